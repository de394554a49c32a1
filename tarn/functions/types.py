"""Document types over Spark types: names, ranks, truth and comparison.

All decisions are taken on static types while the plan is built; no row pays for
polymorphism.  Comparisons are two-valued: null is equal to null and less than
everything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = T.NullType()
INT, LONG, DOUBLE, STRING, BOOL, DATE = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()


class PipelineError(ValueError):
    """A pipeline, filter or update that cannot be compiled."""


class _NoValue:
    def __repr__(self) -> str:
        return "NO_VALUE"


NO_VALUE = _NoValue()


@dataclass(frozen=True)
class Typed:
    """A column with its static type; ``value`` is set for literals."""

    col: Column
    type: T.DataType
    value: Any = NO_VALUE

    @property
    def constant(self) -> bool:
        return self.value is not NO_VALUE


#: type names and numbers of the document format (fixed values)
TYPE_NUMBERS = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10,
    "regex": 11, "dbPointer": 12, "javascript": 13, "symbol": 14, "javascriptWithScope": 15, "int": 16, "timestamp": 17, "long": 18, "decimal": 19,
    "minKey": -1, "maxKey": 127,
}

#: canonical order of types (fixed values)
RANKS = {"null": 2, "double": 3, "int": 3, "long": 3, "decimal": 3, "string": 5, "object": 6, "array": 7, "binData": 8, "bool": 10, "date": 11}


def type_name(t: T.DataType) -> str:
    """The document type name of a Spark type."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, T.LongType):
        return "long"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.BinaryType):
        return "binData"
    if isinstance(t, T.NullType):
        return "null"
    raise PipelineError(f"no document type for {t.simpleString()}")


def rank(t: T.DataType) -> int:
    return RANKS[type_name(t)]


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def null_of(t: T.DataType = NULL) -> Typed:
    return Typed(F.lit(None) if is_null(t) else F.lit(None).cast(t), t)


def widest(types: Sequence[T.DataType]) -> T.DataType:
    """The type all values can be held in; raises when there is none."""
    out: T.DataType = NULL
    for t in types:
        out = _wider(out, t)
    return out


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or is_null(b):
        return a
    if is_null(a):
        return b
    if is_number(a) and is_number(b):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            if any(isinstance(x, (T.DoubleType, T.FloatType)) for x in (a, b)):
                return DOUBLE
            scale = max(getattr(a, "scale", 0) if isinstance(a, T.DecimalType) else 0, getattr(b, "scale", 0) if isinstance(b, T.DecimalType) else 0)
            return T.DecimalType(38, scale)
        if not (is_integer(a) and is_integer(b)):
            return DOUBLE
        return LONG if isinstance(a, T.LongType) or isinstance(b, T.LongType) else INT
    if is_date(a) and is_date(b):
        return DATE
    if is_string(a) and is_string(b):
        return STRING
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wider(a.elementType, b.elementType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        return T.StructType([T.StructField(x.name, _wider(x.dataType, y.dataType)) for x, y in zip(a.fields, b.fields, strict=True)])
    raise PipelineError(f"values of types {type_name(a)} and {type_name(b)} have no common column type")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    try:
        _wider(a, b)
    except PipelineError:
        return False
    return True


def as_type(v: Typed, t: T.DataType) -> Column:
    return v.col if v.type == t else v.col.cast(t)


def _both(a: Typed, b: Typed) -> tuple[Column, Column]:
    t = _wider(a.type, b.type)
    return as_type(a, t), as_type(b, t)


def equal(a: Typed, b: Typed) -> Column:
    """Two-valued equality; numbers compare across their types."""
    if is_null(b.type) or (b.constant and b.value is None):
        return a.col.isNull()
    if is_null(a.type) or (a.constant and a.value is None):
        return b.col.isNull()
    if not comparable(a.type, b.type):
        return a.col.isNull() & b.col.isNull()
    x, y = _both(a, b)
    return x.eqNullSafe(y)


def less(a: Typed, b: Typed, or_equal: bool = False) -> Column:
    """Two-valued order over all types: null first, then by type, then by value."""
    if not comparable(a.type, b.type):
        by_type = F.lit(rank(a.type) < rank(b.type))
        both_null = a.col.isNull() & b.col.isNull()
        out = F.when(a.col.isNull(), b.col.isNotNull()).when(b.col.isNull(), F.lit(False)).otherwise(by_type)
        return (out | both_null) if or_equal else out
    if is_null(a.type) and is_null(b.type):
        return F.lit(or_equal)
    x, y = _both(a, b)
    out = F.coalesce(x < y, x.isNull() & y.isNotNull())
    return (out | x.eqNullSafe(y)) if or_equal else out


def compare(a: Typed, b: Typed) -> Column:
    """-1, 0 or 1 in canonical order."""
    return F.when(less(a, b), F.lit(-1)).when(equal(a, b), F.lit(0)).otherwise(F.lit(1))


def truthy(v: Typed) -> Column:
    """False for null, false, 0 and the empty text; true for everything else."""
    if is_null(v.type):
        return F.lit(False)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_number(v.type):
        return F.coalesce(v.col != 0, F.lit(False))
    if is_string(v.type):
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def sort_column(c: Column, descending: bool) -> Column:
    """Canonical order: nulls first ascending, last descending."""
    return c.desc_nulls_last() if descending else c.asc_nulls_first()
