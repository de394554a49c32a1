"""Accumulators of ``$group`` and ``$bucket`` as aggregate columns.

Sums, averages, extremes and deviations combine on the map side.  ``$first`` and
``$last`` are minimum and maximum by the pipeline's order; ``$push`` sorts by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.expr import Compiler, Scope
from tarn.functions.types import DOUBLE, INT, LONG, PipelineError, Typed, is_integer, is_number, null_of

#: one sort key: column, whether it descends, and its type
Order = Sequence[tuple[Column, bool, T.DataType]]


def _turned(c: Column, t: T.DataType) -> list[Column] | None:
    """Columns that sort ascending as ``c`` sorts descending (nulls last); None for types that have none."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return [c.isNull(), ~F.isnan(c), -c]
    if is_integer(t):
        return [c.isNull(), F.bitwise_not(c)]
    if isinstance(t, T.DecimalType):
        return [c.isNull(), -c]
    if isinstance(t, T.BooleanType):
        return [c.isNull(), ~c]
    if isinstance(t, T.DateType):
        return [c.isNull(), -F.unix_date(c)]
    if isinstance(t, T.TimestampType):
        return [c.isNull(), F.bitwise_not(F.unix_micros(c))]
    return None


def _rank(order: Order) -> Column | None:
    """A struct that sorts ascending in pipeline order; None if a descending key cannot be turned."""
    parts: list[Column] = []
    for c, descending, t in order:
        turned = _turned(c, t) if descending else [c.isNotNull(), c]
        if turned is None:
            return None
        parts += turned
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def _ordered_list(x: Column, order: Order) -> Column:
    """All values, nulls kept, in pipeline order."""
    if not order:
        return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda e: e.getField("x"))
    keys = [c.alias(f"o{i}") for i, (c, _, _) in enumerate(order)]
    rows = F.collect_list(F.struct(*keys, x.alias("x")))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(order))):
            p, q = a.getField(f"o{i}"), b.getField(f"o{i}")
            lower, higher = (F.lit(1), F.lit(-1)) if order[i][1] else (F.lit(-1), F.lit(1))
            first = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), lower).when(q.isNull(), higher)
            out = first.when(p < q, lower).when(p > q, higher).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, before), lambda e: e.getField("x"))


def _edge(x: Column, order: Order, last: bool) -> Column:
    boxed = F.struct(x.alias("x"))
    if not order:
        return (F.last if last else F.first)(boxed).getField("x")
    rank = _rank(order)
    if rank is None:
        if all(d for _, d, _ in order):
            # all descending: the first is the greatest
            rank = F.struct(*[p.alias(f"o{i}") for i, p in enumerate([q for c, _, _ in order for q in (c.isNotNull(), c)])])
            return (F.min_by if last else F.max_by)(boxed, rank).getField("x")
        # a text that descends beside a key that ascends: only here are the group's values gathered
        ordered = _ordered_list(x, order)
        return F.try_element_at(ordered, F.lit(-1 if last else 1))
    return (F.max_by if last else F.min_by)(boxed, rank).getField("x")


def accumulate(spec: Any, schema: T.StructType, order: Order = (), name: str = "") -> Typed:
    """One accumulator document, such as ``{"$sum": "$x"}``, as an aggregate."""
    if not isinstance(spec, dict) or not spec:
        raise PipelineError(f"field {name} of $group must be an accumulator document")
    op, arg = next(iter(spec.items()))
    if op == "$count":
        return Typed(F.count(F.lit(1)).cast("int"), INT)
    c = Compiler(Scope(schema))
    v = c(arg[0] if isinstance(arg, list) and len(arg) == 1 else arg)
    numeric = is_number(v.type)
    if op == "$sum":
        if not numeric:
            return Typed(F.coalesce(F.sum(F.lit(None).cast("int")), F.lit(0)).cast("long"), LONG)
        t = LONG if is_integer(v.type) else T.DecimalType(38, v.type.scale) if isinstance(v.type, T.DecimalType) else DOUBLE
        if v.constant and is_integer(v.type):
            return Typed((F.count(F.lit(1)) * v.value).cast("long"), LONG)  # counting needs no column
        return Typed(F.coalesce(F.sum(v.col.cast(t)), F.lit(0)).cast(t), t)
    if op == "$avg":
        return Typed(F.avg(v.col.cast("double")), DOUBLE) if numeric else Typed(F.avg(F.lit(None).cast("double")), DOUBLE)
    if op in ("$stdDevPop", "$stdDevSamp"):
        x = v.col.cast("double") if numeric else null_of(DOUBLE).col
        return Typed((F.stddev_pop if op == "$stdDevPop" else F.stddev_samp)(x), DOUBLE)
    if op == "$min":
        return Typed(F.min(v.col), v.type)
    if op == "$max":
        return Typed(F.max(v.col), v.type)
    if op in ("$first", "$last"):
        return Typed(_edge(v.col, order, op == "$last"), v.type)
    if op == "$push":
        return Typed(_ordered_list(v.col, order), T.ArrayType(v.type, True))
    if op == "$addToSet":
        boxed = F.collect_set(F.struct(v.col.alias("x")))
        return Typed(F.transform(F.array_sort(boxed) if _sortable(v.type) else boxed, lambda e: e.getField("x")), T.ArrayType(v.type, True))
    raise PipelineError(f"unknown accumulator {op}")


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return False
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t.fields)
    return not isinstance(t, T.NullType)
