"""Compile filter documents into boolean columns.

Predicates stay bare, so that the scan can take them; in a filter null counts as
false anyway.  Before a negation, and where a caller needs a total column, null
is made false first, so the result is two-valued as the filter language demands.

With ``bracketing`` (the default) an order comparison holds only between values
of one kind, so null fails it; without, null is less than everything and values
of unlike kinds compare by kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import paths
from tarn.functions.expr import COMPARE, compile_expression, java_flags, literal
from tarn.functions.types import TYPE_NUMBERS, PipelineError, Typed, comparable, equal, is_integer, is_null, is_number, is_string, type_name


def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def _no(p: Column) -> Column:
    """Two-valued negation."""
    return ~F.coalesce(p, _false())


def _all(ps: list[Column]) -> Column:
    out = None
    for p in ps:
        out = p if out is None else out & p
    return _true() if out is None else out


def _any(ps: list[Column]) -> Column:
    out = None
    for p in ps:
        out = p if out is None else out | p
    return _false() if out is None else out


def is_operator_document(condition: Any) -> bool:
    return isinstance(condition, dict) and any(isinstance(k, str) and k.startswith("$") for k in condition)


@dataclass(frozen=True)
class Matcher:
    """Compiles filters against a schema."""

    schema: T.StructType
    bracketing: bool = True

    def filter(self, spec: dict[str, Any]) -> Column:
        if not isinstance(spec, dict):
            raise PipelineError("a filter is a document")
        parts = [self.element(k, v) for k, v in spec.items()]
        return _all(parts)

    def element(self, key: str, arg: Any) -> Column:
        if key in ("$and", "$or", "$nor"):
            if not isinstance(arg, (list, tuple)):
                raise PipelineError(f"{key} requires an array of filters")
            ps = [self.filter(f) for f in arg]
            return _all(ps) if key == "$and" else _any(ps) if key == "$or" else _no(_any(ps))
        if key == "$expr":
            from tarn.functions.types import truthy

            return truthy(compile_expression(arg, self.schema))
        if key == "$text":
            return self.text(arg)
        if key == "$comment":
            return _true()
        if key.startswith("$"):
            raise PipelineError(f"unknown or unsupported top-level operator {key}")
        return self.condition(paths.resolve(self.schema, key), arg)

    def text(self, arg: Any) -> Column:
        """Case-insensitive substring over all text fields, nested ones too."""
        if not isinstance(arg, dict) or not isinstance(arg.get("$search"), str):
            raise PipelineError("$text requires {$search: text}")
        wanted = arg["$search"].lower()

        def holds(v: Typed) -> list[Column]:
            if is_string(v.type):
                return [F.contains(F.lower(v.col), F.lit(wanted))]
            if isinstance(v.type, T.StructType):
                return [p for f in v.type.fields for p in holds(Typed(v.col.getField(f.name), f.dataType))]
            if isinstance(v.type, T.ArrayType) and holds(Typed(F.lit(None), v.type.elementType)):
                return [F.exists(v.col, lambda x: _any(holds(Typed(x, v.type.elementType))))]
            return []

        return _any([p for f in self.schema.fields for p in holds(Typed(F.col(paths.quoted(f.name)), f.dataType))])

    def condition(self, field: Typed, condition: Any) -> Column:
        if isinstance(condition, re.Pattern):
            return self.regex(field, condition, "")
        if not is_operator_document(condition):
            return self.equality(field, literal(condition))
        parts = []
        for op, arg in condition.items():
            if op == "$options":
                if "$regex" not in condition:
                    raise PipelineError("$options needs $regex")
                continue
            if op == "$regex":
                parts.append(self.regex(field, arg, condition.get("$options", "")))
                continue
            f = FIELD_OPERATORS.get(op)
            if f is None:
                raise PipelineError(f"unknown or unsupported operator {op}")
            parts.append(f(self, field, arg))
        return _all(parts)

    # ---- values ----------------------------------------------------------------------------------------------------

    def elements(self, field: Typed, p: Callable[[Typed], Column]) -> Column:
        """Some element of an array, or the value itself."""
        if isinstance(field.type, T.ArrayType):
            kind = field.type.elementType
            deep = isinstance(kind, T.ArrayType)
            return F.exists(field.col, lambda x: self.elements(Typed(x, kind), p) if deep else p(Typed(x, kind)))
        return p(field)

    def equality(self, field: Typed, v: Typed) -> Column:
        if isinstance(v.value, re.Pattern):
            return self.regex(field, v.value, "")
        if isinstance(field.type, T.ArrayType):
            if v.value is None and v.constant:
                return field.col.isNull() | (F.exists(field.col, lambda x: x.isNull()))
            whole = equal(field, v) if isinstance(v.type, T.ArrayType) and comparable(field.type, v.type) else _false()
            return whole | self.elements(field, lambda x: equal(x, v) if comparable(x.type, v.type) else _false())
        if not comparable(field.type, v.type):
            return _false() if v.value is not None else field.col.isNull()
        if v.constant and v.value is not None:
            # a plain comparison can be pushed into the scan; a null row simply fails it
            return _plain(field, v, lambda a, b: a == b)
        return equal(field, v)

    def order(self, op: str, field: Typed, v: Typed) -> Column:
        def one(x: Typed) -> Column:
            if is_null(v.type):
                return x.col.isNull() if op in ("$lte", "$gte") else (_false() if self.bracketing or op == "$lt" else x.col.isNotNull())
            if self.bracketing:
                if is_null(x.type) or not comparable(x.type, v.type):
                    return _false()
                return _plain(x, v, _ORDER[op])
            return COMPARE[op](x, v)

        if isinstance(field.type, T.ArrayType) and not isinstance(v.type, T.ArrayType):
            if self.bracketing:
                return self.elements(field, one)
            first = Typed(F.get(field.col, F.lit(0)), field.type.elementType)
            return one(first)
        return one(field)

    def regex(self, field: Typed, pattern: Any, options: str) -> Column:
        if isinstance(pattern, re.Pattern):
            options += "".join(f for f, b in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & b)
            pattern = pattern.pattern
        if not isinstance(pattern, str):
            raise PipelineError("$regex requires a pattern")
        java = java_flags(options) + pattern

        def one(x: Typed) -> Column:
            if not is_string(x.type):
                return _false()
            prefix = re.fullmatch(r"\^([A-Za-z0-9 _-]+)", pattern) if not java_flags(options) else None
            return x.col.startswith(prefix[1]) if prefix else x.col.rlike(java)

        return self.elements(field, one)


_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
}


def _plain(a: Typed, b: Typed, f: Callable[[Column, Column], Column]) -> Column:
    """Compare without casting the column where the literal can take its type, so that the scan sees the predicate."""
    if a.type != b.type and is_number(a.type) and is_number(b.type) and b.constant and not isinstance(b.value, bool):
        if is_integer(a.type) and isinstance(b.value, int):
            return f(a.col, F.lit(b.value))
        if isinstance(a.type, (T.DoubleType, T.FloatType)):
            return f(a.col, F.lit(float(b.value)))
    return f(a.col, b.col)


FIELD_OPERATORS: dict[str, Callable[[Matcher, Typed, Any], Column]] = {}


def _field(name: str) -> Callable:
    def register(f: Callable[[Matcher, Typed, Any], Column]) -> Callable:
        FIELD_OPERATORS[name] = f
        return f

    return register


@_field("$eq")
def _eq(m: Matcher, field: Typed, arg: Any) -> Column:
    return m.equality(field, literal(arg))


@_field("$ne")
def _ne(m: Matcher, field: Typed, arg: Any) -> Column:
    return _no(m.equality(field, literal(arg)))


for _op in _ORDER:
    FIELD_OPERATORS[_op] = lambda m, field, arg, op=_op: m.order(op, field, literal(arg))


def _list(arg: Any, name: str) -> list:
    if not isinstance(arg, (list, tuple)):
        raise PipelineError(f"{name} requires an array")
    return list(arg)


@_field("$in")
def _in(m: Matcher, field: Typed, arg: Any) -> Column:
    values = _list(arg, "$in")
    plain = [v for v in values if v is not None and not isinstance(v, (re.Pattern, list, tuple, dict))]
    rest = [v for v in values if v is None or isinstance(v, (re.Pattern, list, tuple, dict))]
    parts = [m.equality(field, literal(v)) if not isinstance(v, re.Pattern) else m.regex(field, v, "") for v in rest]
    if plain and not isinstance(field.type, T.ArrayType):
        fit = [literal(v) for v in plain]
        fit = [v for v in fit if comparable(field.type, v.type) and not is_null(field.type)]
        if fit:
            parts.append(field.col.isin([v.col if not is_number(v.type) else _number(field.type, v.value) for v in fit]))
    else:
        parts += [m.equality(field, literal(v)) for v in plain]
    return _any(parts)


def _number(t: T.DataType, value: Any) -> Column:
    return F.lit(float(value)) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(value)


@_field("$nin")
def _nin(m: Matcher, field: Typed, arg: Any) -> Column:
    return _no(_in(m, field, arg))


@_field("$exists")
def _exists(_: Matcher, field: Typed, arg: Any) -> Column:
    present = _false() if is_null(field.type) else field.col.isNotNull()
    return present if arg else ~present


@_field("$type")
def _type(_: Matcher, field: Typed, arg: Any) -> Column:
    wanted = set()
    numbers = {v: k for k, v in TYPE_NUMBERS.items()}
    for a in arg if isinstance(arg, (list, tuple)) else [arg]:
        if a == "number":
            wanted |= {"int", "long", "double", "decimal"}
        elif a in TYPE_NUMBERS:
            wanted.add(a)
        elif isinstance(a, (int, float)) and int(a) in numbers:
            wanted.add(numbers[int(a)])
        else:
            raise PipelineError(f"$type: unknown type {a}")
    own = field.col.isNotNull() if not is_null(field.type) and type_name(field.type) in wanted else _false()
    return own | field.col.isNull() if "null" in wanted else own


@_field("$mod")
def _mod(m: Matcher, field: Typed, arg: Any) -> Column:
    pair = _list(arg, "$mod")
    if len(pair) != 2 or int(pair[0]) == 0:
        raise PipelineError("$mod requires [divisor, remainder] with a divisor other than 0")
    d, r = int(pair[0]), int(pair[1])

    def one(x: Typed) -> Column:
        if not is_number(x.type):
            return _false()
        whole = x.col if is_integer(x.type) else x.col.cast("long")
        return whole % F.lit(d) == F.lit(r)

    return m.elements(field, one)


@_field("$all")
def _all_of(m: Matcher, field: Typed, arg: Any) -> Column:
    values = _list(arg, "$all")
    if not values:
        return _false()
    return _all([_elem_match(m, field, v["$elemMatch"]) if isinstance(v, dict) and "$elemMatch" in v else m.equality(field, literal(v)) for v in values])


@_field("$elemMatch")
def _elem_match(m: Matcher, field: Typed, arg: Any) -> Column:
    if not isinstance(field.type, T.ArrayType):
        return _false()
    return F.exists(field.col, element_predicate(m, field.type.elementType, arg))


def element_predicate(m: Matcher, kind: T.DataType, arg: dict) -> Callable[[Column], Column]:
    """The predicate of $elemMatch on one element."""
    if isinstance(kind, T.StructType) and not (is_operator_document(arg) and not any(k in ("$and", "$or", "$nor") for k in arg)):
        return lambda x: _ElementMatcher(kind, m.bracketing, x).filter(arg)
    return lambda x: m.condition(Typed(x, kind), arg)


@dataclass(frozen=True)
class _ElementMatcher(Matcher):
    """Fields are those of an array element."""

    at: Column | None = None

    def __init__(self, schema: T.StructType, bracketing: bool, at: Column) -> None:
        object.__setattr__(self, "schema", schema)
        object.__setattr__(self, "bracketing", bracketing)
        object.__setattr__(self, "at", at)

    def element(self, key: str, arg: Any) -> Column:
        if key in ("$expr", "$text"):
            raise PipelineError(f"{key} is not allowed inside $elemMatch")
        if key.startswith("$"):
            return super().element(key, arg)
        found = paths.walk(Typed(self.at, self.schema), key.split("."))
        return self.condition(found if found is not None else Typed(F.lit(None), T.NullType()), arg)


@_field("$size")
def _size(_: Matcher, field: Typed, arg: Any) -> Column:
    if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg != int(arg) or arg < 0:
        raise PipelineError("$size requires a non-negative integer")
    if not isinstance(field.type, T.ArrayType):
        return _false()
    return F.size(field.col) == int(arg)


@_field("$not")
def _not(m: Matcher, field: Typed, arg: Any) -> Column:
    if not isinstance(arg, re.Pattern) and not is_operator_document(arg):
        raise PipelineError("$not requires an operator document or a pattern")
    return _no(m.condition(field, arg))


def _mask(arg: Any, name: str) -> int:
    if isinstance(arg, (list, tuple)):
        return sum(1 << int(i) for i in set(arg))
    if isinstance(arg, (bytes, bytearray)):
        return int.from_bytes(arg, "little")
    if isinstance(arg, bool) or not isinstance(arg, int) or arg < 0:
        raise PipelineError(f"{name} requires a mask or positions")
    return arg


def _bits(name: str, test: Callable[[Column, Column], Column]) -> None:
    def compile_(m: Matcher, field: Typed, arg: Any) -> Column:
        mask = F.lit(_mask(arg, name)).cast("long")

        def one(x: Typed) -> Column:
            if not is_number(x.type):
                return _false()
            if is_integer(x.type):
                return test(x.col.cast("long").bitwiseAND(mask), mask)
            whole = F.when(x.col == F.floor(x.col), F.floor(x.col).cast("long"))  # fractions never match
            return test(whole.bitwiseAND(mask), mask)

        return m.elements(field, one)

    FIELD_OPERATORS[name] = compile_


_bits("$bitsAllSet", lambda b, mask: b == mask)
_bits("$bitsAnySet", lambda b, mask: b != 0)
_bits("$bitsAllClear", lambda b, mask: b == 0)
_bits("$bitsAnyClear", lambda b, mask: b != mask)


def compile_match(spec: dict[str, Any], schema: T.StructType, bracketing: bool = True, total: bool = False) -> Column:
    """The filter as one boolean column; null means no match, and is never given if ``total``."""
    p = Matcher(schema, bracketing).filter(spec)
    return F.coalesce(p, _false()) if total else p


__all__ = ["Matcher", "compile_match", "element_predicate", "is_operator_document"]
