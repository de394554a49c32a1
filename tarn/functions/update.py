"""Update documents as column rewrites.

An update becomes, for every path it names, a new value of the row as it was;
the executor puts these under the filter of the update.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import paths
from tarn.functions.expr import literal, slice_of
from tarn.functions.match import Matcher, is_operator_document
from tarn.functions.types import DATE, LONG, PipelineError, Typed, as_type, compare, equal, is_null, is_number, less, widest

UPDATES: dict[str, Callable[[Typed, Any, T.StructType], Typed | None]] = {}


def _update(name: str) -> Callable:
    def register(f: Callable) -> Callable:
        UPDATES[name] = f
        return f

    return register


def compile_update(spec: dict[str, Any], schema: T.StructType, inserting: bool = False) -> dict[str, Typed | None]:
    """Path to new value (None removes the path).  ``$setOnInsert`` counts only when ``inserting``."""
    if not isinstance(spec, dict) or not spec:
        raise PipelineError("an update is a document of operators")
    if not all(k.startswith("$") for k in spec):
        raise PipelineError("an update cannot mix operators and fields; use replace for whole documents")
    out: dict[str, Typed | None] = {}
    for op, fields in spec.items():
        if op == "$setOnInsert":
            if inserting:
                out |= {p: literal(v) for p, v in fields.items()}
            continue
        if op == "$rename":
            for old, new in fields.items():
                if paths.exists(schema, old):
                    out[new], out[old] = paths.resolve(schema, old), None
            continue
        f = UPDATES.get(op)
        if f is None:
            raise PipelineError(f"unknown update operator {op}")
        for path, arg in fields.items():
            if "$" in path:
                raise PipelineError("positional paths are not supported")
            if path in out:
                raise PipelineError(f"{path} is updated twice")
            out[path] = f(paths.resolve(schema, path), arg, schema)
    return out


@_update("$set")
def _set(_: Typed, arg: Any, __: T.StructType) -> Typed:
    return literal(arg)


@_update("$unset")
def _unset(_: Typed, __: Any, ___: T.StructType) -> None:
    return None


def _numbers(old: Typed, arg: Any, name: str) -> tuple[Column, Column, T.DataType]:
    v = literal(arg)
    if not is_number(v.type) or not (is_number(old.type) or is_null(old.type)):
        raise PipelineError(f"{name} requires numbers")
    t = widest([old.type, v.type])
    return F.coalesce(old.col.cast(t), F.lit(0).cast(t)), as_type(v, t), t


@_update("$inc")
def _inc(old: Typed, arg: Any, _: T.StructType) -> Typed:
    a, b, t = _numbers(old, arg, "$inc")
    return Typed(a + b, t)


@_update("$mul")
def _mul(old: Typed, arg: Any, _: T.StructType) -> Typed:
    a, b, t = _numbers(old, arg, "$mul")
    return Typed(a * b, t)


def _extreme(name: str, keep_new: Callable[[Typed, Typed], Column]) -> None:
    def run(old: Typed, arg: Any, _: T.StructType) -> Typed:
        v = literal(arg)
        t = widest([old.type, v.type])
        return Typed(F.when(old.col.isNull() | keep_new(v, old), as_type(v, t)).otherwise(as_type(old, t)), t)

    UPDATES[name] = run


_extreme("$min", lambda new, old: less(new, old))
_extreme("$max", lambda new, old: less(old, new))


@_update("$currentDate")
def _current_date(_: Typed, arg: Any, __: T.StructType) -> Typed:
    if arg is not True and not (isinstance(arg, dict) and arg.get("$type") in ("date", "timestamp")):
        raise PipelineError("$currentDate requires true or a type")
    return Typed(F.current_timestamp(), DATE)


def _list(old: Typed, kind: T.DataType, name: str) -> tuple[Column, T.ArrayType]:
    if is_null(old.type):
        t = T.ArrayType(kind, True)
        return F.array().cast(t), t
    if not isinstance(old.type, T.ArrayType):
        raise PipelineError(f"{name} requires an array")
    t = T.ArrayType(widest([old.type.elementType, kind]), True)
    return F.coalesce(old.col.cast(t), F.array().cast(t)), t


def _each(arg: Any) -> tuple[list[Any], dict]:
    if isinstance(arg, dict) and "$each" in arg:
        return list(arg["$each"]), arg
    return [arg], {}


def _sorted(a: Column, kind: T.DataType, by: Any) -> Column:
    if isinstance(by, dict):
        keys = [(k, d < 0) for k, d in by.items()]

        def value(x: Column, k: str) -> Typed:
            return paths.walk(Typed(x, kind), k.split(".")) or Typed(F.lit(None), T.NullType())
    else:
        keys = [("", by < 0)]

        def value(x: Column, _: str) -> Typed:
            return Typed(x, kind)

    def before(x: Column, y: Column) -> Column:
        out: Column = F.lit(0)
        for k, descending in reversed(keys):
            c = compare(value(x, k), value(y, k))
            c = -c if descending else c
            out = F.when(c != 0, c).otherwise(out)
        return out

    return F.array_sort(a, before)


@_update("$push")
def _push(old: Typed, arg: Any, _: T.StructType) -> Typed:
    items, options = _each(arg)
    new = [literal(i) for i in items]
    kind = widest([n.type for n in new])
    a, t = _list(old, kind, "$push")
    added = F.array(*[as_type(n, t.elementType) for n in new]).cast(t)
    position = options.get("$position")
    if position is None or position < 0:
        out = F.concat(a, added)
    else:
        out = F.concat(F.slice(a, F.lit(1), F.lit(position)), added, F.slice(a, F.lit(position + 1), F.greatest(F.size(a), F.lit(0))))
    if "$sort" in options:
        out = _sorted(out, t.elementType, options["$sort"])
    if "$slice" in options:
        out = slice_of(out, F.lit(int(options["$slice"])))
    return Typed(out, t)


def _holds(a: Column, kind: T.DataType, v: Typed) -> Column:
    return F.exists(a, lambda x: equal(Typed(x, kind), v))


def _rid_of(a: Column, kind: T.DataType, v: Typed) -> Column:
    return F.filter(a, lambda x: ~equal(Typed(x, kind), v))


@_update("$addToSet")
def _add_to_set(old: Typed, arg: Any, _: T.StructType) -> Typed:
    items, _options = _each(arg)
    new = [literal(i) for i in items]
    kind = widest([n.type for n in new])
    if not is_null(old.type) and not isinstance(old.type, T.ArrayType):
        old = Typed(F.lit(None), T.NullType())  # anything but an array is replaced
    out, t = _list(old, kind, "$addToSet")
    for n in new:
        one = Typed(as_type(n, t.elementType), t.elementType)
        out = F.when(_holds(out, t.elementType, one), out).otherwise(F.concat(out, F.array(one.col)))
    return Typed(out, t)


def _needs_array(old: Typed, name: str) -> bool:
    if is_null(old.type):
        return False
    if not isinstance(old.type, T.ArrayType):
        raise PipelineError(f"{name} requires an array")
    return True


@_update("$pop")
def _pop(old: Typed, arg: Any, _: T.StructType) -> Typed:
    if not _needs_array(old, "$pop"):
        return old
    n = F.greatest(F.size(old.col) - 1, F.lit(0))
    return Typed(F.slice(old.col, F.lit(2) if arg == -1 else F.lit(1), n), old.type)


@_update("$pull")
def _pull(old: Typed, arg: Any, schema: T.StructType) -> Typed:
    if not _needs_array(old, "$pull"):
        return old
    kind = old.type.elementType
    if is_operator_document(arg):
        m = Matcher(schema)
        return Typed(F.filter(old.col, lambda x: ~m.condition(Typed(x, kind), arg)), old.type)
    return Typed(_rid_of(old.col, kind, literal(arg)), old.type)


@_update("$pullAll")
def _pull_all(old: Typed, arg: Any, _: T.StructType) -> Typed:
    if not _needs_array(old, "$pullAll"):
        return old
    kind, out = old.type.elementType, old.col
    for a in arg:
        out = _rid_of(out, kind, literal(a))
    return Typed(out, old.type)


@_update("$bit")
def _bit(old: Typed, arg: Any, _: T.StructType) -> Typed:
    out = F.coalesce(old.col.cast("long"), F.lit(0).cast("long"))
    for op, n in arg.items():
        mask = F.lit(int(n)).cast("long")
        if op not in ("and", "or", "xor"):
            raise PipelineError(f"$bit: unknown operation {op}")
        out = out.bitwiseAND(mask) if op == "and" else out.bitwiseOR(mask) if op == "or" else out.bitwiseXOR(mask)
    return Typed(out, LONG)


def upsert_base(query: dict[str, Any]) -> dict[str, Any]:
    """The document an upsert starts from: the equalities of the filter."""
    out: dict[str, Any] = {}
    for k, v in query.items():
        if k == "$and":
            for q in v:
                out |= upsert_base(q)
        elif not k.startswith("$"):
            if is_operator_document(v):
                if "$eq" in v:
                    out[k] = v["$eq"]
            else:
                out[k] = v
    return out


__all__ = ["UPDATES", "compile_update", "upsert_base"]
