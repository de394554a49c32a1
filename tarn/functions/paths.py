"""Dotted paths over nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.types import NULL, Typed


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def root(schema: T.StructType, name: str) -> Typed | None:
    """A top-level field, exactly as named (a dotted column name wins over a path)."""
    if name in schema.names:
        return Typed(F.col(quoted(name)), schema[name].dataType)
    return None


def step(at: Typed, segment: str) -> Typed | None:
    """One segment further: a field, an array position, a map key, or a field of every element."""
    t = at.type
    if isinstance(t, T.StructType):
        if segment in t.names:
            return Typed(at.col.getField(segment), t[segment].dataType)
        return None
    if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        return Typed(F.try_element_at(at.col, F.lit(segment)), t.valueType)
    if isinstance(t, T.ArrayType):
        if segment.isdigit():
            return Typed(F.get(at.col, F.lit(int(segment))), t.elementType)
        inner = step(Typed(F.lit(None), t.elementType), segment)
        if inner is None:
            return None
        return Typed(F.transform(at.col, lambda x: step(Typed(x, t.elementType), segment).col), T.ArrayType(inner.type, True))
    return None


def walk(start: Typed, segments: list[str]) -> Typed | None:
    at: Typed | None = start
    for s in segments:
        at = step(at, s)
        if at is None:
            return None
    return at


def resolve(schema: T.StructType, path: str) -> Typed:
    """The column at ``path``; a path the schema does not have is a null of no type."""
    whole = root(schema, path)
    if whole is not None:
        return whole
    head, *rest = path.split(".")
    start = root(schema, head)
    found = walk(start, rest) if start is not None else None
    return found if found is not None else Typed(F.lit(None), NULL)


def exists(schema: T.StructType, path: str) -> bool:
    found = resolve(schema, path)
    return not isinstance(found.type, T.NullType) or path in schema.names


def with_path(schema: T.StructType, path: str, value: Typed | None) -> tuple[str, Column | None, T.DataType | None]:
    """The top-level column to replace so that ``path`` holds ``value`` (None removes it).

    Returns the column's name, expression and type; parents that are missing are
    created, and the column is None when the top-level field itself is removed.
    """
    if path in schema.names or "." not in path:
        return path, None if value is None else value.col, None if value is None else value.type
    head, *rest = path.split(".")
    current = root(schema, head)
    col, t = _rebuild(current, rest, value)
    return head, col, t


def _rebuild(at: Typed | None, segments: list[str], value: Typed | None) -> tuple[Column | None, T.DataType | None]:
    if not segments:
        return (None, None) if value is None else (value.col, value.type)
    name, rest = segments[0], segments[1:]
    if at is not None and isinstance(at.type, T.ArrayType) and isinstance(at.type.elementType, T.StructType):
        kind = _rebuild(Typed(F.lit(None), at.type.elementType), segments, value)[1]
        return F.transform(at.col, lambda x: _rebuild(Typed(x, at.type.elementType), segments, value)[0]), T.ArrayType(kind, True)
    fields = list(at.type.fields) if at is not None and isinstance(at.type, T.StructType) else []
    parts: list[Column] = []
    types: list[T.StructField] = []
    seen = False
    for f in fields:
        if f.name != name:
            parts.append(at.col.getField(f.name).alias(f.name))
            types.append(f)
            continue
        seen = True
        col, t = _rebuild(Typed(at.col.getField(name), f.dataType), rest, value)
        if col is not None:
            parts.append(col.alias(name))
            types.append(T.StructField(name, t))
    if not seen and value is not None:
        col, t = _rebuild(None, rest, value)
        parts.append(col.alias(name))
        types.append(T.StructField(name, t))
    if not parts:
        return None, None
    out = F.struct(*parts)
    if value is None and at is not None:
        out = F.when(at.col.isNotNull(), out)
    return out, T.StructType(types)
