"""Document mode: heterogeneous documents in a VARIANT column.

Only here can a field be missing rather than null and hold values of several
types.  VARIANT can be neither sorted nor grouped, so both use a canonical key:
a struct of type rank and the value in the slot of its kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.expr import java_flags
from tarn.functions.types import RANKS, TYPE_NUMBERS, PipelineError

#: document type of a variant's own type name (fixed values); integers are told apart by size
_KINDS = {"VOID": "null", "BOOLEAN": "bool", "STRING": "string", "DOUBLE": "double", "FLOAT": "double", "DATE": "date", "TIMESTAMP": "date", "BINARY": "binData"}


def documents(spark: SparkSession, texts: Sequence[str] | DataFrame, column: str = "value") -> DataFrame:
    """A table with one VARIANT column ``doc`` from JSON texts; a text that is no JSON becomes null."""
    df = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(t,) for t in texts], f"{column} string")
    return df.select(F.try_parse_json(F.col(column)).alias("doc"))


def _json_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split("."))


def at(path: str, doc: str | Column = "doc") -> Column:
    """The variant at a path: SQL NULL when missing, a variant null when explicitly null."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, _json_path(path), "variant")


def type_of(v: Column) -> Column:
    """The document type name; "missing" when there is no value."""
    s = F.schema_of_variant(v)
    out = F.when(v.isNull(), F.lit("missing")).when(F.is_variant_null(v), F.lit("null"))
    for k, t in _KINDS.items():
        out = out.when(s == k, F.lit(t))
    whole = F.try_variant_get(v, "$", "bigint")
    small = whole.between(-(2**31), 2**31 - 1)
    out = out.when(s.startswith("BIGINT"), F.when(small, F.lit("int")).otherwise(F.lit("long")))
    out = out.when(s.startswith("DECIMAL"), F.lit("double")).when(s.startswith("ARRAY"), F.lit("array")).when(s.startswith("OBJECT"), F.lit("object"))
    return out.when(s.startswith("TIMESTAMP"), F.lit("date")).otherwise(F.lit("other"))


def sort_key(v: Column) -> Column:
    """Canonical key: (rank, number, text).  Missing and null share the lowest rank; 1 equals 1.0."""
    t = type_of(v)
    rank = F.when(t == "missing", F.lit(RANKS["null"]))
    for name, r in RANKS.items():
        rank = rank.when(t == name, F.lit(r))
    number = F.when(t.isin("int", "long", "double"), F.try_variant_get(v, "$", "double")).when(t == "bool", F.try_variant_get(v, "$", "boolean").cast("double"))
    text = F.when(t == "string", F.try_variant_get(v, "$", "string")).when(t.isin("object", "array", "date", "binData"), F.to_json(v))
    return F.struct(rank.otherwise(50).alias("rank"), number.alias("number"), text.alias("text"))


def _key_of(value: Any) -> Column:
    """The canonical key of a constant."""
    if value is None:
        rank, number, text = RANKS["null"], None, None
    elif isinstance(value, bool):
        rank, number, text = RANKS["bool"], float(value), None
    elif isinstance(value, (int, float)):
        rank, number, text = RANKS["int"], float(value), None
    elif isinstance(value, str):
        rank, number, text = RANKS["string"], None, value
    else:
        raise PipelineError("document mode compares with null, booleans, numbers and texts")
    return F.struct(F.lit(rank).alias("rank"), F.lit(number).cast("double").alias("number"), F.lit(text).cast("string").alias("text"))


def _elements(v: Column) -> Column:
    """The elements of an array variant; no array has none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


#: whether some value that a path leads to passes a test
Reach = Callable[[Callable[[Column], Column]], Column]


def _reach(doc: Column, path: str) -> Reach:
    """The values of a path: its own, and through every array of documents on the way those of the elements."""
    parts = path.split(".")

    def reach(test: Callable[[Column], Column]) -> Column:
        out = test(at(path, doc))
        for i in range(1, len(parts)):
            if not parts[i].isdigit():
                out = out | F.exists(_elements(at(".".join(parts[:i]), doc)), _below(".".join(parts[i:]), test))
        return out

    return reach


def _below(path: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: test(at(path, x))


def _itself(v: Column) -> Reach:
    return lambda test: test(v)


def _with_elements(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The test on a value or on some element of it."""
    return lambda v: test(v) | F.exists(_elements(v), lambda x: test(x))


def _is(value: Any) -> Callable[[Column], Column]:
    if isinstance(value, (list, tuple, dict)):
        key = sort_key(F.parse_json(F.lit(json.dumps(value))))
    else:
        key = _key_of(value)
    return lambda v: sort_key(v).eqNullSafe(key)


def _compares(op: str, value: Any) -> Callable[[Column], Column]:
    key = _key_of(value)

    def test(v: Column) -> Column:
        own = sort_key(v)
        p = {"$gt": own > key, "$gte": own >= key, "$lt": own < key, "$lte": own <= key}[op]
        return (own.getField("rank") == key.getField("rank")) & F.coalesce(p, F.lit(False))

    return test


def _number(v: Column) -> Column:
    return F.when(type_of(v).isin("int", "long", "double"), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(type_of(v) == "string", F.try_variant_get(v, "$", "string"))


def _bits(op: str, arg: Any) -> Callable[[Column], Column]:
    mask = F.lit(sum(1 << int(i) for i in set(arg)) if isinstance(arg, (list, tuple)) else int(arg)).cast("long")

    def test(v: Column) -> Column:
        x = _number(v)
        held = F.when(x == F.floor(x), x.cast("long")).bitwiseAND(mask)
        p = {"$bitsAllSet": held == mask, "$bitsAnySet": held != 0, "$bitsAllClear": held == 0, "$bitsAnyClear": held != mask}[op]
        return F.coalesce(p, F.lit(False))

    return test


def _some_element(spec: dict[str, Any]) -> Callable[[Column], Column]:
    """An element of an array that meets a condition, or as a document a filter."""
    of_value = any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec)
    return lambda v: F.exists(_elements(v), lambda x: condition(x, spec) if of_value else _filter(spec, x))


def condition(v: Column | Reach, spec: Any) -> Column:
    """A field condition on a variant (or on the values of a path), two-valued.

    Equality, comparisons, ``$in``, ``$all``, ``$mod``, ``$regex`` and the bit operators hold for a
    value or for some element of an array; ``$type``, ``$size`` and ``$elemMatch`` speak of the
    value itself.
    """
    reach = _itself(v) if isinstance(v, Column) else v
    if isinstance(spec, re.Pattern):
        spec = {"$regex": spec.pattern, "$options": "".join(f for f, b in (("i", re.I), ("m", re.M), ("s", re.S)) if spec.flags & b)}
    if not (isinstance(spec, dict) and any(k.startswith("$") for k in spec)):
        return reach(_with_elements(_is(spec)))
    out = F.lit(True)
    for op, arg in spec.items():
        if op in ("$eq", "$ne"):
            p = reach(_with_elements(_is(arg)))
            p = ~p if op == "$ne" else p
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            p = reach(_with_elements(_compares(op, arg)))
        elif op in ("$in", "$nin"):
            hit = F.lit(False)
            for a in arg:
                hit = hit | (condition(reach, a) if isinstance(a, re.Pattern) else reach(_with_elements(_is(a))))
            p = hit if op == "$in" else ~hit
        elif op == "$all":
            p = F.lit(bool(arg))
            for a in arg:
                p = p & (condition(reach, a) if isinstance(a, dict) and "$elemMatch" in a else reach(_with_elements(_is(a))))
        elif op == "$elemMatch":
            p = reach(_some_element(arg))
        elif op == "$exists":
            p = reach(lambda x: x.isNotNull())
            p = p if arg else ~p
        elif op == "$type":
            numbers = {n: k for k, n in TYPE_NUMBERS.items()}
            names = [numbers.get(a, a) for a in (arg if isinstance(arg, (list, tuple)) else [arg])]
            names += ["int", "long", "double", "decimal"] if "number" in names else []
            p = reach(lambda x: type_of(x).isin(names))  # noqa: B023 - used at once
        elif op == "$size":
            p = reach(lambda x: (type_of(x) == "array") & (F.size(_elements(x)) == arg))  # noqa: B023
        elif op == "$mod":
            if not isinstance(arg, (list, tuple)) or len(arg) != 2 or int(arg[0]) == 0:
                raise PipelineError("$mod requires a divisor other than 0 and a remainder")
            p = reach(_with_elements(lambda x: F.coalesce(_number(x).cast("long") % int(arg[0]) == int(arg[1]), F.lit(False))))  # noqa: B023
        elif op == "$regex":
            pattern, options = (arg.pattern, "") if isinstance(arg, re.Pattern) else (arg, spec.get("$options", ""))
            p = reach(_with_elements(lambda x: F.coalesce(_text(x).rlike(java_flags(options) + pattern), F.lit(False))))  # noqa: B023
        elif op == "$options":
            if "$regex" not in spec:
                raise PipelineError("$options needs $regex")
            continue
        elif op.startswith("$bits"):
            p = reach(_with_elements(_bits(op, arg)))
        elif op == "$not":
            p = ~condition(reach, arg)
        else:
            raise PipelineError(f"{op} is not available in document mode")
        out = out & p
    return out


def match(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    return df.where(_filter(spec, F.col("doc")))


def _filter(spec: dict[str, Any], doc: Column) -> Column:
    out = F.lit(True)
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            p = F.lit(k == "$and")
            for q in (_filter(s, doc) for s in v):
                p = (p & q) if k == "$and" else (p | q)
            out = out & (~p if k == "$nor" else p)
        elif k == "$expr":
            out = out & _test(v, doc)
        elif k.startswith("$"):
            raise PipelineError(f"{k} is not available in document mode")
        else:
            out = out & condition(_reach(doc, k), v)
    return out


def _operand(e: Any, doc: Column) -> Column:
    """The canonical key of a path or a constant."""
    if isinstance(e, str) and e.startswith("$"):
        return sort_key(at(e[1:], doc))
    return _key_of(e["$literal"] if isinstance(e, dict) and set(e) == {"$literal"} else e)


def _test(e: Any, doc: Column) -> Column:
    """A boolean expression over paths and constants, in canonical order."""
    if isinstance(e, bool):
        return F.lit(e)
    if not (isinstance(e, dict) and len(e) == 1):
        raise PipelineError("$expr takes one comparison or logical operator in document mode")
    op, args = next(iter(e.items()))
    if op in ("$and", "$or"):
        out = F.lit(op == "$and")
        for a in args:
            out = (out & _test(a, doc)) if op == "$and" else (out | _test(a, doc))
        return out
    if op == "$not":
        return ~_test(args[0] if isinstance(args, (list, tuple)) else args, doc)
    if op not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        raise PipelineError(f"{op} is not available in $expr in document mode")
    a, b = (_operand(x, doc) for x in args)
    if op in ("$eq", "$ne"):
        return a.eqNullSafe(b) if op == "$eq" else ~a.eqNullSafe(b)
    return F.coalesce({"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op], F.lit(False))


# ---- stages --------------------------------------------------------------------------------------------------------


def _value(e: Any, doc: Column) -> Column:
    """A path, a constant or a document of these as a variant."""
    if isinstance(e, str) and e.startswith("$"):
        return at(e[1:], doc)
    if isinstance(e, dict) and not any(k.startswith("$") for k in e):
        return _object({k: _value(x, doc) for k, x in e.items()})
    return F.parse_json(F.lit(json.dumps(e["$literal"] if isinstance(e, dict) and set(e) == {"$literal"} else e)))


def _object(fields: dict[str, Column]) -> Column:
    """Variants as one document; missing fields stay missing."""
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))) if fields else F.parse_json(F.lit("{}"))


def project_documents(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Documents of the fields named: ``{"a": 1}`` keeps a path (under its last name), ``{"b": "$a.c"}`` computes one."""
    fields = {}
    for k, v in spec.items():
        if v is True or v == 1:
            fields[k.split(".")[-1]] = at(k)
        elif v is False or v == 0:
            raise PipelineError("document mode projects by inclusion")
        else:
            fields[k] = _value(v, F.col("doc"))
    return df.select(_object(fields).alias("doc"))


def unwind(df: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """One document per element of the array at a path, in the field of the path's last name beside ``_doc``, the whole one.

    A value that is no array counts as one element; missing, null and empty ones go unless ``keep``.
    """
    v = at(path)
    each = F.when(type_of(v) == "array", _elements(v)).when(type_of(v).isin("missing", "null"), F.array().cast("array<variant>")).otherwise(F.array(v))
    one = df.select("doc", (F.explode_outer if keep else F.explode)(each).alias("_x"))
    return one.select(_object({path.split(".")[-1]: F.col("_x"), "_doc": F.col("doc")}).alias("doc"))


def group(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """``$group`` by a path, a document of paths or null: columns ``_id`` (a variant) and one per accumulator.

    Documents group by their canonical key, so 1 and 1.0 are one group and missing
    and null another.  ``$sum`` and ``$avg`` take numbers only and give doubles; ``$min`` and
    ``$max`` follow the canonical order and pass over missing and null; ``$first`` is any
    value, documents having no order; ``$push`` collects the group's values.
    """
    expr = spec.get("_id")
    parts = {"": expr} if not isinstance(expr, dict) else expr
    keys = {f"_g{i}": sort_key(_value(e, F.col("doc"))) if e is not None else F.lit(None) for i, e in enumerate(parts.values())}
    rows = df.select("doc", *[k.alias(n) for n, k in keys.items()])
    aggs = [F.first(_value(expr, F.col("doc")) if expr is not None else F.parse_json(F.lit("null"))).alias("_id")]
    for name, acc in spec.items():
        if name == "_id":
            continue
        op, arg = next(iter(acc.items()))
        if op == "$count" or (op == "$sum" and isinstance(arg, (int, float)) and not isinstance(arg, bool)):
            aggs.append((F.count(F.lit(1)) * F.lit(1 if op == "$count" else arg)).alias(name))
            continue
        v = _value(arg, F.col("doc"))
        if op == "$sum":
            aggs.append(F.coalesce(F.sum(_number(v)), F.lit(0.0)).alias(name))
        elif op == "$avg":
            aggs.append(F.avg(_number(v)).alias(name))
        elif op in ("$min", "$max"):
            there = F.when(~type_of(v).isin("missing", "null"), sort_key(v))
            aggs.append((F.min_by if op == "$min" else F.max_by)(v, there).alias(name))
        elif op == "$first":
            aggs.append(F.first(v, ignorenulls=True).alias(name))
        elif op == "$push":
            aggs.append(F.collect_list(v).alias(name))
        else:
            raise PipelineError(f"{op} is not available in document mode")
    return rows.groupBy(*keys).agg(*aggs).drop(*keys)


def aggregate(df: DataFrame, pipeline: Sequence[dict[str, Any]]) -> DataFrame:
    """A pipeline over documents: match, project, unwind, sort, skip, limit, count, sortByCount and, as the last but for sort and limit, group."""
    for s in pipeline:
        name, spec = next(iter(s.items()))
        if name == "$match":
            df = match(df, spec)
        elif name == "$project":
            df = project_documents(df, spec)
        elif name == "$unwind":
            path, keep = (spec, False) if isinstance(spec, str) else (spec["path"], bool(spec.get("preserveNullAndEmptyArrays")))
            df = unwind(df, path.lstrip("$"), keep)
        elif name == "$sort":
            df = sort(df, spec) if "doc" in df.columns else df.orderBy(*[F.desc(k) if d < 0 else F.asc(k) for k, d in spec.items()])
        elif name == "$skip":
            df = df.offset(int(spec))
        elif name == "$limit":
            df = df.limit(int(spec))
        elif name == "$count":
            df = df.agg(F.count(F.lit(1)).cast("int").alias(spec))
        elif name == "$sortByCount":
            df = group(df, {"_id": spec, "count": {"$sum": 1}}).orderBy(F.desc("count"))
        elif name == "$group":
            df = group(df, spec)
        else:
            raise PipelineError(f"{name} is not available in document mode")
    return df


def sort(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    """Canonical order over mixed types."""
    return df.orderBy(*[sort_key(at(p)).desc() if d < 0 else sort_key(at(p)).asc() for p, d in spec.items()])


def group_count(df: DataFrame, path: str) -> DataFrame:
    """Values of a path with their counts; ``key`` is the canonical key."""
    return df.groupBy(sort_key(at(path)).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def project(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns from paths: name to ``path:type``, values of other types null."""
    return df.select(*[F.try_variant_get(F.col("doc"), _json_path(p.rpartition(":")[0]), p.rpartition(":")[2]).alias(n) for n, p in fields.items()])
