"""Pipeline stages: each turns a frame into a frame while the plan is built.

A frame is a DataFrame with the order its last ``$sort`` gave, because rows of a
DataFrame have none.  The whole pipeline is checked before any data is touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import paths
from tarn.functions.accum import Order, _ordered_list, _rank, accumulate
from tarn.functions.expr import Compiler, Scope, compile_expression, literal, slice_of, struct
from tarn.functions.match import compile_match, element_predicate
from tarn.functions.types import PipelineError, Typed, as_type, is_null, less, sort_column, widest
from tarn.operators.ranks import ranked
from tarn.operators.skew import join_null_safe
from tarn.sources import cut_lineage


class Catalog(Protocol):
    """Where stages find and write other collections."""

    def load(self, name: str) -> DataFrame: ...

    def write(self, name: str, df: DataFrame) -> None: ...

    def has(self, name: str) -> bool: ...


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()
    catalog: Catalog | None = None
    bracketing: bool = True

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def with_df(self, df: DataFrame, keeps_order: bool = True) -> Frame:
        kept = keeps_order and all(paths.exists(df.schema, p) for p, _ in self.order)
        return replace(self, df=df, order=self.order if kept else ())

    def order_columns(self) -> Order:
        at = [(paths.resolve(self.schema, p), d) for p, d in self.order]
        return [(v.col, d, v.type) for v, d in at]

    def lookup_catalog(self, stage: str) -> Catalog:
        if self.catalog is None:
            raise PipelineError(f"{stage} needs a catalog of collections")
        return self.catalog


Stage = Callable[[Frame, Any], Frame]
STAGES: dict[str, Stage] = {}
#: stages the engine names but does not offer
ABSENT = ("$densify", "$fill", "$geoNear", "$graphLookup", "$search")
#: stages that work on each row alone
ROW_WISE = ("$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$redact")


def stage(*names: str) -> Callable[[Stage], Stage]:
    def register(f: Stage) -> Stage:
        for n in names:
            STAGES[n] = f
        return f

    return register


def validate(pipeline: Sequence[dict[str, Any]]) -> None:
    """Raise for anything that is not a list of known single-key stages."""
    if not isinstance(pipeline, (list, tuple)):
        raise PipelineError("a pipeline is an array of stages")
    for i, s in enumerate(pipeline):
        if not isinstance(s, dict) or len(s) != 1:
            raise PipelineError(f"stage {i}: a stage is a document with one field")
        name, spec = next(iter(s.items()))
        if name in ABSENT:
            raise PipelineError(f"stage {i}: {name} is not implemented")
        if name not in STAGES:
            raise PipelineError(f"stage {i}: unknown stage {name}")
        if name == "$facet":
            for sub in spec.values():
                validate(sub)
        if name in ("$lookup", "$unionWith") and isinstance(spec, dict) and "pipeline" in spec:
            validate(spec["pipeline"])


def run(frame: Frame, pipeline: Sequence[dict[str, Any]]) -> Frame:
    """Compile a pipeline over a frame."""
    from tarn.operators.peephole import rewrite

    validate(pipeline)
    for i, s in enumerate(rewrite(pipeline)):
        name, spec = next(iter(s.items()))
        try:
            frame = STAGES[name](frame, spec)
        except PipelineError as e:
            raise PipelineError(f"stage {i} {name}: {e}") from None
    return frame


# ---- rows ----------------------------------------------------------------------------------------------------------


@stage("$match")
def _match(f: Frame, spec: Any) -> Frame:
    return f.with_df(f.df.where(compile_match(spec, f.schema, f.bracketing)))


def _is_flag(v: Any) -> bool:
    return isinstance(v, (bool, int, float))


def _flatten(spec: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested projection documents as dotted paths; expressions stay whole."""
    out: dict[str, Any] = {}
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(x.startswith("$") for x in v):
            out |= _flatten(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def _pick(at: Typed, tree: dict[str, Any]) -> Typed | None:
    """The parts of a nested value named by ``tree`` (a leaf is True or a computed value)."""
    if isinstance(at.type, T.ArrayType):
        inner = _pick(Typed(F.lit(None), at.type.elementType), tree)
        if inner is None:
            return None
        return Typed(F.transform(at.col, lambda x: _pick(Typed(x, at.type.elementType), tree).col), T.ArrayType(inner.type, True))
    out: dict[str, Typed] = {}
    if isinstance(at.type, T.StructType):
        for field in at.type.fields:
            if field.name not in tree:
                continue
            value, leaf = Typed(at.col.getField(field.name), field.dataType), tree[field.name]
            got = value if leaf is True else leaf if isinstance(leaf, Typed) else _pick(value, leaf)
            if got is not None:
                out[field.name] = got
    for name, leaf in tree.items():
        if name not in out and isinstance(leaf, Typed):
            out[name] = leaf
        elif name not in out and isinstance(leaf, dict):
            got = _pick(Typed(F.lit(None), T.StructType([])), leaf)
            if got is not None:
                out[name] = got
    if not out:
        return None
    s = struct(out)
    return Typed(F.when(at.col.isNotNull(), s.col), s.type) if isinstance(at.type, T.StructType) and at.type.fields else s


def project(df: DataFrame, spec: dict[str, Any], computed: Callable[[str, Any], Typed | None]) -> DataFrame:
    """Inclusion, exclusion and computed fields; ``_id`` stays unless it is excluded."""
    flat = _flatten(spec)
    if not flat:
        raise PipelineError("a projection names at least one field")
    inclusion = any(not _is_flag(v) or (v and k != "_id") for k, v in flat.items()) or (len(flat) == 1 and bool(flat.get("_id")))
    if not inclusion:
        for path in flat:
            df = _without(df, path)
        return df
    schema = df.schema
    tree: dict[str, Any] = {}
    for path, v in flat.items():
        if _is_flag(v):
            if not v:
                continue
            leaf: Any = True
        else:
            leaf = computed(path, v)
            if leaf is None:
                continue
        head, *rest = [path] if path in schema.names else path.split(".")
        at, names = tree, [head, *rest]
        for n in names[:-1]:
            nxt = at.setdefault(n, {})
            if not isinstance(nxt, dict):
                raise PipelineError(f"path {path} collides with another field")
            at = nxt
        at[names[-1]] = leaf
    if "_id" in schema.names and "_id" not in flat:
        tree = {"_id": True, **tree}
    out: list[Column] = []
    for name in schema.names:
        if name in tree:
            value, leaf = Typed(F.col(paths.quoted(name)), schema[name].dataType), tree[name]
            got = value if leaf is True else leaf if isinstance(leaf, Typed) else _pick(value, leaf)
            if got is not None:
                out.append(got.col.alias(name))
    for name, leaf in tree.items():
        if name not in schema.names and leaf is not True:
            got = leaf if isinstance(leaf, Typed) else _pick(Typed(F.lit(None), T.StructType([])), leaf)
            if got is not None:
                out.append(got.col.alias(name))
    return df.select(*out)


def _without(df: DataFrame, path: str) -> DataFrame:
    if path in df.columns:
        return df.drop(df[paths.quoted(path)]) if "." in path else df.drop(path)
    if not paths.exists(df.schema, path):
        return df
    head, col, _ = paths.with_path(df.schema, path, None)
    return df.drop(head) if col is None else df.withColumn(head, col)


@stage("$project")
def _project(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict):
        raise PipelineError("requires a document")
    schema = f.schema

    def computed(_: str, v: Any) -> Typed | None:
        return None if v == "$$REMOVE" else compile_expression(v, schema)

    recomputed = {k.split(".")[0] for k, v in _flatten(spec).items() if not _is_flag(v)}
    out = f.with_df(project(f.df, spec, computed))
    return out if not any(p.split(".")[0] in recomputed for p, _ in f.order) else replace(out, order=())


def set_fields(df: DataFrame, values: dict[str, Typed | None]) -> DataFrame:
    """Set or remove several paths at once; all values see the row as it was."""
    schema = df.schema
    heads: dict[str, Typed | None] = {}
    for path, v in values.items():
        head = path if path in schema.names or "." not in path else path.split(".")[0]
        if head == path:
            heads[head] = v
            continue
        current = heads.get(head) if head in heads else paths.root(schema, head)
        col, t = paths._rebuild(current, path.split(".")[1:], v)
        heads[head] = None if col is None else Typed(col, t)
    gone = [h for h, v in heads.items() if v is None]
    kept = {h: v.col for h, v in heads.items() if v is not None}
    out = df.withColumns({paths.quoted(h) if "." in h else h: c for h, c in kept.items()}) if kept else df
    return out.drop(*gone) if gone else out


@stage("$addFields", "$set")
def _add_fields(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict) or not spec:
        raise PipelineError("requires a document of fields")
    schema = f.schema
    values = {k: None if v == "$$REMOVE" else compile_expression(v, schema) for k, v in spec.items()}
    out = f.with_df(set_fields(f.df, values))
    touched = {k.split(".")[0] for k in spec}
    return replace(out, order=()) if any(p.split(".")[0] in touched for p, _ in f.order) else out


@stage("$unset")
def _unset(f: Frame, spec: Any) -> Frame:
    df = f.df
    for path in [spec] if isinstance(spec, str) else spec:
        df = _without(df, path)
    return f.with_df(df)


@stage("$replaceRoot", "$replaceWith")
def _replace_root(f: Frame, spec: Any) -> Frame:
    expr = spec["newRoot"] if isinstance(spec, dict) and set(spec) == {"newRoot"} else spec
    root = compile_expression(expr, f.schema)
    if not isinstance(root.type, T.StructType):
        raise PipelineError("the new root must be a document")
    return f.with_df(f.df.select(root.col.alias("_root")).select("_root.*"), keeps_order=False)


@stage("$redact")
def _redact(f: Frame, spec: Any) -> Frame:
    def rebuilt(at: Column, t: T.StructType) -> Column:
        parts = []
        for field in t.fields:
            v = at.getField(field.name)
            parts.append((level(v, field.dataType) if isinstance(field.dataType, T.StructType) else v).alias(field.name))
        return F.struct(*parts)

    def level(at: Column, t: T.StructType) -> Column:
        verdict = Compiler(Scope(t, base=at))(spec).col
        deeper = any(isinstance(x.dataType, T.StructType) for x in t.fields)
        inner = F.when(verdict == "keep", at).otherwise(rebuilt(at, t)) if deeper else at
        return F.when(at.isNull() | (verdict == "prune"), F.lit(None)).otherwise(inner)

    verdict = compile_expression(spec, f.schema).col
    df = f.df.withColumn("_verdict", verdict).where(F.col("_verdict") != "prune")
    cols = []
    for field in f.schema.fields:
        c = F.col(paths.quoted(field.name))
        if isinstance(field.dataType, T.StructType):
            c = F.when(F.col("_verdict") == "keep", c).otherwise(level(c, field.dataType))
        cols.append(c.alias(field.name))
    return f.with_df(df.select(*cols))


# ---- order and number ----------------------------------------------------------------------------------------------


@stage("$sort")
def _sort(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict) or not spec:
        raise PipelineError("requires a document of sort keys")
    keys = tuple((p, isinstance(d, (int, float)) and d < 0) for p, d in spec.items() if paths.exists(f.schema, p))
    if not keys:
        return f
    by = [sort_column(paths.resolve(f.schema, p).col, d) for p, d in keys]
    return replace(f, df=f.df.orderBy(*by), order=keys)


def _count_of(spec: Any, name: str) -> int:
    if isinstance(spec, bool) or not isinstance(spec, (int, float)) or spec < 0 or spec != int(spec):
        raise PipelineError(f"{name} requires a number of rows")
    return int(spec)


@stage("$limit")
def _limit(f: Frame, spec: Any) -> Frame:
    return f.with_df(f.df.limit(_count_of(spec, "$limit")))


@stage("$skip")
def _skip(f: Frame, spec: Any) -> Frame:
    return f.with_df(f.df.offset(_count_of(spec, "$skip")))


@stage("$sample")
def _sample(f: Frame, spec: Any) -> Frame:
    seed = int(spec.get("seed", 0))
    return replace(f, df=f.df.orderBy(F.rand(seed)).limit(_count_of(spec["size"], "$sample")), order=())


@stage("$count")
def _count(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, str) or not spec or spec.startswith("$"):
        raise PipelineError("requires a field name")
    return replace(f, df=f.df.agg(F.count(F.lit(1)).cast("int").alias(spec)), order=())


# ---- groups --------------------------------------------------------------------------------------------------------


def _group_key(expr: Any, schema: T.StructType) -> Column:
    key = compile_expression(expr, schema)
    return (key.col.cast("string") if is_null(key.type) else key.col).alias("_id")


@stage("$group")
def _group(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict):
        raise PipelineError("requires a document")
    order = f.order_columns()
    aggs = [accumulate(a, f.schema, order, name).col.alias(name) for name, a in spec.items() if name != "_id"]
    key = _group_key(spec.get("_id"), f.schema)
    df = f.df.groupBy(key).agg(*aggs) if aggs else f.df.select(key).distinct()
    return replace(f, df=df, order=())


@stage("$sortByCount")
def _sort_by_count(f: Frame, spec: Any) -> Frame:
    df = f.df.groupBy(_group_key(spec, f.schema)).agg(F.count(F.lit(1)).cast("int").alias("count"))
    return replace(f, df=df.orderBy(F.desc("count"), F.asc_nulls_first("_id")), order=(("count", True), ("_id", False)))


@stage("$bucket")
def _bucket(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict) or "groupBy" not in spec or len(spec.get("boundaries", ())) < 2:
        raise PipelineError("requires groupBy and at least two boundaries")
    key = compile_expression(spec["groupBy"], f.schema)
    bounds = [literal(b) for b in spec["boundaries"]]
    kind = widest([b.type for b in bounds])
    if any(not bool(a.value < b.value) for a, b in zip(bounds, bounds[1:])):
        raise PipelineError("boundaries must ascend")
    place = None
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        inside = F.coalesce(less(lo, key, True) & less(key, hi), F.lit(False))
        place = F.when(inside, F.lit(i)) if place is None else place.when(inside, F.lit(i))
    n = len(bounds) - 1
    default = literal(spec["default"]) if "default" in spec else None
    if default is not None:
        kind = widest([kind, default.type])
        place = place.otherwise(F.lit(n))
    else:
        place = place.otherwise(F.raise_error(F.lit("$bucket: a value lies outside the boundaries and there is no default")).cast("int"))
    output = dict(spec.get("output") or {})
    output.pop("count", None)
    order = f.order_columns()
    aggs = [accumulate(a, f.schema, order, name).col.alias(name) for name, a in output.items()]
    counted = f.df.withColumn("_place", place).groupBy("_place").agg(F.count(F.lit(1)).cast("int").alias("count"), *aggs)
    spark = f.df.sparkSession
    rows = bounds[:-1] + ([default] if default is not None else [])
    frame = None
    for i, b in enumerate(rows):
        one = spark.range(1).select(F.lit(i).alias("_at"), as_type(b, kind).alias("_id"))
        frame = one if frame is None else frame.unionByName(one)
    # every bucket is reported, empty ones too; the default bucket only when something fell into it
    joined = frame.join(counted, F.col("_at") == F.col("_place"), "left")
    if default is not None:
        joined = joined.where((F.col("_at") < n) | F.col("count").isNotNull())
    zero = {name: F.lit(0) for name, a in output.items() if next(iter(a)) in ("$sum", "$count")}
    out = joined.orderBy("_at").select(
        "_id",
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        *[(F.coalesce(F.col(name), zero[name].cast(counted.schema[name].dataType)) if name in zero else F.col(name)).alias(name) for name in output],
    )
    return replace(f, df=out, order=(("_id", False),))


@stage("$bucketAuto")
def _bucket_auto(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict) or "groupBy" not in spec or "buckets" not in spec:
        raise PipelineError("requires groupBy and buckets")
    k = _count_of(spec["buckets"], "buckets")
    if k < 1:
        raise PipelineError("buckets must be positive")
    key = compile_expression(spec["groupBy"], f.schema)
    output = spec.get("output") or {"count": {"$sum": 1}}
    # only fields that the accumulators or the order may name are written
    said = json.dumps(output, default=str, ensure_ascii=False) + " ".join(p for p, _ in f.order)
    kept = [F.col(paths.quoted(c)) for c in f.df.columns if c in said or "$$" in said]
    placed = ranked(f.df.select(*kept, key.col.alias("_key")), [], [F.col("_key").asc_nulls_first()], "_place", "_all")
    at = F.col("_place")
    q, r = F.expr(f"_all div {k}"), F.expr(f"_all % {k}")
    big = r * (q + 1)
    bucket = F.when(at < big, F.floor(at / F.greatest(q + 1, F.lit(1)))).otherwise(r + F.floor((at - big) / F.greatest(q, F.lit(1))))
    order = f.order_columns()
    aggs = [accumulate(a, f.schema, order, name).col.alias(name) for name, a in output.items()]
    df = (
        placed.withColumn("_bucket", bucket.cast("long"))
        .groupBy("_bucket")
        .agg(F.min("_key").alias("_min"), F.max("_key").alias("_max"), *aggs)
        .orderBy("_bucket")
        .select(F.struct(F.col("_min").alias("min"), F.col("_max").alias("max")).alias("_id"), *output)
    )
    return replace(f, df=df, order=(("_id", False),))


# ---- arrays --------------------------------------------------------------------------------------------------------


@stage("$unwind")
def _unwind(f: Frame, spec: Any) -> Frame:
    spec = {"path": spec} if isinstance(spec, str) else dict(spec)
    path = spec.get("path", "")
    if not path.startswith("$"):
        raise PipelineError("the path must start with $")
    path = path[1:]
    keep, index = bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    v = paths.resolve(f.schema, path)
    if is_null(v.type):
        return f if keep else f.with_df(f.df.where(F.lit(False)))
    if not isinstance(v.type, T.ArrayType):
        df = f.df if keep else f.df.where(v.col.isNotNull())
        return f.with_df(df.withColumn(index, F.lit(None).cast("long")) if index else df)
    explode = F.posexplode_outer if keep else F.posexplode
    df = f.df.select("*", explode(v.col).alias("_pos", "_val"))
    df = set_fields(df, {path: Typed(F.col("_val"), v.type.elementType)})
    if index:
        df = df.withColumn(index, F.col("_pos").cast("long"))
    out = f.with_df(df.drop("_pos", "_val"))
    return replace(out, order=()) if any(p.split(".")[0] == path.split(".")[0] for p, _ in f.order) else out


# ---- several collections -------------------------------------------------------------------------------------------


def _run_keyed(f: Frame, df: DataFrame, pipeline: Sequence[dict], keys: Sequence[str]) -> Frame:
    """A sub-pipeline over each set of rows with equal ``keys`` (helper columns, carried along), all sets at once.

    Sorting is kept as helper columns ``_so*`` until something needs the order; limits
    are row numbers within the key, so that only the first rows of each map task
    are shuffled; groups and counts take the keys into their own.
    """
    frame, helpers = replace(f, df=df, order=()), list(keys)

    def numbered() -> DataFrame:
        order = [sort_column(c, d) for c, d, _ in frame.order_columns()] or [F.lit(1)]
        return frame.df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    for s in pipeline:
        name, spec = next(iter(s.items()))
        if name in ("$replaceRoot", "$replaceWith"):
            expr = spec["newRoot"] if isinstance(spec, dict) and set(spec) == {"newRoot"} else spec
            root = compile_expression(expr, frame.schema)
            if not isinstance(root.type, T.StructType):
                raise PipelineError("the new root must be a document")
            frame = replace(frame, df=frame.df.select(*helpers, root.col.alias("_root")).select(*helpers, "_root.*"))
        elif name == "$project":
            if any(not _is_flag(v) or v for v in _flatten(spec).values()):
                spec = {**spec, **dict.fromkeys(helpers, 1)}
            frame = STAGES[name](frame, spec)
        elif name in ROW_WISE or name in ("$unwind", "$lookup", "_lookupUnwind", "_lookupAnti", "_lookupSemi"):
            frame = replace(STAGES[name](frame, spec), order=frame.order)
        elif name == "$sort":
            by = [(paths.resolve(frame.schema, p).col, isinstance(d, (int, float)) and d < 0) for p, d in spec.items() if paths.exists(frame.schema, p)]
            names = [f"_so{i}" for i in range(len(by))]
            helpers = [*keys, *names]
            frame = replace(frame, df=frame.df.drop(*[c for c in frame.df.columns if c.startswith("_so")]).withColumns({n: c for n, (c, _) in zip(names, by)}), order=tuple((n, d) for n, (_, d) in zip(names, by)))
        elif name in ("$limit", "$skip"):
            n = _count_of(spec, name)
            frame = replace(frame, df=numbered().where(F.col("_rn") <= n if name == "$limit" else F.col("_rn") > n).drop("_rn"))
        elif name == "$group":
            order = frame.order_columns()
            aggs = [accumulate(a, frame.schema, order, n).col.alias(n) for n, a in spec.items() if n != "_id"]
            grouped = frame.df.groupBy(*keys, _group_key(spec.get("_id"), frame.schema))
            frame, helpers = replace(frame, df=grouped.agg(*aggs) if aggs else grouped.count().drop("count"), order=()), list(keys)
        elif name == "$sortByCount":
            counted = frame.df.groupBy(*keys, _group_key(spec, frame.schema)).agg(F.count(F.lit(1)).cast("int").alias("count"))
            helpers = [*keys, "_so0", "_so1"]
            frame = replace(frame, df=counted.withColumns({"_so0": F.col("count"), "_so1": F.col("_id")}), order=(("_so0", True), ("_so1", False)))
        elif name == "$count":
            if not isinstance(spec, str) or not spec or spec.startswith("$"):
                raise PipelineError("requires a field name")
            frame, helpers = replace(frame, df=frame.df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias(spec)), order=()), list(keys)
        else:
            raise PipelineError(f"{name} is not supported in a correlated $lookup")
    return frame


@dataclass(frozen=True)
class Foreign:
    """The foreign side of a ``$lookup``: rows with key columns ``names``, and the local values they must equal."""

    frame: Frame
    local: list[Typed]
    names: list[str]
    pipeline: list[dict]  #: what has still to run on the rows that a local row meets
    any_of: bool  #: the first key meets any element of an array, on either side

    @property
    def many(self) -> bool:
        """Whether a local row has several keys."""
        return self.any_of and isinstance(self.local[0].type, T.ArrayType)

    def nested(self) -> Column:
        return _nested(self.frame.df, [*self.names, "_fid", "_row"])


def foreign_side(f: Frame, spec: dict) -> Foreign:
    """Load the other collection, find the keys and run the sub-pipeline as far as it can run per key."""
    catalog = f.lookup_catalog("$lookup")
    foreign = catalog.load(spec["from"])
    pipeline = list(spec.get("pipeline") or [])
    local: list[Typed] = []
    keys: list[Typed] = []
    if "localField" in spec:
        local.append(paths.resolve(f.schema, spec["localField"]))
        keys.append(paths.resolve(foreign.schema, spec["foreignField"]))
    if spec.get("let"):
        variables = {k: compile_expression(v, f.schema) for k, v in spec["let"].items()}
        first = pipeline.pop(0) if pipeline else {}
        rest = []
        for eq in _conjuncts(first):
            pair = _correlation(eq, variables, foreign.schema)
            if pair is None:
                rest.append(eq)
            else:
                local.append(pair[0])
                keys.append(pair[1])
        if len(keys) == len(local) == 0 or any("$$" in str(e) for e in rest):
            raise PipelineError("let is supported for equality of a field and a variable in the first $match")
        if rest:
            pipeline.insert(0, {"$match": {"$expr": {"$and": rest}}})
    names = [f"_fk{i}" for i in range(len(keys))]
    foreign = foreign.withColumns({n: (k.col if not is_null(k.type) else F.lit(None).cast("string")) for n, k in zip(names, keys)})
    any_of = "localField" in spec
    lists = any_of and isinstance(keys[0].type, T.ArrayType)
    many = any_of and isinstance(local[0].type, T.ArrayType)
    if lists and many:
        # a row that is met by several elements counts once: it needs an id, which a written table keeps the same
        foreign = cut_lineage(foreign.withColumn("_fid", F.monotonically_increasing_id()))
    if lists:
        foreign = foreign.withColumn(names[0], F.explode_outer(F.array_distinct(F.col(names[0]))))
    frame = replace(f, df=foreign, order=())
    if pipeline and not keys:
        return Foreign(run(frame, pipeline), local, names, [], any_of)
    if many and any(next(iter(s)) not in ROW_WISE for s in pipeline):
        return Foreign(frame, local, names, pipeline, any_of)  # the rows of several keys are one set
    return Foreign(_run_keyed(f, foreign, pipeline, [*names, *(["_fid"] if lists and many else [])]), local, names, [], any_of)


def _local_keys(f: Frame, side: Foreign, df: DataFrame) -> DataFrame:
    types = side.frame.schema
    return df.withColumns({n: (v.col if not is_null(v.type) else F.lit(None).cast(types[n].dataType)) for n, v in zip(side.names, side.local)})


def _each_key(f: Frame, side: Foreign) -> tuple[DataFrame, DataFrame]:
    """The local rows with ``_row``, and one row per ``_row`` and key; null and empty arrays have none."""
    left = cut_lineage(_local_keys(f, side, f.df).withColumn("_row", F.monotonically_increasing_id()))
    each = left.select("_row", F.explode(F.array_distinct(side.names[0])).alias(side.names[0]), *side.names[1:])
    return left.drop(*side.names), each


def _conjuncts(match: dict) -> list[Any]:
    spec = match.get("$match", {}) if match else {}
    if set(spec) != {"$expr"}:
        return [spec] if spec else []
    e = spec["$expr"]
    return list(e["$and"]) if isinstance(e, dict) and set(e) == {"$and"} else [e]


def _correlation(e: Any, variables: dict[str, Typed], schema: T.StructType) -> tuple[Typed, Typed] | None:
    if not (isinstance(e, dict) and list(e) == ["$eq"] and len(e["$eq"]) == 2):
        return None
    a, b = e["$eq"]
    if isinstance(a, str) and a.startswith("$$"):
        a, b = b, a
    if not (isinstance(b, str) and b.startswith("$$") and b[2:] in variables and isinstance(a, str) and a.startswith("$") and not a.startswith("$$")):
        return None
    return variables[b[2:]], paths.resolve(schema, a[1:])


def _nested(foreign: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[F.col(paths.quoted(c)) for c in foreign.columns if c not in names and not c.startswith("_so")])


@stage("$lookup")
def _lookup(f: Frame, spec: Any) -> Frame:
    if not isinstance(spec, dict) or "from" not in spec or "as" not in spec:
        raise PipelineError("requires from and as")
    side = foreign_side(f, spec)
    foreign, names = side.frame.df, side.names
    if not names:
        # uncorrelated: the same array for every row, computed once, as large as its meaning demands
        one = foreign.agg(_ordered_list(side.nested(), side.frame.order_columns()).alias("_found"))
        joined = f.df.crossJoin(one)
        return f.with_df(set_fields(joined, {spec["as"]: Typed(F.col("_found"), joined.schema["_found"].dataType)}).drop("_found"))
    if side.many:
        left, each = _each_key(f, side)
        met = join_null_safe(each, foreign, names).drop(*names)
        if "_fid" in met.columns:
            met = met.dropDuplicates(["_row", "_fid"]).drop("_fid")
        frame = _run_keyed(f, met, side.pipeline, ["_row"]) if side.pipeline else replace(side.frame, df=met)
        rows = frame.df.groupBy("_row").agg(_ordered_list(_nested(frame.df, ["_row"]), frame.order_columns()).alias("_found"))
        kind = rows.schema["_found"].dataType
        joined = left.join(rows, "_row", "left").drop("_row")
    else:
        grouped = foreign.groupBy(*names).agg(_ordered_list(side.nested(), side.frame.order_columns()).alias("_found"))
        kind = grouped.schema["_found"].dataType
        joined = join_null_safe(_local_keys(f, side, f.df), grouped, names, "left").drop(*names)
    found = F.coalesce(F.col("_found"), F.array().cast(kind))
    return f.with_df(set_fields(joined, {spec["as"]: Typed(found, kind)}).drop("_found"))


@stage("_lookupUnwind")
def _lookup_unwind(f: Frame, spec: Any) -> Frame:
    """``$lookup`` followed by ``$unwind`` of its result: a plain join, no arrays."""
    look, unwind = spec
    side = foreign_side(f, look)
    names = side.names
    if not names or unwind.get("includeArrayIndex") or side.many:
        return _unwind(_lookup(f, look), unwind)
    right = side.frame.df.select(*names, side.nested().alias("_found"))
    how = "left" if unwind.get("preserveNullAndEmptyArrays") else "inner"
    joined = join_null_safe(_local_keys(f, side, f.df), right, names, how).drop(*names)
    return f.with_df(set_fields(joined, {look["as"]: Typed(F.col("_found"), joined.schema["_found"].dataType)}).drop("_found"))


@stage("_lookupAnti", "_lookupSemi")
def _lookup_anti(f: Frame, spec: Any) -> Frame:
    look, how = spec
    side = foreign_side(f, look)
    names = side.names
    if side.pipeline:  # what a row's several keys meet has to pass the sub-pipeline as one set
        full = _lookup(f, look)
        empty = F.size(paths.resolve(full.schema, look["as"]).col) == 0
        return f.with_df(full.df.where(empty) if how == "left_anti" else full.df.where(~empty).drop(look["as"]))
    if side.many:
        left, each = _each_key(f, side)
        met = join_null_safe(each, side.frame.df.select(*names), names, "left_semi").select("_row").distinct()
        out = left.join(met, "_row", how).drop("_row")
    else:
        out = join_null_safe(_local_keys(f, side, f.df), side.frame.df.select(*names), names, how).drop(*names)
    if how == "left_anti":
        kind = T.ArrayType(side.frame.df.select(side.nested().alias("_x")).schema["_x"].dataType)
        out = set_fields(out, {look["as"]: Typed(F.array().cast(kind), kind)})
    return f.with_df(out)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns by name, missing ones null, unlike types widened."""
    casts_a, casts_b = {}, {}
    for name in set(a.columns) & set(b.columns):
        x, y = a.schema[name].dataType, b.schema[name].dataType
        if x != y:
            t = widest([x, y])
            casts_a[name], casts_b[name] = F.col(paths.quoted(name)).cast(t), F.col(paths.quoted(name)).cast(t)
    a = a.withColumns(casts_a) if casts_a else a
    b = b.withColumns(casts_b) if casts_b else b
    return a.unionByName(b, allowMissingColumns=True)


@stage("$unionWith")
def _union_with(f: Frame, spec: Any) -> Frame:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = replace(f, df=f.lookup_catalog("$unionWith").load(spec["coll"]), order=())
    if spec.get("pipeline"):
        other = run(other, spec["pipeline"])
    return replace(f, df=union_all(f.df, other.df), order=())


@stage("$facet")
def _facet(f: Frame, spec: Any) -> Frame:
    """Every branch over the same input, in one row; meant for branches that end in few rows."""
    if not isinstance(spec, dict) or not spec:
        raise PipelineError("requires named pipelines")
    out: DataFrame | None = None
    plan = f.df._jdf.queryExecution().optimizedPlan().toString()
    if len(spec) > 1 and re.search(r"^[ :+-]*(Aggregate|Join|Sort|Window|Distinct|Generate|Deduplicate|MapIn)", plan, re.M):
        # what comes before is more than a scan with filters: it is done once for all branches
        f = replace(f, df=cut_lineage(f.df))
    for name, sub in spec.items():
        branch = run(replace(f), sub)
        rows = F.struct(*[F.col(paths.quoted(c)) for c in branch.df.columns])
        one = branch.df.agg(_ordered_list(rows, branch.order_columns()).alias(name))
        out = one if out is None else out.crossJoin(one)
    return replace(f, df=out, order=())


@stage("$out")
def _out(f: Frame, spec: Any) -> Frame:
    name = spec if isinstance(spec, str) else spec["coll"]
    f.lookup_catalog("$out").write(name, f.df)
    return replace(f, df=f.catalog.load(name))


def merge(target: DataFrame | None, source: DataFrame, on: Sequence[str], matched: str = "merge", unmatched: str = "insert", order: Order = ()) -> DataFrame:
    """The target after merging the source on the key columns."""
    if matched not in ("merge", "replace", "keepExisting", "fail"):
        raise PipelineError(f"$merge: whenMatched {matched} is not supported")
    if unmatched not in ("insert", "discard", "fail"):
        raise PipelineError(f"$merge: whenNotMatched {unmatched} is not supported")
    if all(k in source.columns for k in on):
        source = fold_repeats(source, on, matched, order)
    if target is None:
        if unmatched == "fail":
            raise PipelineError("$merge: no target document matches")
        return source if unmatched == "insert" else source.where(F.lit(False))
    for k in on:
        if k not in source.columns or k not in target.columns:
            raise PipelineError(f"$merge: key {k} is missing")
    names = list(dict.fromkeys([*target.columns, *source.columns]))
    s = source.select(F.lit(True).alias("_in_s"), *[F.col(paths.quoted(c)).alias(f"_s_{c}") for c in source.columns])
    t = target.select(F.lit(True).alias("_in_t"), *[F.col(paths.quoted(c)).alias(f"_t_{c}") for c in target.columns])
    same = F.lit(True)
    for k in on:
        same = same & F.col(f"_t_{k}").eqNullSafe(F.col(f"_s_{k}"))
    both = t.join(s, same, "full_outer")
    if matched == "fail":
        both = both.where(F.when(F.col("_in_s") & F.col("_in_t"), F.raise_error(F.lit("$merge: a target document matches")).cast("boolean")).otherwise(True))
    if unmatched == "fail":
        both = both.where(F.when(F.col("_in_t").isNull(), F.raise_error(F.lit("$merge: no target document matches")).cast("boolean")).otherwise(True))
    elif unmatched == "discard":
        both = both.where(F.col("_in_t").isNotNull())
    from_source = F.col("_in_s").isNotNull() & (F.col("_in_t").isNull() | F.lit(matched != "keepExisting"))
    cols = []
    for c in names:
        in_s, in_t = c in source.columns, c in target.columns
        t_col = F.col(f"_t_{c}") if in_t else F.lit(None)
        if in_s:
            kind = widest([source.schema[c].dataType] + ([target.schema[c].dataType] if in_t else []))
            cols.append(F.when(from_source, F.col(f"_s_{c}").cast(kind)).otherwise(t_col.cast(kind)).alias(c))
        elif matched == "replace":
            cols.append(F.when(~from_source, t_col).alias(c))
        else:
            cols.append(t_col.alias(c))
    return both.select(*cols)


def fold_repeats(source: DataFrame, on: Sequence[str], matched: str, order: Order = ()) -> DataFrame:
    """One row per key, as if the source's rows were merged one after another in the pipeline's order.

    The last one stands, with ``keepExisting`` the first; with ``fail`` a second one
    raises.  Without an order (or one that a rank cannot express) the choice is by
    a hash of the row, the same in every run.
    """
    others = [F.col(paths.quoted(c)).alias(c) for c in source.columns if c not in on]
    if not others:
        return source.distinct()
    row = F.struct(*others)
    place = _rank(order) if order else None
    pick = F.min_by if matched == "keepExisting" else F.max_by
    one = source.groupBy(*[F.col(paths.quoted(c)).alias(c) for c in on]).agg(pick(row, F.xxhash64(F.to_json(row)) if place is None else place).alias("_one"), F.count(F.lit(1)).alias("_many"))
    if matched == "fail":
        one = one.where(F.when(F.col("_many") > 1, F.raise_error(F.lit("$merge: a target document matches")).cast("boolean")).otherwise(True))
    return one.select(*[F.col(paths.quoted(c)) for c in on], "_one.*").select(*[F.col(paths.quoted(c)) for c in source.columns])


@stage("$merge")
def _merge(f: Frame, spec: Any) -> Frame:
    spec = {"into": spec} if isinstance(spec, str) else spec
    into = spec["into"] if isinstance(spec["into"], str) else spec["into"]["coll"]
    on = spec.get("on", "_id")
    catalog = f.lookup_catalog("$merge")
    source = cut_lineage(f.df)
    target = catalog.load(into) if catalog.has(into) else None
    catalog.write(into, merge(target, source, [on] if isinstance(on, str) else list(on), spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert"), replace(f, df=source).order_columns()))
    return replace(f, df=source)


# ---- find projections ----------------------------------------------------------------------------------------------


def _asked_of(query: dict[str, Any], path: str, kind: T.DataType) -> dict[str, Any]:
    """What a filter demands of an element of the array at ``path``, as an ``$elemMatch`` condition."""
    out: dict[str, Any] = {}
    for k, v in query.items():
        if k == "$and":
            for q in v:
                out |= _asked_of(q, path, kind)
        elif k == path:
            if isinstance(v, dict) and "$elemMatch" in v:
                out |= v["$elemMatch"]
            elif isinstance(v, dict) and any(x.startswith("$") for x in v):
                out |= v
            else:
                out |= {"$eq": v}
        elif k.startswith(path + "."):
            out[k[len(path) + 1 :]] = v
    return out


def find_projection(df: DataFrame, spec: dict[str, Any], query: dict[str, Any] | None = None) -> DataFrame:
    """A ``find`` projection: inclusion, exclusion, ``$slice``, ``$elemMatch``, ``f.$`` and expressions.

    ``f.$`` keeps the first element that meets what ``query`` demands of the array;
    where it demands nothing that is the first.
    """
    flags = {k: bool(v) for k, v in spec.items() if _is_flag(v) and k != "_id"}
    if len(set(flags.values())) > 1:
        raise PipelineError("a projection cannot mix inclusion and exclusion")
    schema = df.schema
    sliced = {k: v["$slice"] for k, v in spec.items() if isinstance(v, dict) and "$slice" in v}
    cuts: dict[str, Typed | None] = {}
    for k, n in sliced.items():
        a = paths.resolve(schema, k)
        if isinstance(a.type, T.ArrayType):
            ns = [F.lit(int(x)) for x in (n if isinstance(n, (list, tuple)) else [n])]
            cuts[k] = Typed(slice_of(a.col, ns[-1], ns[0] if len(ns) == 2 else None), a.type)
    df = set_fields(df, cuts) if cuts else df
    rest = {k: v for k, v in spec.items() if k not in sliced}
    if not rest:
        return df
    including = any(flags.values()) or any(not _is_flag(v) for v in rest.values())
    if including:
        rest |= dict.fromkeys(sliced, 1)

    def computed(path: str, v: Any) -> Typed | None:
        if isinstance(v, dict) and "$elemMatch" in v:
            a = paths.resolve(schema, path)
            if not isinstance(a.type, T.ArrayType):
                return None
            from tarn.functions.match import Matcher

            hit = F.slice(F.filter(a.col, element_predicate(Matcher(schema), a.type.elementType, v["$elemMatch"])), 1, 1)
            return Typed(F.when(F.size(hit) > 0, hit), a.type)
        return compile_expression(v, df.schema)

    positional = {k[:-2]: v for k, v in rest.items() if k.endswith(".$")}
    for k in positional:
        rest.pop(f"{k}.$")
        a = paths.resolve(schema, k)
        if isinstance(a.type, T.ArrayType):
            from tarn.functions.match import Matcher

            asked = _asked_of(query or {}, k, a.type.elementType)
            hit = F.filter(a.col, element_predicate(Matcher(schema), a.type.elementType, asked)) if asked else a.col
            df = set_fields(df, {k: Typed(F.slice(hit, 1, 1), a.type)})
        rest[k] = 1
    return project(df, rest, computed)


__all__ = ["Catalog", "Frame", "STAGES", "find_projection", "merge", "project", "run", "union_all", "validate"]
