"""Per-entity feature tables from typed events.

Event types become small integer indices.  Every entity carries sparse vectors
(index, count, total, latest time) whose merge is addition and maximum per
index, so partial tables of days or files combine.  Only the last step expands
the vectors into columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.ranks import ranked
from tarn.operators.skew import FEW, join_few
from tarn.sources import cut_lineage

VECTOR = ("idx", "cnt", "tot", "last_us")


def type_table(df: DataFrame, kind: str) -> DataFrame:
    """The event types in sorted order with their index: ``_t``, ``_i``; any number of them."""
    found = df.select(F.col(f"`{kind}`").cast("string").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    return ranked(found, [], [F.col("_t").asc()], "_i").select("_t", F.col("_i").cast("int").alias("_i"))


def type_dictionary(df: DataFrame, kind: str, max_types: int = 4096) -> list[str]:
    """The event types in sorted order as a list, for one column per type.

    The list is collected only up to ``max_types`` + 1 values; more raise, since
    columns per type would then be the wrong shape for the data; the sparse
    vectors have no such bound.
    """
    c = F.col(f"`{kind}`").cast("string")
    found = [r[0] for r in df.select(c.alias("t")).where(F.col("t").isNotNull()).distinct().limit(max_types + 1).collect()]
    if len(found) > max_types:
        raise ValueError(f"more than {max_types} event types in {kind}")
    return sorted(found)


def sparse_features(
    df: DataFrame,
    entity: str,
    kind: str,
    ts: str,
    flag: str,
    event_id: str | None = None,
    types: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """One row per entity: ``entity`` and its sparse vectors.

    Columns: the entity, ``idx`` (sorted type indices), ``cnt``, ``tot`` (how often
    ``flag`` was true) and ``last_us`` (latest ``ts``, microseconds since 1970
    UTC, null when all are null), aligned by position.  ``types`` is a list of
    types or a ``type_table``, by default that of ``df``.

    With ``event_id``, exact repetitions of an event count once.  Events without
    entity or type belong to no row; a null flag is not true; an empty table
    gives no rows.  Counting is done per (entity, type) with map-side combine, so
    a hot entity is never gathered: at most one cell per type reaches its row.
    """
    if types is None:
        types = type_table(df, kind)
    dictionary = types if isinstance(types, DataFrame) else df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "_t string, _i int")
    cols = [
        F.col(f"`{entity}`").alias("_e"),
        F.col(f"`{kind}`").cast("string").alias("_t"),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("_us"),
        F.coalesce(F.col(f"`{flag}`").cast("boolean"), F.lit(False)).alias("_ok"),
    ]
    if event_id is not None:
        cols.append(F.col(f"`{event_id}`").alias("_id"))
    rows = df.select(*cols).where(F.col("_e").isNotNull() & F.col("_t").isNotNull())
    few = dictionary.limit(FEW + 1).count() <= FEW
    if few:  # the index is narrower than the type, so it is put in before anything is shuffled
        rows = rows.join(F.broadcast(dictionary), "_t").drop("_t")
    if event_id is not None:
        rows = rows.distinct()
    key = "_i" if few else "_t"
    cells = rows.groupBy("_e", key).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.sum(F.col("_ok").cast("long")).alias("_tot"),
        F.max("_us").alias("_last"),
    )
    if not few:  # a type meets its index once per entity, whatever the number of its events; a hot type is salted
        cells = join_few(cells, cut_lineage(dictionary), ["_t"], F.col("_e"), most=0).drop("_t")
    return _gather(cells, entity)


def _gather(cells: DataFrame, entity: str) -> DataFrame:
    v = F.array_sort(F.collect_list(F.struct("_i", "_cnt", "_tot", "_last")))
    return (
        cells.groupBy("_e")
        .agg(v.alias("_v"))
        .select(
            F.col("_e").alias(entity),
            F.col("_v._i").alias("idx"),
            F.col("_v._cnt").alias("cnt"),
            F.col("_v._tot").alias("tot"),
            F.col("_v._last").alias("last_us"),
        )
    )


def explode_features(features: DataFrame, entity: str) -> DataFrame:
    """The vectors as cells: entity, ``idx``, ``cnt``, ``tot``, ``last_us``."""
    return features.select(entity, F.inline(F.arrays_zip(*VECTOR)))


def merge_features(parts: Sequence[DataFrame], entity: str) -> DataFrame:
    """Combine feature tables of disjoint event sets (same dictionary) into one."""
    cells = None
    for p in parts:
        e = explode_features(p, entity)
        cells = e if cells is None else cells.unionByName(e)
    merged = cells.groupBy(F.col(entity).alias("_e"), F.col("idx").alias("_i")).agg(
        F.sum("cnt").alias("_cnt"), F.sum("tot").alias("_tot"), F.max("last_us").alias("_last")
    )
    return _gather(merged, entity)


def expand_features(features: DataFrame, entity: str, types: Sequence[str]) -> DataFrame:
    """One column each for count, total and latest time (µs) of every type.

    Column names are ``n_<type>``, ``ok_<type>`` and ``last_us_<type>``; a type an
    entity never had counts 0 with a null latest time.
    """
    width = len(types)
    kind = features.schema[entity].dataType
    schema = f"`{entity}` {kind.simpleString()}" + "".join(f", `{p}_{t}` bigint" for p in ("n", "ok", "last_us") for t in types)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, idx, *vectors = b.columns
            owner = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
            at = idx.flatten().to_numpy()
            arrays = [e]
            for v, missing in zip(vectors, (False, False, True), strict=True):
                flat = v.flatten()
                grid = np.zeros((width, b.num_rows), dtype=np.int64)
                grid[at, owner] = flat.fill_null(0).to_numpy(zero_copy_only=False)
                absent = np.full((width, b.num_rows), missing)
                absent[at, owner] = np.asarray(flat.is_null()) if missing else False
                arrays += [pa.array(grid[i], mask=absent[i]) for i in range(width)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [entity] + [f"{p}_{t}" for p in ("n", "ok", "last_us") for t in types]
    return features.select(entity, *VECTOR).mapInArrow(dense, schema)
