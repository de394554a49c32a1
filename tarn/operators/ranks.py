"""Exact global ranks without a window over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources import cut_lineage


def ranked(df: DataFrame, within: Sequence[str], by: Sequence[Column], out: str = "_rank", total: str | None = None) -> DataFrame:
    """Add each row's place (from 0) in the order ``by`` among the rows of equal ``within`` columns (null equals null).

    Rows are range-partitioned by ``within``, ``by`` and a hash of the whole row, so that
    neither a hot group nor a hot value is one partition; a row's place is the
    number of its group's rows in earlier partitions plus its place in its own.
    Ties are in no particular order.  ``total`` names a column for the group's size.

    The table of counts has one row per partition and group in it: it is broadcast
    after being counted to at most 100,000 rows, and joined like any other beyond.
    """
    hash_ = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])
    order = [*[F.col(f"`{c}`").asc_nulls_first() for c in within], *by, hash_]
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(parts.withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}))
    keys = [f"_w{i}" for i in range(len(within))]
    per = placed.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(within, keys)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cut_lineage(per.select(*keys, "_p", "_first", ahead.alias("_ahead"), F.sum("_n").over(group).alias("_total")), 1)
    if per.limit(100_001).count() <= 100_000:
        per = F.broadcast(per)
    same = F.col("_part") == F.col("_p")
    for c, k in zip(within, keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    found = placed.join(per, same).withColumn(out, F.col("_mono") - F.col("_first") + F.col("_ahead"))
    if total is not None:
        found = found.withColumn(total, F.col("_total"))
    return found.drop("_part", "_mono", "_p", "_first", "_ahead", "_total", *keys)
