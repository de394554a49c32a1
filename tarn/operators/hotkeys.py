"""Per-key results when a few keys hold most records.

Counts, failures and latest times are partial aggregates: a hot key leaves every
map task as one row.  Quantiles per key come from distributed exact selection:
every round cuts each key's current interval of values into equal bins, adds up
mergeable bin counts and keeps the bin holding the wanted rank, until one value
is left.  The values of a hot key are never gathered anywhere.  The same
selection over the codes of the keys finds the hot keys themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.skew import join_few, join_null_safe
from tarn.sources import cut_lineage


def refine_quantiles(counts: DataFrame, k: Sequence[str], at: Sequence[float], bins: int = 1024) -> DataFrame:
    """Exact quantiles of the integer column ``_v`` per key: rows of ``k``, ``_q``, ``_value``.

    ``counts`` has one row per key and value with its count ``_n``.  Each round
    replaces a key's interval by the occupied part of the bin that holds the wanted
    rank; an interval of width w shrinks to w / bins at least, so values of 64 bits
    resolve within ceil(64 / log2(bins)) rounds.  The first interval is a key's whole
    span; the rows of the second are written, and later rounds read only these.
    Intervals are few (one per key and quantile):
    counted small they are broadcast, beyond that the join to them is salted, so
    that a hot key is never one task.
    """
    k = list(k)
    rows = counts.where(F.col("_v").isNotNull()).select(*k, "_v", "_n")
    span = rows.groupBy(*k).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    q = F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("_q")
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("_q") * F.col("_total"), 6))).cast("long")
    state = cut_lineage(span.select(*k, "_total", "_lo", "_hi", q).withColumn("_rank", rank))
    width = F.expr(f"_hi div {bins} - _lo div {bins} + 1")  # no overflow even over the whole range
    for turn in range(64):
        open_ = state.where(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            break
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        inside = join_few(rows, open_.select(*k, "_lo", "_hi").distinct(), k, F.col("_v"), also=within).select(*k, "_lo", "_hi", "_v", "_n", width.alias("_w"))
        if turn == 1:
            inside = cut_lineage(inside)
            rows = inside.select(*k, "_v", "_n").distinct()  # intervals of one key may overlap only by being equal
        cells = inside.groupBy(*k, "_lo", "_hi", F.expr("(_v div _w) - (_lo div _w)").alias("_bin")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        # at most bins + 2 cells in a window
        upto = F.sum("_n").over(Window.partitionBy(*k, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("_upto", upto)
        hit = (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto"))
        closer = join_few(cells, open_, [*k, "_lo", "_hi"], F.col("_bin"), also=hit).select(
            *k, "_total", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_q", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")
        )
        state = cut_lineage(state.where(F.col("_lo") >= F.col("_hi")).unionByName(closer))
    return state.select(*k, "_q", F.col("_lo").alias("_value"))


def heavy_keys(df: DataFrame, keys: Sequence[str], event_id: str | None, share: float) -> DataFrame:
    """Keys (all fields present) holding at least ``share`` of the events: ``keys``, ``n``, ``share``.

    In the order of their codes the events of a key follow each other, so a key
    with that share covers one of the ranks 1·share, 2·share, ... of all events.  The
    selection of these quantiles over the codes gives at most 1 / share + 1
    candidates; their counts decide.

    With ``event_id``, exact repetitions of (key, event) count once.  An empty
    table has no such key.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], *([F.col(f"`{event_id}`").alias("_id")] if event_id is not None else [])).dropna(subset=k)
    if event_id is not None:
        rows = rows.distinct()
    counts = cut_lineage(rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).withColumn("_v", F.xxhash64(*k)))
    # the least of whole-number ranks that are no further apart than share · events
    at = [min(1.0, i * share) for i in range(1, ceil(1 / share) + 1)]
    found = refine_quantiles(counts.withColumn("_g", F.lit(0)), ["_g"], at).select(F.col("_value").alias("_v")).distinct()
    all_ = counts.agg(F.sum("_n").alias("_all"))  # one row
    candidates = counts.join(F.broadcast(found), "_v").crossJoin(F.broadcast(all_))  # found has a row per rank
    return candidates.where(F.col("_n") >= F.lit(share) * F.col("_all")).select(
        *[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], F.col("_n").alias("n"), (F.col("_n") / F.col("_all")).alias("share")
    )


def key_profile(
    df: DataFrame,
    keys: Sequence[str],
    event_id: str | None,
    ok: str,
    ts: str,
    value: Column,
    at: Sequence[float] = (0.5, 0.9, 0.99),
) -> DataFrame:
    """One row per key: ``n``, ``failed``, ``last_us``, ``share``, ``values`` and one column ``value_q<percent>`` per quantile.

    ``failed`` counts events with ``ok`` false (null is not false); ``share`` is n over
    the events in which every key field is present (null for keys with a null
    field); ``value`` is an integer column whose quantile q is the reading of rank
    max(1, ceil(q·count)).  With ``event_id``, exact repetitions count once.

    Null key fields are values of their own; a key without values has null
    quantiles; an empty table gives no rows.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    cols = [
        *[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)],
        F.col(f"`{ok}`").cast("boolean").alias("_ok"),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("_us"),
        value.cast("long").alias("_v"),
    ]
    rows = df.select(*cols, *([F.col(f"`{event_id}`").alias("_id")] if event_id is not None else []))
    if event_id is not None:
        rows = rows.distinct().drop("_id")
    # one mergeable table of (key, value) counts serves both the per-key results and the selection
    counts = cut_lineage(
        rows.groupBy(*k, "_v").agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.when(F.col("_ok") == F.lit(False), 1).otherwise(0)).alias("_failed"),
            F.max("_us").alias("_last"),
        )
    )
    totals = counts.groupBy(*k).agg(F.sum("_n").alias("n"), F.sum("_failed").alias("failed"), F.max("_last").alias("last_us"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("values"))
    found = refine_quantiles(counts, k, at)
    present = F.lit(True)
    for a in k:
        present = present & F.col(a).isNotNull()
    all_ = counts.where(present).agg(F.sum("_n").alias("_all"))  # one row
    wide = found.groupBy(*k).agg(*[F.max(F.when(F.col("_q") == F.lit(float(x)), F.col("_value"))).alias(f"value_q{round(x * 100)}") for x in at])
    joined = join_null_safe(totals, wide, k, "left")
    return joined.crossJoin(F.broadcast(all_)).select(
        *[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)],
        "n",
        "failed",
        "last_us",
        F.when(present, F.col("n") / F.col("_all")).alias("share"),
        "values",
        *[c for c in wide.columns if c not in k],
    )
