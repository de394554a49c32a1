"""Percentiles per group by radix selection, exact and mergeable.

Floating values map to 64-bit integers in the same order.  A pass histograms one
digit of that integer per group (map-side combine, so a hot group becomes at
most 2^bits cells) and keeps, for every target rank, only the digit that contains
it; rows outside the kept prefixes drop out.  After all digits the value is
exact.  The histogram of the leading digits alone is a summary of fixed relative
precision that adds up over days and files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.skew import join_few
from tarn.sources import cut_lineage

_BITS = 64
#: ordered integers of the infinities
_INFINITY, _MINUS_INFINITY = 0x7FF0 << 48, (0x0010 << 48) - 1 - (1 << 63)


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """Order-preserving integers of doubles; -0 equals 0, every NaN is the one above infinity, null stays null."""
    x = v.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = np.where(np.isnan(x), np.int64(0x7FF8 << 48), x.view(np.int64))
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def _doubles(b: pd.Series) -> pd.Series:
    bits = b.to_numpy(dtype="int64")
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def from_ordered_bits(b: Column) -> Column:
    """The double of an order-preserving integer; all above infinity's is NaN (which pandas would turn into null)."""
    return F.when(b > F.lit(_INFINITY), F.lit(float("nan"))).otherwise(_doubles(b))


def ordered_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of ``keys`` as ``_k0``, ... and ``_b`` (ordered integer of the reading).

    Null readings are left out, null keys are a group of their own.
    """
    return (
        df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], F.col(f"`{value}`").cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .select(*[f"_k{i}" for i in range(len(keys))], ordered_bits("_v").alias("_b"))
    )


def digit_histogram(df: DataFrame, keys: Sequence[str], value: str, bits: int = 24) -> DataFrame:
    """A mergeable summary: ``keys``, ``digit`` (leading ``bits`` of the ordered integer), ``n``.

    A cell spans less than a factor 1 + 2^-(bits-12) of a value, which bounds the
    error of any percentile read from it.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    h = ordered_rows(df, keys, value).groupBy(*k, F.shiftright("_b", _BITS - bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    return h.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], "digit", "n")


def merge_histograms(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Add up summaries of separate days, files or partitions."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys, "digit").agg(F.sum("n").alias("n"))


def histogram_percentiles(histogram: DataFrame, keys: Sequence[str], at: Sequence[float], bits: int = 24) -> DataFrame:
    """Percentiles with bounds from a summary: ``keys``, ``q``, ``n``, ``low``, ``high`` (low ≤ exact ≤ high)."""
    k = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    cells = histogram.select(*k, F.col("digit").alias("_p"), F.col("n").alias("_n"))
    state = _targets(cells, [f"_k{i}" for i in range(len(keys))], at)
    low = F.shiftleft(F.col("_p"), _BITS - bits)
    high = low.bitwiseOR(F.lit((1 << (_BITS - bits)) - 1))
    return state.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)],
        F.col("_q").alias("q"),
        F.col("_total").alias("n"),
        from_ordered_bits(F.greatest(low, F.lit(_MINUS_INFINITY))).alias("low"),
        from_ordered_bits(F.when(low <= F.lit(_INFINITY), F.least(high, F.lit(_INFINITY))).otherwise(high)).alias("high"),
    )


def _running(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells with ``_upto``, the count up to and with each, and ``_all`` of their group.

    There are at most 2^bits cells in a group, so the window is bounded.
    """
    w = Window.partitionBy(*by)
    return cells.withColumns({"_upto": F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})


def _targets(cells: DataFrame, k: list[str], at: Sequence[float]) -> DataFrame:
    """The cell that holds each percentile's rank, the ceiling of q·n and at least 1, and the rank within it."""
    ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(q)) * F.col("_all"), 6))).cast("long").alias("r")) for q in at])
    here = F.filter(ranks, lambda x: (x.getField("r") > F.col("_upto") - F.col("_n")) & (x.getField("r") <= F.col("_upto")))
    run = _running(cells, k).withColumn("_x", F.explode(here))
    kept = [c for c in cells.columns if c != "_n"]
    return run.select(*kept, F.col("_x.q").alias("_q"), F.col("_all").alias("_total"), (F.col("_x.r") - F.col("_upto") + F.col("_n")).alias("_rank"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], digit_bits: int = 16) -> DataFrame:
    """Exact percentiles of ``value`` per group: ``keys``, ``q``, ``n``, ``value``.

    The percentile q of n readings is the reading of rank max(1, ceil(q·n)), so
    the error is zero and the result does not depend on partitioning.

    The first digit is counted straight from the rows: at most 2^digit_bits cells
    per group and map task are shuffled, and no reading.  Only readings under a kept
    prefix are written (as value and count) and looked at again; a target is
    settled as soon as its cell holds a single value.  ``df`` is read twice, so a
    costly one should be written first.

    Defined cases: null readings do not count, NaN sorts above infinity, a group
    without readings gives no row, null keys form a group, ties are readings like
    any other, an empty table gives no rows.
    """
    if _BITS % digit_bits:
        raise ValueError("digit_bits must divide 64")
    k = [f"_k{i}" for i in range(len(keys))]
    rows = ordered_rows(df, keys, value).withColumn("_n", F.lit(1).cast("long"))
    ends = [F.sum("_n").alias("_n"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi")]
    done = digit_bits
    cells = rows.groupBy(*k, F.shiftright("_b", _BITS - done).alias("_p")).agg(*ends)
    state = cut_lineage(_targets(cells, k, at))
    while done < _BITS:
        open_ = state.where(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            break
        near = join_few(rows.withColumn("_p", F.shiftright("_b", _BITS - done)), open_.select(*k, "_p").distinct(), [*k, "_p"], F.col("_b"), how="left_semi")
        rows = cut_lineage(near.groupBy(*k, "_b").agg(F.sum("_n").alias("_n"))) if done == digit_bits else near.drop("_p")
        done += digit_bits
        above = F.shiftright("_b", _BITS - done + digit_bits).alias("_above")
        run = _running(rows.groupBy(*k, above, F.shiftright("_b", _BITS - done).alias("_p")).agg(*ends), [*k, "_above"]).drop("_all")
        hit = (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto"))
        asked = open_.select(*k, F.col("_p").alias("_above"), "_q", "_total", "_rank")
        closer = join_few(run, asked, [*k, "_above"], F.col("_p"), also=hit).select(*k, "_p", "_lo", "_hi", "_q", "_total", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
        state = cut_lineage(state.where(F.col("_lo") >= F.col("_hi")).unionByName(closer))
    return state.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], F.col("_q").alias("q"), F.col("_total").alias("n"), from_ordered_bits(F.col("_lo")).alias("value"))
