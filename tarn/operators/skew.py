"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows up to which a side is broadcast once it has been counted
FEW = 100_000


def join_null_safe(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner", also: Column | None = None, merge: bool = False, broadcast: bool = False) -> DataFrame:
    """Join on equality of the named columns, null equal to null; they come from ``a``.

    Other column names must differ between the sides; ``also`` may use any of them.
    ``merge`` forbids a broadcast: the planner guesses a side's size from its
    compressed files, which says nothing of rows that are repeated for salting.
    """
    right = b.withColumnsRenamed({c: f"_r{c}" for c in cols})
    if merge:
        right = right.hint("merge")
    if broadcast:
        right = F.broadcast(right)
    on = F.lit(True) if also is None else also
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return a.join(right, on, how).drop(*[f"_r{c}" for c in cols])


def salted(rows: DataFrame, few: DataFrame, spread: Column, salts: int) -> tuple[DataFrame, DataFrame]:
    """Add ``_salt`` to both sides: a hash of ``spread`` on ``rows``, every value on ``few``.

    ``few`` must have a handful of rows per key; it is repeated ``salts`` times, and
    each key's rows split evenly into as many join keys.
    """
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")),
        few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
    )


def join_few(rows: DataFrame, few: DataFrame, cols: Sequence[str], spread: Column, also: Column | None = None, how: str = "inner", salts: int = 32, most: int = FEW) -> DataFrame:
    """Rows, hot keys among them, meet a table of a handful of rows per key.

    ``few`` is counted (it should be a written table): up to ``most`` rows it is
    broadcast, so that nothing is shuffled; beyond, both sides are salted.
    """
    if few.limit(most + 1).count() <= most:
        return join_null_safe(rows, few, cols, how, also, broadcast=True)
    left, right = salted(rows, few, spread, salts)
    return join_null_safe(left, right, [*cols, "_salt"], how, also, merge=True).drop("_salt")
