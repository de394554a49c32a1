"""Rolling totals over trailing calendar periods, one row per entity and day.

The rows of an entity are first reduced to one partial aggregate per day
(map-side combine, so a hot entity shrinks to at most one row per calendar day
before anything is gathered).  The days are then sorted inside hash partitions
and streamed through a two-stack queue per entity and period: each stack holds
running monoid aggregates, so evicting the oldest day never subtracts and any
associative aggregate (sum, count, min, max, ...) can be kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TwoStackQueue:
    """First-in first-out window over a monoid, amortised O(1) per operation.

    ``op`` must be associative with identity ``unit``; it need neither commute
    nor have an inverse.  Elements carry a tag (here a day number) that grows.
    """

    __slots__ = ("back", "back_total", "front", "op", "unit")

    def __init__(self, op: Callable[[Any, Any], Any], unit: Any) -> None:
        self.op, self.unit = op, unit
        self.front: list[tuple[int, Any]] = []  # top: oldest; each with the aggregate of itself and all newer in front
        self.back: list[tuple[int, Any]] = []
        self.back_total = unit

    def push(self, tag: int, value: Any) -> None:
        self.back.append((tag, value))
        self.back_total = self.op(self.back_total, value)

    def evict_before(self, tag: int) -> None:
        front, back = self.front, self.back
        while True:
            if not front:
                if not back or back[0][0] >= tag:
                    return
                total, op = self.unit, self.op
                for t, v in reversed(back):
                    total = op(v, total)
                    front.append((t, total))
                back.clear()
                self.back_total = self.unit
            if front[-1][0] >= tag:
                return
            front.pop()

    def total(self) -> Any:
        return self.op(self.front[-1][1], self.back_total) if self.front else self.back_total


#: rows of an output batch, so that empty days between distant readings never pile up
_OUT_ROWS = 10_000

#: (sum, count, min, max); the identity holds no reading.
UNIT = (0.0, 0, None, None)


def merge_stats(a: tuple, b: tuple) -> tuple:
    """Monoid of (sum, count, min, max); min and max have no inverse."""
    if not a[1]:
        return b
    if not b[1]:
        return a
    return (a[0] + b[0], a[1] + b[1], a[2] if a[2] <= b[2] else b[2], a[3] if a[3] >= b[3] else b[3])


def calendar_day(text: Column) -> Column:
    """A date from a year-first spelling (``2031-01-08``, ``2031/1/8``, ``20310108``, with or without a time); else null."""
    digits = r"^\s*(\d{4})[-/. ]?(\d{1,2})[-/. ]?(\d{1,2})(?!\d)"
    part = lambda i: F.regexp_extract(text, digits, i)
    numeric = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")
    named = F.try_to_timestamp(F.regexp_replace(F.substring(F.trim(text), 1, 11), r"[-/. ]+", " "), F.lit("yyyy MMM dd")).cast("date")
    return F.coalesce(numeric, named)


def rolling_totals(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """Totals and averages of ``value`` over trailing periods, one row per entity and day.

    ``day`` is a date column.  Days from the entity's first to its last row are
    all present; the rows are ``keys``, ``day``, ``day_index`` (0 on the first day), ``total`` and
    ``readings`` of the day and, for each period p, ``total_p``, ``readings_p``,
    ``avg_p`` (total divided by p calendar days), ``min_p`` and ``max_p``.

    Defined cases: a null key is a key of its own; rows without a day are left
    out; null and NaN readings add nothing but their day counts; an empty table
    gives no rows; other columns of ``df`` are ignored, whatever their names.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    v = F.col(f"`{value}`").cast("double")
    v = F.when(~F.isnan(v), v)
    days = (
        df.select(
            *[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)],
            F.col(f"`{day}`").cast("date").alias("_day"),
            v.alias("_v"),
        )
        .where(F.col("_day").isNotNull())
        .groupBy(*k, F.unix_date("_day").alias("_d"))
        .agg(
            F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"),
            F.count("_v").alias("_n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
        )
    )
    schema = T.StructType(
        [T.StructField(a, days.schema[a].dataType) for a in k]
        + [T.StructField("_d", T.IntegerType()), T.StructField("day_index", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("readings", T.LongType())]
        + [
            T.StructField(f"{n}_{p}", t)
            for p in periods
            for n, t in (("total", T.DoubleType()), ("readings", T.LongType()), ("avg", T.DoubleType()), ("min", T.DoubleType()), ("max", T.DoubleType()))
        ]
    )
    spans = tuple(int(p) for p in periods)
    nk = len(k)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity: tuple | None = None
        last = first = 0
        queues: list[TwoStackQueue] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(i) for i in range(nk)]
            change = np.zeros(n, dtype=bool)
            for c in cols:
                eq = pa.compute.equal(c.slice(1), c.slice(0, n - 1))
                null = np.logical_xor(np.asarray(c.is_null())[1:], np.asarray(c.is_null())[:-1])
                change[1:] |= ~np.asarray(eq.fill_null(True)) | null
            head = tuple(c[0].as_py() for c in cols)
            change[0] = head != entity
            d, s, m, lo, hi = (batch.column(nk + i).to_pylist() for i in range(5))
            source: list[int] = []
            out: list[list] = [[] for _ in range(4 + 5 * len(spans))]

            def part() -> pa.RecordBatch:
                at = pa.array(source, pa.int32())
                arrays = [c.take(at) for c in cols] + [pa.array(o, f.type) for o, f in zip(out, arrow[nk:], strict=True)]
                source.clear()
                for o in out:
                    o.clear()
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for i in range(n):
                today = d[i]
                if change[i]:
                    queues = [TwoStackQueue(merge_stats, UNIT) for _ in spans]
                    first = today
                    last = today - 1
                stat = (s[i], m[i], lo[i], hi[i])
                for at in range(last + 1, today + 1):
                    own = stat if at == today else UNIT
                    row = [at, at - first, own[0], own[1]]
                    for q, p in zip(queues, spans, strict=True):
                        if at == today:
                            q.push(at, stat)
                        q.evict_before(at - p + 1)
                        t = q.total()
                        row += (t[0], t[1], t[0] / p, t[2], t[3])
                    source.append(i)
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
                    if len(source) == _OUT_ROWS:
                        yield part()
                last = today
            entity = tuple(c[n - 1].as_py() for c in cols)
            if source:
                yield part()

    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in schema.fields]
    arrow = list(to_arrow_schema(schema))
    rows = days.repartition(*k).sortWithinPartitions(*k, "_d").mapInArrow(stream, schema)
    return rows.select(
        *[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)],
        F.date_from_unix_date("_d").alias("day"),
        *[f.name for f in schema.fields[nk + 1 :]],
    )
