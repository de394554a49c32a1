"""Grouping activity into sessions by occupancy bitmaps.

Time is cut into slots (a fraction of the allowed gap).  Per entity the slots
holding events form a bitmap; a morphological closing (dilation, then erosion,
each by doubling shifts) fills every hole that is certainly no longer than the
gap, the runs of the closed bitmap are the sessions, and the slots' event counts
and first and last instants are joined to them.  Holes whose length in slots
leaves the answer open are settled by the runs' exact end points, so the result
is exact at the resolution of the timestamps.  Empty stretches are shortened to
just over the gap before the bits are laid out, so a bitmap grows with the
events and not with the time they span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64


def _shift_up(words: np.ndarray, by: int) -> np.ndarray:
    """Move every bit ``by`` places up (towards later slots)."""
    whole, part = divmod(by, _WORD)
    out = np.zeros_like(words)
    if whole < len(words):
        out[whole:] = words[: len(words) - whole] << np.uint64(part)
        if part and whole + 1 < len(words):
            out[whole + 1 :] |= words[: len(words) - whole - 1] >> np.uint64(_WORD - part)
    return out


def _shift_down(words: np.ndarray, by: int) -> np.ndarray:
    whole, part = divmod(by, _WORD)
    out = np.zeros_like(words)
    if whole < len(words):
        out[: len(words) - whole] = words[whole:] >> np.uint64(part)
        if part and whole + 1 < len(words):
            out[: len(words) - whole - 1] |= words[whole + 1 :] << np.uint64(_WORD - part)
    return out


def close_bitmap(words: np.ndarray, reach: int) -> np.ndarray:
    """Fill holes of up to ``reach`` zero bits: dilate upwards, then erode, in O(log reach) shifts.

    The caller leaves at least ``reach`` zero bits above the last set bit.
    """
    grown, done = words, 0
    while done < reach:
        step = min(done + 1, reach - done)
        grown = grown | _shift_up(grown, step)
        done += step
    kept, done = grown, 0
    while done < reach:
        step = min(done + 1, reach - done)
        kept = kept & _shift_down(kept, step)
        done += step
    return kept


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    event_id: str | None = None,
    gap_us: int = 30 * 60 * 1_000_000,
    slots_per_gap: int = 30,
) -> DataFrame:
    """Maximal rows of events of one entity with no step longer than ``gap_us``.

    Columns: ``keys``, ``start_us``, ``end_us`` (first and last instant,
    microseconds since 1970 UTC), ``duration_us`` and ``events``.  A step of
    exactly the gap still belongs; one event alone is a session; ties are one
    instant.  With ``event_id``, exact repetitions of an event count once.

    Events without ``ts`` or with a null in the first key belong to no session; a
    null in a later key is a value of its own; an empty table gives no rows.
    """
    if gap_us < slots_per_gap:
        slots_per_gap = max(1, gap_us)
    slot = max(1, gap_us // slots_per_gap)
    k = [f"_k{i}" for i in range(len(keys))]
    cols = [*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("_us")]
    if event_id is not None:
        cols.append(F.col(f"`{event_id}`").alias("_id"))
    rows = df.select(*cols).where(F.col(k[0]).isNotNull() & F.col("_us").isNotNull())
    if event_id is not None:
        rows = rows.distinct()
    # partial aggregation: a hot entity reaches its task as at most one row per slot of time
    slots = rows.groupBy(*k, F.expr(f"(_us - pmod(_us, {slot}L)) div {slot}L").alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_from"), F.max("_us").alias("_to")
    )
    schema = T.StructType(
        [T.StructField(a, slots.schema[a].dataType) for a in k]
        + [T.StructField(n, T.LongType()) for n in ("start_us", "end_us", "events")]
    )
    names, nk, wide = [f.name for f in schema.fields], len(k), gap_us
    #: slots this near are certainly within the gap; those from `apart` on are certainly not
    near, apart = max(0, gap_us // slot - 1), -(-gap_us // slot) + 1

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = batch.num_rows
        fresh = np.ones(n, dtype=bool)
        if n > 1:
            same = np.ones(n - 1, dtype=bool)
            for i in range(nk):
                c = batch.column(i)
                null = np.asarray(c.is_null())
                same &= np.asarray(pc.equal(c.slice(1), c.slice(0, n - 1)).fill_null(True)) & (null[1:] == null[:-1])
            fresh[1:] = ~same
        at, count, lo, hi = (batch.column(nk + i).to_numpy() for i in range(4))
        step = np.empty(n, dtype=np.int64)
        step[0] = 0
        step[1:] = np.where(fresh[1:], apart + 1, np.minimum(at[1:] - at[:-1], apart + 1))
        place = np.cumsum(step)
        words = np.zeros((int(place[-1]) + near + 1) // _WORD + 1, dtype=np.uint64)
        np.bitwise_or.at(words, place // _WORD, np.uint64(1) << (place % _WORD).astype(np.uint64))
        closed = close_bitmap(words, max(0, near - 1))
        bits = np.unpackbits(closed.view(np.uint8), bitorder="little")
        begins = np.flatnonzero(bits & ~np.concatenate(([0], bits[:-1])).astype(np.uint8) & 1)
        first = np.searchsorted(place, begins)  # the run begins on an occupied slot: erosion trimmed the rest
        last = np.append(first[1:], n) - 1
        # holes between near and apart: the exact instants decide
        joined = ~fresh[first[1:]] & (lo[first[1:]] - hi[last[:-1]] <= wide)
        keep = np.concatenate(([True], ~joined))
        start = first[keep]
        end = np.append(start[1:], n) - 1
        return start, lo[start], hi[end], np.add.reduceat(count, start), fresh

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        held: pa.RecordBatch | None = None  # the last session so far, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            start, lo, hi, count, _ = runs(batch)
            at = pa.array(start)
            keys_out = [batch.column(i).take(at) for i in range(nk)]
            head = tuple(c[0].as_py() for c in keys_out)
            if held is not None:
                if head == open_key and lo[0] - held.column(nk + 1)[0].as_py() <= wide:
                    lo = lo.copy()
                    count = count.copy()
                    lo[0] = held.column(nk)[0].as_py()
                    count[0] += held.column(nk + 2)[0].as_py()
                else:
                    yield held
            whole = pa.RecordBatch.from_arrays([*keys_out, pa.array(lo), pa.array(hi), pa.array(count)], names=names)
            held = whole.slice(whole.num_rows - 1)
            open_key = tuple(c[c.__len__() - 1].as_py() for c in keys_out)
            if whole.num_rows > 1:
                yield whole.slice(0, whole.num_rows - 1)
        if held is not None:
            yield held

    found = slots.repartition(*k).sortWithinPartitions(*k, "_slot").mapInArrow(stream, schema)
    return found.select(
        *[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)],
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "events",
    )
