"""Implausible measurements, judged against each source's own behaviour.

A local-level state-space model follows the logarithm of every field of a
source: a Kalman filter forecasts the next reading, the innovation is
standardised by its forecast variance, and a reading far outside is flagged and
withheld from the update.  Readings withheld for a week or more that agree among
themselves are a new level: the filter restarts there and they are released.
Within the least factor from the forecast a reading is flagged only where it
stands alone: just as far outside the source's noise, to the same side, from the
plausible readings before and after it.  Short shifts shared by successive runs,
and a first or last reading within that factor, stay.
Where the variance of the innovations of the last readings vanishes (the readings
are exactly equal) the source is stuck.  Readings that are not positive, or pairs in the wrong order, are
impossible whatever the source does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.percentiles import percentiles
from tarn.operators.ranks import ranked
from tarn.operators.skew import join_null_safe
from tarn.sources import cut_lineage


@dataclass(frozen=True)
class SpikeModel:
    """Parameters of the filter; the defaults are those of the registered query."""

    threshold: float = 4.75  #: standardised innovation beyond which a reading is flagged
    least_ratio: float = 2.0  #: and the least factor from the forecast, unless the reading stands alone
    drift: float = 0.03  #: process noise: standard deviation of the level's move per square root of a day, relative to the noise
    floor_noise: float = 0.01  #: least standard deviation of the logarithm
    prior_noise: float = 0.15  #: noise before the source has shown any
    prior_weight: float = 4.0
    memory: int = 60  #: readings over which the innovation variance is averaged
    level_days: int = 7  #: withheld readings that persist this long are a level, not a spike
    level_readings: int = 3
    stuck: int = 6  #: equal readings in a row that count as stuck
    warm_up: int = 8  #: readings whose median gives the first level


def step_sizes(values: np.ndarray) -> np.ndarray:
    """Sizes of the moves of the logarithm to each usable reading from the usable one before; NaN elsewhere and where nothing moved."""
    out = np.full(len(values), np.nan)
    usable = np.flatnonzero(np.isfinite(values) & (values > 0))
    if len(usable) > 1:
        moves = np.abs(np.diff(np.log(values[usable])))
        out[usable[1:]] = np.where(moves > 0, moves, np.nan)
    return out


def noise_of(middle: float, count: int, model: SpikeModel) -> float:
    """Variance the source shows from step to step, from the median size of its moves, which spikes and level changes hardly touch."""
    own = middle * 1.4826 / math.sqrt(2) if count >= 5 else model.prior_noise
    return max(own, model.floor_noise) ** 2


def kalman_flags(days: np.ndarray, values: np.ndarray, model: SpikeModel, base: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flags and standardised innovations of one field of one source, in order.

    Null (NaN) readings get no flag.  Non-positive readings are skipped here.
    ``base`` is the source's noise (``noise_of``) where only a part of it is given.
    """
    n = len(values)
    flags = np.zeros(n, dtype=bool)
    scores = np.zeros(n)
    usable = np.flatnonzero(np.isfinite(values) & (values > 0))
    if len(usable) < 3:
        return flags, scores
    y = np.log(values[usable])
    t = days[usable]
    least = math.log(model.least_ratio)
    if base is None:
        moves = np.sort(step_sizes(values))
        count = int(np.count_nonzero(~np.isnan(moves)))
        base = noise_of(float(moves[(count - 1) // 2]) if count else 0.0, count, model)

    def start(i: int) -> tuple[float, float]:
        return float(np.median(y[i : i + model.warm_up])), base

    def alone(i: int, e: float) -> bool:
        """Whether the readings before and after, spikes beyond the least factor passed over, are both away from reading ``i`` by as much as noise allows none to be."""
        after = next((j for j in range(i + 1, len(y)) if abs(y[j] - level) <= least), None)
        if before is None or after is None:
            return False
        far = model.threshold * math.sqrt(2 * max(noise, base))  # a difference of two readings has twice their variance
        return min((y[i] - y[before]) * np.sign(e), (y[i] - y[after]) * np.sign(e)) > far

    level, p = start(0)
    before: int | None = None  # the last reading neither flagged nor withheld
    noise, weight = base, model.prior_weight
    held: list[int] = []
    last = t[0]
    for i in range(len(y)):
        p += base * model.drift * max(1.0, float(t[i] - last))
        last = t[i]
        s = p + max(noise, base)
        e = float(y[i]) - level
        z = e / math.sqrt(s)
        scores[usable[i]] = z
        if abs(z) > model.threshold and abs(e) > least:
            held.append(i)
            if t[i] - t[held[0]] >= model.level_days and len(held) >= model.level_readings:
                recent = y[held]
                middle = float(np.median(recent))
                agree = np.abs(recent - middle) <= max(least, model.threshold * math.sqrt(max(noise, base)))
                consecutive = i - held[0] + 1 == len(held)
                if consecutive and agree.mean() >= 0.75:
                    for j, ok in zip(held, agree, strict=True):
                        flags[usable[j]] = not ok
                    level, p = middle, base / len(held)
                    before = max(j for j, ok in zip(held, agree, strict=True) if ok)
                    held = []
                    continue
            flags[usable[i]] = True
            continue
        held = []
        if abs(z) > model.threshold and alone(i, e):
            flags[usable[i]] = True
            continue
        before = i
        gain = p / s
        level += gain * e
        p *= 1 - gain
        weight = min(weight + 1, model.memory)
        noise += (e * e * (1 - gain) - noise) / weight
        noise = max(noise, base * 0.25)
    return flags, scores


def stuck_flags(values: np.ndarray, least: int) -> np.ndarray:
    """Readings in a stretch of ``least`` successive non-null ones over which the innovations against the last reading have no variance."""
    flags = np.zeros(len(values), dtype=bool)
    at = np.flatnonzero(~np.isnan(values))
    if len(at) < least:
        return flags
    v = values[at]
    with np.errstate(invalid="ignore"):
        steps = np.where(v[1:] == v[:-1], 0.0, 1.0)  # innovations of a level that follows every reading, by whether they vanish
    variance = np.convolve(steps, np.ones(least - 1), "valid")
    for i in np.flatnonzero(variance == 0):
        flags[at[i : i + least]] = True
    return flags


def spikes(
    df: DataFrame,
    source: Sequence[str],
    run: str,
    day: str,
    fields: Sequence[str],
    ordered_pairs: Sequence[tuple[str, str]] = (),
    model: SpikeModel = SpikeModel(),
    slice_rows: int = 50_000,
    context_rows: int = 2_000,
) -> DataFrame:
    """One row per run with ``impossible``, ``stuck`` and ``outlying`` flags and the largest innovation.

    ``df`` has one row per (``source``, ``run``) delivery; exact repetitions count
    once.  ``ordered_pairs`` (a, b) demand a ≤ b where both are present.  Output:
    ``source`` columns, ``run``, ``impossible``, ``stuck``, ``outlying``, ``implausible`` and ``score`` (the
    standardised innovation of largest size).

    The runs of a source are judged in slices of ``slice_rows``, each with the
    ``context_rows`` before and after it, whose flags are not emitted, so that no task
    holds a third of the table even if all its runs are of one day.  Most sources
    are one slice.  The noise of a source is taken over all its slices (the exact
    median of its moves).  The filter forgets by a sixth and its variance by a
    sixtieth per reading, so that after the context nothing of a slice's start is
    left: 2,000 readings leave 10^-14 of it.

    Defined cases: a null source field is a value of its own; runs without day
    sort first; null and NaN readings are never flagged; an empty table gives no
    rows; ties in day are ordered by ``run``.
    """
    k = [f"_k{i}" for i in range(len(source))]
    f = [f"_f{i}" for i in range(len(fields))]
    rows = (
        df.select(
            *[F.col(f"`{c}`").alias(a) for c, a in zip(source, k, strict=True)],
            F.col(f"`{run}`").alias("_run"),
            F.coalesce(F.unix_date(F.col(f"`{day}`").cast("date")), F.lit(-(2**30))).alias("_d"),
            *[F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(fields, f, strict=True)],
        )
        .distinct()
    )
    rows = _sliced(rows, k, f, slice_rows, min(context_rows, slice_rows), model)
    pairs = tuple((fields.index(a), fields.index(b)) for a, b in ordered_pairs)
    nk, nf = len(k), len(f)
    types = rows.schema
    schema = (
        ", ".join(f"{a} {types[a].dataType.simpleString()}" for a in k)
        + f", _run {types['_run'].dataType.simpleString()}, impossible boolean, stuck boolean, outlying boolean, score double"
    )
    names = [*k, "_run", "impossible", "stuck", "outlying", "score"]

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All runs of one slice of one source, in order."""
        days = table.column("_d").to_numpy()
        readings = [table.column(a).cast(pa.float64()).to_numpy() for a in f]  # nulls become NaN
        n = len(days)
        impossible, stuck, outlying, score = (np.zeros(n, dtype=x) for x in (bool, bool, bool, float))
        noises = [table.column(f"_noise{i}")[0].as_py() for i in range(nf)]
        for i, v in enumerate(readings):
            with np.errstate(invalid="ignore"):
                impossible |= v <= 0
            stuck |= stuck_flags(v, model.stuck)
            flags, z = kalman_flags(days, v, model, noises[i])
            outlying |= flags
            score = np.where(np.abs(z) > np.abs(score), z, score)
        for a, b in pairs:
            with np.errstate(invalid="ignore"):
                impossible |= readings[a] > readings[b]
        own = table.column("_own").to_numpy(zero_copy_only=False)
        out = pa.table([*(table.column(a) for a in [*k, "_run"]), pa.array(impossible), pa.array(stuck), pa.array(outlying), pa.array(score)], names=names)
        yield from out.filter(pa.array(own)).combine_chunks().to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for name in [*k, "_slice"]:
                c = batch.column(names_in.index(name))
                null = np.asarray(c.is_null())
                eq = np.asarray(pa.compute.equal(c.slice(1), c.slice(0, n - 1)).fill_null(True)) & (null[1:] == null[:-1])
                change[1:] |= ~eq
            head = tuple(batch.column(names_in.index(c))[0].as_py() for c in [*k, "_slice"])
            if held and head != key:
                yield from judge(pa.Table.from_batches(held))
                held = []
            bounds = [0, *np.flatnonzero(change).tolist(), n]
            for a, b in zip(bounds, bounds[1:]):
                if a and held:
                    yield from judge(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            key = tuple(batch.column(names_in.index(c))[n - 1].as_py() for c in [*k, "_slice"])
        if held:
            yield from judge(pa.Table.from_batches(held))

    names_in = [*k, "_slice", "_own", *[f"_noise{i}" for i in range(nf)], "_d", "_run", *f]
    found = rows.select(*names_in).repartition(*k, "_slice").sortWithinPartitions(*k, "_slice", "_d", "_run").mapInArrow(stream, schema)
    return found.select(
        *[F.col(a).alias(c) for c, a in zip(source, k, strict=True)],
        F.col("_run").alias(run),
        "impossible",
        "stuck",
        "outlying",
        (F.col("impossible") | F.col("stuck") | F.col("outlying")).alias("implausible"),
        "score",
    )


def _sliced(rows: DataFrame, k: list[str], f: list[str], slice_rows: int, context: int, model: SpikeModel) -> DataFrame:
    """Add ``_slice``, ``_own`` and ``_noise0``, ... (a variance per field, null where the slice is the whole source).

    The table of sources of more than one slice is broadcast when it has been
    counted to at most a thousand rows; beyond that it is joined like any other.
    """
    big = cut_lineage(rows.groupBy(*k).count().where(F.col("count") > slice_rows).drop("count"))
    many = big.limit(1001).count()
    whole = rows.withColumns({"_slice": F.lit(0).cast("long"), "_own": F.lit(True), **{f"_noise{i}": F.lit(None).cast("double") for i in range(len(f))}})
    if not many:
        return whole
    few = many <= 1000
    small = join_null_safe(whole, big, k, "left_anti", broadcast=few)
    # the place of each run in its source, without a window over the source
    placed = ranked(join_null_safe(rows, big, k, "left_semi", broadcast=few), k, [F.col("_d").asc(), F.col("_run").asc_nulls_first()], "_at", "_size")
    at, size = F.col("_at"), F.lit(slice_rows)
    mine = F.floor(at / size)
    last = F.floor((F.col("_size") - 1) / size)
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((at - context) / size)), F.least(last, F.floor((at + context) / size)))
    cut = cut_lineage(placed.withColumn("_mine", mine).withColumn("_slice", F.explode(near)).withColumn("_own", F.col("_slice") == F.col("_mine")).drop("_at", "_size", "_mine"))

    def of_slice(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_d", "_run"], kind="stable", na_position="first")
        own = part["_own"].to_numpy()
        found = [step_sizes(part[a].to_numpy(dtype="float64", na_value=np.nan))[own] for a in f]
        return pd.DataFrame({**{a: [part[a].iloc[0]] * (len(f) * int(own.sum())) for a in k}, "_field": np.repeat(np.arange(len(f)), own.sum()), "_move": np.concatenate(found)})

    types = ", ".join(f"{a} {rows.schema[a].dataType.simpleString()}" for a in k)
    sizes = cut.groupBy(*k, "_slice").applyInPandas(of_slice, f"{types}, _field int, _move double").where(F.col("_move").isNotNull() & ~F.isnan("_move"))
    middle = percentiles(cut_lineage(sizes), [*k, "_field"], "_move", (0.5,))
    noise = F.when(F.col("n") >= 5, F.col("value") * (1.4826 / math.sqrt(2))).otherwise(F.lit(model.prior_noise))
    per = middle.select(*k, "_field", F.pow(F.greatest(noise, F.lit(model.floor_noise)), F.lit(2.0)).alias("_v"))
    wide = big
    for i in range(len(f)):
        one = per.where(F.col("_field") == i).select(*k, F.col("_v").alias(f"_noise{i}"))
        wide = join_null_safe(wide, one, k, "left")
    wide = cut_lineage(wide.fillna(noise_of(0.0, 0, model), [f"_noise{i}" for i in range(len(f))]))
    return small.unionByName(join_null_safe(cut, wide, k, broadcast=few).select(*small.columns))
