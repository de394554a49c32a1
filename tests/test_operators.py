"""The general problems' operators against brute force, with dirt in every column."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.operators import features, hotkeys, percentiles, rolling, sessions, snapshots, spikes
from tarn.operators.ranks import ranked
from tarn.plans import problems

# ---- rolling -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-9, 9)), max_size=60), st.integers(1, 12))
def test_two_stack_queue_matches_recomputation(steps, width):
    """Concatenation neither commutes nor inverts."""
    q = rolling.TwoStackQueue(lambda a, b: a + b, ())
    at, held = 0, []
    for gap, x in steps:
        at += gap
        q.push(at, (x,))
        held.append((at, x))
        q.evict_before(at - width + 1)
        assert q.total() == tuple(v for t, v in held if t > at - width)


def test_rolling_totals(spark):
    rng = random.Random(3)
    rows = []
    for k in ("a", "b", None):
        for _ in range(40):
            day = dt.date(2031, 1, 1) + dt.timedelta(days=rng.randrange(60))
            rows.append((k, "t", day, rng.choice([None, float("nan"), rng.randrange(100) * 1.0]), 7))
    rows.append(("a", "t", None, 5.0, 7))
    df = spark.createDataFrame(rows, "k string, t string, d date, v double, total_7 int")
    got = {(r.k, r.day): r for r in rolling.rolling_totals(df, ["k", "t"], "d", "v", (7, 30)).collect()}
    want = defaultdict(list)
    for k, _, d, v, _ in rows:
        if d is not None:
            want[k].append((d, v))
    n = 0
    for k, items in want.items():
        first, last = min(d for d, _ in items), max(d for d, _ in items)
        for i in range((last - first).days + 1):
            day = first + dt.timedelta(days=i)
            n += 1
            r = got[(k, day)]
            assert r.day_index == i
            for p in (7, 30):
                vs = [v for d, v in items if 0 <= (day - d).days < p and v is not None and v == v]
                assert math.isclose(r[f"total_{p}"], sum(vs), abs_tol=1e-9)
                assert math.isclose(r[f"avg_{p}"], sum(vs) / p, abs_tol=1e-9)
                assert (r[f"readings_{p}"], r[f"min_{p}"], r[f"max_{p}"]) == (len(vs), min(vs, default=None), max(vs, default=None))
    assert n == len(got)
    assert rolling.rolling_totals(df.limit(0), ["k", "t"], "d", "v").count() == 0


def test_rolling_survives_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_rolling_totals(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_calendar_day(spark):
    texts = ["2031-01-08", "2031/1/8", "20310108", "2031-01-08T00:00:00Z", " 2031.01.08 ", "2031 Jan 08", "x", None, "2031-13-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rolling.calendar_day(F.col("t"))).collect()]
    assert got == [dt.date(2031, 1, 8)] * 6 + [None] * 3


# ---- features ------------------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user string, action string, ts timestamp, ok boolean, idx int")


def test_features(spark):
    t = dt.datetime(2031, 1, 1)
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["u", "v", None]), rng.choice(["x", "y", "z", None]), rng.choice([None, t + dt.timedelta(hours=i)]), rng.choice([True, False, None]), 1)
        for i in range(200)
    ]
    df = events(spark, rows + rows[:50])
    types = features.type_dictionary(df, "action")
    assert types == ["x", "y", "z"]
    f = features.sparse_features(df, "user", "action", "ts", "ok", "event_id", types)
    want = defaultdict(lambda: [0, 0, None])
    for _, u, a, ts, ok, _ in rows:
        if u and a:
            c = want[(u, a)]
            c[0] += 1
            c[1] += ok is True
            c[2] = max(filter(None, (c[2], ts)), default=None)
    cells = {(r["user"], types[r.idx]): [r.cnt, r.tot, r.last_us] for r in features.explode_features(f, "user").collect()}
    micros = lambda x: None if x is None else int(x.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    assert cells == {k: [a, b, micros(c)] for k, (a, b, c) in want.items()}
    halves = [features.sparse_features(df.where(F.col("event_id") % 2 == i), "user", "action", "ts", "ok", "event_id", types) for i in (0, 1)]
    merged = {r["user"]: r for r in features.merge_features(halves, "user").collect()}
    assert merged == {r["user"]: r for r in f.collect()}
    wide = {r["user"]: r for r in features.expand_features(f, "user", [*types, "never"]).collect()}
    assert wide["u"]["n_x"] == want[("u", "x")][0] and wide["u"]["n_never"] == 0 and wide["u"]["last_us_never"] is None
    assert features.sparse_features(df.limit(0), "user", "action", "ts", "ok", "event_id").count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        features.type_dictionary(df, "action", max_types=2)


# ---- sessions ------------------------------------------------------------------------------------------------------


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for i, u, c, us in set(rows):
        if u is not None and us is not None:
            by[(u, c)].append(us)
    out = set()
    for (u, c), ts in by.items():
        ts.sort()
        start, n = ts[0], 1
        for a, b in zip(ts, ts[1:]):
            if b - a > gap:
                out.add((u, c, start, a, n))
                start, n = b, 0
            n += 1
        out.add((u, c, start, ts[-1], n))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=80, unique=True), st.integers(0, 30))
def test_closing_fills_holes_up_to_reach(places, reach):
    places = sorted(places)
    words = np.zeros((places[-1] + reach) // 64 + 2, dtype=np.uint64)
    for p in places:
        words[p // 64] |= np.uint64(1) << np.uint64(p % 64)
    closed = np.unpackbits(sessions.close_bitmap(words, reach).view(np.uint8), bitorder="little")
    want = np.zeros(len(closed), dtype=int)
    for a, b in zip(places, [*places[1:], None]):
        want[a] = 1
        if b is not None and b - a - 1 <= reach:
            want[a:b] = 1
    assert closed.tolist() == want.tolist()


@pytest.mark.parametrize(("gap", "slots", "batch"), [(1800, 30, 10000), (1800, 30, 7), (1000, 7, 50), (5, 30, 10000), (1, 30, 11)])
def test_sessions(spark, gap, slots, batch):
    rng = random.Random(gap)
    rows = []
    for i in range(600):
        at = rng.choice([rng.randrange(40_000), rng.randrange(20) * gap, rng.randrange(20) * gap + rng.choice([-1, 1]), -rng.randrange(5000)])
        rows.append((i, rng.choice(["u", "v", "w", None]), rng.choice([1, 2, None]), rng.choice([at, at, at, at, None])))
    df = spark.createDataFrame([*rows, *rows[:100]], "event_id long, user string, conn long, us long").withColumn("ts", F.timestamp_micros("us")).withColumn("events", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sessions.sessions(df, ["user", "conn"], "ts", "event_id", gap_us=gap, slots_per_gap=slots).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got))
    assert {(r["user"], r.conn, r.start_us, r.end_us, r.events) for r in got} == brute_sessions(rows, gap)
    assert all(r.duration_us == r.end_us - r.start_us for r in got)
    assert sessions.sessions(df.limit(0), ["user", "conn"], "ts", "event_id").count() == 0


# ---- spikes --------------------------------------------------------------------------------------------------------


def series(rng, n, level=100.0, noise=0.05):
    return level * np.exp(rng.normal(0, noise, n))


def test_kalman_flags_spikes_and_accepts_levels():
    rng = np.random.default_rng(2)
    days = np.arange(120)
    v = series(rng, 120)
    v[60:] *= 3.0  # a lasting level
    v[[20, 45, 100]] *= (8.0, 0.05, 12.0)
    flags, _ = spikes.kalman_flags(days, v, spikes.SpikeModel())
    assert set(np.flatnonzero(flags)) == {20, 45, 100}
    wild = series(rng, 200, noise=0.9)
    assert not spikes.kalman_flags(np.arange(200), wild, spikes.SpikeModel())[0].any()
    assert not spikes.kalman_flags(np.arange(5), np.full(5, np.nan), spikes.SpikeModel())[0].any()


def test_kalman_flags_lone_readings_within_the_least_factor():
    rng = np.random.default_rng(5)
    v = series(rng, 150, noise=0.03)
    v[[30, 70]] *= (1.6, 0.6)
    v[100:103] *= 1.5  # shared by three runs
    v[[120, 121]] *= (1.6, 0.02)  # a lone reading beside a far spike
    flags, _ = spikes.kalman_flags(np.arange(150), v, spikes.SpikeModel())
    assert set(np.flatnonzero(flags)) == {30, 70, 120, 121}
    noisy = series(rng, 400, noise=0.15)
    noisy[200] *= 1.6  # within what this source always shows
    assert not spikes.kalman_flags(np.arange(400), noisy, spikes.SpikeModel())[0].any()


def test_stuck_flags():
    v = np.array([1, 1, 1, np.nan, 1, 1, 1, 2, 2, 2, 2, 2, 3.0])
    assert spikes.stuck_flags(v, 6).tolist() == [True, True, True, False, True, True, True] + [False] * 6


def spike_table(spark):
    rng = np.random.default_rng(4)
    rows, run = [], 0
    for s in ("a", "b", None):
        v = series(rng, 80)
        if s == "a":
            v[40] *= 10
        for i in range(80):
            run += 1
            rows.append((s, "t", run, dt.date(2031, 1, 1) + dt.timedelta(days=i), float(v[i]), 1.0, 2.0))
    rows[5] = (*rows[5][:4], -1.0, 1.0, 2.0)
    rows[7] = (*rows[7][:4], None, 3.0, 2.0)
    rows[9] = (*rows[9][:3], None, float("nan"), None, None)
    df = spark.createDataFrame(rows, "w string, t string, run long, day date, x double, p double, q double")
    return df.withColumn("score", F.lit("clash")).withColumn("p", F.col("p") + F.col("run") / 1e4).withColumn("q", F.col("q") + F.col("run") / 1e4)


def test_spikes(spark):
    df = spike_table(spark)
    run = lambda **o: {r.run: r for r in spikes.spikes(df.union(df.limit(50)), ["w", "t"], "run", "day", ["x", "p", "q"], [("p", "q")], **o).collect()}
    got = run()
    assert len(got) == 240
    assert {k for k, r in got.items() if r.impossible} == {6, 8}
    assert {k for k, r in got.items() if r.outlying} == {8, 41}  # run 8 triples a quiet field
    assert spikes.spikes(df.limit(0), ["w", "t"], "run", "day", ["x"]).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert run() == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sliced = run(slice_rows=50, context_rows=45)  # every source is cut
    assert len(sliced) == 240 and {k for k, r in sliced.items() if r.implausible} == {k for k, r in got.items() if r.implausible}


def test_slices_of_a_long_history_give_what_the_whole_gives(spark):
    """Years of runs, many of them of one day, with spikes, stuck readings, a new level and gaps, on both sides of the slice size."""
    rng = np.random.default_rng(21)
    n = 6000
    v = 1000 * np.exp(np.cumsum(rng.normal(0, 0.002, n)) + rng.normal(0, 0.03, n))
    v[3000:] *= 2.6
    v[rng.integers(0, n, 60)] *= rng.choice([0.2, 1.35, 4.0], 60)
    v[2496:2504] = v[2496]
    day = np.sort(rng.integers(0, 1500, n))
    day[1000:2200] = day[1000]
    rows = [("hot", i, dt.date(2030, 1, 1) + dt.timedelta(days=int(day[i])), None if i % 97 == 0 else float(v[i]), float(10 + i % 7)) for i in range(n)]
    rows += [("small", n + i, dt.date(2030, 1, 1) + dt.timedelta(days=i), float(v[i]), 5.0 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "w string, run long, day date, x double, y double").cache()
    run = lambda **o: {r.run: r for r in spikes.spikes(df, ["w"], "run", "day", ["x", "y"], **o).collect()}
    whole, cut = run(), run(slice_rows=1000, context_rows=900)
    flags = lambda r: (r.impossible, r.stuck, r.outlying)
    assert {k: flags(r) for k, r in whole.items()} == {k: flags(r) for k, r in cut.items()} and len(cut) == n + 100
    assert all(abs(whole[k].score - cut[k].score) < 1e-6 * (1 + abs(whole[k].score)) for k in whole)
    assert sum(r.outlying for r in whole.values()) > 30 and all(whole[i].stuck for i in range(2496, 2504) if i % 97)
    df.unpersist()


def test_ranks_are_exact_without_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([1, 1, 1, 2, None, rng.randrange(1000)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = ranked(df, ["g"], [F.col("v").asc_nulls_first()], "at", "of").collect()
    for g in ("a", "b", None):
        own = sorted((r.at, -1 if r.v is None else r.v, r.of) for r in got if r.g == g)
        assert [r[0] for r in own] == list(range(len(own))) and [r[1] for r in own] == sorted(r[1] for r in own)
        assert {r[2] for r in own} == {len(own)}
    assert ranked(df.limit(0), [], [F.col("v").asc()]).count() == 0


def test_heavy_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choices(["x", "y", "z", f"k{rng.randrange(300)}", None], [40, 3, 2, 60, 5])[0], rng.choice(["c", "c", "d", None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:500], "a string, b string, id int").withColumn("n", F.lit("clash"))
    whole = [r[:2] for r in rows if r[0] is not None and r[1] is not None]
    for share in (0.5, 0.02, 0.013, 0.2, 1.0):
        want = {(k, n) for k, n in Counter(whole).items() if n >= share * len(whole)}
        assert {((r.a, r.b), r.n) for r in hotkeys.heavy_keys(df, ["a", "b"], "id", share).collect()} == want
    assert hotkeys.heavy_keys(df.limit(0), ["a", "b"], "id", 0.02).count() == 0


# ---- percentiles and hot keys --------------------------------------------------------------------------------------


def rank_of(values, q):
    s = sorted(values, key=lambda x: (x != x, x))
    return s[max(1, math.ceil(round(q * len(s), 6))) - 1]


def test_combined_percentiles_cover_fields_keys_and_runs_without_day(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, rng.choice("AB"), rng.choice(["x", "y", None]), rng.choice(["2031-01-01", "2031-01-02", "no day", None]), rng.choice([None, rng.gauss(50, 9)]), rng.random() * 9) for i in range(300)]
    spark.createDataFrame(rows, "run_id long, workload string, target string, run_date string, ops_per_sec double, p99_ms double").write.parquet(f"{tmp_path}/bench_runs.parquet")
    at = lambda df: {(r.field, r.workload, r.target, r.q): r for r in df.where("q < 0.95").collect()}
    # a group of a null target and the group of all targets look alike, so that targets are named here
    named = f"{tmp_path}/named"
    spark.read.parquet(f"{tmp_path}/bench_runs.parquet").fillna("none", ["target"]).write.parquet(f"{named}/bench_runs.parquet")
    got, want = at(problems.p5_combined(spark, named)), at(problems.p5_percentiles(spark, named))
    assert set(got) == set(want) and len(got) == 2 * 2 * (2 + 6)
    for k, r in got.items():
        assert r.n == want[k].n and r.low - 1e-6 <= want[k].value <= r.high + 1e-6
    assert problems.p5_combined(spark, str(tmp_path)).count() == 2 * 2 * (2 + 6)


def test_percentiles(spark):
    rng = random.Random(8)
    pool = [0.0, -0.0, 1.5, -3.25, float("inf"), float("-inf"), float("nan"), 1e-300, 1e300, None]
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.choice(pool), rng.gauss(0, 100), 7.0])) for _ in range(500)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("q", F.lit(1)).withColumn("n", F.lit(1))
    at = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    for bits in (16, 32):
        got = {(r.k, r.q): r for r in percentiles.percentiles(df, ["k"], "v", at, digit_bits=bits).collect()}
        by = defaultdict(list)
        for k, v in rows:
            if v is not None:
                by[k].append(v)
        assert set(got) == {(k, q) for k in by for q in at}
        for (k, q), r in got.items():
            want = rank_of(by[k], q)
            assert r.n == len(by[k]) and (r.value == want or (r.value != r.value and want != want)), (k, q, r.value, want)
    parts = [percentiles.digit_histogram(df.where(F.coalesce(F.col("v"), F.lit(0)) > 5), ["k"], "v"), percentiles.digit_histogram(df.where(~(F.coalesce(F.col("v"), F.lit(0)) > 5)), ["k"], "v")]
    for r in percentiles.histogram_percentiles(percentiles.merge_histograms(parts, ["k"]), ["k"], at).collect():
        want = rank_of(by[r.k], r.q)
        assert want != want or r.low <= want <= r.high
        if want == want and math.isfinite(want) and want:
            assert abs(r.high - r.low) <= abs(want) * 2.0**-11
    assert percentiles.percentiles(df.limit(0), ["k"], "v", at).count() == 0


def test_key_profile(spark):
    rng = random.Random(9)
    t = dt.datetime(2031, 1, 1)
    rows = []
    for i in range(2000):
        db = rng.choice(["hot"] * 8 + ["cold", None])
        v = rng.choice([None, rng.randrange(-(10**15), 10**15), rng.randrange(10), 5])
        rows.append((i, db, rng.choice(["c", None, "c"]), rng.choice([True, False, None]), rng.choice([None, t + dt.timedelta(seconds=i)]), v))
    df = spark.createDataFrame(rows + rows[:300], "event_id long, db string, coll string, ok boolean, ts timestamp, v long").withColumn("n", F.lit("clash"))
    got = {(r.db, r.coll): r for r in hotkeys.key_profile(df, ["db", "coll"], "event_id", "ok", "ts", F.col("v"), (0.0, 0.5, 0.9)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[(r[1], r[2])].append(r)
    both = sum(len(v) for k, v in by.items() if None not in k)
    assert set(got) == set(by)
    for k, items in by.items():
        r, vs = got[k], sorted(x[5] for x in items if x[5] is not None)
        assert (r.n, r.failed, r["values"]) == (len(items), sum(x[3] is False for x in items), len(vs))
        assert (r.share is None) == (None in k) and (r.share is None or math.isclose(r.share, len(items) / both))
        for q, name in ((0.0, "value_q0"), (0.5, "value_q50"), (0.9, "value_q90")):
            assert r[name] == rank_of(vs, q)
    assert hotkeys.key_profile(df.limit(0), ["db", "coll"], "event_id", "ok", "ts", F.col("v")).count() == 0


# ---- snapshots -----------------------------------------------------------------------------------------------------


def test_snapshot_changes(spark):
    e = lambda *xs: [(n, None, s, None) for n, s in xs]
    rows = [
        (1, "2031-01-01T00:00:00Z", "s", e(("A ", "pass"), ("b", None), ("c", "fail"), ("a", "PASS"))),
        (5, "2031-01-01T09:00:00+09:00", "s", None),
        (2, "2031-01-02T01:00:00+02:00", "s", e(("a", " Pass"), ("b", "fail"), (None, "x"))),
        (2, "2031-01-02T01:00:00+02:00", "s", e(("a", " Pass"), ("b", "fail"), (None, "x"))),
        (4, "2031-01-01T23:30:00Z", "s", []),
        (3, "2031-01-03T00:00:00.000Z", "s", e(("a", "pass"), ("c", "fail"))),
        (7, "nonsense", "s", e(("z", "pass"))),
        (8, "2031-01-01T00:00:00Z", None, e(("z", "pass"))),
        (9, "2031-01-01T00:00:00Z", "only", e(("z", "pass"))),
    ]
    df = spark.createDataFrame(rows, "report_id long, generated_at string, server string, results array<struct<name string, category string, status string, note string>>").withColumn("change", F.lit(1))
    run = lambda d: snapshots.snapshot_changes(d, "server", "report_id", snapshots.instant(F.col("generated_at")), "results", snapshots.tidy(F.col("_e.name")), [snapshots.tidy(F.col("_e.status"))])
    assert sorted((r.report_id, r.name, r.change) for r in run(df).collect()) == sorted(
        [(2, "b", "changed"), (2, "c", "removed"), (4, "a", "removed"), (4, "b", "removed"), (3, "a", "added"), (3, "c", "added")]
    )
    assert run(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [100_000, 3])
def test_any_number_of_event_types(spark, monkeypatch, few):
    """The index table is broadcast or joined; the vectors are the same, and one column per type alone is bounded."""
    monkeypatch.setattr(features, "FEW", few)
    rng = random.Random(6)
    rows = [(rng.choice(["u", "u", "v", None]), rng.choice([f"t{rng.randrange(40)}", None]), dt.datetime(2031, 1, 1, 0, 0, rng.randrange(60)), rng.choice([True, False, None]), i) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:90], "who string, what string, ts timestamp, ok boolean, id int")
    names = sorted({r[1] for r in rows} - {None})
    got = {(r.who, names[r.idx]): (r.cnt, r.tot) for r in features.explode_features(features.sparse_features(df, "who", "what", "ts", "ok", "id"), "who").collect()}
    want = defaultdict(lambda: (0, 0))
    for who, what, _, ok, _ in rows:
        if who and what:
            want[who, what] = (want[who, what][0] + 1, want[who, what][1] + bool(ok))
    assert got == dict(want)
    with pytest.raises(ValueError, match="event types"):
        features.type_dictionary(df, "what", 5)


def test_rolling_fills_decades_in_slices(spark):
    df = spark.createDataFrame([("a", dt.date(1990, 1, 1), 1.0), ("a", dt.date(2031, 1, 1), 2.0), ("b", dt.date(2031, 1, 1), 3.0)], "k string, d date, v double")
    got = rolling.rolling_totals(df, ["k"], "d", "v", (7,)).groupBy("k").agg(F.count("*").alias("n"), F.sum("total_7").alias("s")).collect()
    assert {(r.k, r.n, r.s) for r in got} == {("a", (dt.date(2031, 1, 1) - dt.date(1990, 1, 1)).days + 1, 9.0), ("b", 1, 3.0)}
