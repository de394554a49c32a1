"""Queries of the general problems 1 to 7 over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import features, hotkeys, percentiles, rolling, sessions, snapshots, spikes
from tarn.sources import cut_lineage, read_table

SOURCE = ["workload", "target"]
READINGS = ["ops_per_sec", "p50_ms", "p99_ms"]


def bench_runs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Each run once with its calendar day; copies differ in ``recorded_at`` only."""
    raw = read_table(spark, d, "bench_runs")
    return raw.select("run_id", *SOURCE, rolling.calendar_day(F.col("run_date")).alias("day"), *cols).distinct()


def rolling_days(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(bench_runs(spark, d, "ops_per_sec"), SOURCE, "day", "ops_per_sec", (7, 30))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    days = rolling_days(spark, d)
    hit = (F.col("day_index") >= 29) & (F.col("total_7") / 7 < F.col("total_30") / 30 / 2)
    return days.where(hit).select(*SOURCE, F.date_format("day", "yyyy-MM-dd").alias("run_date"))


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 3).alias(c)
    return rolling_days(spark, d).select(
        *SOURCE, F.date_format("day", "yyyy-MM-dd").alias("run_date"), r("total_7"), r("avg_7"), r("total_30"), r("avg_30"), "readings_30", "min_30", "max_30"
    )


def event_features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    e = read_table(spark, d, "audit_events")
    types = features.type_dictionary(e, "action")
    return features.sparse_features(e, "user_name", "action", "ts", "ok", "event_id", types), types


def _named_cells(spark: SparkSession, d: str) -> DataFrame:
    f, types = event_features(spark, d)
    return features.explode_features(f, "user_name").withColumn("action", F.element_at(F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>"), F.col("idx") + 1))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _named_cells(spark, d).where((F.col("cnt") >= 3) & (F.col("tot") == 0)).select("user_name", "action")


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    return _named_cells(spark, d).select("user_name", "action", "cnt", F.col("tot").alias("ok_total"), "last_us")


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    f, types = event_features(spark, d)
    return features.expand_features(f, "user_name", types)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(read_table(spark, d, "audit_events"), ["user_name", "connid"], "ts", "event_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_name", "connid", "start_us", "end_us")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def _spikes(spark: SparkSession, d: str) -> DataFrame:
    return spikes.spikes(bench_runs(spark, d, *READINGS), SOURCE, "run_id", "day", READINGS, [("p50_ms", "p99_ms")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _spikes(spark, d).where("implausible").select("run_id")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return _spikes(spark, d).where("implausible")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles.percentiles(cut_lineage(bench_runs(spark, d, "p99_ms")), SOURCE, "p99_ms", (0.5, 0.9))
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return p.groupBy(*SOURCE).agg(at(0.5).alias("mid"), at(0.9).alias("high")).where(F.col("high") >= 2 * F.col("mid")).select(*SOURCE)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Both fields, per workload and per source, in one selection over (field, grouping) cells."""
    runs = cut_lineage(bench_runs(spark, d, "ops_per_sec", "p99_ms"))
    each = [
        F.struct(F.lit(field).alias("field"), F.lit(by_target).alias("by_target"), (F.col("target") if by_target else F.lit(None).cast("string")).alias("target"), F.col(field).alias("reading"))
        for field in ("ops_per_sec", "p99_ms")
        for by_target in (False, True)
    ]
    rows = runs.select("workload", F.inline(F.array(*each)))
    return percentiles.percentiles(rows, ["field", "by_target", "workload", "target"], "reading", (0.5, 0.9, 0.99)).drop("by_target")


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the percentiles of both fields from histograms of separate days, combined per source and then per workload.

    Runs without day are with the even days.
    """
    runs = cut_lineage(bench_runs(spark, d, "ops_per_sec", "p99_ms"))
    odd = F.coalesce(F.pmod(F.unix_date("day"), F.lit(2)), F.lit(0))
    out = None
    for field in ("ops_per_sec", "p99_ms"):
        parts = [percentiles.digit_histogram(runs.where(odd == i), SOURCE, field) for i in (0, 1)]
        per_source = cut_lineage(percentiles.merge_histograms(parts, SOURCE))
        for keys, whole in ((["workload"], percentiles.merge_histograms([per_source], ["workload"])), (SOURCE, per_source)):
            one = percentiles.histogram_percentiles(whole, keys, (0.5, 0.9)).select(
                F.lit(field).alias("field"),
                "workload",
                (F.col("target") if "target" in keys else F.lit(None).cast("string")).alias("target"),
                "q",
                "n",
                F.round("low", 6).alias("low"),
                F.round("high", 6).alias("high"),
            )
            out = one if out is None else out.unionByName(one)
    return out


def _profile(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "audit_events")
    took = F.regexp_extract("details", r'"durMs"\s*:\s*(-?\d{1,18})', 1).try_cast("long")
    return hotkeys.key_profile(e, ["db", "collection"], "event_id", "ok", "ts", took, (0.5, 0.9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(read_table(spark, d, "audit_events"), ["db", "collection"], "event_id", 0.02).select("db", "collection")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).drop("share")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    reports = read_table(spark, d, "compat_reports")
    found = snapshots.snapshot_changes(
        reports,
        "server_uri",
        "report_id",
        snapshots.instant(F.col("generated_at")),
        "results",
        snapshots.tidy(F.col("_e.name")),
        [snapshots.tidy(F.col("_e.status"))],
    )
    return found.select("report_id", "name", "change")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_rolling, p2_found, p2_cells, p2_features, p3_found, p3_sessions, p4_found, p4_flags,
        p5_found, p5_percentiles, p5_combined, p6_found, p6_profile, p7_found,
    )
}

_DAY = "try_cast(regexp_replace(run_date, '^\\s*(\\d{4})[-/. ]?(\\d{2})[-/. ]?(\\d{2}).*$', '\\1-\\2-\\3') AS DATE)"
_RUNS = f"runs AS (SELECT DISTINCT run_id, workload, target, {_DAY} AS day, ops_per_sec, p50_ms, p99_ms FROM bench_runs)"
_ROLL = f"""WITH {_RUNS},
per_day AS (SELECT workload, target, day, coalesce(sum(ops_per_sec), 0) AS s, count(ops_per_sec) AS n, min(ops_per_sec) AS lo, max(ops_per_sec) AS hi
  FROM runs WHERE day IS NOT NULL GROUP BY ALL),
spans AS (SELECT workload, target, min(day) AS first_day, max(day) AS last_day FROM per_day GROUP BY ALL),
calendar AS (SELECT workload, target, first_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
filled AS (SELECT c.workload, c.target, c.day, c.day - c.first_day AS day_index, coalesce(p.s, 0) AS s, coalesce(p.n, 0) AS n, p.lo, p.hi
  FROM calendar c LEFT JOIN per_day p ON c.workload IS NOT DISTINCT FROM p.workload AND c.target IS NOT DISTINCT FROM p.target AND c.day = p.day),
rolled AS (SELECT workload, target, day, day_index, sum(s) OVER w7 AS total_7, sum(s) OVER w30 AS total_30, sum(n) OVER w30 AS readings_30,
    min(lo) OVER w30 AS min_30, max(hi) OVER w30 AS max_30
  FROM filled WINDOW w7 AS (PARTITION BY workload, target ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY workload, target ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
_CELLS = """WITH e AS (SELECT DISTINCT event_id, user_name, action, ts, ok FROM audit_events WHERE user_name IS NOT NULL AND action IS NOT NULL),
cells AS (SELECT user_name, action, count(*) AS cnt, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok_total, max(epoch_us(ts)) AS last_us FROM e GROUP BY ALL)
"""
_SESS = """WITH e AS (SELECT DISTINCT event_id, user_name, connid, epoch_us(ts) AS us FROM audit_events WHERE user_name IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_name, connid ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_name, connid ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
s AS (SELECT user_name, connid, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM g GROUP BY user_name, connid, g.g)
"""
_PCT = ", ".join(
    f"""{n} AS (SELECT '{field}' AS field, workload, {t} AS target, u.q AS q, count({field}) AS n,
  list_sort(list({field}) FILTER (WHERE {field} IS NOT NULL))[CAST(greatest(1, ceil(round(u.q * count({field}), 6))) AS BIGINT)] AS value
  FROM runs, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q) u GROUP BY {g}, u.q HAVING count({field}) > 0)"""
    for n, field, t, g in (
        ("a", "ops_per_sec", "CAST(NULL AS VARCHAR)", "workload"),
        ("b", "ops_per_sec", "target", "workload, target"),
        ("c", "p99_ms", "CAST(NULL AS VARCHAR)", "workload"),
        ("d", "p99_ms", "target", "workload, target"),
    )
)
_KEYED = r"""WITH e AS (SELECT DISTINCT event_id, db, collection, ok, epoch_us(ts) AS us,
    try_cast(nullif(regexp_extract(details, '"durMs"\s*:\s*(-?\d{1,18})', 1), '') AS BIGINT) AS v FROM audit_events),
k AS (SELECT db, collection, count(*) AS n, CAST(count(*) FILTER (WHERE ok = false) AS BIGINT) AS failed, max(us) AS last_us, count(v) AS "values",
    list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS vs FROM e GROUP BY db, collection)
"""

ORACLE: dict[str, str] = {
    "p1_found": _ROLL + "SELECT workload, target, strftime(day, '%Y-%m-%d') AS run_date FROM rolled WHERE day_index >= 29 AND total_7 / 7 < total_30 / 30 / 2",
    "p1_rolling": _ROLL
    + """SELECT workload, target, strftime(day, '%Y-%m-%d') AS run_date, round(total_7, 3) AS total_7, round(total_7 / 7, 3) AS avg_7,
round(total_30, 3) AS total_30, round(total_30 / 30, 3) AS avg_30, CAST(readings_30 AS BIGINT) AS readings_30, min_30, max_30 FROM rolled""",
    "p2_found": _CELLS + "SELECT user_name, action FROM cells WHERE cnt >= 3 AND ok_total = 0",
    "p2_cells": _CELLS + "SELECT * FROM cells",
    "p3_found": _SESS + "SELECT user_name, connid, start_us, end_us FROM s",
    "p3_sessions": _SESS + "SELECT user_name, connid, start_us, end_us, end_us - start_us AS duration_us, events FROM s",
    "p5_found": f"WITH {_RUNS}, {_PCT}, w AS (SELECT workload, target, max(value) FILTER (WHERE q = 0.5) AS mid, max(value) FILTER (WHERE q = 0.9) AS high FROM d GROUP BY ALL) SELECT workload, target FROM w WHERE high >= 2 * mid",
    "p5_percentiles": f"WITH {_RUNS}, {_PCT} SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d",
    "p6_found": _KEYED + "SELECT db, collection FROM k WHERE db IS NOT NULL AND collection IS NOT NULL AND n >= 0.02 * (SELECT sum(n) FROM k WHERE db IS NOT NULL AND collection IS NOT NULL)",
    "p6_profile": _KEYED
    + """SELECT db, collection, n, failed, last_us, "values", vs[CAST(greatest(1, ceil(round(0.5 * len(vs), 6))) AS BIGINT)] AS value_q50,
vs[CAST(greatest(1, ceil(round(0.9 * len(vs), 6))) AS BIGINT)] AS value_q90 FROM k""",
    "p7_found": r"""WITH given AS (SELECT DISTINCT report_id, server_uri, CAST(generated_at AS TIMESTAMPTZ) AS instant, results FROM compat_reports WHERE results IS NOT NULL),
heads AS (SELECT report_id, server_uri, results, row_number() OVER (PARTITION BY server_uri ORDER BY instant, report_id) AS i FROM given),
cells AS (SELECT DISTINCT server_uri, i, lower(trim(r.name)) AS name, lower(trim(r.status)) AS status FROM (SELECT server_uri, i, unnest(results) AS r FROM heads)),
later AS (SELECT h.report_id, h.i, h.server_uri FROM heads h WHERE h.i > 1)
SELECT l.report_id, c.name, CASE WHEN p.name IS NULL THEN 'added' ELSE 'changed' END AS change
FROM later l JOIN cells c ON c.server_uri = l.server_uri AND c.i = l.i LEFT JOIN cells p ON p.server_uri = l.server_uri AND p.i = l.i - 1 AND p.name = c.name
WHERE p.name IS NULL OR p.status IS DISTINCT FROM c.status
UNION ALL SELECT l.report_id, p.name, 'removed' FROM later l JOIN cells p ON p.server_uri = l.server_uri AND p.i = l.i - 1
LEFT JOIN cells c ON c.server_uri = l.server_uri AND c.i = l.i AND c.name = p.name WHERE c.name IS NULL""",
}
