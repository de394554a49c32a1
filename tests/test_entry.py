"""Registered queries against their SQL on the smallest tables, where these are present."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    cur = sql.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(canonical(r[cols.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    got = sorted(repr(tuple(canonical(r[c]) for c in sorted(cols))) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", ["math_arithmetic_all", "math_rounding_all", "math_powers_all"])
def test_arithmetic_covers_every_line(spark, sql, name):
    want = sql.execute("SELECT l_linenumber, count(*) FROM lineitem GROUP BY 1").fetchall()
    got = entry.queries()[name](spark, DATA).groupBy("l_linenumber").count().collect()
    assert {tuple(r) for r in got} == set(want) and len(want) > 1


def test_set_operators_cover_accounts_without_tags(spark, sql):
    got = entry.queries()["set_ops_all"](spark, DATA).collect()
    bare = {i for (i,) in sql.execute("SELECT account_id FROM accounts WHERE tags IS NULL").fetchall()}
    assert len(got) == sql.execute("SELECT count(*) FROM accounts").fetchone()[0] and bare
    assert bare <= {r.account_id for r in got if tuple(r)[1:] == (False, None, 2, None, False, False, True)}


@pytest.mark.parametrize("n, key", [(0, "i"), (31, "NULL"), (60, "nullif(i % 7, 0)"), (40000, "i")])
def test_cursor_reads_suppliers_of_any_number(spark, tmp_path, n, key):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        os.symlink(f"{DATA}/{f}", tmp_path / f)
    os.remove(tmp_path / "supplier.parquet")
    c.execute(f"COPY (SELECT CAST({key} AS BIGINT) AS s_suppkey, 'x' AS s_name, 1 AS s_nationkey, 0.5 AS s_acctbal FROM range({n}) t(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = entry.queries()["cursor_batches"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == c.execute(entry.oracle_sql()["cursor_batches"]).fetchall()


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_text_package():
    import pathlib

    for p in (pathlib.Path(entry.__file__).parent / "tarn").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tarn.llm" not in p.read_text(), p
