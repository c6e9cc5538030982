"""Every registered query that has SQL is held against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from firnline.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    out = QUERIES[name](spark, DATA)
    assert out.count() > 0
    if name == "ops_integrity":
        assert out.where("NOT ok").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_key_filter_reaches_the_scan_and_a_mutable_one_does_not(spark):
    from firnline.queries import orders_table

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t = orders_table(spark, DATA)
    assert "EqualTo(o_orderkey,42)" in plan(t.scan([("o_orderkey", "=", 42)]))
    mutable = t.scan(where="o_orderstatus = 'F'", columns=["o_orderkey"])
    scans = [line for line in mutable._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line]
    assert scans
    assert t.report.deduplicated
