"""Every query with SQL gives what an independent engine gives on the same tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans import catalog, catalog_extraction, catalog_operators

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalog.QUERIES | catalog_operators.QUERIES | catalog_extraction.QUERIES
SQL = catalog.ORACLE_SQL | catalog_operators.ORACLE_SQL | catalog_extraction.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["position", "stock_code", "stock_abbr", "company_name", "report_year", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranking_plan(spark):
    """Top-n is taken without a full sort, and years reach the scan's side of the aggregation."""
    plan = QUERIES["q13_ranking_base_desc"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_discount:double,l_shipdate:timestamp>" in plan or "l_returnflag" not in plan.split("ReadSchema")[1]
