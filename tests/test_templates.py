"""Golden cases over a small hand-made set of statements."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import metrics
from ledgerline.operators.marts import Marts, core_performance
from ledgerline.plans import templates as t

FACT = "stock_code string, report_year int, report_period string"


@pytest.fixture(scope="module")
def m(spark):
    dim = spark.createDataFrame([("A", "alpha", "Alpha Ltd"), ("B", "beta", "Beta Ltd"), ("C", "gamma", "Gamma Ltd"), ("D", "delta", "Delta Ltd")], "stock_code string, stock_abbr string, company_name string")
    d = Decimal
    income = [
        ("A", 2022, "FY", d(100), d(10)), ("A", 2023, "FY", d(120), d(-5)), ("A", 2024, "FY", d(150), d(15)), ("B", 2022, "FY", d(80), d(8)), ("B", 2023, "FY", d(80), d(0)), ("B", 2024, "FY", None, d(4)),
        ("C", 2024, "FY", d(150), d(30)), ("C", 2022, "FY", d(0), d(1)), ("A", 2024, "HY", d(70), d(7)),
    ]
    balance = [("A", 2024, "FY", d(200), d(120), d(80)), ("B", 2024, "FY", d(50), None, d(50)), ("C", 2024, "FY", d(0), d(0), d(0)), ("A", 2023, "FY", d(180), d(100), d(80))]
    cash = [("A", 2024, "FY", d(20), d(-8), d(-4), d(8)), ("D", 2024, "FY", d(1), d(1), d(1), d(3))]
    return Marts(
        dim,
        spark.createDataFrame(income, f"{FACT}, total_operating_revenue decimal(20,2), net_profit decimal(20,2)"),
        spark.createDataFrame(balance, f"{FACT}, asset_total_assets decimal(20,2), liability_total_liabilities decimal(20,2), equity_total_equity decimal(20,2)"),
        spark.createDataFrame(cash, f"{FACT}, operating_cf_net_amount decimal(20,2), investing_cf_net_amount decimal(20,2), financing_cf_net_amount decimal(20,2), net_cash_flow decimal(20,2)"),
    )


def by_code(df, *cols):
    return {r.stock_code: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_point_keeps_the_company_without_records(m):
    rows = t.point(m, "D", 2024, "FY", ["net_profit", "asset_total_assets"]).collect()
    assert len(rows) == 1 and rows[0].report_year is None and rows[0].income_sheet__net_profit is None


def test_periods_are_apart(m):
    assert t.point(m, "A", 2024, "HY", ["net_profit"]).first().income_sheet__net_profit == 7


def test_derived_statuses(m):
    got = by_code(t.derived_points(m, None, [2024], "FY", "debt_to_asset_ratio"), "status", "value")
    assert got == {"A": ("ok", 60.0), "B": ("empty_numerator", None), "C": ("zero_denominator", None), "D": ("missing_record", None)}


def test_yoy_statuses(m):
    got = by_code(t.yoy(m, None, 2024, "FY", ["net_profit"]), "status", "change_abs", "yoy_rate")
    assert got == {"A": ("ok", 20.0, 4.0), "B": ("zero_previous_value", 4.0, None), "C": ("missing_previous_year", None, None), "D": ("missing_current_year", None, None)}
    assert by_code(t.yoy(m, ["B"], 2024, "FY", ["total_operating_revenue"]), "status") == {"B": "empty_current_value"}


def test_signed_and_absolute_growth(m):
    assert t.yoy_ranking(m, "net_profit", 2024, "FY").first().yoy_rate == -4.0
    assert t.yoy_ranking(m, "net_profit", 2024, "FY", signed=False).first().yoy_rate == 4.0


def test_derived_yoy(m):
    r = t.derived_yoy(m, ["A"], 2024, "FY", "debt_to_asset_ratio").first()
    assert (r.current_value, r.previous_value, r.change_abs, r.status) == (60.0, 55.56, 4.44, "ok")


def test_trend(m):
    rows = t.trend(m, "A", 2022, 2024, "FY", "net_profit").collect()
    assert {(r.direction, r.absolute_change, r.change_rate_pct) for r in rows} == {("up", 5.0, 50.0)}
    one = t.trend(m, "C", 2023, 2024, "FY", "net_profit").collect()
    assert {(r.report_year, r.status) for r in one} == {(2023, "missing_record"), (2024, "ok")} and {r.direction for r in one} == {"insufficient"}


def test_derived_trend_shape(m):
    rows = t.derived_trend(m, "A", 2022, 2024, "FY", "net_profit_margin").collect()
    assert {r.direction for r in rows} == {"fluctuating_flat"} and {r.change_pp for r in rows} == {0.0}


def test_compare_names_extremes_and_gaps(m):
    rows = t.compare(m, ["A", "B", "D"], 2024, "FY", ["net_profit"]).collect()
    assert {(r.metric_status, r.higher, r.lower, r.diff) for r in rows} == {("partial_compare_unavailable", "Alpha Ltd", "Beta Ltd", 11.0)}
    assert {r.metric_status for r in t.compare(m, ["D"], 2024, "FY", ["net_profit"]).collect()} == {"compare_unavailable"}


def test_compare_yoy_has_no_winner_unless_all_are_ok(m):
    assert {r.winner for r in t.compare_yoy(m, ["A", "B"], 2024, "FY", "net_profit").collect()} == {None}
    row = next(r for r in t.compare_yoy(m, ["A", "B"], 2024, "FY", "net_profit").collect() if r.stock_code == "A")
    assert row.warning == "negative_previous_value"


def test_ranking_ties_by_code_and_nulls_out(m):
    rows = t.ranking(m, "total_operating_revenue", 2024, "FY").collect()
    assert [(r.position, r.stock_code) for r in rows] == [(1, "A"), (2, "C")]
    assert t.rank_position(m, "C", "total_operating_revenue", 2024, "FY").first().rank_no == 1
    assert t.rank_position(m, "B", "net_profit", 2024, "FY").first().rank_no == 3


def test_rank_position_of_the_last_of_many(spark, m):
    n = 250
    dim = spark.range(1, n + 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.lit("x").alias("stock_abbr"), F.lit("x").alias("company_name"))
    income = spark.range(1, n + 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.lit(2024).alias("report_year"), F.lit("FY").alias("report_period"), (n - F.col("id") + 1).cast("double").alias("total_operating_revenue"))
    r = t.rank_position(Marts(dim, income, m.balance_sheet, m.cash_flow_sheet), "000250", "total_operating_revenue", 2024, "FY").first()
    assert (r.rank_no, r.total_count, r.percentile_bucket, r.position_zone) == (250, 250, 100, "bottom_10")


def test_thresholds(m):
    assert [r.stock_code for r in t.threshold_filter(m, "debt_to_asset_ratio", ">", 50, 2024, "FY").collect()] == ["A"]
    assert t.percent_threshold(0.5) == 0.5 and t.percent_threshold(-20) == -0.2
    assert [r.stock_code for r in t.yoy_filter(m, [("net_profit", ">", 100), ("total_operating_revenue", ">=", 25)], 2024, "FY").collect()] == ["A"]


def test_sets(m):
    top = t.ranking(m, "net_profit", 2024, "FY", n=2)
    assert by_code(t.company_set_yoy(m, top, 2024, "FY", ["net_profit"]), "status") == {"A": "ok", "C": "missing_previous_value"}
    assert [r.stock_code for r in t.ranking(m, "total_operating_revenue", 2024, "FY", "asc", within=top).collect()] == ["A", "C"]
    assert [r.stock_code for r in t.top_intersection(m, 2024, "FY", 2).collect()] == ["C", "A"]


def test_core_mart(m):
    files = m.income_sheet.sparkSession.createDataFrame([(7, 1, "A", 2024, "FY", "parsed"), (5, 1, "A", 2024, "FY", "failed"), (9, 2, "A", 2024, "FY", "parsed")], f"file_id long, company_id long, {FACT}, parse_status string")
    wide = Marts(m.dim, m.income_sheet.withColumn("operating_expense_cost_of_sales", F.lit(90).cast("decimal(20,2)")), m.balance_sheet, m.cash_flow_sheet)
    rows = core_performance(wide, files).collect()
    a = next(r for r in rows if (r.stock_code, r.report_year, r.report_period) == ("A", 2024, "FY"))
    assert (a.file_id, a.company_id, a.gross_profit_margin, a.operating_revenue_yoy_growth, a.net_profit_yoy_growth, a.eps) == (7, 1, 0.4, 25.0, 400.0, None)
    assert next(r for r in rows if (r.stock_code, r.report_year, r.report_period) == ("A", 2022, "FY")).operating_revenue_yoy_growth is None
    assert [r.serial_number for r in sorted(rows, key=lambda r: (r.stock_code, r.report_year, r.report_period))] == list(range(1, len(rows) + 1))
    assert {(r.stock_code, r.report_year): r.net_profit_margin for r in rows if r.report_period == "FY"}[("C", 2022)] is None
    assert any(r.stock_code == "D" and r.total_operating_revenue is None for r in rows)


def test_registry_is_sound():
    assert metrics.audit_registry() == []
    bad = {"x": metrics.Derived("roe", "nothing")}
    assert metrics.audit_registry(derived=metrics.DERIVED | bad) == [("x", "derived_operand:roe"), ("x", "unknown_operand:nothing")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(-3, 3), st.none() | st.integers(-3, 3)), min_size=1, max_size=8))
def test_guarded_ratio(spark, pairs):
    df = spark.createDataFrame(pairs, "n int, d int")
    status = metrics.ratio_status(F.lit(True), F.col("n"), F.col("d"))
    for (n, d), r in zip(pairs, df.select(metrics.fraction(F.col("n"), F.col("d")).alias("v"), status.alias("s")).collect()):
        assert (r.v is None) == (n is None or not d)
        assert r.s == ("empty_numerator" if n is None else "empty_denominator" if d is None else "zero_denominator" if d == 0 else "ok")
