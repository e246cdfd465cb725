import pytest
from pyspark.sql import functions as F

from ledgerline.operators.marts import build
from ledgerline.plans import templates as t
from ledgerline.plans.compile import ResultContract, compile_spec, latest_year
from ledgerline.plans.dag import Task, order_tasks, run_tasks
from ledgerline.plans.guard import UnsafeQuery, explain, read_only, review
from ledgerline.plans.spec import Filter, QuerySpec, SpecError, recent_years, route, stages, validate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    return build(spark, SF)


def spec(operation, **kw):
    return QuerySpec(operation, **({"metrics": ("net_profit",), "year": 1998} | kw))


@pytest.mark.parametrize(
    "s,code",
    [
        (spec("nothing"), "unsupported_operation"),
        (spec("point"), "missing_company"),
        (spec("point", companies=("1", "2")), "too_many_companies"),
        (spec("compare", companies=("1", "1")), "too_few_companies"),
        (spec("ranking", year=None), "missing_year"),
        (spec("ranking", metrics=()), "missing_metric"),
        (spec("ranking", metrics=("x",)), "unknown_metric"),
        (spec("ranking", metrics=("net_profit", "roe")), "one_metric_needed"),
        (spec("ranking", limit=51), "invalid_limit"),
        (spec("ranking", limit=0), "invalid_limit"),
        (spec("ranking", direction="up"), "invalid_direction"),
        (spec("ranking", period="M1"), "invalid_period"),
        (spec("ranking", input="a"), "UNSUPPORTED_FLEXIBLE_SQL"),
        (spec("yoy_ranking", metrics=("roe",)), "unsupported_metric"),
        (spec("growth_ranking"), "missing_year_range"),
        (spec("trend", companies=("1",), start_year=2000, end_year=1999), "invalid_year_range"),
        (spec("metric_filter"), "missing_filter"),
        (spec("metric_filter", filters=(Filter("roe", "~", 1),)), "invalid_operator"),
        (spec("company_set_yoy"), "missing_input"),
    ],
)
def test_validation(s, code):
    with pytest.raises(SpecError) as e:
        validate(s)
    assert e.value.code == code


def test_half_year_has_two_names():
    assert validate(spec("ranking", period="H1")).period == validate(spec("ranking", period="HY")).period == "HY"


def test_routes():
    assert route({"operation": "ranking", "metrics": ["roe"], "time_scope": {"year": 1998}}) == "deterministic"
    assert route({"operation": "metric_filter", "filters": [{"metric": "roe", "operator": ">", "value": 5}], "time_scope": {"year": 1998}}) == "flexible"
    assert route({"operation": "ranking", "metrics": ["roe"]}) == "clarification"
    assert route({"operation": "dance"}) == "unsupported"
    assert route(spec("company_set_yoy", input="a")) == "composite"
    assert recent_years(2024, 4) == [2021, 2022, 2023, 2024]
    with pytest.raises(SpecError):
        stages([{"operation": "ranking"}, {"operation": "ranking", "input": "first"}])


@pytest.mark.parametrize(
    "s",
    [
        spec("point", companies=("000003",)), spec("point", companies=("000003",), metrics=("roa", "roe")), spec("trend", companies=("000003",), start_year=1995, end_year=1999),
        spec("trend", companies=("000003",), metrics=("roa",), start_year=1995, end_year=1999), spec("yoy", companies=("000003",)), spec("yoy", companies=("000003",), metrics=("roa",)),
        spec("compare", companies=("000003", "000007")), spec("compare", companies=("000003", "000007"), metrics=("roa",)), spec("compare_trend", companies=("000003", "000007"), start_year=1995, end_year=1999),
        spec("compare_yoy", companies=("000003", "000007")), spec("ranking", metrics=("roa",)), spec("yoy_ranking"), spec("growth_ranking", start_year=1996, end_year=1999), spec("rank_position", companies=("000003",)),
        spec("metric_filter", filters=(Filter("net_profit_margin", ">", -90), Filter("net_profit", "<", 1e12))), spec("multi_metric_yoy_filter", filters=(Filter("net_profit", ">", -5000),), order=(("net_profit", "desc"),)),
        spec("set_intersection", limit=5),
    ],
)
def test_every_operation_compiles_and_runs(m, s):
    df = compile_spec(m, s)
    df.collect()
    contract = ResultContract.of(df, s.limit)
    assert contract.columns and set(contract.keys) <= set(df.columns)


def test_compiled_equals_template(m):
    a, b = compile_spec(m, spec("ranking", limit=5)).collect(), t.ranking(m, "net_profit", 1998, "FY", n=5).collect()
    assert a == b


def test_latest_year(m):
    assert latest_year(m) == m.income_sheet.agg(F.max("report_year")).first()[0]


def test_tasks(m):
    top, moved, best = Task("top", spec("ranking", metrics=("total_operating_revenue",), limit=6)), Task("yoy", spec("company_set_yoy", input="top"), ("top",)), Task("best", needs=("yoy",), rerank=("yoy_rate", "desc", 3))
    done = run_tasks(m, [best, moved, top])
    rows = done["best"].collect()
    assert len(rows) <= 3 and {r.stock_code for r in rows} <= {r.stock_code for r in done["top"].collect()}


@pytest.mark.parametrize(
    "tasks,code",
    [
        ([Task("a"), Task("a")], "duplicate_task"),
        ([Task("a", needs=("b",))], "unknown_dependency"),
        ([Task("a", needs=("b",)), Task("b", needs=("a",))], "cycle"),
        ([Task("a"), Task("b", spec("company_set_yoy", input="z"), ("a",))], "artifact_mismatch"),
    ],
)
def test_task_errors(tasks, code):
    with pytest.raises(SpecError) as e:
        order_tasks(tasks)
    assert e.value.code == code


GOOD = "SELECT stock_code, net_profit, rank() OVER (ORDER BY net_profit DESC) AS r FROM income_sheet WHERE report_year = 1998 ORDER BY r LIMIT 10"


@pytest.fixture(scope="module")
def views(m):
    m.income_sheet.createOrReplaceTempView("income_sheet")
    m.dim.createOrReplaceTempView("company_dim")
    return {"income_sheet", "company_dim"}


def test_guard_takes_bounded_reads(spark, views):
    assert review(spark, GOOD, views).count() == 10
    both = "WITH top AS (SELECT stock_code FROM income_sheet ORDER BY net_profit DESC LIMIT 5) SELECT d.company_name FROM company_dim d JOIN top ON d.stock_code = top.stock_code LIMIT 5"
    assert review(spark, both, views).count() <= 5


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW income_sheet", "SELECT stock_code FROM income_sheet; SELECT 1", "SELECT * FROM income_sheet LIMIT 5", "SELECT stock_code FROM income_sheet", "SELECT stock_code FROM income_sheet LIMIT 51",
        "SELECT stock_code FROM elsewhere LIMIT 5", "SELECT nothing FROM income_sheet LIMIT 5", "SELECT reflect('java.lang.System', 'exit') FROM income_sheet LIMIT 5", "SELECT random() FROM income_sheet LIMIT 5",
        "SELEC x", "INSERT INTO income_sheet SELECT 1",
    ],
)
def test_guard_refuses(spark, views, sql):
    with pytest.raises(UnsafeQuery):
        review(spark, sql, views)


def test_read_only_caps_rows_outside_the_window(spark, views):
    columns, rows = read_only(spark, "SELECT stock_code, rank() OVER (ORDER BY net_profit) AS r, count(*) OVER () AS n FROM income_sheet", views, limit=3, timeout_s=60)
    assert columns == ["stock_code", "r", "n"] and len(rows) == 3 and rows[0][2] > 3


def test_explain(spark):
    assert "Range" in explain(spark.range(3))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,scans,exchanges",
    [("q02_derived_point", 8, 10), ("q05_yoy", 4, 7), ("q05_yoy_all_customers", 3, 5), ("q18_company_set_yoy", 6, 9), ("q22_yoy_multi_filter", 3, 5), ("q14_yoy_ranking", 2, 4), ("dq_funnel", 6, 14)],
)
def test_each_table_is_read_once(spark, name, scans, exchanges):
    """A mart is built once a query, whatever the number of metrics and years; its own joins are counted too."""
    from ledgerline.plans import catalog, catalog_operators

    plan = plan_of((catalog.QUERIES | catalog_operators.QUERIES)[name](spark, "/root/testdata/sf0.01"))
    assert plan.count("FileScan") <= scans and plan.count("Exchange") <= exchanges


@pytest.mark.parametrize("name", ["q05_yoy", "q13_ranking_base_desc", "q21_threshold_filter", "q09_compare_trend"])
def test_years_reach_the_scan(spark, name):
    from ledgerline.plans import catalog

    plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert "GreaterThanOrEqual(l_shipdate" in plan or "GreaterThanOrEqual(o_orderdate" in plan


def test_no_task_numbers_all_rows(spark):
    from ledgerline.plans import catalog

    plan = plan_of(catalog.QUERIES["q23_core_mart"](spark, "/root/testdata/sf0.01"))
    assert plan.count("Exchange SinglePartition") <= 1  # the counts by prefix


def test_all_conditions_come_before_the_limit(m):
    both = spec("metric_filter", filters=(Filter("net_profit", "<", 1e12), Filter("total_operating_revenue", ">", 0)), limit=1, direction="asc")
    assert compile_spec(m, both).count() == 1


def test_guard_reads_whole_names_and_every_function(spark, m):
    for name in ("dim", "income_sheet", "balance_sheet"):
        getattr(m, name).createOrReplaceTempView(name)
    spark.sql("CREATE DATABASE IF NOT EXISTS other")
    spark.sql("CREATE TABLE IF NOT EXISTS other.income_sheet (stock_code STRING) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS default.secret (stock_code STRING) USING parquet")
    allowed = {"income_sheet", "dim", "secret"}
    try:
        for sql in (
            "SELECT stock_code FROM other.income_sheet LIMIT 5",
            "SELECT stock_code FROM spark_catalog.other.income_sheet LIMIT 5",
            "SELECT stock_code FROM secret LIMIT 5",  # allowed by name, but no temporary view
            "SELECT stock_code FROM balance_sheet LIMIT 5",
            "SELECT stock_code FROM income_sheet WHERE stock_code IN (SELECT stock_code FROM other.income_sheet) LIMIT 5",
            "SELECT stock_code, (SELECT max(stock_code) FROM dim) AS x FROM income_sheet LIMIT 5",
            "WITH a AS (SELECT stock_code FROM balance_sheet) SELECT stock_code FROM a LIMIT 5",
            "WITH a AS (SELECT stock_code FROM b), b AS (SELECT stock_code FROM dim) SELECT stock_code FROM a LIMIT 5",
            "SELECT reflect('java.lang.System', 'exit') AS x FROM dim LIMIT 5",
            "SELECT stock_code FROM dim ORDER BY upper(stock_code) LIMIT 5",
        ):
            with pytest.raises(UnsafeQuery):
                review(spark, sql, allowed)
        review(spark, "WITH a AS (SELECT stock_code FROM dim), b AS (SELECT stock_code FROM a) SELECT stock_code FROM b LIMIT 5", allowed)
        review(spark, "SELECT stock_code, count(*) AS n FROM income_sheet GROUP BY stock_code LIMIT 5", allowed)
    finally:
        spark.sql("DROP TABLE IF EXISTS other.income_sheet")
        spark.sql("DROP TABLE IF EXISTS default.secret")
        spark.sql("DROP DATABASE IF EXISTS other")


def test_years_of_generated_sql(spark, m):
    from ledgerline.plans.guard import years_missing

    for name in ("dim", "income_sheet", "balance_sheet"):
        getattr(m, name).createOrReplaceTempView(name)
    assert years_missing(spark.sql("SELECT stock_code FROM income_sheet WHERE report_year = 1998 LIMIT 5")) == []
    assert years_missing(spark.sql("SELECT stock_code FROM income_sheet LIMIT 5")) == ["income_sheet"]
    assert years_missing(spark.sql("SELECT i.stock_code FROM income_sheet i JOIN balance_sheet b ON i.stock_code = b.stock_code WHERE i.report_period = 'FY' LIMIT 5")) == ["balance_sheet", "income_sheet"]
    assert years_missing(spark.sql("SELECT stock_code FROM dim LIMIT 5")) == []
