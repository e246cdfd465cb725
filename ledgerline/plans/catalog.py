"""Queries of the template catalogue over the marts of the order tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.metrics import BASE, DERIVED
from ledgerline.operators.marts import UNFILLED, build, core_performance, report_files
from ledgerline.plans import oracle as o
from ledgerline.plans import templates as t

Query = Callable[[SparkSession, str], DataFrame]
CODE, CODES, YEAR, START, END = "000003", ["000003", "000007", "000015"], 1998, 1995, 2000
REV, PROFIT, ASSETS, DEBT = "total_operating_revenue", "net_profit", "asset_total_assets", "liability_total_liabilities"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def on(make: Callable[..., DataFrame], *args, grain: str = "nation") -> Query:
    return lambda spark, sf_dir: make(build(spark, sf_dir, grain), *args)


def tf(key: str) -> tuple[str, str]:
    return BASE[key].table, BASE[key].field


def operands(key: str) -> tuple[tuple[str, str], tuple[str, str], int]:
    d = DERIVED[key]
    return tf(d.numerator), tf(d.denominator), d.scale


IN = f"stock_code IN ({o.codes(CODES)})"
ONE = f"stock_code = '{CODE}'"

add("q01_point", on(t.point, CODE, YEAR, "FY", [PROFIT, ASSETS]), o.point(CODE, YEAR, tf(PROFIT), tf(ASSETS)))
_dp = [o.derived_points(ONE, [YEAR], k, *operands(k), with_=True).replace("pts AS", f"p{i} AS") for i, k in enumerate(DERIVED)]
add(
    "q02_derived_point",
    on(t.derived_point, CODE, YEAR, "FY", list(DERIVED)),
    f"{o.marts()}, {', '.join(_dp)} " + " UNION ALL ".join(f"SELECT stock_code, metric, report_year, numerator, denominator, value, status FROM p{i}" for i in range(len(DERIVED))),
)
add(
    "q02_derived_point_all_customers",
    on(t.derived_points, None, [1997, 1998], "FY", "debt_to_asset_ratio", grain="customer"),
    o.derived_points("TRUE", [1997, 1998], "debt_to_asset_ratio", *operands("debt_to_asset_ratio"), grain="customer"),
)
add("q03_trend", on(t.trend, CODE, START, END, "FY", PROFIT), o.trend(CODE, START, END, *tf(PROFIT)))
add("q04_derived_trend", on(t.derived_trend, CODE, START, END, "FY", "roa"), o.derived_trend(CODE, START, END, *operands("roa")))
_cols = "SELECT stock_code, metric, current_value, previous_value, change_abs, yoy_rate, status FROM "
add("q05_yoy", on(t.yoy, [CODE], YEAR, "FY", [REV, PROFIT]), f"{o.marts()} {_cols} ({o.yoy_rows(ONE, YEAR, [(REV, 'income_sheet'), (PROFIT, 'income_sheet')])})")
add(
    "q05_yoy_all_customers",
    on(t.yoy, None, YEAR, "FY", [DEBT, "asset_inventory"], grain="customer"),
    f"{o.marts('customer')} {_cols} ({o.yoy_rows('TRUE', YEAR, [(DEBT, 'balance_sheet'), ('asset_inventory', 'balance_sheet')])})",
)
add("q06_derived_yoy", on(t.derived_yoy, [CODE], YEAR, "FY", "roe"), f"{o.marts()} {o.derived_yoy_rows(ONE, YEAR, 'roe', *operands('roe'))}")
add(
    "q06_derived_yoy_all_customers",
    on(t.derived_yoy, None, YEAR, "FY", "debt_to_asset_ratio", grain="customer"),
    f"{o.marts('customer')} {o.derived_yoy_rows('TRUE', YEAR, 'debt_to_asset_ratio', *operands('debt_to_asset_ratio'))}",
)
_cmp = " UNION ALL ".join(
    f"SELECT c.stock_code, company_name, '{k}' AS metric, {BASE[k].field} AS value, CASE WHEN a.stock_code IS NULL THEN 'missing_record' WHEN {BASE[k].field} IS NULL THEN 'empty_value' ELSE 'ok' END AS status "
    f"FROM company_dim c LEFT JOIN {BASE[k].table} a ON a.stock_code = c.stock_code AND a.report_year = {YEAR} WHERE c.{IN}"
    for k in (REV, ASSETS)
)
add("q07_compare", on(t.compare, CODES, YEAR, "FY", [REV, ASSETS]), o.extremes(f"{o.marts()}, r AS ({_cmp})", "compare"))
add(
    "q08_derived_compare",
    on(t.derived_compare, CODES, YEAR, "FY", ["roa"]),
    o.extremes(f"{o.marts()}, {o.derived_points(IN, [YEAR], 'roa', *operands('roa'), with_=True)}, r AS (SELECT stock_code, company_name, metric, value, status FROM pts)", "compare"),
)
YEARS = list(range(START, END + 1))
add(
    "q09_compare_trend",
    on(t.compare_trend, CODES, YEARS, "FY", REV),
    f"""{o.marts()}, pts AS (SELECT c.stock_code, company_name, y.report_year, a.{REV} AS value, CASE WHEN a.stock_code IS NULL THEN 'missing_record' WHEN a.{REV} IS NULL THEN 'empty_value' ELSE 'ok' END AS status
    FROM company_dim c CROSS JOIN {o.years(YEARS)} y LEFT JOIN income_sheet a ON a.stock_code = c.stock_code AND a.report_year = y.report_year WHERE c.{IN}) {o.summary('pts', 'stock_code, company_name')}""",
)
add(
    "q10_derived_compare_trend",
    on(t.derived_compare_trend, CODES, YEARS, "FY", "net_profit_margin"),
    f"{o.marts()}, {o.derived_points(IN, YEARS, 'net_profit_margin', *operands('net_profit_margin'), with_=True)} {o.summary('pts', 'stock_code, company_name', rate=False)}",
)


def _compare_yoy_sql() -> str:
    rows = o.yoy_rows(IN, YEAR, [(PROFIT, "income_sheet")], company=True)
    full = "bool_and(status = 'ok') AND count(*) >= 2"
    return f"""{o.marts()}, r AS ({rows}), s AS (SELECT metric,
      CASE WHEN NOT bool_or(status = 'ok') THEN 'compare_yoy_unavailable' WHEN NOT bool_and(status = 'ok') THEN 'partial_compare_yoy_unavailable' ELSE 'ok' END AS metric_status,
      CASE WHEN {full} THEN first(company_name ORDER BY yoy_rate DESC, stock_code) END AS winner, CASE WHEN {full} THEN first(company_name ORDER BY yoy_rate, stock_code) END AS loser,
      CASE WHEN {full} THEN first(company_name ORDER BY abs(change_abs) DESC, stock_code) END AS larger_change, CASE WHEN {full} THEN round(max(yoy_rate) - min(yoy_rate), 4) END AS diff_yoy_rate
      FROM r GROUP BY metric) SELECT metric, stock_code, current_value, previous_value, change_abs, yoy_rate, status, company_name, CASE WHEN status = 'ok' AND previous_value < 0 THEN 'negative_previous_value' END AS warning,
      metric_status, winner, loser, larger_change, diff_yoy_rate FROM r JOIN s USING (metric)"""


add("q11_compare_yoy", on(t.compare_yoy, CODES, YEAR, "FY", PROFIT), _compare_yoy_sql())
add(
    "q12_derived_compare_yoy",
    on(t.derived_compare_yoy, CODES, YEAR, "FY", "roa"),
    f"""{o.marts()}, r AS ({o.derived_yoy_rows(IN, YEAR, 'roa', *operands('roa'))}), s AS (SELECT metric,
      CASE WHEN NOT bool_or(status = 'ok') THEN 'compare_yoy_unavailable' WHEN NOT bool_and(status = 'ok') THEN 'partial_compare_yoy_unavailable' ELSE 'ok' END AS metric_status,
      CASE WHEN bool_and(status = 'ok') AND count(*) >= 2 THEN first(company_name ORDER BY change_abs DESC, stock_code) END AS winner FROM r GROUP BY metric) SELECT * FROM r JOIN s USING (metric)""",
)
for _dir in ("desc", "asc"):
    add(f"q13_ranking_base_{_dir}", on(t.ranking, REV, YEAR, "FY", _dir), o.ranking(REV, YEAR, tf(REV), direction=_dir))
    for _kind, _key in (("same", "net_profit_margin"), ("cross", "roa")):
        _n, _d, _ = operands(_key)
        add(f"q13_ranking_derived_{_kind}_{_dir}", on(t.ranking, _key, YEAR, "FY", _dir), o.ranking(_key, YEAR, _n, _d, _dir))
add("q13_ranking_suppliers", on(t.ranking, PROFIT, YEAR, "FY", "desc", 50, grain="supplier"), o.ranking(PROFIT, YEAR, tf(PROFIT), limit=50, grain="supplier"))


def _growth_sql(key: str, a: int, b: int, rate: str, name: str, first: str, last: str, grain: str) -> str:
    return f"""{o.marts(grain)}, g AS (SELECT c.stock_code, stock_abbr, company_name, start_value, end_value, round({rate}, 8) AS {name} FROM company_dim c JOIN {o.pairs(*tf(key), a, b)} p ON p.stock_code = c.stock_code)
    SELECT row_number() OVER (ORDER BY {name} DESC, stock_code) AS position, stock_code, stock_abbr, company_name, start_value AS {first}, end_value AS {last}, {name} FROM g ORDER BY {name} DESC, stock_code LIMIT 10"""


_signed = f"({o.dbl('end_value')} - {o.dbl('start_value')}) / {o.dbl('start_value')}"
add("q14_yoy_ranking", on(t.yoy_ranking, PROFIT, YEAR, "FY", grain="supplier"), _growth_sql(PROFIT, YEAR - 1, YEAR, _signed, "yoy_rate", "previous_value", "current_value", "supplier"))
_abs = f"round({o.dbl('end_value')} - {o.dbl('start_value')}, 2) / abs({o.dbl('start_value')})"
add(
    "q14_yoy_ranking_abs",
    on(t.yoy_ranking, PROFIT, YEAR, "FY", "desc", 10, False, grain="supplier"),
    _growth_sql(PROFIT, YEAR - 1, YEAR, f"round({_abs}, 4)", "yoy_rate", "previous_value", "current_value", "supplier"),
)
add("q15_growth_ranking", on(t.growth_ranking, REV, 1996, 2000, "FY"), _growth_sql(REV, 1996, 2000, _signed, "growth_rate", "start_value", "end_value", "nation"))


def _position_sql(key: str, n, d, code: str, grain: str) -> str:
    return f"""{o.marts(grain)}, {o.measured(key, YEAR, n, d)}, k AS (SELECT *, rank() OVER (ORDER BY value DESC) AS rank_no, count(*) OVER () AS total_count FROM mv)
    SELECT stock_code, stock_abbr, company_name, report_year, {o.dbl('value')} AS value, rank_no, total_count,
      greatest(10, CAST(floor((rank_no * 1.0 / total_count * 100 + 9.9999) / 10) * 10 AS INTEGER)) AS percentile_bucket,
      CASE WHEN rank_no * 1.0 / total_count * 100 <= 10 THEN 'top_10' WHEN rank_no * 1.0 / total_count * 100 <= 25 THEN 'top_25' WHEN rank_no * 1.0 / total_count * 100 >= 90 THEN 'bottom_10'
           WHEN rank_no * 1.0 / total_count * 100 >= 75 THEN 'bottom_25' ELSE 'middle' END AS position_zone FROM k WHERE stock_code = '{code}'""".replace("rank_no * 1.0", "CAST(rank_no AS DOUBLE)")


add("q16_rank_position_base", on(t.rank_position, CODE, REV, YEAR, "FY"), _position_sql(REV, tf(REV), None, CODE, "nation"))
add("q16_rank_position_derived", on(t.rank_position, CODE, "roa", YEAR, "FY"), _position_sql("roa", *operands("roa")[:2], CODE, "nation"))
add("q16_rank_position_ties", on(t.rank_position, "000011", "asset_inventory", YEAR, "FY", grain="customer"), _position_sql("asset_inventory", tf("asset_inventory"), None, "000011", "customer"))

_known = f"report_year = {YEAR} AND {REV} IS NOT NULL AND {PROFIT} IS NOT NULL AND {REV} <> 0"
add(
    "q17_topn_intersection",
    on(t.top_intersection, YEAR, "FY", 20, grain="supplier"),
    f"""{o.marts('supplier')}, a AS (SELECT * FROM income_sheet WHERE {_known} ORDER BY {REV} DESC, stock_code LIMIT 20), b AS (SELECT * FROM income_sheet WHERE {_known} ORDER BY {PROFIT} DESC, stock_code LIMIT 20)
    SELECT c.stock_code, stock_abbr, company_name, a.report_year, a.report_period, a.{REV}, a.{PROFIT}, round({o.div(f'a.{PROFIT}', f'a.{REV}')}, 8) AS net_profit_margin
    FROM a JOIN b ON a.stock_code = b.stock_code JOIN company_dim c ON c.stock_code = a.stock_code ORDER BY net_profit_margin DESC, c.stock_code LIMIT 20""",
)


def _set_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = build(spark, sf_dir, "supplier")
    return t.company_set_yoy(m, t.ranking(m, REV, YEAR, "FY", n=20), YEAR, "FY", [REV, PROFIT])


_top = f", top AS (SELECT stock_code FROM income_sheet WHERE report_year = {YEAR} AND {REV} IS NOT NULL ORDER BY {REV} DESC, stock_code LIMIT 20)"
_short = "CASE WHEN status IN ('missing_current_year', 'empty_current_value') THEN 'missing_current_value' WHEN status IN ('missing_previous_year', 'empty_previous_value') THEN 'missing_previous_value' ELSE status END AS status"
add(
    "q18_company_set_yoy",
    _set_yoy,
    f"{o.marts('supplier')}{_top} SELECT stock_code, metric, current_value, previous_value, change_abs, yoy_rate, {_short} FROM ({o.yoy_rows('stock_code IN (SELECT stock_code FROM top)', YEAR, [(REV, 'income_sheet'), (PROFIT, 'income_sheet')])})",
)


def _set_ranking(key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = build(spark, sf_dir, "supplier")
        return t.ranking(m, key, YEAR, "FY", n=5, within=t.ranking(m, REV, YEAR, "FY", n=20))

    return query


_inside = "stock_code IN (SELECT stock_code FROM top)"
add("q19_company_set_ranking_base", _set_ranking(PROFIT), o.ranking(PROFIT, YEAR, tf(PROFIT), limit=5, where=_inside, grain="supplier", extra=_top))
add("q19_company_set_ranking_derived", _set_ranking("net_profit_margin"), o.ranking("net_profit_margin", YEAR, *operands("net_profit_margin")[:2], limit=5, where=_inside, grain="supplier", extra=_top))


def _rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = build(spark, sf_dir, "supplier")
    rows = t.company_set_yoy(m, t.ranking(m, REV, YEAR, "FY", n=20), YEAR, "FY", [PROFIT])
    return t.rerank(rows, "yoy_rate", "asc", 5).select("position", "stock_code", "metric", "yoy_rate")


add(
    "q20_rerank_artifact",
    _rerank,
    f"""{o.marts('supplier')}{_top}, r AS ({o.yoy_rows(_inside, YEAR, [(PROFIT, 'income_sheet')])})
    SELECT row_number() OVER (ORDER BY yoy_rate, stock_code) AS position, stock_code, metric, yoy_rate FROM r WHERE yoy_rate IS NOT NULL ORDER BY yoy_rate, stock_code LIMIT 5""",
)
_n, _d, _ = operands("debt_to_asset_ratio")
add(
    "q21_threshold_filter",
    on(t.threshold_filter, "debt_to_asset_ratio", ">", 50, YEAR, "FY", grain="customer"),
    f"{o.marts('customer')}, {o.measured('x', YEAR, _n, _d)} SELECT stock_code, stock_abbr, company_name, report_year, value FROM mv WHERE value > 0.5 ORDER BY value DESC, stock_code LIMIT 50",
)
add(
    "q21_threshold_filter_base",
    on(t.threshold_filter, REV, ">=", 1_000_000, YEAR, "FY", "asc", 50, grain="supplier"),
    f"{o.marts('supplier')}, {o.measured('x', YEAR, tf(REV))} SELECT stock_code, stock_abbr, company_name, report_year, {o.dbl('value')} AS value FROM mv WHERE value >= 1000000 ORDER BY mv.value, stock_code LIMIT 50",
)


def _filter_sql(conditions, order: str) -> str:
    joins, cols = [], []
    for i, (k, test) in enumerate(conditions):
        joins.append(f"JOIN (SELECT stock_code, round({_abs}, 4) AS r FROM {o.pairs(*tf(k), YEAR - 1, YEAR)}) p{i} ON p{i}.stock_code = c.stock_code AND p{i}.r {test}")
        cols.append(f"p{i}.r AS {k}__yoy")
    return f"{o.marts('supplier')} SELECT c.stock_code, stock_abbr, company_name, {', '.join(cols)} FROM company_dim c {' '.join(joins)} ORDER BY {order} LIMIT 50".replace("round(round", "round(round")


add("q22_yoy_multi_filter", on(t.yoy_filter, [(PROFIT, ">", 50), (REV, "<", 10)], YEAR, "FY", [(PROFIT, "desc")], grain="supplier"), _filter_sql([(PROFIT, "> 0.5"), (REV, "< 0.1")], f"{PROFIT}__yoy DESC, c.stock_code"))
add("q22_yoy_direction_filter", on(t.yoy_filter, [(REV, "<", 0), (PROFIT, ">", 0)], YEAR, "FY", [(PROFIT, "desc")], grain="supplier"), _filter_sql([(REV, "< 0"), (PROFIT, "> 0")], f"{PROFIT}__yoy DESC, c.stock_code"))
add(
    "q22_yoy_multi_sort",
    on(t.yoy_filter, [(REV, ">", 0), (PROFIT, ">", 0)], YEAR, "FY", [(REV, "desc"), (PROFIT, "desc")], grain="supplier"),
    _filter_sql([(REV, "> 0"), (PROFIT, "> 0")], f"{REV}__yoy DESC, {PROFIT}__yoy DESC, c.stock_code"),
)
_grow = lambda c: f"CASE WHEN lag(report_year) OVER w = report_year - 1 THEN round(({o.dbl(c)} - {o.dbl(f'lag({c}) OVER w')}) / nullif(abs({o.dbl(f'lag({c}) OVER w')}), 0) * 100, 4) END"
add(
    "q23_core_mart",
    lambda spark, sf_dir: core_performance(build(spark, sf_dir), report_files(spark, sf_dir)),
    f"""{o.marts()}, i AS (SELECT *, {_grow(REV)} AS operating_revenue_yoy_growth, {_grow(PROFIT)} AS net_profit_yoy_growth FROM income_sheet WINDOW w AS (PARTITION BY stock_code, report_period ORDER BY report_year)),
      f AS (SELECT coalesce(i.stock_code, b.stock_code, c.stock_code) AS stock_code, coalesce(i.report_year, b.report_year, c.report_year) AS report_year,
      coalesce(i.report_period, b.report_period, c.report_period) AS report_period, {REV}, {PROFIT}, operating_expense_cost_of_sales, operating_revenue_yoy_growth, net_profit_yoy_growth, equity_total_equity, operating_cf_net_amount
      FROM i FULL JOIN balance_sheet b ON i.stock_code = b.stock_code AND i.report_year = b.report_year FULL JOIN cash_flow_sheet c
      ON coalesce(i.stock_code, b.stock_code) = c.stock_code AND coalesce(i.report_year, b.report_year) = c.report_year),
      fm AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS stock_code, year(o_orderdate) AS report_year, min(o_orderkey) AS file_id, min(c_nationkey)::BIGINT AS company_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT file_id, company_id, f.stock_code, f.report_year, report_period, stock_abbr, company_name, row_number() OVER (ORDER BY f.stock_code, f.report_year, report_period) AS serial_number,
      {', '.join(f'CAST(NULL AS DECIMAL(20,4)) AS {c}' for c in UNFILLED)}, round({o.dbl(PROFIT)} / 10000, 2) AS net_profit_10k_yuan, round({o.div(f'({REV} - operating_expense_cost_of_sales)', REV)}, 4) AS gross_profit_margin,
      round({o.div(PROFIT, REV)}, 4) AS net_profit_margin, {REV}, operating_revenue_yoy_growth, net_profit_yoy_growth, equity_total_equity, operating_cf_net_amount
    FROM f LEFT JOIN company_dim d ON d.stock_code = f.stock_code LEFT JOIN fm ON fm.stock_code = f.stock_code AND fm.report_year = f.report_year""",
)
