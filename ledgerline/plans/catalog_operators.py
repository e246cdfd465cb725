"""Queries of the load, quality, text and sequence operators over the input tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import similarity
from ledgerline.functions import text as x
from ledgerline.operators import load, matching, quality, sequences
from ledgerline.operators.marts import build
from ledgerline.plans import oracle as o
from ledgerline.plans import templates as t
from ledgerline.plans.compile import latest_years
from ledgerline.sources import files
from ledgerline.plans.catalog import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


_O = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)"
#: All orders, and a later delivery of them all: prices changed, and orders that are done under new keys.
_T = f"WITH {_O}, tgt AS (SELECT * FROM o), src AS (SELECT CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CAST(price + 100 AS DECIMAL(18,2)) AS price FROM o)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o_ = orders(spark, sf_dir)
    key = F.when(F.col("o_orderstatus") == "F", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return o_, o_.withColumns({"o_orderkey": key, "price": (F.col("price") + 100).cast("decimal(18,2)")})


@query("load_upsert", f"{_T} SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL SELECT * FROM src")
def _(spark, d):
    return load.upsert(*_two(spark, d), ["o_orderkey"])


@query("load_insert_ignore", f"{_T} SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)")
def _(spark, d):
    return load.insert_ignore(*_two(spark, d), ["o_orderkey"])


@query("load_delete_stale", f"{_T} SELECT * FROM tgt WHERE NOT (o_orderstatus <> 'F' AND price <= 100000)")
def _(spark, d):
    target, scope = _two(spark, d)
    return load.delete_stale(target, scope, scope.where("price > 100100"), ["o_orderkey"])


@query("load_replace_slice", f"{_T} SELECT * FROM tgt WHERE o_custkey NOT IN (SELECT o_custkey FROM src WHERE o_orderstatus = 'P') UNION ALL SELECT * FROM src WHERE o_orderstatus = 'P'")
def _(spark, d):
    target, source = _two(spark, d)
    return load.replace_slice(target, source.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("load_partial_update", f"{_T}, c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN price END AS price FROM src) SELECT t.o_orderkey, o_custkey, o_orderstatus, coalesce(c.price, t.price) AS price FROM tgt t LEFT JOIN c ON c.o_orderkey = t.o_orderkey")
def _(spark, d):
    target, source = _two(spark, d)
    return load.partial_update(target, source.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("price")).alias("price")), ["o_orderkey"])


@query("load_renumber", f"{o.marts('customer')} SELECT stock_code, report_year, report_period, asset_total_assets, row_number() OVER (ORDER BY stock_code, report_year, report_period) AS serial_number FROM balance_sheet")
def _(spark, d):
    return load.renumber(build(spark, d, "customer").balance_sheet.select("stock_code", "report_year", "report_period", "asset_total_assets"))


@query("load_distinct_on", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return load.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction candidates made of order lines."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.year("l_shipdate").alias("report_year"),
        F.when(n % 2 == 0, "balance_sheet").otherwise("income_sheet").alias("target_table"),
        F.when(F.col("l_returnflag") == "A", "asset_total_assets").when(F.col("l_returnflag") == "R", "asset_inventory").otherwise("net_profit").alias("field"),
        (F.col("l_orderkey") * 10 + n).alias("file_id"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.round(F.col("l_tax") * 10, 2).alias("locator_confidence"),
        F.when(n % 3 == 0, "manual").when(n % 3 == 1, "rule").otherwise("rule_candidate_fill").alias("extract_method"),
        (n == 7).alias("is_summary"),
        (n % 2 == 1).alias("is_consolidated"),
        (n == 5).alias("is_parent_only"),
        F.when(F.col("l_linestatus") == "O", "期末余额").when(n == 4, "").otherwise("期初余额").alias("source_column_role"),
        F.lit("").alias("source_text"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
    )


_C = """WITH cand AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(year(l_shipdate) AS INTEGER) AS report_year, CASE WHEN l_linenumber % 2 = 0 THEN 'balance_sheet' ELSE 'income_sheet' END AS target_table,
  CASE l_returnflag WHEN 'A' THEN 'asset_total_assets' WHEN 'R' THEN 'asset_inventory' ELSE 'net_profit' END AS field, l_orderkey * 10 + l_linenumber AS file_id, round(l_discount * 10, 2) AS confidence,
  round(l_tax * 10, 2) AS locator_confidence, CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'rule' ELSE 'rule_candidate_fill' END AS extract_method, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS mo,
  l_linenumber = 7 AS is_summary, l_linenumber % 2 = 1 AS is_consolidated, l_linenumber = 5 AS is_parent_only, CASE WHEN l_linestatus = 'O' THEN 'current' WHEN l_linenumber = 4 THEN 'unknown' ELSE 'previous' END AS period_role,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS value FROM lineitem)"""
_PRIO = "CAST(is_summary AS INT), CAST(NOT is_consolidated AS INT), CAST(is_parent_only AS INT), mo, confidence DESC, locator_confidence DESC, file_id"
_SEL = f"""{_C}, sel AS (SELECT *, row_number() OVER (PARTITION BY stock_code, report_year, target_table, field ORDER BY CASE WHEN target_table = 'balance_sheet' THEN CASE period_role WHEN 'current' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END ELSE 0 END, {_PRIO}) AS n
  FROM cand WHERE NOT (target_table = 'balance_sheet' AND period_role = 'previous' AND field = 'asset_total_assets'))"""
_CKEY = ["stock_code", "report_year", "target_table"]


@query(
    "load_select_candidates",
    f"""{_SEL} SELECT stock_code, report_year, target_table, field, file_id, value, period_role,
    CASE WHEN target_table = 'balance_sheet' AND period_role = 'previous' THEN least(confidence, 0.3::DOUBLE) ELSE confidence END AS confidence,
    CASE WHEN target_table = 'balance_sheet' AND period_role = 'previous' THEN 'previous_period_used_without_current_candidate' WHEN target_table = 'balance_sheet' AND period_role = 'unknown' THEN 'unknown_period_role_no_current_candidate' ELSE '' END AS risk_flag FROM sel WHERE n = 1""",
)
def _(spark, d):
    return load.select_candidates(candidates(spark, d), _CKEY).select(*_CKEY, "field", "file_id", "value", "period_role", "confidence", "risk_flag")


@query(
    "load_stage_rule",
    f"""{_C}, r AS (SELECT *, lead(confidence) OVER w AS second, row_number() OVER w AS n FROM cand WINDOW w AS (PARTITION BY stock_code, report_year, field ORDER BY confidence DESC, file_id)), g AS (SELECT *, round(confidence - coalesce(second, 0), 4) AS gap FROM r WHERE n = 1)
    SELECT stock_code, report_year, field, confidence AS top_confidence, gap, CASE WHEN confidence >= 0.82 AND gap >= 0.06 THEN 'rule' WHEN confidence >= 0.68 AND gap >= 0.12 THEN 'candidate_fill' ELSE 'needs_rerank' END AS stage FROM g""",
)
def _(spark, d):
    return load.stage_of(candidates(spark, d), ["stock_code", "report_year", "field"])


@query(
    "load_assemble",
    f"{_SEL} SELECT stock_code, report_year, target_table, max(value) FILTER (WHERE field = 'asset_total_assets') AS asset_total_assets, max(value) FILTER (WHERE field = 'asset_inventory') AS asset_inventory, max(value) FILTER (WHERE field = 'net_profit') AS net_profit FROM sel WHERE n = 1 GROUP BY ALL",
)
def _(spark, d):
    return load.assemble(load.select_candidates(candidates(spark, d), _CKEY), _CKEY, ["asset_total_assets", "asset_inventory", "net_profit"])


@query(
    "load_rebuild",
    f"{_SEL}, w AS (SELECT stock_code, report_year, CASE target_table WHEN 'balance_sheet' THEN 'HY' ELSE 'FY' END AS report_period, max(value) FILTER (WHERE field = 'asset_inventory') AS asset_inventory, max(value) FILTER (WHERE field = 'net_profit') AS net_profit FROM sel WHERE n = 1 GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY stock_code, report_year, CASE report_period WHEN 'HY' THEN 2 ELSE 4 END) AS serial_number FROM w",
)
def _(spark, d):
    period = F.when(F.col("target_table") == "balance_sheet", "HY").otherwise("FY")
    chosen = load.select_candidates(candidates(spark, d), _CKEY).withColumn("report_period", period)
    return load.rebuild(chosen, ["stock_code", "report_year", "report_period"], ["asset_inventory", "net_profit"])


@query("load_insert_definitions", "SELECT field_code, sort_order FROM (VALUES ('region.r_name', 1)) v(field_code, sort_order) UNION ALL SELECT 'nation.' || n_name, 9000 + n_nationkey FROM nation")
def _(spark, d):
    have = spark.sql("SELECT * FROM VALUES ('region.r_name', 1) AS v(field_code, sort_order)")
    extra = table(spark, d, "nation").select(F.concat(F.lit("nation."), F.col("n_name")).alias("field_code"), (F.lit(9000) + F.col("n_nationkey")).alias("sort_order"))
    return load.insert_missing_definitions(have, extra.union(have))


# --- quality -----------------------------------------------------------------------------------------------------------

_R = lambda a, e: f"CASE WHEN {a} IS NULL OR {e} IS NULL THEN NULL WHEN greatest(abs({a}), abs({e})) = 0 THEN 0 ELSE abs({o.dbl(f'({a} - {e})')}) / greatest(abs({o.dbl(a)}), abs({o.dbl(e)})) END"
_BAL = f"""{o.marts('customer')}, b AS (SELECT *, CAST(CASE WHEN CAST(stock_code AS INT) % 7 = 0 THEN NULL WHEN CAST(stock_code AS INT) % 5 = 0 THEN asset_total_assets * CAST(1.05 AS DECIMAL(3,2)) ELSE asset_total_assets END AS DECIMAL(20,2)) AS total,
  CAST(liability_total_liabilities + equity_total_equity AS DECIMAL(21,2)) AS split FROM balance_sheet)"""


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("stock_code").cast("int"), F.col("asset_total_assets")
    total = F.when(k % 7 == 0, None).when(k % 5 == 0, a * F.lit("1.05").cast("decimal(3,2)")).otherwise(a)
    return build(spark, sf_dir, "customer").balance_sheet.withColumn("liability_and_equity_total", total.cast("decimal(20,2)"))


@query(
    "dq_balance_identity",
    f"""{_BAL}, m AS (SELECT *, CASE WHEN total IS NULL AND split IS NULL THEN 'skipped' WHEN total IS NOT NULL AND split IS NOT NULL AND coalesce({_R('asset_total_assets', 'split')} <= 0.01, FALSE) AND NOT coalesce({_R('asset_total_assets', 'total')} <= 0.01, FALSE) THEN 'fallback_to_parts'
      WHEN total IS NOT NULL THEN 'stated_total' ELSE 'sum_of_parts' END AS mode FROM b), e AS (SELECT *, CAST(CASE WHEN mode = 'stated_total' THEN total WHEN mode <> 'skipped' THEN split END AS DECIMAL(21,2)) AS expected FROM m), r AS (SELECT *, {_R('asset_total_assets', 'expected')} AS q FROM e)
    SELECT stock_code, report_year, report_period, asset_total_assets AS actual, expected, round(q, 6) AS diff_ratio, mode, CASE WHEN mode = 'skipped' THEN 'skipped' WHEN q IS NULL THEN 'warning' WHEN q <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM r""",
)
def _(spark, d):
    return quality.balance_identity(_stated(spark, d))


_CASH = f"""{o.marts()}, e AS (SELECT *, CAST(operating_cf_net_amount + investing_cf_net_amount + financing_cf_net_amount AS DECIMAL(28,2)) AS expected FROM cash_flow_sheet), r AS (SELECT *, {_R('net_cash_flow', 'expected')} AS q FROM e),
  res AS (SELECT stock_code, report_year, report_period, net_cash_flow AS actual, expected, round(q, 6) AS diff_ratio, CASE WHEN q <= 0.01 THEN 'warning' ELSE 'failed' END AS status FROM r)"""


@query("dq_cash_identity", f"{_CASH} SELECT * FROM res")
def _(spark, d):
    return quality.cash_identity(build(spark, d).cash_flow_sheet)


@query("dq_status_summary", f"{_CASH} SELECT report_year, 0::BIGINT AS passed, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'failed') AS failed, 0::BIGINT AS skipped FROM res GROUP BY report_year")
def _(spark, d):
    return quality.status_summary(quality.cash_identity(build(spark, d).cash_flow_sheet), "report_year", ["passed", "warning", "failed", "skipped"])


@query("dq_issues", f"{_CASH} SELECT *, CASE status WHEN 'failed' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS severity, CASE status WHEN 'failed' THEN 'check_source_columns' WHEN 'warning' THEN 'confirm_fx_effect' ELSE 'complete_fields' END AS action FROM res WHERE status <> 'passed'")
def _(spark, d):
    return quality.issues(quality.cash_identity(build(spark, d).cash_flow_sheet))


@query(
    "dq_plausible_balance",
    f"""{o.marts('customer')}, f AS (SELECT *, coalesce(asset_total_assets < greatest(liability_total_liabilities, equity_total_equity, asset_inventory), FALSE) AS ba, coalesce(liability_total_liabilities > asset_total_assets, FALSE) AS bl,
      coalesce(asset_total_assets > 0 AND abs(equity_total_equity) < asset_total_assets * CAST(0.01 AS DECIMAL(3,2)), FALSE) AS tiny, coalesce(asset_total_assets > 0 AND equity_total_equity = asset_total_assets, FALSE) AS same FROM balance_sheet)
    SELECT stock_code, report_year, report_period, CASE WHEN NOT ba THEN asset_total_assets END AS asset_total_assets, CASE WHEN NOT bl THEN liability_total_liabilities END AS liability_total_liabilities, CASE WHEN NOT tiny AND NOT same THEN equity_total_equity END AS equity_total_equity,
      concat_ws(',', CASE WHEN ba THEN 'assets_under_component' END, CASE WHEN bl THEN 'liabilities_over_assets' END, CASE WHEN tiny THEN 'equity_too_small' END, CASE WHEN same AND NOT tiny THEN 'equity_equals_assets' END) AS rejections FROM f""",
)
def _(spark, d):
    return quality.plausible_balance(build(spark, d, "customer").balance_sheet)


@query("dq_plausible_income", f"{o.marts('supplier')} SELECT stock_code, report_year, report_period, total_operating_revenue, operating_profit, operating_expense_cost_of_sales, CASE WHEN total_operating_revenue >= 100000000 AND abs(net_profit) <= 1000 THEN NULL ELSE net_profit END AS net_profit, CASE WHEN total_operating_revenue >= 100000000 AND abs(net_profit) <= 1000 THEN 'profit_too_small' ELSE '' END AS rejections FROM income_sheet")
def _(spark, d):
    return quality.plausible_income(build(spark, d, "supplier").income_sheet)


_FIELDS = ["asset_total_assets", "liability_total_liabilities", "equity_total_equity"]
_LONG = f"""{o.marts('customer')}, w AS (SELECT stock_code, report_year, CAST(asset_total_assets AS DOUBLE) AS asset_total_assets, CAST(liability_total_liabilities AS DOUBLE) AS liability_total_liabilities, CAST(equity_total_equity AS DOUBLE) AS equity_total_equity FROM balance_sheet),
  long AS (SELECT stock_code, report_year, '{_FIELDS[0]}' AS field, {_FIELDS[0]} AS value FROM w UNION ALL SELECT stock_code, report_year, '{_FIELDS[1]}', {_FIELDS[1]} FROM w UNION ALL SELECT stock_code, report_year, '{_FIELDS[2]}', {_FIELDS[2]} FROM w),
  lineage AS (SELECT *, 'src' || CAST(report_year AS VARCHAR) AS source FROM long WHERE (CAST(stock_code AS INT) + report_year) % 4 <> 0), pages AS (SELECT DISTINCT stock_code, report_year FROM long WHERE CAST(stock_code AS INT) % 3 <> 0), cands AS (SELECT stock_code, report_year, field FROM long WHERE report_year % 2 = 0)"""


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Long values, lineage, recovered pages and candidates."""
    rows = quality.unpivot(build(spark, sf_dir, "customer").balance_sheet, ["stock_code", "report_year"], _FIELDS)
    k = F.col("stock_code").cast("int")
    lineage = rows.where((k + F.col("report_year")) % 4 != 0).withColumn("source", F.concat(F.lit("src"), F.col("report_year").cast("string")))
    return rows, lineage, rows.where(k % 3 != 0).select("stock_code", "report_year").distinct(), rows.where(F.col("report_year") % 2 == 0).select("stock_code", "report_year", "field")


_RATE = lambda a, b: f"round({o.div(a, b)}, 6)"


@query("dq_coverage", f"{_LONG} SELECT report_year, field, count(*) AS expected_count, count(value) AS non_null_count, {_RATE('count(value)', 'count(*)')} AS fill_rate FROM long GROUP BY ALL")
def _(spark, d):
    return quality.coverage(_long(spark, d)[0], ["report_year", "field"])


@query("dq_indicator_sum", f"{_LONG} SELECT count(*) AS row_count, CAST(sum(CASE WHEN {_FIELDS[0]} IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {_FIELDS[1]} IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {_FIELDS[2]} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled, count(*) * 3 AS cells FROM w")
def _(spark, d):
    return quality.indicator_sum(build(spark, d, "customer").balance_sheet, _FIELDS)


@query("dq_distribution", "SELECT coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return quality.distribution(table(spark, d, "documents"), "lang")


_REASON = f"""{_LONG}, miss AS (SELECT l.stock_code, l.report_year, l.field, CASE WHEN CAST(l.stock_code AS INT) % 11 = 0 THEN 'validation_field_mapping_issue' WHEN g.field IS NOT NULL THEN 'selected_but_not_loaded' WHEN p.stock_code IS NULL THEN 'no_statement_json' WHEN c.field IS NOT NULL THEN 'candidate_exists_but_not_selected' ELSE 'no_candidate_found' END AS reason
  FROM long l LEFT JOIN (SELECT DISTINCT stock_code, report_year, field FROM lineage) g USING (stock_code, report_year, field) LEFT JOIN pages p ON p.stock_code = l.stock_code AND p.report_year = l.report_year
  LEFT JOIN (SELECT DISTINCT stock_code, report_year, field FROM cands) c ON c.stock_code = l.stock_code AND c.report_year = l.report_year AND c.field = l.field WHERE l.value IS NULL)"""


@query("dq_missing_reasons", f"{_REASON} SELECT * FROM miss")
def _(spark, d):
    rows, lineage, pages, cands = _long(spark, d)
    return quality.missing_reasons(rows.withColumn("mapped", F.col("stock_code").cast("int") % 11 != 0), ["stock_code", "report_year"], lineage, pages, cands)


@query(
    "dq_funnel",
    f"""{_REASON}, base AS (SELECT field, count(*) AS expected_count, count(value) AS non_null_count FROM long GROUP BY field), li AS (SELECT field, count(*) AS lineage_count FROM lineage GROUP BY field), ca AS (SELECT field, count(*) AS candidate_count FROM cands GROUP BY field),
    rs AS (SELECT field, reason, count(*) AS k FROM miss GROUP BY ALL), tp AS (SELECT field, first(reason ORDER BY k DESC, reason) AS main_reason, {', '.join(f"coalesce(sum(k) FILTER (WHERE reason = '{r}'), 0)::BIGINT AS {r}" for r in quality.REASONS)} FROM rs GROUP BY field)
    SELECT field, expected_count, non_null_count, coalesce(lineage_count, 0) AS lineage_count, coalesce(candidate_count, 0) AS candidate_count, {', '.join(f'coalesce({r}, 0) AS {r}' for r in quality.REASONS)}, main_reason, {_RATE('non_null_count', 'expected_count')} AS fill_rate,
      coalesce({_RATE('coalesce(lineage_count, 0)', 'non_null_count')}, 0) AS lineage_coverage, {_RATE('coalesce(candidate_count, 0)', 'expected_count')} AS recall_rate FROM base LEFT JOIN li USING (field) LEFT JOIN ca USING (field) LEFT JOIN tp USING (field)""",
)
def _(spark, d):
    rows, lineage, pages, cands = _long(spark, d)
    return quality.funnel(rows.withColumn("mapped", F.col("stock_code").cast("int") % 11 != 0), ["stock_code", "report_year"], lineage, pages, cands)


@query("dq_lineage_coverage", f"{_LONG} SELECT field, count(*) AS filled, count(g.field) AS with_lineage, {_RATE('count(g.field)', 'count(*)')} AS coverage FROM (SELECT l.field AS field, k.field AS gf FROM long l LEFT JOIN (SELECT DISTINCT stock_code, report_year, field FROM lineage) k ON k.stock_code = l.stock_code AND k.report_year = l.report_year AND k.field = l.field WHERE l.value IS NOT NULL) g GROUP BY field".replace("count(g.field)", "count(gf)"))
def _(spark, d):
    rows, lineage, _, _ = _long(spark, d)
    return quality.lineage_coverage(rows, lineage, ["stock_code", "report_year"])


@query("dq_lineage_wide", f"{_LONG} SELECT stock_code, report_year, {', '.join(f'''max(source) FILTER (WHERE field = '{f}') AS {f}''' for f in _FIELDS)} FROM lineage GROUP BY ALL")
def _(spark, d):
    return quality.lineage_wide(_long(spark, d)[1], ["stock_code", "report_year"], _FIELDS)


@query("dq_latest_provenance", "SELECT user_id, event_type AS field, event_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("field"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "value")
    return quality.latest_provenance(rows, ["user_id"]).select("user_id", "field", "id", "value")


@query("dq_expected_missing", "SELECT s_suppkey AS file_id, f AS field FROM supplier CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = f AND l_quantity > 49)")
def _(spark, d):
    fields = spark.sql("SELECT * FROM VALUES ('A'), ('N'), ('R') AS v(field)")
    found = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("field"))
    return quality.expected_missing(fields, table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id")), found)


@query("dq_run_delta", "WITH a AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CASE WHEN value > 50 THEN 'large' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1) SELECT kind, coalesce(a.n, 0) AS old_value, coalesce(b.n, 0) AS new_value, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (kind)")
def _(spark, d):
    e = table(spark, d, "events")
    old = e.groupBy(F.col("event_type").alias("kind")).count()
    new = e.groupBy(F.when(F.col("value") > 50, "large").otherwise(F.col("event_type")).alias("kind")).count()
    return quality.run_delta(old, new, ["kind"], "count")


_PAIR = """WITH s AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber < 3 THEN 'a' ELSE 'b' END AS side, CASE WHEN l_quantity < 4 THEN NULL WHEN l_linestatus = 'O' THEN 'current' ELSE 'previous' END AS role, CASE WHEN l_returnflag = 'A' THEN '期末余额' WHEN l_returnflag = 'R' THEN '年初 数' ELSE '金额' END AS col,
    l_linenumber % 2 AS tab, l_tax > 0.04 AS con, CASE WHEN l_discount > 0.01 THEN l_tax < 0.02 END AS par, CAST(l_extendedprice AS DECIMAL(18,2)) AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber < 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
  p AS (SELECT a.case_id, a.role AS ar, b.role AS br, a.col AS ac, b.col AS bc, a.tab AS at_, b.tab AS bt, a.con AS acon, b.con AS bcon, a.par AS ap, b.par AS bp, a.value AS av, b.value AS bv FROM s a JOIN s b ON a.case_id = b.case_id AND a.side = 'a' AND b.side = 'b' AND a.n = 1 AND b.n = 1)"""


def _pairs_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(n < 3, "a").otherwise("b").alias("side"), F.when(F.col("l_quantity") >= 4, F.when(F.col("l_linestatus") == "O", "current").otherwise("previous")).alias("role"),
        F.when(flag == "A", "期末余额").when(flag == "R", "年初 数").otherwise("金额").alias("column"), (n % 2).alias("table"), (F.col("l_tax") > 0.04).alias("consolidated"), F.when(F.col("l_discount") > 0.01, F.col("l_tax") < 0.02).alias("parent"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), n.alias("o1"), F.col("l_partkey").alias("o2"), F.col("l_suppkey").alias("o3"), F.col("l_extendedprice").alias("o4"),
    )
    first = load.latest(rows, ["case_id", "side"], [F.col(c).asc() for c in ("o1", "o2", "o3", "o4")])
    names = ["role", "column", "table", "consolidated", "parent", "value"]
    a, b = (first.where(F.col("side") == x).select("case_id", *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in "ab")
    return a.join(b, "case_id")


@query(
    "dq_root_cause",
    f"""{_PAIR} SELECT case_id, CASE WHEN ar IS NULL OR br IS NULL THEN 'insufficient_lineage_diagnostics' WHEN ar <> br OR (ac = '年初 数' AND bc = '期末余额') OR (ac = '期末余额' AND bc = '年初 数') THEN 'previous_period_column_mismatch' WHEN at_ <> bt THEN 'mixed_statement_table'
      WHEN ap IS NOT NULL AND bp IS NOT NULL AND (acon <> bcon OR ap <> bp) THEN 'mixed_consolidated_parent_scope' WHEN abs(CAST(av - bv AS DOUBLE)) / greatest(CAST(av AS DOUBLE), CAST(bv AS DOUBLE)) > 0.01 THEN 'possible_wrong_row_or_unit' ELSE 'insufficient_lineage_diagnostics' END AS cause,
      at_ <> bt OR acon <> bcon OR coalesce(ap <> bp, FALSE) OR coalesce(ar <> br, FALSE) AS scope_conflict FROM p""",
)
def _(spark, d):
    return quality.root_cause(_pairs_of_sources(spark, d), ["case_id"])


@query("dq_skip_reasons", f"""{_BAL} SELECT 'missing_total_and_parts' AS reason, count(*) AS n FROM b WHERE asset_total_assets IS NOT NULL AND total IS NULL AND (liability_total_liabilities IS NULL OR equity_total_equity IS NULL) HAVING count(*) > 0
    UNION ALL SELECT 'missing_assets', count(*) FROM b WHERE asset_total_assets IS NULL HAVING count(*) > 0""")
def _(spark, d):
    return quality.skip_reasons(_stated(spark, d))


@query("dq_plausible_cash", f"""{o.marts()}, f AS (SELECT *, CAST(stock_code AS INT) % 5 = 0 AS same FROM cash_flow_sheet) SELECT stock_code, report_year, report_period, CASE WHEN NOT same THEN operating_cf_net_amount END AS operating_cf_net_amount, CASE WHEN NOT same THEN investing_cf_net_amount END AS investing_cf_net_amount,
    CASE WHEN NOT same THEN financing_cf_net_amount END AS financing_cf_net_amount, net_cash_flow, CASE WHEN same THEN 'three_equal_amounts' ELSE '' END AS rejections FROM f""")
def _(spark, d):
    cash, same = build(spark, d).cash_flow_sheet, F.col("stock_code").cast("int") % 5 == 0
    filled = {c: F.when(same, F.col("net_cash_flow")).otherwise(F.col(c)) for c in ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount")}
    return quality.plausible_cash(cash.withColumns(filled))


@query("dq_listed_values", f"""{o.marts()}, k AS (SELECT DISTINCT lpad(CAST(c_nationkey + 3 AS VARCHAR), 6, '0') AS stock_code, 1998 AS report_year FROM customer) SELECT k.stock_code, k.report_year, net_profit, i.stock_code IS NOT NULL AS found FROM k LEFT JOIN income_sheet i ON i.stock_code = k.stock_code AND i.report_year = k.report_year""")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.lpad((F.col("c_nationkey") + 3).cast("string"), 6, "0").alias("stock_code"), F.lit(1998).alias("report_year"))
    return quality.listed_values(keys, build(spark, d).table("income_sheet", [1998]), ["stock_code", "report_year"], ["net_profit"])


@query("dq_path_check", "SELECT count(*) FILTER (WHERE p_partkey < (SELECT max(s_suppkey) FROM supplier)) AS existing, count(*) FILTER (WHERE p_partkey >= (SELECT max(s_suppkey) FROM supplier)) AS missing FROM part")
def _(spark, d):
    paths = table(spark, d, "part").select(F.concat(F.lit("D:\\old\\"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    there = table(spark, d, "supplier").where("s_suppkey > 0").select(F.concat(F.lit("/new/"), (F.col("s_suppkey") - 1).cast("string"), F.lit(".pdf")).alias("path"))
    return files.path_check(files.replace_prefix(paths, "path", "D:/old", "/new"), there)


@query("load_signature", """SELECT s_suppkey, sha256('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}') AS signature FROM supplier""")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", files.signature("s_suppkey", "s_name").alias("signature"))


@query("load_needs_rebuild", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 3 = 0 OR o_orderkey % 5 = 0""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("modified"))
    odd = F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(F.col("o_custkey"))
    late = F.when(F.col("o_orderkey") % 5 == 0, F.col("modified") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified"))
    built = rows.where("o_orderstatus <> 'P'").select("o_orderkey", odd.alias("o_custkey"), late.alias("built_at")).withColumn("signature", files.signature("o_custkey"))
    return files.needs_rebuild(rows, built, ["o_orderkey"], ["o_custkey"]).select("o_orderkey")


@query("agg_latest_year", f"{o.marts()} SELECT 'income_sheet' AS sheet, max(report_year) AS latest FROM income_sheet UNION ALL SELECT 'balance_sheet', max(report_year) FROM balance_sheet UNION ALL SELECT 'cash_flow_sheet', max(report_year) FROM cash_flow_sheet")
def _(spark, d):
    return latest_years(build(spark, d))


@query("dq_mapping_audit")
def _(spark, d):
    names = [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]
    wanted = [("part", "a", "p_name", "extracted_metric"), ("part", "b", "p_names", "extracted_metric"), ("part", "c", "weight", "extracted_metric"), ("part", "d", None, "derived_metric"), ("part", "e", "zzz", "not_supported_in_v1")]
    return quality.mapping_audit(spark.createDataFrame(wanted, "table string, field string, source_field string, kind string"), spark.createDataFrame(names, "table string, column string"))


@query("seq_merge_page_breaks")
def _(spark, d):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    cells = F.when(flag != "N", F.create_map(flag, F.col("l_quantity").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.ceil(n / 2).cast("int").alias("page_no"), (n * 1000 + F.col("l_quantity")).alias("y"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("item "), n.cast("string"))).otherwise("").alias("item"), cells.alias("cells"))
    return sequences.merge_page_breaks(rows).select("file_id", "page_no", "y", "item", F.to_json("cells").alias("cells"))


@query("agg_company_reports", f"{o.marts('customer')} SELECT stock_code, count(*) AS reports, min(report_year) AS first_year, max(report_year) AS last_year FROM balance_sheet GROUP BY stock_code")
def _(spark, d):
    return build(spark, d, "customer").balance_sheet.groupBy("stock_code").agg(F.count("*").alias("reports"), F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"))


@query("agg_confidence", f"{_C} SELECT extract_method, count(*) AS n, round(CAST(sum(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) / count(*), 6) AS avg_confidence, count(*) FILTER (WHERE confidence >= 0.68) AS confident FROM cand GROUP BY 1")
def _(spark, d):
    c = F.col("confidence")
    return candidates(spark, d).groupBy("extract_method").agg(F.count("*").alias("n"), F.round(F.sum(c.cast("decimal(10,4)")).cast("double") / F.count("*"), 6).alias("avg_confidence"), F.count(F.when(c >= 0.68, 1)).alias("confident"))


@query(
    "agg_top_summary",
    f"""{o.ranking('x', 1998, ('income_sheet', 'net_profit'), limit=20, grain='supplier').replace('SELECT row_number()', ', z AS (SELECT row_number()')}) SELECT count(*) AS n, round(avg(value), 4) AS average, max(value) FILTER (WHERE position = 1) AS first, max(value) FILTER (WHERE position = 2) AS second,
    count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value < 0) AS negative, round(max(value) FILTER (WHERE position = 1) - max(value) FILTER (WHERE position = 2), 4) AS gap,
    round((max(value) FILTER (WHERE position = 1) - max(value) FILTER (WHERE position = 2)) / abs(nullif(max(value) FILTER (WHERE position = 2), 0)) * 100, 2) AS gap_pct FROM z""",
)
def _(spark, d):
    return sequences.ranked_summary(t.ranking(build(spark, d, "supplier"), "net_profit", 1998, "FY", n=20), "value")


# --- sequences ---------------------------------------------------------------------------------------------------------


@query(
    "win_run_after",
    """WITH f AS (SELECT *, lead(event_type <> 'purchase', 1) OVER w AS a, lead(event_type <> 'purchase', 2) OVER w AS b, lead(event_type <> 'purchase', 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN coalesce(a, FALSE) THEN 1 ELSE 0 END + CASE WHEN coalesce(a AND b, FALSE) THEN 1 ELSE 0 END + CASE WHEN coalesce(a AND b AND c, FALSE) THEN 1 ELSE 0 END AS run_length FROM f WHERE event_type = 'purchase'""",
)
def _(spark, d):
    buys = F.col("event_type") == "purchase"
    return sequences.run_after(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], buys, ~buys).select("event_id", "run_length")


@query("win_top_of_group", "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3")
def _(spark, d):
    return sequences.top_of_group(table(spark, d, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id").asc()], 3).select("user_id", "event_id", "place")


@query("sort_truncated", "SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM supplier) > 50 AS truncated FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def _(spark, d):
    return sequences.truncated(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()])


@query("set_concat_keep_first", "SELECT key, name, balance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, name) AS n FROM (SELECT c_nationkey AS key, c_name AS name, c_acctbal AS balance, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier)) WHERE n = 1")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sequences.concat_keep_first([a, b], ["key"], [F.col("name").asc()])


@query("set_key_difference", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    rows = table(spark, d, "orders")
    return rows.select("o_custkey").distinct().join(rows.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti")


@query("set_year_union", "SELECT year(o_orderdate) AS report_year FROM orders UNION SELECT year(l_shipdate) FROM lineitem")
def _(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("report_year")).union(table(spark, d, "lineitem").select(F.year("l_shipdate"))).distinct()


@query("text_repeated_lines", """WITH l AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type AS line FROM events), u AS (SELECT user_id, count(DISTINCT day) AS units FROM l GROUP BY 1), c AS (SELECT user_id, line, count(*) AS found_on FROM l GROUP BY 1, 2)
    SELECT user_id, line, found_on, units FROM c JOIN u USING (user_id) WHERE found_on >= greatest(2, units // 2 + 1)""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("line"))
    return sequences.repeated_lines(rows, "user_id", "day", "line")


@query(
    "seq_cluster_lines",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, value, i, value AS centre, 1 AS n, 0 AS cluster FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN abs(e.value - r.centre) > 2.8 THEN e.value + (e.value - e.value) / 1 ELSE r.centre + (e.value - r.centre) / (r.n + 1) END,
        CASE WHEN abs(e.value - r.centre) > 2.8 THEN 1 ELSE r.n + 1 END, CASE WHEN abs(e.value - r.centre) > 2.8 THEN r.cluster + 1 ELSE r.cluster END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, value, cluster FROM r""",
)
def _(spark, d):
    return sequences.cluster_lines(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 2.8)


@query(
    "seq_merge_labels",
    """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events), w AS (SELECT *, lag(value IS NULL) OVER o AS above, lag(event_type) OVER o AS label, lead(value IS NOT NULL) OVER o AS below FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, CASE WHEN value IS NOT NULL AND coalesce(above, FALSE) THEN label || event_type ELSE event_type END AS event_type, value FROM w WHERE NOT (value IS NULL AND coalesce(below, FALSE))""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return sequences.merge_labels(rows, ["user_id"], "event_id", "event_type", "value")


# --- text --------------------------------------------------------------------------------------------------------------


@query("text_normalise", r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(12288) || chr(160), '  '), '\r\n?', chr(10), 'g'), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS x FROM documents)
    SELECT doc_id, md5(x) AS text_md5, md5(regexp_replace(x, '[ \t\n\x0b\f\r]+', '', 'g')) AS compact_md5 FROM n""")
def _(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(x.normalise_text(c)).alias("text_md5"), F.md5(x.compact_text(c)).alias("compact_md5"))


def _cycled(key: Column, values: list[str | None]) -> Column:
    """The values in turn by key."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _expected(key: str, values: list[str | None]) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{', '.join(quoted)}])[{key} % {len(values)} + 1]"


_CODES = {" 600000 ": "600000", "1.0": "000001", "12345": "012345", "000002.0 ": "000002", "1 2 3": "000123", "1234567": "1234567", "AB12": "AB12", "": "", "　300\xa0750": "300750", "12.5": "12.5"}
_PERIOD = {"h1 ": "HY", "annual": "FY", "p": "P", "Q1": "Q1", "first_quarter": "Q1", "semi_annual": "HY", "Half_Year": "HY", "third_quarter": "Q3", " q3": "Q3", "YEARLY": "FY", "year": "FY", "fy": "FY", "": "", "第二季度": "第二季度"}
_ITEM = {
    "其中：货币资金": "货币资金", "资产 合计": "资产总计", "一、营业收入：": "营业收入", "（一）短期借款": "短期借款", "十二、综合收益": "综合收益", "(3)存货": "存货", "加：年初余额": "年初余额", "减:所得税费用": "所得税费用", "项目：负债总计": "负债合计",
    "股东权益合计（元）": "股东权益合计(元", "【应收账款】": "应收账款", "二.净利润": "净利润", "其中:利息　收入": "利息收入", "": "", "一、其中：加：项目 现金": "现金", "所有者权益（或股东权益）合计": "所有者权益(或股东权益)合计",
}
_HEAD = {
    "1998 年 12 月 31 日": "current", "1997年12月31日": "previous", "1996年": "unknown", "期末余额": "current", "期初 余额": "previous", "附注": "note", "行次": "note", "本期金额": "current", "上期金额": "previous", "上年年末余额": "previous",
    "1998年度 上期": "previous", "项目": "unknown", "": "unknown", "注释 1998": "note",
}
_AMOUNT = {
    "1,234.50": "1234.500000", "（12.5）": "-12.500000", "－3": "-3.000000", "45.6 %": "45.600000", "不适用": None, "--": None, "": None, "(1,000)": "-1000.000000", "+7": "7.000000", "12.": "12.000000", ".5": "0.500000", "1.2.3": None, "(4%)": "-4.000000", "abc": None,
    "—8,888.1": "-8888.100000", "1 234": "1234.000000",
}


@query("text_stock_codes", f"SELECT o_orderkey, {_expected('o_orderkey', list(_CODES.values()))} AS code FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.normalise_stock_code(_cycled(F.col("o_orderkey"), list(_CODES))).alias("code"))


@query("text_periods", f"SELECT o_orderkey, {_expected('o_orderkey', [*_PERIOD.values(), None])} AS period FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.normalise_period(_cycled(F.col("o_orderkey"), [*_PERIOD, None])).alias("period"))


@query("text_parsed_amounts", f"SELECT o_orderkey, CAST({_expected('o_orderkey', [*_AMOUNT.values(), None])} AS DECIMAL(28,6)) AS amount FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.parse_amount(_cycled(F.col("o_orderkey"), [*_AMOUNT, None])).alias("amount"))


@query("text_amounts", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_acctbal AS DECIMAL(18,2)) END AS DECIMAL(28,6)) AS amount, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 10000 AS DECIMAL(28,2)) END AS yuan FROM supplier")
def _(spark, d):
    v = F.col("s_acctbal").cast("decimal(18,2)")
    printed = F.when(F.col("s_suppkey") % 10 == 0, "--").when(v < 0, F.concat(F.lit("（"), F.format_number(-v, 2), F.lit("）"))).otherwise(F.format_number(v, 2))
    amount = x.parse_amount(printed)
    unit = x.detect_unit(F.lit("合并利润表 单位：万元 币种：人民币"))
    return table(spark, d, "supplier").select("s_suppkey", amount.alias("amount"), x.scale_amount(amount, unit).alias("yuan"))


@query("text_numeric_tokens", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?')) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(x.numeric_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("text_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", x.json_field(F.col("props"), "k").cast("bigint").alias("k"))


@query("text_item_names", f"SELECT o_orderkey, {_expected('o_orderkey', list(_ITEM.values()))} AS item FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.normalise_item_name(_cycled(F.col("o_orderkey"), list(_ITEM))).alias("item"))


@query("text_column_roles", f"SELECT o_orderkey, {_expected('o_orderkey', list(_HEAD.values()))} AS role FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.column_role(_cycled(F.col("o_orderkey"), list(_HEAD)), F.lit(1998)).alias("role"))


@query("text_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) || ',' || CAST(year(o_orderdate) - 1 AS VARCHAR) ELSE '' END AS named, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 2 END AS recent, CASE o_orderkey % 4 WHEN 0 THEN 1996 WHEN 1 THEN 1989 WHEN 2 THEN 1997 END AS first_year FROM orders")
def _(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    named = F.when(k % 3 == 0, F.concat(y, F.lit("年和 "), (F.year("o_orderdate") - 1).cast("string"), F.lit("、"), y, F.lit("年净利润，代码 000019995"))).otherwise("最近的净利润 3019")
    asked = F.concat(named, _cycled(k, ["近三年", "近 10 年", "近两年", "近年"]))
    recent = x.recent_years(asked, F.lit(1998))
    years = x.named_years(asked)
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", years.cast("array<string>")).alias("named"), F.when(recent.isNotNull(), F.size(recent)).alias("recent"), F.get(recent, 0).alias("first_year"))


@query("text_display", "SELECT s_suppkey, format('{:,.2f}', CAST(s_acctbal AS DOUBLE)) AS figure, CASE WHEN s_suppkey % 10 = 0 THEN '-' ELSE printf('%.1f', CAST(s_nationkey AS DOUBLE)) || '%' END AS percent, printf('%.2f', CAST(s_nationkey AS DOUBLE)) || ' 个百分点' AS points FROM supplier")
def _(spark, d):
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", x.display(F.col("s_acctbal"), "").alias("figure"), x.display(F.when(F.col("s_suppkey") % 10 != 0, n), "percent", 1).alias("percent"), x.display(n, "point").alias("points"))


@query("text_json_rows", """SELECT s_suppkey, '{"id":' || s_suppkey || ',"name":"' || s_name || '","a":' || CASE WHEN s_nationkey = 3 THEN 'null' ELSE CAST(s_nationkey AS VARCHAR) END || ',"half":' || s_nationkey || '.5}' AS json FROM supplier""")
def _(spark, d):
    n = F.col("s_nationkey").cast("decimal(10,2)")
    whole = F.when(F.col("s_nationkey") != 3, n)
    half = (n + F.lit("0.50").cast("decimal(3,2)")).cast("decimal(12,3)")
    columns = {"id": (F.col("s_suppkey"), "bigint"), "name": (F.col("s_name"), "string"), "a": (whole, "decimal(10,2)"), "half": (half, "decimal(12,3)")}
    return table(spark, d, "supplier").select("s_suppkey", x.json_row(columns).alias("json"))


@query("text_aliases", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS stock_code, unnest([lpad(CAST(n_nationkey AS VARCHAR), 6, '0'), n_name, n_name || ' Holdings']) AS alias, unnest(['stock_code', 'stock_abbr', 'company_name']) AS kind, TRUE AS is_primary FROM nation")
def _(spark, d):
    return matching.company_aliases(build(spark, d).dim)


@query("text_resolve_company", """WITH c AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS stock_code, n_name AS stock_abbr, n_name || ' Holdings' AS company_name FROM nation), s AS (
      SELECT *, CASE WHEN stock_code = '000007' THEN 1000 WHEN lower(company_name) = 'nation_1' OR lower(stock_abbr) = 'nation_1' THEN 920 WHEN contains('revenue of ' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) || ' in 1998', lower(company_name)) THEN 900 WHEN contains('revenue of ' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) || ' in 1998', lower(stock_abbr)) THEN 850
        WHEN contains('revenue of ' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) || ' in 1998', stock_code) THEN 800 WHEN contains(lower(company_name), 'nation_1') THEN 500 ELSE 0 END AS match_score, length(company_name) AS match_length FROM c)
    SELECT * FROM s WHERE match_score > 0 ORDER BY match_score DESC, match_length DESC, stock_code LIMIT 10""")
def _(spark, d):
    dim = build(spark, d).dim
    return matching.resolve_company(dim, matching.company_aliases(dim), "revenue of NATION_3 in 1998", ["nation_1"], code="000007")


@query("text_contained_items", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(spark, d):
    return matching.contained_items(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@query("text_match_files", """WITH a AS (SELECT DISTINCT p_brand AS alias, lpad(CAST(CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS VARCHAR), 6, '0') AS stock_code FROM part), h AS (SELECT p_partkey, stock_code, length(alias) AS n FROM part JOIN a ON contains(lower(p_name || ' ' || p_brand), lower(alias))),
    b AS (SELECT p_partkey, max(n) AS n FROM h GROUP BY 1), g AS (SELECT h.p_partkey, min(stock_code) AS c, count(DISTINCT stock_code) AS k FROM h JOIN b ON b.p_partkey = h.p_partkey AND b.n = h.n GROUP BY 1)
    SELECT p_partkey AS file_id, CASE WHEN k = 1 THEN c END AS stock_code, CASE WHEN k = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status FROM g""")
def _(spark, d):
    part = table(spark, d, "part")
    aliases = part.select(F.col("p_brand").alias("alias"), F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").cast("string"), 6, "0").alias("stock_code")).distinct()
    files = part.select(F.col("p_partkey").alias("file_id"), F.concat_ws(" ", "p_name", "p_brand").alias("file_name"))
    return matching.match_files(files, aliases)


@query("text_row_match")
def _(spark, d):
    part = table(spark, d, "part")
    a, b = part.select(F.col("p_type").alias("alias")).distinct(), part.select(F.col("p_brand").alias("label")).distinct()
    return a.crossJoin(F.broadcast(b)).select("alias", "label", similarity.row_match_score(F.col("alias"), F.col("label")).alias("score"))  # a few dozen brands
