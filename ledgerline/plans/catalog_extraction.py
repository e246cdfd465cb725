"""Queries of the extraction operators over the input tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import extraction as e
from ledgerline.operators import load, matching
from ledgerline.operators.marts import build
from ledgerline.plans import oracle as o
from ledgerline.plans.catalog import Query
from ledgerline.plans.catalog_operators import table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- questions -----------------------------------------------------------------------------------------------------------

_ALIASES = [("ring", "ring", 0), ("ring", "small ring", 0), ("widget", "widget", 1), ("colour", "red", 2), ("colour", "blue", 2), ("bolt", "bolt", 3), ("size", "small", 4), ("size", "large", 4), ("class", "economy", 5), ("class", "standard", 5)]
_VALUES = ", ".join(f"('{m}', '{a}', {p})" for m, a, p in _ALIASES)
_VAGUE = {"ring": (("red", "blue"), ("size",)), "economy": (("widget",), ("bolt",))}


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("question_id"), F.lower(F.concat(F.lit("price of "), "p_name", F.lit("\t "), "p_type")).alias("question"))
    return asked, spark.createDataFrame(_ALIASES, "metric string, alias string, position int")


_ASKED = f"""WITH q AS (SELECT p_partkey AS question_id, lower(replace('priceof' || p_name || p_type, ' ', '')) AS q FROM part), a(metric, alias, position) AS (VALUES {_VALUES}),
  h AS (SELECT question_id, metric, alias, position, length(replace(alias, ' ', '')) AS n FROM q JOIN a ON contains(q, replace(alias, ' ', ''))),
  b AS (SELECT question_id, metric, first(alias ORDER BY n DESC, position, alias) AS alias, max(n) AS n, first(position ORDER BY n DESC, position, alias) AS position FROM h GROUP BY ALL)"""


@query("text_metric_mentions", f"{_ASKED} SELECT question_id, metric, alias, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, position, metric) AS place FROM b")
def _(spark, d):
    return matching.metric_mentions(*_questions(spark, d))


@query(
    "text_ambiguous_phrases",
    f"""{_ASKED} SELECT question_id, 'ring' AS phrase FROM q WHERE contains(q, 'ring') AND NOT contains(q, 'red') AND NOT contains(q, 'blue') AND question_id NOT IN (SELECT question_id FROM h WHERE contains(replace(alias, ' ', ''), 'ring')) AND question_id NOT IN (SELECT question_id FROM b WHERE metric = 'size')
    UNION ALL SELECT question_id, 'economy' FROM q WHERE contains(q, 'economy') AND NOT contains(q, 'widget') AND question_id NOT IN (SELECT question_id FROM h WHERE metric <> 'class' AND contains(replace(alias, ' ', ''), 'economy')) AND question_id NOT IN (SELECT question_id FROM b WHERE metric = 'bolt')""",
)
def _(spark, d):
    asked, aliases = _questions(spark, d)
    vague = aliases.where("metric <> 'class'")  # a dictionary that doesn't know the class, so that the word stays vague
    return matching.ambiguous_phrases(asked, matching.metric_mentions(asked, vague), vague, _VAGUE)


# --- pages -----------------------------------------------------------------------------------------------------------------

_WS = r"[ \t\n\x0b\f\r]"
_PAGES = rf"""WITH p AS (SELECT doc_id, lang, text, regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(12288) || chr(160), '  '), '\r\n?', chr(10), 'g'), '{_WS}+', '', 'g') AS c,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents)"""
_N = lambda x, k: f"len(regexp_extract_all({x}, '[0-9][0-9,]*(?:\\.[0-9]+)?')) >= {k}"


@query(
    "page_scores",
    f"""{_PAGES}, s AS (SELECT doc_id, CASE WHEN contains(c, 'Licensed') OR contains(c, 'Allrights') THEN 60.0 WHEN contains(c, 'the') OR contains(c, 'der') THEN 40.0 ELSE 0.0 END AS title_score,
      least(len(list_filter(l[1:50], lambda x: {_N('x', 2)})), 8) * 4.0 AS table_density_score, (CAST(contains(c, 'token') AS INT) + CAST(contains(c, '@') AS INT) + CAST(contains(c, '|') AS INT)) * 5.0 AS financial_row_score,
      CASE WHEN lang = 'en' THEN 8.0 ELSE 0.0 END + CASE WHEN lang = 'fr' THEN 6.0 ELSE 0.0 END AS bonus, CASE WHEN lang = 'de' THEN 12.0 ELSE 0.0 END + CASE WHEN contains(c, 'Apache') THEN 8.0 ELSE 0.0 END AS penalty FROM p),
    t AS (SELECT *, title_score + table_density_score + financial_row_score + bonus - penalty AS score FROM s)
    SELECT doc_id, CAST(title_score AS DOUBLE) AS title_score, CAST(table_density_score AS DOUBLE) AS table_density_score, CAST(financial_row_score AS DOUBLE) AS financial_row_score, CAST(score AS DOUBLE) AS score, greatest(0.0::DOUBLE, least(CAST(score AS DOUBLE) / 100, 1.0::DOUBLE)) AS confidence FROM t""",
)
def _(spark, d):
    lang = F.col("lang")
    pages = table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("title"), F.when(lang == "fr", "h").alias("header"), (lang == "en").alias("is_consolidated"), (lang == "de").alias("is_parent_only"))
    out = e.page_score(pages, ["Licensed", "All rights"], ["the", "der"], ["token", "@", "|"], summary="Apache")
    return out.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("title_score", "table_density_score", "financial_row_score", "score", "confidence")])


_TITLES, _HEADERS, _ROWS, _RESTATED = ["Allrightsreserved."], ["the", "der"], ["of", "die", "token"], ["Apache", "token", "rights"]
_IN = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_HINTS = lambda xs: " + ".join(f"CAST(len(list_filter({xs}, lambda x: contains(x, '{w}'))) > 0 AS INT)" for w in _ROWS)


@query(
    "page_layouts",
    rf"""{_PAGES}, k AS (SELECT *, list_transform(l, lambda x: regexp_replace(x, '{_WS}+', '', 'g')) AS k FROM p), a AS (SELECT *, list_max(list_transform(range(len(k)), lambda i: CASE WHEN k[i + 1] IN ({', '.join(f"'{t}'" for t in _TITLES)}) THEN i END)) AS pos FROM k)
    SELECT doc_id, coalesce(pos >= 55 OR pos >= floor(len(l) * 0.6), FALSE) AS late_title,
      len(list_filter(k[1:12], lambda x: {_IN('x', _HEADERS)})) >= 1 AND len(list_filter(l[1:25], lambda x: {_N('x', 2)})) >= 3 AND ({_HINTS('k[1:25]')}) >= 1 AS dense_header,
      coalesce(len(l[pos + 2:]) >= 8 AND (len(list_filter(l[pos + 2:pos + 19], lambda x: {_N('x', 1)})) >= 2 OR ({_HINTS('k[pos + 2:pos + 21]')}) >= 1), FALSE) AS body_after_title,
      ({' + '.join(f"CAST(contains(c, '{w}') AS INT)" for w in _RESTATED)}) * 16.0::DOUBLE AS restatement_penalty FROM a""",
)
def _(spark, d):
    out = e.page_layout(table(spark, d, "documents").select("doc_id", "text"), _TITLES, _HEADERS, _ROWS, _RESTATED)
    return out.select("doc_id", "late_title", "dense_header", "body_after_title", F.col("restatement_penalty").cast("double").alias("restatement_penalty"))


@query(
    "page_company_fields",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN s_suppkey % 3 = 1 THEN lpad(CAST(s_nationkey AS VARCHAR), 6, '0') END AS stock_code,
      CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS stock_abbr, CASE WHEN s_suppkey % 5 <> 0 THEN s_name || '股份有限公司' END AS company_name FROM supplier""",
)
def _(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    code = F.lpad(k.cast("string"), 6, "0")
    text = F.concat_ws(
        "\n",
        F.lit("2020 年度报告 某某股份有限公司"),
        F.when(k % 3 == 1, F.concat(F.lit(" 公司代码：　"), F.lpad(F.col("s_nationkey").cast("string"), 6, "0"))),
        F.when(k % 4 != 0, F.concat(F.lit("公司简称: "), name, F.lit(" 其他"))),
        F.when(k % 5 != 0, F.concat(F.lit("  "), name, F.lit("股份有限公司　"))),
        F.lit("别的有限公司报告"),
    )
    pages = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, F.concat(F.lit("r_"), code, F.lit(".pdf"))).alias("file_name"), text.alias("text"))
    return e.company_fields(pages).select("s_suppkey", "stock_code", "stock_abbr", "company_name")


# --- tables ----------------------------------------------------------------------------------------------------------------


@query("text_best_rows")
def _(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row_id"), F.array("p_name", F.concat_ws(" ", "p_type", "p_name")).alias("variants"))
    aliases = spark.createDataFrame([("rings", "small rings", 0), ("rings", "ring", 1), ("widgets", "red widget", 0), ("widgets", "widgets", 1)], "field string, alias string, position int")
    return e.best_rows(rows, aliases, {"rings": 70.0})


_HEAD = """WITH h AS (SELECT l_orderkey AS table_id, l_linenumber AS column_index, CASE WHEN l_linenumber = 1 THEN 'note' WHEN l_returnflag = 'A' THEN 'current_period' WHEN l_returnflag = 'R' THEN 'previous_period' ELSE '' END AS column_role,
  CASE WHEN l_linestatus = 'O' THEN '本期金额' WHEN l_quantity > 25 THEN '2020年12月31日' ELSE '' END AS column_label FROM lineitem)"""


@query(
    "load_choose_columns",
    f"""{_HEAD}, r AS (SELECT table_id, column_index, CASE WHEN contains(column_label, '2020年') THEN 0 WHEN column_role = 'current_period' THEN 1 WHEN column_label = '本期金额' THEN 2 END AS rank FROM h WHERE column_role NOT IN ('note', 'index')),
    b AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY rank, column_index) AS n FROM r WHERE rank IS NOT NULL) SELECT table_id, column_index, CASE rank WHEN 0 THEN 'requested' WHEN 1 THEN 'role' ELSE 'alias' END AS chosen_by FROM b WHERE n = 1""",
)
def _(spark, d):
    n = F.col("l_linenumber")
    role = F.when(n == 1, "note").when(F.col("l_returnflag") == "A", "current_period").when(F.col("l_returnflag") == "R", "previous_period").otherwise("")
    label = F.when(F.col("l_linestatus") == "O", "本期 金额").when(F.col("l_quantity") > 25, "2020年12月31日").otherwise("")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), n.alias("column_index"), role.alias("column_role"), label.alias("column_label"))
    return e.choose_columns(rows, "current_period", ["本期金额"], requested="2020 年")


_CAND = """WITH c AS (SELECT l_suppkey AS report, l_returnflag AS field, l_orderkey * 10 + l_linenumber AS file_id, l_quantity * 2 AS score, CASE WHEN l_linestatus = 'O' THEN 'current_period' WHEN l_linenumber > 4 THEN 'previous_period' END AS source_column_role, l_tax AS locator_confidence,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS value, l_linenumber AS row_id FROM lineitem)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("report"),
        F.col("l_returnflag").alias("field"),
        (F.col("l_orderkey") * 10 + n).alias("file_id"),
        (F.col("l_quantity") * 2).alias("score"),
        F.when(F.col("l_linestatus") == "O", "current_period").when(n > 4, "previous_period").alias("source_column_role"),
        F.col("l_tax").alias("locator_confidence"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
        n.alias("row_id"),
    )


@query(
    "load_rank_candidates",
    f"""{_CAND}, k AS (SELECT *, least(0.99::DOUBLE, greatest(0.5::DOUBLE, score / 100)) AS confidence FROM c) SELECT report, field, file_id, confidence, row_number() OVER (PARTITION BY report, field ORDER BY confidence DESC, CASE WHEN source_column_role = 'current_period' THEN 0 ELSE 1 END, locator_confidence DESC, file_id) AS candidate_rank,
    round(confidence, 4) AS candidate_score FROM k""",
)
def _(spark, d):
    return e.rank_candidates(_candidates(spark, d), ["report", "field"]).select("report", "field", "file_id", "confidence", "candidate_rank", "candidate_score")


_NAMED = "CASE field WHEN 'A' THEN 'asset_total_assets' WHEN 'R' THEN 'equity_total_equity' ELSE 'liability_total_liabilities' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("field") == "A", "asset_total_assets").when(F.col("field") == "R", "equity_total_equity").otherwise("liability_total_liabilities")
    rows = _candidates(spark, sf_dir).withColumns({"field": field, "confidence": F.col("score") / 100})
    return rows.withColumn("report", F.floor(F.col("file_id") / 10)).withColumn("value", F.when((F.col("row_id") % 3 == 0) & (F.col("field") == "equity_total_equity"), F.lit(7)).otherwise(F.col("value")).cast("decimal(18,2)"))


_NAMEDC = f"{_CAND}, n AS (SELECT file_id // 10 AS report, {_NAMED} AS field, file_id, score / 100 AS confidence, source_column_role, row_id, CASE WHEN row_id % 3 = 0 AND field = 'R' THEN CAST(7 AS DECIMAL(18,2)) ELSE value END AS value FROM c)"


@query(
    "dq_suspicious_equity",
    f"""{_NAMEDC}, t AS (SELECT *, max(value) FILTER (WHERE field = 'asset_total_assets') OVER (PARTITION BY report) AS top FROM n), f AS (SELECT *, CASE WHEN field = 'equity_total_equity' AND top > 0 AND value = top THEN 'suspicious_equal_asset_total' WHEN field = 'equity_total_equity' AND top > 0 AND abs(value) < top * 0.01 THEN 'suspicious_too_small' ELSE '' END AS risk_flag FROM t)
    SELECT file_id, field, value, risk_flag, CASE WHEN risk_flag <> '' THEN least(confidence, 0.49::DOUBLE) ELSE confidence END AS confidence FROM f""",
)
def _(spark, d):
    return e.suspicious_equity(_named(spark, d).withColumn("row_name", F.lit("")), ["report"]).select("file_id", "field", "value", "risk_flag", "confidence")


@query(
    "load_same_section",
    f"""{_NAMEDC}, f AS (SELECT report, first(row_id ORDER BY confidence DESC, CASE WHEN source_column_role = 'current_period' THEN 0 ELSE 1 END, file_id) AS pos FROM n WHERE field = 'asset_total_assets' GROUP BY 1),
    b AS (SELECT n.*, (pos IS NULL OR row_id >= pos) AS below FROM n LEFT JOIN f USING (report)), s AS (SELECT *, bool_or(below) OVER (PARTITION BY report, field) AS kept FROM b) SELECT file_id, field, row_id FROM s WHERE field = 'asset_total_assets' OR below OR NOT kept""",
)
def _(spark, d):
    return e.same_section(_named(spark, d), ["report"], ["equity_total_equity", "liability_total_liabilities"]).select("file_id", "field", "row_id")


@query(
    "dq_guardrail",
    """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND contains(p_name, 'bolt') THEN 'high_risk_reject_cross_statement_pollution' WHEN p_type = 'ECONOMY' AND contains(p_name, 'red') THEN 'semantic_deny_token'
      WHEN p_type = 'ECONOMY' AND NOT contains(p_name, 'ring') AND NOT contains(p_name, 'widget') THEN 'semantic_allow_token_missing' WHEN p_type = 'SMALL' AND contains(p_name, 'blue') THEN 'semantic_deny_token' WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'not_configured' ELSE 'ok' END AS reason FROM part""",
)
def _(spark, d):
    reason = e.guardrail(F.col("p_type"), [F.col("p_name")], {"ECONOMY": ["ring", "widget"]}, {"ECONOMY": ["red"], "SMALL": ["blue"]}, {"ECONOMY": ["bolt"]})
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


# --- locator ---------------------------------------------------------------------------------------------------------------

_LOC = """loc AS (SELECT l_orderkey AS file_id, CASE WHEN l_returnflag = 'A' THEN 'balance_sheet' WHEN l_returnflag = 'R' THEN 'income_sheet' ELSE 'cash_flow_sheet' END AS statement_type, min(l_linenumber) AS page_start, CASE WHEN max(l_linenumber) > 5 THEN max(l_linenumber) END AS page_end,
  CASE WHEN count(*) > 2 THEN CAST(count(*) AS INT) END AS end_page_guess, CASE WHEN min(l_quantity) > 40 THEN 'failed' WHEN min(l_quantity) > 20 THEN 'weak_match' ELSE 'success' END AS locator_status, max(l_discount) AS locator_confidence, bool_or(l_linestatus = 'O') AS is_consolidated, bool_and(l_linestatus = 'F') AS is_parent_only FROM lineitem GROUP BY 1, 2)"""


def _locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, n, q = F.col("l_returnflag"), F.col("l_linenumber"), F.min("l_quantity")
    kind = F.when(flag == "A", "balance_sheet").when(flag == "R", "income_sheet").otherwise("cash_flow_sheet")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), kind.alias("statement_type")).agg(
        F.min(n).alias("page_start"),
        F.when(F.max(n) > 5, F.max(n)).alias("page_end"),
        F.when(F.count("*") > 2, F.count("*").cast("int")).alias("end_page_guess"),
        F.when(q > 40, "failed").when(q > 20, "weak_match").otherwise("success").alias("locator_status"),
        F.max("l_discount").alias("locator_confidence"),
        F.bool_or(F.col("l_linestatus") == "O").alias("is_consolidated"),
        F.bool_and(F.col("l_linestatus") == "F").alias("is_parent_only"),
    )


@query(
    "load_statement_tasks",
    f"""WITH {_LOC} SELECT o_orderkey AS file_id, statement_type, page_start, coalesce(end_page_guess, page_end, page_start) AS end_page, locator_status FROM orders JOIN loc ON file_id = o_orderkey WHERE o_orderstatus <> 'F' AND page_start IS NOT NULL AND locator_status IN ('success', 'weak_match')""",
)
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "parsed")
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), status.alias("parse_status"))
    return e.statement_tasks(files, _locator(spark, d)).select("file_id", "statement_type", "page_start", "end_page", "locator_status")


@query(
    "load_extract_results",
    f"""WITH {_LOC}, c AS (SELECT l_orderkey AS file_id, CASE WHEN l_linenumber % 2 = 0 THEN 'balance_sheet' ELSE 'income_sheet' END AS target_table, CASE WHEN l_linenumber = 6 THEN '' ELSE 'f' || l_linenumber END AS field, CASE WHEN l_quantity < 5 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS value_text,
      CASE l_returnflag WHEN 'A' THEN 'rule' WHEN 'R' THEN 'manual_backfill' ELSE 'guess' END AS extract_method FROM lineitem)
    SELECT c.file_id, target_table, field, value_text, extract_method, o_custkey, coalesce(locator_confidence, 0) AS locator_confidence, coalesce(is_consolidated, FALSE) AS is_consolidated, coalesce(is_parent_only, FALSE) AS is_parent_only
    FROM c JOIN orders ON o_orderkey = c.file_id LEFT JOIN loc ON loc.file_id = c.file_id AND loc.statement_type = c.target_table WHERE extract_method <> 'guess' AND field <> '' AND value_text IS NOT NULL""",
)
def _(spark, d):
    n, q, flag = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(n % 2 == 0, "balance_sheet").otherwise("income_sheet").alias("target_table"),
        F.when(n == 6, "").otherwise(F.concat(F.lit("f"), n.cast("string"))).alias("field"),
        F.when(q >= 5, q.cast("int").cast("string")).alias("value_text"),
        F.when(flag == "A", "rule").when(flag == "R", "manual_backfill").otherwise("guess").alias("extract_method"),
    )
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), "o_custkey")
    return e.extract_results(rows, files, _locator(spark, d))


@query(
    "set_merge_by_year",
    f"""{o.marts()}, a AS (SELECT report_year, sum(total_operating_revenue) AS revenue, sum(net_profit) AS amount FROM income_sheet WHERE report_year < 2000 GROUP BY 1), b AS (SELECT report_year, sum(asset_total_assets) AS assets, CASE WHEN report_year % 2 = 0 THEN sum(asset_inventory) END AS amount FROM balance_sheet WHERE report_year > 1994 GROUP BY 1)
    SELECT report_year, revenue, coalesce(b.amount, a.amount) AS amount, assets FROM a FULL JOIN b USING (report_year)""",
)
def _(spark, d):
    m = build(spark, d)
    a = m.income_sheet.where("report_year < 2000").groupBy("report_year").agg(F.sum("total_operating_revenue").alias("revenue"), F.sum("net_profit").alias("amount"))
    b = m.balance_sheet.where("report_year > 1994").groupBy("report_year").agg(F.sum("asset_total_assets").alias("assets"), F.when(F.col("report_year") % 2 == 0, F.sum("asset_inventory")).alias("amount"))
    return e.merge_by_year([a, b])


# --- open tasks --------------------------------------------------------------------------------------------------------------

_TASKS = f"""WITH {_LOC}, f AS (SELECT file_id, statement_type, unnest(['A', 'N', 'R']) AS field, page_start FROM loc),
  r AS (SELECT DISTINCT l_orderkey AS file_id, l_returnflag AS field FROM lineitem WHERE l_quantity >= 10 AND l_linenumber <> 7),
  h AS (SELECT l_orderkey AS file_id, l_returnflag AS field, first(struct_pack(p := l_linenumber, t := l_linestatus) ORDER BY l_quantity DESC, l_linenumber, l_linestatus) AS h FROM lineitem GROUP BY ALL),
  t AS (SELECT f.file_id, statement_type, f.field, h.h.p AS page_hint, h.h.t AS text_hint FROM f LEFT JOIN r ON r.file_id = f.file_id AND r.field = f.field LEFT JOIN h ON h.file_id = f.file_id AND h.field = f.field WHERE r.file_id IS NULL)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _locator(spark, sf_dir).select("file_id", "statement_type")
    expected = found.select("*", F.explode(F.array(*map(F.lit, "ANR"))).alias("field"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("field"), "l_quantity", "l_linenumber", "l_linestatus")
    each = lines.join(found, "file_id")
    value = F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("string")).otherwise(" ")
    results = each.select("file_id", "statement_type", "field", F.when(F.col("l_linenumber") == 7, "guess").otherwise("rule").alias("extract_method"), value.alias("value_text"))
    hints = each.select("file_id", "statement_type", "field", F.col("l_linenumber").alias("page"), F.col("l_linestatus").alias("text"), F.col("l_quantity").alias("score"))
    return e.missing_tasks(expected, results, hints)


@query("dq_missing_tasks", f"{_TASKS} SELECT * FROM t")
def _(spark, d):
    return _tasks(spark, d)


@query("dq_task_counts", f"{_TASKS} SELECT statement_type, count(*) AS missing_fields FROM t GROUP BY 1")
def _(spark, d):
    return e.task_counts(_tasks(spark, d))[0]


@query("dq_task_files", f"{_TASKS} SELECT file_id, count(*) AS missing_fields FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return e.task_counts(_tasks(spark, d))[1]


@query(
    "dq_coverage_report",
    """WITH x AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem), h AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS confidence FROM lineitem WHERE l_quantity > 20 GROUP BY ALL),
    j AS (SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_returnflag, l_linestatus, confidence FROM x LEFT JOIN h USING (l_orderkey, l_linenumber))
    SELECT CASE WHEN grouping(l_suppkey) = 0 THEN 2 WHEN grouping(l_linestatus) = 0 THEN 1 ELSE 0 END AS level, l_returnflag, l_linestatus, l_suppkey, count(*) AS expected, count(confidence) AS hit, count(*) - count(confidence) AS missing,
      round(CAST(count(confidence) AS DOUBLE) / count(*), 4) AS coverage_rate, coalesce(round(CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / nullif(count(confidence), 0), 4), 0) AS avg_confidence FROM j GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), (l_suppkey))""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    hits = rows.where("l_quantity > 20").select(*key, F.col("l_tax").alias("confidence"))
    return e.coverage_report(rows.select(*key, "l_suppkey", "l_returnflag", "l_linestatus"), hits, key, [["l_returnflag"], ["l_returnflag", "l_linestatus"], ["l_suppkey"]])


@query(
    "dq_rejection_reasons",
    """WITH c AS (SELECT l_orderkey AS file_id, l_returnflag AS field, CASE WHEN l_linestatus = 'O' THEN 'current_period' WHEN l_linenumber > 2 THEN 'previous_period' END AS role, CASE WHEN l_quantity > 40 THEN 'only_non_target_column_role' END AS warning, l_tax FROM lineitem),
    g AS (SELECT file_id, field, count(*) AS candidates, bool_or(coalesce(role = 'current_period', FALSE)) AS cur, bool_and(coalesce(role = 'previous_period', FALSE)) AS prev, bool_or(coalesce(warning <> '', FALSE)) AS odd, max(l_tax) AS t FROM c GROUP BY ALL)
    SELECT file_id, field, candidates, CASE WHEN t > 0.07 THEN 'final_value_present_not_rejected' WHEN t > 0.06 THEN 'selected_but_removed_by_validation' WHEN prev THEN 'previous_period_only_candidate' WHEN cur AND odd THEN 'current_candidate_with_column_role_warning'
      WHEN cur THEN 'current_candidate_not_selected_or_loader_validation_rejected' WHEN odd THEN 'candidate_column_role_unstable' ELSE 'candidate_not_selected_unknown' END AS reason FROM g""",
)
def _(spark, d):
    key = [F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("field")]
    rows = table(spark, d, "lineitem")
    role = F.when(F.col("l_linestatus") == "O", "current_period").when(F.col("l_linenumber") > 2, "previous_period")
    cands = rows.select(*key, role.alias("column_role"), F.when(F.col("l_quantity") > 40, "only_non_target_column_role").alias("warning"))
    t = F.max("l_tax")
    finals = rows.groupBy(*key).agg(F.when(t > 0.07, t).alias("value"), (t > 0.06).alias("has_lineage")).where("value IS NOT NULL OR has_lineage")
    return e.rejection_reasons(cands, finals, ["file_id", "field"])


@query(
    "dq_suspected_reasons",
    """WITH s AS (SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'A' THEN 'liability_and_equity_total' ELSE 'asset_total_assets' END AS field, l_linenumber AS page, l_quantity > 10 AS found, CASE WHEN l_linestatus = 'O' THEN '' WHEN l_linenumber = 3 THEN '母公司资产负债表' WHEN l_linenumber = 4 THEN '期初余额' ELSE 'x' END AS txt,
      CASE WHEN l_tax > 0.07 THEN 'previous_period_used' ELSE '' END AS flag, l_linenumber = 6 AS parent FROM lineitem),
    g AS (SELECT case_id, min(page) FILTER (WHERE found) <> max(page) FILTER (WHERE found) AS pages, bool_or(found AND txt = '') AS blank, bool_or(flag <> '') AS flag, bool_or(contains(txt, '母公司') OR parent) AS parent, bool_or(contains(txt, '期初')) AS earlier, bool_or(found AND field = 'liability_and_equity_total') AS stated FROM s GROUP BY 1),
    c AS (SELECT o_orderkey AS case_id, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.05 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS t FROM orders)
    SELECT c.case_id, coalesce(nullif(concat_ws(',', CASE WHEN t IS NULL OR NOT coalesce(stated, FALSE) THEN 'missing_liability_and_equity_total' END, CASE WHEN blank THEN 'missing_lineage_source_text' END, CASE WHEN pages THEN 'possible_mixed_statement_pages' END, CASE WHEN parent THEN 'possible_parent_company_statement' END,
      CASE WHEN earlier THEN 'possible_previous_period_column' END, CASE WHEN abs(a - t) > greatest(abs(a), abs(t)) * 0.01 THEN 'possible_wrong_row_or_unit' END, CASE WHEN flag THEN 'previous_period_used' END), ''), 'unclassified') AS reasons FROM c LEFT JOIN g USING (case_id)""",
)
def _(spark, d):
    n, a = F.col("l_linenumber"), F.col("o_totalprice").cast("decimal(18,2)")
    sources = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.when(F.col("l_returnflag") == "A", "liability_and_equity_total").otherwise("asset_total_assets").alias("field"),
        n.alias("page"),
        (F.col("l_quantity") > 10).alias("lineage_found"),
        F.when(F.col("l_linestatus") == "O", None).when(n == 3, "母公司资产负债表").when(n == 4, "期初余额").otherwise("x").alias("source_text"),
        F.when(F.col("l_tax") > 0.07, "previous_period_used").otherwise("").alias("risk_flag"),
        (n == 6).alias("is_parent_only"),
    )
    status = F.col("o_orderstatus")
    total = F.when(status == "F", None).when(status == "P", (a * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(18,2)")).otherwise(a)
    return e.suspected_reasons(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), a.alias("assets"), total.alias("total")), sources)


# --- manual values -------------------------------------------------------------------------------------------------------------

_SHEET = """WITH res AS (SELECT l_orderkey AS file_id, 'balance_sheet' AS target_table, 'f' || l_linenumber AS field, CASE WHEN l_returnflag = 'A' THEN 'manual_backfill' ELSE 'rule' END AS extract_method, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value_text FROM lineitem),
  sheet AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderstatus = 'P' THEN 'x' || o_orderkey ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS file_id, CASE WHEN o_custkey % 10 = 0 THEN 'balance_sheet.serial_number' ELSE 'f1' END AS field, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS manual_value FROM orders),
  chk AS (SELECT *, CASE WHEN file_id LIKE 'x%' THEN 'bad_file_id' WHEN field <> 'f1' THEN 'metadata_field' WHEN manual_value = '' THEN 'empty_value' ELSE '' END AS reason FROM sheet)"""


def _sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = F.col("l_quantity").cast("int").cast("string")
    method = F.when(F.col("l_returnflag") == "A", "manual_backfill").otherwise("rule")
    res = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit("balance_sheet").alias("target_table"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), method.alias("extract_method"), q.alias("value_text"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    file_id = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), k.cast("string"))).otherwise(F.floor(k / 2).cast("string"))
    field = F.when(c % 10 == 0, "balance_sheet.serial_number").otherwise(" f1 ")
    value = F.when(c % 7 == 0, "　").otherwise(c.cast("string"))
    return res, table(spark, sf_dir, "orders").select(k.alias("line_no"), file_id.alias("file_id"), F.lit("balance_sheet").alias("target_table"), field.alias("field"), value.alias("manual_value"))


@query("load_check_backfill", f"{_SHEET} SELECT line_no, reason FROM chk")
def _(spark, d):
    return e.check_backfill(_sheet(spark, d)[1], skipped=["serial_number"]).select("line_no", "reason")


@query(
    "load_backfill",
    f"""{_SHEET}, new AS (SELECT CAST(file_id AS BIGINT) AS file_id, 'balance_sheet' AS target_table, 'f1' AS field, 'manual_backfill' AS extract_method, arg_max(manual_value, line_no) AS value_text FROM chk WHERE reason = '' GROUP BY 1)
    SELECT * FROM res WHERE NOT (extract_method = 'manual_backfill' AND field = 'f1' AND file_id IN (SELECT file_id FROM new)) UNION ALL SELECT * FROM new""",
)
def _(spark, d):
    return e.backfill(*_sheet(spark, d), skipped=["serial_number"])


_SIX = ["file_id", "target_table", "stock_code", "report_year", "field", "extract_method"]
_LINEAGE = """WITH l AS (SELECT l_orderkey AS file_id, CASE WHEN l_linenumber % 2 = 0 THEN 'balance_sheet' ELSE 'income_sheet' END AS target_table, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(year(l_shipdate) AS INT) AS report_year, 'f' || l_linenumber AS field, l_returnflag AS extract_method, l_quantity AS value FROM lineitem),
  one AS (SELECT file_id, target_table, stock_code, report_year, field, extract_method, max(value) AS value FROM l GROUP BY ALL), src AS (SELECT file_id, target_table, stock_code, CASE WHEN extract_method = 'N' THEN report_year + 1 ELSE report_year END AS report_year, field, extract_method, value + 1 AS value FROM one)"""


@query("load_lineage_upsert", f"{_LINEAGE} SELECT * FROM src UNION ALL SELECT o.* FROM one o ANTI JOIN src s USING (file_id, target_table, stock_code, report_year, field, extract_method)")
def _(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.when(n % 2 == 0, "balance_sheet").otherwise("income_sheet").alias("target_table"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.year("l_shipdate").alias("report_year"), F.concat(F.lit("f"), n.cast("string")).alias("field"), F.col("l_returnflag").alias("extract_method"), F.col("l_quantity").alias("value"),
    )
    one = rows.groupBy(*_SIX).agg(F.max("value").alias("value"))
    later = F.when(F.col("extract_method") == "N", F.col("report_year") + 1).otherwise(F.col("report_year"))
    return load.upsert(one, one.withColumns({"report_year": later, "value": F.col("value") + 1}), _SIX)
