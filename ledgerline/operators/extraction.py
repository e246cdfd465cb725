"""From recovered pages and tables to candidate values: page evidence, row and column choice, guardrails, tasks that stay open.

Rules (keywords, allow and deny lists, minima) are parameters: short Python mappings that become expressions. Facts are
DataFrames and meet by keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.metrics import ladder, safe_divide
from ledgerline.functions.similarity import row_match_score, sequence_ratio
from ledgerline.functions.text import compact_text, normalise_text

#: A printed number, roles of columns, methods whose values count, locator states that can be used.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
CURRENT, PREVIOUS = ("current_period", "ending_balance", "current_amount"), ("previous_period", "beginning_balance", "prior_period")
METHODS = ("rule", "rule_candidate_fill", "manual_backfill")
LOCATED, PARSED = ("success", "weak_match"), ("pending", "parsed")
MANUAL = "manual_backfill"


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in words])


def _one_holds(texts: Column, word: str) -> Column:
    return F.exists(texts, lambda x: F.contains(x, F.lit(word)))


def _count(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in tests], F.lit(0))


# --- pages -------------------------------------------------------------------------------------------------------------


def lines_of(text: Column) -> Column:
    """The lines of a page that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _numbers(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)))


def page_score(pages: DataFrame, strong: Sequence[str], weak: Sequence[str], rows: Sequence[str], summary: str = "摘要") -> DataFrame:
    """pages (text, title, header, is_consolidated, is_parent_only) with the parts of their score for a statement and its
    confidence: 60 for a strong title or 40 for a weak one, 4 for each of up to 8 numeric lines among the first 50, 5 for each
    row keyword, 8 for a consolidated statement, 6 for a header, less 12 for a parent's own and 8 for a summary."""
    text, title = compact_text(F.col("text")), compact_text(F.col("title"))
    compact = lambda words: ["".join(w.split()) for w in words]
    named = lambda words: _holds(title, compact(words)) | _holds(text, compact(words))
    numeric = F.size(F.filter(F.slice(lines_of(F.col("text")), 1, 50), lambda x: _numbers(x) >= 2))
    flag = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    parts = {
        "title_score": F.when(named(strong), 60.0).when(named(weak), 40.0).otherwise(0.0),
        "table_density_score": F.least(numeric, F.lit(8)) * 4.0,
        "financial_row_score": _count([F.contains(text, F.lit(w)) for w in rows]) * 5.0,
        "bonus": flag("is_consolidated", 8.0) + F.when(compact_text(F.col("header")) != "", 6.0).otherwise(0.0),
        "penalty": flag("is_parent_only", 12.0) + F.when(F.contains(text, F.lit(summary)), 8.0).otherwise(0.0),
    }
    scored = pages.withColumns(parts)
    score = F.col("title_score") + F.col("table_density_score") + F.col("financial_row_score") + F.col("bonus") - F.col("penalty")
    return scored.withColumn("score", score).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.col("score") / 100.0, F.lit(1.0))))


def page_layout(pages: DataFrame, titles: Sequence[str], headers: Sequence[str], rows: Sequence[str], restated: Sequence[str]) -> DataFrame:
    """pages (text) with where a statement seems to begin: late_title (a line that is a title, in the last two fifths or from
    line 55), dense_header (the top reads like the inside of a table), body_after_title, and restatement_penalty, 16 for each
    phrase of a restatement."""
    lines, text = lines_of(F.col("text")), compact_text(F.col("text"))
    with_lines = pages.withColumns({"__l": lines, "__c": F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", ""))})
    at = F.transform(F.col("__c"), lambda x, i: F.when(x.isin(*titles), i))
    last = F.array_max(at)
    n = F.size("__l")
    hints = lambda lines_: _count([_one_holds(lines_, w) for w in rows])
    dense = (
        (F.size(F.filter(F.slice("__c", 1, 12), lambda x: _holds(x, headers))) >= 1)
        & (F.size(F.filter(F.slice("__l", 1, 25), lambda x: _numbers(x) >= 2)) >= 3)
        & (hints(F.slice("__c", 1, 25)) >= 1)
    )
    out = with_lines.withColumn("__at", last)
    after_l, after_c = (F.slice(c, F.col("__at") + 2, F.greatest(n - F.col("__at") - 1, F.lit(0))) for c in ("__l", "__c"))
    body = (F.size(after_l) >= 8) & ((F.size(F.filter(F.slice(after_l, 1, 18), lambda x: _numbers(x) >= 1)) >= 2) | (hints(F.slice(after_c, 1, 20)) >= 1))
    known = F.col("__at").isNotNull()
    return out.withColumns(
        {
            "late_title": F.coalesce(known & ((F.col("__at") >= 55) | (F.col("__at") >= F.floor(n * 0.6))), F.lit(False)),
            "dense_header": dense,
            "body_after_title": F.when(known, body).otherwise(False),
            "restatement_penalty": _count([F.contains(text, F.lit(w)) for w in restated]) * 16.0,
        }
    ).drop("__l", "__c", "__at")


def company_fields(pages: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """pages (one row a file: its name and first pages) with stock_code (from the name, else labelled in the text), stock_abbr
    and company_name (the first line that ends like a company and isn't a title); null where a part isn't found."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), "　\xa0", "  ")
    own = F.regexp_extract(F.coalesce(F.col(name), F.lit("")), r"(?<!\d)(\d{6})(?!\d)", 1)
    said = F.regexp_extract(t, r"(?:公司代码|股票代码|证券代码)\s*[：: ]\s*(\d{6})", 1)
    abbr = F.regexp_extract(t, r"(?:公司简称|股票简称|证券简称)\s*[：:]\s*([^\n\r ]+)", 1)
    suffix, titles = ("股份有限公司", "有限责任公司", "有限公司"), ("年度报告", "半年度报告", "季度报告", "报告摘要", "公司代码", "公司简称")
    ends = lambda x: _any([F.endswith(x, F.lit(s)) for s in suffix])
    company = F.get(F.filter(lines_of(t), lambda x: ends(x) & ~_holds(x, titles)), 0)
    some = lambda c: F.when(c != "", c)
    return pages.withColumns({"stock_code": F.coalesce(some(own), some(said)), "stock_abbr": some(abbr), "company_name": company})


# --- rows and columns of recovered tables -------------------------------------------------------------------------------


def best_rows(rows: DataFrame, aliases: DataFrame, least: Mapping[str, float], otherwise: float = 68.0) -> DataFrame:
    """For each field the table rows whose name fits one of its aliases: (table_id, row_id, field, alias, variant, score,
    place). rows: table_id, row_id, variants (array of names); aliases: field, alias, position. Only the best alias and variant
    of a row count, and only from the field's minimum score on. Names repeat over reports: each distinct pair is compared
    once, and only those that neither are nor contain each other need the sequence comparison."""
    named = rows.select("table_id", "row_id", F.posexplode("variants").alias("at", "variant")).withColumn("v", compact_text(F.col("variant"))).where("v <> ''")
    wanted = aliases.withColumn("a", compact_text(F.col("alias"))).where("a <> ''")
    listed = wanted.agg(F.collect_set(F.struct("field", "alias", "a", "position")).alias("x")).scalar()  # a dictionary: short
    pairs = named.select("v").distinct().withColumn("x", F.explode(listed)).select("v", "x.*")
    bound = reduce(lambda c, kv: c.when(F.col("field") == kv[0], kv[1]), least.items(), F.when(F.lit(False), otherwise)).otherwise(otherwise)
    fitting = pairs.withColumn("score", row_match_score(F.col("a"), F.col("v"))).where(F.col("score") >= bound)
    met = named.join(fitting, "v")
    best = met.groupBy("table_id", "row_id", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "position", "at", "alias", "variant")).alias("b"))
    out = best.select("table_id", "row_id", "field", F.col("b.alias").alias("alias"), F.col("b.variant").alias("variant"), (-F.col("b.s")).alias("score"))
    w = Window.partitionBy("table_id", "field").orderBy(F.col("score").desc(), "row_id")
    return out.withColumn("place", F.row_number().over(w))


def suggestion_score(name: Column, line: Column, aliases: Column, keywords: Sequence[str]) -> Column:
    """How well a table row suggests itself as a new alias of a field, 0 to 1: 1 if it holds a known alias, else its best
    sequence ratio to one, or the share of keywords that it holds if that is more. aliases: one alias (callers take the
    maximum over a field's aliases)."""
    both = F.concat(normalise_text(name), normalise_text(line))
    alias = normalise_text(aliases)
    fit = F.when(alias == "", 0.0).when(F.contains(both, alias), 1.0).otherwise(sequence_ratio(alias, normalise_text(name)))
    share = _count([F.contains(both, F.lit(k)) for k in keywords]) / float(max(1, len(keywords)))
    return F.when(both == "", 0.0).otherwise(F.round(F.greatest(F.coalesce(fit, F.lit(0.0)), share), 6))


def choose_columns(columns: DataFrame, role: str, aliases: Sequence[str], requested: str | None = None, never: Sequence[str] = ("note", "index")) -> DataFrame:
    """(table_id, column_index, chosen_by) of the column to read: the one whose label is or holds the requested one, else the
    one of the role, else the first alias that fits a label; never a note or index column. columns: table_id, column_index,
    column_role, column_label."""
    label = compact_text(F.col("column_label"))
    want = "".join((requested or "").split())
    rank = F.when((label == want) | F.contains(label, F.lit(want)), 0) if want else F.when(F.lit(False), 0)
    rank = rank.when(F.col("column_role") == role, 1)
    for k, alias in enumerate("".join(a.split()) for a in aliases):
        rank = rank.when(F.contains(label, F.lit(alias)) | ((label != "") & F.contains(F.lit(alias), label)), 2 + k)
    usable = columns.where(~F.coalesce(F.col("column_role").isin(*never), F.lit(False))).withColumn("rank", rank).where("rank IS NOT NULL")
    best = usable.groupBy("table_id").agg(F.min(F.struct("rank", "column_index")).alias("b"))
    by = F.when(F.col("b.rank") == 0, "requested").when(F.col("b.rank") == 1, "role").otherwise("alias")
    return best.select("table_id", F.col("b.column_index").alias("column_index"), by.alias("chosen_by"))


def rank_candidates(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """candidates (score, source_column_role, locator_confidence, file_id) with their confidence, between a half and 0.99, and
    their rank: confidence first, then the current period's column, the locator's confidence, the file."""
    confidence = F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.col("score") / 100.0))
    w = Window.partitionBy(*key).orderBy(
        F.col("confidence").desc(), (F.coalesce(F.col("source_column_role"), F.lit("")) != "current_period").cast("int"), F.coalesce("locator_confidence", F.lit(0.0)).desc(), "file_id"
    )
    ranked = candidates.withColumn("confidence", confidence).withColumn("candidate_rank", F.row_number().over(w))
    return ranked.withColumn("candidate_score", F.round("confidence", 4))


# --- joins with the locator ----------------------------------------------------------------------------------------------


def statement_tasks(files: DataFrame, locator: DataFrame) -> DataFrame:
    """Statements to recover: files that wait or are parsed, joined to what the locator found, with the page to end at: the
    guess, else the locator's end, else the start."""
    open_ = files.where(F.coalesce("parse_status", F.lit("pending")).isin(*PARSED)).drop("parse_status")
    found = locator.where(F.col("page_start").isNotNull() & F.col("locator_status").isin(*LOCATED))
    return open_.join(found, "file_id").withColumn("end_page", F.coalesce("end_page_guess", "page_end", "page_start")).drop("end_page_guess", "page_end")


def extract_results(candidates: DataFrame, files: DataFrame, locator: DataFrame) -> DataFrame:
    """Candidates by a known method with a field and a value, with their file and, by file and statement, what the locator said."""
    filled = candidates.where(F.col("extract_method").isin(*METHODS) & (F.coalesce("field", F.lit("")) != "") & (F.coalesce("value_text", F.lit("")) != ""))
    said = locator.select("file_id", F.col("statement_type").alias("target_table"), "locator_confidence", "is_consolidated", "is_parent_only")
    out = filled.join(files, "file_id").join(said, ["file_id", "target_table"], "left")
    return out.withColumns(
        {
            "locator_confidence": F.coalesce("locator_confidence", F.lit(0.0)),
            "is_consolidated": F.coalesce("is_consolidated", F.lit(False)),
            "is_parent_only": F.coalesce("is_parent_only", F.lit(False)),
        }
    )


def merge_by_year(results: Sequence[DataFrame], year: str = "report_year") -> DataFrame:
    """Several results side by side, a row a year that any of them has. Each holds a year once; of columns that several have
    the last one's value counts, and where it is null an earlier one's."""
    named = [r.where(F.col(year).isNotNull()).select(year, *[F.col(c).alias(f"__{k}_{c}") for c in r.columns if c != year]) for k, r in enumerate(results)]
    both = reduce(lambda a, b: a.join(b, year, "full"), named)
    columns = dict.fromkeys(c for r in results for c in r.columns if c != year)
    latest = lambda c: F.coalesce(*[F.col(f"__{k}_{c}") for k in reversed(range(len(results))) if c in results[k].columns])
    return both.select(year, *[latest(c).alias(c) for c in columns])


# --- what a value must not be --------------------------------------------------------------------------------------------


def guardrail(field: Column, texts: Sequence[Column], allow: Mapping[str, Sequence[str]], deny: Mapping[str, Sequence[str]], foreign: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Why a candidate of a field can't stand, or ok: words of another statement (foreign), denied words, none of the allowed
    words; not_configured for a field without rules."""
    compact = [compact_text(t) for t in texts]
    says = lambda words: _any([_holds(t, words) for t in compact])
    steps = [((field == f) & says(w), "high_risk_reject_cross_statement_pollution") for f, w in (foreign or {}).items()]
    steps += [((field == f) & says(w), "semantic_deny_token") for f, w in deny.items()]
    steps += [((field == f) & ~says(w), "semantic_allow_token_missing") for f, w in allow.items()]
    known = field.isin(*dict.fromkeys([*allow, *deny])) if allow or deny else F.lit(False)
    return ladder(*steps, (~known, "not_configured"))


def suspicious_equity(candidates: DataFrame, key: Sequence[str], explicit: Sequence[str] = ()) -> DataFrame:
    """Equity candidates under a hundredth of the report's largest assets, or equal to them without a row name that says
    equity, get a risk flag and a confidence of 0.49 at most. One window over a report; candidates: key, field, value, confidence,
    row_name."""
    top = F.max(F.when(F.col("field") == "asset_total_assets", F.col("value"))).over(Window.partitionBy(*key))
    rows = candidates.withColumn("__top", top)
    equity = (F.col("field") == "equity_total_equity") & F.col("value").isNotNull() & (F.col("__top") > 0)
    small = equity & (F.abs("value") < F.col("__top") * F.lit("0.01").cast("decimal(3,2)"))
    same = equity & (F.col("value") == F.col("__top")) & ~_holds(compact_text(F.col("row_name")), explicit)
    flag = F.when(same, "suspicious_equal_asset_total").when(small, "suspicious_too_small").otherwise("")
    return rows.withColumn("risk_flag", F.coalesce(flag, F.lit(""))).withColumn("confidence", F.when(F.col("risk_flag") != "", F.least("confidence", F.lit(0.49))).otherwise(F.col("confidence"))).drop("__top")


def same_section(candidates: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Totals from the part of the table where the best candidate of the assets stands: of the fields' candidates those on
    rows above it go, unless no others are there. candidates: key, field, row_id, confidence, source_column_role, file_id."""
    own = Window.partitionBy(*key)
    first = F.struct((-F.col("confidence")).alias("c"), (F.coalesce("source_column_role", F.lit("")) != "current_period").alias("r"), "file_id", "row_id")
    rows = candidates.withColumn("__at", F.min(F.when(F.col("field") == "asset_total_assets", first)).over(own)["row_id"])
    below = F.col("row_id").isNull() | F.col("__at").isNull() | (F.col("row_id") >= F.col("__at"))
    some = F.max(below.cast("int")).over(Window.partitionBy(*key, "field")) == 1
    return rows.withColumns({"__below": below, "__some": some}).where(~F.col("field").isin(*fields) | F.col("__below") | ~F.col("__some")).drop("__at", "__below", "__some")


# --- what stays open -----------------------------------------------------------------------------------------------------


def missing_tasks(expected: DataFrame, results: DataFrame, hints: DataFrame) -> DataFrame:
    """Fields of a file and statement without a value by any method: (file_id, statement_type, field) with the best hint.
    expected: those three; results: those three, extract_method, value_text; hints: those three, page, text, score."""
    on = ["file_id", "statement_type", "field"]
    filled = results.where(F.col("extract_method").isin(*METHODS) & (normalise_text(F.col("value_text")) != "")).select(*on)
    best = hints.groupBy(*on).agg(F.min_by(F.struct("page", "text"), F.struct((-F.col("score")).alias("s"), "page", "text")).alias("h"))
    return expected.select(*on).distinct().join(filled, on, "left_anti").join(best, on, "left").select(*on, F.col("h.page").alias("page_hint"), F.col("h.text").alias("text_hint"))


def task_counts(tasks: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Missing fields by statement, and the n files with the most of them."""
    by_statement = tasks.groupBy("statement_type").agg(F.count("*").alias("missing_fields"))
    by_file = tasks.groupBy("file_id").agg(F.count("*").alias("missing_fields")).orderBy(F.col("missing_fields").desc(), "file_id").limit(n)
    return by_statement, by_file


def coverage_report(expected: DataFrame, hits: DataFrame, key: Sequence[str], groups: Sequence[Sequence[str]]) -> DataFrame:
    """Expected, hit and missing counts, rate and average confidence of the hits, for several groupings in one pass; columns
    that a grouping lacks are null, and level says which it is. hits: key and confidence, of a key the best one counts."""
    best = hits.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    rows = expected.join(best, list(key), "left")
    columns = list(dict.fromkeys(c for g in groups for c in g))
    tagged = rows.select("confidence", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in g else F.lit(None)).cast("string").alias(c) for c in columns]) for k, g in enumerate(groups)])).alias("g"))
    n, hit = F.count("*"), F.count("confidence")
    average = F.round(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.when(hit > 0, hit), 4)
    out = tagged.select("confidence", "g.*").groupBy("level", *columns)
    return out.agg(n.alias("expected"), hit.alias("hit"), (n - hit).alias("missing"), F.round(safe_divide(hit, n), 4).alias("coverage_rate"), F.coalesce(average, F.lit(0.0)).alias("avg_confidence"))


def rejection_reasons(candidates: DataFrame, finals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Why candidates of a key didn't become its value. candidates: key, column_role, warning; finals: key, value, has_lineage."""
    met = candidates.groupBy(*key).agg(
        F.count("*").alias("candidates"),
        F.bool_or(F.coalesce(F.col("column_role").isin(*CURRENT), F.lit(False))).alias("current"),
        F.bool_and(F.coalesce(F.col("column_role").isin(*PREVIOUS), F.lit(False))).alias("previous"),
        F.bool_or(F.coalesce(F.col("warning") == "only_non_target_column_role", F.lit(False))).alias("odd"),
    )
    rows = met.join(finals, list(key), "left")
    reason = ladder(
        (F.col("value").isNotNull(), "final_value_present_not_rejected"),
        (F.coalesce("has_lineage", F.lit(False)), "selected_but_removed_by_validation"),
        (F.col("previous"), "previous_period_only_candidate"),
        (F.col("current") & F.col("odd"), "current_candidate_with_column_role_warning"),
        (F.col("current"), "current_candidate_not_selected_or_loader_validation_rejected"),
        (F.col("odd"), "candidate_column_role_unstable"),
        otherwise="candidate_not_selected_unknown",
    )
    return rows.select(*key, "candidates", reason.alias("reason"))


#: Words that point at a parent company's own statement, or at a previous period's column.
PARENT, EARLIER = ("母公司", '"is_parent_only": true'), ("column_role=previous_period", '"source_column_role": "previous_period"', '"column_role": "previous_period"', "期初", "上期", "上年", "年初")


def suspected_reasons(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """cases (case_id, assets, total: liabilities and equity) of failed balance identities with the sorted reasons that their
    fields' sources suggest, or unclassified. sources: case_id, field, page, lineage_found, source_text, risk_flag, is_parent_only."""
    text = F.lower(F.coalesce("source_text", F.lit("")))
    found = F.coalesce("lineage_found", F.lit(False))
    met = sources.groupBy("case_id").agg(
        (F.min(F.when(found, F.col("page"))) != F.max(F.when(found, F.col("page")))).alias("pages"),
        F.bool_or(found & (text == "")).alias("blank"),
        F.collect_set(F.when(F.col("risk_flag") != "", F.col("risk_flag"))).alias("flags"),
        F.bool_or(_holds(text, PARENT) | F.coalesce("is_parent_only", F.lit(False))).alias("parent"),
        F.bool_or(_holds(text, EARLIER)).alias("earlier"),
        F.bool_or(found & (F.col("field") == "liability_and_equity_total")).alias("stated"),
    )
    a, b = F.abs("assets"), F.abs("total")
    off = F.abs(F.col("assets") - F.col("total")) > F.greatest(a, b) * F.lit("0.01").cast("decimal(3,2)")
    tests = [
        ("pages", "possible_mixed_statement_pages"),
        ("blank", "missing_lineage_source_text"),
        ("parent", "possible_parent_company_statement"),
        ("earlier", "possible_previous_period_column"),
    ]
    no = lambda c: F.coalesce(c, F.lit(False))
    reasons = [F.when(no(F.col(c)), r) for c, r in tests]
    reasons += [F.when(F.col("total").isNull() | ~no(F.col("stated")), "missing_liability_and_equity_total"), F.when(no(off) & (F.greatest(a, b) > 0), "possible_wrong_row_or_unit")]
    rows = cases.join(met, "case_id", "left")
    all_ = F.sort_array(F.array_distinct(F.array_compact(F.concat(F.array(*reasons), F.coalesce("flags", F.array().cast("array<string>"))))))
    return rows.select("case_id", F.when(F.size(all_) > 0, F.concat_ws(",", all_)).otherwise("unclassified").alias("reasons"))


# --- manual values -------------------------------------------------------------------------------------------------------


def check_backfill(rows: DataFrame, required: Sequence[str] = ("file_id", "target_table", "field"), skipped: Sequence[str] = ()) -> DataFrame:
    """rows (text columns as read from a sheet) with why each can't be taken, or an empty reason: a required column is empty,
    the file's number isn't one, the field is one of those never filled by hand, there is no value."""
    name = F.element_at(F.split(normalise_text(F.col("field")), r"\.", 2), -1)
    steps = [(normalise_text(F.col(c)) == "", f"missing_{c}") for c in required]
    steps += [(normalise_text(F.col("file_id")).try_cast("bigint").isNull(), "bad_file_id"), (name.isin(*skipped) if skipped else F.lit(False), "metadata_field"), (normalise_text(F.col("manual_value")) == "", "empty_value")]
    return rows.withColumn("reason", ladder(*steps, otherwise=""))


def backfill(results: DataFrame, rows: DataFrame, skipped: Sequence[str] = ()) -> DataFrame:
    """results (file_id, target_table, field, extract_method, value_text) with the sound rows of a sheet (line_no, manual_value)
    in place of earlier manual ones of the same file, table and field; of equal keys the last line counts. Running it again
    changes nothing."""
    on = ["file_id", "target_table", "field"]
    sound = check_backfill(rows, skipped=skipped).where("reason = ''").select(
        normalise_text(F.col("file_id")).try_cast("bigint").alias("file_id"), normalise_text(F.col("target_table")).alias("target_table"), normalise_text(F.col("field")).alias("field"), "line_no", normalise_text(F.col("manual_value")).alias("value_text")
    )
    new = sound.groupBy(*on).agg(F.max_by("value_text", "line_no").alias("value_text")).withColumn("extract_method", F.lit(MANUAL))
    gone = new.select(*on, F.lit(MANUAL).alias("extract_method"))
    return results.join(gone, [*on, "extract_method"], "left_anti").unionByName(new.select(*results.columns))
