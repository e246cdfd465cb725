"""Data quality: identities, plausibility, coverage, lineage, and their reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.metrics import ladder, safe_divide
from ledgerline.functions.similarity import field_similarity
from ledgerline.functions.text import contains_any
from ledgerline.operators.marts import KEY

REASONS = ("validation_field_mapping_issue", "selected_but_not_loaded", "no_statement_json", "candidate_exists_but_not_selected", "no_candidate_found")


def diff_ratio(actual: Column, expected: Column) -> Column:
    """The difference over the larger magnitude; 0 if both are 0."""
    a, e = F.abs(actual.cast("double")), F.abs(expected.cast("double"))
    top = F.greatest(a, e)
    return F.when(actual.isNull() | expected.isNull(), None).when(top == 0, 0.0).otherwise(safe_divide(F.abs((actual - expected).cast("double")), top))


def _status(ratio: Column, optional: bool = False) -> Column:
    return F.when(ratio.isNull(), "warning").when(ratio <= 0.01, "warning" if optional else "passed").otherwise("failed")


def balance_identity(balance: DataFrame) -> DataFrame:
    """Assets against liabilities and equity: the stated total where there is one, unless only the sum of the parts agrees."""
    a, total = F.col("asset_total_assets"), F.col("liability_and_equity_total")
    split = F.col("liability_total_liabilities") + F.col("equity_total_equity")
    both = total.isNotNull() & split.isNotNull()
    agrees = lambda x: F.coalesce(diff_ratio(a, x) <= 0.01, F.lit(False))
    mode = ladder(
        (a.isNull() | (total.isNull() & split.isNull()), "skipped"), (both & agrees(split) & ~agrees(total), "fallback_to_parts"), (total.isNotNull(), "stated_total"), otherwise="sum_of_parts"
    )
    expected = F.when(mode == "stated_total", total).when(mode != "skipped", split)
    ratio = diff_ratio(a, expected)
    return balance.select(*KEY, a.alias("actual"), expected.alias("expected"), F.round(ratio, 6).alias("diff_ratio"), mode.alias("mode"), F.when(mode == "skipped", "skipped").otherwise(_status(ratio)).alias("status"))


def cash_identity(cash: DataFrame, fx: str | None = None) -> DataFrame:
    """Net cash flow against its three parts and the exchange effect. Without a column for that, agreement is a warning."""
    parts = [F.col(c) for c in ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount")]
    net = F.col("net_cash_flow")
    expected = parts[0] + parts[1] + parts[2] + (F.coalesce(F.col(fx), F.lit(0)) if fx else F.lit(0))
    gaps = parts[0].isNull() | parts[1].isNull() | parts[2].isNull() | net.isNull()
    ratio = diff_ratio(net, expected)
    return cash.select(*KEY, net.alias("actual"), expected.cast("decimal(28,2)").alias("expected"), F.round(ratio, 6).alias("diff_ratio"), F.when(gaps, "skipped").otherwise(_status(ratio, fx is None)).alias("status"))


def plausible_balance(balance: DataFrame) -> DataFrame:
    """Implausible amounts to null, with the reasons: assets under a component, liabilities over assets, equity under a
    hundredth of assets or equal to them."""
    a, liabilities, equity = F.col("asset_total_assets"), F.col("liability_total_liabilities"), F.col("equity_total_equity")
    parts = [F.col(c) for c in ("asset_inventory", "asset_cash_and_cash_equivalents", "asset_accounts_receivable") if c in balance.columns]
    bad_a = a < F.greatest(liabilities, equity, *parts) if parts else a < F.greatest(liabilities, equity)
    bad_l = liabilities > a
    tiny, same = (a > 0) & (F.abs(equity) < a * F.lit("0.01").cast("decimal(3,2)")), (a > 0) & (equity == a)
    no = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(
        F.array(F.when(no(bad_a), "assets_under_component"), F.when(no(bad_l), "liabilities_over_assets"), F.when(no(tiny), "equity_too_small"), F.when(no(same) & ~no(tiny), "equity_equals_assets"))
    )
    return balance.select(
        *KEY,
        F.when(~no(bad_a), a).alias("asset_total_assets"),
        F.when(~no(bad_l), liabilities).alias("liability_total_liabilities"),
        F.when(~no(tiny) & ~no(same), equity).alias("equity_total_equity"),
        F.concat_ws(",", reasons).alias("rejections"),
    )


def plausible_income(income: DataFrame) -> DataFrame:
    """A profit of a thousand at most beside a revenue of a hundred million is an ordinal, not a profit."""
    odd = F.coalesce((F.col("total_operating_revenue") >= 100_000_000) & (F.abs("net_profit") <= 1000), F.lit(False))
    return income.withColumn("net_profit", F.when(~odd, F.col("net_profit"))).withColumn("rejections", F.when(odd, "profit_too_small").otherwise(""))


def plausible_cash(cash: DataFrame) -> DataFrame:
    """Three equal net amounts are one value filled in thrice."""
    a, b, c = (F.col(x) for x in ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount"))
    odd = F.coalesce((a == b) & (b == c), F.lit(False))
    fixed = {x: F.when(~odd, F.col(x)) for x in ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount")}
    return cash.withColumns(fixed | {"rejections": F.when(odd, "three_equal_amounts").otherwise("")})


def unpivot(wide: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, field, value) of each field; values as double."""
    return wide.select(*key, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(key), list(fields), "field", "value")


def coverage(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected and filled counts, the fill rate, of (by, value)."""
    n, k = F.count("*"), F.count("value")
    return long.groupBy(*by).agg(n.alias("expected_count"), k.alias("non_null_count"), F.round(safe_divide(k, n), 6).alias("fill_rate"))


def indicator_sum(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many of all fields of all rows are filled, in one pass."""
    filled = sum((F.sum(F.col(f).isNotNull().cast("int")) for f in fields[1:]), F.sum(F.col(fields[0]).isNotNull().cast("int")))
    return wide.agg(F.count("*").alias("row_count"), filled.alias("filled"), (F.count("*") * len(fields)).alias("cells"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Value and count; null and empty are `unknown`."""
    v = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown"))
    return rows.groupBy(v.alias("value")).agg(F.count("*").alias("n"))


def missing_reasons(expected: DataFrame, key: Sequence[str], lineage: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """expected: (key, field, value, mapped). Each missing field with the first reason that applies. lineage and candidates:
    (key, field); pages: keys with a recovered statement."""
    flags = expected.where("value IS NULL")
    for name, rows, on in (("in_lineage", lineage, [*key, "field"]), ("in_pages", pages, list(key)), ("in_candidates", candidates, [*key, "field"])):
        flags = flags.join(rows.select(*on).distinct().withColumn(name, F.lit(True)), on, "left")
    reason = ladder(
        (~F.col("mapped"), REASONS[0]), (F.col("in_lineage").isNotNull(), REASONS[1]), (F.col("in_pages").isNull(), REASONS[2]), (F.col("in_candidates").isNotNull(), REASONS[3]), otherwise=REASONS[4]
    )
    return flags.select(*key, "field", reason.alias("reason"))


def funnel(expected: DataFrame, key: Sequence[str], lineage: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """By field: fill, lineage and recall rates, the count of each missing reason, and the most frequent one. All inputs
    meet in one aggregation by key and field, and fields in a second one."""
    on = [*key, "field"]
    e = expected.select(*on, F.lit(1).alias("e"), F.col("value").isNotNull().cast("int").alias("v"), "mapped", F.lit(0).alias("l"), F.lit(0).alias("c"))
    none = F.lit(None).cast("boolean").alias("mapped")
    li, ca = (x.select(*on, F.lit(0).alias("e"), F.lit(0).alias("v"), none, F.lit(a).alias("l"), F.lit(b).alias("c")) for x, a, b in ((lineage, 1, 0), (candidates, 0, 1)))
    met = e.union(li).union(ca).groupBy(*on).agg(*[F.sum(x).alias(x) for x in "evlc"], F.max("mapped").alias("mapped"))
    met = met.join(pages.select(*key).distinct().withColumn("p", F.lit(True)), list(key), "left")
    reason = ladder((~F.col("mapped"), REASONS[0]), (F.col("l") > 0, REASONS[1]), (F.col("p").isNull(), REASONS[2]), (F.col("c") > 0, REASONS[3]), otherwise=REASONS[4])
    gone = F.col("e") - F.col("v")
    counts = [F.sum(F.when(reason == r, gone).otherwise(0)).alias(r) for r in REASONS]
    out = met.groupBy("field").agg(
        F.sum("e").alias("expected_count"), F.sum("v").alias("non_null_count"), F.sum("l").alias("lineage_count"), F.sum("c").alias("candidate_count"), *counts
    ).where("expected_count > 0")
    # the most frequent reason, of equals the first by name
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(r)).alias("n"), F.lit(r).alias("r")) for r in REASONS]), lambda x: x["n"] < 0))
    out = out.withColumn("main_reason", F.get(ranked, 0)["r"])
    return out.withColumns(
        {
            "fill_rate": F.round(safe_divide(F.col("non_null_count"), F.col("expected_count")), 6),
            "lineage_coverage": F.round(F.coalesce(safe_divide(F.col("lineage_count"), F.col("non_null_count")), F.lit(0.0)), 6),
            "recall_rate": F.round(F.coalesce(safe_divide(F.col("candidate_count"), F.col("expected_count")), F.lit(0.0)), 6),
        }
    )


def expected_missing(dictionary: DataFrame, files: DataFrame, extracted: DataFrame) -> DataFrame:
    """(file, field) pairs of the dictionary that no extraction has. The dictionary, by its nature a short list, becomes one
    array that every file is exploded with, so no join makes the pairs; then an anti join."""
    fields = dictionary.agg(F.collect_set("field").alias("f")).scalar()
    pairs = files.select("file_id", F.explode(fields).alias("field"))
    return pairs.join(extracted.select("file_id", "field"), ["file_id", "field"], "left_anti")


def status_summary(results: DataFrame, by: str, statuses: Sequence[str]) -> DataFrame:
    """Counts by status with zeros."""
    return results.groupBy(by).pivot("status", list(statuses)).count().na.fill(0)


def run_delta(old: DataFrame, new: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """New less old of a count, keys of either run."""
    a = old.select(*by, F.col(value).alias("old_value"))
    b = new.select(*by, F.col(value).alias("new_value"))
    both = a.join(b, list(by), "full")
    o, n = F.coalesce("old_value", F.lit(0)), F.coalesce("new_value", F.lit(0))
    return both.select(*by, o.alias("old_value"), n.alias("new_value"), (n - o).alias("delta"))


def latest_provenance(lineage: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest lineage row of each key and field."""
    w = Window.partitionBy(*key, "field").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return lineage.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lineage_wide(lineage: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One column of provenance a field: a pivot in place of a self join a field."""
    return lineage.groupBy(*key).pivot("field", list(fields)).agg(F.max("source"))


def lineage_coverage(long: DataFrame, lineage: DataFrame, key: Sequence[str]) -> DataFrame:
    """Filled values that have provenance, by field."""
    known = lineage.select(*key, "field").distinct().withColumn("known", F.lit(1))
    rows = long.where("value IS NOT NULL").join(known, [*key, "field"], "left")
    return rows.groupBy("field").agg(F.count("*").alias("filled"), F.count("known").alias("with_lineage"), F.round(safe_divide(F.count("known"), F.count("*")), 6).alias("coverage"))


def issues(results: DataFrame) -> DataFrame:
    """What didn't pass, with its severity and what to do about it."""
    severity = F.when(F.col("status") == "failed", 1).when(F.col("status") == "warning", 2).otherwise(3)
    action = F.when(F.col("status") == "failed", "check_source_columns").when(F.col("status") == "warning", "confirm_fx_effect").otherwise("complete_fields")
    return results.where("status <> 'passed'").withColumns({"severity": severity, "action": action})


#: Words of a column's name.
EARLIER_WORDS, CURRENT_WORDS = ("期初", "上年", "上期", "年初"), ("期末", "本期", "本年")


def scope_conflicts(one: dict[str, Column], two: dict[str, Column]) -> Column:
    """Whether two values' sources contradict each other in any of the named marks; blanks contradict nothing."""
    said = lambda c: c.isNotNull() & (c.cast("string") != "")
    return reduce(lambda a, b: a | b, [F.coalesce(said(one[k]) & said(two[k]) & (one[k] != two[k]), F.lit(False)) for k in one])


def root_cause(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Why a balance identity fails, by the sources of its two sides: pairs holds the key and, for each side a and b, role,
    column (its printed name), table, consolidated, parent and value. The first rung that applies names the cause."""
    a, b = ({k: F.col(f"{side}_{k}") for k in ("role", "column", "table", "consolidated", "parent", "value")} for side in "ab")
    no = lambda c: F.coalesce(c, F.lit(False))
    says = lambda side, words: no(contains_any(side["column"], words))
    crossed = (says(a, EARLIER_WORDS) & says(b, CURRENT_WORDS)) | (says(a, CURRENT_WORDS) & says(b, EARLIER_WORDS))
    scoped = a["consolidated"].isNotNull() & a["parent"].isNotNull() & b["consolidated"].isNotNull() & b["parent"].isNotNull()
    cause = ladder(
        (a["role"].isNull() | a["column"].isNull() | b["role"].isNull() | b["column"].isNull(), "insufficient_lineage_diagnostics"),
        ((a["role"] != b["role"]) | crossed, "previous_period_column_mismatch"),
        (no(a["table"] != b["table"]), "mixed_statement_table"),
        (scoped & ((a["consolidated"] != b["consolidated"]) | (a["parent"] != b["parent"])), "mixed_consolidated_parent_scope"),
        (no(diff_ratio(a["value"], b["value"]) > 0.01), "possible_wrong_row_or_unit"),
        otherwise="insufficient_lineage_diagnostics",
    )
    conflict = scope_conflicts({k: a[k] for k in ("table", "consolidated", "parent", "role")}, {k: b[k] for k in ("table", "consolidated", "parent", "role")})
    return pairs.select(*key, cause.alias("cause"), conflict.alias("scope_conflict"))


def skip_reasons(balance: DataFrame) -> DataFrame:
    """How many balances can't be checked, by what they lack."""
    a, total = F.col("asset_total_assets"), F.col("liability_and_equity_total")
    parts = F.col("liability_total_liabilities").isNotNull() & F.col("equity_total_equity").isNotNull()
    reason = F.when(a.isNull(), "missing_assets").when(total.isNull() & ~parts, "missing_total_and_parts")
    return balance.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def listed_values(keys: DataFrame, table: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The fields of listed keys, null for a key that the table lacks; found tells which."""
    return keys.select(*key).distinct().join(table.select(*key, *fields, F.lit(True).alias("found")), list(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def mapping_audit(metrics: DataFrame, columns: DataFrame) -> DataFrame:
    """metrics (table, field, source_field, kind) with whether the table has the source field, else its most similar column
    from a similarity of 0.45 on, and what to do. columns: table, column. Names meet within a table, and each distinct pair is
    compared once."""
    known = columns.select("table", F.col("column").alias("source_field"), F.lit(True).alias("exists")).distinct()
    rows = metrics.join(known, ["table", "source_field"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    open_ = rows.where("NOT exists AND source_field IS NOT NULL").select("table", "source_field").distinct()
    likely = open_.join(columns, "table").withColumn("similarity", F.round(field_similarity(F.col("source_field"), F.col("column")), 6)).where("similarity >= 0.45")
    best = likely.groupBy("table", "source_field").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "column")).alias("b"))
    out = rows.join(best, ["table", "source_field"], "left").withColumns({"possible": F.col("b.column"), "similarity": -F.col("b.s")}).drop("b")
    action = (
        F.when(F.col("exists"), "").when(F.col("kind") == "not_supported_in_v1", "remove_from_v1_key_metrics").when(F.col("kind") == "add_column_required", "add_final_table_column")
        .when(F.col("kind") == "derived_metric", "mark_as_derived_metric").when(F.col("similarity") >= 0.55, "map_to_existing_field").otherwise("add_final_table_column")
    )
    return out.withColumn("action", action)
