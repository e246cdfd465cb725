"""Operators that change stored tables, over plain files: each takes the target and returns its next state.

Rows are matched by key joins, never collected; `store` writes a state and swaps it in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import period_role

#: Order of periods and of extraction methods, and fields that never take a previous period's value.
PERIOD_ORDER = {"Q1": 1, "HY": 2, "Q3": 3, "FY": 4}
METHOD_ORDER = {"manual": 0, "rule": 1, "rule_candidate_fill": 2}
STRICT_CURRENT = ("asset_total_assets", "liability_total_liabilities", "equity_total_equity", "liability_and_equity_total")


def latest(source: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (DISTINCT ON)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return source.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of source replace those of target with the same key; columns that source lacks keep target's values. source
    holds a key once."""
    lacking = [c for c in target.columns if c not in source.columns]
    new = source.join(target.select(*key, *lacking), list(key), "left") if lacking else source
    return target.join(source.select(*key), list(key), "left_anti").unionByName(new.select(*target.columns))


def insert_ignore(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of source whose key target lacks are added."""
    return target.unionByName(source.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def delete_keys(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key).distinct(), list(key), "left_anti")


def delete_stale(target: DataFrame, scope: DataFrame, selected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys in scope that weren't selected this time are deleted."""
    stale = scope.select(*key).distinct().join(selected.select(*key), list(key), "left_anti")
    return delete_keys(target, stale, key)


def replace_slice(target: DataFrame, source: DataFrame, by: Sequence[str]) -> DataFrame:
    """All rows of target that share `by` with source give way to source."""
    return target.join(source.select(*by).distinct(), list(by), "left_anti").unionByName(source.select(*target.columns))


def partial_update(target: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values of changes that aren't null overwrite target's."""
    new = [c for c in changes.columns if c not in key]
    moved = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in new])
    return target.join(moved, list(key), "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else c for c in target.columns])


def period_order(c: Column) -> Column:
    from ledgerline.functions.text import lookup

    return F.coalesce(lookup(c, PERIOD_ORDER), F.lit(99))


def numbered(table: DataFrame, key: Sequence[str], column: str = "serial_number", order: Sequence[Column] | None = None, letters: int = 3) -> DataFrame:
    """table with a gapless serial in the order of key. Rows are counted by the first `letters` letters of the first key
    column; the prefixes, not the rows, are ordered in one task, and positions are found inside each prefix."""
    part = F.coalesce(F.substring(F.col(key[0]).cast("string"), 1, letters), F.lit(""))
    rows = table.withColumn("__part", part)
    sizes = rows.groupBy("__part").count()
    ahead = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    own = Window.partitionBy("__part").orderBy(*(order or [F.col(k) for k in key]))
    out = rows.withColumn("__n", F.row_number().over(own)).join(ahead, "__part")
    return out.withColumn(column, (F.col("__n") + F.col("__ahead")).cast("long")).select(*dict.fromkeys([*table.columns, column]))


def renumber(table: DataFrame, column: str = "serial_number") -> DataFrame:
    """A gapless serial in the order of code, year and period."""
    return numbered(table, ["stock_code"], column, [F.col("stock_code"), F.col("report_year"), period_order(F.col("report_period"))])


def method_order(c: Column) -> Column:
    from ledgerline.functions.text import lookup

    return F.coalesce(lookup(c, METHOD_ORDER), F.lit(999))


def priority() -> list[Column]:
    """The total order of candidates: full reports before summaries, consolidated first, parent-only last, then method,
    confidences and the file."""
    off = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return [
        off("is_summary").asc(),
        (1 - off("is_consolidated")).asc(),
        off("is_parent_only").asc(),
        method_order(F.col("extract_method")).asc(),
        F.coalesce(F.col("confidence"), F.lit(0.0)).desc(),
        F.coalesce(F.col("locator_confidence"), F.lit(0.0)).desc(),
        F.col("file_id").asc(),
    ]


def select_candidates(candidates: DataFrame, key: Sequence[str], field: str = "field", amounts_of: str = "balance_sheet") -> DataFrame:
    """One candidate a key and field. For amounts of the balance sheet the current period beats an unknown, and an unknown a
    previous one, which strict fields never take and which caps the confidence at 0.3."""
    ranked, role = F.col("target_table") == amounts_of, F.col("period_role")
    rows = candidates.withColumn("period_role", period_role(F.col("source_column_role"), F.col("source_text")))
    strict = F.coalesce(F.col(field).isin(*STRICT_CURRENT), F.lit(False))
    # what may not be taken comes last and goes after the choice: a filter before it would judge the role twice
    order = F.when(ranked, F.when(role == "current", 0).when(role == "unknown", 1).when(strict, 3).otherwise(2)).otherwise(0)
    best = latest(rows.withColumn("__r", order), [*key, field], [F.col("__r").asc(), *priority()]).where("__r < 3")
    late = ranked & (F.col("period_role") == "previous")
    risk = F.when(late, "previous_period_used_without_current_candidate").when(ranked & (F.col("period_role") == "unknown"), "unknown_period_role_no_current_candidate").otherwise("")
    return best.withColumn("risk_flag", risk).withColumn("confidence", F.when(late, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.3))).otherwise(F.col("confidence"))).drop("__r")


def stage_of(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """rule, candidate_fill or needs_rerank, from the best confidence and its gap to the second."""
    w = Window.partitionBy(*key).orderBy(F.col("confidence").desc(), F.col("file_id").asc())
    rows = candidates.withColumns({"second": F.lead("confidence").over(w), "__n": F.row_number().over(w)}).where("__n = 1")
    gap = F.round(F.col("confidence") - F.coalesce("second", F.lit(0.0)), 4)
    stage = F.when((F.col("confidence") >= 0.82) & (gap >= 0.06), "rule").when((F.col("confidence") >= 0.68) & (gap >= 0.12), "candidate_fill").otherwise("needs_rerank")
    return rows.select(*key, F.col("confidence").alias("top_confidence"), gap.alias("gap"), stage.alias("stage"))


def assemble(selected: DataFrame, key: Sequence[str], fields: Sequence[str], field: str = "field", value: str = "value") -> DataFrame:
    """Field rows to one wide record a key. The fields are named, so no pass is spent on finding them."""
    return selected.groupBy(*key).pivot(field, list(fields)).agg(F.first(value, ignorenulls=True))


def rebuild(selected: DataFrame, key: Sequence[str], fields: Sequence[str], field: str = "field", value: str = "value") -> DataFrame:
    """A fact table made anew from all selected candidates: one wide record a key, numbered in the order of code, year and period."""
    return renumber(assemble(selected, key, fields, field, value))


def insert_missing_definitions(dictionary: DataFrame, extra: DataFrame) -> DataFrame:
    """Field definitions that the dictionary lacks are appended."""
    return insert_ignore(dictionary, extra, ["field_code"])


def store(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table; with partitions, only those that table holds are replaced."""
    w = table.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)
