"""Order-dependent operators: runs, neighbours, clusters, top rows of groups, summaries of ranked rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ledgerline.functions.metrics import safe_divide


def run_after(rows: DataFrame, group: Sequence[str], order: Sequence[str], start: Column, goes_on: Column, cap: int = 3) -> DataFrame:
    """For each row where start holds, how many of the next rows, up to cap, go on without a break."""
    w = Window.partitionBy(*group).orderBy(*order)
    length = F.lit(0)
    alive = F.lit(True)
    for k in range(1, cap + 1):
        alive = alive & F.coalesce(F.lead(goes_on, k).over(w), F.lit(False))
        length = length + F.when(alive, 1).otherwise(0)
    return rows.withColumns({"__start": start, "run_length": length}).where("__start").drop("__start")


def top_of_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def ranked_summary(ranked: DataFrame, value: str, position: str = "position") -> DataFrame:
    """Of ranked rows: average, first, second, their gap in value and percent, and signs."""
    v = F.col(value).cast("double")
    at = lambda k: F.max(F.when(F.col(position) == k, v))
    agg = ranked.agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("average"), at(1).alias("first"), at(2).alias("second"), F.count(F.when(v > 0, 1)).alias("positive"), F.count(F.when(v < 0, 1)).alias("negative"))
    gap = F.col("first") - F.col("second")
    return agg.withColumns({"gap": F.round(gap, 4), "gap_pct": F.round(safe_divide(gap, F.abs("second")) * 100, 2)})


def truncated(rows: DataFrame, order: Sequence[Column], cap: int = 50) -> DataFrame:
    """The first cap rows with a flag that more exist: one row more is asked for, none is counted."""
    w = Window.orderBy(*order)
    top = rows.orderBy(*order).limit(cap + 1).withColumns({"__n": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy()) > cap})
    return top.where(F.col("__n") <= cap).drop("__n")


def concat_keep_first(frames: Sequence[DataFrame], key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of all frames, of each key the first: earlier frames win, then the order given."""
    both = None
    for k, f in enumerate(frames):
        f = f.withColumn("__from", F.lit(k))
        both = f if both is None else both.unionByName(f)
    w = Window.partitionBy(*key).orderBy("__from", *order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__from")


def merge_labels(rows: DataFrame, page: Sequence[str], order: str, label: str, value: str) -> DataFrame:
    """A row without a value completes the label of the row below it on its page, if that has one, and gives way to it. Such
    a row never completes two, and one that was completed has a value, so neighbours decide it alone."""
    w = Window.partitionBy(*page).orderBy(order)
    rows = rows.withColumns({"__above": F.lag(F.col(value).isNull()).over(w), "__label": F.lag(label).over(w), "__below": F.lead(F.col(value).isNotNull()).over(w)})
    gone = F.col(value).isNull() & F.coalesce("__below", F.lit(False))
    both = F.concat(F.coalesce("__label", F.lit("")), F.coalesce(label, F.lit("")))
    return rows.where(~gone).withColumn(label, F.when(F.col(value).isNotNull() & F.coalesce("__above", F.lit(False)), both).otherwise(F.col(label))).drop("__above", "__label", "__below")


def cluster_lines(tokens: DataFrame, page: Sequence[str], at: str, tolerance: float) -> DataFrame:
    """tokens with a cluster number by page: sorted by position, a token joins the running centre within tolerance. The centre
    depends on all tokens before, so rows are streamed in order; a task holds a batch of rows and one centre."""
    schema = StructType([*tokens.schema.fields, StructField("cluster", IntegerType())])
    keys = list(page)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, centre, n, k = None, None, 0, -1
        for rows in batches:
            out = []
            for where, x in zip(rows[keys].itertuples(index=False, name=None), rows[at].tolist()):
                if where != now:
                    now, centre, n, k = where, None, 0, -1
                if centre is None or abs(x - centre) > tolerance:
                    centre, n, k = x, 0, k + 1
                n += 1
                centre += (x - centre) / n
                out.append(k)
            yield rows.assign(cluster=pd.Series(out, index=rows.index, dtype="int32"))

    return tokens.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(number, schema)


def merge_page_breaks(rows: DataFrame, file: str = "file_id", page: str = "page_no", y: str = "y", item: str = "item", cells: str = "cells") -> DataFrame:
    """Rows that a page break cut in two made whole: the row takes the next page's first row in if that one has no name, or if
    itself has no amounts, or if both names are short and the second has no amounts. Names join, and amounts that the first lacks
    come from the second. A merged row is tried against the row after it, so rows are streamed in order; a task holds one row.
    cells: map of column to printed amount."""
    schema = rows.schema

    def torn(a: dict, b: dict) -> bool:
        if b[page] != a[page] + 1 or not a[item]:
            return False
        if b[cells]:
            return not b[item] or not a[cells]
        return bool(b[item]) and len(a[item]) <= 8 and len(b[item]) <= 12

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                row[item], row[cells] = row[item] or "", dict(row[cells] or {})
                if held is not None and held[file] == row[file] and torn(held, row):
                    held = {**held, item: held[item] + row[item], cells: {**row[cells], **{k: v for k, v in held[cells].items() if v}}}
                    continue
                if held is not None:
                    out.append(held)
                held = row
            yield pd.DataFrame(out, columns=batch.columns)
        if held is not None:
            yield pd.DataFrame([held])

    return rows.repartition(file).sortWithinPartitions(file, page, y).mapInPandas(joined, schema)


def repeated_lines(lines: DataFrame, group: str, unit: str, line: str) -> DataFrame:
    """Lines found on max(2, half of the units + 1) units of a group at least: headers and footers."""
    units = lines.groupBy(group).agg(F.countDistinct(unit).alias("units"))
    counts = lines.select(group, unit, line).distinct().groupBy(group, line).agg(F.count("*").alias("found_on"))
    least = F.greatest(F.lit(2), F.floor(F.col("units") / 2) + 1)
    return counts.join(units, group).where(F.col("found_on") >= least)


def first_nonempty(rows: DataFrame, key: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of equal key merged, each column's first value that isn't empty."""
    return rows.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))).alias(c) for c in columns])
