"""Statement marts: a company dimension and three fact tables with the grain (stock_code, report_year, report_period)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["stock_code", "report_year", "report_period"]
PERIODS = ("Q1", "HY", "Q3", "FY")


@dataclass(frozen=True)
class Marts:
    """The four tables that queries run over. Any frames of the same columns will do."""

    dim: DataFrame
    income_sheet: DataFrame
    balance_sheet: DataFrame
    cash_flow_sheet: DataFrame

    def table(self, name: str, years: Sequence[int] | None = None) -> DataFrame:
        """A fact table, or its rows of these years."""
        return _of_years(getattr(self, name), years) if years else getattr(self, name)


class BuiltMarts(Marts):
    """Marts whose fact tables are planned when they are asked for. facts: for each table's name a function of its first and
    last year, or None for all; years are read by a range of dates."""

    def __init__(self, dim: DataFrame, facts: Mapping[str, Callable[[tuple[int, int] | None], DataFrame]]):
        object.__setattr__(self, "dim", dim)
        object.__setattr__(self, "facts", facts)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.__dict__.get("facts", ()):
            raise AttributeError(name)
        object.__setattr__(self, name, self.facts[name](None))
        return self.__dict__[name]

    def table(self, name: str, years: Sequence[int] | None = None) -> DataFrame:
        return _of_years(self.facts[name]((min(years), max(years))), years) if years else getattr(self, name)


def _of_years(rows: DataFrame, years: Sequence[int]) -> DataFrame:
    return rows.where(F.col("report_year").isin([int(y) for y in sorted(set(years))]))


def money(c: Column, digits: int = 2) -> Column:
    return c.cast(f"decimal(20,{digits})")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 6, "0")


def build(spark: SparkSession, sf_dir: str, grain: str = "nation", quarterly: bool = False) -> Marts:
    """Marts from the order tables. grain: `nation`, `supplier` (income and cash) or `customer` (balance). quarterly: cumulative
    Q1, HY, Q3 and FY records instead of FY alone."""
    read = functools.cache(lambda name: _table(spark, sf_dir, name))  # reading a table's schema takes a job
    key = {"nation": ("s_nationkey", "c_nationkey"), "supplier": ("s_suppkey", "c_nationkey"), "customer": ("s_nationkey", "c_custkey")}[grain]
    k, name = {"nation": ("n_nationkey", "n_name"), "supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name")}[grain]
    dim = read(grain).select(_code(k).alias("stock_code"), F.col(name).alias("stock_abbr"), F.concat(F.col(name), F.lit(" Holdings")).alias("company_name"))

    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")

    def lines(years: tuple[int, int] | None) -> DataFrame:
        rows = _dated(read("lineitem"), "l_shipdate", years).select(
            "l_suppkey",
            F.year("l_shipdate").alias("report_year"),
            F.month("l_shipdate").alias("m"),
            "l_returnflag",
            revenue.alias("rev"),
            (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)").alias("tax"),
        )
        if grain == "supplier":
            return rows.withColumn("stock_code", _code("l_suppkey"))
        return rows.join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey")), "l_suppkey").withColumn("stock_code", _code("s_nationkey"))

    def orders(years: tuple[int, int] | None) -> DataFrame:
        rows = _dated(read("orders"), "o_orderdate", years).select(
            "o_custkey", F.year("o_orderdate").alias("report_year"), F.month("o_orderdate").alias("m"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount")
        )
        if grain == "customer":
            return rows.withColumn("stock_code", _code("o_custkey"))
        return rows.join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey")), "o_custkey").withColumn("stock_code", _code("c_nationkey"))

    def by_period(df: DataFrame) -> DataFrame:
        if not quarterly:
            return df.withColumn("report_period", F.lit("FY"))
        first = F.when(F.col("m") <= 3, 0).when(F.col("m") <= 6, 1).when(F.col("m") <= 9, 2).otherwise(3)
        periods = F.array(*map(F.lit, PERIODS))
        return df.withColumn("report_period", F.explode(F.slice(periods, first + 1, F.lit(4) - first)))

    half = F.lit(0.5).cast("decimal(2,1)")
    rev = F.col("rev")
    flag = lambda f: F.when(F.col("l_returnflag") == f, rev)

    def income(years: tuple[int, int] | None = None) -> DataFrame:
        return by_period(lines(years)).groupBy(*KEY).agg(
            money(F.sum(rev)).alias("total_operating_revenue"),
            money(F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(rev * half))).alias("operating_profit"),
            money(F.sum(F.when(F.col("l_returnflag") == "R", -rev * 1).otherwise(rev * half))).alias("net_profit"),
            money(F.sum(flag("A"))).alias("operating_expense_cost_of_sales"),
        )

    def cash(years: tuple[int, int] | None = None) -> DataFrame:
        rows = by_period(lines(years)).groupBy(*KEY).agg(
            money(F.coalesce(F.sum(flag("N")), F.lit(0))).alias("operating_cf_net_amount"),
            money(-F.coalesce(F.sum(flag("R")), F.lit(0))).alias("investing_cf_net_amount"),
            money(-F.sum("tax")).alias("financing_cf_net_amount"),
        )
        total = F.col("operating_cf_net_amount") + F.col("investing_cf_net_amount") + F.col("financing_cf_net_amount")
        # every third record is off by a fiftieth, so that identities have something to find
        off = F.when((F.col("stock_code").cast("int") + F.col("report_year")) % 3 == 0, F.lit("1.02")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
        return rows.withColumn("net_cash_flow", money(total * off))

    def balance(years: tuple[int, int] | None = None) -> DataFrame:
        rows = by_period(orders(years)).groupBy(*KEY).agg(
            money(F.sum("amount")).alias("asset_total_assets"),
            money(F.sum(F.when(F.col("o_orderstatus") != "F", F.col("amount")))).alias("liability_total_liabilities"),
            money(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("amount")).otherwise(0))).alias("asset_inventory"),
        )
        return rows.withColumn("equity_total_equity", money(F.col("asset_total_assets") - F.col("liability_total_liabilities")))

    return BuiltMarts(dim, {"income_sheet": income, "balance_sheet": balance, "cash_flow_sheet": cash})


def _dated(rows: DataFrame, column: str, years: tuple[int, int] | None) -> DataFrame:
    """Rows of whole years, by a range that reaches the scan's statistics."""
    if years is None:
        return rows
    kind = rows.schema[column].dataType
    first, after = (F.lit(f"{y:04d}-01-01 00:00:00").cast(kind) for y in (years[0], years[1] + 1))
    return rows.where((F.col(column) >= first) & (F.col(column) < after))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of report files made of orders: each is a file about its customer's nation and year."""
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = _table(spark, sf_dir, "orders").join(customer, "o_custkey")
    return rows.select(
        F.col("o_orderkey").alias("file_id"),
        F.col("c_nationkey").cast("long").alias("company_id"),
        _code("c_nationkey").alias("stock_code"),
        F.year("o_orderdate").alias("report_year"),
        F.lit("FY").alias("report_period"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("parsed").alias("parse_status"),
    )


#: Columns of the mart that no fact table can fill.
UNFILLED = (
    "eps", "operating_revenue_qoq_growth", "net_profit_qoq_growth", "net_asset_per_share", "roe", "operating_cf_per_share", "net_profit_excl_non_recurring",
    "net_profit_excl_non_recurring_yoy", "roe_weighted_excl_non_recurring",
)


def core_performance(m: Marts, files: DataFrame) -> DataFrame:
    """One row a reported key: three facts in a full outer join, the smallest ids of the key's parsed files, guarded margins,
    growth against the same period of the year before in percent, amounts in ten thousands, a serial. files: (file_id,
    company_id, parse_status) and the key."""
    from pyspark.sql.window import Window

    from ledgerline.operators.load import numbered

    before = Window.partitionBy("stock_code", "report_period").orderBy("report_year")

    def growth(c: str) -> Column:
        last, year = F.lag(c).over(before), F.lag("report_year").over(before)
        moved = (F.col(c).cast("double") - last.cast("double")) / F.when(last != 0, F.abs(last.cast("double")))
        return F.when(year == F.col("report_year") - 1, F.round(moved * 100, 4))

    income = m.income_sheet.withColumns({"operating_revenue_yoy_growth": growth("total_operating_revenue"), "net_profit_yoy_growth": growth("net_profit")})
    facts = income.join(m.balance_sheet.select(*KEY, "equity_total_equity"), KEY, "full").join(m.cash_flow_sheet.select(*KEY, "operating_cf_net_amount"), KEY, "full")
    mapped = files.where("parse_status = 'parsed'").groupBy(*KEY).agg(F.min("file_id").alias("file_id"), F.min("company_id").alias("company_id"))
    named = numbered(facts, KEY).join(m.dim, "stock_code", "left").join(mapped, KEY, "left")
    revenue, profit, cost = F.col("total_operating_revenue"), F.col("net_profit"), F.col("operating_expense_cost_of_sales")
    margin = lambda part: F.round(part.cast("double") / F.when(revenue != 0, revenue.cast("double")), 4)
    return named.select(
        "file_id",
        "company_id",
        *KEY,
        "stock_abbr",
        "company_name",
        "serial_number",
        *[F.lit(None).cast("decimal(20,4)").alias(c) for c in UNFILLED],
        F.round(profit.cast("double") / 10000, 2).alias("net_profit_10k_yuan"),
        margin(revenue - cost).alias("gross_profit_margin"),
        margin(profit).alias("net_profit_margin"),
        "total_operating_revenue",
        "operating_revenue_yoy_growth",
        "net_profit_yoy_growth",
        "equity_total_equity",
        "operating_cf_net_amount",
    )
