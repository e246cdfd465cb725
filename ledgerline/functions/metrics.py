"""Metric registry and the guarded arithmetic that every query shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Base:
    table: str
    field: str
    unit: str = "yuan"

    @property
    def alias(self) -> str:
        return f"{self.table}__{self.field}"


@dataclass(frozen=True)
class Derived:
    numerator: str
    denominator: str
    unit: str = "percent"
    scale: int = 100
    precision: int = 2


def _base(table: str, *fields: str) -> dict[str, Base]:
    return {f: Base(table, f) for f in fields}


#: The registered metrics.
BASE: dict[str, Base] = (
    _base("income_sheet", "total_operating_revenue", "operating_profit", "total_profit", "net_profit")
    | _base(
        "balance_sheet",
        "asset_total_assets",
        "liability_total_liabilities",
        "equity_total_equity",
        "liability_and_equity_total",
        "asset_cash_and_cash_equivalents",
        "asset_accounts_receivable",
        "asset_inventory",
    )
    | _base("cash_flow_sheet", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_cash_flow")
)
DERIVED: dict[str, Derived] = {
    "debt_to_asset_ratio": Derived("liability_total_liabilities", "asset_total_assets"),
    "net_profit_margin": Derived("net_profit", "total_operating_revenue"),
    "roe": Derived("net_profit", "equity_total_equity"),
    "roa": Derived("net_profit", "asset_total_assets"),
    "operating_cf_to_net_profit": Derived("operating_cf_net_amount", "net_profit", unit="ratio", scale=1),
}


def audit_registry(base: dict[str, Base] = BASE, derived: dict[str, Derived] = DERIVED) -> list[tuple[str, str]]:
    """(metric, problem) of derived metrics whose operands aren't base metrics."""
    found = []
    for key, d in derived.items():
        for operand in (d.numerator, d.denominator):
            if operand in derived:
                found.append((key, f"derived_operand:{operand}"))
            elif operand not in base:
                found.append((key, f"unknown_operand:{operand}"))
    return found


def safe_divide(num: Column, den: Column) -> Column:
    """num / den in double precision, null where den is null or 0."""
    d = den.cast("double")
    return num.cast("double") / F.when(d != 0, d)


def fraction(num: Column, den: Column, digits: int = 8) -> Column:
    """A ratio as queries compare and sort it."""
    return F.round(safe_divide(num, den), digits)


def derived_value(metric: Derived, num: Column, den: Column) -> Column:
    """A ratio as results show it: scaled and rounded."""
    return F.round(safe_divide(num, den) * metric.scale, metric.precision)


def change(cur: Column, prev: Column, digits: int = 2) -> Column:
    return F.round(cur.cast("double") - prev.cast("double"), digits)


def yoy_rate(cur: Column, prev: Column, signed: bool = False) -> Column:
    """Rounded change over the previous value's magnitude; rankings divide by the signed value, unrounded change."""
    if signed:
        return safe_divide(cur.cast("double") - prev.cast("double"), prev)
    return F.round(safe_divide(change(cur, prev), F.abs(prev.cast("double"))), 4)


def ladder(*steps: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The first step whose condition holds names the status."""
    out = None
    for condition, status in steps:
        out = F.when(condition, status) if out is None else out.when(condition, status)
    return out.otherwise(otherwise)


def ratio_status(present: Column, num: Column, den: Column) -> Column:
    return ladder(
        (~present, "missing_record"),
        (num.isNull(), "empty_numerator"),
        (den.isNull(), "empty_denominator"),
        (den == 0, "zero_denominator"),
    )


def yoy_status(cur_present: Column, cur: Column, prev_present: Column, prev: Column) -> Column:
    return ladder(
        (~cur_present, "missing_current_year"),
        (cur.isNull(), "empty_current_value"),
        (~prev_present, "missing_previous_year"),
        (prev.isNull(), "empty_previous_value"),
        (prev == 0, "zero_previous_value"),
    )


def derived_yoy_status(cur_present: Column, prev_present: Column, cn: Column, pn: Column, cd: Column, pd: Column) -> Column:
    return ladder(
        (~cur_present, "missing_current_year"),
        (~prev_present, "missing_previous_year"),
        (cn.isNull(), "empty_numerator_current"),
        (pn.isNull(), "empty_numerator_previous"),
        (cd.isNull(), "empty_denominator_current"),
        (pd.isNull(), "empty_denominator_previous"),
        (cd == 0, "zero_denominator_current"),
        (pd == 0, "zero_denominator_previous"),
    )


def percentile_zone(rank_no: Column, total: Column) -> tuple[Column, Column]:
    """(bucket, zone) of a rank: tens of percent from 10, and its coarse position."""
    p = rank_no.cast("double") / total.cast("double") * 100
    bucket = F.greatest(F.lit(10), (F.floor((p + 9.9999) / 10) * 10).cast("int"))
    zone = F.when(p <= 10, "top_10").when(p <= 25, "top_25").when(p >= 90, "bottom_10").when(p >= 75, "bottom_25").otherwise("middle")
    return bucket, zone
