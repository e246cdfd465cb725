"""Specifications to DataFrames. Values enter as literals; no SQL text is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.metrics import BASE, DERIVED
from ledgerline.operators.marts import Marts
from ledgerline.plans import templates as t
from ledgerline.plans.spec import QuerySpec, SpecError, validate


@dataclass(frozen=True)
class ResultContract:
    """What a result holds: its columns, the ones that name a row, and the unit of each measure."""

    columns: tuple[str, ...]
    keys: tuple[str, ...]
    units: dict[str, str]
    limit: int | None
    kinds: dict[str, str] = field(default_factory=dict)

    def truncated(self, rows: int) -> bool:
        """Whether a result of so many rows may have been cut by the limit."""
        return self.limit is not None and rows >= self.limit

    @staticmethod
    def of(df: DataFrame, limit: int | None = None) -> ResultContract:
        units = {}
        kinds = {"percent": "percentage", "yuan": "currency", "fraction": "percentage", "ratio": "number"}
        for c in df.columns:
            key = c.split("__")[-1]
            if key in BASE:
                units[c] = BASE[key].unit
            elif key in DERIVED:
                units[c] = DERIVED[key].unit
            elif c.endswith(("_rate", "__yoy")):
                units[c] = "fraction"
        return ResultContract(tuple(df.columns), tuple(c for c in df.columns if c in ("stock_code", "report_year", "report_period", "metric")), units, limit, {c: kinds[u] for c, u in units.items()})


def unsupported_figures(answer: str, rows: list[dict]) -> list[str]:
    """Figures of an answer that no value of its (few, already shown) result rows explains: as it is, rounded to two digits, in
    hundreds of millions, or as a percentage."""
    known: set[str] = set()
    for value in (v for r in rows for v in r.values() if v is not None):
        known.add(str(value))
        try:
            x = float(value)
        except (TypeError, ValueError):
            known.update(re.findall(r"\d+(?:\.\d+)?", str(value)))
            continue
        known |= {f"{abs(y):.{n}f}" for y in (x, x * 100, x / 1e8) for n in (0, 1, 2)}
    said = [m.replace(",", "") for m in re.findall(r"\d[\d,]*(?:\.\d+)?", answer)]
    return [m for m in dict.fromkeys(said) if m not in known and m.lstrip("0") not in known]


def compile_spec(m: Marts, spec: QuerySpec, artifacts: dict[str, DataFrame] | None = None) -> DataFrame:
    """The lazy DataFrame of a validated specification; artifacts hold earlier results by name."""
    s = validate(spec)
    keys, n = list(s.metrics), s.limit or 10
    base, derived = [k for k in keys if k in BASE], [k for k in keys if k in DERIVED]
    members = (artifacts or {}).get(s.input) if s.input else None
    if s.input and members is None:
        raise SpecError("missing_artifact", s.input)
    if base and derived and s.operation in ("point", "yoy", "compare"):
        raise SpecError("mixed_metrics", "base and derived metrics have different rows")
    years = range(s.start_year, s.end_year + 1) if s.start_year is not None and s.end_year is not None else ()
    if s.operation == "point":
        return t.derived_point(m, s.companies[0], s.year, s.period, derived) if derived else t.point(m, s.companies[0], s.year, s.period, base)
    if s.operation == "trend":
        return (t.derived_trend if derived else t.trend)(m, s.companies[0], s.start_year, s.end_year, s.period, keys[0])
    if s.operation == "yoy":
        return t.derived_yoy(m, s.companies, s.year, s.period, derived[0]) if derived else t.yoy(m, s.companies, s.year, s.period, base)
    if s.operation == "compare":
        return (t.derived_compare if derived else t.compare)(m, s.companies, s.year, s.period, keys)
    if s.operation == "compare_trend":
        return (t.derived_compare_trend if derived else t.compare_trend)(m, s.companies, list(years), s.period, keys[0])
    if s.operation == "compare_yoy":
        return (t.derived_compare_yoy if derived else t.compare_yoy)(m, s.companies, s.year, s.period, keys[0])
    if s.operation == "ranking":
        return t.ranking(m, keys[0], s.year, s.period, s.direction, n)
    if s.operation == "yoy_ranking":
        return t.yoy_ranking(m, keys[0], s.year, s.period, s.direction, n)
    if s.operation == "growth_ranking":
        return t.growth_ranking(m, keys[0], s.start_year, s.end_year, s.period, s.direction, n)
    if s.operation == "rank_position":
        return t.rank_position(m, s.companies[0], keys[0], s.year, s.period, s.direction)
    if s.operation == "metric_filter":
        first, *also = [(f.metric, f.operator, f.value) for f in s.filters]
        return t.threshold_filter(m, *first, s.year, s.period, s.direction, s.limit or 50, also)
    if s.operation in ("multi_metric_yoy_filter", "yoy_direction_filter_sort"):
        return t.yoy_filter(m, [(f.metric, f.operator, f.value) for f in s.filters], s.year, s.period, s.order, s.limit or 50)
    if s.operation == "set_intersection":
        return t.top_intersection(m, s.year, s.period, s.limit or 20)
    if s.operation == "company_set_yoy":
        return t.company_set_yoy(m, members, s.year, s.period, keys)
    return t.ranking(m, keys[0], s.year, s.period, s.direction, n, within=members)


def latest_year(m: Marts, table: str = "income_sheet", period: str = "FY") -> int | None:
    """The newest year that a table reports: one value, read from a partial aggregate."""
    return m.table(table).where(F.col("report_period") == period).agg(F.max("report_year")).first()[0]


def latest_years(m: Marts) -> DataFrame:
    """(sheet, latest) of each fact table, as one lazy result."""
    names = ("income_sheet", "balance_sheet", "cash_flow_sheet")
    return reduce(DataFrame.union, [m.table(n).agg(F.lit(n).alias("sheet"), F.max("report_year").alias("latest")) for n in names])
