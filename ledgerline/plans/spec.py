"""Typed query specifications, their normalisation and validation, and routing by capability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from ledgerline.functions.metrics import BASE, DERIVED

#: What a specification may ask for.
OPERATIONS = (
    "point", "trend", "yoy", "compare", "compare_trend", "compare_yoy", "ranking", "yoy_ranking", "growth_ranking", "rank_position",
    "metric_filter", "multi_metric_yoy_filter", "yoy_direction_filter_sort", "set_intersection", "company_set_yoy", "company_set_ranking",
)
COMPARISONS = ("=", "!=", "<>", ">", ">=", "<", "<=")
PERIOD_NAMES = {"H1": "HY", "HY": "HY", "Q1": "Q1", "Q3": "Q3", "FY": "FY"}
MAX_LIMIT = 50
DETERMINISTIC = frozenset(OPERATIONS[:10])
FLEXIBLE = frozenset(OPERATIONS[10:14])


class SpecError(ValueError):
    """A specification that can't be run; code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Filter:
    metric: str
    operator: str
    value: float


@dataclass(frozen=True)
class QuerySpec:
    operation: str
    metrics: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    year: int | None = None
    start_year: int | None = None
    end_year: int | None = None
    period: str = "FY"
    filters: tuple[Filter, ...] = ()
    order: tuple[tuple[str, str], ...] = ()
    direction: str = "desc"
    limit: int | None = None
    input: str | None = None
    inputs: tuple[str, ...] = field(default=())

    @staticmethod
    def parse(raw: Mapping) -> QuerySpec:
        """From a plain dictionary: metrics, filters and time_scope as planners write them."""
        scope = raw.get("time_scope") or {}
        filters = tuple(Filter(f["metric"], f.get("operator", ">"), float(f["value"])) for f in raw.get("filters") or ())
        metrics = tuple(dict.fromkeys([*(m if isinstance(m, str) else m["metric_key"] for m in raw.get("metrics") or ()), *(f.metric for f in filters)]))
        return QuerySpec(
            operation=raw.get("operation", ""),
            metrics=metrics,
            companies=tuple(raw.get("companies") or ()),
            year=scope.get("year", raw.get("year")),
            start_year=scope.get("start_year"),
            end_year=scope.get("end_year"),
            period=scope.get("period", raw.get("period", "FY")),
            filters=filters,
            order=tuple((o["metric"], o.get("direction", "desc")) for o in raw.get("sort") or ()),
            direction=raw.get("direction", "desc"),
            limit=raw.get("limit"),
            input=raw.get("input"),
            inputs=tuple(raw.get("inputs") or ()),
        )


def recent_years(latest: int, n: int) -> list[int]:
    """The n years up to latest."""
    if n < 1:
        raise SpecError("invalid_year_range", str(n))
    return list(range(latest - n + 1, latest + 1))


def validate(spec: QuerySpec) -> QuerySpec:
    """The specification with its period normalised; SpecError names the first slot that is missing or wrong."""
    if spec.operation not in OPERATIONS:
        raise SpecError("unsupported_operation", spec.operation)
    if spec.period not in PERIOD_NAMES:
        raise SpecError("invalid_period", spec.period)
    for m in spec.metrics:
        if m not in BASE and m not in DERIVED:
            raise SpecError("unknown_metric", m)
    if not spec.metrics and spec.operation != "set_intersection":
        raise SpecError("missing_metric")
    many = spec.operation in ("compare", "compare_trend", "compare_yoy")
    one = spec.operation in ("point", "trend", "yoy", "rank_position")
    if one and len(spec.companies) != 1:
        raise SpecError("missing_company" if not spec.companies else "too_many_companies")
    if many and len(set(spec.companies)) < 2:
        raise SpecError("too_few_companies")
    if spec.operation in ("trend", "compare_trend", "growth_ranking"):
        if spec.start_year is None or spec.end_year is None:
            raise SpecError("missing_year_range")
        if spec.start_year >= spec.end_year:
            raise SpecError("invalid_year_range", f"{spec.start_year}-{spec.end_year}")
    elif spec.year is None:
        raise SpecError("missing_year")
    if spec.operation in ("yoy_ranking", "growth_ranking") and any(m in DERIVED for m in spec.metrics):
        raise SpecError("unsupported_metric", "growth rankings take base metrics")
    if spec.operation in ("ranking", "yoy_ranking", "growth_ranking", "rank_position", "company_set_ranking") and len(spec.metrics) != 1:
        raise SpecError("one_metric_needed")
    if spec.direction not in ("asc", "desc") or any(d not in ("asc", "desc") for _, d in spec.order):
        raise SpecError("invalid_direction")
    if spec.limit is not None and not 1 <= spec.limit <= MAX_LIMIT:
        raise SpecError("invalid_limit", str(spec.limit))
    for f in spec.filters:
        if f.operator not in COMPARISONS:
            raise SpecError("invalid_operator", f.operator)
    if spec.operation in ("metric_filter", "multi_metric_yoy_filter", "yoy_direction_filter_sort") and not spec.filters:
        raise SpecError("missing_filter")
    if spec.operation == "ranking" and spec.input:
        raise SpecError("UNSUPPORTED_FLEXIBLE_SQL", "nested top-n")
    if spec.operation.startswith("company_set") and not spec.input:
        raise SpecError("missing_input")
    return QuerySpec(**{**spec.__dict__, "period": PERIOD_NAMES[spec.period]})


def route(raw: Mapping | QuerySpec) -> str:
    """deterministic, flexible, composite, clarification (a slot is open) or unsupported."""
    spec = raw if isinstance(raw, QuerySpec) else QuerySpec.parse(raw)
    try:
        spec = validate(spec)
    except SpecError as e:
        return "clarification" if e.code.startswith(("missing_", "too_few", "one_")) else "unsupported"
    return "deterministic" if spec.operation in DETERMINISTIC else "flexible" if spec.operation in FLEXIBLE else "composite"


def stages(specs: Sequence[Mapping]) -> list[QuerySpec]:
    """Specifications of a staged query; only top-n stages joined by one intersection are taken."""
    out = [QuerySpec.parse(s) for s in specs]
    if any(s.operation == "ranking" and s.input for s in out):
        raise SpecError("UNSUPPORTED_FLEXIBLE_SQL", "nested top-n")
    return out
