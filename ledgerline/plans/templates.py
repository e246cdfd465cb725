"""The deterministic query catalogue: each function turns typed arguments into one lazy DataFrame.

Years become a range of dates at the scan, before any join or aggregation; a template reads each table once, whatever the
number of metrics and years, and touches no other metrics than it is asked for. Ranks of one company are counts of better rows, two-phase aggregates, rather than a window over
a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.metrics import (
    BASE,
    DERIVED,
    Base,
    change,
    derived_value,
    derived_yoy_status,
    fraction,
    ladder,
    percentile_zone,
    ratio_status,
    yoy_rate,
    yoy_status,
)
from ledgerline.operators.marts import Marts

IDS = ["stock_code", "stock_abbr", "company_name"]


def companies(m: Marts, codes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """The dimension: all of it, the listed codes, or those of an earlier result (a semi-join, never collected)."""
    if codes is None:
        return m.dim
    if isinstance(codes, DataFrame):
        return m.dim.join(codes.select("stock_code").distinct(), "stock_code", "left_semi")
    return m.dim.where(F.col("stock_code").isin(list(codes)))


def spine(dim: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each company with each year, so that missing records show."""
    return dim.select("*", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("report_year"))


def fact(m: Marts, metric: Base, period: str, years: Sequence[int] | None = None) -> DataFrame:
    """(stock_code, report_year, value) of one measure."""
    rows = m.table(metric.table, years).where(F.col("report_period") == period)
    return rows.select("stock_code", "report_year", F.col(metric.field).alias(metric.alias))


def by_table(keys: Sequence[str]) -> dict[str, list[str]]:
    """The measures of each table."""
    out: dict[str, list[str]] = {}
    for k in dict.fromkeys(keys):
        out.setdefault(BASE[k].table, []).append(k)
    return out


def with_facts(base: DataFrame, m: Marts, keys: Sequence[str], period: str, years: Sequence[int]) -> DataFrame:
    """base (with report_year) left-joined to each table that holds a measure once; has__table tells missing records."""
    for table, metrics in by_table(keys).items():
        rows = m.table(table, years).where(F.col("report_period") == period)
        rows = rows.select("stock_code", "report_year", *[F.col(BASE[k].field).alias(BASE[k].alias) for k in metrics], F.lit(True).alias(f"has__{table}"))
        base = base.join(rows, ["stock_code", "report_year"], "left")
    return base


def side_by_side(m: Marts, base: DataFrame, keys: Sequence[str], years: tuple[int, int], period: str, how: str = "left") -> DataFrame:
    """base joined to each table once, with measure__c and measure__p of the second and the first year, and has__table__c and
    has__table__p. A table is read once for both years."""
    for table, metrics in by_table(keys).items():
        rows = m.table(table, years).where(F.col("report_period") == period)
        out = []
        for tag, y in (("p", years[0]), ("c", years[1])):
            own = F.col("report_year") == y
            out += [F.max(F.when(own, F.col(BASE[k].field))).alias(f"{k}__{tag}") for k in metrics] + [F.max(F.when(own, True)).alias(f"has__{table}__{tag}")]
        base = base.join(rows.groupBy("stock_code").agg(*out), "stock_code", how)  # a key's record is one row
    return base


def both(key: str) -> tuple[Column, Column]:
    """Current and previous value, as side_by_side has them."""
    return F.col(f"{key}__c"), F.col(f"{key}__p")


def had(tag: str, *keys: str) -> Column:
    """Whether any table of the measures has the record of that year."""
    return reduce(lambda a, b: a | b, [F.col(f"has__{t}__{tag}").isNotNull() for t in by_table(keys)])


def rows_of(base: DataFrame, keep: Sequence[str], items: Sequence[Sequence[Column]]) -> DataFrame:
    """A row of base for each item, a list of named columns of equal names and types."""
    return base.select(*keep, F.explode(F.array(*[F.struct(*x) for x in items])).alias("__i")).select(*keep, "__i.*")


def has(*keys: str) -> Column:
    """Whether any table of the measures has the record."""
    tables = dict.fromkeys(BASE[k].table for k in keys)
    return reduce(lambda a, b: a | b, [F.col(f"has__{t}").isNotNull() for t in tables])


def val(key: str) -> Column:
    return F.col(BASE[key].alias)


def _operands(key: str) -> tuple[str, str]:
    return DERIVED[key].numerator, DERIVED[key].denominator


# --- one company -----------------------------------------------------------------------------------------------------


def point(m: Marts, code: str, year: int, period: str, keys: Sequence[str]) -> DataFrame:
    rows = with_facts(spine(companies(m, [code]), [year]), m, keys, period, [year])
    return rows.select(*IDS, F.when(has(*keys), F.col("report_year")).alias("report_year"), F.lit(period).alias("report_period"), *[val(k) for k in keys])


def _ratio(key: str) -> list[Column]:
    """metric, value and status of a derived metric over a row's operands."""
    n, d = _operands(key)
    status = ratio_status(has(n, d), val(n), val(d))
    return [F.lit(key).alias("metric"), F.when(status == "ok", derived_value(DERIVED[key], val(n), val(d))).alias("value"), status.alias("status")]


def derived_point(m: Marts, code: str, year: int, period: str, keys: Sequence[str]) -> DataFrame:
    """One row a derived metric; all operands come in one join a table."""
    operands = [x for k in keys for x in _operands(k)]
    rows = with_facts(spine(companies(m, [code]), [year]), m, operands, period, [year])
    out = rows_of(rows, ["stock_code", "report_year"], [[*_ratio(k), *[val(x).alias(a) for x, a in zip(_operands(k), ("numerator", "denominator"))]] for k in keys])
    return out.select("stock_code", "metric", "report_year", "numerator", "denominator", "value", "status")


def trend(m: Marts, code: str, start: int, end: int, period: str, key: str) -> DataFrame:
    """Yearly rows with the summary of the series on each."""
    years = list(range(start, end + 1))
    rows = with_facts(spine(companies(m, [code]), years), m, [key], period, years)
    rows = rows.select("stock_code", "report_year", val(key).alias("value"), ladder((~has(key), "missing_record"), (val(key).isNull(), "empty_value")).alias("status"))
    w = Window.partitionBy("stock_code")
    seen = F.when(F.col("status") != "missing_record", F.col("report_year"))
    rows = rows.withColumns({"first_year": F.min(seen).over(w), "last_year": F.max(seen).over(w)})
    at = lambda c: F.max(F.when(F.col("report_year") == F.col(c), F.col("value").cast("double"))).over(w)
    rows = rows.withColumns({"first_value": at("first_year"), "last_value": at("last_year")})
    first, last = F.col("first_value"), F.col("last_value")
    direction = ladder(
        (F.coalesce(F.col("first_year") == F.col("last_year"), F.lit(True)) | first.isNull() | last.isNull(), "insufficient"),
        (F.abs(last - first) < 1e-9, "flat"),
        (last > first, "up"),
        otherwise="down",
    )
    known = direction != "insufficient"
    return rows.select(
        "*",
        F.when(known, F.round(last - first, 2)).alias("absolute_change"),
        F.when(known & (first != 0), F.round((last - first) / F.when(first != 0, first) * 100, 2)).alias("change_rate_pct"),
        direction.alias("direction"),
    )


def series_summary(points: DataFrame, by: Sequence[str], precision: int = 2) -> DataFrame:
    """First and last valid value, change and direction of each series of (report_year, value, status)."""
    ok = F.when((F.col("status") == "ok") & F.col("value").isNotNull(), F.col("report_year"))
    v = F.col("value").cast("double")
    agg = points.groupBy(*by).agg(
        F.count(ok).cast("long").alias("valid_points"), F.min(ok).alias("first_year"), F.max(ok).alias("last_year"), F.min_by(v, ok).alias("first_value"), F.max_by(v, ok).alias("__last")
    )
    first, last = F.col("first_value"), F.when(F.col("valid_points") >= 2, F.col("__last"))
    moved = F.round(last - first, precision)
    return agg.select(
        *by,
        "valid_points",
        "first_year",
        "last_year",
        "first_value",
        last.alias("last_value"),
        moved.alias("absolute_change"),
        F.when(first != 0, F.round(moved / F.abs(F.when(first != 0, first)), 4)).alias("change_rate"),
        ladder((F.col("valid_points") < 2, "insufficient_points"), (last > first, "up"), (last < first, "down"), otherwise="flat").alias("trend_direction"),
    )


def derived_points(m: Marts, codes: Sequence[str] | DataFrame, years: Sequence[int], period: str, key: str) -> DataFrame:
    """(stock_code, company_name, report_year, value, status) of a derived metric on the spine."""
    rows = with_facts(spine(companies(m, codes), years), m, _operands(key), period, years)
    return rows.select("stock_code", "company_name", "report_year", *_ratio(key)[1:])


def derived_trend(m: Marts, code: str, start: int, end: int, period: str, key: str) -> DataFrame:
    """Yearly ratios, over the years that either operand's table reports, with the shape of the series."""
    n, d = _operands(key)
    years = list(range(start, end + 1))
    known = [m.table(t, years).where((F.col("report_period") == period) & (F.col("stock_code") == code)).select("stock_code", "report_year") for t in by_table((n, d))]
    base = reduce(DataFrame.union, known).distinct()
    rows = with_facts(base, m, [n, d], period, years)
    status = ratio_status(has(n, d), val(n), val(d))
    rows = rows.select("stock_code", "report_year", F.when(status == "ok", derived_value(DERIVED[key], val(n), val(d))).alias("value"), status.alias("status"))
    steps = rows.where("status = 'ok'").withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("stock_code").orderBy("report_year")))
    shape = steps.groupBy("stock_code").agg(
        F.count("*").alias("k"), F.every(F.coalesce(F.col("step") >= 0, F.lit(True))).alias("up"), F.every(F.coalesce(F.col("step") <= 0, F.lit(True))).alias("down"),
        F.min_by("value", "report_year").alias("first"), F.max_by("value", "report_year").alias("last"),
    )
    shape = shape.select(
        "stock_code",
        ladder(
            (F.col("k") < 2, "insufficient_points"), (F.col("up"), "up"), (F.col("down"), "down"), (F.col("last") > F.col("first"), "fluctuating_up"), (F.col("last") < F.col("first"), "fluctuating_down"),
            otherwise="fluctuating_flat",
        ).alias("direction"),
        F.when(F.col("k") >= 2, F.round(F.col("last") - F.col("first"), 2)).alias("change_pp"),
    )
    return rows.join(shape, "stock_code", "left")


def yoy(m: Marts, codes: Sequence[str] | DataFrame, year: int, period: str, keys: Sequence[str]) -> DataFrame:
    """One row a company and metric: change and rate against the year before, with the first status that applies."""
    rows = side_by_side(m, companies(m, codes), keys, (year - 1, year), period)
    out = []
    for k in keys:
        c, p = both(k)
        status = yoy_status(had("c", k), c, had("p", k), p)
        out.append(
            [
                F.lit(k).alias("metric"),
                c.alias("current_value"),
                p.alias("previous_value"),
                F.when(status == "ok", change(c, p)).when(status == "zero_previous_value", F.round(c.cast("double"), 2)).alias("change_abs"),
                F.when(status == "ok", yoy_rate(c, p)).alias("yoy_rate"),
                status.alias("status"),
            ]
        )
    return rows_of(rows, ["stock_code"], out)


def derived_yoy(m: Marts, codes: Sequence[str] | DataFrame, year: int, period: str, key: str) -> DataFrame:
    """Change of a ratio in points of its unit."""
    n, d = _operands(key)
    rows = side_by_side(m, companies(m, codes), [n, d], (year - 1, year), period)
    (cn, pn), (cd, pd) = both(n), both(d)
    status = derived_yoy_status(had("c", n, d), had("p", n, d), cn, pn, cd, pd)
    cur, prev = derived_value(DERIVED[key], cn, cd), derived_value(DERIVED[key], pn, pd)
    moved = F.round(cur - prev, DERIVED[key].precision)
    ok = status == "ok"
    return rows.select(
        "stock_code",
        "company_name",
        F.lit(key).alias("metric"),
        F.when(ok, cur).alias("current_value"),
        F.when(ok, prev).alias("previous_value"),
        F.when(ok, moved).alias("change_abs"),
        F.when(ok & (prev != 0), F.round(moved / F.abs(F.when(prev != 0, prev)), 4)).alias("yoy_rate"),
        status.alias("status"),
    )


# --- several companies -------------------------------------------------------------------------------------------------


def roll_up(ok: Column, prefix: str) -> Column:
    """ok, partial or unavailable over a group's rows."""
    return F.when(~F.bool_or(ok), f"{prefix}_unavailable").when(~F.bool_and(ok), f"partial_{prefix}_unavailable").otherwise("ok")


def _extremes(rows: DataFrame, prefix: str) -> DataFrame:
    """The metric's status, largest and smallest value and their companies (ties: the smaller code) beside each row."""
    v = F.when(F.col("status") == "ok", F.col("value").cast("double"))
    top = F.min_by("company_name", F.when(v.isNotNull(), F.struct(-v, "stock_code")))
    low = F.min_by("company_name", F.when(v.isNotNull(), F.struct(v, "stock_code")))
    summary = rows.groupBy("metric").agg(
        roll_up(F.col("status") == "ok", prefix).alias("metric_status"), top.alias("higher"), low.alias("lower"), F.when(F.count(v) >= 2, F.round(F.max(v) - F.min(v), 2)).alias("diff")
    )
    return rows.join(F.broadcast(summary), "metric")  # one row a metric


def compare(m: Marts, codes: Sequence[str], year: int, period: str, keys: Sequence[str]) -> DataFrame:
    rows = with_facts(spine(companies(m, codes), [year]), m, keys, period, [year])
    items = [[F.lit(k).alias("metric"), val(k).alias("value"), ladder((~has(k), "missing_record"), (val(k).isNull(), "empty_value")).alias("status")] for k in keys]
    return _extremes(rows_of(rows, ["stock_code", "company_name"], items), "compare")


def derived_compare(m: Marts, codes: Sequence[str], year: int, period: str, keys: Sequence[str]) -> DataFrame:
    rows = with_facts(spine(companies(m, codes), [year]), m, [x for k in keys for x in _operands(k)], period, [year])
    return _extremes(rows_of(rows, ["stock_code", "company_name"], [_ratio(k) for k in keys]), "compare")


def compare_trend(m: Marts, codes: Sequence[str], years: Sequence[int], period: str, key: str) -> DataFrame:
    rows = with_facts(spine(companies(m, codes), years), m, [key], period, years)
    points = rows.select("stock_code", "company_name", "report_year", val(key).alias("value"), ladder((~has(key), "missing_record"), (val(key).isNull(), "empty_value")).alias("status"))
    return series_summary(points, ["stock_code", "company_name"])


def derived_compare_trend(m: Marts, codes: Sequence[str], years: Sequence[int], period: str, key: str) -> DataFrame:
    """As compare_trend, in points; a rate of change of percentages isn't given."""
    out = series_summary(derived_points(m, codes, years, period, key), ["stock_code", "company_name"], DERIVED[key].precision)
    return out.drop("change_rate") if DERIVED[key].unit == "percent" else out


def compare_yoy(m: Marts, codes: Sequence[str], year: int, period: str, key: str) -> DataFrame:
    """Growth of each company; the winner is named only if all are comparable."""
    rows = yoy(m, codes, year, period, [key]).join(m.dim.select("stock_code", "company_name"), "stock_code")
    ok = F.col("status") == "ok"
    best = F.min_by("company_name", F.when(ok, F.struct(-F.col("yoy_rate"), "stock_code")))
    worst = F.min_by("company_name", F.when(ok, F.struct("yoy_rate", "stock_code")))
    widest = F.min_by("company_name", F.when(ok, F.struct(-F.abs("change_abs"), "stock_code")))
    full = F.bool_and(ok) & (F.count("*") >= 2)
    summary = rows.groupBy("metric").agg(
        roll_up(ok, "compare_yoy").alias("metric_status"), F.when(full, best).alias("winner"), F.when(full, worst).alias("loser"), F.when(full, widest).alias("larger_change"),
        F.when(full, F.round(F.max("yoy_rate") - F.min("yoy_rate"), 4)).alias("diff_yoy_rate"),
    )
    warning = F.when(ok & (F.col("previous_value") < 0), "negative_previous_value")
    return rows.withColumn("warning", warning).join(F.broadcast(summary), "metric")  # one row


def derived_compare_yoy(m: Marts, codes: Sequence[str], year: int, period: str, key: str) -> DataFrame:
    rows = derived_yoy(m, codes, year, period, key)
    ok = F.col("status") == "ok"
    full = F.bool_and(ok) & (F.count("*") >= 2)
    summary = rows.groupBy("metric").agg(
        roll_up(ok, "compare_yoy").alias("metric_status"),
        F.when(full, F.min_by("company_name", F.when(ok, F.struct(-F.col("change_abs"), "stock_code")))).alias("winner"),
    )
    return rows.join(F.broadcast(summary), "metric")  # one row


# --- all companies -----------------------------------------------------------------------------------------------------


def _measured(m: Marts, key: str, year: int, period: str, within: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Companies whose metric is known, with `value` (ratios as fractions). Operands of one table need one scan."""
    dim = companies(m, within)
    if key in BASE:
        rows = fact(m, BASE[key], period, [year]).withColumnRenamed(BASE[key].alias, "value")
    else:
        n, d = _operands(key)
        if BASE[n].table == BASE[d].table:
            rows = m.table(BASE[n].table, [year]).where(F.col("report_period") == period)
            rows = rows.select("stock_code", "report_year", F.col(BASE[n].field).alias("numerator"), F.col(BASE[d].field).alias("denominator"))
        else:
            a, b = (fact(m, BASE[k], period, [year]).withColumnRenamed(BASE[k].alias, x) for k, x in ((n, "numerator"), (d, "denominator")))
            rows = a.join(b, ["stock_code", "report_year"])
        rows = rows.where("numerator IS NOT NULL AND denominator IS NOT NULL AND denominator <> 0").withColumn("value", fraction(F.col("numerator"), F.col("denominator")))
    return dim.join(rows.where("value IS NOT NULL"), "stock_code")


def _order(direction: str, column: str = "value") -> list[Column]:
    c = F.col(column)
    return [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), F.col("stock_code").asc()]


def ranked(rows: DataFrame, direction: str, n: int, column: str = "value") -> DataFrame:
    """The first n rows with their positions; ties by code. The position is counted over the n rows alone."""
    top = rows.orderBy(*_order(direction, column)).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*_order(direction, column))).cast("long"))


def ranking(m: Marts, key: str, year: int, period: str, direction: str = "desc", n: int = 10, within: Sequence[str] | DataFrame | None = None) -> DataFrame:
    return ranked(_measured(m, key, year, period, within), direction, n).select("position", *IDS, "report_year", F.col("value").cast("double").alias("value"))


def _pairs(m: Marts, key: str, first: int, last: int, period: str) -> DataFrame:
    """Companies that report a measure in both years, the earlier one not 0; its table is read once."""
    rows = side_by_side(m, m.dim, [key], (first, last), period, "inner")
    c, p = both(key)
    return rows.where(p.isNotNull() & c.isNotNull() & (p != 0)).select(*IDS, p.alias("start_value"), c.alias("end_value"))


def yoy_ranking(m: Marts, key: str, year: int, period: str, direction: str = "desc", n: int = 10, signed: bool = True) -> DataFrame:
    """By growth against the year before; signed divides by the previous value as it is, else by its magnitude."""
    rate = F.round(yoy_rate(F.col("end_value"), F.col("start_value"), signed), 8)
    rows = _pairs(m, key, year - 1, year, period).withColumn("yoy_rate", rate)
    return ranked(rows, direction, n, "yoy_rate").select("position", *IDS, F.col("end_value").alias("current_value"), F.col("start_value").alias("previous_value"), "yoy_rate")


def growth_ranking(m: Marts, key: str, start: int, end: int, period: str, direction: str = "desc", n: int = 10) -> DataFrame:
    rate = F.round(yoy_rate(F.col("end_value"), F.col("start_value"), signed=True), 8)
    return ranked(_pairs(m, key, start, end, period).withColumn("growth_rate", rate), direction, n, "growth_rate").select("position", *IDS, "start_value", "end_value", "growth_rate")


def rank_position(m: Marts, code: str, key: str, year: int, period: str, direction: str = "desc") -> DataFrame:
    """A company's rank (ties share the best) among all companies, the total, and its zone."""
    rows = _measured(m, key, year, period)
    own = rows.where(F.col("stock_code") == code).select(*IDS, "report_year", F.col("value").alias("own"))
    better = F.col("value") > F.col("own") if direction == "desc" else F.col("value") < F.col("own")
    # the one-row side is broadcast; what is left is a count
    counted = rows.select("value").crossJoin(F.broadcast(own)).groupBy(*IDS, "report_year", "own").agg((F.count(F.when(better, 1)) + 1).alias("rank_no"), F.count("*").alias("total_count"))
    bucket, zone = percentile_zone(F.col("rank_no"), F.col("total_count"))
    return counted.select(*IDS, "report_year", F.col("own").cast("double").alias("value"), F.col("rank_no").cast("long").alias("rank_no"), F.col("total_count").cast("long").alias("total_count"), bucket.alias("percentile_bucket"), zone.alias("position_zone"))


def top_intersection(m: Marts, year: int, period: str, n: int, first: str = "total_operating_revenue", second: str = "net_profit") -> DataFrame:
    """Companies in the top n of both measures of the income sheet, by margin."""
    rows = m.table("income_sheet", [year]).where((F.col("report_period") == period) & F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != 0))
    a, b = (rows.orderBy(F.col(k).desc(), "stock_code").limit(n) for k in (first, second))
    both = a.join(b.select("stock_code"), "stock_code", "left_semi")
    out = m.dim.join(both, "stock_code").select(*IDS, "report_year", "report_period", first, second, fraction(F.col(second), F.col(first)).alias("net_profit_margin"))
    return out.orderBy(F.col("net_profit_margin").desc(), "stock_code").limit(n)


_OPS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def percent_threshold(value: float) -> float:
    """A threshold of a percentage as a fraction: divided once, and only if it can't be a fraction already."""
    return value / 100 if abs(value) > 1 else value


def threshold_filter(m: Marts, key: str, op: str, value: float, year: int, period: str, direction: str = "desc", n: int = 50, also: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """Companies whose metric meets a bound, and those of also as well (metric, operator, bound); the limit comes last."""
    bound = lambda k, v: float(percent_threshold(v) if k in DERIVED and DERIVED[k].unit == "percent" else v)
    meets = lambda k, o, v: _measured(m, k, year, period).where(_OPS[o](F.col("value").cast("double"), F.lit(bound(k, v))))
    rows = meets(key, op, value)
    for more in also:
        rows = rows.join(meets(*more).select("stock_code"), "stock_code", "left_semi")
    return ranked(rows, direction, n).select(*IDS, "report_year", F.col("value").cast("double").alias("value"))


def yoy_filter(m: Marts, conditions: Sequence[tuple[str, str, float]], year: int, period: str, order: Sequence[tuple[str, str]] = (), n: int = 50) -> DataFrame:
    """Companies whose growth meets every condition (metric, operator, bound in percent or as a fraction)."""
    rows = side_by_side(m, m.dim, [k for k, _, _ in conditions], (year - 1, year), period, "inner")
    rates = {}
    for k, op, bound in conditions:
        c, p = both(k)
        rates[k] = F.when(c.isNotNull() & (p != 0), F.round(yoy_rate(c, p), 4))
        rows = rows.where(_OPS[op](rates[k], F.lit(float(percent_threshold(bound)))))
    rows = rows.select(*IDS, *[rate.alias(f"{k}__yoy") for k, rate in rates.items()])
    by = [F.col(f"{k}__yoy").desc_nulls_last() if d == "desc" else F.col(f"{k}__yoy").asc_nulls_last() for k, d in order]
    return rows.orderBy(*by, "stock_code").limit(n)


def company_set_yoy(m: Marts, members: DataFrame, year: int, period: str, keys: Sequence[str]) -> DataFrame:
    """Growth of several measures for an earlier result's companies, one row a company and measure."""
    short = {"missing_current_year": "missing_current_value", "empty_current_value": "missing_current_value", "missing_previous_year": "missing_previous_value", "empty_previous_value": "missing_previous_value"}
    rows = yoy(m, members, year, period, keys)
    status = reduce(lambda c, x: c.when(F.col("status") == x[0], x[1]), short.items(), F.when(F.lit(False), "")).otherwise(F.col("status"))
    return rows.withColumn("status", status)


def rerank(artifact: DataFrame, column: str, direction: str, n: int) -> DataFrame:
    """An earlier result in another order, rows without the value left out."""
    return ranked(artifact.where(F.col(column).isNotNull()), direction, n, column)
