"""SQL that states the catalogue's queries a second time, for an engine that only has the input tables."""

from __future__ import annotations


def marts(grain: str = "nation") -> str:
    """The statement marts as common table expressions."""
    line_key = "l_suppkey" if grain == "supplier" else "s_nationkey"
    order_key = "o_custkey" if grain == "customer" else "c_nationkey"
    dim = {"nation": ("nation", "n_nationkey", "n_name"), "supplier": ("supplier", "s_suppkey", "s_name"), "customer": ("customer", "c_custkey", "c_name")}[grain]
    return f"""
WITH company_dim AS (
  SELECT lpad(CAST({dim[1]} AS VARCHAR), 6, '0') AS stock_code, {dim[2]} AS stock_abbr, {dim[2]} || ' Holdings' AS company_name FROM {dim[0]}
), lines AS (
  SELECT lpad(CAST({line_key} AS VARCHAR), 6, '0') AS stock_code, CAST(year(l_shipdate) AS INTEGER) AS report_year, 'FY' AS report_period, l_returnflag,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS rev, CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS tax
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), income_sheet AS (
  SELECT stock_code, report_year, report_period, CAST(sum(rev) AS DECIMAL(20,2)) AS total_operating_revenue,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE rev * CAST(0.5 AS DECIMAL(2,1)) END) AS DECIMAL(20,2)) AS operating_profit,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN -rev ELSE rev * CAST(0.5 AS DECIMAL(2,1)) END) AS DECIMAL(20,2)) AS net_profit,
         CAST(sum(rev) FILTER (WHERE l_returnflag = 'A') AS DECIMAL(20,2)) AS operating_expense_cost_of_sales
  FROM lines GROUP BY ALL
), cash_parts AS (
  SELECT stock_code, report_year, report_period,
         CAST(coalesce(sum(rev) FILTER (WHERE l_returnflag = 'N'), 0) AS DECIMAL(20,2)) AS operating_cf_net_amount,
         CAST(-coalesce(sum(rev) FILTER (WHERE l_returnflag = 'R'), 0) AS DECIMAL(20,2)) AS investing_cf_net_amount,
         CAST(-sum(tax) AS DECIMAL(20,2)) AS financing_cf_net_amount
  FROM lines GROUP BY ALL
), cash_flow_sheet AS (
  SELECT *, CAST((operating_cf_net_amount + investing_cf_net_amount + financing_cf_net_amount)
                 * CASE WHEN (CAST(stock_code AS INTEGER) + report_year) % 3 = 0 THEN CAST(1.02 AS DECIMAL(3,2)) ELSE CAST(1.00 AS DECIMAL(3,2)) END AS DECIMAL(20,2)) AS net_cash_flow
  FROM cash_parts
), balance_parts AS (
  SELECT lpad(CAST({order_key} AS VARCHAR), 6, '0') AS stock_code, CAST(year(o_orderdate) AS INTEGER) AS report_year, 'FY' AS report_period,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS asset_total_assets,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'F') AS DECIMAL(20,2)) AS liability_total_liabilities,
         CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS asset_inventory
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
), balance_sheet AS (
  SELECT *, CAST(asset_total_assets - liability_total_liabilities AS DECIMAL(20,2)) AS equity_total_equity FROM balance_parts
)"""


def codes(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def div(n: str, d: str) -> str:
    return f"({dbl(n)} / nullif({dbl(d)}, 0))"


def years(values) -> str:
    return "(SELECT unnest([" + ", ".join(map(str, values)) + "]) AS report_year)"


def ratio_status(present: str, n: str, d: str) -> str:
    return f"CASE WHEN NOT ({present}) THEN 'missing_record' WHEN {n} IS NULL THEN 'empty_numerator' WHEN {d} IS NULL THEN 'empty_denominator' WHEN {d} = 0 THEN 'zero_denominator' ELSE 'ok' END"


def yoy_status(c: str, p: str, v: str) -> str:
    return (
        f"CASE WHEN {c}.stock_code IS NULL THEN 'missing_current_year' WHEN {c}.{v} IS NULL THEN 'empty_current_value' WHEN {p}.stock_code IS NULL THEN 'missing_previous_year' "
        f"WHEN {p}.{v} IS NULL THEN 'empty_previous_value' WHEN {p}.{v} = 0 THEN 'zero_previous_value' ELSE 'ok' END"
    )


def point(code, year, a, b) -> str:
    (ta, fa), (tb, fb) = a, b
    return f"""{marts()}
SELECT d.stock_code, stock_abbr, company_name, coalesce(a.report_year, b.report_year) AS report_year, 'FY' AS report_period, a.{fa} AS {ta}__{fa}, b.{fb} AS {tb}__{fb}
FROM company_dim d LEFT JOIN {ta} a ON a.stock_code = d.stock_code AND a.report_year = {year} LEFT JOIN {tb} b ON b.stock_code = d.stock_code AND b.report_year = {year}
WHERE d.stock_code = '{code}'"""


def derived_points(where: str, ys, key, n, d, scale, grain="nation", columns="stock_code, company_name, report_year, value, status", with_=False) -> str:
    """n and d: (table, field)."""
    (tn, fn), (td, fd) = n, d
    same = tn == td
    present = "a.stock_code IS NOT NULL" if same else "a.stock_code IS NOT NULL OR b.stock_code IS NOT NULL"
    den = f"a.{fd}" if same else f"b.{fd}"
    join = "" if same else f"LEFT JOIN {td} b ON b.stock_code = c.stock_code AND b.report_year = y.report_year"
    body = f"""SELECT c.stock_code, company_name, y.report_year, '{key}' AS metric, a.{fn} AS numerator, {den} AS denominator,
  round({div(f'a.{fn}', den)} * {scale}, 2) AS value0, {ratio_status(present, f'a.{fn}', den)} AS status
FROM (SELECT * FROM company_dim WHERE {where}) c CROSS JOIN {years(ys)} y
LEFT JOIN {tn} a ON a.stock_code = c.stock_code AND a.report_year = y.report_year {join}"""
    if with_:
        return f"pts AS (SELECT *, CASE WHEN status = 'ok' THEN value0 END AS value FROM ({body}))"
    return f"{marts(grain)}, pts AS (SELECT *, CASE WHEN status = 'ok' THEN value0 END AS value FROM ({body})) SELECT {columns} FROM pts"


def trend(code, start, end, t, f) -> str:
    return f"""{marts()}, pts AS (
  SELECT '{code}' AS stock_code, y.report_year, a.{f} AS value, CASE WHEN a.stock_code IS NULL THEN 'missing_record' WHEN a.{f} IS NULL THEN 'empty_value' ELSE 'ok' END AS status
  FROM {years(range(start, end + 1))} y LEFT JOIN {t} a ON a.stock_code = '{code}' AND a.report_year = y.report_year
), s AS (
  SELECT min(report_year) AS first_year, max(report_year) AS last_year FROM pts WHERE status <> 'missing_record'
), v AS (
  SELECT s.*, (SELECT {dbl('value')} FROM pts WHERE report_year = first_year) AS first_value, (SELECT {dbl('value')} FROM pts WHERE report_year = last_year) AS last_value FROM s
), z AS (
  SELECT *, CASE WHEN first_year IS NULL OR first_year = last_year OR first_value IS NULL OR last_value IS NULL THEN 'insufficient' WHEN abs(last_value - first_value) < 1e-9 THEN 'flat'
                 WHEN last_value > first_value THEN 'up' ELSE 'down' END AS direction FROM v
)
SELECT stock_code, report_year, value, status, first_year, last_year, first_value, last_value, CASE WHEN direction <> 'insufficient' THEN round(last_value - first_value, 2) END AS absolute_change,
  CASE WHEN direction <> 'insufficient' THEN round((last_value - first_value) / nullif(first_value, 0) * 100, 2) END AS change_rate_pct, direction FROM pts, z"""


def summary(points: str, by: str, rate: bool = True) -> str:
    """points: a CTE of report_year, value, status."""
    return f"""SELECT {by}, valid_points, first_year, last_year, first_value, last_value, absolute_change{", round(absolute_change / abs(nullif(first_value, 0)), 4) AS change_rate" if rate else ""},
  CASE WHEN valid_points < 2 THEN 'insufficient_points' WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'flat' END AS trend_direction
FROM (SELECT *, round(last_value - first_value, 2) AS absolute_change FROM (
  SELECT *, CASE WHEN valid_points >= 2 THEN last0 END AS last_value FROM (
    SELECT {by}, count(*) FILTER (WHERE status = 'ok') AS valid_points, min(report_year) FILTER (WHERE status = 'ok') AS first_year, max(report_year) FILTER (WHERE status = 'ok') AS last_year,
      arg_min({dbl('value')}, report_year) FILTER (WHERE status = 'ok') AS first_value, arg_max({dbl('value')}, report_year) FILTER (WHERE status = 'ok') AS last0
    FROM {points} GROUP BY {by})))"""


def derived_trend(code, start, end, n, d, scale) -> str:
    (tn, fn), (td, fd) = n, d
    return f"""{marts()}, ys AS (
  SELECT report_year FROM {tn} WHERE stock_code = '{code}' AND report_year BETWEEN {start} AND {end} UNION SELECT report_year FROM {td} WHERE stock_code = '{code}' AND report_year BETWEEN {start} AND {end}
), pts AS (
  SELECT '{code}' AS stock_code, ys.report_year, {ratio_status('a.stock_code IS NOT NULL OR b.stock_code IS NOT NULL', f'a.{fn}', f'b.{fd}')} AS status, round({div(f'a.{fn}', f'b.{fd}')} * {scale}, 2) AS v
  FROM ys LEFT JOIN {tn} a ON a.stock_code = '{code}' AND a.report_year = ys.report_year LEFT JOIN {td} b ON b.stock_code = '{code}' AND b.report_year = ys.report_year
), ok AS (
  SELECT *, v - lag(v) OVER (ORDER BY report_year) AS step FROM pts WHERE status = 'ok'
), s AS (
  SELECT count(*) AS k, bool_and(coalesce(step >= 0, TRUE)) AS up, bool_and(coalesce(step <= 0, TRUE)) AS down, arg_min(v, report_year) AS first, arg_max(v, report_year) AS last FROM ok
)
SELECT stock_code, report_year, CASE WHEN status = 'ok' THEN v END AS value, status,
  CASE WHEN k < 2 THEN 'insufficient_points' WHEN up THEN 'up' WHEN down THEN 'down' WHEN last > first THEN 'fluctuating_up' WHEN last < first THEN 'fluctuating_down' ELSE 'fluctuating_flat' END AS direction,
  CASE WHEN k >= 2 THEN round(last - first, 2) END AS change_pp FROM pts, s"""


def yoy_rows(where: str, year: int, metrics, grain: str = "nation", company: bool = False) -> str:
    """metrics: (key, table). A select without the marts."""
    parts = []
    for k, t in metrics:
        st = yoy_status("c", "p", k)
        parts.append(
            f"SELECT *, CASE WHEN status = 'ok' THEN round({dbl('current_value')} - {dbl('previous_value')}, 2) WHEN status = 'zero_previous_value' THEN round({dbl('current_value')}, 2) END AS change_abs, "
            f"CASE WHEN status = 'ok' THEN round(round({dbl('current_value')} - {dbl('previous_value')}, 2) / abs(nullif({dbl('previous_value')}, 0)), 4) END AS yoy_rate FROM ("
            f"SELECT d.stock_code, {'d.company_name, ' if company else ''}'{k}' AS metric, c.{k} AS current_value, p.{k} AS previous_value, {st} AS status FROM (SELECT * FROM company_dim WHERE {where}) d "
            f"LEFT JOIN {t} c ON c.stock_code = d.stock_code AND c.report_year = {year} LEFT JOIN {t} p ON p.stock_code = d.stock_code AND p.report_year = {year - 1})"
        )
    return " UNION ALL ".join(parts)


def derived_yoy_rows(where: str, year: int, key, n, d, scale) -> str:
    (tn, fn), (td, fd) = n, d
    return f"""SELECT stock_code, company_name, '{key}' AS metric, CASE WHEN status = 'ok' THEN cv END AS current_value, CASE WHEN status = 'ok' THEN pv END AS previous_value,
  CASE WHEN status = 'ok' THEN round(cv - pv, 2) END AS change_abs, CASE WHEN status = 'ok' THEN round(round(cv - pv, 2) / abs(nullif(pv, 0)), 4) END AS yoy_rate, status FROM (
  SELECT c.stock_code, company_name, round({div(f'a.{fn}', f'b.{fd}')} * {scale}, 2) AS cv, round({div(f'e.{fn}', f'f.{fd}')} * {scale}, 2) AS pv,
    CASE WHEN a.stock_code IS NULL AND b.stock_code IS NULL THEN 'missing_current_year' WHEN e.stock_code IS NULL AND f.stock_code IS NULL THEN 'missing_previous_year'
         WHEN a.{fn} IS NULL THEN 'empty_numerator_current' WHEN e.{fn} IS NULL THEN 'empty_numerator_previous' WHEN b.{fd} IS NULL THEN 'empty_denominator_current'
         WHEN f.{fd} IS NULL THEN 'empty_denominator_previous' WHEN b.{fd} = 0 THEN 'zero_denominator_current' WHEN f.{fd} = 0 THEN 'zero_denominator_previous' ELSE 'ok' END AS status
  FROM (SELECT * FROM company_dim WHERE {where}) c
  LEFT JOIN {tn} a ON a.stock_code = c.stock_code AND a.report_year = {year} LEFT JOIN {td} b ON b.stock_code = c.stock_code AND b.report_year = {year}
  LEFT JOIN {tn} e ON e.stock_code = c.stock_code AND e.report_year = {year - 1} LEFT JOIN {td} f ON f.stock_code = c.stock_code AND f.report_year = {year - 1})"""


def extremes(rows: str, prefix: str) -> str:
    """rows: CTEs that end in one named r."""
    return f"""{rows}, s AS (
  SELECT metric, CASE WHEN NOT bool_or(status = 'ok') THEN '{prefix}_unavailable' WHEN NOT bool_and(status = 'ok') THEN 'partial_{prefix}_unavailable' ELSE 'ok' END AS metric_status,
    first(company_name ORDER BY {dbl('value')} DESC, stock_code) FILTER (WHERE status = 'ok') AS higher, first(company_name ORDER BY {dbl('value')}, stock_code) FILTER (WHERE status = 'ok') AS lower,
    CASE WHEN count(*) FILTER (WHERE status = 'ok') >= 2 THEN round(max({dbl('value')}) FILTER (WHERE status = 'ok') - min({dbl('value')}) FILTER (WHERE status = 'ok'), 2) END AS diff FROM r GROUP BY metric
) SELECT metric, stock_code, company_name, value, status, metric_status, higher, lower, diff FROM r JOIN s USING (metric)"""


def measured(key: str, year: int, n, d=None) -> str:
    """A CTE `mv` of companies with value; n, d: (table, field)."""
    if d is None:
        inner = f"SELECT stock_code, report_year, {n[1]} AS value FROM {n[0]} WHERE report_year = {year} AND {n[1]} IS NOT NULL"
    else:
        inner = (
            f"SELECT a.stock_code, a.report_year, round({div(f'a.{n[1]}', f'b.{d[1]}')}, 8) AS value FROM {n[0]} a JOIN {d[0]} b ON a.stock_code = b.stock_code AND a.report_year = b.report_year "
            f"WHERE a.report_year = {year} AND a.{n[1]} IS NOT NULL AND b.{d[1]} IS NOT NULL AND b.{d[1]} <> 0"
        )
    return f"mv AS (SELECT c.stock_code, stock_abbr, company_name, report_year, value FROM company_dim c JOIN ({inner}) x ON x.stock_code = c.stock_code)"


def ranking(key, year, n, d=None, direction="desc", limit=10, where="TRUE", grain="nation", extra="") -> str:
    return f"""{marts(grain)}{extra}, {measured(key, year, n, d)}
SELECT row_number() OVER (ORDER BY value {direction}, stock_code) AS position, stock_code, stock_abbr, company_name, report_year, {dbl('value')} AS value FROM mv WHERE {where}
ORDER BY value {direction}, stock_code LIMIT {limit}"""


def pairs(t, f, a, b) -> str:
    return f"(SELECT x.stock_code, x.{f} AS start_value, y.{f} AS end_value FROM {t} x JOIN {t} y ON x.stock_code = y.stock_code WHERE x.report_year = {a} AND y.report_year = {b} AND x.{f} IS NOT NULL AND y.{f} IS NOT NULL AND x.{f} <> 0)"
