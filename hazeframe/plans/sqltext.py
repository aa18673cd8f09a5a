"""ANSI SQL (DuckDB dialect) building blocks for the oracle side of the query catalogue.

Each function returns one or more common-table-expression bodies; ``with_ctes`` glues them in
front of a final SELECT. The driver tables are pre-registered as views in DuckDB.
"""

from __future__ import annotations

READINGS_H = """readings_h AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS datetime, avg(value) AS pm25
  FROM events GROUP BY 1, 2)"""

READINGS_M = """readings_m AS (
  SELECT event_type AS city, date_trunc('minute', ts) AS datetime, avg(value) AS pm25
  FROM events GROUP BY 1, 2)"""

READINGS_D = """readings_d AS (
  SELECT o_orderpriority AS city, CAST(o_orderdate AS TIMESTAMP) AS datetime,
         avg(o_totalprice) / 3000 AS pm25
  FROM orders GROUP BY 1, 2)"""


def gaps(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT city, datetime,
         CASE WHEN rn <= 5 OR rn % 11 IN (3, 4) OR rn BETWEEN 100 AND 140 THEN NULL ELSE pm25 END AS pm25
  FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) AS rn FROM {src}) g)"""


def filled(src: str, name: str = "filled") -> str:
    run = "PARTITION BY city ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    fwd = "PARTITION BY city ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""{name}_i AS (
  SELECT city, datetime, CASE WHEN isnan(pm25) OR isinf(pm25) THEN NULL ELSE pm25 END AS v,
         row_number() OVER (PARTITION BY city ORDER BY datetime) AS rn
  FROM {src}),
{name}_n AS (
  SELECT *,
    last_value(v IGNORE NULLS) OVER ({run}) AS pv,
    last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER ({run}) AS pi,
    first_value(v IGNORE NULLS) OVER ({fwd}) AS nv,
    first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER ({fwd}) AS ni
  FROM {name}_i),
{name}_f AS (
  SELECT city, datetime,
    CASE WHEN v IS NOT NULL THEN v
         WHEN pi IS NULL OR rn - pi > 27 THEN NULL
         WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * least(rn - pi, 3) / (ni - pi) END AS pm25
  FROM {name}_n),
{name} AS (
  SELECT city, datetime, coalesce(pm25, median(pm25) OVER (PARTITION BY city)) AS pm25 FROM {name}_f)"""


def processed(src_filled: str, name: str = "processed") -> str:
    w = "PARTITION BY city ORDER BY rn"
    return f"""{name}_k AS (
  SELECT city, datetime, pm25, row_number() OVER (PARTITION BY city ORDER BY datetime) AS rn
  FROM {src_filled} WHERE pm25 >= 0 AND pm25 <= 999),
{name}_w AS (
  SELECT *,
    avg(pm25) OVER ({w} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS cm,
    stddev_samp(pm25) OVER ({w} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS cs,
    lag(pm25, 1) OVER ({w}) AS lag1,
    lag(pm25, 24) OVER ({w}) AS lag24,
    avg(pm25) OVER ({w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS tm,
    stddev_samp(pm25) OVER ({w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS tsd,
    CAST(lead(CASE WHEN pm25 > 35.4 THEN 1 ELSE 0 END, 1) OVER ({w}) AS INTEGER) AS target_next_hour,
    median(pm25) OVER (PARTITION BY city) AS kmed
  FROM {name}_k),
{name}_m AS (SELECT *, median(cs) OVER (PARTITION BY city) AS kmed_cs FROM {name}_w),
{name} AS (
  SELECT datetime, city, pm25,
    coalesce(CAST(abs((pm25 - cm) / (coalesce(cs, kmed_cs) + 1e-6)) > 4 AS INTEGER), 0) AS is_extreme,
    CAST(hour(datetime) AS INTEGER) AS hour,
    CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
    CAST(month(datetime) AS INTEGER) AS month,
    CAST(dayofyear(datetime) AS INTEGER) AS day_of_year,
    CAST(isodow(datetime) IN (6, 7) AS INTEGER) AS is_weekend,
    CASE WHEN month(datetime) IN (11, 12, 1, 2) THEN 'dry'
         WHEN month(datetime) BETWEEN 5 AND 10 THEN 'wet' ELSE 'transition' END AS season,
    CASE WHEN hour(datetime) < 6 THEN 'night' WHEN hour(datetime) < 12 THEN 'morning'
         WHEN hour(datetime) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
    CASE WHEN pm25 <= 12 THEN 'good' WHEN pm25 <= 35.4 THEN 'moderate'
         WHEN pm25 <= 55.4 THEN 'unhealthy_sensitive' WHEN pm25 <= 150.4 THEN 'unhealthy'
         ELSE 'hazardous' END AS hazard_level,
    CAST(pm25 > 35.4 AS INTEGER) AS is_unhealthy,
    coalesce(lag1, kmed) AS pm25_lag_1h,
    coalesce(lag24, kmed) AS pm25_lag_24h,
    coalesce(tm, kmed) AS pm25_rolling_mean_24h,
    coalesce(tsd, 0) AS pm25_rolling_std_24h,
    target_next_hour
  FROM {name}_m)"""


def chain_h(gappy: bool = True) -> list[str]:
    """readings_h [with gaps] -> filled -> processed (CTE name ``processed``)."""
    ctes = [READINGS_H]
    src = "readings_h"
    if gappy:
        ctes.append(gaps("readings_h", "readings_hg"))
        src = "readings_hg"
    return ctes + [filled(src), processed("filled")]


def chain_m() -> list[str]:
    """readings_m -> filled -> processed (CTE name ``processed``)."""
    return [READINGS_M, filled("readings_m"), processed("filled")]


def chain_d() -> list[str]:
    """readings_d -> filled -> processed (CTE name ``processed``)."""
    return [READINGS_D, filled("readings_d"), processed("filled")]


def r6(x: str, digits: int = 6) -> str:
    """Round half-up on the decimal value (what Spark's ``round`` of a decimal does)."""
    return (f"CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN CAST(round(CAST({x} AS DECIMAL(38, 12)), {digits}) AS DOUBLE) "
            f"ELSE CAST({x} AS DOUBLE) END")


def re2(x: str, digits: int = 2) -> str:
    """Round half-even on the decimal value (Spark ``bround``)."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
