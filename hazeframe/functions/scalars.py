"""Scalar column functions (calendar parts, labels, bins, item strings, rounding).

Every function returns a ``Column`` built from Spark built-ins, so it stays inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the analysed pipeline's definitions.
UNHEALTHY_THRESHOLD = 35.4
# hazard level: upper bounds (inclusive) and labels; above the last bound -> "hazardous"
HAZARD_BOUNDS = [12.0, 35.4, 55.4, 150.4]
HAZARD_LABELS = ["good", "moderate", "unhealthy_sensitive", "unhealthy", "hazardous"]
# season by month
DRY_MONTHS = [11, 12, 1, 2]
WET_MONTHS = [5, 6, 7, 8, 9, 10]
SEASONS = ["dry", "transition", "wet"]
# time of day: hour < 6 night, < 12 morning, < 18 afternoon, else evening
TIME_OF_DAY_BOUNDS = [6, 12, 18]
TIME_OF_DAY_LABELS = ["night", "morning", "afternoon", "evening"]
# right-closed bins used for transactions
PM25_LEVEL_EDGES = [0.0, 12.0, 35.4, 55.4, 150.4, 500.0]
PM25_LEVEL_LABELS = ["good", "moderate", "usg", "unhealthy", "hazardous"]
TIME_PERIOD_EDGES = [-1, 6, 12, 18, 24]
TIME_PERIOD_LABELS = ["night", "morning", "afternoon", "evening"]
DAY_TYPE_LABELS = {0: "weekday", 1: "weekend"}
# valid measurement range after gap filling
VALID_MIN, VALID_MAX = 0.0, 999.0
# ---------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c) -> Column:
    """NaN and +-inf become NULL; Spark orders NaN above every number, so it must never leak."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def hour_of(ts) -> Column:
    return F.hour(_c(ts)).cast("int")


def weekday_of(ts) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(ts)).cast("int")


def month_of(ts) -> Column:
    return F.month(_c(ts)).cast("int")


def day_of_year(ts) -> Column:
    return F.dayofyear(_c(ts)).cast("int")


def is_weekend(weekday) -> Column:
    return _c(weekday).isin(5, 6).cast("int")


def season_of(month) -> Column:
    m = _c(month)
    return (F.when(m.isin(*DRY_MONTHS), "dry")
            .when(m.isin(*WET_MONTHS), "wet")
            .when(m.isNotNull(), "transition"))


def time_of_day(hour) -> Column:
    h = _c(hour)
    out = F.when(h.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(TIME_OF_DAY_BOUNDS, TIME_OF_DAY_LABELS):
        out = out.when(h < bound, label)
    return out.otherwise(TIME_OF_DAY_LABELS[-1])


def hazard_level(v) -> Column:
    v = _c(v)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(HAZARD_BOUNDS, HAZARD_LABELS):
        out = out.when(v <= bound, label)
    return out.otherwise(HAZARD_LABELS[-1])


def is_unhealthy(v, threshold: float = UNHEALTHY_THRESHOLD) -> Column:
    return (_c(v) > threshold).cast("int")


def cut(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; values outside every bin give NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs len(edges) == len(labels) + 1")
    c = _c(c)
    out = F.when(c.isNull() | (c <= edges[0]) | (c > edges[-1]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= upper, label)
    return out


def pm25_level(v) -> Column:
    return cut(v, PM25_LEVEL_EDGES, PM25_LEVEL_LABELS)


def time_period(hour) -> Column:
    return cut(hour, TIME_PERIOD_EDGES, TIME_PERIOD_LABELS)


def day_type(weekend_flag) -> Column:
    w = _c(weekend_flag)
    out = F.when(w.isNull(), F.lit(None).cast("string"))
    for code, label in DAY_TYPE_LABELS.items():
        out = out.when(w == code, label)
    return out


def str_or_nan(c) -> Column:
    """Stringify; a missing value becomes the literal 'nan'."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def item(name: str, c=None) -> Column:
    """Transaction item ``name=value``."""
    return F.concat(F.lit(name + "="), str_or_nan(name if c is None else c))


def items_string(arr) -> Column:
    return F.array_join(F.array_sort(_c(arr)), ", ")


def rule_label(antecedent_str, consequent_str, width: int = 60) -> Column:
    return F.concat(F.substring(F.concat(_c(antecedent_str), F.lit(" → "), _c(consequent_str)), 1, width),
                    F.lit("..."))


def round_half_even(c, digits: int) -> Column:
    """Half-even rounding of the value's decimal form (via decimal(38,12), so last-bit noise of a
    double does not move a tie)."""
    return F.bround(_c(c).cast("decimal(38,12)"), digits).cast("double")


def capitalize(c) -> Column:
    """First character upper case, the rest lower case."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, (1 << 31) - 1)))


def slug(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), " ", "_")


def found_count(c) -> Column:
    """Total-count strings: ``'>1000'`` -> 1001, ``'42'`` -> 42, missing or non-digit -> 0."""
    s = F.coalesce(_c(c).cast("string"), F.lit("0"))
    return (F.when(s.startswith(">"), F.substring(s, 2, 64).try_cast("long") + 1)
            .when(s.rlike("^[0-9]+$"), s.try_cast("long"))
            .otherwise(F.lit(0).cast("long")))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres (earth radius 6,371,008.8 m)."""
    r = 6371008.8
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * r) * F.asin(F.sqrt(a))
