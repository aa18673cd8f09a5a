"""Query catalogue: every registered query runs on the driver tables (whole tables) through the
library operators, next to an equivalent DuckDB SQL text where one exists.

Floating results are rounded to 6 digits on both sides; integer results are cast explicitly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeframe.operators.sequence import DEFAULT_CHUNK_ROWS
from hazeframe.plans import sqltext as Q
from hazeframe.plans.pipeline import filled_readings, processed
from hazeframe.sources import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Chunk size of the positional windows; the tests run the same chain with small chunks.
CHUNK_ROWS = DEFAULT_CHUNK_ROWS


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (the oracle does the same)."""
    def rnd(c):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return F.when(finite, F.round(c.cast("decimal(38,12)"), digits).cast("double")).otherwise(c)
    cols = [rnd(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


# ---- shared bases -----------------------------------------------------------------------------

def hourly(spark, sf):
    return standins.readings_hourly(spark, sf)


def hourly_gappy(spark, sf):
    return standins.with_gaps(hourly(spark, sf))


def processed_h(spark, sf):
    return processed(hourly_gappy(spark, sf), chunk_rows=CHUNK_ROWS)


def processed_d(spark, sf):
    return processed(standins.readings_daily(spark, sf), chunk_rows=CHUNK_ROWS)


H = Q.chain_h()
D = Q.chain_d()


# ---- A1 / W1-W3 / W4-W8 / F1-F6 ---------------------------------------------------------------

@register("hourly_mean", Q.with_ctes([Q.READINGS_H],
          f"SELECT city, datetime, {Q.r6('pm25')} AS pm25 FROM readings_h"))
def hourly_mean(spark, sf):
    return r6(hourly(spark, sf))


@register("gap_fill", Q.with_ctes([Q.READINGS_H, Q.gaps("readings_h", "readings_hg"), Q.filled("readings_hg")],
          f"SELECT city, datetime, {Q.r6('pm25')} AS pm25 FROM filled"))
def gap_fill(spark, sf):
    return r6(filled_readings(hourly_gappy(spark, sf), chunk_rows=CHUNK_ROWS).select("city", "datetime", "pm25"))


_PROC_COLS = ", ".join(f"{Q.r6(c)} AS {c}" if c in ("pm25", "pm25_lag_1h", "pm25_lag_24h",
                                                        "pm25_rolling_mean_24h", "pm25_rolling_std_24h")
                       else c for c in [
    "datetime", "city", "pm25", "is_extreme", "hour", "day_of_week", "month", "day_of_year",
    "is_weekend", "season", "time_of_day", "hazard_level", "is_unhealthy", "pm25_lag_1h",
    "pm25_lag_24h", "pm25_rolling_mean_24h", "pm25_rolling_std_24h", "target_next_hour"])


@register("processed_table", Q.with_ctes(H, f"SELECT {_PROC_COLS} FROM processed"))
def processed_table(spark, sf):
    return r6(processed_h(spark, sf))


@register("processed_daily", Q.with_ctes(D, f"SELECT {_PROC_COLS} FROM processed"))
def processed_daily(spark, sf):
    return r6(processed_d(spark, sf))


# ---- A2 ----------------------------------------------------------------------------------------

_SUMMARY_SQL = f"""SELECT city,
  CAST(count(pm25) AS BIGINT) AS pm25_count,
  {Q.re2('avg(pm25)')} AS pm25_mean, {Q.re2('stddev_samp(pm25)')} AS pm25_std,
  {Q.re2('min(pm25)')} AS pm25_min, {Q.re2('max(pm25)')} AS pm25_max,
  {Q.re2('median(pm25)')} AS pm25_median,
  {Q.re2('avg(is_unhealthy)')} AS is_unhealthy_mean,
  min(datetime) AS datetime_min, max(datetime) AS datetime_max,
  {Q.re2(Q.re2('avg(is_unhealthy)') + ' * 100', 1)} AS unhealthy_pct
FROM processed GROUP BY city"""


@register("city_summary", Q.with_ctes(H, _SUMMARY_SQL))
def city_summary(spark, sf):
    from hazeframe.operators.summaries import city_summary as op
    return r6(op(processed_h(spark, sf)))


# ---- A5-A22, T2 (descriptive tables) ------------------------------------------------------------

from hazeframe.functions import scalars as S  # noqa: E402
from hazeframe.operators import summaries as SM  # noqa: E402

HAZ = S.HAZARD_LABELS
CORR_COLS = ["pm25", "hour", "day_of_week", "month", "is_weekend", "pm25_lag_1h", "pm25_lag_24h",
             "pm25_rolling_mean_24h"]


@register("extreme_rate", Q.with_ctes(D, f"""SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(is_extreme) AS BIGINT) AS extreme_count, {Q.r6('sum(is_extreme) * 100.0 / count(*)')} AS extreme_pct
FROM processed"""))
def extreme_rate(spark, sf):
    return r6(SM.extreme_rate(processed_d(spark, sf)))


@register("daily_mean", Q.with_ctes(H, f"""SELECT city, CAST(datetime AS DATE) AS date, {Q.r6('avg(pm25)')} AS pm25_mean
FROM processed GROUP BY 1, 2"""))
def daily_mean(spark, sf):
    return r6(SM.daily_mean(processed_h(spark, sf)))


@register("monthly_mean", Q.with_ctes(D, f"""SELECT city, month, {Q.r6('avg(pm25)')} AS pm25_mean
FROM processed GROUP BY 1, 2"""))
def monthly_mean(spark, sf):
    return r6(SM.group_mean(processed_d(spark, sf), ["city", "month"]))


@register("hour_profile", Q.with_ctes(H, f"""SELECT city, hour, {Q.r6('avg(pm25)')} AS pm25_mean
FROM processed GROUP BY 1, 2"""))
def hour_profile(spark, sf):
    return r6(SM.group_mean(processed_h(spark, sf), ["city", "hour"]))


@register("weekday_profile", Q.with_ctes(D, f"""SELECT city, day_of_week, {Q.r6('avg(pm25)')} AS pm25_mean
FROM processed GROUP BY 1, 2"""))
def weekday_profile(spark, sf):
    return r6(SM.group_mean(processed_d(spark, sf), ["city", "day_of_week"]))


def _mix_sql(key: str) -> list[str]:
    cs = ", ".join(f"sum(CASE WHEN hazard_level = '{lv}' THEN 1 ELSE 0 END) AS c{i}" for i, lv in enumerate(HAZ))
    ps = ", ".join(f"sum(c{i}) AS p{i}" for i in range(len(HAZ)))
    return [f"mix_m AS (SELECT {key}, count(*) AS t, {cs} FROM processed GROUP BY {key})",
            f"mix_p AS (SELECT {ps} FROM mix_m)",
            "mix AS (SELECT {k}, {cols} FROM mix_m, mix_p)".format(
                k=key, cols=", ".join(f"CASE WHEN p{i} > 0 THEN {Q.r6(f'c{i} * 100.0 / t')} END AS {lv}"
                                      for i, lv in enumerate(HAZ)))]


@register("hazard_mix_by_city", Q.with_ctes(D + _mix_sql("city"), "SELECT * FROM mix"))
def hazard_mix_by_city(spark, sf):
    return r6(SM.level_mix(processed_d(spark, sf), "city", "hazard_level", HAZ))


@register("hazard_mix_by_season", Q.with_ctes(D + _mix_sql("season"), """SELECT s.season, CAST(s.ord AS INTEGER) AS ord,
  good, moderate, unhealthy_sensitive, unhealthy, hazardous
FROM (VALUES ('dry', 0), ('transition', 1), ('wet', 2)) s(season, ord) LEFT JOIN mix USING (season)"""))
def hazard_mix_by_season(spark, sf):
    return r6(SM.level_mix(processed_d(spark, sf), "season", "hazard_level", HAZ, row_order=S.SEASONS))


@register("hazard_share_long", Q.with_ctes(D, f"""SELECT city, hazard_level,
  {Q.re2('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY city)', 1)} AS share_pct
FROM processed GROUP BY city, hazard_level"""))
def hazard_share_long(spark, sf):
    return r6(SM.level_share_long(processed_d(spark, sf), "city", "hazard_level"))


def _corr_sql(cols: list[str]) -> str:
    parts = [f"stddev_pop({c}) AS s{i}" for i, c in enumerate(cols)]
    parts += [f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS v{i}_{j}"
              for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    sels = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = f"CASE WHEN s{i} > 0 THEN 1.0 END" if i == j else f"v{min(i, j)}_{max(i, j)}"
            sels.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {Q.r6(v)} AS corr FROM cs")
    return Q.with_ctes(D + [f"cs AS (SELECT {', '.join(parts)} FROM processed)"], "\nUNION ALL ".join(sels))


@register("correlation_matrix", _corr_sql(CORR_COLS))
def correlation_matrix(spark, sf):
    return r6(SM.correlation_long(processed_d(spark, sf), CORR_COLS))


@register("city_compare", Q.with_ctes(D, f"""SELECT city, {Q.r6('avg(pm25)')} AS pm25_mean,
  {Q.r6('stddev_samp(pm25)')} AS pm25_std, {Q.r6('median(pm25)')} AS pm25_median,
  CAST(row_number() OVER (ORDER BY avg(pm25), city) AS INTEGER) AS mean_rank
FROM processed GROUP BY city"""))
def city_compare(spark, sf):
    return r6(SM.city_compare(processed_d(spark, sf)))


@register("unhealthy_pct", Q.with_ctes(D, f"""SELECT city, {Q.r6('avg(is_unhealthy) * 100')} AS unhealthy_pct,
  CAST(row_number() OVER (ORDER BY avg(is_unhealthy) * 100, city) AS INTEGER) AS pct_rank
FROM processed GROUP BY city"""))
def unhealthy_pct(spark, sf):
    return r6(SM.rate_by(processed_d(spark, sf), "city"))


@register("season_pivot", Q.with_ctes(D, f"""SELECT city,
  {Q.r6("avg(CASE WHEN season = 'dry' THEN pm25 END)")} AS dry,
  {Q.r6("avg(CASE WHEN season = 'transition' THEN pm25 END)")} AS transition,
  {Q.r6("avg(CASE WHEN season = 'wet' THEN pm25 END)")} AS wet
FROM processed GROUP BY city"""))
def season_pivot(spark, sf):
    return r6(SM.mean_pivot(processed_d(spark, sf), "city", "season", S.SEASONS))


@register("season_mean", Q.with_ctes(D, f"""SELECT season, upper(substr(season, 1, 1)) || lower(substr(season, 2)) AS season_label,
  {Q.r6('avg(pm25)')} AS pm25_mean FROM processed GROUP BY season"""))
def season_mean(spark, sf):
    d = SM.group_mean(processed_d(spark, sf), ["season"])
    return r6(d.withColumn("season_label", S.capitalize("season")))


@register("argmax_groups", Q.with_ctes(D + ["k AS (SELECT city, avg(pm25) AS m FROM processed GROUP BY city)",
                                            "s AS (SELECT season, avg(pm25) AS m FROM processed GROUP BY season)"],
          f"""SELECT (SELECT city FROM k ORDER BY m DESC, city LIMIT 1) AS most_polluted,
  (SELECT city FROM k ORDER BY m, city LIMIT 1) AS cleanest,
  (SELECT season FROM s ORDER BY m DESC, season LIMIT 1) AS worst_season,
  (SELECT {Q.r6('avg(is_unhealthy) * 100')} FROM processed) AS overall_unhealthy_pct"""))
def argmax_groups(spark, sf):
    return r6(SM.argmax_groups(processed_d(spark, sf)))


@register("overview", Q.with_ctes(H, """SELECT CAST(count(*) AS BIGINT) AS n_rows, min(datetime) AS datetime_min,
  max(datetime) AS datetime_max, CAST(count(DISTINCT city) AS BIGINT) AS n_cities,
  array_to_string(list_sort(list_distinct(list(city))), ', ') AS cities, CAST(18 AS INTEGER) AS n_columns
FROM processed"""))
def overview(spark, sf):
    return SM.overview(processed_h(spark, sf))


@register("top_hours", Q.with_ctes(H, f"""SELECT * FROM (SELECT hour, {Q.r6('avg(pm25)')} AS pm25_mean,
  CAST(row_number() OVER (ORDER BY avg(pm25) DESC, hour) AS INTEGER) AS rank
FROM processed GROUP BY hour) t WHERE rank <= 3"""))
def top_hours(spark, sf):
    return r6(SM.top_groups(processed_h(spark, sf), "hour", n=3))


def _hist_sql(bins: int) -> str:
    w = f"((mx - mn) / {bins})"
    return Q.with_ctes(H + [
        "r AS (SELECT city, min(pm25) AS mn, max(pm25) AS mx, count(pm25) AS n FROM processed GROUP BY city)",
        f"""b AS (SELECT p.city, CASE WHEN mx = mn THEN 0
             ELSE CAST(least(floor((pm25 - mn) * {bins} / (mx - mn)), {bins - 1}) AS INTEGER) END AS bin
           FROM processed p JOIN r USING (city) WHERE pm25 IS NOT NULL)""",
        "c AS (SELECT city, bin, count(*) AS c FROM b GROUP BY 1, 2)",
        f"sp AS (SELECT city, mn, mx, n, unnest(range(0, {bins})) AS bin FROM r)"],
        f"""SELECT sp.city, CAST(sp.bin AS INTEGER) AS bin, {Q.r6(f'mn + sp.bin * {w}')} AS bin_lo,
  {Q.r6(f'mn + (sp.bin + 1) * {w}')} AS bin_hi, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
  CASE WHEN {w} > 0 THEN {Q.r6(f'coalesce(c.c, 0) / (n * {w})')} END AS density
FROM sp LEFT JOIN c ON sp.city = c.city AND sp.bin = c.bin""")


@register("histogram_50", _hist_sql(50))
def histogram_50(spark, sf):
    return r6(SM.histogram(processed_h(spark, sf), "city", "pm25", 50))


@register("boxplot_stats", Q.with_ctes(H + ["""q AS (SELECT city, quantile_cont(pm25, 0.25) AS q1,
  quantile_cont(pm25, 0.5) AS med, quantile_cont(pm25, 0.75) AS q3 FROM processed GROUP BY city)"""],
          f"""SELECT q.city, {Q.r6('q1')} AS q1, {Q.r6('med')} AS median, {Q.r6('q3')} AS q3, {Q.r6('q3 - q1')} AS iqr,
  {Q.r6('min(CASE WHEN pm25 >= q1 - 1.5 * (q3 - q1) THEN pm25 END)')} AS whisker_lo,
  {Q.r6('max(CASE WHEN pm25 <= q3 + 1.5 * (q3 - q1) THEN pm25 END)')} AS whisker_hi,
  CAST(sum(CASE WHEN pm25 < q1 - 1.5 * (q3 - q1) OR pm25 > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  CAST(row_number() OVER (ORDER BY med DESC, q.city) AS INTEGER) AS median_rank
FROM processed p JOIN q USING (city) GROUP BY q.city, q1, med, q3"""))
def boxplot_stats(spark, sf):
    return r6(SM.boxplot_stats(processed_h(spark, sf)))


# ---- M28-M30, A35, P10-P11, T5-T7 (association) --------------------------------------------------

from hazeframe.operators import association as AS  # noqa: E402

_TX = """tx AS (
  SELECT 'city=' || coalesce(CAST(city AS VARCHAR), 'nan') AS i1,
         'season=' || coalesce(season, 'nan') AS i2,
         'time_period=' || coalesce(CASE WHEN hour <= -1 OR hour > 24 THEN NULL WHEN hour <= 6 THEN 'night'
              WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon' ELSE 'evening' END, 'nan') AS i3,
         'day_type=' || coalesce(CASE WHEN is_weekend = 0 THEN 'weekday' WHEN is_weekend = 1 THEN 'weekend' END, 'nan') AS i4,
         'pm25_level=' || coalesce(CASE WHEN pm25 IS NULL OR pm25 <= 0 OR pm25 > 500 THEN NULL
              WHEN pm25 <= 12 THEN 'good' WHEN pm25 <= 35.4 THEN 'moderate' WHEN pm25 <= 55.4 THEN 'usg'
              WHEN pm25 <= 150.4 THEN 'unhealthy' ELSE 'hazardous' END, 'nan') AS i5
  FROM processed)"""

_ITEMSETS = [_TX, """cells AS (
  SELECT list_sort(list_filter([CASE WHEN grouping(i1) = 0 THEN i1 END, CASE WHEN grouping(i2) = 0 THEN i2 END,
           CASE WHEN grouping(i3) = 0 THEN i3 END, CASE WHEN grouping(i4) = 0 THEN i4 END,
           CASE WHEN grouping(i5) = 0 THEN i5 END], lambda x: x IS NOT NULL)) AS items,
         count(*) AS freq
  FROM tx GROUP BY CUBE (i1, i2, i3, i4, i5))""",
  """fi AS (
  SELECT items, array_to_string(items, ', ') AS itemset, CAST(freq AS BIGINT) AS freq,
         freq / (SELECT count(*) FROM tx) AS support, CAST(len(items) AS INTEGER) AS length
  FROM cells WHERE len(items) > 0 AND freq / (SELECT count(*) FROM tx) >= 0.03)"""]

_RULES = _ITEMSETS + ["""rs AS (
  SELECT array_to_string(list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1), ', ') AS a,
         array_to_string(list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0), ', ') AS c, support
  FROM fi, range(1, 31) t(m) WHERE length >= 2 AND m <= (1 << length) - 2)""",
  """rules AS (
  SELECT rs.a AS antecedents_str, rs.c AS consequents_str, fa.support AS antecedent_support,
         fc.support AS consequent_support, rs.support AS support,
         rs.support / fa.support AS confidence, rs.support / fa.support / fc.support AS lift
  FROM rs JOIN fi fa ON fa.itemset = rs.a JOIN fi fc ON fc.itemset = rs.c
  WHERE rs.support / fa.support >= 0.4 AND rs.support / fa.support / fc.support >= 1.1)"""]

_RULE_COLS = ("antecedents_str, consequents_str, " + ", ".join(
    f"{Q.r6(c)} AS {c}" for c in ["antecedent_support", "consequent_support", "support", "confidence", "lift"]))


def _rules(spark, sf, min_lift=AS.MIN_LIFT):
    tx = AS.transactions(processed_d(spark, sf))
    return AS.association_rules(AS.frequent_itemsets(tx), AS.MIN_CONFIDENCE, min_lift)


# No rule of the synthetic tables reaches lift 1.1, so the rule post-processing queries below run
# on the confidence-only rule set (the rule table before the lift filter) to check real rows.
# The rule table is materialised before the text filters run on it.
_RULES_CONF = _RULES[:-1] + [_RULES[-1].replace("rules AS (", "rules AS MATERIALIZED (", 1).replace(" AND rs.support / fa.support / fc.support >= 1.1", "")]


def _itemsets(spark, sf):
    return AS.frequent_itemsets(AS.transactions(processed_d(spark, sf)))


@register("transactions", Q.with_ctes(D + [_TX], """SELECT i1 || ', ' || i2 || ', ' || i3 || ', ' || i4 || ', ' || i5 AS basket,
  CAST(count(*) AS BIGINT) AS n FROM tx GROUP BY 1"""))
def transactions_q(spark, sf):
    tx = AS.transactions(processed_d(spark, sf))
    return tx.groupBy(F.array_join("items", ", ").alias("basket")).agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("frequent_itemsets", Q.with_ctes(D + _ITEMSETS, f"SELECT itemset, freq, {Q.r6('support')} AS support, length FROM fi"))
def frequent_itemsets_q(spark, sf):
    return r6(_itemsets(spark, sf).select("itemset", "freq", "support", "length"))


@register("frequent_itemsets_fpgrowth", Q.with_ctes(D + _ITEMSETS, f"SELECT itemset, freq, {Q.r6('support')} AS support, length FROM fi"))
def frequent_itemsets_fpgrowth_q(spark, sf):
    tx = AS.transactions(processed_d(spark, sf))
    return r6(AS.frequent_itemsets_baskets(tx.select("items")).select("itemset", "freq", "support", "length"))


@register("itemset_lengths", Q.with_ctes(D + _ITEMSETS, "SELECT length, CAST(count(*) AS BIGINT) AS n_itemsets FROM fi GROUP BY length"))
def itemset_lengths_q(spark, sf):
    return AS.itemset_lengths(_itemsets(spark, sf))


@register("top_items", Q.with_ctes(D + _ITEMSETS, f"""SELECT * FROM (SELECT items[1] AS item, {Q.r6('support')} AS support,
  CAST(row_number() OVER (ORDER BY support DESC, items[1]) AS INTEGER) AS support_rank FROM fi WHERE length = 1) t
WHERE support_rank <= 20"""))
def top_items_q(spark, sf):
    return r6(AS.top_single_items(_itemsets(spark, sf), 20))


@register("assoc_rules", Q.with_ctes(D + _RULES, f"""SELECT {_RULE_COLS},
  CAST(row_number() OVER (ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS lift_rank FROM rules"""))
def assoc_rules_q(spark, sf):
    return r6(AS.rank_rules(_rules(spark, sf)).drop("antecedent", "consequent"))


@register("assoc_rules_confident", Q.with_ctes(D + _RULES_CONF, f"""SELECT {_RULE_COLS},
  CAST(row_number() OVER (ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS lift_rank FROM rules"""))
def assoc_rules_confident_q(spark, sf):
    return r6(AS.rank_rules(_rules(spark, sf, None)).drop("antecedent", "consequent"))


@register("rules_with_level", Q.with_ctes(D + _RULES_CONF, f"""SELECT {_RULE_COLS} FROM rules
WHERE contains(antecedents_str, 'pm25_level=') OR contains(consequents_str, 'pm25_level=')"""))
def rules_with_level_q(spark, sf):
    return r6(AS.rules_with_level(_rules(spark, sf, None)).drop("antecedent", "consequent"))


@register("rules_by_consequent", Q.with_ctes(D + _RULES_CONF, f"""SELECT * FROM (
  SELECT lv.level, {_RULE_COLS},
         CAST(count(*) OVER (PARTITION BY lv.level) AS BIGINT) AS level_rules,
         CAST(row_number() OVER (PARTITION BY lv.level ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS level_rank
  FROM rules JOIN (VALUES ('good'), ('moderate'), ('usg'), ('unhealthy'), ('hazardous')) lv(level)
    ON contains(consequents_str, 'pm25_level=' || lv.level)) t
WHERE level_rank <= 3"""))
def rules_by_consequent_q(spark, sf):
    return r6(AS.rules_by_consequent(_rules(spark, sf, None)).drop("antecedent", "consequent"))


@register("rule_labels", Q.with_ctes(D + _RULES_CONF, f"""SELECT lift_rank, rule, {Q.r6('lift')} AS lift, {Q.r6('confidence')} AS confidence FROM (
  SELECT substr(antecedents_str || ' → ' || consequents_str, 1, 60) || '...' AS rule, lift, confidence,
         CAST(row_number() OVER (ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS lift_rank
  FROM rules) t WHERE lift_rank <= 15"""))
def rule_labels_q(spark, sf):
    return r6(AS.rule_labels(_rules(spark, sf, None), 15))


# Levels that depend on the key, so that rules reach the lift of 1.1.
_DISCOUNT = ["""processed AS (
  SELECT CASE WHEN l_discount < 0.035 THEN 'low' WHEN l_discount < 0.075 THEN 'mid' ELSE 'high' END AS city,
         CASE WHEN month(l_shipdate) IN (11, 12, 1, 2) THEN 'dry' WHEN month(l_shipdate) BETWEEN 5 AND 10 THEN 'wet' ELSE 'transition' END AS season,
         CAST(hour(l_shipdate) AS INTEGER) AS hour, CAST(isodow(l_shipdate) IN (6, 7) AS INTEGER) AS is_weekend,
         l_extendedprice * l_discount / 20 AS pm25 FROM lineitem)"""]


def _lift_rules(spark, sf):
    from hazeframe.operators.features import add_calendar

    tx = AS.transactions(add_calendar(standins.readings_discount(spark, sf)))
    return AS.association_rules(AS.frequent_itemsets(tx))


@register("assoc_rules_lift", Q.with_ctes(_DISCOUNT + _RULES, f"""SELECT {_RULE_COLS},
  CAST(row_number() OVER (ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS lift_rank FROM rules"""))
def assoc_rules_lift_q(spark, sf):
    """M30 at the analysed thresholds (support 0.03, confidence 0.4, lift 1.1)."""
    return r6(AS.rank_rules(_lift_rules(spark, sf)).drop("antecedent", "consequent"))


@register("rules_by_consequent_lift", Q.with_ctes(_DISCOUNT + _RULES, f"""SELECT * FROM (
  SELECT lv.level, {_RULE_COLS},
         CAST(count(*) OVER (PARTITION BY lv.level) AS BIGINT) AS level_rules,
         CAST(row_number() OVER (PARTITION BY lv.level ORDER BY lift DESC, antecedents_str, consequents_str) AS INTEGER) AS level_rank
  FROM rules JOIN (VALUES ('good'), ('moderate'), ('usg'), ('unhealthy'), ('hazardous')) lv(level)
    ON contains(consequents_str, 'pm25_level=' || lv.level)) t
WHERE level_rank <= 3"""))
def rules_by_consequent_lift_q(spark, sf):
    return r6(AS.rules_by_consequent(_lift_rules(spark, sf)).drop("antecedent", "consequent"))


# ---- M1-M5, M13, M7, M9, A23-A26 (modelling base, classifiers, evaluation) ------------------------

from hazeframe.operators import classify as CL  # noqa: E402
from hazeframe.operators import evaluate as EV  # noqa: E402
from hazeframe.operators import prep as PR  # noqa: E402

H_LEVELS = ["click", "error", "purchase", "signup", "view"]  # keys of the hourly view
FEATS = PR.FORECAST_FEATURES + [f"city_{lv}" for lv in H_LEVELS]


def _frame_with_split(spark, sf):
    p = processed_h(spark, sf)
    d, cols = PR.forecast_frame(p, levels=H_LEVELS)
    d = d.withColumn("is_test", ((F.dayofyear("datetime") * 24 + F.hour("datetime")) % 5) == 0)
    return d, cols


_FRAME_SQL = """fr AS (
  SELECT city, datetime, hour, day_of_week, month, is_weekend, pm25_lag_1h, pm25_lag_24h,
         pm25_rolling_mean_24h, pm25_rolling_std_24h,
         """ + ", ".join(f"CAST(city = '{lv}' AS INTEGER) AS city_{lv}" for lv in H_LEVELS) + """,
         CAST(target_next_hour AS INTEGER) AS label, (day_of_year * 24 + hour) % 5 = 0 AS is_test
  FROM processed WHERE target_next_hour IS NOT NULL)"""


def _scaled_sql(src: str, fit_where: str, name: str) -> str:
    stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATS)
    cols = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END AS {c}" for c in FEATS)
    return (f"{name}_st AS (SELECT {stats} FROM {src} WHERE {fit_where}),\n"
            f"{name} AS (SELECT city, datetime, label, is_test, {cols} FROM {src}, {name}_st)")


@register("impute_scale_onehot", Q.with_ctes(H + [_FRAME_SQL, _scaled_sql("fr", "true", "sc")],
          "SELECT city, datetime, label, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in FEATS) + " FROM sc"))
def impute_scale_onehot(spark, sf):
    d, cols = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    return r6(PR.standardize(d, cols).select("city", "datetime", "label", *cols))


@register("impute_standardize_nulls", Q.with_ctes([Q.READINGS_H, Q.gaps("readings_h", "readings_hg"),
  "im AS (SELECT city, datetime, coalesce(pm25, (SELECT median(pm25) FROM readings_hg)) AS v FROM readings_hg)"],
  f"SELECT city, datetime, {Q.r6('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()')} AS pm25 FROM im"))
def impute_standardize_nulls(spark, sf):
    """M2 / M22 on a column with NULLs."""
    from hazeframe.operators.cluster import cluster_frame

    return r6(cluster_frame(hourly_gappy(spark, sf), ["pm25"]))


@register("zscore_nulls", Q.with_ctes([Q.READINGS_H, Q.gaps("readings_h", "readings_hg"),
  "im AS (SELECT city, datetime, coalesce(pm25, (SELECT median(pm25) FROM readings_hg)) AS v FROM readings_hg)"],
  "SELECT city, datetime, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) > 1 AS anomaly_zscore FROM im"))
def zscore_nulls(spark, sf):
    """M24 on a column with NULLs, at a threshold that rows reach."""
    from hazeframe.operators.anomaly import zscore_flag

    return zscore_flag(hourly_gappy(spark, sf), threshold=1.0).select("city", "datetime", "anomaly_zscore")


@register("split_counts", Q.with_ctes(H + [_FRAME_SQL], """SELECT label, CAST(count(*) AS BIGINT) AS n,
  CAST(round(count(*) * 0.2) AS BIGINT) AS n_test, CAST(count(*) - round(count(*) * 0.2) AS BIGINT) AS n_train
FROM fr GROUP BY label"""))
def split_counts(spark, sf):
    d, _ = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    s = PR.stratified_split(d)
    return s.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                  F.sum(F.col("is_test").cast("long")).alias("n_test"),
                                  F.sum((~F.col("is_test")).cast("long")).alias("n_train"))


@register("fold_counts", Q.with_ctes(H + [_FRAME_SQL], """SELECT label, CAST(f AS INTEGER) AS fold,
  CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT label, count(*) AS n FROM fr GROUP BY label) c, range(0, 5) t(f)"""))
def fold_counts(spark, sf):
    d, _ = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    return PR.stratified_folds(d).groupBy("label", "fold").agg(F.count(F.lit(1)).cast("long").alias("n"))


def _nb_sql() -> list[str]:
    parts = ["count(*) AS n"]
    for c in (0, 1):
        parts.append(f"sum(CASE WHEN label = {c} THEN 1 ELSE 0 END) AS n{c}")
        for j, f in enumerate(FEATS):
            parts.append(f"avg(CASE WHEN label = {c} THEN {f} END) AS mu{c}_{j}")
            parts.append(f"var_pop(CASE WHEN label = {c} THEN {f} END) AS v{c}_{j}")
    parts += [f"var_pop({f}) AS vall_{j}" for j, f in enumerate(FEATS)]
    eps = "greatest(" + ", ".join(f"vall_{j}" for j in range(len(FEATS))) + ") * 1e-9"

    def jll(c):
        terms = " + ".join(f"(-0.5 * ln(2 * pi() * (v{c}_{j} + eps)) - power({f} - mu{c}_{j}, 2) / (2.0 * (v{c}_{j} + eps)))"
                           for j, f in enumerate(FEATS))
        return f"ln(n{c} / n) + {terms}"

    return [f"nbm AS (SELECT {', '.join(parts)} FROM fr WHERE NOT is_test)",
            f"nbe AS (SELECT *, {eps} AS eps FROM nbm)",
            f"nbj AS (SELECT fr.city, fr.datetime, fr.label, {jll(0)} AS j0, {jll(1)} AS j1 FROM fr, nbe WHERE fr.is_test)",
            "nb AS (SELECT city, datetime, label, 1.0 / (1.0 + exp(least(j0 - j1, 700.0))) AS score, "
            "CAST(j1 > j0 AS INTEGER) AS prediction FROM nbj)"]


NB_CTES = H + [_FRAME_SQL] + _nb_sql()


def _nb_pred(spark, sf):
    d, cols = _frame_with_split(spark, sf)
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    return CL.gnb_predict(te.select("city", "datetime", "label", *cols), CL.gnb_fit(tr, cols), cols)


@register("gaussian_nb", Q.with_ctes(NB_CTES, f"SELECT city, datetime, label, {Q.r6('score')} AS score, prediction FROM nb"))
def gaussian_nb(spark, sf):
    return r6(_nb_pred(spark, sf).select("city", "datetime", "label", "score", "prediction"))


@register("confusion", Q.with_ctes(NB_CTES, """SELECT g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)
LEFT JOIN (SELECT label, prediction, count(*) AS n FROM nb GROUP BY 1, 2) c USING (label, prediction)"""))
def confusion(spark, sf):
    return EV.confusion(_nb_pred(spark, sf))


@register("classification_metrics", Q.with_ctes(NB_CTES + ["""cm AS (SELECT sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hit, count(*) AS n FROM nb)"""],
          f"""SELECT {Q.r6('hit / n')} AS accuracy,
  {Q.r6('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS precision,
  {Q.r6('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS recall,
  {Q.r6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1 FROM cm"""))
def classification_metrics(spark, sf):
    return r6(EV.binary_metrics(_nb_pred(spark, sf)))


_SCORES = """sg AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n FROM nb GROUP BY score),
sb AS (SELECT s, p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
              coalesce(sum(p) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM sg)"""


@register("roc_auc", Q.with_ctes(NB_CTES + [_SCORES], f"SELECT {Q.r6('sum(p * (nb + n / 2.0)) / (sum(p) * sum(n))')} AS roc_auc FROM sb"))
def roc_auc(spark, sf):
    return r6(EV.roc_auc(_nb_pred(spark, sf)))


@register("roc_curve", Q.with_ctes(NB_CTES + [_SCORES], f"""SELECT {Q.r6('s')} AS threshold,
  {Q.r6('(sum(n) OVER () - nb) / sum(n) OVER ()')} AS fpr, {Q.r6('(sum(p) OVER () - pb) / sum(p) OVER ()')} AS tpr FROM sb
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0"""))
def roc_curve(spark, sf):
    return r6(EV.roc_curve(_nb_pred(spark, sf)))


def _knn_pred(spark, sf):
    d, cols = _frame_with_split(spark, sf)
    tr = d.where(~F.col("is_test"))
    sc = PR.scaler_fit(tr, cols)
    d = PR.scaler_apply(d, sc, cols)
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    return CL.knn_classify(tr, te.select("city", "datetime", "label", *cols), cols, ["city", "datetime"])


_KNN_SQL = [_scaled_sql("fr", "NOT is_test", "ks"), """kd AS (
  SELECT q.city, q.datetime, q.label, t.label AS y, sqrt(""" + " + ".join(f"power(q.{c} - t.{c}, 2)" for c in FEATS) + """) AS dist,
         row_number() OVER (PARTITION BY q.city, q.datetime ORDER BY round(sqrt(""" + " + ".join(f"power(q.{c} - t.{c}, 2)" for c in FEATS) + """), 9), t.city, t.datetime) AS rk
  FROM ks q, ks t WHERE q.is_test AND NOT t.is_test)""",
  """knn AS (SELECT city, datetime, label,
  CASE WHEN sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) > 0
       THEN sum(CASE WHEN dist = 0 THEN y END) / sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END)
       ELSE sum(CASE WHEN dist > 0 THEN y / dist END) / sum(CASE WHEN dist > 0 THEN 1.0 / dist END) END AS score
  FROM kd WHERE rk <= 7 GROUP BY city, datetime, label)"""]


@register("knn_classify", Q.with_ctes(H + [_FRAME_SQL] + _KNN_SQL,
          f"SELECT city, datetime, label, {Q.r6('score')} AS score, CAST(score > 0.5 AS INTEGER) AS prediction FROM knn"))
def knn_classify(spark, sf):
    return r6(_knn_pred(spark, sf).select("city", "datetime", "label", "score", "prediction"))


def _tree_sql(src: str, depth: int) -> list[str]:
    """The tree over the training rows by exhaustive splits, one level after the other."""
    long = " UNION ALL ".join(f"SELECT node, label, {i} AS f, CAST({c} AS DOUBLE) AS v FROM {{rows}}" for i, c in enumerate(FEATS))
    value = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(FEATS)) + " END"
    gini = lambda a, b: f"(1.0 - (({a}) / (({a}) + ({b}))) * (({a}) / (({a}) + ({b}))) - (({b}) / (({a}) + ({b}))) * (({b}) / (({a}) + ({b}))))"
    a0, a1, b0, b1, t0, t1 = "l0 * w0", "l1 * w1", "(t0 - l0) * w0", "(t1 - l1) * w1", "t0 * w0", "t1 * w1"
    whole = f"({a0} + {a1} + {b0} + {b1})"
    gain = f"{gini(t0, t1)} - ({a0} + {a1}) / {whole} * {gini(a0, a1)} - ({b0} + {b1}) / {whole} * {gini(b0, b1)}"
    ctes = [f"cw AS (SELECT CAST(count(*) AS DOUBLE) / (2 * sum(1 - label)) AS w0, CAST(count(*) AS DOUBLE) / (2 * sum(label)) AS w1 FROM {src} WHERE NOT is_test)",
            f"tr0 AS MATERIALIZED (SELECT 1 AS node, * FROM {src})"]
    for t in range(depth):
        ctes += [
            f"tt{t} AS (SELECT node, sum(1 - label) AS t0, sum(label) AS t1 FROM tr{t} WHERE NOT is_test GROUP BY node HAVING count(*) >= 100 AND sum(label) BETWEEN 1 AND count(*) - 1)",
            f"tl{t} AS (SELECT node, f, v, sum(1 - label) AS n0, sum(label) AS n1 FROM ({long.format(rows=f'(SELECT * FROM tr{t} WHERE NOT is_test)')}) GROUP BY node, f, v)",
            f"tc{t} AS (SELECT node, f, v, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, lead(v) OVER w AS nx FROM tl{t} WINDOW w AS (PARTITION BY node, f ORDER BY v))",
            f"tg{t} AS (SELECT c.*, t0, t1, {gain} AS g FROM tc{t} c JOIN tt{t} USING (node), cw WHERE l0 + l1 >= 50 AND t0 + t1 - l0 - l1 >= 50)",
            f"tb{t} AS MATERIALIZED (SELECT *, v / 2 + nx / 2 AS thr FROM tg{t} QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(g, 12) DESC, f, v) = 1)",
            f"tr{t + 1} AS MATERIALIZED (SELECT CASE WHEN b.f IS NULL THEN r.node ELSE r.node * 2 + CAST({value} > thr AS INTEGER) END AS node, r.* EXCLUDE (node) "
            f"FROM tr{t} r LEFT JOIN tb{t} b ON b.node = r.node)"]
    ctes.append(f"tv AS (SELECT node, sum(label * w1) / sum(label * w1 + (1 - label) * w0) AS score FROM tr{depth}, cw WHERE NOT is_test GROUP BY node)")
    return ctes


_TREE_SQL = H + [_FRAME_SQL] + _tree_sql("fr", 10)


def _tree_model(spark, sf):
    d, cols = _frame_with_split(spark, sf)
    d = materialize(d)
    return CL.tree_fit(d.where(~F.col("is_test")), cols), d.where(F.col("is_test")), cols


@register("tree_predict", Q.with_ctes(_TREE_SQL, f"""SELECT city, datetime, label, {Q.r6('score')} AS score, CAST(score > 0.5 AS INTEGER) AS prediction
FROM tr10 JOIN tv USING (node) WHERE is_test"""))
def tree_predict(spark, sf):
    m, te, cols = _tree_model(spark, sf)
    return r6(CL.tree_predict(m, te.select("city", "datetime", "label", *cols), cols)
              .select("city", "datetime", "label", "score", "prediction"))


@register("feature_importance", Q.with_ctes(_TREE_SQL + ["ig AS (" + " UNION ALL ".join(
    f"SELECT f, (t0 * w0 + t1 * w1) * g AS s FROM tb{t}, cw" for t in range(10)) + ")",
  "nm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATS)) + ") n(f, feature))",
  "im AS (SELECT feature, coalesce(sum(s), 0) / (SELECT sum(s) FROM ig) AS importance FROM nm LEFT JOIN ig USING (f) GROUP BY feature)"],
  f"SELECT feature, {Q.r6('importance')} AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM im"))
def feature_importance(spark, sf):
    m, _, cols = _tree_model(spark, sf)
    return r6(CL.feature_importance(m, cols, spark))


@register("svm_calibrated")
def svm_calibrated(spark, sf):
    d, cols = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    s = PR.stratified_split(d)
    tr = s.where(~F.col("is_test"))
    sc = PR.scaler_fit(tr, cols)
    s = PR.scaler_apply(s, sc, cols)
    pairs = CL.svm_calibrated_fit(s.where(~F.col("is_test")), cols)
    return r6(CL.svm_calibrated_predict(pairs, s.where(F.col("is_test")).select("city", "datetime", "label", *cols), cols)
              .select("city", "datetime", "label", "score", "prediction"))


def _model_rows(spark, sf):
    """One metric row (A24 + A25) for each of the four models on one stratified split."""
    d, cols = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    s = materialize(PR.stratified_split(d))
    tr, te = s.where(~F.col("is_test")), s.where(F.col("is_test")).select("city", "datetime", "label", *cols)
    sc = materialize(PR.scaler_apply(s, PR.scaler_fit(tr, cols), cols))
    str_, ste = sc.where(~F.col("is_test")), sc.where(F.col("is_test")).select("city", "datetime", "label", *cols)
    pred = {
        "Decision Tree": CL.tree_predict(CL.tree_fit(tr, cols), te, cols),
        "k-NN": CL.knn_classify(str_, ste, cols, ["city", "datetime"]),
        "Linear SVM": CL.svm_calibrated_predict(CL.svm_calibrated_fit(str_, cols), ste, cols),
        "Naive Bayes": CL.gnb_predict(te, CL.gnb_fit(tr, cols), cols),
    }
    return EV.compare_models(pred)


@register("model_comparison")
def model_comparison(spark, sf):
    return r6(_model_rows(spark, sf))


@register("best_model")
def best_model(spark, sf):
    """The model of the highest F1."""
    return r6(_model_rows(spark, sf).where("f1_rank = 1"))


@register("model_row_sql", Q.with_ctes(H, f"""SELECT model, {Q.r6('accuracy')} AS accuracy, {Q.r6('tp / (tp + fp)')} AS precision,
  {Q.r6('tp / (tp + fn)')} AS recall, {Q.r6('2 * tp / (2 * tp + fp + fn)')} AS f1,
  {Q.r6('(sp - np * (np + 1) / 2) / (np * (n - np))')} AS roc_auc,
  CAST(row_number() OVER (ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, model) AS INTEGER) AS f1_rank
FROM (SELECT model, avg(CAST(y = p AS INTEGER)) AS accuracy, sum(y * p) * 1.0 AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn,
        sum(y) * 1.0 AS np, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS sp
      FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS rk
            FROM (SELECT 'lag 1' AS model, pm25_lag_1h / 1000 AS s, CAST(pm25_lag_1h > 30 AS INTEGER) AS p, target_next_hour AS y
                  FROM processed WHERE target_next_hour IS NOT NULL
                  UNION ALL SELECT 'mean', pm25_rolling_mean_24h / 1000, CAST(pm25_rolling_mean_24h > 80 AS INTEGER), target_next_hour
                  FROM processed WHERE target_next_hour IS NOT NULL) q) r GROUP BY model) t"""))
def model_row_sql(spark, sf):
    """M10 / T9 on two threshold rules, which SQL can express."""
    p = processed_h(spark, sf).where("target_next_hour is not null").withColumn("label", F.col("target_next_hour"))
    rule = lambda c, at: p.select("label", (F.col(c) / 1000).alias("score"), (F.col(c) > at).cast("int").alias("prediction"))
    return r6(EV.compare_models({"lag 1": rule("pm25_lag_1h", 30), "mean": rule("pm25_rolling_mean_24h", 80)}))


@register("cv_f1")
def cv_f1(spark, sf):
    d, cols = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    return r6(EV.fold_summary(CL.cross_validate(d, cols)))


def _cv_sql() -> str:
    """F1 per fold of naive Bayes and k-NN, each fold against the rows of the others."""
    fold = "(day_of_year * 24 + hour) % 5"
    ctes = H + [_FRAME_SQL.replace("AS label,", f"AS label, CAST({fold} AS INTEGER) AS fold,")]
    st = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATS)
    cols = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END AS {c}" for c in FEATS)
    dist = "sqrt(" + " + ".join(f"power(q.{c} - t.{c}, 2)" for c in FEATS) + ")"
    ctes += [f"ss AS (SELECT {st} FROM fr)", f"sc AS (SELECT city, datetime, label, fold, {cols} FROM fr, ss)",
             f"kd AS (SELECT q.city, q.datetime, q.fold, q.label, t.label AS y, {dist} AS dist FROM sc q JOIN sc t ON t.fold <> q.fold "
             f"QUALIFY row_number() OVER (PARTITION BY q.city, q.datetime ORDER BY round({dist}, 9), t.city, t.datetime) <= 7)",
             """kp AS (SELECT fold, label, CASE WHEN sum(CAST(dist = 0 AS INTEGER)) > 0 THEN sum(CASE WHEN dist = 0 THEN y END) / sum(CAST(dist = 0 AS INTEGER))
       ELSE sum(CASE WHEN dist > 0 THEN y / dist END) / sum(CASE WHEN dist > 0 THEN 1.0 / dist END) END > 0.5 AS p FROM kd GROUP BY city, datetime, fold, label)"""]
    parts = ["k.fold", "count(*) AS n"]
    for c in (0, 1):
        parts.append(f"sum(CAST(label = {c} AS INTEGER)) AS n{c}")
        for j, f in enumerate(FEATS):
            parts += [f"avg(CASE WHEN label = {c} THEN {f} END) AS mu{c}_{j}", f"var_pop(CASE WHEN label = {c} THEN {f} END) AS v{c}_{j}"]
    parts += [f"var_pop({f}) AS vall_{j}" for j, f in enumerate(FEATS)]
    jll = lambda c: f"ln(n{c} / n) + " + " + ".join(
        f"(-0.5 * ln(2 * pi() * (v{c}_{j} + eps)) - power({f} - mu{c}_{j}, 2) / (2.0 * (v{c}_{j} + eps)))" for j, f in enumerate(FEATS))
    ctes += [f"nbm AS (SELECT {', '.join(parts)} FROM range(0, 5) k(fold) JOIN fr ON fr.fold <> k.fold GROUP BY k.fold)",
             "nbe AS (SELECT *, greatest(" + ", ".join(f"vall_{j}" for j in range(len(FEATS))) + ") * 1e-9 AS eps FROM nbm)",
             f"np AS (SELECT fr.fold, label, {jll(1)} > {jll(0)} AS p FROM fr JOIN nbe ON nbe.fold = fr.fold)",
             "al AS (SELECT 'knn' AS model, fold, label, p FROM kp UNION ALL SELECT 'nb', fold, label, p FROM np)",
             "cm AS (SELECT model, fold, sum(CAST(label = 1 AND p AS INTEGER)) AS tp, sum(CAST(label = 0 AND p AS INTEGER)) AS fp, "
             "sum(CAST(label = 1 AND NOT p AS INTEGER)) AS fn FROM al GROUP BY model, fold)"]
    f1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END"
    return Q.with_ctes(ctes, f"SELECT model, CAST(fold AS INTEGER) AS fold, {Q.r6(f1)} AS f1 FROM cm")


@register("cv_folds", _cv_sql())
def cv_folds(spark, sf):
    """M11 for naive Bayes and k-NN on folds that a rule gives."""
    d, cols = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    d = d.withColumn("f", (F.dayofyear("datetime") * 24 + F.hour("datetime")) % 5)
    return r6(CL.cross_validate(d, cols, models=("knn", "nb"), fold="f"))


# ---- M14-M21, A28-A30 (clustering) ---------------------------------------------------------------

from hazeframe.operators import anomaly as AN  # noqa: E402
from hazeframe.operators import cluster as CU  # noqa: E402
from hazeframe.operators import density as DE  # noqa: E402
from hazeframe.operators import mixture as MX  # noqa: E402
from hazeframe.operators import pca as PC  # noqa: E402
from hazeframe.operators.sequence import index_rows, materialize, number_rows  # noqa: E402

CF = PR.CLUSTER_FEATURES
AF = PR.ANOMALY_FEATURES
TOD = S.TIME_OF_DAY_LABELS
_RULE_LABEL = "CASE time_of_day " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TOD)) + " END"


def _rule_label():
    lab = F.lit(None).cast("int")
    for i, t in enumerate(TOD):
        lab = F.when(F.col("time_of_day") == t, F.lit(i)).otherwise(lab)
    return lab


def _std_sql(name: str, feats: list[str], extra: str = "") -> str:
    cols = ", ".join(f"CASE WHEN stddev_pop({f}) OVER () = 0 THEN {f} - avg({f}) OVER () "
                     f"ELSE ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () END AS {f}" for f in feats)
    return f"{name} AS (SELECT city, datetime, {cols}{extra} FROM processed)"


def _cluster_base(spark, sf, with_row_id: bool = False):
    p = processed_h(spark, sf)
    base = p.select("city", "datetime", *CF, _rule_label().alias("label"), "time_of_day",
                    F.col("hour").alias("hour_of_day"), "season",
                    "is_unhealthy", F.col("pm25").alias("pm25_raw"))
    if with_row_id:
        base = index_rows(base, [], ["city", "datetime"],
                          bucket=F.struct(F.col("city"), F.date_trunc("day", F.col("datetime"))), rn_col="row_id")
        base = base.withColumn("row_id", F.col("row_id") - 1)
    d = PR.standardize(base, CF)
    return materialize(d)


_CF_SQL = _std_sql("cf", CF, f", {_RULE_LABEL} AS label, hour AS hour_of_day, season, city AS key, is_unhealthy, pm25 AS pm25_raw, "
                             "CAST(row_number() OVER (ORDER BY city, datetime) - 1 AS BIGINT) AS row_id")
_DIST_CF = "sqrt(" + " + ".join(f"power(a.{f} - b.{f}, 2)" for f in CF) + ")"


@register("silhouette", Q.with_ctes(H + [_CF_SQL, f"""pd AS (SELECT a.city, a.datetime, a.label AS la, b.label AS lb, {_DIST_CF} AS d
  FROM cf a, cf b WHERE NOT (a.city = b.city AND a.datetime = b.datetime))""",
  "pc AS (SELECT city, datetime, la, lb, avg(d) AS m FROM pd GROUP BY ALL)",
  """si AS (SELECT city, datetime, max(CASE WHEN lb = la THEN m END) AS a, min(CASE WHEN lb <> la THEN m END) AS b
  FROM pc GROUP BY city, datetime)"""],
  f"SELECT {Q.r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM si"))
def silhouette_q(spark, sf):
    return r6(CU.silhouette(_cluster_base(spark, sf), CF, "label", ["city", "datetime"]).select("silhouette"))


# mean squared distances of every row to every cluster, by brute force over pairs
_SQ_SQL = ["pq AS (SELECT a.row_id, a.label AS la, b.label AS lb, sum(" + " + ".join(f"power(a.{f} - b.{f}, 2)" for f in CF)
           + ") AS s, count(*) AS n FROM cl a, cl b GROUP BY ALL)",
           "sq AS (SELECT row_id, max(CASE WHEN lb = la AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN lb <> la THEN s / n END) AS b "
           "FROM pq GROUP BY row_id)"]
_SQ_MEAN = "avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)"


@register("silhouette_squared", Q.with_ctes(H + [_CF_SQL, "cl AS (SELECT * FROM cf)", *_SQ_SQL],
          f"SELECT {Q.r6(_SQ_MEAN)} AS silhouette_squared FROM sq"))
def silhouette_squared_q(spark, sf):
    return r6(CU.silhouette_squared(_cluster_base(spark, sf), CF, "label"))


@register("cluster_eval_noise", Q.with_ctes(H + [_CF_SQL, "cl AS (SELECT * FROM cf WHERE label > 0)", *_SQ_SQL,
  f"pd AS (SELECT a.row_id, a.label AS la, b.label AS lb, avg({_DIST_CF}) AS m FROM cl a, cl b WHERE a.row_id <> b.row_id GROUP BY ALL)",
  "si AS (SELECT row_id, max(CASE WHEN lb = la THEN m END) AS a, min(CASE WHEN lb <> la THEN m END) AS b FROM pd GROUP BY row_id)",
  "cen AS (SELECT label, count(*) AS nc, " + ", ".join(f"avg({f}) AS c_{f}" for f in CF) + " FROM cl GROUP BY label)",
  "g AS (SELECT count(*) AS n, " + ", ".join(f"avg({f}) AS g_{f}" for f in CF) + " FROM cl)",
  "w AS (SELECT sum(" + " + ".join(f"power(cl.{f} - c_{f}, 2)" for f in CF) + ") AS w FROM cl JOIN cen USING (label))",
  "b AS (SELECT sum(nc * (" + " + ".join(f"power(c_{f} - g_{f}, 2)" for f in CF) + ")) AS b, count(*) AS k, max(n) AS n FROM cen, g)",
  "sc AS (SELECT label, avg(sqrt(" + " + ".join(f"power(cl.{f} - c_{f}, 2)" for f in CF) + ")) AS s FROM cl JOIN cen USING (label) GROUP BY label)",
  "cs AS (SELECT * FROM cen JOIN sc USING (label))",
  "r AS (SELECT x.label, max((x.s + y.s) / sqrt(" + " + ".join(f"power(x.c_{f} - y.c_{f}, 2)" for f in CF)
  + ")) AS r FROM cs x, cs y WHERE x.label <> y.label GROUP BY x.label)"],
  f"""SELECT 'rule' AS method, (SELECT CAST(count(*) AS BIGINT) FROM cen) AS n_clusters,
  (SELECT CAST(count(*) AS BIGINT) FROM cf WHERE label = 0) AS noise_points,
  (SELECT {Q.r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} FROM si) AS silhouette,
  (SELECT {Q.r6(_SQ_MEAN)} FROM sq) AS silhouette_squared,
  (SELECT {Q.r6('(b / (k - 1)) / (w / (n - k))')} FROM b, w) AS calinski_harabasz,
  (SELECT {Q.r6('avg(r)')} FROM r) AS davies_bouldin"""))
def cluster_eval_noise_q(spark, sf):
    """M21 with the first rule label as noise (-1)."""
    d = _cluster_base(spark, sf).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return r6(CU.evaluate_clustering(d, CF, "label", ["city", "datetime"], "rule"))


@register("calinski_harabasz", Q.with_ctes(H + [_CF_SQL,
  "cen AS (SELECT label, count(*) AS nc, " + ", ".join(f"avg({f}) AS c_{f}" for f in CF) + " FROM cf GROUP BY label)",
  "g AS (SELECT count(*) AS n, " + ", ".join(f"avg({f}) AS g_{f}" for f in CF) + " FROM cf)",
  "w AS (SELECT sum(" + " + ".join(f"power(cf.{f} - c_{f}, 2)" for f in CF) + ") AS w FROM cf JOIN cen USING (label))",
  "b AS (SELECT sum(nc * (" + " + ".join(f"power(c_{f} - g_{f}, 2)" for f in CF) + ")) AS b, count(*) AS k, max(n) AS n FROM cen, g)"],
  f"SELECT CASE WHEN k >= 2 THEN {Q.r6('(b / (k - 1)) / (w / (n - k))')} END AS calinski_harabasz FROM b, w"))
def calinski_harabasz_q(spark, sf):
    return r6(CU.calinski_harabasz(_cluster_base(spark, sf), CF, "label"))


@register("davies_bouldin", Q.with_ctes(H + [_CF_SQL,
  "cen AS (SELECT label, " + ", ".join(f"avg({f}) AS c_{f}" for f in CF) + " FROM cf GROUP BY label)",
  "sc AS (SELECT label, avg(sqrt(" + " + ".join(f"power(cf.{f} - c_{f}, 2)" for f in CF) + ")) AS s FROM cf JOIN cen USING (label) GROUP BY label)",
  "cs AS (SELECT * FROM cen JOIN sc USING (label))",
  "r AS (SELECT x.label, max((x.s + y.s) / sqrt(" + " + ".join(f"power(x.c_{f} - y.c_{f}, 2)" for f in CF) + ")) AS r FROM cs x, cs y WHERE x.label <> y.label GROUP BY x.label)"],
  f"SELECT {Q.r6('avg(r)')} AS davies_bouldin FROM r"))
def davies_bouldin_q(spark, sf):
    return r6(CU.davies_bouldin(_cluster_base(spark, sf), CF, "label"))


@register("cluster_profile", Q.with_ctes(H + [_CF_SQL,
  "kc AS (SELECT label, key, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, key) AS rk FROM cf GROUP BY label, key)"],
  f"""SELECT CAST(cf.label AS INTEGER) AS cluster, {Q.r6('avg(pm25_raw)')} AS pm25_mean, {Q.r6('stddev_samp(pm25_raw)')} AS pm25_std,
  CAST(count(*) AS BIGINT) AS n, {Q.r6('avg(is_unhealthy) * 100')} AS unhealthy_pct, any_value(kc.key) AS top_city
FROM cf JOIN kc ON kc.label = cf.label AND kc.rk = 1 GROUP BY cf.label"""))
def cluster_profile_q(spark, sf):
    d = _cluster_base(spark, sf).withColumnRenamed("label", "cluster")
    return r6(CU.cluster_profile(d.drop("pm25").withColumnRenamed("pm25_raw", "pm25")))


@register("cluster_hour_pivot", Q.with_ctes(H + [_CF_SQL], "SELECT CAST(hour_of_day AS INTEGER) AS hour, " + ", ".join(
    f"{Q.r6(f'avg(CASE WHEN label = {i} THEN pm25_raw END)')} AS c{i}" for i in range(len(TOD))) + " FROM cf GROUP BY hour_of_day"))
def cluster_hour_pivot_q(spark, sf):
    d = _cluster_base(spark, sf)
    piv = d.groupBy(F.col("hour_of_day").alias("hour")).pivot("label", list(range(len(TOD)))).agg(F.avg("pm25_raw"))
    return r6(piv.select("hour", *[F.col(str(i)).alias(f"c{i}") for i in range(len(TOD))]))


@register("cluster_crosstab", Q.with_ctes(H + [_CF_SQL,
  "t AS (SELECT label, count(*) AS t FROM cf GROUP BY label)",
  "c AS (SELECT season, label, count(*) AS n FROM cf GROUP BY season, label)",
  "pr AS (SELECT DISTINCT season FROM cf)"],
  f"""SELECT s.season, CAST(t.label AS INTEGER) AS cluster,
  CASE WHEN pr.season IS NOT NULL THEN {Q.r6('coalesce(c.n, 0) / t.t')} END AS share
FROM (VALUES ('dry'), ('transition'), ('wet')) s(season) CROSS JOIN t
LEFT JOIN c ON c.season = s.season AND c.label = t.label LEFT JOIN pr ON pr.season = s.season"""))
def cluster_crosstab_q(spark, sf):
    d = _cluster_base(spark, sf).withColumnRenamed("label", "cluster")
    return r6(CU.crosstab_share(d, "season", "cluster", S.SEASONS))


@register("cluster_city_crosstab", Q.with_ctes(H + [_CF_SQL,
  "t AS (SELECT label, count(*) AS t FROM cf GROUP BY label)",
  "c AS (SELECT key, label, count(*) AS n FROM cf GROUP BY key, label)", "k AS (SELECT DISTINCT key FROM cf)"],
  f"""SELECT k.key AS city, CAST(t.label AS INTEGER) AS cluster, {Q.r6('coalesce(c.n, 0) / t.t')} AS share
FROM k CROSS JOIN t LEFT JOIN c ON c.key = k.key AND c.label = t.label"""))
def cluster_city_crosstab_q(spark, sf):
    return r6(CU.crosstab_share(_cluster_base(spark, sf).withColumnRenamed("label", "cluster"), "city", "cluster"))


@register("dbscan_core", Q.with_ctes(H + [_CF_SQL, f"""nb AS (SELECT a.row_id, count(*) AS n FROM cf a, cf b
  WHERE {_DIST_CF} <= 0.8 GROUP BY a.row_id)"""],
  "SELECT cf.row_id, CAST(coalesce(n, 0) AS BIGINT) AS n_neighbors, coalesce(n, 0) >= 50 AS is_core FROM cf LEFT JOIN nb USING (row_id)"))
def dbscan_core_q(spark, sf):
    d = _cluster_base(spark, sf, with_row_id=True)
    return CU.dbscan_core(d.select("row_id", *CF), CF, "row_id").select("row_id", "n_neighbors", "is_core")


def _dbscan_sql(src: str, rounds: int = 40) -> list[str]:
    """Labels by brute force over pairs: least core id spread along core pairs for ``rounds`` steps."""
    return [f"pr AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM {src} a, {src} b WHERE {_DIST_CF} <= 0.8)",
            "co AS MATERIALIZED (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= 50)",
            "ce AS MATERIALIZED (SELECT a, b FROM pr WHERE a IN (SELECT id FROM co) AND b IN (SELECT id FROM co))",
            f"""cc AS (SELECT 0 AS step, id, id AS comp FROM co
  UNION ALL SELECT cc.step + 1, ce.a, min(cc.comp) FROM cc JOIN ce ON ce.b = cc.id WHERE cc.step < {rounds} GROUP BY ce.a, cc.step)""",
            f"cn AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM cc WHERE step = {rounds})",
            "bo AS (SELECT pr.a AS id, min(cn.cluster) AS cluster FROM pr JOIN cn ON cn.id = pr.b GROUP BY pr.a)"]


def _dbscan_select(src: str) -> str:
    return (f"SELECT s.row_id, co.id IS NOT NULL AS is_core, CAST(coalesce(cn.cluster, bo.cluster, -1) AS INTEGER) AS cluster FROM {src} s "
            "LEFT JOIN co ON co.id = s.row_id LEFT JOIN cn ON cn.id = s.row_id LEFT JOIN bo ON bo.id = s.row_id")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("dbscan_labels", _recursive(Q.with_ctes(H + [_CF_SQL] + _dbscan_sql("cf"), _dbscan_select("cf"))))
def dbscan_labels_q(spark, sf):
    d = _cluster_base(spark, sf, with_row_id=True)
    return DE.dbscan(d.select("row_id", *CF), CF, "row_id").select("row_id", "is_core", "cluster")


def _kmeans_sql(src: str, steps: int) -> list[str]:
    """Centres moved ``steps`` times from the rule labels' means, as one chain of tables."""
    avg = ", ".join(f"avg({f}) AS c_{f}" for f in CF)
    ctes = [f"k0 AS (SELECT label AS c, {avg} FROM {src} GROUP BY label)"]
    near = " + ".join(f"power(s.{f} - c_{f}, 2)" for f in CF)
    for t in range(steps + 1):
        ctes.append(f"n{t} AS (SELECT s.*, k.c FROM {src} s, k{t} k QUALIFY row_number() OVER (PARTITION BY s.city, s.datetime ORDER BY {near}, k.c) = 1)")
        ctes.append(f"k{t + 1} AS (SELECT k.c, " + ", ".join(f"coalesce(avg(n.{f}), any_value(k.c_{f})) AS c_{f}" for f in CF)
                    + f" FROM k{t} k LEFT JOIN (SELECT c AS nc, {', '.join(CF)} FROM n{t}) n ON n.nc = k.c GROUP BY k.c)")
    return ctes


@register("kmeans_steps", Q.with_ctes(H + [_CF_SQL] + _kmeans_sql("(SELECT city AS key0, * FROM cf)", 4),
          "SELECT city, datetime, CAST(c AS INTEGER) AS cluster FROM n4"))
def kmeans_steps_q(spark, sf):
    """M14 from fixed starts: four moves from the means of the rule labels."""
    d = _cluster_base(spark, sf)
    return CU.kmeans_from(d.select("city", "datetime", *CF, "label"), CF, "label", 4).select("city", "datetime", "cluster")


def _gmm_sql(src: str, steps: int, k: int) -> list[str]:
    """Mixture steps unrolled: moments, Cholesky factors and memberships per step."""
    d = len(CF)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    shift = ", ".join(f"{f} - avg({f}) OVER () AS x{i}" for i, f in enumerate(CF))
    ctes = [f"g AS (SELECT city, datetime, label, {shift} FROM {src})", "r0 AS (SELECT g.*, label AS c, 1.0 AS r FROM g)"]
    for t in range(steps):
        ctes.append(f"mo{t} AS (SELECT c, sum(r) + 2.220446049250313e-15 AS n, " + ", ".join(f"sum(r * x{i}) AS s{i}" for i in range(d)) + ", "
                    + ", ".join(f"sum(r * x{i} * x{j}) AS q{i}_{j}" for i, j in pairs) + f" FROM r{t} GROUP BY c)")
        ctes.append(f"cv{t} AS (SELECT c, n, " + ", ".join(f"s{i} / n AS m{i}" for i in range(d)) + ", " + ", ".join(
            f"q{i}_{j} / n - (s{i} / n) * (s{j} / n)" + (" + 1e-6" if i == j else "") + f" AS v{i}_{j}" for i, j in pairs) + f" FROM mo{t})")
        last = f"cv{t}"
        for i, j in pairs:  # Cholesky, one entry a table
            done = " - ".join([f"v{i}_{j}", *[f"l{i}_{m} * l{j}_{m}" for m in range(j)]])
            entry = f"sqrt({done})" if i == j else f"({done}) / l{j}_{j}"
            ctes.append(f"ch{t}_{i}_{j} AS (SELECT *, {entry} AS l{i}_{j} FROM {last})")
            last = f"ch{t}_{i}_{j}"
        prev = "g.*, p.c, p.n, " + ", ".join(f"m{i}" for i in range(d)) + ", " + ", ".join(f"l{i}_{j}" for i, j in pairs)
        ctes.append(f"y{t}_0 AS (SELECT {prev}, (x0 - m0) / l0_0 AS y0 FROM g, {last} p)")
        for i in range(1, d):
            ctes.append(f"y{t}_{i} AS (SELECT *, (" + " - ".join([f"x{i} - m{i}", *[f"l{i}_{j} * y{j}" for j in range(i)]]) + f") / l{i}_{i} AS y{i} FROM y{t}_{i - 1})")
        dens = (f"ln(n / (SELECT count(*) FROM g)) - {' - '.join(f'ln(l{i}_{i})' for i in range(d))} - {d / 2} * ln(2 * pi()) - 0.5 * ("
                + " + ".join(f"y{i} * y{i}" for i in range(d)) + ")")
        ctes.append(f"d{t} AS (SELECT *, {dens} AS lp, max({dens}) OVER (PARTITION BY city, datetime) AS top FROM y{t}_{d - 1})")
        ctes.append(f"r{t + 1} AS (SELECT city, datetime, label, " + ", ".join(f"x{i}" for i in range(d))
                    + f", c, exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY city, datetime) AS r FROM d{t})")
    return ctes


@register("gmm_steps", Q.with_ctes(H + [_CF_SQL] + _gmm_sql("cf", 3, len(TOD)), "SELECT city, datetime, "
          + "CAST(arg_max(c, r) AS INTEGER) AS cluster, " + ", ".join(f"{Q.r6(f'max(CASE WHEN c = {c} THEN r END)')} AS p{c}" for c in range(len(TOD)))
          + " FROM r3 GROUP BY city, datetime"))
def gmm_steps_q(spark, sf):
    """M18 from fixed starts: two steps from the rule labels and the memberships after them; ``month`` is constant."""
    d = _cluster_base(spark, sf).select("city", "datetime", *CF, "label")
    g = MX.mixture(d, CF, "label", len(TOD), max_iter=2, tolerance=0.0)
    return r6(g.select("city", "datetime", "cluster", *[F.col("probability")[c].alias(f"p{c}") for c in range(len(TOD))]))


@register("kmeans_labels")
def kmeans_labels_q(spark, sf):
    d = _cluster_base(spark, sf)
    return CU.kmeans_labels(d.select("city", "datetime", *CF), CF, k=4).select("city", "datetime", "cluster")


@register("k_sweep")
def k_sweep_q(spark, sf):
    d = _cluster_base(spark, sf).select("city", "datetime", *CF)
    return r6(CU.k_sweep(d, CF, ["city", "datetime"]))


@register("cluster_comparison")
def cluster_comparison(spark, sf):
    """M21 for K-means at the best k, DBSCAN with its noise removed, and the mixture."""
    base = _cluster_base(spark, sf, with_row_id=True).select("row_id", "city", "datetime", *CF)
    d = base.drop("row_id")
    best = CU.k_sweep(d, CF, ["city", "datetime"]).where("best").first()["k"]
    db = DE.dbscan(base.select("row_id", *CF), CF, "row_id").select(*CF, "cluster")
    rows = [(CU.kmeans_labels(d, CF, best), "K-Means"), (db, "DBSCAN"), (CU.gmm_labels(d, CF, best), "GMM")]
    out = [CU.evaluate_clustering(materialize(x.select(*CF, "cluster")), CF, "cluster", [], name) for x, name in rows]
    return r6(out[0].unionByName(out[1]).unionByName(out[2]))


@register("clustered_table")
def clustered_table(spark, sf):
    """The processed table with its fitted cluster, as the pipeline stores it."""
    p = materialize(processed_h(spark, sf))
    lab = CU.kmeans_labels(CU.cluster_frame(p), CF, k=4).select("city", "datetime", "cluster")
    return r6(p.join(lab, ["city", "datetime"], "left"))


@register("gmm_labels")
def gmm_labels_q(spark, sf):
    d = _cluster_base(spark, sf).select("city", "datetime", *CF)
    g = CU.gmm_labels(d, CF, k=4)
    return r6(g.select("city", "datetime", "cluster", F.array_max("probability").alias("probability")))


@register("cluster_eval")
def cluster_eval_q(spark, sf):
    d = _cluster_base(spark, sf).select("city", "datetime", *CF)
    lab = CU.kmeans_labels(d, CF, k=4)
    return r6(CU.evaluate_clustering(lab, CF, "cluster", ["city", "datetime"], "K-Means"))


# ---- M23-M27, A31-A32, T3, W9 (anomalies, PCA) ----------------------------------------------------

_AF_SQL = _std_sql("af", AF, ", pm25 AS pm25_raw")
_DIST_AF = "sqrt(" + " + ".join(f"power(a.{f} - b.{f}, 2)" for f in AF) + ")"
_LOF_SQL = [_AF_SQL, f"""nn AS (SELECT * FROM (SELECT a.city AS qc, a.datetime AS qd, b.city AS pc, b.datetime AS pd, {_DIST_AF} AS d,
    row_number() OVER (PARTITION BY a.city, a.datetime ORDER BY round({_DIST_AF}, 9), b.city, b.datetime) AS rk
  FROM af a, af b WHERE NOT (a.city = b.city AND a.datetime = b.datetime)) t WHERE rk <= 20)""",
  "kd AS (SELECT qc, qd, max(d) AS kd FROM nn GROUP BY qc, qd)",
  """lrd AS (SELECT nn.qc, nn.qd, 1.0 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd
  FROM nn JOIN kd ON kd.qc = nn.pc AND kd.qd = nn.pd GROUP BY nn.qc, nn.qd)""",
  """lof AS (SELECT nn.qc AS city, nn.qd AS datetime, avg(l2.lrd) / l1.lrd AS lof FROM nn
  JOIN lrd l2 ON l2.qc = nn.pc AND l2.qd = nn.pd JOIN lrd l1 ON l1.qc = nn.qc AND l1.qd = nn.qd
  GROUP BY nn.qc, nn.qd, l1.lrd)""",
  "lofq AS (SELECT quantile_cont(-lof, 0.05) AS thr FROM lof)",
  """flags AS (SELECT p.*, abs((p.pm25 - avg(p.pm25) OVER ()) / stddev_pop(p.pm25) OVER ()) > 3 AS anomaly_zscore,
    -l.lof < q.thr AS anomaly_lof, p.is_extreme = 1 AS anomaly_extreme
  FROM processed p JOIN lof l USING (city, datetime), lofq q)""",
  """cons AS (SELECT *, CAST(anomaly_zscore AS INTEGER) + CAST(anomaly_lof AS INTEGER) + CAST(anomaly_extreme AS INTEGER) AS n_methods,
    CAST(anomaly_zscore AS INTEGER) + CAST(anomaly_lof AS INTEGER) + CAST(anomaly_extreme AS INTEGER) >= 2 AS anomaly_consensus FROM flags)"""]
FLAGS = ["anomaly_zscore", "anomaly_lof", "anomaly_extreme"]


def _anomaly_frame(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    lof = AN.lof_flag(AN.lof_scores(af, AF, ["city", "datetime"]))
    d = AN.zscore_flag(p).join(lof, ["city", "datetime"]).withColumn("anomaly_extreme", F.col("is_extreme") == 1)
    return materialize(AN.consensus(d, FLAGS))


@register("zscore_flag", Q.with_ctes(H, "SELECT city, datetime, abs((pm25 - avg(pm25) OVER ()) / stddev_pop(pm25) OVER ()) > 3 AS anomaly_zscore FROM processed"))
def zscore_flag_q(spark, sf):
    return AN.zscore_flag(processed_h(spark, sf)).select("city", "datetime", "anomaly_zscore")


@register("lof_scores", Q.with_ctes(H + _LOF_SQL, f"SELECT city, datetime, {Q.r6('lof')} AS lof, -lof < thr AS anomaly_lof FROM lof, lofq"))
def lof_scores_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return r6(AN.lof_flag(AN.lof_scores(af, AF, ["city", "datetime"])))


@register("consensus", Q.with_ctes(H + _LOF_SQL, "SELECT city, datetime, " + ", ".join(FLAGS) + ", n_methods, anomaly_consensus FROM cons"))
def consensus_q(spark, sf):
    return _anomaly_frame(spark, sf).select("city", "datetime", *FLAGS, "n_methods", "anomaly_consensus")


_RATE_DIMS = ["city", "season", "month", "hour"]


@register("anomaly_rates", Q.with_ctes(H + _LOF_SQL + [
  "w AS (SELECT " + ", ".join(f"{c}" for c in _RATE_DIMS) + ", " + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in FLAGS + ["anomaly_consensus"]) + " FROM cons)",
  "g AS (SELECT CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _RATE_DIMS) + " ELSE 'all' END AS dim, CASE "
  + " ".join(f"WHEN grouping({d}) = 0 THEN CAST({d} AS VARCHAR)" for d in _RATE_DIMS) + " ELSE 'all' END AS value, "
  + ", ".join(f"avg({f}) * 100 AS {f}" for f in FLAGS + ["anomaly_consensus"])
  + " FROM w GROUP BY GROUPING SETS ((), " + ", ".join(f"({d})" for d in _RATE_DIMS) + "))"],
  "\nUNION ALL ".join(f"SELECT dim, value, '{f}' AS method, {Q.r6(f)} AS rate_pct FROM g" for f in FLAGS + ["anomaly_consensus"])))
def anomaly_rates_q(spark, sf):
    return r6(AN.anomaly_rates(_anomaly_frame(spark, sf), FLAGS + ["anomaly_consensus"], _RATE_DIMS))


@register("anomaly_days", Q.with_ctes(H + _LOF_SQL, f"""SELECT city, CAST(datetime AS DATE) AS date, {Q.r6('avg(pm25)')} AS pm25_mean,
  CAST(sum(CAST(anomaly_consensus AS INTEGER)) AS BIGINT) AS n_anomalies FROM cons GROUP BY 1, 2
HAVING sum(CAST(anomaly_consensus AS INTEGER)) > 0"""))
def anomaly_days_q(spark, sf):
    return r6(AN.anomaly_days(_anomaly_frame(spark, sf), "anomaly_consensus"))


@register("agreement_hist", Q.with_ctes(H + _LOF_SQL, "SELECT n_methods, CAST(count(*) AS BIGINT) AS n_rows FROM cons GROUP BY n_methods"))
def agreement_hist_q(spark, sf):
    return AN.agreement_hist(_anomaly_frame(spark, sf))


@register("method_counts", Q.with_ctes(H + _LOF_SQL, "\nUNION ALL ".join(
    f"SELECT '{f}' AS method, CAST(sum(CAST({f} AS INTEGER)) AS BIGINT) AS n_flagged FROM cons" for f in FLAGS)))
def method_counts_q(spark, sf):
    return AN.method_counts(_anomaly_frame(spark, sf), FLAGS)


@register("top_anomalies", Q.with_ctes(H + _LOF_SQL, f"""SELECT * FROM (SELECT datetime, city, {Q.r6('pm25')} AS pm25,
  CAST(row_number() OVER (ORDER BY pm25 DESC, city, datetime) AS INTEGER) AS rank FROM cons WHERE anomaly_consensus) t
WHERE rank <= 10"""))
def top_anomalies_q(spark, sf):
    return r6(AN.top_anomalies(_anomaly_frame(spark, sf), "anomaly_consensus", 10))


@register("ocsvm_flag")
def ocsvm_flag_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return AN.ocsvm_flag(af, AF).select("city", "datetime", "anomaly_ocsvm")


def _trio(spark, sf):
    return AN.detector_trio(processed_h(spark, sf), AF, ["city", "datetime"])


@register("anomaly_methods_full")
def anomaly_methods_full_q(spark, sf):
    """The analysed pipeline's three detectors (z-score, LOF, one-class SVM) and their consensus."""
    return r6(_trio(spark, sf).select("city", "datetime", "pm25", *AN.TRIO, "n_methods", "anomaly_consensus"))


@register("trio_rates")
def trio_rates_q(spark, sf):
    """A31 on the analysed trio."""
    return r6(AN.anomaly_rates(_trio(spark, sf), AN.TRIO + ["anomaly_consensus"], _RATE_DIMS))


@register("trio_days")
def trio_days_q(spark, sf):
    """A32 on the analysed trio."""
    return r6(AN.anomaly_days(_trio(spark, sf), "anomaly_consensus"))


@register("trio_agreement")
def trio_agreement_q(spark, sf):
    """M31 / A27 on the analysed trio."""
    return AN.agreement_hist(_trio(spark, sf))


@register("trio_counts")
def trio_counts_q(spark, sf):
    """M31 on the analysed trio."""
    return AN.method_counts(_trio(spark, sf), AN.TRIO)


@register("trio_top")
def trio_top_q(spark, sf):
    """T3 on the analysed trio."""
    return r6(AN.top_anomalies(_trio(spark, sf), "anomaly_consensus", 10))


@register("anomaly_table")
def anomaly_table(spark, sf):
    """The processed table with the detector trio, their consensus and two principal components."""
    d = _trio(spark, sf)
    af = PR.standardize(d.select("city", "datetime", *AF), AF)
    return r6(d.join(PC.pca_scores(af, AF, 2).select("city", "datetime", "pca_1", "pca_2"), ["city", "datetime"]))


@register("pca_ratio")
def pca_ratio_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return r6(PC.explained_variance(af, AF))


@register("pca_ratio_pair", Q.with_ctes(H, f"""SELECT * FROM (
  SELECT 1 AS component, {Q.r6('(1 + abs(corr(pm25, hour))) / 2')} AS ratio FROM processed
  UNION ALL SELECT 2, {Q.r6('(1 - abs(corr(pm25, hour))) / 2')} FROM processed)"""))
def pca_ratio_pair_q(spark, sf):
    """M23 on two standardised features, where the shares are (1 +- |r|) / 2."""
    pair = ["pm25", "hour"]
    e = PC.explained_variance(PR.standardize(processed_h(spark, sf).select(*pair), pair), pair)
    return r6(e.select("component", "ratio"))


@register("pca_components_needed")
def pca_components_needed_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return PC.components_needed(PC.explained_variance(af, AF))


@register("pca_scores")
def pca_scores_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return r6(PC.pca_scores(af, AF, 2).select("city", "datetime", "pca_1", "pca_2"))


@register("pca_loadings")
def pca_loadings_q(spark, sf):
    p = processed_h(spark, sf)
    af = PR.standardize(p.select("city", "datetime", *AF), AF)
    return r6(PC.loadings(af, AF, 3))


@register("pca_decomposition", Q.with_ctes(H, "\nUNION ALL ".join(
    [f"SELECT 'covariance' AS kind, '{a}' AS a, '{b}' AS b, {Q.r6(f'CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0 END')} AS value FROM processed"
     for a in AF for b in AF]
    + [f"SELECT 'product', '{i}', '{j}', {1.0 if i == j else 0.0}" for i in range(1, len(AF) + 1) for j in range(1, len(AF) + 1)])))
def pca_decomposition_q(spark, sf):
    """M23 whole: shares and loadings of all components give back the covariance of the standardised features, and loadings are
    orthonormal."""
    af = materialize(PR.standardize(processed_h(spark, sf).select("city", "datetime", *AF), AF))
    load, share = PC.loadings(af, AF, len(AF)), PC.explained_variance(af, AF)
    total = af.agg(reduce(lambda x, y: x + y, [F.var_pop(f) for f in AF]).alias("total"))
    load = load.join(share.select("component", "ratio"), "component").crossJoin(F.broadcast(total))  # one row
    x = load.select(F.col("component").alias("ca"), F.col("feature").alias("fa"), F.col("loading").alias("la"), (F.col("ratio") * F.col("total")).alias("var"))
    y = load.select(F.col("component").alias("cb"), F.col("feature").alias("fb"), F.col("loading").alias("lb"))
    # features x components: a few rows
    cov = x.join(y, F.col("ca") == F.col("cb")).groupBy("fa", "fb").agg(F.sum(F.col("la") * F.col("lb") * F.col("var")).alias("value"))
    dot = x.join(y, F.col("fa") == F.col("fb")).groupBy("ca", "cb").agg(F.sum(F.col("la") * F.col("lb")).alias("value"))
    rows = cov.select(F.lit("covariance").alias("kind"), F.col("fa").alias("a"), F.col("fb").alias("b"), "value").unionByName(
        dot.select(F.lit("product").alias("kind"), F.col("ca").cast("string").alias("a"), F.col("cb").cast("string").alias("b"), "value"))
    return r6(rows)


# ---- S1-S7, P1-P3, U1, J1, J2, T4, P9, F19, F21 (sources and sinks) ------------------------------

from hazeframe.sources import derive as DV  # noqa: E402
from hazeframe.sources import files as FS  # noqa: E402
from hazeframe.sources import landing as LD  # noqa: E402

LANDED_YEAR = 2024  # the year the events table covers (the request year of the landed pages)


@register("schema_coalesce_union", "SELECT event_type AS city, ts AS datetime, value AS pm25 FROM events")
def schema_coalesce_union(spark, sf):
    root = DV.scratch_dir(spark, "landing")
    path = DV.land_raw_csv(standins.table(spark, sf, "events"), root)
    return FS.standardize(FS.read_raw_csv(spark, path)).select("city", "datetime", "pm25")


def _named(spark, sf, time: str, value: str, city: str | None):
    root = DV.scratch_dir(spark, "landing")
    path = DV.land_named_csv(standins.table(spark, sf, "events"), root, time, value, city)
    return FS.standardize(FS.read_raw_csv(spark, path)).select("city", "datetime", "pm25")


@register("schema_coalesce_date", "SELECT event_type AS city, ts AS datetime, value AS pm25 FROM events")
def schema_coalesce_date(spark, sf):
    """P1 with ``date``, ``city`` and a column whose name holds 'pm'."""
    return _named(spark, sf, "date", "PM2.5 (ug)", "city")


@register("schema_coalesce_datetime", "SELECT 'Unknown' AS city, ts AS datetime, value AS pm25 FROM events")
def schema_coalesce_datetime(spark, sf):
    """P1 with ``datetime``, ``pm25`` and no city."""
    return _named(spark, sf, "datetime", "pm25", None)


@register("schema_coalesce_date_utc", "SELECT event_type AS city, ts AS datetime, value AS pm25 FROM events")
def schema_coalesce_date_utc(spark, sf):
    """P1 with ``date.utc``, a column whose name holds 'value', and ``city_name``."""
    return _named(spark, sf, "date.utc", "Value_avg", "city_name")


def _pages(spark, sf):
    root = DV.scratch_dir(spark, "landing")
    return LD.read_pages(spark, DV.land_pages(standins.table(spark, sf, "events"), root))


@register("pages_flat", f"""SELECT CAST(user_id % 40 AS BIGINT) AS sensor_id, CAST(count(*) AS BIGINT) AS rows,
  min(date_trunc('second', ts)) AS first_hour, max(date_trunc('second', ts)) AS last_hour, {Q.r6('sum(value)')} AS value_sum
FROM events GROUP BY 1""")
def pages_flat(spark, sf):
    p = _pages(spark, sf)
    return r6(p.groupBy(F.col("sensor_id").cast("long").alias("sensor_id"))
               .agg(F.count(F.lit(1)).cast("long").alias("rows"), F.min("datetime").alias("first_hour"),
                    F.max("datetime").alias("last_hour"), F.sum("value").alias("value_sum")))


@register("page_completeness", """SELECT CAST(user_id % 40 AS BIGINT) AS sensor_id, CAST(count(*) AS BIGINT) AS rows,
  CAST(CASE WHEN count(*) > 1000 THEN 1001 ELSE count(*) END AS BIGINT) AS reported,
  CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages
FROM events GROUP BY 1""")
def page_completeness(spark, sf):
    p = _pages(spark, sf).withColumn("sensor_id", F.col("sensor_id").cast("long"))
    return LD.page_completeness(p)


_CITY_VALUES = ", ".join(f"({i}, '{c}', {lat}, {lon})" for i, (c, lat, lon) in enumerate(LD.CITIES))
_STATIONS_SQL = [
    "locs AS (SELECT DISTINCT user_id % 40 AS loc FROM events)",
    f"cty AS (SELECT * FROM (VALUES {_CITY_VALUES}) c(ci, city, lat, lon))",
    """st AS (SELECT loc, city, lat + (loc % 10) * 0.03 AS latitude, lon AS longitude, lat AS clat, lon AS clon,
    loc % 3 <> 0 AS is_monitor, loc % 5 = 0 AS is_mobile FROM locs JOIN cty ON loc % 4 = ci WHERE loc % 7 <> 0)""",
    """near AS (SELECT * FROM st WHERE 2 * 6371008.8 * asin(sqrt(power(sin((radians(clat) - radians(latitude)) / 2), 2)
    + cos(radians(latitude)) * cos(radians(clat)) * power(sin((radians(clon) - radians(longitude)) / 2), 2))) <= 25000)""",
    """pref AS (SELECT *, max(CAST(is_monitor AND NOT is_mobile AS INTEGER)) OVER (PARTITION BY city) AS anyst FROM near)""",
    """sel AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY loc) AS station_rank FROM pref
    WHERE (is_monitor AND NOT is_mobile) OR anyst = 0)"""]


def _selected_sensors(spark, sf):
    root = DV.scratch_dir(spark, "landing")
    st = LD.read_stations(spark, DV.land_stations(standins.table(spark, sf, "events"), root))
    near = LD.stations_near(st, LD.city_dimension(spark)).where(F.col("near_city") == F.col("city"))
    return LD.station_sensors(LD.select_stations(near))


@register("station_sensors", Q.with_ctes(_STATIONS_SQL, """SELECT city, CAST(loc AS BIGINT) AS location_id,
  'Station ' || loc AS location_name, CAST(loc AS BIGINT) AS sensor_id, CAST(station_rank AS INTEGER) AS station_rank
FROM sel WHERE station_rank <= 5"""))
def station_sensors(spark, sf):
    s = _selected_sensors(spark, sf)
    return s.select("city", "location_id", "location_name", "sensor_id", F.col("station_rank").cast("int"))


@register("measurements_hourly", Q.with_ctes(_STATIONS_SQL + ["sel5 AS (SELECT * FROM sel WHERE station_rank <= 5)"],
          f"""SELECT date_trunc('hour', e.ts) AS datetime, sel5.city, {Q.r6('avg(e.value)')} AS pm25
FROM events e JOIN sel5 ON e.user_id % 40 = sel5.loc
WHERE e.value IS NOT NULL AND e.value >= 0 AND year(e.ts) = {LANDED_YEAR} GROUP BY 1, 2"""))
def measurements_hourly(spark, sf):
    pages = LD.restrict_year(_pages(spark, sf).withColumn("sensor_id", F.col("sensor_id").cast("long")), LANDED_YEAR)
    sensors = _selected_sensors(spark, sf)
    return r6(LD.hourly_readings(LD.enrich(pages, sensors)))


@register("processed_roundtrip", Q.with_ctes(H, f"SELECT {_PROC_COLS} FROM processed"))
def processed_roundtrip(spark, sf):
    root = DV.scratch_dir(spark, "sink")
    FS.write_table(processed_h(spark, sf), root + "/csv", fmt="csv")
    back = FS.read_processed(spark, root + "/csv", fmt="csv")
    FS.write_table(back, root + "/parquet")
    return r6(FS.read_processed(spark, root + "/parquet").orderBy("city", "datetime"))


@register("raw_by_city", Q.with_ctes([Q.READINGS_H], """SELECT replace(lower(city), ' ', '_') AS city_slug,
  CAST(count(*) AS BIGINT) AS n FROM readings_h GROUP BY 1"""))
def raw_by_city(spark, sf):
    root = DV.scratch_dir(spark, "sink")
    FS.write_raw_by_city(hourly(spark, sf), root + "/raw", fmt="csv")
    back = spark.read.option("header", True).csv(root + "/raw")
    return back.groupBy(F.col("city_slug").cast("string")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def _sink(spark, df, name):
    return FS.through_sink(df, DV.scratch_dir(spark, "sink") + f"/{name}")


def _sink_of(name: str, query: str) -> None:
    """The output table ``name`` holds the rows of ``query``, written as CSV and read back."""
    make = QUERIES[query]

    def run(spark, sf):
        return _sink(spark, make(spark, sf), name)

    run.__name__ = f"sink_{name}"
    register(run.__name__, ORACLES.get(query))(run)


for _name, _query in (("summary", "city_summary"), ("classification_results", "model_row_sql"), ("clustering_results", "cluster_eval_noise"),
                      ("association_rules", "assoc_rules_lift"), ("frequent_itemsets", "frequent_itemsets")):
    _sink_of(_name, _query)


@register("sink_data_with_clusters", Q.with_ctes(H + [_CF_SQL] + _kmeans_sql("cf", 2), f"""SELECT {_PROC_COLS},
  CAST(c AS INTEGER) AS cluster FROM processed JOIN (SELECT city, datetime, c FROM n2) n2 USING (city, datetime)"""))
def sink_data_with_clusters(spark, sf):
    """The processed table with a cluster per row (two moves from fixed starts)."""
    lab = CU.kmeans_from(_cluster_base(spark, sf).select("city", "datetime", *CF, "label"), CF, "label", 2).select("city", "datetime", "cluster")
    return r6(_sink(spark, processed_h(spark, sf).join(lab, ["city", "datetime"]), "data_with_clusters"))


@register("sink_data_with_anomalies", Q.with_ctes(H + _LOF_SQL, f"""SELECT {_PROC_COLS}, {', '.join(FLAGS)}, n_methods, anomaly_consensus FROM cons"""))
def sink_data_with_anomalies(spark, sf):
    """The processed table with three detectors (the rule is_extreme as the third, which SQL can express) and their consensus."""
    d = _anomaly_frame(spark, sf).drop("lof")
    return r6(_sink(spark, d, "data_with_anomalies"))


# ---- the same operators over readings by the minute, which grow with the tables -------------------

M_CHAIN = Q.chain_m()


def processed_m(spark, sf):
    return processed(standins.readings_minute(spark, sf), chunk_rows=65_536)


def _minute_features(spark, sf, feats):
    p = materialize(processed_m(spark, sf))
    return materialize(PR.standardize(p.select("city", "datetime", *feats), feats))


@register("processed_minute", Q.with_ctes(M_CHAIN, f"SELECT {_PROC_COLS} FROM processed"))
def processed_minute(spark, sf):
    return r6(processed_m(spark, sf))


@register("city_summary_minute", Q.with_ctes(M_CHAIN, _SUMMARY_SQL))
def city_summary_minute(spark, sf):
    return r6(SM.city_summary(processed_m(spark, sf)))


def _minute_split(spark, sf):
    d, cols = PR.forecast_frame(processed_m(spark, sf), levels=H_LEVELS)
    d = materialize(d.withColumn("is_test", ((F.dayofyear("datetime") * 24 + F.hour("datetime")) % 5) == 0))
    return d.where(~F.col("is_test")), d.where(F.col("is_test")), cols


@register("gaussian_nb_minute", Q.with_ctes(M_CHAIN + [_FRAME_SQL] + _nb_sql(), f"SELECT city, datetime, label, {Q.r6('score')} AS score, prediction FROM nb"))
def gaussian_nb_minute(spark, sf):
    tr, te, cols = _minute_split(spark, sf)
    return r6(CL.gnb_predict(te, CL.gnb_fit(tr, cols), cols).select("city", "datetime", "label", "score", "prediction"))


@register("tree_minute", Q.with_ctes(M_CHAIN + [_FRAME_SQL] + _tree_sql("fr", 10), f"""SELECT city, datetime, label, {Q.r6('score')} AS score,
  CAST(score > 0.5 AS INTEGER) AS prediction FROM tr10 JOIN tv USING (node) WHERE is_test"""))
def tree_minute(spark, sf):
    tr, te, cols = _minute_split(spark, sf)
    return r6(CL.tree_predict(CL.tree_fit(tr, cols), te, cols).select("city", "datetime", "label", "score", "prediction"))


@register("knn_minute")
def knn_minute(spark, sf):
    tr, te, cols = _minute_split(spark, sf)
    sc = PR.scaler_fit(tr, cols)
    pred = CL.knn_classify(PR.scaler_apply(tr, sc, cols), PR.scaler_apply(te, sc, cols), cols, ["city", "datetime"])
    return r6(pred.select("city", "datetime", "label", "score", "prediction"))


@register("svm_minute")
def svm_minute(spark, sf):
    tr, te, cols = _minute_split(spark, sf)
    sc = PR.scaler_fit(tr, cols)
    fits = CL.svm_calibrated_fit(PR.scaler_apply(tr, sc, cols), cols)
    return r6(CL.svm_calibrated_predict(fits, PR.scaler_apply(te, sc, cols), cols).select("city", "datetime", "label", "score", "prediction"))


@register("lof_minute")
def lof_minute(spark, sf):
    return r6(AN.lof_flag(AN.lof_scores(_minute_features(spark, sf, AF), AF, ["city", "datetime"])))


@register("ocsvm_minute")
def ocsvm_minute(spark, sf):
    return AN.ocsvm_flag(_minute_features(spark, sf, AF), AF).select("city", "datetime", "anomaly_ocsvm")


@register("dbscan_minute")
def dbscan_minute(spark, sf):
    d = number_rows(_minute_features(spark, sf, CF), ["city", "datetime"], "row_id")
    return DE.dbscan(d, CF, "row_id").select("city", "datetime", "is_core", "cluster")


@register("kmeans_minute")
def kmeans_minute(spark, sf):
    return CU.kmeans_labels(_minute_features(spark, sf, CF), CF, k=4).select("city", "datetime", "cluster")


@register("gmm_minute")
def gmm_minute(spark, sf):
    g = CU.gmm_labels(_minute_features(spark, sf, CF), CF, k=4)
    return r6(g.select("city", "datetime", "cluster", F.array_max("probability").alias("probability")))


# ---- streaming ingestion of landed pages ------------------------------------------------------------

@register("stream_hourly_mean", Q.with_ctes(_STATIONS_SQL + ["sel5 AS (SELECT * FROM sel WHERE station_rank <= 5)"],
          f"""SELECT date_trunc('hour', e.ts) AS datetime, sel5.city, {Q.r6('avg(e.value)')} AS pm25
FROM events e JOIN sel5 ON e.user_id % 40 = sel5.loc
WHERE e.value IS NOT NULL AND e.value >= 0 GROUP BY 1, 2"""))
def stream_hourly_mean(spark, sf):
    from hazeframe.streaming.ingest import hourly_means, start_hourly_ingest
    root = DV.scratch_dir(spark, "stream")
    pages = DV.land_pages(standins.table(spark, sf, "events"), root)
    q = start_hourly_ingest(spark, pages, _selected_sensors(spark, sf), root + "/partials", root + "/_ckpt")
    q.awaitTermination()
    return r6(hourly_means(spark, root + "/partials"))


# ---- P7, A3, A27, A21 (selections, medians, label counts, normal-vs-anomaly densities) ---------

@register("masked_selection", Q.with_ctes(D, f"""SELECT city, datetime, {Q.r6('pm25')} AS pm25, season FROM processed
WHERE city = '1-URGENT' AND season = 'wet'"""))
def masked_selection(spark, sf):
    p = processed_d(spark, sf)
    return r6(p.where((F.col("city") == "1-URGENT") & (F.col("season") == "wet")).select("city", "datetime", "pm25", "season"))


@register("overall_medians", Q.with_ctes(H, "SELECT " + ", ".join(f"{Q.r6(f'median({c})')} AS {c}" for c in PR.FORECAST_FEATURES)
                                         + " FROM processed"))
def overall_medians(spark, sf):
    from hazeframe.operators.stats import key_medians
    return r6(key_medians(processed_h(spark, sf), None, PR.FORECAST_FEATURES, PR.FORECAST_FEATURES))


@register("label_distribution", Q.with_ctes(H + [_FRAME_SQL], "SELECT label, CAST(count(*) AS BIGINT) AS n FROM fr GROUP BY label"))
def label_distribution(spark, sf):
    d, _ = PR.forecast_frame(processed_h(spark, sf), levels=H_LEVELS)
    return d.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"))


def _group_hist_sql(group: str, bins: int, cond: str) -> str:
    w = f"((mx - mn) / {bins})"
    return f"""SELECT '{group}' AS grp, CAST(sp.bin AS INTEGER) AS bin, {Q.r6(f'mn + sp.bin * {w}')} AS bin_lo,
  {Q.r6(f'mn + (sp.bin + 1) * {w}')} AS bin_hi, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
  CASE WHEN {w} > 0 THEN {Q.r6(f'coalesce(c.c, 0) / (n * {w})')} END AS density
FROM (SELECT mn, mx, n, unnest(range(0, {bins})) AS bin
      FROM (SELECT min(pm25) AS mn, max(pm25) AS mx, count(pm25) AS n FROM cons WHERE {cond}) r) sp
LEFT JOIN (SELECT CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor((pm25 - mn) * {bins} / (mx - mn)), {bins - 1}) AS INTEGER) END AS bin,
                  count(*) AS c
           FROM cons, (SELECT min(pm25) AS mn, max(pm25) AS mx FROM cons WHERE {cond}) r
           WHERE {cond} GROUP BY 1) c ON c.bin = sp.bin"""


@register("anomaly_histogram", Q.with_ctes(H + _LOF_SQL, _group_hist_sql("normal", 50, "NOT anomaly_consensus")
                                           + "\nUNION ALL " + _group_hist_sql("anomaly", 30, "anomaly_consensus")))
def anomaly_histogram(spark, sf):
    d = _anomaly_frame(spark, sf).withColumn("grp", F.when(F.col("anomaly_consensus"), "anomaly").otherwise("normal"))
    normal = SM.histogram(d.where(F.col("grp") == "normal"), "grp", "pm25", 50)
    anomaly = SM.histogram(d.where(F.col("grp") == "anomaly"), "grp", "pm25", 30)
    return r6(normal.unionByName(anomaly))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
