"""Descriptive tables (A2, A5-A22, A34, T2): all plain grouped aggregations.

Per-key loops of the analysed pipeline become one ``groupBy`` each; statistics that need a
per-key value on every row (histogram bounds, box-plot fences) are computed as a small per-key
table and joined back instead of a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions.scalars import round_half_even
from hazeframe.operators.stats import key_medians, key_quantiles


def city_summary(df: DataFrame, key: str = "city", value: str = "pm25", flag: str = "is_unhealthy",
                 time: str = "datetime") -> DataFrame:
    """Count, mean, sample std, min, max, median of ``value``; mean of ``flag``; time
    range; all rounded half-even to 2 digits; ``unhealthy_pct`` from the rounded mean (x100, 1 digit)."""
    agg = df.groupBy(key).agg(
        F.count(value).cast("long").alias(f"{value}_count"),
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.avg(flag).alias("_flag"),
        F.min(time).alias(f"{time}_min"), F.max(time).alias(f"{time}_max"))
    med = key_medians(df, key, [value], ["_med"])
    d = agg.join(med, key, "left")
    flag_mean = round_half_even(F.col("_flag"), 2)
    return d.select(
        key, f"{value}_count",
        round_half_even(F.col("_mean"), 2).alias(f"{value}_mean"),
        round_half_even(F.col("_std"), 2).alias(f"{value}_std"),
        round_half_even(F.col("_min"), 2).alias(f"{value}_min"),
        round_half_even(F.col("_max"), 2).alias(f"{value}_max"),
        round_half_even(F.col("_med"), 2).alias(f"{value}_median"),
        flag_mean.alias(f"{flag}_mean"),
        f"{time}_min", f"{time}_max",
        round_half_even(flag_mean * 100, 1).alias("unhealthy_pct"))


def extreme_rate(df: DataFrame, flag: str = "is_extreme") -> DataFrame:
    """A5: number and percentage of flagged rows."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.sum(flag).cast("long").alias("extreme_count"),
                  (F.sum(flag) * 100.0 / F.count(F.lit(1))).alias("extreme_pct"))


def group_mean(df: DataFrame, keys: Sequence, value: str = "pm25", name: str | None = None) -> DataFrame:
    """Mean of ``value`` per group (keys may be columns or named expressions)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name or f"{value}_mean"))


def daily_mean(df: DataFrame, key: str = "city", time: str = "datetime", value: str = "pm25") -> DataFrame:
    """Mean per key and calendar date."""
    return group_mean(df, [key, F.to_date(time).alias("date")], value)


def level_mix(df: DataFrame, key: str, level: str, levels: Sequence[str], row_order: Sequence[str] | None = None) -> DataFrame:
    """Row percentages of ``level`` per ``key``; a combination missing in a key counts
    0, a level missing everywhere gives NULL. With ``row_order`` the result has exactly those keys
    (absent ones as NULL rows) plus an ``ord`` column giving their order."""
    counts = df.groupBy(key).pivot(level, list(levels)).count()
    present = df.agg(*[F.max((F.col(level) == lv).cast("int")).alias(f"_p{i}") for i, lv in enumerate(levels)])
    total = sum(F.coalesce(F.col(f"`{lv}`"), F.lit(0)) for lv in levels)
    d = counts.crossJoin(F.broadcast(present))  # one row
    cols = [F.when(F.col(f"_p{i}") == 1, F.coalesce(F.col(f"`{lv}`"), F.lit(0)) * 100.0 / total).alias(lv)
            for i, lv in enumerate(levels)]
    out = d.select(key, *cols)
    if row_order is None:
        return out
    spine = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(row_order)], f"{key} string, ord int")
    return F.broadcast(spine).join(out, key, "left")


def level_share_long(df: DataFrame, key: str, level: str, digits: int = 1) -> DataFrame:
    """Share (percent, rounded half-even) of each observed level within each key."""
    counts = df.groupBy(key, level).agg(F.count(F.lit(1)).alias("_n"))
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("_t"))
    return (counts.join(totals, key)
                  .select(key, level, round_half_even(F.col("_n") * 100.0 / F.col("_t"), digits).alias("share_pct")))


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair (long form: col_a, col_b, corr),
    in one aggregation pass. corr = covar_pop / (std_pop_a * std_pop_b); a constant column has
    no correlation (NULL through ``try_divide``), never an ANSI division error."""
    cols = list(cols)
    aggs = [F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"_v{i}_{j}")
             for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(*aggs)
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.when(F.col(f"_s{i}") > 0, F.lit(1.0))
            else:
                lo, hi = min(i, j), max(i, j)
                v = F.try_divide(F.col(f"_v{lo}_{hi}"), F.col(f"_s{lo}") * F.col(f"_s{hi}"))
            entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.cast("double").alias("corr")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def city_compare(df: DataFrame, key: str = "city", value: str = "pm25") -> DataFrame:
    """Mean, sample std, median per key and the key's position by ascending mean."""
    agg = df.groupBy(key).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))
    med = key_medians(df, key, [value], [f"{value}_median"])
    d = agg.join(med, key, "left")
    return d.withColumn("mean_rank", F.row_number().over(Window.orderBy(f"{value}_mean", key)).cast("int"))


def rate_by(df: DataFrame, key: str, flag: str = "is_unhealthy", name: str = "unhealthy_pct") -> DataFrame:
    """Percentage of flagged rows per key, with the ascending position."""
    d = df.groupBy(key).agg((F.avg(flag) * 100).alias(name))
    return d.withColumn("pct_rank", F.row_number().over(Window.orderBy(name, key)).cast("int"))


def mean_pivot(df: DataFrame, key: str, pivot: str, values: Sequence[str], value: str = "pm25") -> DataFrame:
    """Mean of ``value`` per key with one column per pivot value (NULL if absent)."""
    return df.groupBy(key).pivot(pivot, list(values)).agg(F.avg(value))


def top_groups(df: DataFrame, key: str, value: str = "pm25", n: int = 3) -> DataFrame:
    """The ``n`` groups with the highest mean (ties: smaller key first)."""
    d = df.groupBy(key).agg(F.avg(value).alias(f"{value}_mean"))
    order = [F.desc(f"{value}_mean"), F.col(key)]
    top = d.orderBy(*order).limit(n)  # per-partition top-n, merged
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))  # n rows


def argmax_groups(df: DataFrame, key: str = "city", season: str = "season", value: str = "pm25",
                  flag: str = "is_unhealthy") -> DataFrame:
    """Key with the highest and the lowest mean, season with the highest mean (ties:
    first in key order), overall flagged percentage."""
    by_key = df.groupBy(key).agg(F.avg(value).alias("m"))
    by_season = df.groupBy(season).agg(F.avg(value).alias("m"))
    k = by_key.agg(F.min_by(key, F.struct(-F.col("m"), F.col(key))).alias("most_polluted"),
                   F.min_by(key, F.struct(F.col("m"), F.col(key))).alias("cleanest"))
    s = by_season.agg(F.min_by(season, F.struct(-F.col("m"), F.col(season))).alias("worst_season"))
    o = df.agg((F.avg(flag) * 100).alias("overall_unhealthy_pct"))
    return k.crossJoin(s).crossJoin(o)


def overview(df: DataFrame, key: str = "city", time: str = "datetime") -> DataFrame:
    """Rows, time range, distinct keys, column count."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.min(time).alias("datetime_min"), F.max(time).alias("datetime_max"),
                  F.count_distinct(key).cast("long").alias("n_cities"),
                  F.array_join(F.array_sort(F.collect_set(key)), ", ").alias("cities"),
                  F.lit(len(df.columns)).cast("int").alias("n_columns"))


def histogram(df: DataFrame, keys, value: str = "pm25", bins: int = 50) -> DataFrame:
    """Equal-width bins per key from the key's min to max (last bin closed on the right);
    every bin appears (count 0 when empty); ``density`` = count / (n * width)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rng = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"),
                                F.count(value).alias("_n"))
    width = (F.col("_mx") - F.col("_mn")) / bins
    b = (F.when(F.col("_mx") == F.col("_mn"), F.lit(0))
          .otherwise(F.least(F.floor((F.col(value) - F.col("_mn")) * bins / (F.col("_mx") - F.col("_mn"))),
                             F.lit(bins - 1))).cast("int"))
    counts = (df.where(F.col(value).isNotNull()).join(rng, keys)
                .groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("_c")))
    spine = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (spine.join(counts, [*keys, "bin"], "left")
                 .select(*keys, "bin",
                         (F.col("_mn") + F.col("bin") * width).alias("bin_lo"),
                         (F.col("_mn") + (F.col("bin") + 1) * width).alias("bin_hi"),
                         F.coalesce(F.col("_c"), F.lit(0)).cast("long").alias("count"),
                         F.when(width > 0, F.coalesce(F.col("_c"), F.lit(0)) / (F.col("_n") * width))
                          .alias("density")))


def boxplot_stats(df: DataFrame, key: str = "city", value: str = "pm25") -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the furthest points within 1.5 IQR,
    outlier count, and the key's position by descending median."""
    q = key_quantiles(df, key, [(value, 0.25, "q1"), (value, 0.5, "median"), (value, 0.75, "q3")])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    v = F.col(value)
    w = (df.select(key, value).join(q, key)
           .groupBy(key).agg(F.min(F.when(v >= lo, v)).alias("whisker_lo"),
                             F.max(F.when(v <= hi, v)).alias("whisker_hi"),
                             F.sum(((v < lo) | (v > hi)).cast("long")).alias("n_outliers")))
    d = q.join(w, key)
    return d.withColumn("median_rank", F.row_number().over(Window.orderBy(F.desc("median"), key)).cast("int"))
