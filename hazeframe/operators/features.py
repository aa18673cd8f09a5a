"""Feature operators: calendar parts and labels (F1-F6), the centred extreme flag (W4, A4) and
lag / rolling / next-step features (W5-W8), all evaluated per (key, chunk) with halo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions import scalars as S
from hazeframe.operators.sequence import CHUNK, DEFAULT_CHUNK_ROWS, HALO, RN, halo_chunks, materialize
from hazeframe.operators.stats import key_medians

CENTRED_WINDOW = 24          # centred rolling window (rows); frame is [-12, +11]
EXTREME_Z = 4.0
STD_EPS = 1e-6
LONG_LAG = 24
TRAILING_WINDOW = 24


def add_calendar(df: DataFrame, time: str = "datetime", value: str = "pm25") -> DataFrame:
    """Hour, day_of_week (Mon = 0), month, day_of_year, is_weekend, season, time_of_day,
    hazard_level, is_unhealthy."""
    return (df.withColumn("hour", S.hour_of(time))
              .withColumn("day_of_week", S.weekday_of(time))
              .withColumn("month", S.month_of(time))
              .withColumn("day_of_year", S.day_of_year(time))
              .withColumn("is_weekend", S.is_weekend("day_of_week"))
              .withColumn("season", S.season_of("month"))
              .withColumn("time_of_day", S.time_of_day("hour"))
              .withColumn("hazard_level", S.hazard_level(value))
              .withColumn("is_unhealthy", S.is_unhealthy(value)))


def bounded_window_features(df: DataFrame, keys, value: str = "pm25", rn_col: str = RN,
                            chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """On a frame with a gap-free 1..n position ``rn_col`` per key, add

    * ``is_extreme``: |v - centred mean| / (centred sample std + 1e-6) > 4 over rows [-12, +11];
      a NULL std takes the key's median std.
    * ``{value}_lag_1h``, ``{value}_lag_24h``: lag by rows, NULL -> key median of ``value``.
    * ``{value}_rolling_mean_24h``: mean of the 24 previous rows, NULL -> key median.
    * ``{value}_rolling_std_24h``: sample std of the 24 previous rows, NULL -> 0.
    * ``target_next_hour``: next row's ``is_unhealthy`` (NULL on the last row).

    With ``chunk_rows`` the windows run per (key, chunk) with halo copies, so a hot key is spread
    over many tasks; ``None`` gives the plain one-partition-per-key plan (same rows).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = F.col(value)
    d = df.withColumn("is_unhealthy", S.is_unhealthy(value))
    if chunk_rows:
        d = halo_chunks(d, rn_col=rn_col, size=chunk_rows, back=max(LONG_LAG, TRAILING_WINDOW, 12), fwd=12)
        part = [*keys, CHUNK]
    else:
        part = keys
    w = Window.partitionBy(*part).orderBy(rn_col)
    centred = w.rowsBetween(-(CENTRED_WINDOW // 2), CENTRED_WINDOW // 2 - 1)
    trailing = w.rowsBetween(-TRAILING_WINDOW, -1)
    d = (d.withColumn("_cm", F.avg(v).over(centred))
          .withColumn("_cs", F.stddev_samp(v).over(centred))
          .withColumn("_lag1", F.lag(v, 1).over(w))
          .withColumn("_lagL", F.lag(v, LONG_LAG).over(w))
          .withColumn("_tm", F.avg(v).over(trailing))
          .withColumn("_ts", F.stddev_samp(v).over(trailing))
          .withColumn("target_next_hour", F.lead("is_unhealthy", 1).over(w).cast("int")))
    if chunk_rows:
        d = d.where(~F.col(HALO)).drop(HALO, CHUNK)
    d = materialize(d)
    med = materialize(key_medians(d, keys, [value, "_cs"], ["_kmed", "_kmed_cs"]))  # one row per key
    d = d.join(med, keys, "left")
    z = (v - F.col("_cm")) / (F.coalesce(F.col("_cs"), F.col("_kmed_cs")) + STD_EPS)
    return (d.withColumn("is_extreme", F.coalesce((F.abs(z) > EXTREME_Z).cast("int"), F.lit(0)))
             .withColumn(f"{value}_lag_1h", F.coalesce(F.col("_lag1"), F.col("_kmed")))
             .withColumn(f"{value}_lag_24h", F.coalesce(F.col("_lagL"), F.col("_kmed")))
             .withColumn(f"{value}_rolling_mean_24h", F.coalesce(F.col("_tm"), F.col("_kmed")))
             .withColumn(f"{value}_rolling_std_24h", F.coalesce(F.col("_ts"), F.lit(0.0)))
             .drop("_cm", "_cs", "_lag1", "_lagL", "_tm", "_ts", "_kmed", "_kmed_cs"))
