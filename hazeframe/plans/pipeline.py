"""End-to-end cleaning + feature chain: readings (key, time, value) -> the 18-column processed table.

S1/P1 (caller) -> P6 -> row index -> W1-W2 -> W3 -> P5 -> re-index -> W4, W5-W8 -> F1-F6.

Shuffles on the data itself: one by (key, day) for the row index, one by (key, chunk) for gap
filling, one by (key, chunk) for the bounded windows. All per-key statistics (counts, medians,
carried neighbours) are small aggregate tables joined back; AQE broadcasts them when their
measured size is small and shuffles otherwise. Two copies of the data are pinned, the filled
readings and the windowed rows, each of which a median and a join read; medians are pinned, too
(a row per key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators import clean, features
from hazeframe.operators.sequence import DEFAULT_CHUNK_ROWS, RN, index_rows, materialize, reindex_within_chunks

PROCESSED_COLUMNS = [
    "datetime", "city", "pm25", "is_extreme", "hour", "day_of_week", "month", "day_of_year",
    "is_weekend", "season", "time_of_day", "hazard_level", "is_unhealthy", "pm25_lag_1h",
    "pm25_lag_24h", "pm25_rolling_mean_24h", "pm25_rolling_std_24h", "target_next_hour",
]


def filled_readings(df: DataFrame, key: str = "city", time: str = "datetime", value: str = "pm25",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, index_bucket: str = "day") -> DataFrame:
    """P6 -> W1-W3: gap-filled readings with ``_rn`` (position in the key before filtering)."""
    d = clean.nonfinite_to_null(df.select(key, time, F.col(value).cast("double").alias(value)), value)
    d = index_rows(d, key, [time], bucket=F.date_trunc(index_bucket, F.col(time)))
    d = materialize(clean.fill_gaps(d, key, value, chunk_rows=chunk_rows))
    return clean.fill_with_key_median(d, key, value)


def processed(df: DataFrame, key: str = "city", time: str = "datetime", value: str = "pm25",
              chunk_rows: int = DEFAULT_CHUNK_ROWS, index_bucket: str = "day", keep_rn: bool = False, pin_output: bool = False) -> DataFrame:
    """The processed table: gap filled, range filtered, extreme flag, calendar, lags, target.
    The result is a map over the pinned windowed rows; ``pin_output`` pins it as well."""
    d = filled_readings(df, key, time, value, chunk_rows, index_bucket)
    d = clean.range_filter(d, value)
    d = reindex_within_chunks(d, key, rn_col=RN, size=chunk_rows)
    d = features.bounded_window_features(d, key, value, rn_col=RN, chunk_rows=chunk_rows)
    d = features.add_calendar(d, time, value)
    cols = [c.replace("pm25", value) if c.startswith("pm25") else c for c in PROCESSED_COLUMNS]
    cols = [time if c == "datetime" else key if c == "city" else c for c in cols]
    out = d.select(*cols, *([RN] if keep_rn else []))
    return materialize(out) if pin_output else out
