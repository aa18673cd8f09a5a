"""Keyed readings views over the driver tables (see FIXTURES.md section 2).

``readings_hourly``  events -> (city = event_type, hourly bucket, mean value)
``readings_minute``  events -> (city = event_type, minute bucket, mean value); grows with scale
``readings_daily``   orders -> (city = o_orderpriority, order date, mean total price / 3000)
``readings_discount``  lineitem -> (city = band of the discount, ship date, discounted amount / 20): levels that depend on the key
``with_gaps``        NULLs at fixed row positions per key (leading, short, long gaps)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.operators.sequence import index_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bucket_mean(df: DataFrame, key: str, ts: str, value: str, unit: str,
                out_key: str = "city", out_time: str = "datetime", out_value: str = "pm25") -> DataFrame:
    """A1: mean of ``value`` per (key, time bucket); only observed buckets appear."""
    return (df.groupBy(F.col(key).alias(out_key),
                       F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias(out_time))
              .agg(F.avg(value).alias(out_value)))


def readings_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_mean(table(spark, sf_dir, "events"), "event_type", "ts", "value", "hour")


def readings_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_mean(table(spark, sf_dir, "events"), "event_type", "ts", "value", "minute")


def readings_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("city"),
                      F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"))
             .agg((F.avg("o_totalprice") / 3000).alias("pm25")))


def readings_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("l_discount")
    band = F.when(rate < 0.035, "low").when(rate < 0.075, "mid").otherwise("high")
    return table(spark, sf_dir, "lineitem").select(
        band.alias("city"), F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"), (F.col("l_extendedprice") * rate / 20).alias("pm25"))


def with_gaps(df: DataFrame, key: str = "city", time: str = "datetime", value: str = "pm25") -> DataFrame:
    """Blank out ``value`` where the row number per key is <= 5, or rn % 11 in (3, 4), or
    100 <= rn <= 140."""
    d = index_rows(df, key, [time], bucket=F.date_trunc("day", F.col(time)), rn_col="_g")
    g = F.col("_g")
    blank = (g <= 5) | (g % 11).isin(3, 4) | g.between(100, 140)
    return d.withColumn(value, F.when(~blank, F.col(value))).drop("_g")
