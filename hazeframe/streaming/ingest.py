"""Incremental ingestion of landed hourly pages with Structured Streaming.

New page files under the landing folder are picked up by a file stream (``readStream.json``),
flattened, mapped to their city through the (static, small) sensor table and reduced per micro-batch
to partial sums and counts per (hour, city). Each micro-batch appends its partials to a parquet
table under a folder named by the batch id (rewritten as a whole if the batch is replayed after a
failure, so the sink is idempotent); the stream keeps no aggregation state. ``hourly_means`` merges
the partials into the hourly mean (A1) at read time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.functions.scalars import found_count
from hazeframe.operators.sequence import materialize
from hazeframe.sources.landing import PAGE_SCHEMA


def page_stream(spark: SparkSession, pages_path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming rows (sensor_id, datetime, value) from landed page files
    (``<pages_path>/sensor_id=<id>/*.json``)."""
    raw = (spark.readStream.schema(PAGE_SCHEMA.add("sensor_id", "long"))
           .option("multiLine", True).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(pages_path))
    return (raw.select("sensor_id", found_count("meta.found").alias("found"), F.explode("results").alias("r"))
               .select("sensor_id",
                       F.try_to_timestamp("r.period.datetimeFrom.utc").cast("timestamp_ntz").alias("datetime"),
                       F.col("r.value").alias("value")))


def start_hourly_ingest(spark: SparkSession, pages_path: str, sensors: DataFrame, out_path: str,
                        checkpoint_path: str, available_now: bool = True):
    """Start the stream; ``sensors`` holds (sensor_id, city). Returns the StreamingQuery."""
    # pinned once: the batches must not read the station files again
    s = materialize(sensors.select(F.col("sensor_id").cast("long").alias("sensor_id"), "city"))

    def write_partials(batch: DataFrame, batch_id: int) -> None:
        part = (batch.na.drop(subset=["value"]).where(F.col("value") >= 0)
                     .join(s, "sensor_id")  # stream-static join with the sensor table
                     .groupBy(F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("datetime"), "city")
                     .agg(F.sum("value").alias("value_sum"), F.count(F.lit(1)).alias("n")))
        part.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    w = (page_stream(spark, pages_path).writeStream.foreachBatch(write_partials)
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def hourly_means(spark: SparkSession, out_path: str) -> DataFrame:
    """A1 over everything ingested so far: mean per (hour, city) from the partials."""
    p = spark.read.parquet(out_path)
    return p.groupBy("datetime", "city").agg((F.sum("value_sum") / F.sum("n")).alias("pm25"))
