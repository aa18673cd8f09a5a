"""Landed-file fixtures written by Spark from the driver tables, so the file and JSON scans are
exercised on data that grows with the tables (``events``):

* raw CSV in two header families (same columns, different order),
* hourly measurement pages, one JSON document per file, <= 1000 results per page,
  ``meta.found`` = the sensor's total ('>1000' above 1000), sensor = user_id % 40,
* station lists, one JSON document per city: station ``loc`` (0..39) lies in city loc % 4,
  (loc % 10) * 0.03 degrees north of the centre, has a PM2.5 sensor (id = loc) unless
  loc % 7 = 0 plus an ozone sensor (id = 1000 + loc), is a monitor unless loc % 3 = 0 and mobile
  when loc % 5 = 0.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.operators.sequence import index_rows
from hazeframe.sources.landing import CITIES

N_SENSORS = 40
PAGE_SIZE = 1000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder."""
    from hazeframe.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def land_raw_csv(events: DataFrame, root: str) -> str:
    utc = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    a = events.where(F.col("event_id") % 2 == 0).select(utc.alias("utc"), F.col("event_type").alias("city_name"),
                                                        F.col("value"))
    b = events.where(F.col("event_id") % 2 == 1).select(F.col("value"), utc.alias("utc"),
                                                        F.col("event_type").alias("city_name"))
    a.write.mode("overwrite").option("header", True).csv(os.path.join(root, "raw", "family_a"))
    b.write.mode("overwrite").option("header", True).csv(os.path.join(root, "raw", "family_b"))
    return os.path.join(root, "raw", "*", "*.csv")


def land_named_csv(events: DataFrame, root: str, time: str, value: str, city: str | None) -> str:
    """Raw CSV with other column names (``city`` None: no such column), in two column orders."""
    cols = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(time), F.col("value").alias(value)]
    cols += [F.col("event_type").alias(city)] if city else []
    for i, order in enumerate((cols, cols[::-1])):
        events.where(F.col("event_id") % 2 == i).select(*order).write.mode("overwrite").option("header", True).csv(os.path.join(root, "named", f"family_{i}"))
    return os.path.join(root, "named", "*", "*.csv")


def land_pages(events: DataFrame, root: str) -> str:
    d = events.select((F.col("user_id") % N_SENSORS).cast("long").alias("sensor_id"), "ts", "value", "event_id")
    # positions by (sensor, day) with running counts, so no task sorts a whole sensor
    n = d.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("_n"))
    d = index_rows(d, "sensor_id", ["ts", "event_id"], bucket=F.date_trunc("day", F.col("ts")), rn_col="_rn")
    d = d.join(n, "sensor_id").withColumn("_page", F.floor((F.col("_rn") - 1) / PAGE_SIZE))
    res = F.struct(F.col("value"), F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))
                                            .alias("datetimeFrom")).alias("period"))
    pages = (d.groupBy("sensor_id", "_page", "_n")
              .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", res.alias("r")))).alias("_rs"))
              .select("sensor_id", F.transform("_rs", lambda x: x["r"]).alias("results"),
                      F.struct(F.when(F.col("_n") > PAGE_SIZE, F.lit(f">{PAGE_SIZE}"))
                               .otherwise(F.col("_n").cast("string")).alias("found")).alias("meta")))
    out = os.path.join(root, "pages")
    pages.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("sensor_id").json(out)
    return out


def land_stations(events: DataFrame, root: str) -> str:
    spark = events.sparkSession
    cities = spark.createDataFrame([(i, c, lat, lon) for i, (c, lat, lon) in enumerate(CITIES)],
                                   "ci int, city string, lat double, lon double")
    locs = events.select((F.col("user_id") % N_SENSORS).cast("long").alias("loc")).distinct()
    locs = locs.join(F.broadcast(cities), (F.col("loc") % len(CITIES)) == F.col("ci"))  # fixed 4-row table
    pm = F.struct(F.col("loc").alias("id"), F.lit("PM2.5 sensor").alias("name"),
                  F.struct(F.lit(2).cast("long").alias("id"), F.lit("pm25").alias("name")).alias("parameter"))
    o3 = F.struct((F.col("loc") + 1000).alias("id"), F.lit("O3 sensor").alias("name"),
                  F.struct(F.lit(10).cast("long").alias("id"), F.lit("o3").alias("name")).alias("parameter"))
    sensors = F.when(F.col("loc") % 7 == 0, F.array(o3)).otherwise(F.array(pm, o3))
    st = F.struct(F.col("loc").alias("id"), F.concat(F.lit("Station "), F.col("loc")).alias("name"),
                  F.struct((F.col("lat") + (F.col("loc") % 10) * 0.03).alias("latitude"),
                           F.col("lon").alias("longitude")).alias("coordinates"),
                  (F.col("loc") % 3 != 0).alias("isMonitor"), (F.col("loc") % 5 == 0).alias("isMobile"),
                  sensors.alias("sensors"))
    doc = (locs.groupBy("city").agg(F.sort_array(F.collect_list(F.struct("loc", st.alias("s")))).alias("_l"))
               .select("city", F.transform("_l", lambda x: x["s"]).alias("results")))
    out = os.path.join(root, "stations")
    doc.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("city").json(out)
    return out
