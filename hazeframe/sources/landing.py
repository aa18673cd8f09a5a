"""Landed API responses (S3-S6, J1, J2, T4, P9, F21): station lists and hourly measurement pages
as JSON files, read with ``spark.read.json`` and flattened with ``explode`` / higher-order array
functions.

Landing layout (Hive-style partitions give the context the request carried):
``<root>/stations/city=<name>/*.json``      one locations response per file (``results[]``)
``<root>/pages/sensor_id=<id>/*.json``      one hourly page per file (``results[]``, ``meta``)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeframe.functions.scalars import found_count, haversine_m

# The monitored cities and their centre coordinates, the PM2.5 parameter id,
# the search radius and the station cap per city.
CITIES = [
    ("Bangkok", 13.7563, 100.5018),
    ("Ho Chi Minh City", 10.8231, 106.6297),
    ("Kuala Lumpur", 3.1390, 101.6869),
    ("Singapore", 1.3521, 103.8198),
]
PM25_PARAMETER_ID = 2
PM25_PARAMETER_NAME = "pm25"
RADIUS_M = 25_000
STATIONS_PER_CITY = 5
YEAR = 2023

STATION_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("coordinates", T.StructType([T.StructField("latitude", T.DoubleType()),
                                               T.StructField("longitude", T.DoubleType())])),
    T.StructField("isMonitor", T.BooleanType()), T.StructField("isMobile", T.BooleanType()),
    T.StructField("sensors", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("parameter", T.StructType([T.StructField("id", T.LongType()),
                                                 T.StructField("name", T.StringType())]))]))),
])))])

PAGE_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("value", T.DoubleType()),
        T.StructField("period", T.StructType([T.StructField("datetimeFrom", T.StructType([
            T.StructField("utc", T.StringType())]))]))]))),
    T.StructField("meta", T.StructType([T.StructField("found", T.StringType())])),
])


def city_dimension(spark: SparkSession) -> DataFrame:
    """The city table (fixed, four rows)."""
    return spark.createDataFrame(CITIES, "city string, lat double, lon double")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per station with at least one PM2.5 sensor (parameter id 2 or name 'pm25');
    defaults 'Unknown' / false / 'PM2.5'; ``pos`` = position in the response."""
    raw = spark.read.schema(STATION_SCHEMA).option("multiLine", True).json(path)
    ctx = [c for c in raw.columns if c != "results"]  # partition columns such as city
    loc = raw.select(*ctx, F.col("_metadata.file_path").alias("_file"),
                     F.posexplode("results").alias("pos", "r"))
    pm = F.filter("r.sensors", lambda s: (s["parameter"]["id"] == PM25_PARAMETER_ID)
                  | (s["parameter"]["name"] == PM25_PARAMETER_NAME))
    sensors = F.transform(pm, lambda s: F.struct(s["id"].alias("sensor_id"),
                                                 F.coalesce(s["name"], F.lit("PM2.5")).alias("sensor_name")))
    return (loc.select(*ctx, "_file", "pos", F.col("r.id").alias("location_id"),
                       F.coalesce("r.name", F.lit("Unknown")).alias("location_name"),
                       F.col("r.coordinates.latitude").alias("latitude"),
                       F.col("r.coordinates.longitude").alias("longitude"),
                       F.coalesce("r.isMonitor", F.lit(False)).alias("is_monitor"),
                       F.coalesce("r.isMobile", F.lit(False)).alias("is_mobile"),
                       sensors.alias("sensors"))
               .where(F.size("sensors") > 0))


def stations_near(stations: DataFrame, cities: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Stations within ``radius_m`` of a city centre (broadcast of the fixed city table,
    non-equi join on the haversine distance)."""
    c = F.broadcast(cities.select(F.col("city").alias("near_city"), "lat", "lon"))  # fixed 4-row dimension
    return (stations.join(c, haversine_m("latitude", "longitude", "lat", "lon") <= radius_m, "inner")
                    .withColumn("distance_m", haversine_m("latitude", "longitude", "lat", "lon"))
                    .drop("lat", "lon"))


def select_stations(stations: DataFrame, key: str = "city", n: int = STATIONS_PER_CITY) -> DataFrame:
    """P9 + T4: stationary monitors (monitor and not mobile) when a city has any, else all its
    stations; the first ``n`` in response order."""
    stationary = F.col("is_monitor") & ~F.col("is_mobile")
    w = Window.partitionBy(key)
    d = stations.withColumn("_any", F.max(stationary.cast("int")).over(w))
    d = d.where(stationary | (F.col("_any") == 0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_file", "pos"))
    return d.withColumn("station_rank", rank).where(F.col("station_rank") <= n).drop("_any")


def station_sensors(stations: DataFrame) -> DataFrame:
    """One row per (station, PM2.5 sensor)."""
    return (stations.select("*", F.explode("sensors").alias("s"))
                    .select(*[c for c in stations.columns if c != "sensors"], "s.sensor_id", "s.sensor_name"))


def read_pages(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """One row per hourly result: (sensor_id from the landing path, datetime, value, page file,
    reported total). ``keep_empty`` gives a page without results one row with ``landed`` = false."""
    raw = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)
    ctx = [c for c in raw.columns if c not in ("results", "meta")]
    one = (F.explode_outer if keep_empty else F.explode)(F.transform("results", lambda r: F.struct(F.lit(True).alias("landed"), r.alias("r"))))
    rows = raw.select(*ctx, F.col("_metadata.file_path").alias("page_file"), found_count("meta.found").alias("found"), one.alias("x"))
    flag = [F.coalesce("x.landed", F.lit(False)).alias("landed")] if keep_empty else []
    return rows.select(*ctx, "page_file", "found",
                       F.try_to_timestamp("x.r.period.datetimeFrom.utc").cast("timestamp_ntz").alias("datetime"),
                       F.col("x.r.value").alias("value"), *flag)


def page_completeness(pages: DataFrame) -> DataFrame:
    """per sensor, rows landed vs. the total the API reported (largest ``found``). Pages read
    with ``keep_empty`` count as pages, so a sensor with empty pages only has 0 rows."""
    landed = F.count_if("landed") if "landed" in pages.columns else F.count(F.lit(1))
    return pages.groupBy("sensor_id").agg(landed.cast("long").alias("rows"),
                                          F.max("found").cast("long").alias("reported"),
                                          F.count_distinct("page_file").cast("long").alias("pages"))


def restrict_year(df: DataFrame, year: int = YEAR, col: str = "datetime") -> DataFrame:
    """Keep [year-01-01T00:00:00, year-12-31T23:59:59]."""
    lo = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{year}-12-31 23:59:59").cast("timestamp_ntz")
    return df.where(F.col(col).between(lo, hi))


def enrich(measurements: DataFrame, sensors: DataFrame) -> DataFrame:
    """Measurements with city, location name and id through the sensor -> station mapping."""
    s = sensors.select("sensor_id", "city", "location_name", "location_id")
    return measurements.join(s, "sensor_id", "inner")


def hourly_readings(enriched: DataFrame) -> DataFrame:
    """P3-P5 + A1: value -> pm25, drop missing and negative, mean per (hour, city)."""
    d = enriched.withColumnRenamed("value", "pm25").na.drop(subset=["pm25"]).where(F.col("pm25") >= 0)
    return d.groupBy(F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("datetime"), "city") \
            .agg(F.avg("pm25").alias("pm25"))
