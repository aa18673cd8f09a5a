"""File scans and sinks.

``read_raw_csv``     several landed CSV files whose headers may differ: files are grouped by
                     header (one distributed pass over the first lines of every file), each group is
                     read with its own header, and the groups are united by column name. Reading
                     files of different headers with one reader would bind columns by position.
``standardize``      schema coalescing of the raw union into (datetime, city, pm25), following the
                     column-name precedence of the analysed pipeline; the choice is made on the
                     column names (metadata) and applied as one projection.
``read_processed``   the processed table with its explicit schema (parquet, or CSV).
``write_*``          overwrite sinks; raw readings partitioned by a city slug.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeframe.functions.scalars import slug

PROCESSED_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()), T.StructField("city", T.StringType()),
    T.StructField("pm25", T.DoubleType()), T.StructField("is_extreme", T.IntegerType()),
    T.StructField("hour", T.IntegerType()), T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("day_of_year", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()), T.StructField("season", T.StringType()),
    T.StructField("time_of_day", T.StringType()), T.StructField("hazard_level", T.StringType()),
    T.StructField("is_unhealthy", T.IntegerType()), T.StructField("pm25_lag_1h", T.DoubleType()),
    T.StructField("pm25_lag_24h", T.DoubleType()), T.StructField("pm25_rolling_mean_24h", T.DoubleType()),
    T.StructField("pm25_rolling_std_24h", T.DoubleType()), T.StructField("target_next_hour", T.IntegerType()),
])


HEAD_BYTES = 1 << 16


def _opened(path: str):
    """(file system, path there) of a file by its Spark path; raises ValueError for a store that Arrow can't open."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def first_line(path: str, block: int = HEAD_BYTES) -> tuple[str | None, int]:
    """(first line, bytes read) of a text file, read block by block up to its first line end; no line in an empty file."""
    where, name = _opened(path)
    with where.open_input_file(name) as f:
        got = b""
        while b"\n" not in got:
            more = f.read(block)
            if not more:
                break
            got += more
    return (got.split(b"\n", 1)[0].rstrip(b"\r").decode() if got else None), len(got)


def first_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of every non-empty text file under ``path``.

    Spark lists the files and deals them to tasks, which read the first block of each, whatever its size. A store that only
    Spark can open is scanned as text instead. The file names reach the driver, which holds them for the listing anyway.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read
    some = files.limit(1).collect()
    if not some:
        return []
    try:
        _opened(some[0]["path"])
    except (ValueError, OSError):  # Arrow knows no such store
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
                                            F.monotonically_increasing_id().alias("no")).where("at = 0")
        return [(r["file"], r["line"]) for r in rows.groupBy("file").agg(F.min_by("value", "no").alias("line")).collect()]

    def heads(batches):
        for rb in batches:
            got = [(p, first_line(p)[0]) for p in rb.column(0).to_pylist()]
            got = [(p, line) for p, line in got if line is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], names=["file", "line"])

    dealt = files.repartition(spark.sparkContext.defaultParallelism)
    return [(r["file"], r["line"]) for r in dealt.mapInArrow(heads, "file string, line string").collect()]  # a row a file


def header_families(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Map header line -> files having it."""
    fam: dict[str, list[str]] = {}
    for file, header in first_lines(spark, path):
        fam.setdefault(header, []).append(file)
    if not fam:
        raise FileNotFoundError(f"no CSV files found at {path}")
    return fam


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path`` (glob allowed), united by column name; values as strings."""
    parts = []
    for header, files in sorted(header_families(spark, path).items()):
        parts.append(spark.read.option("header", True).option("inferSchema", False).csv(sorted(files)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _first(cols: Sequence[str], pred) -> str | None:
    for c in cols:
        if pred(c):
            return c
    return None


def standardize(df: DataFrame, strict: bool = True) -> DataFrame:
    """(datetime, city, pm25) from the raw union.

    time: ``date`` when there is no ``utc``, else ``utc``, else ``datetime``, else ``date.utc``;
    value: ``value`` if present, else an existing ``pm25``, else the first column whose lower-cased
    name contains ``pm`` or ``value``; city: ``city_name`` if present, else ``city``, else 'Unknown'.
    A time that can't be read raises; with ``strict=False`` it becomes NULL (the row stays, last in
    its series, and ``time_rejects`` counts such rows).
    """
    cols = df.columns
    if "date" in cols and "utc" not in cols:
        tcol = "date"
    elif "utc" in cols:
        tcol = "utc"
    elif "datetime" in cols:
        tcol = "datetime"
    elif "date.utc" in cols:
        tcol = "date.utc"
    else:
        raise KeyError("no time column (date, utc, datetime or date.utc)")
    if "value" in cols:
        vcol = "value"
    elif "pm25" in cols:
        vcol = "pm25"
    else:
        vcol = _first(cols, lambda c: "pm" in c.lower() or "value" in c.lower())
        if vcol is None:
            raise KeyError("no value column")
    city = F.col("`city_name`") if "city_name" in cols else F.col("`city`") if "city" in cols else F.lit("Unknown")
    ts = F.col(f"`{tcol}`")
    if not isinstance(df.schema[tcol].dataType, (T.TimestampType, T.TimestampNTZType)):
        text = ts.cast("string")
        ts = F.try_to_timestamp(text)
        if strict:
            bad = F.raise_error(F.concat(F.lit("time can't be read: "), text)).cast("timestamp")
            ts = F.when(text.isNotNull() & ts.isNull(), bad).otherwise(ts)
    return df.select(ts.cast("timestamp_ntz").alias("datetime"), city.cast("string").alias("city"),
                     F.col(f"`{vcol}`").cast("double").alias("pm25"))


def time_rejects(df: DataFrame, time: str = "datetime") -> DataFrame:
    """One row: rows read, and rows without a readable time."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.count_if(F.col(time).isNull()).cast("long").alias("n_without_time"))


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The processed table with its explicit schema."""
    if fmt == "parquet":
        return spark.read.schema(PROCESSED_SCHEMA).parquet(path)
    return (spark.read.schema(PROCESSED_SCHEMA).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite sink (parquet, or CSV with header)."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_raw_by_city(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Raw readings partitioned by the city slug (one folder per city)."""
    d = df.withColumn("city_slug", slug("city"))
    w = d.write.mode("overwrite").partitionBy("city_slug")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def through_sink(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write a table and read it back with its own schema (CSV keeps no types, and no difference between NULL and '')."""
    write_table(df, path, fmt)
    if fmt == "parquet":
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return (df.sparkSession.read.schema(df.schema).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
