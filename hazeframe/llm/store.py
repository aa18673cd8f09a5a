"""Shared-folder helpers: pinned tables and their folder.

A pinned table is written as Parquet below ``spark.checkpoint.dir`` (read from the session) and
reread, so that a lost executor costs the lost tasks and never the plan above the table. The shuffle
files of the write serve nothing after it and are removed when it ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hazeframe.session import ensure_checkpoint_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and reread it (cuts lineage, survives lost executors). ``group_bytes``: of a
    row group, for rows of packed arrays; a reader skips the groups that its filter leaves out."""
    bound_batches(df.sparkSession)
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # of this write only: a caller's frames may run again
    try:
        out = df.write.option("compression", "zstd")
        if group_bytes:  # sizes are looked at after each row, not after a hundred
            out = out.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
        out.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Keep the Arrow batches between Spark and Python small: rows here hold whole texts or packed
    arrays, and both sides hold a batch outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
