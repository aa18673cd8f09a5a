"""Row-position machinery for keyed series that scales past "one task per key".

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole series into one task; with a few
keys (four cities) or one hot key holding a third of all rows that is one task per key. The
helpers here give every row its exact position inside its series while partitioning the work
by (key, time bucket) or (key, chunk of positions):

``index_rows``     global 1-based row number per key: per-bucket counts (map-side partial
                   aggregation, a tiny table), running offsets over that tiny table, and a
                   ``row_number`` inside each (key, bucket).
``halo_chunks``    replicate the last ``back`` / first ``fwd`` rows of each chunk of ``size``
                   positions into the neighbouring chunk, so that bounded row frames
                   (lag 24, rolling 24, centred 24, lead 1) can be evaluated per (key, chunk).
``carry_nonnull``  previous / next non-null (position, value) for every row, exact even when the
                   neighbour is arbitrarily far: per-chunk summaries are carried across chunks on
                   a table of (#rows / size) entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.session import ensure_checkpoint_dir

RN = "_rn"
CHUNK = "_chunk"
HALO = "_halo"

DEFAULT_CHUNK_ROWS = 1_000_000


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def index_rows(df: DataFrame, keys, order: Sequence[str] | str, bucket: Column | None = None,
               rn_col: str = RN) -> DataFrame:
    """Add ``rn_col`` = 1-based position of the row inside its key, ordered by ``order``.

    ``bucket`` must be a monotone function of the first order column (e.g. ``date_trunc('day',
    datetime)``); rows are numbered inside (key, bucket) in parallel and shifted by the running
    count of the earlier buckets. Without ``bucket`` the whole key is one window partition.
    Rows without a key are left out (no series holds them); rows without an order value come last in
    their series.
    """
    keys = _keys(keys)
    order = [F.col(o).asc_nulls_last() for o in ([order] if isinstance(order, str) else order)]
    df = df.na.drop(subset=keys) if keys else df
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rn_col, F.row_number().over(w).cast("long"))
    d = df.withColumn("_bkt", bucket)
    counts = d.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy(F.col("_bkt").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_bkt").alias("_obkt"),
                            F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_boff"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    d = d.withColumn("_lrn", local)
    same = F.col("_bkt").eqNullSafe(F.col("_obkt"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_o_{k}"))
    return (d.join(offsets, same, "inner")
             .withColumn(rn_col, (F.col("_boff") + F.col("_lrn")).cast("long"))
             .drop("_bkt", "_obkt", "_lrn", "_boff", *[f"_o_{k}" for k in keys]))


def reindex_within_chunks(df: DataFrame, keys, rn_col: str = RN, size: int = DEFAULT_CHUNK_ROWS,
                          out_col: str = RN) -> DataFrame:
    """Renumber the surviving rows 1..n per key after a filter, keeping the old order.

    Works per (key, chunk of the old positions): kept-row counts per chunk are a tiny table whose
    running sum gives each chunk's offset.
    """
    keys = _keys(keys)
    d = df.withColumn("_oc", F.floor((F.col(rn_col) - 1) / size))
    counts = d.groupBy(*keys, "_oc").agg(F.count(F.lit(1)).alias("_cn"))
    wc = Window.partitionBy(*keys).orderBy("_oc").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_oc", F.coalesce(F.sum("_cn").over(wc), F.lit(0)).alias("_coff"))
    local = F.row_number().over(Window.partitionBy(*keys, "_oc").orderBy(rn_col))
    d = d.withColumn("_lrn", local)
    return (d.join(offsets, [*keys, "_oc"], "inner")
             .withColumn(out_col, (F.col("_coff") + F.col("_lrn")).cast("long"))
             .drop("_oc", "_lrn", "_coff"))


def halo_chunks(df: DataFrame, rn_col: str = RN, size: int = DEFAULT_CHUNK_ROWS,
                back: int = 24, fwd: int = 12) -> DataFrame:
    """Assign ``_chunk`` = (rn - 1) div size and add halo copies (``_halo`` = true) of the rows
    that a neighbouring chunk's bounded frame can reach. Evaluate windows over
    ``partitionBy(key, _chunk).orderBy(rn)`` and then drop the halo rows."""
    if size < max(back, fwd, 1):
        raise ValueError("chunk size must be at least the halo width")
    pos = (F.col(rn_col) - 1) % size
    chunk = F.floor((F.col(rn_col) - 1) / size)
    targets = F.array(
        F.struct(chunk.alias("c"), F.lit(False).alias("h")),
        F.when(pos >= size - back, F.struct((chunk + 1).alias("c"), F.lit(True).alias("h"))),
        F.when((pos < fwd) & (chunk > 0), F.struct((chunk - 1).alias("c"), F.lit(True).alias("h"))),
    )
    return (df.withColumn("_t", F.explode(F.filter(targets, lambda t: t.isNotNull())))
              .withColumn(CHUNK, F.col("_t.c"))
              .withColumn(HALO, F.col("_t.h"))
              .drop("_t"))


def carry_nonnull(df: DataFrame, keys, value: str, rn_col: str = RN,
                  size: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``_pv, _pi`` (last non-null value and its position at or before the row) and ``_nv,
    _ni`` (first non-null at or after the row), exact over the whole key.

    Within a chunk both come from running frames (the "next" one from a descending order, which
    keeps the frame O(1) per row); across chunks from a carried per-chunk summary.
    """
    keys = _keys(keys)
    v = F.col(value)
    d = df.withColumn(CHUNK, F.floor((F.col(rn_col) - 1) / size))
    nn = F.when(v.isNotNull(), F.struct(F.col(rn_col).alias("i"), v.alias("v")))
    summ = d.groupBy(*keys, CHUNK).agg(F.max(nn).alias("_last"), F.min(nn).alias("_first"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*keys, CHUNK,
                        F.last("_last", ignorenulls=True).over(before).alias("_cprev"),
                        F.last("_first", ignorenulls=True).over(after).alias("_cnext"))
    run_up = Window.partitionBy(*keys, CHUNK).orderBy(rn_col).rowsBetween(Window.unboundedPreceding, 0)
    run_down = (Window.partitionBy(*keys, CHUNK).orderBy(F.col(rn_col).desc())
                .rowsBetween(Window.unboundedPreceding, 0))
    d = (d.withColumn("_lp", F.last(nn, ignorenulls=True).over(run_up))
          .withColumn("_ln", F.last(nn, ignorenulls=True).over(run_down)))
    d = d.join(carry, [*keys, CHUNK], "inner")
    prev = F.coalesce(F.col("_lp"), F.col("_cprev"))
    nxt = F.coalesce(F.col("_ln"), F.col("_cnext"))
    return (d.withColumn("_pv", prev["v"]).withColumn("_pi", prev["i"])
             .withColumn("_nv", nxt["v"]).withColumn("_ni", nxt["i"])
             .drop("_lp", "_ln", "_cprev", "_cnext", CHUNK))


# How multi-pass operators pin an intermediate result that later steps read more than once
# (a statistic computed from it and then joined back to it). Without it every such step repeats
# the whole upstream plan, and nested steps repeat it exponentially often. "table" (default)
# writes it as Parquet below spark.checkpoint.dir and rereads it: one job, later plans start at a scan
# whose size is known and whose columns are pruned, and the result survives lost executors.
# "checkpoint" writes an RDD checkpoint (for types that Parquet lacks); "cache" keeps it in executor
# memory / local disk (lost blocks are recomputed from the lineage); "none" leaves the plan as it is.
MATERIALIZE = "table"


def materialize(df: DataFrame, how: str | None = None) -> DataFrame:
    how = how or MATERIALIZE
    if how == "table":
        path = f"{ensure_checkpoint_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "checkpoint":
        # persist first: writing the checkpoint files runs a second job over the same plan, which
        # then reads the persisted blocks instead of recomputing
        from pyspark import StorageLevel
        df.persist(StorageLevel.MEMORY_AND_DISK)
        out = df.checkpoint(eager=True)
        df.unpersist()
        return out
    if how == "cache":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, its rows' numbers (from 1) in ascending order: ranges are numbered one by one and shifted
    by the rows of the ranges before, so no task sorts them all."""
    cols = [F.col(o) for o in order]
    dealt = materialize(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = counts.select("_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    return dealt.withColumn("_at", inside).join(shift, "_range").withColumn(
        out, (F.col("_shift") + F.col("_at")).cast("long")).drop("_range", "_at", "_shift")


def running_totals(df: DataFrame, keys, order: Sequence[str], totals: dict[str, str], exclusive: bool = False) -> DataFrame:
    """``df`` with running sums per key in ascending order: ``totals`` maps a new column to the summed one.

    Distributed prefix sums: rows are dealt by ranges of (keys, order), summed inside their range and
    shifted by the totals of the key's ranges before, so a key of any size is spread over tasks. Rows with the same
    (keys, order) are in no defined order; NULL keys are a key of their own. ``exclusive`` leaves out the row itself.
    """
    keys = _keys(keys)
    dealt = materialize(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id()))
    names = list(totals)
    held = dealt.groupBy(*keys, "_range").agg(*[F.sum(totals[n]).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and range
    shift = held.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_range").alias("_o_range"),
                        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    same = F.col("_range") == F.col("_o_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    out = dealt.select("*", *[F.coalesce(F.sum(totals[n]).over(inside), F.lit(0)).alias(f"_i_{n}") for n in names]).join(shift, same)
    return out.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_i_{n}")).alias(n) for n in names])
