"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.sequence import materialize


def connected_components(edges: DataFrame, vertices: DataFrame, src: str = "src", dst: str = "dst",
                         vid: str = "id") -> DataFrame:
    """Smallest vertex id of each vertex's component (edges undirected). Rounds of min-label
    propagation over edges followed by pointer jumping (label <- label of label), pinned, until no
    label changes."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = materialize(vertices.select(F.col(vid).alias("v"), F.col(vid).alias("l")))
    while True:
        prop = (e.join(lab.withColumnRenamed("v", "b").withColumnRenamed("l", "lb"), "b")
                 .groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("m")))
        new = (lab.join(prop, "v", "left")
                  .select("v", F.least(F.col("l"), F.coalesce(F.col("m"), F.col("l"))).alias("l")))
        jump = (new.alias("x").join(new.alias("y"), F.col("x.l") == F.col("y.v"), "left")
                   .select(F.col("x.v").alias("v"), F.least(F.col("x.l"), F.coalesce(F.col("y.l"), F.col("x.l"))).alias("l")))
        jump = materialize(jump)  # cuts the lineage every round
        changed = jump.join(lab.withColumnRenamed("l", "old"), "v").where(F.col("l") != F.col("old")).limit(1).count()
        lab = jump
        if changed == 0:
            return lab.select(F.col("v").alias(vid), F.col("l").alias("component"))
