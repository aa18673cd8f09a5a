"""Connected components over edge tables: alternating large-star and small-star, to convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.llm.store import pin


def _least(e: DataFrame) -> DataFrame:
    """(u, v, m): every edge end u with its neighbour v and the least of u and its neighbours."""
    m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.hint("merge").join(m, "u")  # both sides are shuffled by u anyway: no copy of m goes through the driver


def _rows(e: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """The given pairs of columns of every row, each as a row of its own."""
    return e.select(F.inline(F.array(*(F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs))))


def _open(e: DataFrame) -> bool:
    """Whether some component is no star yet: a node with two smaller neighbours, or a smaller and a larger one."""
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                     F.struct(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    n = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return n.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).agg(F.count(F.lit(1))).first()[0] > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge; comp is the smallest node. ``edges``: longs a, b.

    Each pass ends in a pinned table; passes go on until every component is a star around its smallest
    node, which is what further passes would leave as it is. Then every edge is (node, smallest node).
    A pass reads its edges once a side of its joins: small plans, as the driver keeps each of them.
    """
    e = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while _open(e):
        both = _rows(e, ("a", "b"), ("b", "a"), names=("u", "v"))
        large = _least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = _least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        e = pin(_rows(down, ("v", "m"), ("u", "m"), names=("a", "b")).where("a <> b").distinct(), "edges")
    return _rows(e, ("a", "b"), ("b", "b"), names=("node", "comp")).distinct()
