"""Exact decision trees, grown level by level.

Every distinct value of every feature is a candidate split. A level is one aggregation (class counts per node,
feature and value), running class counts over the values of each (node, feature) by distributed prefix sums,
and the best split per node. Several trees over differently tagged rows grow in the same passes.

What reaches the driver are the splits: at most 2 ** ``max_depth`` a tree. Gini impurity over balanced class
weights (n / (2 n_class)); limits count rows. Equal gains (to 12 decimals) go to the earlier feature, then the smaller value;
a threshold lies halfway to the next value of the node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.sequence import materialize, running_totals

MAX_DEPTH = 10
MIN_SPLIT = 100
MIN_LEAF = 50


@dataclass
class Node:
    n0: int
    n1: int
    depth: int = 0
    feature: int | None = None
    threshold: float | None = None
    gain: float = 0.0  # impurity decrease, as a share of the node's weight
    left: Node | None = None
    right: Node | None = None


@dataclass
class Tree:
    root: Node
    w0: float  # weight of a row of class 0
    w1: float
    feats: list[str] = field(default_factory=list)

    def weight(self, n: Node) -> float:
        return n.n0 * self.w0 + n.n1 * self.w1

    def nodes(self) -> list[Node]:
        """All nodes, parents first."""
        out = [self.root]
        for n in out:
            out += [c for c in (n.left, n.right) if c is not None]
        return out

    def table(self) -> dict[str, list]:
        """The tree as arrays by position: feature (-1 in a leaf), threshold, left, right, value (P of class 1)."""
        nodes = self.nodes()
        at = {id(n): i for i, n in enumerate(nodes)}
        return {"feature": [-1 if n.feature is None else n.feature for n in nodes],
                "threshold": [n.threshold or 0.0 for n in nodes],
                "left": [at[id(n.left)] if n.left is not None else 0 for n in nodes],
                "right": [at[id(n.right)] if n.right is not None else 0 for n in nodes],
                "value": [n.n1 * self.w1 / self.weight(n) if self.weight(n) else 0.0 for n in nodes]}

    def importances(self) -> list[float]:
        """Weighted impurity decrease per feature, adding up to 1."""
        got = [0.0] * len(self.feats)
        for n in self.nodes():
            if n.feature is not None:
                got[n.feature] += self.weight(n) * n.gain
        total = sum(got)
        return [g / total if total else 0.0 for g in got]


def _gini(w0: Column, w1: Column) -> Column:
    w = w0 + w1
    return 1.0 - (w0 / w) * (w0 / w) - (w1 / w) * (w1 / w)


def grow(rows: DataFrame, feats: Sequence[str], label: str = "label", tree: str | None = None, max_depth: int = MAX_DEPTH,
         min_split: int = MIN_SPLIT, min_leaf: int = MIN_LEAF) -> dict[int, Tree]:
    """A tree per value of the integer column ``tree`` (None: one tree, number 0). Labels are 0 or 1."""
    spark = rows.sparkSession
    xs = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)]
    tag = F.lit(0) if tree is None else F.col(tree).cast("int")
    now = materialize(rows.select(tag.alias("tree"), F.lit(1).cast("long").alias("node"), F.col(label).cast("int").alias("y"), *xs))
    counts = now.groupBy("tree").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()  # a row a tree
    trees, open_ = {}, {}
    for r in counts:
        n = r["n0"] + r["n1"]
        trees[r["tree"]] = Tree(Node(r["n0"], r["n1"]), n / (2 * r["n0"]) if r["n0"] else 0.0, n / (2 * r["n1"]) if r["n1"] else 0.0, list(feats))
        open_[r["tree"], 1] = trees[r["tree"]].root
    for _ in range(max_depth):
        open_ = {k: n for k, n in open_.items() if n.n0 + n.n1 >= max(min_split, 2) and n.n0 and n.n1}
        if not open_:
            break
        known = F.broadcast(spark.createDataFrame(  # at most 2 ** max_depth rows a tree
            [(t, k, n.n0, n.n1, trees[t].w0, trees[t].w1) for (t, k), n in open_.items()], "tree int, node long, t0 long, t1 long, w0 double, w1 double"))
        values = F.posexplode(F.array(*[F.col(f"x{i}") for i in range(len(feats))])).alias("f", "v")
        counted = now.select("tree", "node", "y", values).where("v is not null").groupBy("tree", "node", "f", "v").agg(
            F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
        run = running_totals(counted, ["tree", "node", "f"], ["v"], {"l0": "n0", "l1": "n1"}).join(known, ["tree", "node"])
        run = run.withColumn("r0", F.col("t0") - F.col("l0")).withColumn("r1", F.col("t1") - F.col("l1"))
        fits = (F.col("l0") + F.col("l1") >= min_leaf) & (F.col("r0") + F.col("r1") >= max(min_leaf, 1))
        a0, a1, b0, b1 = (F.col(n) * F.col(w) for n, w in (("l0", "w0"), ("l1", "w1"), ("r0", "w0"), ("r1", "w1")))
        whole = a0 + a1 + b0 + b1
        gain = _gini(F.col("t0") * F.col("w0"), F.col("t1") * F.col("w1")) - (a0 + a1) / whole * _gini(a0, a1) - (b0 + b1) / whole * _gini(b0, b1)
        best = run.where(fits).withColumn("g", gain).groupBy("tree", "node").agg(
            F.min(F.struct((-F.round("g", 12)).alias("o"), "f", "v", "l0", "l1", "g")).alias("s"))
        best = best.select("tree", "node", F.col("s.f").alias("f"), F.col("s.v").alias("at"), "s.l0", "s.l1", "s.g")
        above = run.select("tree", "node", "f", "v").join(best, ["tree", "node", "f"]).where("v > at")
        splits = above.groupBy("tree", "node", "f", "at", "l0", "l1", "g").agg(F.min("v").alias("next")).collect()  # a row a node
        if not splits:
            break
        made, sent = {}, []
        for s in splits:
            n = open_[s["tree"], s["node"]]
            n.feature, n.threshold, n.gain = s["f"], s["at"] / 2 + s["next"] / 2, s["g"]
            if not s["at"] <= n.threshold < s["next"]:
                n.threshold = s["at"]
            n.left, n.right = Node(s["l0"], s["l1"], n.depth + 1), Node(n.n0 - s["l0"], n.n1 - s["l1"], n.depth + 1)
            made[s["tree"], 2 * s["node"]], made[s["tree"], 2 * s["node"] + 1] = n.left, n.right
            sent.append((s["tree"], s["node"], n.feature, n.threshold))
        open_ = made
        to = F.broadcast(spark.createDataFrame(sent, "tree int, node long, f int, threshold double"))  # as ``known``
        right = F.get(F.array(*[F.col(f"x{i}") for i in range(len(feats))]), F.col("f")) > F.col("threshold")
        now = materialize(now.join(to, ["tree", "node"]).select(
            "tree", (F.col("node") * 2 + F.coalesce(right, F.lit(False)).cast("int")).alias("node"), "y", *[f"x{i}" for i in range(len(feats))]))
    return trees


def predict(trees: dict[int, Tree], df: DataFrame, feats: Sequence[str], tree: str | None = None) -> DataFrame:
    """``df`` with ``score`` (P of class 1) and ``prediction``; each row goes down the tree its column ``tree`` names.
    A NULL feature goes to the left."""
    rows = [(t, *m.table().values()) for t, m in trees.items()]
    model = df.sparkSession.createDataFrame(rows, "_t int, _f array<int>, _c array<double>, _l array<int>, _r array<int>, _v array<double>")
    depth = max((n.depth for m in trees.values() for n in m.nodes()), default=0)
    x = F.array(*[F.col(f).cast("double") for f in feats])
    on = F.lit(0) if tree is None else F.col(tree).cast("int")
    d = df.join(F.broadcast(model), on == F.col("_t")).withColumn("_x", x)  # a row a tree

    def down(at: Column, _: Column) -> Column:
        f = F.get("_f", at)
        right = F.coalesce(F.get("_x", f) > F.get("_c", at), F.lit(False))
        return F.when(f < 0, at).when(right, F.get("_r", at)).otherwise(F.get("_l", at))

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), down)
    score = F.get("_v", leaf)
    return d.withColumn("score", score).select(*df.columns, "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
