"""DBSCAN without pairs of points.

Points become locations (equal coordinates are one, with a weight) in cells whose diagonal is at most
``eps``. What a cell can't settle as a whole is settled by its parts: halves, quarters, ... of the cell
along every coordinate, each with its tight box and weight, down to single locations.

* Core points: a cell of ``min_samples`` points is core as a whole. Every other point adds up the cells
  around it: one wholly within reach counts with its weight, one out of reach not at all, and only
  cells in between are split, until the point surely has enough neighbours or surely has not. Neighbours
  beyond ``min_samples`` are never looked at.
* Links: the core points of one cell are one cluster. Two cells are linked as soon as any two of their
  parts lie wholly within ``eps`` of each other; parts of cells that are in one component already, or out
  of reach, drop out.
* Border points take the lowest-numbered cluster with a core point within ``eps``, by the same descent.

Tables per round hold (location, part) or (part, part); points beside dense cells meet few parts of them,
so the work grows with the rows and not with the neighbours a point has.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.components import connected_components
from hazeframe.operators.sequence import materialize, number_rows

EPS = 0.8
MIN_SAMPLES = 50
FEW = 8  # a part of at most so many locations is split into them at once
GRID_DIMS = 3  # coordinates of the coarse grid that finds neighbouring cells


def _norm(terms: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [t * t for t in terms]))


def _between(lo: str, hi: str, lo2: str, hi2: str, d: int) -> Column:
    """Least distance between two boxes (columns by prefix and dimension); a point is a box with lo = hi."""
    return _norm([F.greatest(F.lit(0.0), F.col(f"{lo2}{i}") - F.col(f"{hi}{i}"), F.col(f"{lo}{i}") - F.col(f"{hi2}{i}")) for i in range(d)])


def _across(lo: str, hi: str, lo2: str, hi2: str, d: int) -> Column:
    """Greatest distance between two boxes."""
    return _norm([F.greatest(F.abs(F.col(f"{hi}{i}") - F.col(f"{lo2}{i}")), F.abs(F.col(f"{hi2}{i}") - F.col(f"{lo}{i}"))) for i in range(d)])


class Space:
    """Coordinates x0.., the side of the cells, and the parts of cells at every level."""

    def __init__(self, d: int, eps: float, varying: int):
        self.d, self.eps = d, eps
        self.side = eps / max(1, varying) ** 0.5 * (1 - 1e-9)
        self.xs = [f"x{i}" for i in range(d)]

    def key(self, level: int) -> Column:
        """The part of that level a location lies in; halving is exact, so parts of a part share its key."""
        return F.array(*[F.floor(F.col(x) / F.lit(self.side / 2 ** level)).cast("long") for x in self.xs])

    def boxes(self) -> list[Column]:
        return [F.min(x).alias(f"lo{i}") for i, x in enumerate(self.xs)] + [F.max(x).alias(f"hi{i}") for i, x in enumerate(self.xs)]

    def names(self, prefix: str = "") -> list[Column]:
        return [F.col(f"{e}{i}").alias(f"{prefix}{e}{i}") for e in ("lo", "hi") for i in range(self.d)]

    def parts(self, locs: DataFrame, wanted: DataFrame, level: int) -> DataFrame:
        """Parts (key, n locations, weight, box) of the ``wanted`` parts (of: their keys, of_n) of one level."""
        inside = locs.withColumn("of", self.key(level)).join(wanted, "of")
        key = F.when(F.col("of_n") <= FEW, F.array("loc")).otherwise(self.key(level + 1))
        return inside.groupBy("of", key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *self.boxes())


def locations(df: DataFrame, feats: Sequence[str], id_col: str) -> DataFrame:
    """loc (smallest id), x0.., w (number of rows) per distinct coordinate; rows with a NULL coordinate are left out."""
    xs = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)]
    return (df.select(F.col(id_col).alias("loc"), *xs).na.drop().groupBy(*[f"x{i}" for i in range(len(feats))])
            .agg(F.min("loc").alias("loc"), F.count(F.lit(1)).alias("w")))


def neighbour_cells(cells: DataFrame, space: Space, widths: list[float]) -> DataFrame:
    """(a, b, a's box, b's figures) of all cells whose boxes are at most eps apart, from a coarse grid on box centres."""
    dims = sorted(range(space.d), key=lambda i: -widths[i])[:GRID_DIMS]
    step = space.eps + space.side  # centres of boxes within eps of each other are at most this far apart
    spot = [F.floor((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 / F.lit(step)).cast("long") for i in dims]
    offsets = F.explode(F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=len(dims))]))
    a = cells.select(F.col("key").alias("a"), F.array(*spot).alias("at"), *space.names("a"), offsets.alias("off")).select(
        "a", *[f"a{e}{i}" for e in ("lo", "hi") for i in range(space.d)], F.zip_with("at", "off", lambda x, o: x + o).alias("at"))
    b = cells.withColumn("at", F.array(*spot)).withColumnRenamed("key", "b")
    return a.join(b, "at").drop("at").where(_between("alo", "ahi", "lo", "hi", space.d) <= space.eps)


def core_locations(locs: DataFrame, cells: DataFrame, near: DataFrame, space: Space, min_samples: int) -> DataFrame:
    """``locs`` (with their cell as ``key``) and is_core."""
    d, eps = space.d, space.eps
    rich = locs.join(cells.where(F.col("w") >= min_samples).select("key"), "key", "left_semi").withColumn("is_core", F.lit(True))
    poor = materialize(locs.join(cells.where(F.col("w") < min_samples).select("key"), "key", "left_semi"))
    done, sure = [rich], poor.select("loc", F.lit(0).cast("long").alias("sure"))
    front = poor.select("loc", *space.xs, F.col("key").alias("a")).join(
        near.select("a", F.col("b").alias("key"), "n", "w", *space.names()), "a").drop("a")
    level = 0
    while True:
        touched = materialize(front.where(_between("x", "x", "lo", "hi", d) <= eps).withColumn("whole", _across("x", "x", "lo", "hi", d) <= eps))
        sums = touched.groupBy("loc").agg(F.sum(F.when(F.col("whole"), F.col("w"))).alias("got"), F.sum("w").alias("most"))
        now = materialize(sure.join(sums, "loc", "left").select(
            "loc", (F.col("sure") + F.coalesce("got", F.lit(0))).alias("sure"), (F.col("sure") + F.coalesce("most", F.lit(0))).alias("most")))
        enough, open_ = F.col("sure") >= min_samples, (F.col("sure") < min_samples) & (F.col("most") >= min_samples)
        done.append(poor.join(now.where(~open_).select("loc", enough.alias("is_core")), "loc").select(*rich.columns))
        sure = now.where(open_).select("loc", "sure")
        between = materialize(touched.where(~F.col("whole")).join(sure.select("loc"), "loc", "left_semi").select(
            "loc", *space.xs, F.col("key").alias("of"), F.col("n").alias("of_n")))
        if between.isEmpty():
            break
        wanted = between.select("of", "of_n").distinct()
        front = between.drop("of_n").join(space.parts(locs.drop("key"), wanted, level), "of").drop("of")
        level += 1
    return materialize(reduce(lambda a, b: a.unionByName(b), done))


def _split(front: DataFrame, core: DataFrame, space: Space, side: str, level: int) -> DataFrame:
    """``front`` with the parts of one side (columns prefixed ``a`` or ``b``) instead of the part itself; a single
    location stays."""
    own = [f"{side}key", f"{side}n", *[f"{side}{e}{i}" for e in ("lo", "hi") for i in range(space.d)]]
    wanted = front.where(F.col(f"{side}n") > 1).select(F.col(f"{side}key").alias("of"), F.col(f"{side}n").alias("of_n")).distinct()
    parts = space.parts(core, wanted, level).select("of", F.col("key").alias(f"{side}key"), F.col("n").alias(f"{side}n"), *space.names(side))
    rest = [c for c in front.columns if c not in own]
    opened = front.where(F.col(f"{side}n") > 1).select(*rest, F.col(f"{side}key").alias("of")).join(parts, "of").select(*rest, *own)
    return opened.unionByName(front.where(F.col(f"{side}n") == 1).select(*rest, *own))


def core_components(core: DataFrame, cells: DataFrame, near: DataFrame, space: Space) -> DataFrame:
    """(key, comp): the component of every cell that holds core locations; comp is its smallest core id."""
    d, eps = space.d, space.eps
    held = materialize(core.groupBy("key").agg(F.min("loc").alias("cid"), F.count(F.lit(1)).alias("n"), *space.boxes()))
    side = lambda p, key: held.select(F.col("key").alias(key), F.col("cid").alias(f"{p}cid"), F.col("key").alias(f"{p}key"),
                                      F.col("n").alias(f"{p}n"), *space.names(p))
    front = near.select("a", "b").join(side("a", "a"), "a").join(side("b", "b"), "b").where("acid < bcid").drop("a", "b")
    comp = held.select("cid", F.col("cid").alias("comp"))
    level, edges = 0, None
    while True:
        hit = materialize(front.where(_between("alo", "ahi", "blo", "bhi", d) <= eps)
                          .withColumn("whole", _across("alo", "ahi", "blo", "bhi", d) <= eps))
        edges = hit.where("whole").select("acid", "bcid").distinct()
        rest = hit.where(~F.col("whole")).drop("whole")
        if not edges.isEmpty():
            merged = connected_components(edges, comp.select(F.col("comp").alias("cid")).distinct(), "acid", "bcid", "cid")
            merged = materialize(merged.select(F.col("cid").alias("comp"), F.col("component").alias("to")))
            comp = materialize(comp.join(merged, "comp").select("cid", F.col("to").alias("comp")))
            for p in "ab":
                rest = rest.join(merged.select(F.col("comp").alias(f"{p}cid"), F.col("to").alias(f"{p}to")), f"{p}cid").drop(f"{p}cid").withColumnRenamed(f"{p}to", f"{p}cid")
        rest = materialize(rest.where("acid <> bcid"))
        if rest.isEmpty():
            break
        bare = core.drop("key", "is_core")
        front = _split(_split(rest, bare, space, "a", level), bare, space, "b", level)
        level += 1
    return held.join(comp, "cid").select("key", "comp")


def border_labels(other: DataFrame, core: DataFrame, near: DataFrame, labels: DataFrame, space: Space) -> DataFrame:
    """(loc, cluster): the lowest cluster with a core location within eps, of the locations that have one."""
    d, eps = space.d, space.eps
    boxes = core.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *space.boxes()).join(labels, "key")
    front = other.select("loc", *space.xs, F.col("key").alias("a")).join(near.select("a", F.col("b").alias("key")), "a").drop("a").join(boxes, "key")
    bare, found, level = core.drop("key", "is_core"), [], 0
    while True:
        touched = materialize(front.where(_between("x", "x", "lo", "hi", d) <= eps).withColumn("whole", _across("x", "x", "lo", "hi", d) <= eps))
        best = materialize(touched.where("whole").groupBy("loc").agg(F.min("cluster").alias("cluster")))
        found.append(best)
        known = best.withColumnRenamed("cluster", "known")
        between = materialize(touched.where(~F.col("whole")).join(known, "loc", "left").where("known is null or cluster < known").select(
            "loc", *space.xs, "cluster", F.col("key").alias("of"), F.col("n").alias("of_n")))
        if between.isEmpty():
            break
        wanted = between.select("of", "of_n").distinct()
        front = between.drop("of_n").join(space.parts(bare, wanted, level).drop("w"), "of").drop("of")
        level += 1
    return reduce(lambda a, b: a.unionByName(b), found).groupBy("loc").agg(F.min("cluster").alias("cluster"))


def dbscan(df: DataFrame, feats: Sequence[str], id_col: str = "row_id", eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``df`` with is_core and ``cluster``: its number in order of the clusters' smallest core ids (0, 1, ...);
    border points take the lowest-numbered cluster among their core neighbours, noise is -1.

    ``id_col`` is a numeric row id giving the visiting order. Rows with a NULL coordinate are noise.
    """
    feats = list(feats)
    d = len(feats)
    locs = materialize(locations(df, feats, id_col))
    ends = locs.agg(*[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)]).first()  # one row
    widths = [(ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0) for i in range(d)]
    space = Space(d, eps, sum(w > 0 for w in widths))
    locs = locs.withColumn("key", space.key(0)).select("loc", *space.xs, "w", "key")
    cells = materialize(locs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *space.boxes()))
    near = materialize(neighbour_cells(cells, space, widths))
    all_ = core_locations(locs, cells, near, space, min_samples)
    core = all_.where("is_core")
    comp = materialize(core_components(core, cells, near, space))
    number = number_rows(comp.select("comp").distinct(), ["comp"], "_no")
    labels = materialize(comp.join(number, "comp").select("key", (F.col("_no") - 1).cast("int").alias("cluster")))
    own = core.join(labels, "key").select("loc", "cluster")
    border = border_labels(all_.where(~F.col("is_core")), core, near, labels, space)
    named = all_.join(own.unionByName(border), "loc", "left").select(
        *[F.col(x).alias(f"_{x}") for x in space.xs], "is_core", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    same = reduce(lambda a, b: a & b, [F.col(f).cast("double") == F.col(f"_{x}") for f, x in zip(feats, space.xs)])
    out = df.join(named, same, "left").drop(*[f"_{x}" for x in space.xs])
    return out.withColumn("is_core", F.coalesce("is_core", F.lit(False))).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
