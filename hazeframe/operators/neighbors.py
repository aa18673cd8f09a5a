"""Exact Euclidean neighbour joins without all-pairs products.

``knn_join``   k nearest neighbours over adaptive cells. Equal coordinates are one location with its smallest
               ids. Locations are split recursively at sampled quantiles of each cell's widest
               coordinate until a leaf holds at most ``LEAF`` of them (in dense and thin regions alike),
               every query takes a radius from its own leaf, and the tree is walked from the root for
               all leaves at once, dropping pairs of boxes that lie farther apart than the radius.
               Leaves travel as one row each; a pair of leaves is one block of distances (NumPy in the
               tasks). Ties at equal distance: smaller neighbour id first.
``range_join`` every pair within ``eps`` (grid of side eps, one round, exact).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.operators.sequence import materialize

LEAF = 1024  # locations of a leaf, at most
BITS = 5  # bits of a cell id per level: up to 16 parts and the middle
MAX_LEVELS = 12


def _dist(feats: Sequence[str], a: str = "q_", b: str = "p_"):
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(a + f) - F.col(b + f), 2) for f in feats]))


def _cells(feats: Sequence[str], prefix: str, r):
    return [F.floor(F.col(prefix + f) / r).cast("long") for f in feats]


def _offsets(d: int):
    return F.array(*[F.array(*[F.lit(x) for x in off]) for off in itertools.product((-1, 0, 1), repeat=d)])


def _prefixed(df: DataFrame, ids: Sequence[str], feats: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in ids],
                     *[F.col(f).cast("double").alias(prefix + f) for f in feats if f not in ids])


def _candidates(q: DataFrame, p: DataFrame, feats, gdims, r: float) -> DataFrame:
    """Query rows x point rows sharing a neighbouring cell (each pair once). A neighbouring cell
    whose nearest face is farther than ``r`` from the query cannot hold a point within ``r`` and is
    skipped (about 40 % of the 3^d cells for d = 4)."""
    d = len(gdims)
    qc = q.select("*", F.array(*_cells(gdims, "q_", r)).alias("_qc"))
    qe = qc.select("*", F.explode(_offsets(d)).alias("_off"))
    gaps = []
    for i, f in enumerate(gdims):
        lo = F.col("_qc")[i] * F.lit(r)
        o = F.col("_off")[i]
        gaps.append(F.when(o == -1, F.col("q_" + f) - lo)
                     .when(o == 1, lo + F.lit(r) - F.col("q_" + f)).otherwise(F.lit(0.0)))
    near = reduce(lambda a, b: a + b, [g * g for g in gaps]) <= F.lit(r * r * (1 + 1e-9))
    qe = (qe.where(near)
            .select("*", *[(F.col("_qc")[i] + F.col("_off")[i]).alias(f"_c{i}") for i in range(d)])
            .drop("_qc", "_off"))
    pc = p.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(_cells(gdims, "p_", r))])
    return qe.join(pc, [f"_c{i}" for i in range(d)], "inner").drop(*[f"_c{i}" for i in range(d)])


# ---- k nearest neighbours: adaptive cells --------------------------------------------------------

def _x(feats: Sequence[str]) -> list[str]:
    return [f"x{i}" for i in range(len(feats))]


def _sq(terms):
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _box(d: int, prefix: str = "") -> list[str]:
    return [f"{prefix}lo{i}" for i in range(d)] + [f"{prefix}hi{i}" for i in range(d)]


def _gap(d: int, lo: str, hi: str, box: str = ""):
    """Distance of the range [lo_i, hi_i] (columns by prefix) to the box, 0 where they meet."""
    return F.sqrt(_sq([F.greatest(F.lit(0.0), F.col(f"{box}lo{i}") - F.col(f"{hi}{i}"), F.col(f"{lo}{i}") - F.col(f"{box}hi{i}"))
                       for i in range(d)]))


def _reach(d: int, x: str = "x", box: str = ""):
    """Distance of a point to the farthest corner of the box."""
    return F.sqrt(_sq([F.greatest(F.abs(F.col(f"{x}{i}") - F.col(f"{box}lo{i}")), F.abs(F.col(f"{x}{i}") - F.col(f"{box}hi{i}"))) for i in range(d)]))


def locations(queries: DataFrame, points: DataFrame, feats: Sequence[str], p_ids: Sequence[str], keep: int) -> DataFrame:
    """A row per distinct coordinate of queries and points: loc, x0.., ids (its ``keep`` smallest point ids), m (their
    number), is_query. Equal points beyond ``keep`` can't be among the ``keep`` nearest of anything."""
    xs = _x(feats)
    coords = [F.col(f).cast("double").alias(x) for f, x in zip(feats, xs)]
    pts = points.select(F.struct(*[F.col(c).alias(f"p_{c}") for c in p_ids]).alias("id"), *coords)
    # a row_number limit is applied map-side first, so a coordinate that holds most rows moves few of them
    first = pts.withColumn("at", F.row_number().over(Window.partitionBy(*xs).orderBy("id"))).where(F.col("at") <= keep)
    both = first.select(*xs, "id", F.lit(False).alias("is_query")).unionByName(
        queries.select(*coords).distinct().select(*xs, F.lit(None).cast(first.schema["id"].dataType).alias("id"), F.lit(True).alias("is_query")))
    locs = both.groupBy(*xs).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("is_query").alias("is_query"))
    return locs.select(F.monotonically_increasing_id().alias("loc"), *xs, "ids", F.size("ids").alias("m"), "is_query")


def split_cells(locs: DataFrame, d: int, leaf: int) -> tuple[DataFrame, int]:
    """``locs`` with ``cell``: recursive splits at sampled quantiles of each cell's widest coordinate, and the depth.

    Each round splits every cell of more than ``leaf`` locations into 2 to 16 parts; the middle of the range
    is a split as well, so a cell with two distinct values always falls apart. Cell ids hold ``BITS`` bits a
    level: the ancestor of a leaf is its id shifted to the right.
    """
    xs = [f"x{i}" for i in range(d)]
    now, done, level = materialize(locs.withColumn("cell", F.lit(0).cast("long"))), [], 0
    while True:
        stats = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)],
                                        *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)])
        widest = F.greatest(*[F.struct((F.col(f"hi{i}") - F.col(f"lo{i}")).alias("w"), F.lit(i).alias("i"), F.col(f"lo{i}").alias("lo"),
                                       F.col(f"hi{i}").alias("hi")) for i in range(d)]) if d > 1 else F.struct(
            (F.col("hi0") - F.col("lo0")).alias("w"), F.lit(0).alias("i"), F.col("lo0").alias("lo"), F.col("hi0").alias("hi"))
        open_ = materialize(stats.withColumn("s", widest).where((F.col("n") > leaf) & (F.col("s.w") > 0)).select(
            F.col("cell").alias("of"), F.col("s.i").alias("dim"), (F.col("s.lo") / 2 + F.col("s.hi") / 2).alias("mid"), F.col("s.lo").alias("lo"),
            F.col("s.hi").alias("hi"), F.pow(2, F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / leaf))))).cast("int").alias("parts")))
        if open_.isEmpty() or level == MAX_LEVELS:
            done.append((now, level))
            break
        dealt = now.join(open_, F.col("cell") == F.col("of"), "left").withColumn("v", F.get(F.array(*xs), F.col("dim")))
        done.append((dealt.where("of is null").select(*now.columns), level))
        dealt = dealt.where("of is not null")
        grid = F.percentile_approx("v", [i / 16 for i in range(1, 16)], 1000)
        cuts = dealt.groupBy("of").agg(grid.alias("grid"), F.first("parts").alias("parts"), F.first("mid").alias("mid"), F.first("lo").alias("lo"),
                                       F.first("hi").alias("hi"))
        step = (F.lit(16) / F.col("parts")).cast("int")
        mid = F.when(F.col("mid") < F.col("hi"), F.col("mid")).otherwise(F.col("lo"))
        cuts = cuts.select(F.col("of").alias("at"), F.array_append(F.filter("grid", lambda g, i: (i + 1) % step == 0), mid).alias("cuts"))
        child = F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("v") > c).cast("int"))
        now = materialize(dealt.join(cuts, F.col("of") == F.col("at")).select(
            *[c for c in now.columns if c != "cell"], (F.shiftleft("cell", BITS) + child).cast("long").alias("cell")))
        level += 1
    parts = [p.withColumn("cell", F.shiftleft("cell", BITS * (level - at))) for p, at in done]
    return reduce(lambda a, b: a.unionByName(b), parts), level


def _nodes(leaves: DataFrame, d: int, level: int, depth: int, more) -> DataFrame:
    """Boxes of the nodes of one level (and ``more`` aggregates) from the table of leaves."""
    node = F.shiftright("cell", BITS * (depth - level))
    return leaves.groupBy(node.alias("node")).agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)], *more)


def _packed(locs: DataFrame, d: int, more: list[str], stats) -> DataFrame:
    """A row per leaf: cell, its box, ``stats``, and its locations (at most a leaf's) as an array."""
    held = F.collect_list(F.struct("loc", *[f"x{i}" for i in range(d)], *more)).alias("rows")
    return locs.groupBy("cell").agg(*[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)], *stats, held)


def _coords(rows: pa.Array, d: int) -> np.ndarray:
    flat = rows.flatten()
    return np.stack([flat.field(f"x{i}").to_numpy(zero_copy_only=False) for i in range(d)], 1)


def _squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product (a few units in the last places of the largest coordinate off)."""
    return (q * q).sum(1)[:, None] - 2 * q @ p.T + (p * p).sum(1)[None, :]


def _slack(q: np.ndarray, p: np.ndarray) -> float:
    return 1e-12 * (float((q * q).sum(1).max(initial=0.0)) + float((p * p).sum(1).max(initial=0.0))) + 1e-300


def _bounded(asking: DataFrame, q_packed: DataFrame, p_packed: DataFrame, leaves: DataFrame, d: int, depth: int, keep: int) -> DataFrame:
    """``asking`` with r: no smaller than the distance of its ``keep``-th nearest point id.

    From the locations of its own cell, or, where the cell has too few, from the farthest corner of the
    smallest ancestor that has enough.
    """
    own = q_packed.select("cell", F.col("rows").alias("q")).join(p_packed.select("cell", F.col("rows").alias("p")), "cell").select("q", "p")

    def kth(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                q_rows, p_rows = rb.column(0).slice(k, 1), rb.column(1).slice(k, 1)
                q, p = _coords(q_rows, d), _coords(p_rows, d)
                if len(p) < keep:
                    continue
                near = np.partition(_squares(q, p), keep - 1, axis=1)[:, keep - 1]
                r = np.sqrt(np.maximum(near, 0.0) + _slack(q, p)) * (1 + 1e-12)
                yield pa.RecordBatch.from_arrays([q_rows.flatten().field("loc"), pa.array(r)], names=["loc", "r"])

    near = own.mapInArrow(kth, "loc long, r double")
    got = materialize(asking.join(near, "loc", "left").withColumn("r", F.when(F.col("m") >= keep, F.lit(0.0)).otherwise(F.col("r"))))
    short = got.where("r is null").drop("r")
    if short.isEmpty():
        return got
    rich = [_nodes(leaves, d, lv, depth, [F.sum("ids_held").alias("held")]).where(F.col("held") >= keep).withColumn("level", F.lit(lv))
            for lv in range(depth + 1)]
    rich = reduce(lambda a, b: a.unionByName(b), rich)
    levels = short.withColumn("level", F.explode(F.array(*[F.lit(lv) for lv in range(depth + 1)])))
    levels = levels.withColumn("node", reduce(lambda e, lv: F.when(F.col("level") == lv, F.shiftright("cell", BITS * (depth - lv))).otherwise(e),
                                              range(depth), F.col("cell")))
    far = levels.join(rich, ["level", "node"]).groupBy("loc").agg(F.min(_reach(d)).alias("r"))
    loose = short.join(far, "loc", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    return materialize(got.where("r is not null").unionByName(loose.select(*got.columns)))


def leaf_pairs(queries: DataFrame, points: DataFrame, keep: int, feats: Sequence[str], p_ids: Sequence[str],
               leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query leaves, point leaves, pairs): packed leaves (cell, box, rows; queries with their radius r) and the pairs (a, b)
    of a query leaf and a point leaf that may hold one of the ``keep`` nearest points of a query."""
    d = len(feats)
    cells, depth = split_cells(locations(queries, points, feats, p_ids, keep), d, max(leaf, 3 * keep))
    cells = materialize(cells)
    p_packed = materialize(_packed(cells.where("m > 0"), d, ["ids"], [F.sum("m").alias("ids_held"), F.count(F.lit(1)).alias("n")]))
    leaves = p_packed.drop("rows")
    asking = cells.where("is_query").select("loc", "cell", *_x(feats), "m")
    asking = _bounded(asking, _packed(asking, d, [], []), p_packed, leaves, d, depth, keep)
    q_packed = materialize(_packed(asking, d, ["r"], [F.max("r").alias("r"), F.count(F.lit(1)).alias("n")]))
    q_leaves = q_packed.drop("rows")
    # both trees from the root: node pairs whose boxes are farther apart than the largest radius drop out
    pairs = _nodes(q_leaves, d, 0, depth, []).select(F.col("node").alias("a")).join(
        _nodes(leaves, d, 0, depth, []).select(F.col("node").alias("b")), F.lit(True))  # one row each
    for level in range(1, depth + 1):
        qn = _nodes(q_leaves, d, level, depth, [F.max("r").alias("r")])
        qn = qn.select(F.shiftright("node", BITS).alias("a"), F.col("node").alias("a1"), "r", *[F.col(c).alias(f"q{c}") for c in _box(d)])
        pn = _nodes(leaves, d, level, depth, []).select(F.shiftright("node", BITS).alias("b"), F.col("node").alias("b1"), *_box(d))
        pairs = pairs.join(qn, "a").join(pn, "b").where(_gap(d, "qlo", "qhi") <= F.col("r")).select(F.col("a1").alias("a"), F.col("b1").alias("b"))
        if level % 2 == 0 or level == depth:
            pairs = materialize(pairs)
    return q_packed, p_packed, pairs


def nearest_locations(q_packed: DataFrame, p_packed: DataFrame, pairs: DataFrame, d: int, keep: int) -> DataFrame:
    """loc, dist, ids: for each query location the point locations that can be among its ``keep`` nearest ids, from
    each pair of leaves those no farther than its ``keep``-th there (to 9 decimals, so ties stay)."""
    both = pairs.join(q_packed.select(F.col("cell").alias("a"), F.col("rows").alias("q")), "a").join(
        p_packed.select(F.col("cell").alias("b"), F.col("rows").alias("p")), "b").select("q", "p")
    schema = both.select(F.explode("p").alias("p")).select(F.col("p.loc").alias("loc"), F.col("p.x0").alias("dist"), F.col("p.ids").alias("ids")).schema

    def near(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                q_rows, p_rows = rb.column(0).slice(k, 1), rb.column(1).slice(k, 1)
                q, p = _coords(q_rows, d), _coords(p_rows, d)
                r = q_rows.flatten().field("r").to_numpy(zero_copy_only=False)
                ids, loc = p_rows.flatten().field("ids"), q_rows.flatten().field("loc")
                limit = (r + 2e-9) ** 2 * (1 + 1e-9) + _slack(q, p)
                for lo in range(0, len(q), 1024):
                    part = q[lo:lo + 1024]
                    i, j = np.nonzero(_squares(part, p) <= limit[lo:lo + 1024, None])
                    dist = np.sqrt(((part[i] - p[j]) ** 2).sum(1))
                    ok = dist <= r[lo + i] + 2e-9
                    i, j, dist = i[ok], j[ok], dist[ok]
                    tie = np.round(dist, 9)
                    order = np.lexsort((tie, i))
                    i, j, dist, tie = i[order], j[order], dist[order], tie[order]
                    first = np.searchsorted(i, i)  # where the query's rows start
                    last = np.minimum(first + keep, np.searchsorted(i, i, side="right")) - 1
                    ok = tie <= tie[last]
                    i, j, dist = i[ok], j[ok], dist[ok]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([loc.take(pa.array(lo + i)), pa.array(dist), ids.take(pa.array(j))], names=["loc", "dist", "ids"])

    return both.mapInArrow(near, schema)


def knn_join(queries: DataFrame, points: DataFrame, k: int, feats: Sequence[str], q_ids: Sequence[str],
             p_ids: Sequence[str], exclude_self: bool = False, leaf: int = LEAF) -> DataFrame:
    """Exact k nearest ``points`` of every query row: (q_<ids>, p_<ids>, dist, nn_rank).

    ``exclude_self`` drops pairs whose ids are equal (self-join use). Feature columns must be
    numeric without NULLs. Distances equal to 9 decimals count as ties and are broken by the neighbour id,
    so that last-bit differences of the inputs cannot reorder neighbours.
    """
    feats, q_ids, p_ids = list(feats), list(q_ids), list(p_ids)
    d, keep = len(feats), k + bool(exclude_self)
    q = materialize(_prefixed(queries, q_ids, feats, "q_"))
    p = materialize(_prefixed(points, p_ids, feats, "p_"))
    plain = lambda df, t, ids: df.select(*[F.col(f"{t}{c}").alias(c) for c in dict.fromkeys([*ids, *feats])])
    q_packed, p_packed, pairs = leaf_pairs(plain(q, "q_", q_ids), plain(p, "p_", p_ids), keep, feats, p_ids, leaf)
    each = nearest_locations(q_packed, p_packed, pairs, d, keep).select("loc", "dist", F.explode("ids").alias("id"))
    first = Window.partitionBy("loc").orderBy(F.round("dist", 9), "id")
    each = each.withColumn("nn_rank", F.row_number().over(first)).where(F.col("nn_rank") <= keep)
    found = each.groupBy("loc").agg(F.sort_array(F.collect_list(F.struct("nn_rank", "id", "dist"))).alias("nn"))  # ``keep`` entries
    qx = [f"x{i}" for i in range(d)]
    spots = q_packed.select(F.inline("rows")).select("loc", *qx)
    rows = q.join(found.join(spots, "loc").drop("loc"), [F.col(f"q_{f}") == F.col(x) for f, x in zip(feats, qx)])
    nn = F.col("nn")
    if exclude_self:
        nn = F.slice(F.filter(nn, lambda e: ~reduce(lambda a, b: a & b, [F.col(f"q_{a}") == e["id"][f"p_{b}"] for a, b in zip(q_ids, p_ids)])), 1, k)
    rows = rows.select(*[f"q_{c}" for c in q_ids], F.posexplode(nn).alias("at", "e"))
    return rows.select(*[f"q_{c}" for c in q_ids], *[F.col(f"e.id.p_{c}").alias(f"p_{c}") for c in p_ids], F.col("e.dist").alias("dist"),
                       (F.col("at") + 1).alias("nn_rank"))


def range_join(df: DataFrame, eps: float, feats: Sequence[str], ids: Sequence[str],
               grid_dims: Sequence[str] | None = None, queries: DataFrame | None = None,
               q_ids: Sequence[str] | None = None) -> DataFrame:
    """Every ordered pair (including self) at Euclidean distance <= eps: (q_<ids>, p_<ids>, dist).

    With ``queries`` (and their ``q_ids``), pairs of a query row and a row of ``df``.
    """
    feats, ids = list(feats), list(ids)
    gdims = list(grid_dims) if grid_dims else feats
    q_ids = list(q_ids) if q_ids is not None else ids
    q = _prefixed(df if queries is None else queries, q_ids, feats, "q_")
    p = _prefixed(df, ids, feats, "p_")
    cand = _candidates(q, p, feats, gdims, eps)
    return (cand.select(*[f"q_{c}" for c in q_ids], *[f"p_{c}" for c in ids], _dist(feats).alias("dist"))
                .where(F.col("dist") <= eps))
