"""K-means of many k and many restarts at once.

Every pass over the rows serves all fits that are still moving: a pass takes each row's nearest centre in
every fit and adds up counts, sums and squared errors per (fit, cluster) inside the tasks; Spark sums those
few rows. The number of passes is that of the slowest fit, whatever the number of fits.

Starts are k-means||: per restart, rounds of ``OVERSAMPLE`` rows drawn by their squared distance to the
rows drawn before (one pass a round for all restarts; exponential races, so no total is needed first), weighted
by the rows nearest to each, from which weighted k-means++ picks the k starts. The driver holds
centres and drawn rows only; their number depends on k and the restarts, not on the data.

Distances of a row to hundreds of centres are one matrix product in NumPy inside the tasks; the
labels of one fit (``nearest``) are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.operators.sequence import materialize

MAX_ITER = 300
TOLERANCE = 1e-4  # of the mean column variance, against the squared movement of all centres
ROUNDS = 5
OVERSAMPLE = 20
SEED = 42


def vectors(df: DataFrame, feats: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """h (a hash that identifies the row), x0..: what the passes read, pinned. Rows with a NULL feature are left out."""
    xs = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)]
    return materialize(df.select(F.xxhash64(*(ids or df.columns)).alias("h"), *xs).na.drop(subset=[f"x{i}" for i in range(len(feats))]))


def _matrix(rb: pa.RecordBatch, d: int) -> np.ndarray:
    return np.stack([rb.column(rb.schema.get_field_index(f"x{i}")).to_numpy(zero_copy_only=False) for i in range(d)], 1)


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform (0, 1) numbers from row hashes."""
    z = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            z = z + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


def starts(points: DataFrame, d: int, ks: Sequence[int], n_init: int, seed: int = SEED, rounds: int = ROUNDS,
           oversample: int = OVERSAMPLE) -> list[tuple[int, np.ndarray]]:
    """(k, start centres) for every k and restart."""
    take = max(oversample, 2 * max(ks))
    drawn: list[np.ndarray] = [np.zeros((0, d)) for _ in range(n_init)]
    schema = "fit int, race double, " + ", ".join(f"x{i} double" for i in range(d))
    for t in range(rounds + 1):
        have = list(drawn)
        n_take = 1 if t == 0 else take

        def race(batches, have=have, t=t, n_take=n_take):
            best = [(np.zeros(0), np.zeros((0, d))) for _ in have]
            for rb in batches:
                x, h = _matrix(rb, d), rb.column(0).to_numpy()
                for r, c in enumerate(have):
                    e = -np.log(_uniform(h, seed, r, t))
                    with np.errstate(divide="ignore"):
                        key = e if not len(c) else e / _squared(x, c).min(1)
                    ok = np.flatnonzero(np.isfinite(key))
                    key, xr = np.concatenate((best[r][0], key[ok])), np.concatenate((best[r][1], x[ok]))
                    top = np.argsort(key, kind="stable")[:n_take]
                    best[r] = key[top], xr[top]
            fit = np.repeat(np.arange(len(have), dtype=np.int32), [len(k) for k, _ in best])
            if len(fit):
                x = np.concatenate([x for _, x in best])
                yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(np.concatenate([k for k, _ in best])),
                                                  *[pa.array(x[:, i]) for i in range(d)]], names=["fit", "race", *[f"x{i}" for i in range(d)]])

        won = points.mapInArrow(race, schema)
        won = won.withColumn("at", F.row_number().over(Window.partitionBy("fit").orderBy("race", *[f"x{i}" for i in range(d)]))).where(F.col("at") <= n_take)
        for row in won.orderBy("fit", "at").collect():  # n_init x take rows
            drawn[row["fit"]] = np.concatenate((drawn[row["fit"]], [[row[f"x{i}"] for i in range(d)]]))
    drawn = [np.unique(c, axis=0) for c in drawn]
    held = sums(points, d, drawn)
    out = []
    for k in ks:
        for r, c in enumerate(drawn):
            out.append((k, _plus_plus(c, held[r][:, 0], k, np.random.default_rng([seed, k, r]))))
    return out


def _plus_plus(c: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over the drawn rows."""
    if len(c) <= k:
        return c
    at = [int(rng.choice(len(c), p=w / w.sum()))]
    while len(at) < k:
        far = w * _squared(c, c[at]).min(1)
        if far.sum() <= 0:
            at.append(next(i for i in range(len(c)) if i not in at))
        else:
            at.append(int(rng.choice(len(c), p=far / far.sum())))
    return c[at]


def sums(points: DataFrame, d: int, fits: list[np.ndarray]) -> list[np.ndarray]:
    """One pass: per fit an array (cluster, [count, squared error, sums of x0..])."""
    width = 2 + d
    all_c = np.concatenate(fits)
    off = np.concatenate(([0], np.cumsum([len(c) for c in fits])))

    def add(batches):
        acc = np.zeros((len(all_c), width))
        for rb in batches:
            x = _matrix(rb, d)
            for lo in range(0, len(x), 8192):
                part = x[lo:lo + 8192]
                dist = _squared(part, all_c)
                for f in range(len(fits)):
                    s, e = off[f], off[f + 1]
                    if s == e:
                        continue
                    lab = dist[:, s:e].argmin(1)
                    acc[s:e, 0] += np.bincount(lab, minlength=e - s)
                    acc[s:e, 1] += np.bincount(lab, dist[np.arange(len(part)), s + lab], e - s)
                    for i in range(d):
                        acc[s:e, 2 + i] += np.bincount(lab, part[:, i], e - s)
        at = np.flatnonzero(acc[:, 0] > 0)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(acc[at, i]) for i in range(width)]],
                                             names=["c", *[f"v{i}" for i in range(width)]])

    schema = "c int, " + ", ".join(f"v{i} double" for i in range(width))
    got = points.mapInArrow(add, schema).groupBy("c").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])
    out = np.zeros((len(all_c), width))
    for row in got.collect():  # a row a centre
        out[row["c"]] = [row[f"v{i}"] for i in range(width)]
    return [out[off[f]:off[f + 1]] for f in range(len(fits))]


def lloyd(points: DataFrame, d: int, begin: list[np.ndarray], max_iter: int = MAX_ITER,
          tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centres, (count, squared error, sums) per cluster) of every fit, moved until each has settled.

    A cluster without rows keeps its centre.
    """
    spread = points.agg(*[F.var_pop(f"x{i}").alias(f"x{i}") for i in range(d)]).first()  # one row
    limit = tolerance * float(np.mean([v or 0.0 for v in spread]))
    centres = [c.copy() for c in begin]
    moving = {f: max_iter for f in range(len(begin))}  # steps left
    out: list = [None] * len(begin)
    while moving:
        order = sorted(moving)
        for f, s in zip(order, sums(points, d, [centres[f] for f in order])):
            out[f] = (centres[f], s)
            if moving[f] == 0:
                del moving[f]
                continue
            new = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1), centres[f])
            moved = float(((new - centres[f]) ** 2).sum())
            centres[f] = new
            moving[f] = 0 if moved <= limit else moving[f] - 1
    return out


def fit(points: DataFrame, d: int, ks: Sequence[int], n_init: int, seed: int = SEED) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per k the centres and cluster sums of the restart with the least squared error (the first of equals)."""
    begin = starts(points, d, list(ks), n_init, seed)
    best: dict[int, tuple] = {}
    for (k, _), got in zip(begin, lloyd(points, d, [c for _, c in begin])):
        if k not in best or got[1][:, 1].sum() < best[k][1][:, 1].sum():
            best[k] = got
    return best


def nearest(feats: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre (the first of equals); NULL where a feature is."""
    each = [F.struct(reduce(lambda a, b: a + b, [(F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(feats, c)]).alias("d"),
                     F.lit(i).alias("i")) for i, c in enumerate(centres)]
    best = F.least(*each) if len(each) > 1 else each[0]
    return F.when(best["d"].isNotNull(), best["i"]).cast("int")


def squared_silhouettes(points: DataFrame, d: int, fits: list[tuple[np.ndarray, np.ndarray]]) -> list[float | None]:
    """Mean silhouette of squared distances of every fit, in one pass, from the cluster sums."""
    centres = [c for c, _ in fits]
    clusters, place, inner = [], [], []
    for c, s in fits:  # mean squared distance to a cluster = squared distance to its mean + its mean squared error around it
        has = s[:, 0] > 0
        m = s[has, 2:] / s[has, :1]
        clusters.append((m, s[has, 0]))
        place.append(np.cumsum(has) - 1)
        inner.append(s[has, 1] / s[has, 0] - ((m - c[has]) ** 2).sum(1))

    def score(batches):
        acc = np.zeros((len(clusters), 2))
        for rb in batches:
            x = _matrix(rb, d)
            for f, (m, n) in enumerate(clusters):
                if len(n) < 2:
                    continue
                dist = _squared(x, m) + inner[f][None, :]
                lab = place[f][_squared(x, centres[f]).argmin(1)]
                rows = np.arange(len(x))
                own = dist[rows, lab] * n[lab] / np.maximum(n[lab] - 1, 1)
                dist[rows, lab] = np.inf
                other = dist.min(1)
                top = np.maximum(own, other)
                with np.errstate(invalid="ignore"):
                    s = np.where((n[lab] == 1) | (top == 0), 0.0, (other - own) / top)
                acc[f] += s.sum(), len(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(clusters), dtype=np.int32)), pa.array(acc[:, 0]), pa.array(acc[:, 1])], names=["f", "s", "n"])

    got = {r["f"]: r for r in points.mapInArrow(score, "f int, s double, n double").groupBy("f").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [got[f]["s"] / got[f]["n"] if f in got and got[f]["n"] else None for f in range(len(fits))]
