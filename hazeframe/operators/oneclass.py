"""One-class SVM with an RBF kernel, solved to a measured duality gap.

Rows are mapped to features whose products approximate the kernel (Nystrom: ``LANDMARKS`` sampled rows; exact
when every row is one). In that space the one-class SVM is the shortest vector w among all averages of the
rows in which no row weighs more than 1 / (nu n). The solver keeps corners of that set:

1. a pass finds the average of the ``nu`` share of rows with the lowest score w.x (a score histogram first, so that
   the rows at the limit get the weight that is left);
2. the shortest vector among all corners found so far is a problem of their number, solved on the driver.

``|w|^2 - w.corner`` bounds the distance to the optimum; passes go on until it is below ``GAP`` of ``|w|^2``.
Rows scoring below the ``nu`` quantile are flagged. Feature products are NumPy inside the tasks; the driver holds
landmarks and corners, whose number does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeframe.operators.sequence import materialize
from hazeframe.operators.stats import key_quantiles

NU = 0.05
LANDMARKS = 256
GAP = 1e-3
MAX_PASSES = 200
BINS = 1 << 16
SEED = 42


class Kernel:
    """Row features of the RBF kernel around landmarks."""

    def __init__(self, marks: np.ndarray, gamma: float):
        self.marks, self.gamma = marks, gamma
        values, vectors = np.linalg.eigh(self.against(marks))
        keep = values > 1e-10 * max(float(values.max()), 1e-300)
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def against(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] - 2 * x @ self.marks.T + (self.marks * self.marks).sum(1)[None, :]
        return np.exp(-self.gamma * np.maximum(d, 0.0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.against(x) @ self.root


def _blocks(rb: pa.RecordBatch, names: Sequence[str], size: int = 4096):
    x = np.stack([rb.column(rb.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
    for lo in range(0, len(x), size):
        yield x[lo:lo + size]


def _bins(score: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((score - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)


def _limit(points: DataFrame, names: list[str], kernel: Kernel, w: np.ndarray, low: float, high: float, most: float) -> tuple[int, float]:
    """(bin, share of its rows) at which the lowest-scoring rows are used up."""

    def count(batches):
        acc = np.zeros(BINS, np.int64)
        for rb in batches:
            for x in _blocks(rb, names):
                acc += np.bincount(_bins(kernel.features(x) @ w, low, high), minlength=BINS)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["bin", "n"])

    rows = points.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()  # at most BINS rows
    before = 0
    for r in rows:
        if before + r["n"] >= most - 1e-9:
            return r["bin"], (most - before) / r["n"]
        before += r["n"]
    return BINS, 0.0


def _average(points: DataFrame, names: list[str], kernel: Kernel, w: np.ndarray | None, low: float, high: float, at: tuple[int, float],
             most: float) -> np.ndarray:
    """The weighted average of the features of the rows below the limit (all rows without w)."""
    m = kernel.root.shape[1]

    def add(batches):
        acc = np.zeros(m)
        for rb in batches:
            for x in _blocks(rb, names):
                z = kernel.features(x)
                if w is None:
                    acc += z.sum(0)
                else:
                    b = _bins(z @ w, low, high)
                    acc += z[b < at[0]].sum(0) + at[1] * z[b == at[0]].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(acc)], names=["i", "v"])

    got = points.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row a feature
    out = np.zeros(m)
    for r in got:
        out[r["i"]] = r["v"]
    return out / most


def shortest(corners: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """Weights (non-negative, adding up to 1) of the corners whose average is the shortest vector: accelerated projected gradient."""
    g = corners @ corners.T
    n = len(g)
    a = np.full(n, 1.0 / n)
    y, t = a.copy(), 1.0
    rate = 1.0 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-300)
    for _ in range(steps):
        z = y - rate * (g @ y)
        u = np.sort(z)[::-1]
        c = np.cumsum(u) - 1
        k = np.flatnonzero(u - c / np.arange(1, n + 1) > 0)[-1]
        new = np.maximum(z - c[k] / (k + 1), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - a)
        if (y - new) @ (new - a) < 0:
            y, t2 = new.copy(), 1.0
        done = np.abs(new - a).max() < 1e-14
        a, t = new, t2
        if done:
            break
    return a


def oneclass_scores(df: DataFrame, feats: Sequence[str], nu: float = NU, landmarks: int = LANDMARKS, gap: float = GAP,
                    seed: int = SEED, out: str = "score") -> tuple[DataFrame, float]:
    """(``df`` with ``out`` = w.x, relative duality gap reached). Rows with a NULL feature score NULL."""
    feats, d = list(feats), len(feats)
    xs = [f"x{i}" for i in range(d)]
    kept = df.columns
    points = materialize(df.select(*kept, *[F.col(f).cast("double").alias(x) for f, x in zip(feats, xs)]))
    full = points.select(*xs).na.drop()
    # gamma = 1 / (features * variance of all entries)
    st = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{x}") for x in xs], *[F.avg(F.col(x) * F.col(x)).alias(f"q{x}") for x in xs]).first()
    n = st["n"]
    if not n:
        return df.withColumn(out, F.lit(None).cast("double")), 0.0
    mean = sum(st[f"m{x}"] for x in xs) / d
    var = sum(st[f"q{x}"] for x in xs) / d - mean ** 2
    gamma = 1.0 / (d * var) if var > 0 else 1.0
    marks = full.distinct().orderBy(F.xxhash64(*xs, F.lit(seed)), *xs).limit(landmarks).collect()  # at most ``landmarks`` rows
    kernel = Kernel(np.array([list(r) for r in marks], float), gamma)
    most = max(nu * n, 1.0)
    corners = [_average(full, xs, kernel, None, 0, 0, (0, 0.0), float(n))]
    w, reached = corners[0], float("inf")
    for _ in range(MAX_PASSES):
        # scores lie within the longest feature vector (kernel: length 1) times |w|
        reach = 1.0001 * float(np.linalg.norm(w)) + 1e-12
        at = _limit(full, xs, kernel, w, -reach, reach, most)
        corner = _average(full, xs, kernel, w, -reach, reach, at, most)
        reached = float(w @ w - w @ corner) / max(float(w @ w), 1e-300)
        if reached <= gap:
            break
        corners.append(corner)
        a = shortest(np.array(corners))
        w = a @ np.array(corners)
        live = a > 1e-12
        corners = [c for c, keep in zip(corners, live) if keep]

    def score(batches):
        for rb in batches:
            x = np.stack([rb.column(rb.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in xs], 1)
            s = np.full(len(x), np.nan)
            ok = np.flatnonzero(~np.isnan(x).any(1))
            for lo in range(0, len(ok), 4096):
                s[ok[lo:lo + 4096]] = kernel.features(x[ok[lo:lo + 4096]]) @ w
            yield pa.RecordBatch.from_arrays([*[rb.column(rb.schema.get_field_index(c)) for c in kept], pa.array(s, from_pandas=True)], names=[*kept, out])

    schema = T.StructType([*[points.schema[c] for c in kept], T.StructField(out, T.DoubleType())])
    return points.mapInArrow(score, schema), reached


def oneclass_flag(df: DataFrame, feats: Sequence[str], nu: float = NU, out: str = "anomaly_ocsvm", **more) -> DataFrame:
    """``df`` with ``out``: the row scores below the ``nu`` quantile of all scores."""
    kept = df.columns
    scored, _ = oneclass_scores(df, feats, nu, out="_score", **more)
    scored = materialize(scored)
    limit = key_quantiles(scored, None, [("_score", nu, "_limit")])
    d = scored.crossJoin(F.broadcast(limit))  # one row
    return d.select(*kept, F.coalesce(F.col("_score") < F.col("_limit"), F.lit(False)).alias(out))
