"""Gaussian mixture with full covariances by expectation-maximisation.

A step is one pass: every row's membership in the k components, and counts, sums and products weighted by it, added
up inside the tasks (NumPy over Arrow batches); Spark sums one row per component and task. The driver turns those
k rows into means, covariances and their Cholesky factors. ``FLOOR`` on the diagonal keeps
constant or repeated columns regular; memberships come from log densities by log-sum-exp, so
far-off rows stay defined. Columns are shifted by their means first, so products don't cancel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeframe.operators.sequence import materialize

FLOOR = 1e-6
TOLERANCE = 1e-3  # change of the mean log likelihood
MAX_ITER = 100
Params = list[tuple[float, np.ndarray, np.ndarray]]  # per component: constant, mean, inverse Cholesky factor


def _matrix(rb: pa.RecordBatch, d: int) -> np.ndarray:
    return np.stack([rb.column(rb.schema.get_field_index(f"x{i}")).to_numpy(zero_copy_only=False) for i in range(d)], 1)


def _members(x: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(membership of every row in every component, log likelihood of every row), by log-sum-exp."""
    dens = np.stack([c - 0.5 * (((x - mu) @ inv.T) ** 2).sum(1) for c, mu, inv in params], 1)
    top = dens.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(dens - top).sum(1))
    return np.exp(dens - ll[:, None]), ll


def _moments(points: DataFrame, d: int, k: int, params: Params | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts, sums and products per component, and the summed log likelihood, in one pass; without parameters the members
    are those of the start."""
    width = 2 + d + d * d

    def add(batches):
        acc = np.zeros((k, width))
        for rb in batches:
            x = _matrix(rb, d)
            if params is None:
                r, ll = (rb.column(rb.schema.get_field_index("c0")).to_numpy(zero_copy_only=False)[:, None] == np.arange(k)[None, :]).astype(float), np.zeros(len(x))
            else:
                r, ll = _members(x, params)
            acc[:, 0] += r.sum(0)
            acc[0, 1] += ll.sum()
            acc[:, 2:2 + d] += r.T @ x
            for c in range(k):
                acc[c, 2 + d:] += (x.T @ (x * r[:, c:c + 1])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *[pa.array(acc[:, i]) for i in range(width)]],
                                         names=["c", *[f"v{i}" for i in range(width)]])

    rows = points.mapInArrow(add, "c int, " + ", ".join(f"v{i} double" for i in range(width))).groupBy("c").agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect()  # k rows
    got = np.zeros((k, width))
    for row in rows:
        got[row["c"]] = [row[f"v{i}"] for i in range(width)]
    return got[:, 0], got[:, 2:2 + d], got[:, 2 + d:].reshape(k, d, d), float(got[:, 1].sum())


def _parameters(n: np.ndarray, s: np.ndarray, q: np.ndarray, rows: int) -> Params:
    k, d = s.shape
    n = n + 10 * np.finfo(float).eps
    out: Params = []
    for c in range(k):
        mu = s[c] / n[c]
        cov = q[c] / n[c] - np.outer(mu, mu) + FLOOR * np.eye(d)
        inv = np.linalg.inv(np.linalg.cholesky(cov))
        const = math.log(n[c] / rows) + float(np.log(np.diag(inv)).sum()) - 0.5 * d * math.log(2 * math.pi)
        out.append((const, mu, inv))
    return out


def mixture(df: DataFrame, feats: Sequence[str], start: str, k: int, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``cluster`` (most probable component, the first of equals) and ``probability`` (array of k).

    ``start`` names an integer column with each row's first component (0..k-1), dropped from the result. Steps go on until the mean
    log likelihood changes by less than ``tolerance``, at most ``max_iter``. Rows with a NULL feature get NULLs.
    """
    d = len(feats)
    kept = [c for c in df.columns if c != start]
    shift = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)]).first()  # one row
    xs = [(F.col(f).cast("double") - F.lit(shift[f"m{i}"] or 0.0)).alias(f"x{i}") for i, f in enumerate(feats)]
    points = materialize(df.select(F.struct(*kept).alias("row"), F.col(start).alias("c0"), *xs))
    fitted = points.drop("row").na.drop(subset=[f"x{i}" for i in range(d)])
    rows = fitted.count()
    if not rows:
        return df.select(*kept, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("array<double>").alias("probability"))
    n, s, q, _ = _moments(fitted, d, k, None)
    before = -math.inf
    for _ in range(max_iter):
        n, s, q, ll = _moments(fitted, d, k, _parameters(n, s, q, rows))
        if abs(ll / rows - before) < tolerance:
            break
        before = ll / rows
    params = _parameters(n, s, q, rows)

    def label(batches):
        for rb in batches:
            x = _matrix(rb, d)
            ok = np.flatnonzero(~np.isnan(x).any(1))
            r, at = np.zeros((len(x), k)), np.zeros(len(x), np.int32)
            r[ok] = _members(x[ok], params)[0] if len(ok) else r[ok]
            at[ok] = r[ok].argmax(1) if len(ok) else at[ok]
            miss = np.ones(len(x), bool)
            miss[ok] = False
            prob = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(r.ravel()), mask=pa.array(miss))
            yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index("row")), pa.array(at, mask=miss), prob], names=["row", "cluster", "probability"])

    schema = T.StructType([points.schema["row"], T.StructField("cluster", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])
    return points.mapInArrow(label, schema).select("row.*", "cluster", "probability")
