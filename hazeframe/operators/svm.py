"""Linear SVMs with squared hinge loss and Platt scaling, many fits in the same passes (M8).

A fit is a group of rows and a fold it leaves out: it minimises ``|w|^2 / 2 + C sum_i c_i max(0, 1 - s_i w.x_i)^2`` over the
group's other folds (bias as a constant feature, balanced class weights c), by Newton steps. A step needs the
loss, its gradient and its second derivatives, which are sums over rows; one pass gives them for all fits, so the
number of passes is that of the slowest fit (about ten). The left-out fold's margins are then mapped
to probabilities by a logistic curve with smoothed targets, fitted by Newton steps over the same rows.

Sums are NumPy products inside the tasks; Spark adds one row per fit and task. The driver holds sums of size
features x features per fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.sequence import materialize

C = 1.0
TOLERANCE = 1e-8  # of the gradient, against the first
MAX_STEPS = 200


@dataclass
class Fit:
    """w (last entry: bias) and the curve P = 1 / (1 + exp(a m + b)) of a margin m."""

    w: np.ndarray
    a: float = 0.0
    b: float = 0.0


def _sums(rows: DataFrame, d: int, keys: list[tuple[int, int]], value, width: int) -> dict[tuple[int, int], np.ndarray]:
    """One pass: the vector ``value(fit number, x, y)`` of each fit's rows, summed. ``rows``: grp, fold, y, x0..

    ``value`` gets all rows of the fit's group with a mask of those in the left-out fold.
    """

    def add(batches):
        acc = np.zeros((len(keys), width))
        for rb in batches:
            cols = {n: rb.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(rb.schema.names)}
            x = np.stack([*[cols[f"x{i}"] for i in range(d)], np.ones(rb.num_rows)], 1)
            for n, (g, f) in enumerate(keys):
                own = np.flatnonzero(cols["grp"] == g)
                if len(own):
                    acc[n] += value(n, x[own], cols["y"][own], cols["fold"][own] == f)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys), dtype=np.int32)), *[pa.array(acc[:, i]) for i in range(width)]],
                                         names=["n", *[f"v{i}" for i in range(width)]])

    got = rows.mapInArrow(add, "n int, " + ", ".join(f"v{i} double" for i in range(width))).groupBy("n").agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect()  # a row a fit
    out = {k: np.zeros(width) for k in keys}
    for r in got:
        out[keys[r["n"]]] = np.array([r[f"v{i}"] for i in range(width)])
    return out


def _newton(rows: DataFrame, d: int, start: dict, loss, m: int, tolerance: float) -> dict:
    """Minimise a convex loss per fit: ``loss(key, w)`` returns a function (x, y, held out) -> sums of loss, gradient and
    second derivatives, and the part of them that no row adds to. Steps that don't lower the loss are halved."""
    w = {k: v.copy() for k, v in start.items()}
    at: dict = {k: None for k in start}  # (w, loss, step) of the last point taken
    first: dict = {}
    todo = list(start)
    up = np.triu_indices(m)
    for _ in range(MAX_STEPS):
        fns = [loss(k, w[k]) for k in todo]
        got = _sums(rows, d, todo, lambda n, x, y, held, fns=fns: fns[n][0](x, y, held), 1 + m + len(up[0]))
        still = []
        for k, (_, own) in zip(todo, fns):
            v = got[k] + own
            value, grad = v[0], v[1:1 + m]
            hess = np.zeros((m, m))
            hess[up] = v[1 + m:]
            hess = hess + np.triu(hess, 1).T
            if at[k] is not None and value > at[k][1] + 1e-12 * abs(at[k][1]):
                base, before, step = at[k]
                step = step / 2
                at[k] = base, before, step
                w[k] = base + step
                if np.abs(step).max() > 1e-12:
                    still.append(k)
                else:
                    w[k] = base
                continue
            first.setdefault(k, max(float(np.abs(grad).max()), 1e-300))
            if np.abs(grad).max() <= tolerance * first[k]:
                continue
            step = -np.linalg.solve(hess + 1e-12 * np.eye(m), grad)
            at[k] = w[k].copy(), value, step
            w[k] = w[k] + step
            still.append(k)
        todo = still
        if not todo:
            break
    return w


def _half(p: np.ndarray) -> np.ndarray:
    return p[np.triu_indices(len(p))]


def fit_calibrated(df: DataFrame, feats: Sequence[str], label: str, fold: str, n_folds: int, group: str | None = None, c: float = C) -> dict[int, list[Fit]]:
    """Per value of the integer column ``group`` (None: one group, 0) the ``n_folds`` fits, each on the folds but one."""
    d = len(feats)
    rows = materialize(df.select((F.lit(0) if group is None else F.col(group)).cast("int").alias("grp"), F.col(fold).cast("int").alias("fold"),
                                 F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)]))
    n = {(r["grp"], r["fold"], r["y"]): r["n"] for r in rows.groupBy("grp", "fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a fold
    groups = sorted({g for g, _, _ in n})
    keys = [(g, f) for g in groups for f in range(n_folds)]
    size = {(k, y, held): sum(v for (g, f, yy), v in n.items() if g == k[0] and yy == y and (f == k[1]) == held)
            for k in keys for y in (0.0, 1.0) for held in (False, True)}

    def hinge(k, w):
        total = size[k, 0.0, False] + size[k, 1.0, False]
        weight = [c * total / (2 * size[k, y, False]) if size[k, y, False] else 0.0 for y in (0.0, 1.0)]

        def rows_part(x, y, held, w=w, weight=weight):
            x, y = x[~held], y[~held]
            s = 2 * y - 1
            slack = 1 - s * (x @ w)
            on = slack > 0
            x, s, slack, cw = x[on], s[on], slack[on], np.where(y[on] == 1, weight[1], weight[0])
            return np.concatenate(([float((cw * slack * slack).sum())], -2 * x.T @ (cw * s * slack), _half(2 * x.T @ (x * cw[:, None]))))

        return rows_part, np.concatenate(([0.5 * float(w @ w)], w, _half(np.eye(d + 1))))

    w = _newton(rows, d, {k: np.zeros(d + 1) for k in keys}, hinge, d + 1, TOLERANCE)

    def curve(k, ab):
        up, low = (size[k, 1.0, True] + 1) / (size[k, 1.0, True] + 2), 1 / (size[k, 0.0, True] + 2)

        def rows_part(x, y, held, ab=ab, v=w[k], up=up, low=low):
            m = x[held] @ v
            t = np.where(y[held] == 1, up, low)
            z = ab[0] * m + ab[1]
            p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
            q = p * (1 - p)
            nll = np.logaddexp(0, z) - (1 - t) * z  # -t log p - (1 - t) log (1 - p)
            e = t - p
            return np.array([nll.sum(), (e * m).sum(), e.sum(), (q * m * m).sum(), (q * m).sum(), q.sum()])

        return rows_part, np.array([0.0, 0, 0, 1e-12, 0, 1e-12])

    start = {k: np.array([0.0, float(np.log((size[k, 0.0, True] + 1) / (size[k, 1.0, True] + 1)))]) for k in keys}
    ab = _newton(rows, d, start, curve, 2, 1e-7)
    return {g: [Fit(w[g, f], float(ab[g, f][0]), float(ab[g, f][1])) for f in range(n_folds)] for g in groups}


def probability(fits: Sequence[Fit], feats: Sequence[str]) -> Column:
    """Mean of the fits' probabilities as a column expression."""
    out = None
    for f in fits:
        m = F.lit(float(f.w[-1]))
        for name, v in zip(feats, f.w):
            m = m + F.lit(float(v)) * F.col(name)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(f.a) * m + F.lit(f.b), F.lit(700.0))))
        out = p if out is None else out + p
    return out / len(fits)
