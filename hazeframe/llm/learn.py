"""Shared learning helpers: the bounded labelled sample and a sparse logistic regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PER_CLASS = 3000  # documented bounds of every classifier's labelled sample: rows of a class
MAX_CHARS = 100_000  # and code points of a row


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, out: int,
                    max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray, float]:
    """(texts, 0/1 labels, log-odds shift) of a bounded sample of the training folds.

    At most about ``max_per_class`` rows of either class are taken, chosen by a hash of doc_id, so
    what reaches the driver does not grow with the input. Models learn from the first ``max_chars``
    code points of a sampled text (scoring reads whole texts). The shift turns log-odds of the sample
    into log-odds of all training rows. A document with repeated label rows counts once (its
    largest label), repeated rows of one id count once (the least text); null labels and null ids
    are left out.
    """
    t = (labels.where(F.col(label).isin(0, 1) & (fold("doc_id", mod) != out))
         .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    n = {r["y"]: r["n"] for r in t.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not n:
        return [], np.zeros(0), 0.0
    share = {y: min(1.0, max_per_class / c) for y, c in n.items()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = [(F.col("y") == y) & (h < int(share[y] * (1 << 30))) if share[y] < 1 else F.col("y") == y for y in n]
    picked = t.where(keep[0] if len(keep) == 1 else keep[0] | keep[1])
    cut = docs.select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(max_chars)).alias("text"))
    got = (cut.join(F.broadcast(picked), "doc_id")  # picked is bounded by the sample
           .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = got.column("y").to_numpy().astype(np.float64)
    shift = 0.0
    if len(n) == 2:
        shift = math.log(n[1] / n[0]) - math.log((n[1] * share[1]) / (n[0] * share[0]))
    return got.column("text").to_pylist(), y, shift


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sparse_logreg(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, n_features: int,
                  l2: float = 1e-5, epochs: int = 12, rate: float = 0.3, batch: int = 64,
                  seed: int = 7, by_feature: bool = False) -> tuple[np.ndarray, float]:
    """L2 logistic regression by mini-batch Adagrad over CSR rows, weights averaged over the last half.

    ``y`` may be (n,) or (n, classes); one-vs-rest for several classes, where no row may be empty.
    ``by_feature``: ``val`` holds one value a feature, the same in all rows, instead of one an entry.
    """
    many = y.ndim == 2
    yy = y if many else y[:, None]
    k = yy.shape[1]
    w, g2 = np.zeros((n_features, k)), np.full((n_features, k), 1e-8)
    b, gb2 = np.zeros(k), np.full(k, 1e-8)
    ws, bs, steps = np.zeros_like(w), np.zeros(k), 0
    rng, n = np.random.default_rng(seed), len(yy)
    for ep in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at:at + batch]
            ln = (ptr[rows + 1] - ptr[rows])
            take = np.repeat(ptr[rows] - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(ln.sum())
            j, v, r = idx[take], val[idx[take] if by_feature else take], np.repeat(np.arange(len(rows)), ln)
            if many:  # every row has features: sums over runs of rows, then over runs of features
                z = np.add.reduceat(w[j] * v[:, None], np.cumsum(ln) - ln)
            else:
                z = np.bincount(r, v * w[j, 0], len(rows))[:, None]
            e = (logistic(z + b) - yy[rows]) / len(rows)
            if many:
                by = np.argsort(j, kind="stable")
                at_u = np.flatnonzero(np.concatenate(([True], np.diff(j[by]) > 0)))
                u, g = j[by][at_u], np.add.reduceat((v[:, None] * e[r])[by], at_u)
            else:
                u, inv = np.unique(j, return_inverse=True)
                g = np.bincount(inv, v * e[r, 0], len(u))[:, None]
            g += l2 * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            gb = e.sum(0)
            gb2 += gb * gb
            b -= rate * gb / np.sqrt(gb2)
        if ep >= epochs // 2:
            ws, bs, steps = ws + w, bs + b, steps + 1
    w, b = ws / max(steps, 1), bs / max(steps, 1)
    return (w, b) if many else (w[:, 0], float(b[0]))
