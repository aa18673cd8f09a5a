"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. Every passage becomes a vector of character-class
shares and word statistics, is encoded by one dense layer, and gets a gated attention weight
``softmax(w . (tanh(V h) * sigmoid(U h)))``; the weighted mean of the encodings is classified by a
logistic layer. All weights are learned jointly from document labels (Adam, mini-batches of bags).

The labelled sample is bounded (``max_per_class``); scoring is a map over all rows and whole texts.
Defined cases: null text = empty text = one empty passage; null doc_id is scored, its ``held_out``
is null; repeated rows are scored each; without labels of both classes every score is the share of
label 1 (1.0 without labels, so nothing is rejected unseen); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazeframe.llm import learn
from hazeframe.llm import text as X

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 24, 12
_CLASSES = 128
# ASCII bytes keep their own class; all other bytes share class 127. Case folds into letter classes
# with one extra count for capitals.
N_FEATURES = _CLASSES + 6


def passages(data: np.ndarray, off: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features, passage offsets per row) of a byte slice; a row without words has one empty passage."""
    n = len(off) - 1
    s, e, row = X.word_spans(data, off)
    wo = np.searchsorted(row, np.arange(n + 1))
    counts = np.maximum(1, -(-np.diff(wo) // size))
    po = np.concatenate(([0], np.cumsum(counts)))
    total = int(po[-1])
    owner = np.repeat(np.arange(n), counts)
    nth = np.arange(total) - po[owner]
    first = wo[owner] + nth * size
    start = np.where(nth == 0, off[owner], s[np.minimum(first, max(len(s) - 1, 0))] if len(s) else off[owner])
    feats = np.zeros((total, N_FEATURES))
    if len(data):
        edges = np.concatenate((start, [len(data)]))
        pid = np.repeat(np.arange(total), np.diff(edges))
        low = X.lower(data)
        cls = np.minimum(low, 127).astype(np.int64)
        feats[:, :_CLASSES] = np.bincount(pid * _CLASSES + cls, minlength=total * _CLASSES).reshape(total, _CLASSES)
        size_b = np.maximum(1.0, np.diff(edges))[:, None]
        feats[:, :_CLASSES] = np.sqrt(feats[:, :_CLASSES] / size_b)
        caps = np.bincount(pid, low != data, total) / size_b[:, 0]
        wp = po[row] + (np.arange(len(s)) - wo[row]) // size
        h = X.span_hash(low, s, e)
        nw = np.bincount(wp, minlength=total)
        # distinct words, and words that repeat the one two or ... places before: loops and lists
        o = np.lexsort((h, wp))
        new = np.ones(len(o), bool)
        new[1:] = (wp[o][1:] != wp[o][:-1]) | (h[o][1:] != h[o][:-1])
        distinct = np.bincount(wp[o][new], minlength=total)
        ln = np.bincount(wp, e - s, total) / np.maximum(nw, 1)
        again = np.zeros(total)
        if len(h) > 1:
            again = np.bincount(wp[1:], h[1:] == h[:-1], total)
        feats[:, _CLASSES] = caps
        feats[:, _CLASSES + 1] = distinct / np.maximum(nw, 1)
        feats[:, _CLASSES + 2] = np.log1p(ln)
        feats[:, _CLASSES + 3] = again / np.maximum(nw, 1)
        feats[:, _CLASSES + 4] = np.log1p(nw) / 4
    feats[:, _CLASSES + 5] = 1.0 / counts[owner]
    return feats, po


@dataclass
class MILModel:
    """Standardisation, encoder, gated attention and classifier weights."""

    mean: np.ndarray
    scale: np.ndarray
    par: dict[str, np.ndarray]
    shift: float = 0.0
    const: float | None = None


def _forward(p: dict[str, np.ndarray], x: np.ndarray, po: np.ndarray) -> tuple:
    h = np.tanh(x @ p["W"] + p["c"])
    t, g = np.tanh(h @ p["V"]), learn.logistic(h @ p["U"])
    a = (t * g) @ p["w"]
    row = np.repeat(np.arange(len(po) - 1), np.diff(po))
    a = np.exp(a - np.maximum.reduceat(a, po[:-1])[row])
    a /= np.add.reduceat(a, po[:-1])[row]
    z = np.add.reduceat(h * a[:, None], po[:-1], axis=0)
    return h, t, g, a, row, z, z @ p["o"] + p["b"][0]


def fit(texts: list[str], y: np.ndarray, shift: float = 0.0, epochs: int = 40, batch: int = 64,
        rate: float = 0.01, l2: float = 1e-4, seed: int = 11) -> MILModel:
    if len(y) == 0 or y.min() == y.max():
        return MILModel(np.zeros(1), np.ones(1), {}, const=float(y[0]) if len(y) else 1.0)
    parts, sizes = [], []
    rb = pa.record_batch([pa.array(texts, pa.large_string())], names=["t"])
    for _, data, off in X.slices(iter([rb]), "t"):
        f, po = passages(data, off)
        parts.append(f.astype(np.float32))
        sizes.append(np.diff(po))
    x, sizes = np.concatenate(parts), np.concatenate(sizes)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    ptr = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "c": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
         "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "o": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for ep in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            ln = sizes[rows]
            take = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            po = np.concatenate(([0], np.cumsum(ln)))
            xb = x[take]
            h, t, g, a, row, z, s = _forward(p, xb, po)
            e = (learn.logistic(s) - y[rows]) / len(rows)
            dz = e[:, None] * p["o"]
            dh = a[:, None] * dz[row]
            da = (h * dz[row]).sum(1)
            da = a * (da - np.add.reduceat(a * da, po[:-1])[row])
            dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["U"].T
            du = dh * (1 - h * h)
            grad = {"W": xb.T @ du + l2 * p["W"], "c": du.sum(0), "V": h.T @ dt, "U": h.T @ dg,
                    "w": (t * g).T @ da, "o": z.T @ e + l2 * p["o"], "b": np.array([e.sum()])}
            step += 1
            lr = rate * (0.5 * (1 + np.cos(np.pi * step * batch / (epochs * max(len(y), batch)))) if ep else 1.0)
            for k, v in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] = p[k] - max(lr, 0) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return MILModel(mean, scale, p, shift)


def scores(m: MILModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if m.const is not None:
        return np.full(len(off) - 1, m.const)
    f, po = passages(data, off)
    return learn.logistic(_forward(m.par, (f - m.mean) / m.scale, po)[-1] + m.shift)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
            max_per_class: int = learn.MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows with crc32(doc_id) mod 4 other than 2."""
    m = fit(*learn.labelled_sample(docs, labels, "quality", 4, 2, max_per_class))

    def run(batches):
        for rb, data, off in X.slices(batches, "text"):
            s = scores(m, data, off)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (learn.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
