"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are the distinct byte 5- and 8-grams of a text (A-Z lower-cased, white space as
spaces). From the labelled sample, each n-gram gets the ratio
``r = log((p + a) / (P + 2a)) - log((q + a) / (Q + 2a))`` of its document rates in both classes; a
logistic regression is fitted on the features scaled by ``r``. The score of a text is the logistic
of the sum of ``w * r`` over its distinct n-grams, so it does not fade with length.

Bounded are the labelled sample (``learn.labelled_sample``) and the features (``max_features`` hash
slots of the most telling n-grams, all n-grams in them); scoring is a map over all rows and whole
texts that meets every feature. Defined cases: null text = empty text (scored by the intercept); null doc_id is scored, its
``held_out`` is null; repeated rows are scored each; without labels of both classes every score is
the share of label 1 (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazeframe.llm import learn
from hazeframe.llm import text as X

ORDERS = (5, 8)
LUT_BITS = 20
FIT_BITS = 22
MAX_FEATURES = 30_000
MIN_DF = 3


@dataclass
class NBModel:
    """Sorted feature keys with weights ``w * r``, the hash slots that hold a key, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    slots: np.ndarray
    bias: float


def _clean(data: np.ndarray) -> np.ndarray:
    d = X.lower(data)
    return np.where((d >= 9) & (d <= 13), np.uint8(32), d)


def _slot(keys: np.ndarray, bits: int = LUT_BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def ngram_keys(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key, row) of every n-gram of ``order`` bytes that lies inside one row."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(min(order, 8)):
        key |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    key = (key ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    inside = row[:n] == row[order - 1:order - 1 + n]
    return key[inside], row[:n][inside]


def _rows_keys(texts: list[str], wanted: np.ndarray | None):
    """Distinct n-gram keys of every text, in order; only those in wanted slots if given."""
    batch = pa.record_batch([pa.array(texts, pa.large_string())], names=["t"])
    for _, data, off in X.slices(iter([batch]), "t", 1 << 17):
        d, n = _clean(data), len(off) - 1
        keys, rows = [], []
        for o in ORDERS:
            k, r = ngram_keys(d, off, o)
            if wanted is not None:
                ok = wanted[_slot(k, FIT_BITS)]
                k, r = k[ok], r[ok]
            keys.append(k)
            rows.append(r)
        k, r = np.concatenate(keys), np.concatenate(rows)
        o = np.lexsort((k, r))
        k, r = k[o], r[o]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        k, r = k[new], r[new]
        cut = np.searchsorted(r, np.arange(n + 1))
        for i in range(n):
            yield k[cut[i]:cut[i + 1]]


def _ratio(p: np.ndarray, q: np.ndarray, pos: float, neg: float, alpha: float) -> np.ndarray:
    return np.log((p + alpha) / (pos + 2 * alpha)) - np.log((q + alpha) / (neg + 2 * alpha))


def fit(texts: list[str], y: np.ndarray, shift: float = 0.0, alpha: float = 1.0,
        max_features: int = MAX_FEATURES) -> NBModel:
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(1, bool)
    if len(y) == 0 or y.min() == y.max():
        return NBModel(*none, bias=40.0 if len(y) and y[0] == 1 else -40.0)
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    # pass 1: document counts of both classes per hash slot; the most telling slots stay
    cnt = np.zeros((2, 1 << FIT_BITS), np.uint16)
    for k, label in zip(_rows_keys(texts, None), y, strict=True):
        cnt[int(label)][np.unique(_slot(k, FIT_BITS))] += 1
    q, p = cnt
    seen = np.flatnonzero(p.astype(np.uint32) + q >= MIN_DF)
    p, q = p[seen].astype(float), q[seen].astype(float)
    tell = np.abs(_ratio(p, q, pos, neg, alpha)) / np.sqrt(1 / (p + alpha) + 1 / (q + alpha))
    wanted = np.zeros(1 << FIT_BITS, bool)
    wanted[seen[np.argsort(-tell, kind="stable")[:max_features]]] = True
    del cnt, p, q, seen, tell
    # pass 2: the n-grams in those slots; pass 3: every text as indexes of them, laid one after the other in one array
    keys, pool, size = np.zeros(0, np.uint64), [], 0
    ptr = np.zeros(len(y) + 1, np.int64)
    for row, k in enumerate(_rows_keys(texts, wanted)):
        ptr[row + 1] = ptr[row] + len(k)
        pool.append(k)
        size += len(k)
        if size > 1_000_000:
            keys, pool, size = np.unique(np.concatenate((keys, *pool))), [], 0
    keys = np.unique(np.concatenate((keys, *pool)))
    del pool
    idx, p, df = np.empty(ptr[-1], np.int32), np.zeros(len(keys)), np.zeros(len(keys))
    for row, k in enumerate(_rows_keys(texts, wanted)):
        i = idx[ptr[row]:ptr[row + 1]]
        i[:] = np.searchsorted(keys, k)
        df[i] += 1
        p[i] += y[row]
    r = _ratio(p, df - p, pos, neg, alpha)
    r[df < MIN_DF] = 0.0
    end = 0
    for row in range(len(y)):  # n-grams without weight go, in place
        i = idx[ptr[row]:ptr[row + 1]]
        i = i[r[i] != 0]
        ptr[row] = end
        idx[end:end + len(i)] = i
        end += len(i)
    ptr[-1] = end
    w, b = learn.sparse_logreg(ptr, idx[:end], r.astype(np.float32), y, len(keys), l2=1e-4, rate=0.02, epochs=10, by_feature=True)
    v = w * r
    some = v != 0
    return _model(keys[some], v[some], b + shift)


def _model(keys: np.ndarray, v: np.ndarray, bias: float) -> NBModel:
    """``keys`` are distinct and in order."""
    slots = np.zeros(1 << LUT_BITS, bool)
    slots[_slot(keys)] = True
    return NBModel(keys, v.astype(np.float32), slots, float(bias))


def margins(m: NBModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-odds per row of a byte slice."""
    n = len(off) - 1
    z = np.full(n, m.bias)
    if not len(m.keys) or not len(data):
        return z
    d = _clean(data)
    for o in ORDERS:
        key, row = ngram_keys(d, off, o)
        hit = np.flatnonzero(m.slots[_slot(key)])
        key, row = key[hit], row[hit]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        ok = m.keys[at] == key
        u = np.unique(row[ok] * np.int64(len(m.keys)) + at[ok])
        z += np.bincount(u // len(m.keys), m.weights[u % len(m.keys)].astype(np.float64), n)
    return z


def score(docs: DataFrame, m: NBModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    def run(batches):
        for rb, data, off in X.slices(batches, "text"):
            s = learn.logistic(margins(m, data, off))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = learn.MAX_PER_CLASS) -> NBModel:
    """Fit on ``labels.toxic`` of the rows whose crc32(doc_id) mod 5 is not 0."""
    return fit(*learn.labelled_sample(docs, labels, "toxic", 5, 0, max_per_class))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    s = score(docs, train(docs, labels))
    return s.select("doc_id", (learn.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; all columns stay as they are."""
    m = train(docs, labels)

    def run(batches):
        for rb, data, off in X.slices(batches, "text"):
            yield rb.filter(pa.array(learn.logistic(margins(m, data, off)) < threshold))

    return docs.mapInArrow(run, docs.schema)
