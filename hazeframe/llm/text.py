"""Vectorised text helpers for Arrow batches: bytes, words, word hashes, shingles, n-grams.

All functions work on one byte slice (about 1 MB) at a time, so memory does not depend on the
batch size Spark chose. A text longer than the slice size makes a slice of its own.
Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes, which equals the same pattern over code
points since the separators are ASCII. Lower-casing touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
# Multipliers of the five positions of a shingle (odd, arbitrary).
_C5 = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 1 << 16)
        p = np.full(m, _P, np.uint64)
        q = np.full(m, _PINV, np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.cumprod(p), np.cumprod(q)
    return _POW, _INV


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str,
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches so that ``column`` holds about ``most`` bytes; yields (rows, bytes, offsets)."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        data, off = text_buffers(rb.column(rb.schema.get_field_index(column)))
        i, n = 0, rb.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
            j = min(n, max(j, i + 1))
            yield rb.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def lower(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << np.uint8(5))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross a row border."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    prev = np.concatenate(([False], word[:-1]))
    start = np.flatnonzero(word & (~prev | first))
    last = np.concatenate((~word[1:] | first[1:], [True]))
    end = np.flatnonzero(word & last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span (polynomial prefix sums, then a finaliser)."""
    n = len(data)
    p, q = _powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=pre[1:])
    h = (pre[end] - pre[start]) * q[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, word offsets per row) of the lower-cased words."""
    s, e, row = word_spans(data, off)
    h = span_hash(lower(data), s, e)
    return h, np.searchsorted(row, np.arange(len(off)), side="left")


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of one text (unsorted, with repeats); fewer words make one."""
    n = len(words)
    if n == 0:
        return words
    if n < 5:
        acc = np.full(1, n, np.uint64)
        for i in range(n):
            acc = (acc ^ words[i:i + 1]) * _C5[i]
        return mix(acc)
    m = n - 4
    acc = words[:m] * _C5[0]
    for k in range(1, 5):
        acc = acc + words[k:k + m] * _C5[k]
    return mix(acc)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))
