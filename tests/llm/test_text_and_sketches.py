"""Fingerprints: exact columns and sketch estimates against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from hazeframe.llm import fingerprints as FP
from hazeframe.llm import text as X
from tests.llm.conftest import words


def shingle_set(t: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def neighbours(pairs):
    rows = sorted(pairs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return [(r, rows[(i + 1) % len(rows)]) for i, r in enumerate(rows)]


def check(rows, pairs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in rows)
    want = []
    for (i, t), (_, nxt) in neighbours(pairs):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = (t[:len(t) - k] if k else t) + nxt[:k]
        want.append((i is None, i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)


def test_word_hashes_follow_the_pattern():
    import pyarrow as pa

    texts = ["", "a b", "  A\tb\x0bc ", "É é", "x", "\n", "tail word"]
    data, off = X.text_buffers(pa.array(texts))
    h, wo = X.word_hashes(data, off)
    seen: dict = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert wo[i + 1] - wo[i] == len(w)
        for a, b in zip(w, h[wo[i]:wo[i + 1]], strict=True):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in a)
            assert seen.setdefault(low, int(b)) == int(b)
    assert len(set(seen.values())) == len(seen)


def test_awkward_rows(docs_of, awkward):
    out = FP.fingerprint_with_edit(docs_of(awkward, extra=True), rows_per_bucket=3)
    rows = out.collect()
    check(rows, awkward)
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.fingerprint for r in empty} == {"0:"}
    same = [r.fingerprint for r in rows if r.doc_id in (5, 6) or r.doc_id is None]
    assert len(same) == 4 and len(set(same)) == 1


def test_buckets_do_not_show(docs_of):
    rng = random.Random(2)
    pairs = [(i * 7, " ".join(words(rng, rng.randrange(0, 60)))) for i in range(90)]
    a = FP.fingerprint_with_edit(docs_of(pairs), rows_per_bucket=4).collect()
    check(a, pairs)
    b = FP.fingerprint_with_edit(docs_of(pairs), rows_per_bucket=1000).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_estimates(share):
    rng = random.Random(1)
    w = words(rng, 3000, 10**6)
    v = w[:int(3000 * share)] + words(rng, 3000 - int(3000 * share), 10**6)
    import pyarrow as pa

    data, off = X.text_buffers(pa.array([" ".join(w), " ".join(v)]))
    a, b = FP.sketches(data, off)
    s, t = shingle_set(" ".join(w)), shingle_set(" ".join(v))
    assert abs(FP.resemblance(a, b) - len(s & t) / len(s | t)) < 0.15
    assert abs(FP.containment(a, b) - len(s & t) / len(s)) < 0.2
    assert abs(FP.distinct_count(a) / len(s) - 1) < 0.3
    assert (FP.from_string(FP.to_string(a)) == a).all()


def test_merge_equals_sketch_of_union(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    both = FP.sketch_hashes(np.concatenate((a, b)))
    assert (FP.merge(FP.sketch_hashes(a), FP.sketch_hashes(b)) == both).all()
    df = spark.createDataFrame([("k", FP.to_string(FP.sketch_hashes(a))), ("k", FP.to_string(FP.sketch_hashes(b))), ("e", "0:")],
                               "key string, fingerprint string")
    got = {r.key: r.fingerprint for r in FP.merge_fingerprints(df, "key").collect()}
    assert got["k"] == FP.to_string(both)


def test_empty_table(docs_of):
    assert FP.fingerprint_with_edit(docs_of({})).count() == 0
    assert FP.fingerprint(docs_of({1: "a b c"})).first().fingerprint.startswith("1:")
