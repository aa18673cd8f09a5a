"""Jaccard join, decontamination, packing, archives and the language model against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import heapq
import math
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import components, decontaminate, jaccard, lm, packing, warc
from hazeframe.llm.store import scratch
from tests.llm.conftest import words
from tests.llm.test_text_and_sketches import shingle_set


def brute_components(pairs):
    rows = [(i, shingle_set(t or "")) for i, t in pairs if i is not None]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near_copies(rng, groups=12, most=14):
    out, i = {}, 0
    for _ in range(groups):
        base = words(rng, rng.randrange(3, 120))
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 14))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            out[i * 3 + 1] = " ".join(w)
            i += 1
    return out


def test_component_passes(spark, monkeypatch):
    """Chains, stars, rings and random edges, repeated, reversed and with null ends; small plans without copies through
    the driver, and no pass over components that are stars already."""
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(300, 301), (301, 302), (302, 300), (9, 9)]
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(-7, 3), (3, 2**62)]
    up = {x: x for p in pairs if p[0] != p[1] for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    written = []

    def noted(df, name):
        out = pin(df, name)
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    pin = components.pin
    monkeypatch.setattr(components, "pin", noted)
    rows = [*pairs, *((b, a) for a, b in pairs[::3]), *pairs[::4], (None, 5), (5, None)]
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up)
    assert len(written) > 2
    for plan in written[1:]:
        start = plan.split("Initial Plan")[-1]
        assert "Broadcast" not in plan and start.count("FileScan parquet") <= 4
    written.clear()
    stars = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, i) for i in range(21, 29)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(stars).collect()} == {
        (i, 1) for i in range(1, 9)} | {(i, 20) for i in range(20, 29)}
    assert len(written) == 1
    assert components.connected_components(stars.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(docs_of, awkward, seed, monkeypatch):
    rng = random.Random(seed)
    texts = near_copies(rng)
    common = " ".join(words(rng, 50))
    texts |= {10_000 + k: " ".join(words(rng, 12)) + " " + common for k in range(40)}  # a shared passage, near the limit
    pairs = [*texts.items(), *((None if i is None else i + 20_000, t) for i, t in awkward)]
    if seed == 2:  # many blocks, common tokens and shards on small data
        monkeypatch.setattr(jaccard, "BLOCK", 4)
        monkeypatch.setattr(jaccard, "VERIFY", 2)
        monkeypatch.setattr(jaccard, "KEYS", 1)
        monkeypatch.setattr(jaccard, "COMMON_CHUNK", 2)
        monkeypatch.setattr(jaccard, "COMMON_TOTAL", 2)
    d = docs_of(pairs, extra=True)
    rows = jaccard.near_duplicates(d).collect()
    want = brute_components(pairs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in pairs)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    size = {i: len(shingle_set(t or "")) for i, t in pairs}
    assert all(r.n_shingles == size[r.doc_id] for r in rows)
    kept = jaccard.keep_one(d)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(want.values()) | {None}
    assert kept.columns == d.columns


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(6):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.15])]
            s = np.unique(np.concatenate((keep, rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64))))
            sets.append(s if len(s) else base)
    n = len(sets)
    size, sigs = [len(s) for s in sets], [jaccard.signature(s) for s in sets]
    linked = {(i, j) for j in range(n) for i in range(j)
              if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    order = sorted(range(n), key=lambda i: size[i])
    pairs = {(min(x, y), max(x, y)) for xs, ys in jaccard._tree_pairs(size, sigs, order, None)
             for x, y in zip(xs.tolist(), ys.tolist(), strict=True)}
    assert linked <= pairs and len(pairs) < n * n / 8
    leaf = {(min(x, y), max(x, y)) for x, y in jaccard._leaf_pairs(size, sigs, list(range(n)), None, order)}
    assert leaf == pairs
    span = jaccard.spanning_pairs(list(range(n)), list(range(n)), size, sigs)
    assert len(span) < n
    named = jaccard.named_members(list(range(n)), list(range(n)), [1] * n, size, sigs)
    assert all((j, i) in named for i, j in linked)
    for i, j in zip(jaccard.linked_with(sets[:50], iter(sets[50:])), range(50, n), strict=False):
        assert (i >= 0) == any((k, j) in linked for k in range(50)) and (i < 0 or (i, j) in linked)


def test_partnered_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(1, 60))
        g, n = rng.integers(0, 4, k), rng.integers(1, 40, k)
        o = np.lexsort((n, g))
        g, n = g[o], n[o]
        cap = (4 * n - 7 * rng.integers(0, n // 4 + 1)) // 3
        comp = rng.integers(0, 6, k)
        want = [any(g[x] == g[y] and comp[x] != comp[y] and n[y] <= cap[x] and n[x] <= cap[y] for y in range(k)) for x in range(k)]
        assert jaccard.partnered(g, n, cap, comp).tolist() == want
    none = np.zeros(0, np.int64)
    assert len(jaccard.partnered(none, none, none, none)) == 0


def test_sets_that_cannot_link_at_a_token_are_not_dealt(spark):
    """Ten sets share only the last token of their prefixes: no pair can first meet there. Two sets that share their first can."""
    rows = [(s, 40, [*(1000 * s + j for j in range(10)), 7]) for s in range(1, 11)]
    rows += [(s, 40, [5, *(1000 * s + j for j in range(10))]) for s in (20, 21)]
    pre = spark.createDataFrame(rows, "sid long, n int, prefix array<long>")
    comps = spark.createDataFrame([], "node long, comp long")
    got = {r["tok"]: (r["size"], sorted(r["sids"])) for r in jaccard._mixed_tokens(pre, comps, 0).collect()}
    assert got == {5: (2, [20, 21])}


def test_no_documents(docs_of):
    assert jaccard.near_duplicates(docs_of({})).count() == 0
    only = jaccard.near_duplicates(docs_of({4: None, 5: ""})).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in only} == {(4, 0, 4), (5, 0, 5)}


def brute_matches(docs, items, least=0.75):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    bag = lambda w: collections.Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])
    out = {}
    for i, t in docs:
        w = cut(t)
        for k, it in items:
            v = cut(it)
            if not v or not w:
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s:s + len(v)]), bag(v)
                n = sum((a & b).values())
                best = max(best, n / (sum(a.values()) + sum(b.values()) - n))
            if best >= least:
                out[(i, k)] = best
    return out


@pytest.mark.parametrize("few", [decontaminate.BROADCAST_SHINGLES, 0])
def test_decontamination(spark, docs_of, awkward, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", few)  # both join forms
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, n, 10**5))) for k, n in enumerate([3, 5, 8, 20, 45, 60])] + [(50, None), (51, ""), (4, None)]
    docs = [(i, t) for i, t in awkward if i != 8]
    for k, t in items[:6]:
        w = t.split()
        docs.append((100 + k, " ".join(words(rng, 30) + w + words(rng, 25))))
        if len(w) >= 45:
            w[10] = "changed"
            docs.append((200 + k, " ".join(words(rng, 7) + w).upper()))
            docs.append((300 + k, " ".join(words(rng, 9) + w[:len(w) // 2] + words(rng, 40))))
    it = spark.createDataFrame(items, "item_id long, text string")
    d = docs_of(docs, extra=True)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(d, it).collect()}
    want = brute_matches(docs, items)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(i >= 200 for i, _ in got) and not any(i and i >= 300 for i, _ in got)
    kept = decontaminate.drop_contaminated(d, it)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (i is None, i or 0) for i, _ in docs if i not in {a for a, _ in want})
    assert decontaminate.matches(docs_of({}), it).count() == 0
    assert decontaminate.matches(d, it.limit(0)).count() == 0


def test_decontamination_repeated_items(spark, docs_of):
    """Items repeated under one id or several each give their row; two texts under one id are two items."""
    rng = random.Random(12)
    a, b = " ".join(words(rng, 20, 10**5)), " ".join(words(rng, 9, 10**5))
    it = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (3, "one two"), (None, b)], "item_id long, text string")
    got = [r.item_id for r in decontaminate.matches(docs_of({10: f"x {a} y", 11: b, 12: "say one two now"}), it).orderBy("doc_id").collect()]
    assert collections.Counter(got) == {1: 2, 2: 1, 3: 2, None: 1}


def test_decontamination_recall_by_similarity_and_candidates(spark, docs_of):
    """Documents that edit an item by more and more words, among many items: recall per similarity band, and no
    work on (window, item) pairs without a common shingle."""
    rng = random.Random(21)
    items = [(k, " ".join(words(rng, 40, 10**6))) for k in range(400)]
    docs = []
    for i in range(600):
        w = items[i % 400][1].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(docs), it).collect()}
    bands = collections.defaultdict(list)
    for i, t in docs:
        a, b = (collections.Counter(zip(*[x.split()[k:] for k in range(5)])) for x in (t, items[i % 400][1]))
        s = sum((a & b).values()) / sum((a | b).values())
        if s >= 0.75:
            bands[int(s * 20)].append((i, i % 400) in got)
    assert len(bands) >= 3 and all(sum(x) >= 0.9 * len(x) for x in bands.values())
    assert got <= {(i, i % 400) for i, _ in docs}


def test_multi_index_guarantee(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    r = 19
    vals = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    near = [v ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, r + 1))) for v in vals]
    df = spark.createDataFrame(list(zip(vals, near, strict=True)), "a long, b long")
    agree = F.arrays_overlap(decontaminate.blocks(F.col("a"), r), decontaminate.blocks(F.col("b"), r))
    assert df.where(~agree).count() == 0


def test_ids_equal_the_named_tokenizer():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    path = packing.vocabulary_path()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "a  b\n\n c's", "é文字 123", "'LL 're"]))
    def same(s):
        assert packing.token_ids(s, path).tolist() == [*t.encode(s, add_special_tokens=False).ids, 2]

    same()


def test_special_tokens_as_in_the_named_tokenizer(docs_of):
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # at its default settings
    assert {x.content: i for i, x in t.get_added_tokens_decoder().items()} == packing.SPECIAL
    path = packing.vocabulary_path()
    part = st.text(max_size=20) | st.sampled_from(["<|endoftext|>", "  ", " \n", "<|endoftext", "|>", "'s", "é文 1"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(part, max_size=8).map("".join))
    def same(s):
        got = packing.token_ids(s, path, special=frozenset(packing.SPECIAL)).tolist()
        assert got == [*t.encode(s, add_special_tokens=False).ids, 2]

    same()
    text = "hi <|endoftext|> there"
    row = packing.pack_documents(docs_of({1: text})).first()
    want = [5303, 220, 50256, 612, 2]
    assert (row.length, row.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_packing_round_trip(docs_of, awkward):
    rng = random.Random(3)
    pairs = [*awkward, *((100 + k, " ".join(words(rng, rng.randrange(1, 500)))) for k in range(80))]
    rows = packing.pack_documents(docs_of(pairs, extra=True), limit=256).collect()
    path = packing.vocabulary_path()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in pairs:
        if i == 6:
            continue  # the repeated id, below
        ids, at = packing.token_ids(t, path), 0
        for r in sorted(by[i], key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == 256
            at += r.length
        assert at == len(ids)
    assert len(by[6]) == 2 * len(by[5])
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 256
    tokens = sum(r.length for r in rows)
    assert len(seq) <= math.ceil(tokens / 256) * 1.03 + 2
    assert packing.pack_documents(docs_of({})).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(65, np.int64)
    np.add.at(hist, rng.integers(1, 65, 50 * (1 + 20 * seed)), 1)
    used = np.zeros(65, np.int64)
    bins = 0
    for content, count in packing.plan(hist):
        assert sum(v * m for v, m in content) <= 64
        bins += count
        for v, m in content:
            used[v] += m * count
    assert (used == hist).all()
    assert bins <= math.ceil((np.arange(65) * hist).sum() / 64) * 1.1 + 1


def test_archives_round_trip(spark):
    pages = [(i, f"http://www.Host{i % 3}.example.com:80/p/{i % 4}?q={i}#f", f"<p>{i % 5}é\r\n\r\nWARC/1.1\r\n</p>") for i in range(40)]
    pages += [(100, None, None), (101, "x", ""), (102, "bad\r\nurl", None), (None, "http://a.b/", "<p>1é\r\n\r\nWARC/1.1\r\n</p>"),
              (7, "http://a.b/", "again"), (7, "http://a.b/", "again"), (103, "http://long/", "é" * 400_000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc-test")
    warc.write_runs(df.repartition(3), path, records_per_file=5)
    index = warc.read_runs(spark, path)
    for run in {r.run for r in index.select("run").collect()}:
        own = sorted((r for r in index.collect() if r.run == run), key=lambda r: r.nth)
        keys = [(r.urlkey, r.time, r.page_id is not None, r.page_id or 0) for r in own]
        assert keys == sorted(keys)  # locally sorted runs
    out = warc.merge_runs(index, rows_per_range=7).collect()
    order = sorted(out, key=lambda r: r.seq)
    keys = [(r.urlkey, r.time, r.page_id is not None, r.page_id or 0) for r in order]
    assert keys == sorted(keys) and [r.seq for r in order] == list(range(len(pages)))
    biggest: dict = {}
    for i, _, h in pages:
        if i is not None:
            biggest[h or ""] = max(biggest.get(h or "", -1), i)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = collections.Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        resp = i is None or biggest[h or ""] == i
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if resp else "revisit", None if resp else biggest[h or ""])] += 1
    assert got == want
    assert warc.archive_histories(df.limit(0)).count() == 0
    assert warc.archive_histories(df, min_bytes=10**9).where("record_type = 'revisit'").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
    got = [(runs[r][i], r) for r, i in warc.LoserTree(runs)]
    assert got == list(heapq.merge(*[[(v, r) for v in run] for r, run in enumerate(runs)]))


def test_language_model(docs_of, awkward):
    rng = random.Random(8)
    pairs = [*awkward, *((1000 + k, " ".join(words(rng, rng.randrange(1, 200), 60 + k))) for k in range(60))]
    rows = lm.score(docs_of(pairs, extra=True)).collect()
    assert len(rows) == len(pairs)
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "\0"]
    c = collections.Counter()
    for i, t in pairs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(cut(t))
    n, v = sum(c.values()), len(c)
    text = collections.defaultdict(list)
    for i, t in pairs:
        text[i].append(cut(t))
    for r in rows:
        w = text[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0 and r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(docs_of({})).count() == 0


def test_predictive_sums_to_one():
    rng = np.random.default_rng(1)
    w, u = rng.integers(0, 30, 500), rng.integers(0, 3, 500) * lm.PER_U1 + rng.integers(0, 2, 500)
    (wu, c) = np.unique(np.stack([w, u]), axis=1, return_counts=True)
    x, wi = np.unique(wu[0], return_inverse=True)
    seats = lm.Seats(x.astype(np.uint64), wi, wu[1], c, 0)
    m = lm.Model(500, len(x), (0.5, 0.6, 0.7))
    for _ in range(3):
        m.totals.append(seats.vector())
        seats.sweep(m.totals[-1], m, len(m.totals) - 1)
        assert (seats.t2 <= seats.c2).all() and (seats.t1 <= seats.c1).all() and (seats.t0 <= seats.c0).all()
    m.totals = [seats.vector()]
    sc = lm.Scorer(None, m)
    sc.seats, sc.samples = seats, [(lm._totals(m.totals[0]), seats.probabilities(m.totals[0], m))]
    for ctx in np.unique(u)[:4]:
        every = np.concatenate((x, [np.uint64(10**9)])).astype(np.uint64)
        lp, _, known = sc.token_scores(every, np.ones(len(every), int), np.full(len(every), ctx))
        assert (10**lp).sum() == pytest.approx(1.0) and not known[-1]


def test_contexts_are_whole_words(docs_of):
    def held(i):
        return zlib.crc32(str(i).encode()) % 5 == 1

    train, tests = [i for i in range(400) if not held(i)], [i for i in range(400, 900) if held(i)]
    rng = random.Random(4)
    follow = {("cold", "nation"): "left", ("cold", "station"): "right", ("warm", "nation"): "up", ("warm", "station"): "down"}
    pairs = [(i, " ".join(f"{a} {b} {follow[a, b]}" for a, b in rng.choices(list(follow), k=12))) for i in train]
    asks = [(a, b, c) for a, b in follow for c in sorted(follow.values())]
    pairs += [(i, f"{a} {b} {c}") for i, (a, b, c) in zip(tests, asks, strict=False)]
    got = {r.doc_id: r.score for r in lm.score(docs_of(pairs)).collect()}
    by = {ask: got[i] for i, ask in zip(tests, asks, strict=False)}
    for a, b in follow:  # equal endings, and one word before: each has its own word after it
        assert all(by[a, b, follow[a, b]] > by[a, b, c] + 1 for c in follow.values() if c != follow[a, b])


def test_contexts_stay_inside_a_text():
    data = np.frombuffer(b"A bB b cd", np.uint8)
    w, row = lm.tokens(data, np.array([0, 3, 3, 9]))
    dic, code, v, p = lm.contexts(w)
    name = {int(dic[c]): k for k, c in zip(["a", "b", lm.END, lm.END, "b", "b", "cd", lm.END], code, strict=True)}
    name[int(lm.START)] = "-"
    assert row.tolist() == [0, 0, 0, 1, 2, 2, 2, 2]
    assert [name[int(x)] for x in dic[v]] == ["-", "a", "b", "-", "-", "b", "b", "cd"]
    assert [name[int(x)] for x in dic[p]] == ["-", "-", "a", "-", "-", "-", "b", "b"]


def test_table_draws_follow_the_exact_conditional():
    d, s, base, rest = 0.5, 1.0, 0.2, 3
    table = lm.stirling(d)
    t = lm.draw_tables(np.random.default_rng(2), np.full(40_000, 4), np.full(40_000, rest), np.full(40_000, base), d, s, table)
    w = [math.exp(table[4, k]) * math.prod((s + d * (rest + j)) * base for j in range(k)) for k in range(1, 5)]
    for k in range(1, 5):
        assert (t == k).mean() == pytest.approx(w[k - 1] / sum(w), abs=0.01)
    # four customers: seatings by hand, discount d
    assert math.exp(table[3, 2]) == pytest.approx(3 * (1 - d)) and math.exp(table[3, 1]) == pytest.approx((1 - d) * (2 - d))


def test_language_model_keeps_few_bytes_a_token(docs_of, monkeypatch):
    rng, sizes, pin = random.Random(6), [], lm.pin

    def weighed(*a):
        d = pin(*a)
        sizes.append(sum(os.path.getsize(urllib.parse.urlparse(f).path) for f in d.inputFiles()))
        return d

    monkeypatch.setattr(lm, "pin", weighed)
    pairs = [(i, " ".join(words(rng, 600, 30_000))) for i in range(500)]
    assert lm.score(docs_of(pairs)).count() == 500
    assert sum(sizes) < 20 * 601 * 500  # all tables together, of four sweeps


def test_language_model_parts_change_nothing(spark, docs_of):
    rng = random.Random(7)
    docs = docs_of([(i, " ".join(words(rng, rng.randrange(80), 40))) for i in range(300)])
    other = docs.orderBy(F.udf(random.random, "double").asNondeterministic()())  # another order at each reading
    got = [sorted(lm.score(d, parts=k).collect()) for d, k in ((docs, 1), (docs, 3), (other, 2))]
    for rows in got[1:]:
        assert [r[:5] for r in rows] == [r[:5] for r in got[0]]
        assert [r.score for r in rows] == pytest.approx([r.score for r in got[0]], rel=1e-9)
        assert [r.base_score for r in rows] == pytest.approx([r.base_score for r in got[0]], rel=1e-9)


def test_triples_without_customers_score_as_unseen_ones():
    rng = np.random.default_rng(3)
    w, u = rng.integers(0, 30, 300), rng.integers(0, 6, 300) * lm.PER_U1 + rng.integers(0, 3, 300)
    (w, u), c = np.unique(np.stack([w, u]), axis=1, return_counts=True)
    c = c * (u // lm.PER_U1 < 4) * (rng.random(len(c)) < 0.7)
    x, some = np.arange(30, dtype=np.uint64), c > 0
    every, seen = lm.Seats(x, w, u, c, 0), lm.Seats(x, w[some], u[some], c[some], 0)
    m = lm.Model(int(c.sum()), int((seen.count > 0).sum()), (0.5, 0.6, 0.7))
    for i in range(3):
        m.totals.append(seen.vector())
        assert (every.vector() == seen.vector()).all()
        every.sweep(m.totals[-1], m, i)
        seen.sweep(m.totals[-1], m, i)
    tot = seen.vector()
    sc = lm.Scorer(None, m)
    sc.seats, sc.samples = seen, [(lm._totals(tot), seen.probabilities(tot, m))]
    want = [sc.token_scores(x[a:a + 1], np.ones(1, int), np.array([b]))[0][0] for a, b in zip(w, u, strict=True)]
    assert np.log10(every.probabilities(tot, m)[2]) == pytest.approx(np.array(want))
