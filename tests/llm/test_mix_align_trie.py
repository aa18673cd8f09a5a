"""Source mixing, tokenizer alignment and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import alignment as AL
from hazeframe.llm import mixing as MX
from hazeframe.llm import trie as TR
from tests.llm.conftest import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


# ---- mixing -----------------------------------------------------------------------------------

def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes: dict, ratio=1.5, most=2.0, cycle=(5, 2, 1)) -> dict:
    """Clamping and resharing round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    want, fixed = {}, {}
    while True:
        left = ratio * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        want = fixed | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s: most * sizes[s] for s in open_ if want[s] >= most * sizes[s]}
        if not above:
            return want
        fixed |= above
        if len(fixed) == len(order):
            return fixed


def mix_rows(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    if extra:
        for c in ("size", "target", "taken", "place", "of", "whole", "cut"):
            df = df.withColumn(c, F.lit(f"extra {c}"))
    return df


def check_mix(got, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    want = targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    return taken, want, sizes


def test_mix_meets_capped_targets_to_the_word(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.choice((0, 3, 40, 900)))), rng.choice(["a"] * 9 + ["b", "ä", "", "Z", None])) for i in range(900)]
    rows += [(None, None, "a"), (5000, "only", "lone"), (5001, "", "blank")]
    got = MX.mix(mix_rows(spark, rows, extra=True)).collect()
    taken, want, _ = check_mix(got, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, s
    again = {(r.doc_id, r.taken) for r in MX.mix(mix_rows(spark, rows)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}  # reruns agree


def test_mix_whole_and_fractional_repetitions(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 1 + i % 50)), "x") for i in range(400)]  # one source: 1.5 repetitions
    got = MX.mix(mix_rows(spark, rows)).collect()
    kinds = Counter("whole" if r.taken == r["size"] else "twice" if r.taken == 2 * r["size"] else "cut" for r in got)
    assert kinds["cut"] <= 1 and kinds["whole"] > 100 and kinds["twice"] > 100


def test_mix_repeated_rows_share_the_cut(spark):
    rows = [(7, "a b c d e", "x")] * 30 + [(None, "f g", "y")] * 9
    got = MX.mix(mix_rows(spark, rows)).collect()
    taken, want, sizes = check_mix(got, rows)
    for s in want:
        assert want[s] - 30 <= taken[s] <= want[s] + 1


def test_mix_given_weights_and_texts(spark):
    rng = random.Random(5)
    rows = [(i, "\t" * (i % 2) + "  \n ".join(words(rng, 20)) + " ", s) for i, s in enumerate(["p", "q", "r", "p", "q", "r", "p"])]
    w = spark.createDataFrame([("p", 1.0), ("q", 3.0), ("r", None), ("absent", 9.0)], "source string, weight double")
    docs = mix_rows(spark, rows)
    by = {r.source: r.target for r in MX.mix(docs, w, ratio=0.5).collect()}
    assert by == {"p": pytest.approx(30.0), "q": pytest.approx(40 * 1.0), "r": 0.0} or by["r"] == 0.0
    assert sum(by.values()) == pytest.approx(70.0)
    taken = {r.doc_id: r.taken for r in MX.mix(docs, w, ratio=0.5).collect()}
    texts = defaultdict(int)
    for r in MX.mixed_texts(docs, w, ratio=0.5).collect():
        texts[r.doc_id] += n_words(r.text)
        assert dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert texts == {i: n for i, n in taken.items() if n}


def test_mix_empty_table_and_sources_without_words(spark):
    assert MX.mix(mix_rows(spark, [])).collect() == []
    got = MX.mix(mix_rows(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert MX.mixed_texts(mix_rows(spark, [(1, None, "a")])).collect() == []


def test_mix_plan_has_no_python(spark):
    rows = MX._rows(mix_rows(spark, [(1, "a b", "s")]), 1)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- alignment --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def byte_table():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(tokenizer, pieces, text):
    """(A ids, B ids, links, groups) by interval overlap, two pointers nowhere."""
    table = byte_table()
    if not text:
        return [], [], [], []
    enc = tokenizer.encode(" " + text, add_special_tokens=False)
    a = enc.ids
    ab = [bytes(table[c] for c in tokenizer.id_to_token(i)) for i in a]
    b = pieces.encode(text)
    bb = []
    for i in b:
        p = pieces.id_to_piece(i)
        bb.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return [], [], [], []
    ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
    owner = defaultdict(set)
    sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
    at_a = [k for k, x in enumerate(ab) for _ in x]
    at_b = [k for k, x in enumerate(bb) for _ in x]
    links = sorted(set(zip(at_a, at_b)))
    cuts = sorted(set(ea) & set(eb))
    groups, last = [], 0
    for c in cuts:
        groups.append(([a[k] for k in range(len(a)) if last <= sa[k] < c], [b[k] for k in range(len(b)) if last <= sb[k] < c]))
        last = c
    del owner
    return a, b, [(a[i], b[j]) for i, j in links], groups


def plain_rows(tokenizer, pieces, pairs):
    got = [(i, *plain_alignment(tokenizer, pieces, t)) for i, t in pairs]
    count = Counter(x for _, _, _, links, _ in got for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, links, groups in got:
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(s.encode()).hexdigest() if a else ""))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_alignment_matches_interval_overlap(spark, docs_of, json_tokenizer):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    alphabet = ["the", "ing", " ", "\n", "  ", "é", "文字", "ß", "0", "12", "\t", "<|endoftext|>", "</s>", "<s>", "<0x41>", "Ünï", "👩‍👩‍👧", "x" * 40, "'ll", "　", "A"]
    pairs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    pairs += [(100, None), (101, ""), (102, "has ▁ in it"), (103, " "), (None, "no id"), (None, "no id"), (104, pairs[3][1]), (105, "a")]
    pairs += [(106, " ".join(words(rng, 1500)))]  # many lanes
    got = sorted((tuple(r) for r in AL.align(docs_of(pairs, extra=True), chunk_bytes=700).collect()), key=key)
    assert got == sorted(plain_rows(json_tokenizer, pieces, pairs), key=key)
    whole = sorted((tuple(r) for r in AL.align(docs_of(pairs)).collect()), key=key)
    assert whole == got  # batches change nothing


def test_lanes_change_nothing():
    rng = np.random.default_rng(2)
    ends_a, ends_b, off, base = [], [], [0], 0
    for _ in range(7):
        n = int(rng.integers(1, 400))
        a = np.unique(np.append(rng.integers(1, n + 1, n), n))
        b = np.unique(np.append(rng.integers(1, n + 1, n // 2 + 1), n))
        ends_a.append(a + base)
        ends_b.append(b + base)
        off.append(off[-1] + len(a))
        base += n
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    want = AL.lockstep(a, b, np.array(off), lane=10 ** 9)
    for lane in (1, 2, 7, 64):
        for x, y in zip(AL.lockstep(a, b, np.array(off), lane=lane), want):
            assert np.array_equal(x, y)


def test_rank_encoder_equals_the_json_tokenizer_on_whole_documents(spark, json_tokenizer):
    t = AL.tokens(AL.vocabulary_path(AL.A_VOCABULARY), AL.vocabulary_path(AL.B_VOCABULARY))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for x in texts:
        assert t.a.encode_ordinary(" " + x) == json_tokenizer.encode(" " + x, add_special_tokens=False).ids


def test_alignment_links_and_empty_tables(spark, docs_of):
    docs = docs_of({1: "Hello there", 2: None, 3: "▁"})
    rows = AL.links(docs).orderBy("a_pos", "b_pos").collect()
    assert {r.doc_id for r in rows} == {1} and [r.group for r in rows] == sorted(r.group for r in rows)
    d = AL.align(docs).where("doc_id = 1").first()
    assert len(rows) == d.n_links and len({r.group for r in rows}) == d.n_groups
    assert AL.align(docs_of([])).collect() == []
    assert AL.links(docs_of([])).collect() == []
    none = AL.align(docs_of({1: None, 2: ""})).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_packs_bounded_rows(spark, docs_of, json_tokenizer, monkeypatch):
    import pyarrow.parquet as pq
    import public_tokenizers
    import sentencepiece

    rng = random.Random(12)
    pairs = [(i, "".join(rng.choices("abcdefghij klmno  pqrstuvwxyz", k=3000))) for i in range(2000)]  # more than one batch
    kept = []
    monkeypatch.setattr(AL, "pin", lambda df, *a, f=AL.pin: kept.append(f(df, *a)) or kept[-1])
    got = {r.doc_id: tuple(r) for r in AL.align(docs_of(pairs).coalesce(1)).collect()}
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in kept[0].inputFiles()]
    groups = [f.read_row_group(k) for f in files for k in range(f.num_row_groups)]
    assert max(g.nbytes for g in groups) < 12 << 20  # what a reader holds at once
    assert max(g.slice(k, 1).nbytes for g in groups for k in range(g.num_rows)) < 4 << 20
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(got) == len(pairs)
    for want in plain_rows(json_tokenizer, pieces, pairs[:5]):  # what does not depend on the other documents
        assert got[want[0]][:5] == want[:5] and got[want[0]][7] == want[7]


def test_alignment_streams_pairs_of_many_batches(spark, docs_of, json_tokenizer, monkeypatch):
    import public_tokenizers
    import sentencepiece

    rng = random.Random(13)
    pairs = [(i, None if i % 7 == 0 else " ".join(words(rng, rng.randrange(1, 80)))) for i in range(300)]
    monkeypatch.setattr(AL, "PAIRS_A_ROW", 5, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # pairs and documents of a batch come in several
    try:
        got = sorted(tuple(r) for r in AL.align(docs_of(pairs).repartition(3), chunk_bytes=3000).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert got == sorted(plain_rows(json_tokenizer, pieces, pairs))


# ---- trie -------------------------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [y[2:] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    for c in ("depth", "pos", "h1", "length", "n_convs", "part"):
        df = df.withColumn(c, F.lit(f"extra {c}"))
    return sorted(tuple(r) for r in TR.prefix_trie(df).collect())


def test_trie_matches_plain_python(spark):
    rng = random.Random(6)
    rows = []
    for c in list(range(140)) + [250, 399, 1_000_000_007]:
        first = rng.choice("ab")
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.98 else t, rng.choice(["user", None]) if t % 3 else "user", first if t < 2 else rng.choice(["x", "", None, "ü文"])))
    rows += [(7, None, "system", "before all"), (None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_long_chains_and_hot_first_turns(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 31) for t in range(3)]  # one group of copies, no head conversation
    rows += [(200, t, "user", str(t % 5)) for t in range(700)]  # one long chain
    rows += [(300 + c, t, "user", "same" if t == 0 else f"{c}") for c in range(40) for t in range(7)]  # many children of one node
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_chunks_change_nothing(spark):
    rows = [(c, t, "user", str((t * c) % 3)) for c in (1, 2, 105) for t in range(60)]
    turns = TR.rebuild(TR.numbered_turns(spark.createDataFrame(rows, TURNS)))
    a = {tuple(r) for r in TR.prefixes(turns, chunk=7).collect()}
    assert a == {tuple(r) for r in TR.prefixes(turns).collect()} and len(a) > 150


def test_trie_repeated_rows_empty_and_turnless(spark):
    rows = [(1, 1, "user", "x")] * 3 + [(2, 1, "user", "x")]
    got = trie_rows(spark, rows)
    assert got == plain_trie(rows)
    assert trie_rows(spark, []) == []
    lone = [(c, 0, "user", "only") for c in range(101, 130)]  # some keep no turn at all
    assert trie_rows(spark, lone) == plain_trie(lone)


def test_ends_of_a_hot_node_are_streamed_in_order(spark):
    ids = list(range(5, 90_000, 7))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9)], "depth long, p1 long, p2 long, conv_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.p2, r.ends_sha256) for r in TR.ends_digest(df, ["depth", "p1", "p2"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got == {(3, want), (4, hashlib.sha256(b"9").hexdigest())}
