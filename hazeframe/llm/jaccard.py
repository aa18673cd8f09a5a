"""Exact n-gram Jaccard self-join with signature trees: near-duplicate classes at similarity 0.75.

A document is the set of its distinct 5-word shingles (64-bit hashes). Documents of equal sets form
one node (``sid``, a hash of set and size). Two nodes link when ``7 * |x & y| >= 3 * (|x| + |y|)``,
which is Jaccard >= 0.75.

Signature tree: members of a group are sorted by size and packed into leaves, leaves into inner
nodes. A node holds the OR of its members' token bitmaps, their size range and the largest
excess (tokens minus set bits). For any x below A and y below B::

    |x & y| <= popcount(bits A & bits B) + min(excess A, excess B)

A dual traversal from (root, root) drops node pairs whose bound is below what the smallest sizes
need, whose size ranges are too far apart, or whose members are all in one component already.
What is left at the leaves is verified on the exact sets.

Which documents meet in a group is exact, too (prefix filter): in any total order of tokens, two
linked sets share one of their first ``n - ceil(0.75 n) + 1`` tokens. The order is by hash, with
tokens that many documents share last; that choice only moves work, never results.

Rounds:

* Keys: groups by the eight smallest token hashes; few rows, merges nearly all copies. Candidates
  that could unite a group's components are verified on the exact sets and united.
* Prefixes: all prefix tokens that still touch two components, found by a shuffle of packed arrays,
  with the sets whose sizes and places of the token let it be the first one they share.
  The traversal looks for every pair of different components that passes the bound and names, for
  each, the larger component and the other set that may link with it: (component, set), never the
  pair. The members of every named component then meet its named sets in blocks and are compared
  exactly, one link at most per set and block. After it no link can be missing.

Groups of more than ``BLOCK`` members are split into blocks by hash; the first round looks inside
blocks, the second at all block pairs. Links, components and sets never pass the driver.

Defined cases: null or empty text is a component of its own; a row without doc_id links with
nothing (its component_id is null) and stays; rows that repeat a doc_id count as one document, so they
stay or go together; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.llm import text as X
from hazeframe.llm.components import connected_components
from hazeframe.llm.store import pin

KEYS = 8
BLOCK = 2048
VERIFY = 512  # sets of either side in a verification block
LEAF, FANOUT = 16, 8
COMMON_CHUNK, COMMON_TOTAL = 4, 24  # a common token: in 4 sets of a chunk, and in 24 over all chunks
CHUNK_TOKENS = 2_000_000
CHUNK_POSTINGS = 1_000_000
MAX_COMMON = 500_000  # bounds the list of common tokens; the rest keep their hash order
SHARD_POSTINGS = 500_000
BROADCAST_ROWS = 1_000_000


# --- sets, signatures ------------------------------------------------------------------------------

def _sid(s: np.ndarray) -> int:
    """64-bit id of a token set (sum and xor of its hashes, mixed with its size)."""
    a = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], np.uint64)
    a = X.mix(a + np.uint64(len(s)))
    return int(X.mix(a[:1] ^ (a[1:] * np.uint64(0x9E3779B97F4A7C15)))[0].astype(np.int64))


def token_sets(batches, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows with the sorted distinct shingle hashes of every row."""
    for rb, data, off in X.slices(batches, column):
        w, wo = X.word_hashes(data, off)
        yield rb, [np.unique(X.shingles(w[wo[i]:wo[i + 1]])) for i in range(len(off) - 1)]


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, 3 to 6 times n, at least 4096 (small
    sets get a bound that is nearly exact for little space)."""
    return max(4096, 1 << int(3 * n - 1).bit_length())


def signature(s: np.ndarray) -> np.ndarray:
    w = width(len(s))
    bits = np.zeros(w, bool)
    bits[(s & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a wider class, folded to ``words`` 64-bit words (last axis)."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


class SignatureTree:
    """Nodes over members of one width class: OR bitmap, size range, largest excess."""

    def __init__(self, sizes: np.ndarray, sigs: np.ndarray, index: np.ndarray):
        """``index``: the members' places in the group, ascending by size."""
        self.index, self.sizes, self.sigs = index, sizes, sigs
        self.excess = sizes - np.bitwise_count(sigs).sum(1).astype(np.int64)
        at = np.arange(0, len(index), LEAF)
        self.levels = [self._node(sigs, sizes, sizes, self.excess, at)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, ex = self.levels[-1]
            self.levels.append(self._node(bits, lo, hi, ex, np.arange(0, len(bits), FANOUT)))

    @staticmethod
    def _node(bits, lo, hi, ex, at):
        return (np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at),
                np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at))

    def folded(self, words: int) -> SignatureTree:
        return self if self.sigs.shape[1] == words else SignatureTree(self.sizes, fold(self.sigs, words), self.index)


def _may(bits_a, lo_a, hi_a, ex_a, bits_b, lo_b, hi_b, ex_b) -> np.ndarray:
    """Which of the paired nodes can hold a linked pair."""
    near = (4 * hi_a >= 3 * lo_b) & (4 * hi_b >= 3 * lo_a)
    most = np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64) + np.minimum(ex_a, ex_b)
    return near & (7 * most >= 3 * (lo_a + lo_b))


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, one_component=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member pairs (places in the group) that pass every bound, in small batches.

    ``one_component(x, y)`` may drop a node pair's members; it is asked right before they are compared.
    """
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        la, lb, i, j = stack.pop()
        na, nb = a.levels[la], b.levels[lb]
        ok = _may(*(x[i] for x in na), *(x[j] for x in nb))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            for p, q in zip(i, j, strict=True):
                x = np.arange(p * LEAF, min((p + 1) * LEAF, len(a.index)))
                y = np.arange(q * LEAF, min((q + 1) * LEAF, len(b.index)))
                if one_component is not None and one_component(a.index[x], b.index[y]):
                    continue
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                if same:
                    up = x < y
                    x, y = x[up], y[up]
                good = _may(a.sigs[x], a.sizes[x], a.sizes[x], a.excess[x], b.sigs[y], b.sizes[y], b.sizes[y], b.excess[y])
                if good.any():
                    yield a.index[x[good]], b.index[y[good]]
            continue

        def kids(nodes, level, tree):
            n = len(tree.levels[level - 1][0])
            first = nodes * FANOUT
            return first, np.minimum(first + FANOUT, n) - first

        # open the higher side (both, if level), keeping each unordered pair once
        fa, ca = kids(i, la, a) if la >= lb and la else (i, np.ones_like(i))
        fb, cb = kids(j, lb, b) if lb >= la and lb else (j, np.ones_like(j))
        per = ca * cb
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        ni = np.repeat(fa, per) + k // np.repeat(cb, per)
        nj = np.repeat(fb, per) + k % np.repeat(cb, per)
        la2, lb2 = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        if same and la2 == lb2:
            up = ni <= nj
            ni, nj = ni[up], nj[up]
        # pairs near the diagonal first: similar members merge early
        order = np.argsort(-np.abs(ni - nj), kind="stable") if same else np.arange(len(ni))
        for part in np.array_split(order, max(1, len(order) // 4096)):
            stack.append((la2, lb2, ni[part], nj[part]))


class _Union:
    def __init__(self, comps: list[int]):
        self.up = {c: c for c in comps}

    def find(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _leaf_pairs(size, sigs, comp, side, order) -> Iterator[tuple[int, int]]:
    """Places of the pairs that pass the bound in a group that fits one leaf, bitmaps as integers."""
    bits = [int.from_bytes(x.tobytes(), "little") for x in sigs]
    wide = [64 * len(x) for x in sigs]
    spare = [n - b.bit_count() for n, b in zip(size, bits, strict=True)]
    for k, y in enumerate(order):
        n = size[y]
        for x in reversed(order[:k]):  # close sizes first
            m = size[x]
            if 4 * m < 3 * n:
                break
            if comp[x] == comp[y] or (side is not None and side[x] == side[y]):
                continue
            b, ex = bits[y], spare[y]
            if wide[y] != wide[x]:  # at most twice as wide
                half = wide[y] // 2
                b = (b >> half) | (b & ((1 << half) - 1))
                ex = n - b.bit_count()
            if 7 * ((bits[x] & b).bit_count() + min(spare[x], ex)) >= 3 * (m + n):
                yield x, y


def _tree_pairs(size, sigs, order, together) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that pass the bound, by dual traversal of one tree per bitmap width."""
    n = np.array(size)
    by_width: dict[int, list[int]] = {}
    for i in order:
        by_width.setdefault(len(sigs[i]), []).append(i)
    trees = {w: SignatureTree(n[ix], np.stack([sigs[i] for i in ix]), np.array(ix)) for w, ix in by_width.items()}
    for w, t in sorted(trees.items()):
        for w2 in (w, 2 * w):  # sets of the ratio 3 : 4 are at most one width apart
            if w2 in trees:
                yield from dual_traversal(t, trees[w2].folded(w), w2 == w, together)


def spanning_pairs(sid: list[int], comp: list[int], size: list[int], sigs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sids of one group that pass the bound; a pair only if it could unite two components
    not yet united by an earlier one."""
    order = sorted(range(len(sid)), key=lambda i: (size[i], sid[i]))
    uf = _Union(comp)
    out: list[tuple[int, int]] = []

    def take(x, y):
        if comp[x] != comp[y] and uf.join(comp[x], comp[y]):
            out.append((min(sid[x], sid[y]), max(sid[x], sid[y])))

    if len(sid) <= 2 * LEAF:
        for x, y in _leaf_pairs(size, sigs, comp, None, order):
            take(x, y)
        return out

    def together(x, y):
        c = uf.find(comp[x[0]])
        return all(uf.find(comp[i]) == c for i in x) and all(uf.find(comp[i]) == c for i in y)

    for xs, ys in _tree_pairs(size, sigs, order, together):
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            take(x, y)
    return out


def named_members(sid: list[int], comp: list[int], weight: list[int], size: list[int], sigs: list[np.ndarray],
                  side: list[int] | None = None) -> set[tuple[int, int]]:
    """(component, sid) for every pair of different components that passes the bound: the larger
    component and the other set. With ``side``, only pairs of different sides."""
    order = sorted(range(len(sid)), key=lambda i: (size[i], sid[i]))
    out: set[tuple[int, int]] = set()
    big = [(w, c) for w, c in zip(weight, comp, strict=True)]
    if len(sid) <= 2 * LEAF:
        for x, y in _leaf_pairs(size, sigs, comp, side, order):
            a, b = (x, y) if big[x] > big[y] else (y, x)
            out.add((comp[a], sid[b]))
        return out
    c, w, s = np.array(comp), np.array(weight), np.array(sid)
    sd = None if side is None else np.array(side)

    def together(x, y):
        return c[x].min() == c[x].max() == c[y].min() == c[y].max()

    for xs, ys in _tree_pairs(size, sigs, order, together):
        ok = c[xs] != c[ys]
        if sd is not None:
            ok &= sd[xs] != sd[ys]
        xs, ys = xs[ok], ys[ok]
        first = (w[xs] > w[ys]) | ((w[xs] == w[ys]) & (c[xs] > c[ys]))
        a, b = np.where(first, xs, ys), np.where(first, ys, xs)
        out.update(zip(c[a].tolist(), s[b].tolist(), strict=True))
    return out


def partnered(group: np.ndarray, n: np.ndarray, cap: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which postings have a partner of another component in their group: sizes n that neither's cap excludes.
    Postings lie in the order of group and n."""
    if not len(n):
        return np.zeros(0, bool)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    most = int(np.diff(np.append(np.flatnonzero(new), len(n))).max())
    # by doubling steps: of a posting and all before it in its group, the largest cap, its component, the largest of the others
    top, own, rest = cap.copy(), comp.copy(), np.full(len(n), -1, cap.dtype)
    step = 1
    while step < most:
        i = np.flatnonzero(np.arange(len(n)) - step >= start)
        j = i - step
        left = top[j] > top[i]
        hi, lo = np.where(left, j, i), np.where(left, i, j)
        second = np.maximum(rest[hi], np.where(own[lo] != own[hi], top[lo], rest[lo]))
        top[i], own[i], rest[i] = top[hi], own[hi], second
        step *= 2
    place, wide = np.cumsum(new), int(max(n.max(), cap.max())) + 1
    end = np.searchsorted(place * wide + n, place * wide + cap, side="right")  # those of at most cap tokens
    last = np.maximum(end - 1, 0)
    return (end > start) & (np.where(own[last] == comp, rest[last], top[last]) >= n)


def linked_with(sets: list[np.ndarray], others: Iterator[np.ndarray]) -> Iterator[int]:
    """For each of ``others`` the place of a set it links with, or -1; exact overlaps by one lookup
    of all its tokens in the sets' tokens."""
    tok = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    o = np.argsort(tok, kind="stable")
    tok, own = tok[o], own[o]
    n = np.array([len(x) for x in sets])
    for x in others:
        lo, hi = np.searchsorted(tok, x, "left"), np.searchsorted(tok, x, "right")
        k = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        hit = np.flatnonzero(7 * np.bincount(own[at], minlength=len(n)) >= 3 * (n + len(x)))
        yield int(hit[0]) if len(hit) else -1


# --- Spark steps -----------------------------------------------------------------------------------

def _summaries(docs: DataFrame) -> DataFrame:
    """One pass: (doc_id, n, sid, keys) a row, and (tok, cnt) rows of tokens common in a chunk."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0

        def common():
            nonlocal held, size
            if held:
                tok, cnt = np.unique(np.concatenate(list(held.values())), return_counts=True)
                keep = cnt >= COMMON_CHUNK
                tok, cnt = tok[keep].astype(np.int64), cnt[keep]
                held, size = {}, 0
                for at in range(0, len(tok), 100_000):
                    k = len(tok[at:at + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())),
                         pa.array(tok[at:at + 100_000]), pa.array(cnt[at:at + 100_000])], names=names)

        names = ["doc_id", "n", "sid", "keys", "tok", "cnt"]
        for rb, sets in token_sets(batches):
            sids = [_sid(s) if len(s) else 0 for s in sets]
            k = rb.num_rows
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sids, pa.int64()),
                 pa.array([s[:KEYS].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            for i, s in zip(sids, sets, strict=True):
                if i not in held:
                    held[i] = s
                    size += len(s)
            if size >= CHUNK_TOKENS:
                yield from common()
        yield from common()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n int, sid long, keys array<long>, tok long, cnt long")


def _prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(sid, n, keys, prefix, sig): every set once a task; tokens in ``common`` come last in the order."""
    def run(batches):
        seen: set[int] = set()
        for _, sets in token_sets(batches):
            rows = []
            for s in sets:
                if not len(s) or (i := _sid(s)) in seen:
                    continue
                seen.add(i)
                p = prefix_length(len(s))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hot = common[at] == s
                    order = np.concatenate((s[~hot], s[hot]))[:p]
                else:
                    order = s[:p]
                rows.append((i, len(s), s[:KEYS].astype(np.int64), order.astype(np.int64), signature(s).tobytes()))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int64())),
                     pa.array(c[3], pa.list_(pa.int64())), pa.array(c[4], pa.binary())], names=["sid", "n", "keys", "prefix", "sig"])

    return docs.select("text").mapInArrow(run, "sid long, n int, keys array<long>, prefix array<long>, sig binary")


def _held(df: DataFrame, rows: int):
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _groups(batches, columns) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, x, y) and the rows of every group of batches sorted by it."""
    now, rows = None, []
    for rb in batches:
        cols = [rb.column(rb.schema.get_field_index(c)).to_pylist() for c in ("key", "x", "y", *columns)]
        for key, x, y, *row in zip(*cols, strict=True):
            if (key, x, y) != now:
                if now is not None:
                    yield now, rows
                now, rows = (key, x, y), []
            rows.append(row)
    if now is not None:
        yield now, rows


def _longs(rows, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _spans(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that could unite components of a block."""
    def run(batches):
        for _, rows in _groups(batches, ("sid", "n", "sig")):
            sid, n, sig = zip(*rows, strict=True)
            if len(set(sid)) > 1:
                pairs = spanning_pairs(list(sid), list(sid), list(n), [np.frombuffer(g, np.uint64) for g in sig])
                if pairs:
                    yield _longs(pairs, ["a", "b"])

    dealt = members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "sid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _named(members: DataFrame) -> DataFrame:
    """Distinct (hub, sid) of all block pairs: sets that may link with the larger component hub."""
    def run(batches):
        sent: set = set()
        for (_, x, y), rows in _groups(batches, ("sid", "comp", "weight", "n", "sig", "side")):
            sid, comp, weight, n, sig, side = map(list, zip(*rows, strict=True))
            if len(set(comp)) < 2:
                continue
            found = named_members(sid, comp, weight, n, [np.frombuffer(g, np.uint64) for g in sig], side if x != y else None) - sent
            if len(sent) < 200_000:  # a local memory only; the distinct below is what counts
                sent |= found
            if found:
                yield _longs(sorted(found), ["hub", "sid"])

    dealt = members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "sid")
    return dealt.mapInArrow(run, "hub long, sid long").distinct()


def _blocks(members: DataFrame, pairs: bool) -> DataFrame:
    """Adds block coordinates to members (key, size, ...). Inside blocks only, or all block pairs."""
    nb = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), nb).cast("int")
    m = members.withColumn("_nb", nb).withColumn("side", own)
    if not pairs:
        return m.withColumn("x", F.col("side")).withColumn("y", F.col("side")).drop("_nb", "size")
    both = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1),
                       lambda o: F.struct(F.least(o, F.col("side")).alias("x"), F.greatest(o, F.col("side")).alias("y")))
    return m.select("*", F.inline(both)).drop("_nb", "size")


def _sets(wanted: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, s): the exact token sets of the distinct ``sid`` of wanted, from one document each."""
    wanted = pin(wanted, "wanted")
    n = wanted.count()  # and at most as many documents
    rep = pin(ids.join(_held(wanted, n), "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "reps")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_held(rep, n), "doc_id")

    def run(batches):
        for rb, got in token_sets(batches):
            real = [_sid(s) if len(s) else 0 for s in got]
            ok = [i for i, (r, w) in enumerate(zip(real, rb.column(2).to_pylist(), strict=True)) if r == w]
            yield pa.RecordBatch.from_arrays([pa.array([real[i] for i in ok], pa.int64()),
                                              pa.array([got[i].tobytes() for i in ok], pa.binary())], names=["sid", "s"])

    return some.select("doc_id", "text", "sid").mapInArrow(run, "sid long, s binary")


def _verify_pairs(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact sets link. A pair's first set travels once with all its partners."""
    pairs = pin(pairs, "pairs")
    n = pairs.count()
    s = _sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), docs, ids)
    # partners of a much used set are dealt to parts, each with a copy of the set
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFY).cast("int").alias("parts"))
    dealt = pairs.join(_held(parts, n), "a").select(
        "a", F.col("b").alias("sid"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    other = s.join(_held(dealt, n), "sid").select("a", F.col("sid").alias("b"), "s", "part")
    own = s.join(_held(parts.withColumnRenamed("a", "sid"), n), "sid").select(
        F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(batches):
        now, x = None, None
        for rb in batches:
            keep = []
            for a, b, part, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(3).to_pylist(), rb.column(2), strict=True):
                y = np.frombuffer(t.as_py(), np.uint64)
                if b is None:
                    now, x = (a, part), y
                elif (a, part) == now and 7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)):
                    keep.append((a, b))
            if keep:
                yield _longs(keep, ["a", "b"])

    laid = other.union(own).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return laid.mapInArrow(run, "a long, b long")


def _verify_hubs(named: DataFrame, comps: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (a, b) between a component's members (role 0) and the sets named with it (role 1)."""
    hubs = named.select("hub").distinct()
    members = hubs.select("hub", F.col("hub").alias("sid")).union(  # a component is named by one of its sets
        hubs.join(comps.where("node <> comp"), hubs["hub"] == comps["comp"]).select("hub", "node"))
    named = pin(named.withColumn("role", F.lit(1)).unionByName(members.withColumn("role", F.lit(0))), "blocks")
    s = _sets(named.select("sid").distinct(), docs, ids)
    side = lambda r: F.ceil(F.count_if(F.col("role") == r) / VERIFY).cast("int")
    grid = named.groupBy("hub").agg(side(0).alias("n0"), side(1).alias("n1"))
    n = named.count()
    dealt = s.join(_held(named.join(_held(grid, n), "hub"), n), "sid")
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("role") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)
    dealt = dealt.select("hub", "sid", "role", "s", own.alias("own"), F.explode(every).alias("all")).select(
        F.col("hub").alias("key"), F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("all")).alias("x"),
        F.when(F.col("role") == 0, F.col("all")).otherwise(F.col("own")).alias("y"), "role", "sid", "s")

    def run(batches):
        for _, rows in _groups(batches, ("role", "sid", "s")):
            here = [(i, np.frombuffer(t, np.uint64)) for r, i, t in rows if r == 0]
            there = [(i, np.frombuffer(t, np.uint64)) for r, i, t in rows if r == 1]
            if here and there:
                hits = linked_with([t for _, t in here], (t for _, t in there))
                links = [(min(i, here[k][0]), max(i, here[k][0])) for (i, _), k in zip(there, hits, strict=True) if k >= 0]
                if links:
                    yield _longs(links, ["a", "b"])

    laid = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "role", "sid")
    return laid.mapInArrow(run, "a long, b long")


def _with_comp(df: DataFrame, comps: DataFrame, rows: int) -> DataFrame:
    """Adds ``comp`` (the sid itself where it links with nothing); ``rows`` is the size of comps."""
    c = comps.select(F.col("node").alias("sid"), "comp")
    return df.join(_held(c, rows), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, bytes of one significance together: small numbers compress."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _mixed_tokens(prefixes: DataFrame, comps: DataFrame, n_comps: int) -> DataFrame:
    """(tok, size, sids): prefix tokens with the sets that may link there with a set of another component.

    The first token that two linked sets share leaves either enough tokens: a set of n tokens with i of its
    prefix before it has a partner of at most (4 n - 7 i) / 3 tokens there. A set without such a partner in a
    token's group is left out of it, as it meets all its links at other tokens.

    Tokens with the same sets (a passage shared by some documents gives many) would ask for the same
    pairs; one token stays for each distinct group of sets. Postings travel as packed arrays, one
    row per (chunk of sets, shard of tokens); components only where they differ from the set id.
    """
    total = prefixes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    shards = max(64, int(total // SHARD_POSTINGS))

    def packed(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            t, i, c, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            s = (t % np.uint64(shards)).astype(np.int64)
            o = np.argsort(s, kind="stable")
            t, i, c, n, at, s = t[o], i[o], c[o], n[o], at[o], s[o]
            cut = np.searchsorted(s, np.arange(shards + 1))

            def row(k):
                a, b = cut[k], cut[k + 1]
                own = np.flatnonzero(i[a:b] != c[a:b])
                return (k, t[a:b].tobytes(), i[a:b].tobytes(), _planes(n[a:b]), _planes(at[a:b]),
                        own.astype(np.int32).tobytes(), c[a:b][own].tobytes())

            for k0 in range(0, shards, 64):
                rows = [row(k) for k in range(k0, min(k0 + 64, shards)) if cut[k + 1] > cut[k]]
                if rows:
                    x = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), *(pa.array(v, pa.binary()) for v in x[1:])],
                                                     names=["shard", "t", "s", "n", "i", "at", "c"])

        for rb in batches:
            if not rb.num_rows:
                continue
            p = rb.column(0)
            k = np.diff(np.asarray(p.offsets))
            sid, comp, n = (np.repeat(rb.column(x).to_numpy(zero_copy_only=False), k) for x in (1, 2, 3))
            held.append((p.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), sid, comp, n,
                         np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)))
            size += len(sid)
            if size >= CHUNK_POSTINGS:
                yield from flush()
        if size:
            yield from flush()

    def mixed(batches):
        now, held = None, []

        def flush():
            t, i, c, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.lexsort((i, n, t))
            o = o[np.concatenate(([True], (t[o][1:] != t[o][:-1]) | (i[o][1:] != i[o][:-1])))]  # copies of a set count once
            a = np.concatenate(([0], np.flatnonzero(t[o][1:] != t[o][:-1]) + 1))
            more = np.minimum.reduceat(c[o], a) != np.maximum.reduceat(c[o], a)
            o = o[np.repeat(more, np.diff(np.append(a, len(o))))]
            o = o[partnered(t[o], n[o], (4 * n[o] - 7 * at[o]) // 3, c[o])]
            t, i = t[o], i[o]
            o = np.lexsort((i, t))
            t, i = t[o], i[o]
            a = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
            k = np.diff(np.append(a, len(t)))
            group = np.add.reduceat(X.mix(i.astype(np.uint64)), a) if len(a) else t
            _, one = np.unique(np.stack((group, k.astype(np.uint64))), axis=1, return_index=True)  # the least token first
            one.sort()
            for at in range(0, len(one), 10_000):
                u = one[at:at + 10_000]
                take = np.repeat(a[u] - np.cumsum(k[u]) + k[u], k[u]) + np.arange(k[u].sum())
                sids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k[u]))), pa.int32()), pa.array(i[take], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(t[a[u]].astype(np.int64)), pa.array(k[u], pa.int64()),
                                                  pa.array(group[u].astype(np.int64)), sids], names=["tok", "size", "members", "sids"])

        for rb in batches:
            for shard, t, s, n, i, at, c in zip(*(x.to_pylist() for x in rb.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield from flush()
                    now, held = shard, []
                s = np.frombuffer(s, np.int64)
                full = s.copy()
                full[np.frombuffer(at, np.int32)] = np.frombuffer(c, np.int64)
                held.append((np.frombuffer(t, np.uint64), s, full, _from_planes(n), _from_planes(i)))
        if now is not None:
            yield from flush()

    rows = _with_comp(prefixes, comps, n_comps).select("prefix", "sid", "comp", "n").mapInArrow(
        packed, "shard int, t binary, s binary, n binary, i binary, at binary, c binary")
    found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(mixed, "tok long, size long, members long, sids array<long>")
    return found.groupBy("members", "size").agg(F.min(F.struct("tok", "sids")).alias("m")).select("m.tok", "size", "m.sids")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, comp) of every row; comp is null for documents without words or without id."""
    one = pin(_summaries(docs), "sets")
    rows = one.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    ids = rows.where("doc_id is not null and n > 0")
    docs = docs.where("doc_id is not null")
    one = one.where("doc_id is not null or tok is not null")
    common = (one.where(F.col("tok").isNotNull()).groupBy("tok").agg(F.sum("cnt").alias("c")).where(F.col("c") >= COMMON_TOTAL)
              .orderBy(F.desc("c"), "tok").limit(MAX_COMMON).select("tok").toArrow())
    common = np.sort(common.column(0).to_numpy().astype(np.uint64)) if common.num_rows else np.zeros(0, np.uint64)
    pre = pin(_prefixes(docs, common), "prefixes")

    # keys: the smallest hashes
    keyed = one.where(F.col("n") > 0).select("sid", F.explode("keys").alias("key")).distinct()
    shared = pin(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    held = _held(shared, shared.count())
    members = pre.select("sid", "n", "sig", F.explode("keys").alias("key")).join(held, "key")
    links = pin(_verify_pairs(_spans(_blocks(members, False)), docs, ids), "links")
    comps = pin(connected_components(links), "comps")

    # prefixes: tokens that still touch two components
    n_comps = comps.count()
    mixed = pin(_mixed_tokens(pre, comps, n_comps), "tokens")
    n_met = mixed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if n_met:
        met = mixed.select(F.col("tok").alias("key"), "size", F.explode("sids").alias("sid"))
        tokens = pre.select("sid", "n", "sig").join(_held(met, n_met), "sid")
        weight = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
        weighed = comps.join(weight, "comp").withColumnRenamed("node", "sid")
        live = tokens.join(_held(weighed, n_comps), "sid", "left").withColumns(
            {"comp": F.coalesce("comp", "sid"), "weight": F.coalesce("weight", F.lit(1))})
        named = pin(_named(_blocks(live, True)), "named")
        more = pin(_verify_hubs(named, comps, docs, ids), "links")
        if more.limit(1).count():
            comps = pin(connected_components(links.union(more)), "comps")
            n_comps = comps.count()
    full = _with_comp(ids, comps, n_comps).select("doc_id", "n", "comp")
    return full.union(rows.where("doc_id is null or n = 0").select("doc_id", "n", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    c = pin(classes(docs), "classes")
    least = c.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = c.where(F.col("comp").isNotNull()).join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.union(c.where(F.col("comp").isNull()).select("doc_id", F.col("n").cast("long"), "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id stays."""
    d = near_duplicates(docs).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    d = pin(d, "drops")
    return docs.join(_held(d, d.count()), "doc_id", "left_anti").select(*docs.columns)
