"""Best-fit packing: length patterns fitted by non-negative least squares, residuals by best fit.

Documents are tokenised, ended by id 2, and pieces of at most ``limit`` tokens are packed into
sequences. Only longer documents are cut; their first piece takes the remainder, so all others are
full. Steps:

1. one map over the texts yields a row per piece (pinned in the shared folder);
2. the histogram of piece lengths (at most ``limit`` rows) goes to the driver;
3. patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts
   are fitted to the histogram by non-negative least squares (accelerated projected gradient) and
   rounded so that no length is overdrawn;
4. what is left is packed by best fit, longest first, on length counts (all pieces of one length
   at a time), which opens the remaining patterns;
5. every piece is numbered inside its length (per salt group, plus offsets on the small table of
   group counts), and its number decides pattern, sequence and offset by a table lookup.

The driver holds histograms and patterns only: their size depends on ``limit``, not on the data.

Ids: the byte-level BPE vocabulary ``byte_bpe_50k`` through the rank encoder, which gives the ids of
the ``byte_bpe_50k.json`` tokenizer at its default settings (tested) at about five times its speed; its
special token ``<|endoftext|>`` in a text is one token, as there.

Defined cases: null text = empty text = one piece holding id 2 only; null and repeated doc_id rows
are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.llm.store import pin

LIMIT = 1024
END_ID = 2
ROWS_PER_GROUP = 200_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # the added tokens of the JSON tokenizer
_ENCODERS: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The rank encoder of a vocabulary file (kept per worker)."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def token_ids(text: str | None, path: str, end_id: int = END_ID, special: frozenset[str] = frozenset()) -> np.ndarray:
    """Ids of a text and the end id; strings in ``special`` are read as special tokens, others as ordinary text."""
    ids = encoder(path).encode_to_numpy(text or "", allowed_special=special, disallowed_special=())
    return np.concatenate((ids.astype("<u4"), np.array([end_id], "<u4")))


def cuts(n: int, limit: int = LIMIT) -> list[int]:
    """Start positions of the pieces of a document of n tokens; the first takes the remainder."""
    if n <= limit:
        return [0]
    rest = n % limit
    return ([0] if rest else []) + list(range(rest, n, limit))


def tokenized_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a pure map over the texts."""
    special = frozenset(SPECIAL)

    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                rows: list[tuple] = []
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = token_ids(body, path, end_id, special)
                    c = cuts(len(ids), limit)
                    for i, (s, e) in enumerate(zip(c, [*c[1:], len(ids)], strict=True)):
                        rows.append((doc, i, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- patterns --------------------------------------------------------------------------------------

def fill_patterns(hist: np.ndarray) -> np.ndarray:
    """All patterns of one to three present lengths (ascending, 0 = none) that sum to the limit."""
    limit = len(hist) - 1
    has = np.flatnonzero(hist)
    has = has[has > 0]
    out = [np.array([[0, 0, limit]])] if hist[limit] else []
    a = has[(has * 2 <= limit)]
    pair = a[hist[limit - a] > 0]
    out.append(np.stack([np.zeros_like(pair), pair, limit - pair], 1))
    for x in has[has * 3 <= limit]:
        y = has[(has >= x) & (x + 2 * has <= limit)]
        y = y[hist[limit - x - y] > 0]
        out.append(np.stack([np.full_like(y, x), y, limit - x - y], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def nnls(patterns: np.ndarray, hist: np.ndarray, steps: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squared misfit of the length histogram.

    Long pieces weigh more: they are the hardest to place later. Nesterov steps with projection and
    restart; every step is a sparse product (three entries a pattern).
    """
    n = len(hist)
    target = hist.astype(float)
    weight = 0.3 + np.arange(n) / n
    weight[0] = 0.0
    member = np.bincount(patterns.ravel(), minlength=n).astype(float)
    # Jacobi scaling keeps one step size valid for all patterns
    scale = 1.0 / np.maximum(1.0, (weight**2 * member)[patterns]).sum(1)
    x = np.zeros(len(patterns))
    y, t, last = x.copy(), 1.0, np.inf
    for _ in range(steps):
        fit = np.bincount(patterns.ravel(), np.repeat(y, 3), n)
        miss = weight**2 * (fit - target)
        miss[0] = 0.0
        grad = miss[patterns].sum(1)
        new = np.maximum(0.0, y - scale * grad)
        cost = float((miss * (fit - target)).sum())
        if cost > last:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        y = np.maximum(y, 0.0)
        x, t, last = new, t2, cost
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern as ((length, copies), ...), repeats)] that uses up the histogram exactly.

    ``hist[l]`` is the number of pieces of length l; the limit is ``len(hist) - 1``.
    """
    limit = len(hist) - 1
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def use(lengths, count):
        need = defaultdict(int)
        for v in lengths:
            if v:
                need[int(v)] += 1
        count = min([count, *(int(left[v]) // m for v, m in need.items())])
        if count > 0:
            for v, m in need.items():
                left[v] -= m * count
            out.append((tuple(sorted(need.items(), reverse=True)), count))

    pats = fill_patterns(hist)
    if len(pats):
        x = nnls(pats, hist)
        whole, part = np.floor(x + 1e-9).astype(np.int64), x - np.floor(x + 1e-9)
        for i in np.flatnonzero(whole):
            use(pats[i], int(whole[i]))
        for i in np.argsort(-part, kind="stable"):
            if part[i] < 0.05:
                break
            use(pats[i], 1)
    # residuals: best fit, longest first, all pieces of a length at a time
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [[contents, bins]]
    for v in range(limit, 0, -1):
        n = int(left[v])
        while n:
            room = next((r for r in range(v, limit) if open_.get(r)), 0)
            if not room:
                per = limit // v
                bins = max(1, n // per)
                put = min(n, per)
                # a new bin takes one piece; further equal pieces come back to it by best fit
                bins, put = (n, 1) if per == 1 else (bins, put)
                open_[limit - put * v].append([((v, put),), bins])
                n -= bins * put
                continue
            have, bins = open_[room].pop()
            put = min(n, room // v)
            take = min(bins, n // put)
            if take < bins:
                open_[room].append([have, bins - take])
            open_[room - put * v].append([(*have, (v, put)), take])
            n -= take * put
    for groups in open_.values():
        out += [(tuple(h), b) for h, b in groups]
    return out


def _lookup(patterns) -> dict[str, np.ndarray]:
    """Slots of every length in pattern order: first piece number, copies, first sequence, offset."""
    rows, seq, used = [], 0, defaultdict(int)
    for content, count in patterns:
        at = 0
        for v, m in content:
            rows.append((v, used[v], m, seq, at))
            used[v] += m * count
            at += v * m
        seq += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "first": a[:, 1], "copies": a[:, 2], "seq": a[:, 3], "offset": a[:, 4]}


def pack(pieces: DataFrame, limit: int = LIMIT, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to a pinned table of pieces (doc_id, piece, length, ...)."""
    hist = np.zeros(limit + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``limit`` rows
        hist[r["length"]] = r["n"]
    look = _lookup(plan(hist))
    groups = max(64, int(hist.sum()) // rows_per_group)  # a hot length is numbered in many groups
    named = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = named.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    order = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (named.withColumn("_r", F.row_number().over(order)).join(sizes, ["length", "_g"])
              .select(*pieces.columns, (F.col("_b") + F.col("_r") - 1).alias("_k")))
    key = look["length"] << 44  # numbers inside a length stay below 2^44
    starts = key + look["first"]

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            k = rb.column(rb.schema.get_field_index("_k")).to_numpy()
            v = rb.column(rb.schema.get_field_index("length")).to_numpy()
            i = np.searchsorted(starts, (v << 44) + k, side="right") - 1
            j = k - look["first"][i]
            seq = look["seq"][i] + j // look["copies"][i]
            off = look["offset"][i] + (j % look["copies"][i]) * v
            keep = [n for n in rb.schema.names if n != "_k"]
            yield pa.RecordBatch.from_arrays([*(rb.column(n) for n in keep), pa.array(seq), pa.array(off)],
                                             names=[*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pin(tokenized_pieces(docs, path or vocabulary_path(), limit), "pieces"), limit)
