"""Cross-tokenizer alignment: the tokens of two tokenizers linked where their byte ranges overlap.

``aligned`` encodes every text by tokenizer A (byte-level BPE) and B (piece BPE), takes the byte ends of
all tokens and merges the two sequences in lockstep: one NumPy vector holds the A and B pointers of all
lanes of a batch, each step emits a link per lane and, where both tokens end at the same byte, a cut,
then advances A, B or both; finished lanes are compacted away. A lane is a document or, in a longer one,
a run of ``LANE_TOKENS`` A tokens: it starts at the B token under its first byte, which is where the merge
of the whole document arrives, so a long text costs more lanes and not more steps.

Corpus-wide counts of id pairs: a batch of documents (``CHUNK_BYTES`` of text) numbers its distinct pairs and
packs each document's pair numbers, delta-coded, with how often it has them. Spark sums the
pairs of all batches, finds each B id's highest count, and joins both back to the batches, a row per
(batch, distinct pair). So texts are encoded once, and what is shuffled are distinct pairs of batches, which
hold no hot key: a pair stands at most once in a batch. The rows of a batch meet, its documents last, and are streamed.
No row holds a whole batch: a packed row has the documents of a slice (``SLICE_BYTES`` of text, or one longer
text) or ``PAIRS_A_ROW`` pairs, and a row group some of them, so the memory of a reader, a sort or a shuffle does
not depend on the batch or the input.

Ids of A come from the rank encoder over the vocabulary of ``byte_bpe_50k.json`` (tested equal to that
tokenizer with ``encode_special_tokens``) with a space before the text, ids of B from ``piece_bpe_32k.model``,
which adds that space itself. Strings of special tokens in texts are ordinary text for both.

Defined cases: a text that is null or empty, or whose joined A or B bytes differ from space + text (e.g.
one that holds U+2581), has no tokens: zeros and an empty ``groups_sha256``; null and repeated ids are rows of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.llm.store import pin
from hazeframe.llm.text import slices

A_VOCABULARY = "byte_bpe_50k.tiktoken"
B_VOCABULARY = "piece_bpe_32k.model"
LANE_TOKENS = 256
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
PAIRS_A_ROW = 1 << 15
GROUP_BYTES = 2 << 20
DOC_BYTES = 128  # of a document's figures, beside its text
_LOADED: dict[tuple[str, str], Tokens] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Both encoders and the bytes of their tokens (one per worker)."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if the bytes of either are not those of space + text. A's tokens are slices of
        the bytes in order, so their length tells; B may change characters."""
        if text:
            whole = (" " + text).encode()
            a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            if int(self.a_len[a].sum()) == len(whole):
                b = self.b.encode(text)
                if b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                    return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def tokens(a_path: str, b_path: str) -> Tokens:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokens(a_path, b_path)
    return _LOADED[a_path, b_path]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_off: np.ndarray,
             lane: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A index, B index, cut after both) of every overlapping token pair of all documents of a batch, in order.

    ``a_end``/``b_end``: byte ends of the tokens of all documents laid one after the other; ``a_off``: first A token
    of each document, and the end.
    """
    n = len(a_end)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool)
    first = np.zeros(n, bool)
    sizes = np.diff(a_off)
    within = np.arange(n) - np.repeat(a_off[:-1], sizes)
    first[within % lane == 0] = True
    i = np.flatnonzero(first)
    stop = np.append(i[1:], n)
    begin = np.where(i > 0, a_end[i - 1], 0)
    j = np.searchsorted(b_end, begin, side="right")
    links_a, links_b, cuts = [], [], []
    while len(i):
        ea, eb = a_end[i], b_end[j]
        links_a.append(i)
        links_b.append(j)
        cuts.append(ea == eb)
        i = i + (ea <= eb)
        j = j + (eb <= ea)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    la, lb, cut = np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)
    order = np.argsort(la * (len(b_end) + 1) + lb, kind="stable")
    return la[order], lb[order], cut[order]


def decimals(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every id in decimal followed by its byte of ``ends``, and where each one stops."""
    digits = np.ones(len(ids), np.int64)
    for p in (10, 100, 1000, 10_000, 100_000):
        digits += ids >= p
    stop = np.cumsum(digits + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[stop - 1] = ends
    rest = ids.copy()
    for k in range(6):
        has = np.flatnonzero(digits > k)
        if not len(has):
            break
        out[stop[has] - 2 - k] = 48 + rest[has] % 10
        rest = rest // 10
    return out, stop


def group_digests(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, cut: np.ndarray, a_off: np.ndarray,
                  b_off: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of groups, SHA-256 of the groups in text) per document."""
    at = np.flatnonzero(cut)
    ca, cb = la[at], lb[at]  # the last A and B token of every group
    ga, gb = np.searchsorted(ca, np.arange(len(a))), np.searchsorted(cb, np.arange(len(b)))
    b_before = np.concatenate(([0], cb + 1))
    pa_ = np.arange(len(a)) + b_before[ga]
    pb = np.arange(len(b)) + (ca + 1)[gb]
    ids = np.empty(len(a) + len(b), np.int64)
    ends = np.full(len(ids), ord(","), np.uint8)
    ids[pa_], ids[pb] = a, b
    ends[pa_[ca]] = ord("|")
    ends[pb[cb]] = ord(";")
    text, stop = decimals(ids, ends)
    n = np.diff(np.searchsorted(ca, a_off))
    spots = a_off + b_off  # first token of each document among all tokens
    begin = np.concatenate(([0], stop))[spots]
    whole = text.tobytes()
    return n, [hashlib.sha256(whole[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(begin[:-1], begin[1:])]


def narrow(x: np.ndarray) -> bytes:
    """The numbers (none below 0) in the fewest bytes each that hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def wide(x: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``narrow``."""
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def folded(docs: pa.StructArray, gap: np.ndarray, times: np.ndarray) -> bytes:
    """A piece in one value: rows of many columns are slow to hand to Python."""
    parts = [pa.RecordBatch.from_struct_array(docs).serialize().to_pybytes(), narrow(gap), narrow(times)]
    return b"".join([np.array([len(x) for x in parts], np.int64).tobytes(), *parts])


def unfolded(x: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    ends = np.cumsum([24, *np.frombuffer(x, np.int64, 3)]).tolist()
    docs, gap, times = (x[i:j] for i, j in zip(ends[:-1], ends[1:]))
    docs = pa.ipc.read_record_batch(pa.py_buffer(docs), pa.schema(list(DOCS)))
    n = int(docs.column("n_pairs").to_numpy().sum())
    return docs, wide(gap, n), wide(times, n)


class Batch:
    """Collects the aligned documents of one chunk, a piece for each slice, and gives its packed rows."""

    def __init__(self, t: Tokens, number: int):
        self.t, self.number, self.bytes = t, number, 0
        self.pieces: list[tuple] = []

    def add(self, ids: pa.Array, texts: list, n_bytes: int) -> None:
        t = self.t
        got = [t.encode(x or "") for x in texts]
        a, b = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        a_off = np.concatenate(([0], np.cumsum([len(x[0]) for x in got])))
        b_off = np.concatenate(([0], np.cumsum([len(x[1]) for x in got])))
        del got
        la, lb, cut = lockstep(np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b]), a_off)
        n_groups, shas = group_digests(a, b, la, lb, cut, a_off, b_off)
        n_links = np.diff(np.searchsorted(la, a_off))
        # Of each document its distinct pairs, ascending, and how often it has them.
        m = len(t.a_len) * len(t.b_len)
        seen, times = np.unique(np.repeat(np.arange(len(ids)), n_links) * m + a[la] * len(t.b_len) + b[lb], return_counts=True)
        n_pairs = np.bincount(seen // m, minlength=len(ids))
        docs = pa.StructArray.from_arrays(
            [ids, *(pa.array(x, pa.int64()) for x in (np.diff(a_off), np.diff(b_off), n_groups, n_links)), pa.array(shas, pa.string()),
             pa.array(n_pairs, pa.int64())], fields=list(DOCS))
        self.pieces.append((docs, n_pairs, seen % m, times))
        self.bytes += n_bytes + DOC_BYTES * len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        pair, places = np.unique(np.concatenate([x[2] for x in self.pieces]), return_inverse=True)
        n = np.bincount(places, np.concatenate([x[3] for x in self.pieces]), len(pair)).astype(np.int64)
        pair = pair // len(self.t.b_len) << 32 | pair % len(self.t.b_len)
        ends = np.cumsum([len(x[2]) for x in self.pieces])
        for nth, ((docs, n_pairs, _, times), place) in enumerate(zip(self.pieces, np.split(places, ends[:-1]))):
            # Pair numbers, each less the one before within the document.
            gap = np.diff(place, prepend=0)
            starts = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
            gap[starts] = place[starts]
            yield self.row(nth, docs=folded(docs, gap, times))
        for k in range(0, len(pair), PAIRS_A_ROW):
            yield self.row(k, pairs=pair[k:k + PAIRS_A_ROW], counts=n[k:k + PAIRS_A_ROW])

    def row(self, nth: int, docs: bytes | None = None, **lists: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int64()), pa.array([nth], pa.int64()), pa.array([docs], pa.binary()),
             *(pa.array([lists.get(c)], pa.list_(pa.int64())) for c in ("pairs", "counts"))], names=["batch_no", "nth", "docs", "pairs", "counts"])


DOCS = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
_DOCS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PACKED = "batch_no long, nth long, docs binary, pairs array<long>, counts array<long>"
OUT = f"{_DOCS_DDL}, n_best long, count_sum long"


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packed rows of batches of documents: ``docs`` of a slice with their figures, pair numbers and how often they have
    them (``folded``), or the batch's distinct ``pairs`` and their ``counts`` from the ``nth`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = tokens(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        batch = Batch(t, number)
        for rb, _, off in slices(batches, "text", SLICE_BYTES):
            batch.add(rb.column(0), rb.column(1).to_pylist(), int(off[-1]))
            if batch.bytes >= chunk_bytes:
                yield from batch.rows()
                number += 1
                batch = Batch(t, number)
        if batch.pieces:
            yield from batch.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def pair_counts(packed: DataFrame) -> DataFrame:
    """a_id, b_id, n (links of the pair in all documents), best (no pair of that B id has more)."""
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    each = packed.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = pin(each.groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.shiftright("pair", 32).alias("a_id"), low.alias("b_id"), "n"), "align-pairs")
    most = total.groupBy("b_id").agg(F.max("n").alias("most"))
    return total.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document."""
    packed = pin(aligned(docs, a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY), chunk_bytes), "align-docs",
                 GROUP_BYTES)
    counts = pair_counts(packed).select(F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id")).alias("pair"),
                                        F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("signed"))  # negative: best
    asked = packed.select("batch_no", "nth", F.posexplode("pairs").alias("pos", "pair"))
    # Back to the batches: the corpus-wide counts of a batch's distinct pairs, then its documents. One number sorts them: rows are many.
    turn = F.shiftleft("batch_no", 1)
    told = asked.join(counts, "pair").select(turn.alias("turn"), (F.col("nth") + F.col("pos")).alias("at"), "signed",
                                             F.lit(None).cast("binary").alias("docs"))
    held = packed.where("docs is not null").select((turn + 1).alias("turn"), "nth", F.lit(None).cast("long").alias("signed"), "docs")
    laid = told.union(held).repartition(F.shiftright("turn", 1)).sortWithinPartitions("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counted, fresh = None, np.zeros(0, np.int64), []
        for rb in batches:
            begin, turns, at, signed = 0, rb.column(0).to_numpy(), rb.column(1).to_numpy(), rb.column(2)
            for k in np.flatnonzero(turns & 1).tolist():
                if k > begin:
                    fresh.append((at[begin:k], signed.slice(begin, k - begin).to_numpy()))
                begin = k + 1
                if turns[k] != number:
                    number, counted = turns[k], np.zeros(sum(len(x) for x, _ in fresh), np.int64)
                    while fresh:
                        place, n = fresh.pop()
                        counted[place] = n
                docs, gap, times = unfolded(rb.column(3)[k].as_py())
                size = docs.column("n_pairs").to_numpy()
                off = np.concatenate(([0], np.cumsum(size)))
                inner = np.cumsum(gap)
                base = np.concatenate(([0], inner))[off[:-1]]  # sums of the documents before
                mine = counted[inner - np.repeat(base, size)]
                best = np.concatenate(([0], np.cumsum(np.where(mine < 0, times, 0))))
                total = np.concatenate(([0], np.cumsum(np.abs(mine) * times)))
                more = [pa.array(best[off[1:]] - best[off[:-1]], pa.int64()), pa.array(total[off[1:]] - total[off[:-1]], pa.int64())]
                docs = docs.drop_columns(["n_pairs"])
                yield pa.RecordBatch.from_arrays([*docs.columns, *more], names=[*docs.schema.names, "n_best", "count_sum"])
            if begin < rb.num_rows:
                fresh.append((at[begin:].copy(), signed.slice(begin).to_numpy().copy()))

    return laid.mapInArrow(run, OUT).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row per link: doc_id, a_pos, b_pos (token places in the document), a_id, b_id, group (its number, from 0)."""
    a_path, b_path = a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(a_path, b_path)
        for rb, _, _ in slices(batches, "text", SLICE_BYTES):
            got = [t.encode(x or "") for x in rb.column(1).to_pylist()]
            a, b = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            a_off = np.concatenate(([0], np.cumsum([len(x[0]) for x in got])))
            b_off = np.concatenate(([0], np.cumsum([len(x[1]) for x in got])))
            la, lb, cut = lockstep(np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b]), a_off)
            if not len(la):
                continue
            doc = np.searchsorted(a_off, la, side="right") - 1
            group = np.concatenate(([0], np.cumsum(cut)[:-1]))
            group = group - group[np.searchsorted(la, a_off[doc])]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(doc)), pa.array(la - a_off[doc]), pa.array(lb - b_off[doc]), pa.array(a[la]), pa.array(b[lb]),
                 pa.array(group)], names=["doc_id", "a_pos", "b_pos", "a_id", "b_id", "group"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, a_pos long, b_pos long, a_id long, b_id long, group long")
