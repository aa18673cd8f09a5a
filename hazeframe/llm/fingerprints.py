"""Document fingerprints: mergeable bottom-k sketches of 5-word shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit shingle hashes of a text (all of them when the
text has at most ``k``). Sketches of parts merge by union and cut (``merge``); a merged sketch
equals the sketch of the united shingle sets. From two sketches come estimates of resemblance
(Jaccard), containment and the distinct shingle count. As a string, a sketch is the hash count
followed by the hashes in ascending order, hexadecimal; the empty text has the sketch ``"0:"``.

``fingerprint_with_edit`` also sketches the edited text of every document (its last third replaced
by the beginning of the next document in descending id order) and compares. Rows are cut into
ordered buckets of doc_id; each bucket also gets a copy of the first document after it, so
neighbours are compared without a global sort, without a window over all rows and without shipping
any text twice.

Defined cases: null text = empty text; null doc_id sorts after all ids; equal ids are ordered by
text; one document alone is its own neighbour; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.llm import text as X

K = 128
ROWS_PER_BUCKET = 1500
MAX_BUCKETS = 8192  # bounds the driver's list of bucket borders; buckets grow beyond


# --- sketch arithmetic ---------------------------------------------------------------------

def sketch_hashes(shingle_hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    h = shingle_hashes
    if len(h) > 4 * k:
        # at most 2k of the smallest are needed unless repeats hide distinct ones
        part = np.unique(np.partition(h, 2 * k)[:2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles behind a sketch (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike (1), empty and full are not (0)."""
    if not len(a) and not len(b):
        return 1.0
    u = np.union1d(a, b)
    u = u[:k] if max(len(a), len(b)) >= k else u
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(u, both, assume_unique=True).sum()) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b also has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    both = j * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def to_string(a: np.ndarray) -> str:
    return f"{len(a)}:" + a.astype(">u8").tobytes().hex()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s.split(":", 1)[1]), ">u8").astype(np.uint64)


def sketches(data: np.ndarray, off: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Sketch of every row of a byte slice."""
    w, wo = X.word_hashes(data, off)
    return [sketch_hashes(X.shingles(w[wo[i]:wo[i + 1]]), k) for i in range(len(off) - 1)]


# --- DataFrame operators -----------------------------------------------------------------------

def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint string, n_sketch) for every row; a pure map over the scan."""
    def run(batches):
        for rb, data, off in X.slices(batches, "_t"):
            s = sketches(data, off, k)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([to_string(a) for a in s]),
                 pa.array([distinct_count(a, k) for a in s], pa.float64())],
                names=[id_col, "fingerprint", "n_shingles_est"])
    src = df.select(F.col(id_col), F.col(text_col).alias("_t"))
    kind = dict(src.dtypes)[id_col]
    return src.mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, n_shingles_est double")


def merge_fingerprints(df: DataFrame, key: str, k: int = K) -> DataFrame:
    """Merge the sketches of a key's parts natively: explode, distinct hashes, the k smallest.

    The k smallest are kept per (key, salt) first, so a hot key never meets in one task.
    """
    h = (df.select(key, F.explode(F.expr(
            "filter(transform(sequence(0, 2048), i -> substring(split(fingerprint, ':')[1], i * 16 + 1, 16)),"
            " x -> x <> '')")).alias("h")).distinct())
    salted = h.groupBy(key, F.pmod(F.xxhash64("h"), F.lit(64)).alias("_s")).agg(
        F.slice(F.array_sort(F.collect_set("h")), 1, k).alias("hs"))
    merged = salted.groupBy(key).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hs")))), 1, k).alias("hs"))
    return merged.select(key, F.concat(F.size("hs").cast("string"), F.lit(":"), F.array_join("hs", "")).alias("fingerprint"))


def _edit(own: bytes, nxt: bytes) -> bytes:
    a = np.frombuffer(own, np.uint8)
    starts = np.flatnonzero((a & 0xC0) != 0x80)
    cut = len(starts) // 3
    if cut == 0:
        return own
    head = own[:starts[len(starts) - cut]]
    b = np.frombuffer(nxt, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    return head + (nxt if len(at) <= cut else nxt[:at[cut]])


def fingerprint_with_edit(df: DataFrame, k: int = K, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double, n_shingles_est double")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.select((-F.col("doc_id").cast("double")).alias("o"))
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, n // rows_per_bucket))
    cuts = ids.approxQuantile("o", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    splits = [-np.inf, *sorted(set(cuts)), np.inf]
    docs = docs.withColumn("o", -F.col("doc_id").cast("double"))
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="o", outputCol="b", handleInvalid="keep").transform(docs)
    else:
        docs = docs.withColumn("b", F.lit(0))
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(len(splits)))
                       .otherwise(F.col("b").cast("int")).alias("b"))
    # the largest id of every bucket = the document after the bucket before it (cyclic)
    heads = docs.groupBy("b").agg(F.max("doc_id").alias("head")).orderBy("b").collect()  # one row a bucket
    if not heads:
        return df.sparkSession.createDataFrame([], out)
    spark = df.sparkSession
    after = spark.createDataFrame(
        [(h["head"], heads[i - 1]["b"]) for i, h in enumerate(heads)], "head long, prev int")
    copies = (docs.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("head")))  # <= MAX_BUCKETS rows
              .select("doc_id", "text", F.col("prev").alias("b"), F.lit(True).alias("copy")))
    laid = docs.withColumn("copy", F.lit(False)).unionByName(copies)
    laid = (laid.repartition("b").sortWithinPartitions(
        "b", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))

    def run(batches):
        held = None  # (bucket, id, bytes, sketch)
        skip = None
        rows: list[tuple] = []

        def done():
            nonlocal rows
            cols = list(zip(*rows, strict=True))
            rows = []
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
            names = [x.split()[0] for x in out.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for rb, data, off in X.slices(batches, "text"):
            own = sketches(data, off, k)
            raw = data.tobytes()
            ids_, bs, cp = (rb.column(i).to_pylist() for i in (0, 2, 3))
            edits: list[tuple] = []
            for i in range(rb.num_rows):
                if skip == bs[i] and cp[i]:
                    continue
                body = raw[off[i]:off[i + 1]]
                if held is not None:
                    edits.append((*held[1:], _edit(held[2], body), own[i]))
                held = None if cp[i] else (bs[i], ids_[i], body, own[i])
                if cp[i]:
                    skip = bs[i]
            if edits:
                joined = np.frombuffer(b"".join(e[3] for e in edits), np.uint8)
                eo = np.cumsum([0, *(len(e[3]) for e in edits)])
                for (doc, body, fp, edit, nxt), ef in zip(edits, sketches(joined, eo, k), strict=True):
                    rows.append((doc, X.code_points(np.frombuffer(body, np.uint8)), hashlib.sha256(edit).hexdigest(),
                                 to_string(fp), to_string(ef), resemblance(fp, ef, k), resemblance(fp, nxt, k),
                                 distinct_count(fp, k)))
                yield done()

    return laid.mapInArrow(run, out)
