"""Benchmark decontamination by SimHash windows, native DataFrame expressions only.

1. Items are cut into 5-word shingles (lower case; fewer words: the whole item). A window can only
   be similar to an item if they share a shingle, so windows are laid where a document has an item
   shingle: at the offset the shingle has in the item, as long as the item (item-sized windows). A window
   carries the item it was laid for, so work grows with these hits and not with windows x items.
   This loses nothing: any other window has similarity 0 to that item.
2. Every window and item gets a 64-bit SimHash of its shingles, each weighted by its count.
3. Multi-index: the fingerprint is cut into ``radius + 1`` blocks; two fingerprints within the radius
   agree on at least one block (pigeonhole), so joining on (item, block, value) finds all of them.
4. Candidates within the radius are verified by the exact weighted-shingle similarity
   ``sum(min counts) / sum(max counts) >= similarity``.

The document side is one scan, whatever sizes items have; the shingles and blocks of the items are broadcast only when the
benchmark is counted to be small, else the same joins shuffle. Windows are keyed by document, so a
passage in a third of all documents is no hot key.

Defined cases: null or empty text and items without words match nothing; null doc_id is matched
like any other (documents are told apart by id and text); repeated items, also under one id, each give their row;
repeated documents give one row each distinct (id, text); empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.llm.store import pin

RADIUS = 19
SIMILARITY = 0.75
BROADCAST_SHINGLES = 2_000_000
_BLANK = r"[\x09-\x0D ]+"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null or blank text."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BLANK))


def shingle_hashes(w: Column) -> Column:
    """64-bit hashes of the 5-word shingles in order; fewer words make one shingle."""
    # no words or fewer than five: the sequence has one position, missing words hash as null
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0)))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))


def word_grams(w: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` < 5 words in order, equal to the shingle of a text of k words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)], *[F.lit(None).cast("string")] * (5 - k))))


def simhash(h: Column) -> Column:
    """64-bit SimHash of shingle hashes; a shingle weighs as often as it occurs."""
    zero = F.array_repeat(F.lit(0), 64)
    votes = F.aggregate(h, zero, lambda acc, x: F.transform(
        acc, lambda v, i: v + F.when(F.getbit(x, i) == 1, F.lit(1)).otherwise(F.lit(-1))))
    bits = F.transform(votes, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
                       .otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def blocks(f: Column, radius: int) -> Column:
    """(block, value) structs: radius + 1 disjoint blocks that cover the 64 bits."""
    n = radius + 1
    edge = [i * 64 // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(f, edge[i]).bitwiseAND(
        F.lit((1 << (edge[i + 1] - edge[i])) - 1).cast("bigint")).alias("v")) for i in range(n)])


def weighted_similarity(a: Column, b: Column) -> Column:
    """sum(min counts) / sum(max counts) of two shingle arrays (multisets)."""
    both = F.array_distinct(F.array_intersect(a, b))
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    inter = F.aggregate(both, F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, item_hash (of its text, words long: telling items of one id apart), n (words), ih (shingles) of every item with words."""
    return (items.select("item_id", F.xxhash64("text").alias("item_hash"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
            .select("item_id", "item_hash", F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("ih")))


def spots(w: Column, sizes: list[int]) -> Column:
    """(p, h) of all 5-word shingles and of all runs of ``sizes`` (below five) words, in one array: items of any size are
    met in one pass over the text. A text of fewer than five words is itself such a run."""
    runs = [F.when(F.size(w) >= 5, shingle_hashes(w)).otherwise(F.array().cast("array<bigint>")), *[word_grams(w, k) for k in sizes]]
    return F.concat(*[F.transform(r, lambda h, p: F.struct(p.alias("p"), h.alias("h"))) for r in runs])


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), n_words, hamming, similarity: the best window of every
    contaminated (document, item)."""
    it = pin(item_grams(items).withColumn("if", simhash(F.col("ih"))), "items")
    # items of equal text are met once and told apart at the end
    texts = pin(it.dropDuplicates(["item_hash"]).drop("item_id"), "item-texts")
    grams = pin(texts.select("item_hash", "n", F.posexplode("ih").alias("q", "h")).distinct(), "item-grams")
    few = grams.count() <= BROADCAST_SHINGLES
    held = F.broadcast if few else (lambda d: d)
    short = sorted(r["n"] for r in texts.where("n < 5").select("n").distinct().collect())  # four sizes at most

    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    start = lambda size: F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), size - F.col("n")))
    if short:
        hits = d.select("*", F.inline(spots(F.col("w"), short)))
    else:
        hits = d.select("*", F.posexplode(shingle_hashes(F.col("w"))).alias("p", "h"))
    if few:
        # the words ride along as a reference; only rows that hit are built
        win = (hits.join(held(grams), "h").withColumn("start", start(F.size("w")))
               .select("doc_id", "text_hash", "item_hash", "start", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("w")))
        win = win.groupBy("doc_id", "text_hash", "item_hash", "start", "n").agg(F.first("w").alias("w"))
    else:
        at = (hits.select("doc_id", "text_hash", F.size("w").alias("size"), "p", "h").join(grams, "h")
              .select("doc_id", "text_hash", "item_hash", start(F.col("size")).alias("start"), "n").distinct())
        a, b = at.alias("a"), d.dropDuplicates(["doc_id", "text_hash"]).alias("b")
        win = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash")).select(
            "a.*", F.slice("b.w", F.col("a.start") + 1, F.col("a.n")).alias("w"))
    win = win.withColumn("wh", shingle_hashes(F.col("w")))
    win = pin(win.withColumn("wf", simhash(F.col("wh"))).drop("w"), "windows")

    left = win.select("*", blocks(F.col("wf"), radius).alias("lb"), F.inline(blocks(F.col("wf"), radius)))
    right = texts.select("item_hash", "ih", "if", blocks(F.col("if"), radius).alias("rb"), F.inline(blocks(F.col("if"), radius)))
    hamming = F.bit_count(F.col("wf").bitwiseXOR(F.col("if")))
    # a pair counts in its first agreeing block only, so no shuffle is needed to drop repeats
    same = [F.expr(f"get(lb, {k}).v = get(rb, {k}).v") for k in range(radius + 1)]
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(same)])
    cand = left.join(held(right), ["item_hash", "i", "v"]).where((first == F.col("i")) & (hamming <= radius))
    ok = cand.select("doc_id", "text_hash", "item_hash", "start", F.col("n").alias("n_words"), hamming.alias("hamming"),
                     weighted_similarity(F.col("wh"), F.col("ih")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.struct(F.col("similarity"), (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.col("n_words"))
    out = ok.groupBy("doc_id", "text_hash", "item_hash").agg(F.max(best).alias("b"))
    out = out.join(it.select("item_id", "item_hash"), "item_hash")
    return out.select("doc_id", "text_hash", "item_id", (-F.col("b.s")).alias("start"), "b.n_words",
                      (-F.col("b.h")).alias("hamming"), "b.similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without a match; columns unchanged."""
    bad = matches(docs, items, radius, similarity).select(
        F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    bad = pin(bad, "leaks")
    same = (F.xxhash64(docs["text"]) == bad["__leak_hash"]) & docs["doc_id"].eqNullSafe(bad["__leak_id"])
    return docs.join(bad, same, "left_anti")
