"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Sources share ``ratio`` times the words of all documents by weight. A source never gives more than
``max_epochs`` times its own words: sources above that are clamped, their excess is shared among the
others by weight, and so on in rounds until none is above (each round is one aggregation of the
source table; two sums reach the driver). A source's target is then taken as whole repetitions of all
its documents and one fractional repetition, which takes documents in the order of a seeded hash until
the words are used up; only the document at the cut gives a part of its words (the first ones), so that
every source meets its target to the word.

Only DataFrame functions are used. What a document gives depends on its own hash and one row per
source: its whole repetitions, the hash at the cut and the words given there. The cut is found on
sums by (source, hash range) and then on sums by hash inside one range, whose number of rows is
about ``RANGE_ROWS`` for every size of a source. A hot source therefore never meets in one task; the join of
documents and sources is left to Spark (a broadcast where the source table is measured to be small,
else a skew join).

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, an
empty one another; repeated rows and null ids are documents of their own; rows of equal id and text have the same
hash and, at the cut, share its words evenly (the remainder of that division is left out); a source without weight,
or with a null or non-positive one, has target 0; if all sources are clamped, targets are the
clamps, even if their sum stays below the share; an empty table gives an empty result. Columns of the
input named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.llm.store import pin

WORD = r"[^\x20\x09-\x0D]+"
WORD_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
RATIO = 1.5
MAX_EPOCHS = 2.0
SEED = 11
CYCLE = (5.0, 2.0, 1.0)  # weights of the sources in order, repeating
HASH_DIGITS = 13  # hexadecimal digits of the hash that orders documents
RANGE_ROWS = 4096
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(seed: int = SEED) -> Column:
    """The seeded hash of a document's id and text: its place in the fractional repetition."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                      F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def source_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``pos``, the place (from 0) of its source by code point, null last.

    Ranges of sources are numbered one by one and shifted by the sources in the ranges before, so no task
    sorts all of them.
    """
    dealt = pin(sources.repartitionByRange(F.col("source").asc_nulls_last())
                .withColumn("range_no", F.spark_partition_id()), "mix-order")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = dealt.groupBy("range_no").agg(F.count(F.lit(1)).alias("in_range")).select(
        "range_no", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(offsets, "range_no").withColumn(
        "pos", (F.col("shift") + F.col("inside") - 1).cast("long")).drop("range_no", "shift", "inside")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """``sources`` with ``weight``: the numbers of ``cycle`` in the order of the sources, repeating."""
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return source_order(sources).withColumn(
        "weight", F.element_at(values, (F.col("pos") % len(cycle) + 1).cast("int"))).drop("pos")


def water_fill(sources: DataFrame, ratio: float = RATIO, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, by rounds of clamping and resharing."""
    w = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(0.0)
    cap = F.col("source_size") * float(max_epochs)
    level = 0.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped = -1
    while True:
        full = (w > 0) & (cap <= F.lit(level) * w) if level else F.lit(False)
        got = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, w))).first()
        if got[0] == clamped:
            break
        clamped = got[0]
        if not got[2]:  # nothing left that could take more
            break
        level = max(0.0, (ratio * total - (got[1] or 0.0)) / got[2])
    return sources.withColumn("target", F.least(cap, F.lit(level) * w))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), order_hash(seed).alias("place"))


def source_plan(rows: DataFrame, weights: DataFrame | None = None, ratio: float = RATIO, max_epochs: float = MAX_EPOCHS,
                cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """A row per source: source_size, target, whole, cut (hash of the fractional repetition's last documents),
    part (words that each of them gives there). ``rows``: source, size, place."""
    sources = pin(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
                  "mix-sources")
    if weights is None:
        weighed = cycle_weights(sources, cycle)
    else:
        given = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sources.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    filled = water_fill(pin(weighed, "mix-weights"), ratio, max_epochs)
    words = F.round("target").cast("long")
    plan = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")))
                             .otherwise(0).cast("long"))
    plan = pin(plan.select("source", "source_size", "target", "whole",
                           (words - F.col("whole") * F.col("source_size")).alias("rest"),
                           F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long").alias("ranges")), "mix-targets")
    # Sums by hash range, then the range in which the rest is used up.
    span = float(16 ** HASH_DIGITS)
    asked = plan.where("rest > 0").select(F.col("source").alias("of"), "rest", "ranges")
    dealt = rows.join(asked, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "hash_range", F.floor(F.col("place") / F.lit(span) * F.col("ranges")).cast("long"))
    sums = dealt.groupBy("of", "rest", "ranges", "hash_range").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("of").orderBy("hash_range").rowsBetween(Window.unboundedPreceding, 0)
    reached = (sums.withColumn("upto", F.sum("words").over(ordered))
               .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
               .select(F.col("of").alias("at"), F.col("hash_range").alias("at_range"),
                       (F.col("rest") - F.col("upto") + F.col("words")).alias("needed")))
    inside = dealt.join(reached, F.col("of").eqNullSafe(F.col("at")) & (F.col("hash_range") == F.col("at_range")))
    by_place = inside.groupBy("at", "needed", "place").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("same"))
    ordered = Window.partitionBy("at").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cut = (by_place.withColumn("upto", F.sum("words").over(ordered))
           .where((F.col("upto") >= F.col("needed")) & (F.col("upto") - F.col("words") < F.col("needed")))
           .select("at", F.col("place").alias("cut"),
                   F.floor((F.col("needed") - F.col("upto") + F.col("words")) / F.col("same")).cast("long").alias("part")))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("at")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "whole", "cut", "part")


def _taken(size: Column, place: Column) -> Column:
    extra = F.when(place < F.col("cut"), size).when(place == F.col("cut"), F.least(size, F.col("part"))).otherwise(0)
    return (size * F.col("whole") + extra).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, ratio: float = RATIO, max_epochs: float = MAX_EPOCHS,
        seed: int = SEED, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) per document.

    ``weights`` (source, weight) gives the shares; without it the sources weigh ``cycle`` in order.
    The texts are read once; sizes and hashes are pinned.
    """
    rows = pin(_rows(docs, seed), "mix-rows")
    plan = pin(source_plan(rows, weights, ratio, max_epochs, cycle), "mix-plan")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), F.col("place")).alias("taken"))


def mixed_texts(docs: DataFrame, weights: DataFrame | None = None, ratio: float = RATIO, max_epochs: float = MAX_EPOCHS,
                seed: int = SEED, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """The mix itself: a row per repetition taken, with the columns of ``docs``, ``repetition`` (from 0) and, for the
    document at a cut, the text up to its last word taken."""
    plan = pin(source_plan(pin(_rows(docs, seed), "mix-rows"), weights, ratio, max_epochs, cycle), "mix-plan")
    kept = [c for c in docs.columns if c != "repetition"]
    own = docs.select(F.struct(*kept).alias("doc"), word_count("text").alias("size"), order_hash(seed).alias("place"),
                      F.col("source").alias("key"))
    had = own.join(plan, F.col("key").eqNullSafe(F.col("of"))).withColumn("taken", _taken(F.col("size"), F.col("place")))
    each = had.where("taken > 0").withColumn(
        "repetition", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("repetition") * F.col("size")
    pieces = F.split(F.col("doc.text"), WORD_START)  # a blank start is a piece without a word
    blank = F.col("doc.text").rlike(r"^[\x20\x09-\x0D]").cast("long")
    head = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (left + blank).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(left >= F.col("size"), F.col("doc.text")).otherwise(head)
    return each.select(*[text.alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in kept], "repetition")
