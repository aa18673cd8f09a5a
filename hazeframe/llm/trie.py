"""Conversation prefix trie: nodes by prefix hashes, subtree totals by parallel tree contraction.

Two conversations share a trie node where their first turns are the same. ``rebuild`` gives the turns,
``prefix_trie`` the nodes with their members and subtree totals:

1. turns get their place in the conversation by ranges of (conv_id, turn), so that no conversation, however
   long, is numbered in one task;
2. a prefix is named by its depth and two 64-bit hashes: the XOR of position-dependent hashes of its
   turns. XOR has running values, so a long conversation is worked in chunks of turns whose totals are
   carried over, and the parent's name is the node's name XOR its last turn;
3. subtree totals come from tree contraction. Every round rakes all leaves into their parents (one
   aggregation with map-side sums: a node with any number of children is no hot key) and compresses every
   chain of nodes with a single child into the child below by pointer doubling (joins on unique keys). A
   round at least halves the leaves of what is left, so rounds are logarithmic in the number of nodes;
4. the compressed nodes are expanded again, last round first: a compressed node's total is that of the node
   below it plus the weights in between.

Every round's state is a table in the shared folder. The driver gets counts only.

Defined cases: rows without conv_id belong to no conversation and are left out; null role and text are
empty; turns are ordered with null first, equal turns by a hash of role and text; repeated rows are
turns of their own; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.llm.store import pin

BLOCK = 100  # conversations that borrow their first turns from the same one
MOST_BORROWED = 6  # borrowed turns: crc32(conv_id) modulo this
CHUNK_TURNS = 4096
NODE = ("conv_id", "depth")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _running(column: str, parts: list[str], order: str) -> Column:
    return F.bit_xor(column).over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_own (turns of the conversation), h1, h2 (hashes of role and text), length (code points)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    thin = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, role, F.lit(2)).alias("h2"), F.char_length(text).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row_no"))  # splits any number of equal rows
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("row_no")]
    dealt = pin(thin.repartitionByRange(F.col("conv_id"), *order).withColumn("range_no", F.spark_partition_id()), "trie-turns")
    counts = dealt.groupBy("conv_id", "range_no").agg(F.count(F.lit(1)).alias("in_range"))
    own = Window.partitionBy("conv_id")
    offsets = counts.select(
        "conv_id", "range_no", F.sum("in_range").over(own).alias("n_own"),
        (F.sum("in_range").over(own.orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "range_no").orderBy(*order))
    return dealt.withColumn("inside", inside).join(offsets, ["conv_id", "range_no"]).select(
        "conv_id", (F.col("shift") + F.col("inside")).alias("pos"), "n_own", "h1", "h2", "length")


def rebuild(turns: DataFrame, block: int = BLOCK, most: int = MOST_BORROWED) -> DataFrame:
    """The rebuilt turns (conv_id, pos, h1, h2, length) and, at pos 0, a row per conversation.

    Conversation c takes the first h turns of conversation c - c % block and its own turns after the first h;
    h = crc32(decimal c) % most.
    """
    turns = pin(turns, "trie-numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < most)).select(
        F.col("conv_id").alias("head"), F.col("pos").alias("at"), "h1", "h2", "length", F.col("n_own").alias("n_head"))
    convs = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("head"), h.alias("h"))
    lent = convs.join(heads, "head").where("at <= h").select("conv_id", F.col("at").alias("pos"), "h1", "h2", "length")
    # Own turns keep their places but where the head conversation has fewer than h turns.
    short = heads.where("at = 1").select("head", "n_head")
    moved = (convs.join(short, "head", "left")
             .select("conv_id", (F.col("h") - F.least("h", F.coalesce("n_head", F.lit(0)))).alias("gap")).where("gap > 0"))
    own = turns.where(F.col("pos") > h).join(moved, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "h1", "h2", "length")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("h1"),
                        F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("length"))
    return tops.unionByName(lent).unionByName(own)


def prefixes(turns: DataFrame, chunk: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, depth, p1, p2 (the prefix's name), q1, q2 (its parent's), length, last (no longer prefix of the conversation)."""
    spot = turns.select("conv_id", F.col("pos").alias("depth"), "length", F.floor(F.col("pos") / chunk).alias("part"),
                        *[F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("pos", h)).alias(x)
                          for h, x in (("h1", "x1"), ("h2", "x2"))])
    spot = pin(spot, "trie-spots")
    totals = spot.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"), F.max("depth").alias("deepest"))
    own = Window.partitionBy("conv_id")
    carried = totals.select("conv_id", "part", F.max("deepest").over(own).alias("deepest"),
                            *[_running(t, ["conv_id"], "part").bitwiseXOR(F.col(t)).alias(t) for t in ("t1", "t2")])
    named = spot.join(carried, ["conv_id", "part"])
    for i in ("1", "2"):
        named = named.withColumn(f"p{i}", _running(f"x{i}", ["conv_id", "part"], "depth").bitwiseXOR(F.col(f"t{i}")))
    return named.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
                        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "length",
                        (F.col("depth") == F.col("deepest")).alias("last"))


def ends_digest(ends: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ends_sha256: SHA-256 of the conv_ids of each key, ascending, decimal and comma-joined.

    Ids are dealt by ranges of (key, conv_id) and joined per range; a key inside one range is hashed there, one
    that spans several ranges (fewer keys than ranges do) is hashed by streaming its parts in order.
    """
    dealt = pin(ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").withColumn("range_no", F.spark_partition_id()), "trie-ends")
    parts = dealt.groupBy(*key, "range_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = pin(parts, "trie-parts")
    spread = pin(parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_parts")), "trie-spread")
    whole = parts.join(spread.where("n_parts = 1"), key).select(*key, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = parts.join(spread.where("n_parts > 1"), key).drop("n_parts")
    schema = whole.schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        rows: list[tuple] = []
        for rb in batches:
            for row in zip(*[rb.column(rb.schema.get_field_index(c)).to_pylist() for c in [*key, "ids"]]):
                if row[:-1] != at:
                    if at is not None:
                        rows.append((*at, state.hexdigest()))
                    at, state = row[:-1], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[-1].encode())
        if at is not None:
            rows.append((*at, state.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[f.name for f in schema.fields])

    streamed = many.repartition(*key).sortWithinPartitions(*key, "range_no").mapInArrow(digest, schema)
    return whole.unionByName(streamed)


def trie_nodes(turns: DataFrame) -> DataFrame:
    """A row per node without subtree totals: conv_id, depth, parent_conv_id, n_convs, n_children, length, ends_sha256."""
    pref = pin(prefixes(turns), "trie-prefixes")
    nodes = pin(pref.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.first("length").alias("length")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    name = ["depth", "p1", "p2"]
    ends = ends_digest(pref.where("last"), name)
    full = nodes.join(children, name, "left").join(ends, name, "left")
    # The root, parent of every first turn, is one known row; other parents join.
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root"))
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                                              F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "length",
           F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    deep = full.where("depth > 1").join(parents, ["depth", "q1", "q2"]).select(*out)
    least = root.first()  # one row
    shallow = full.where("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(least[0] if least else None).cast("long"))).select(*out)
    return deep.unionByName(shallow)


def _node(conv: str, depth: str) -> list[Column]:
    return [F.col(conv).alias("conv_id"), F.col(depth).alias("depth")]


def contract(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """conv_id, depth and, per column of ``weights``, its sum over the node's subtree (same names).

    ``nodes``: conv_id, depth, parent_conv_id (null: the root; a parent is one level up), n_children, weights (longs).
    """
    above = [f"above_{w}" for w in weights]  # weight of compressed nodes between a node and its present parent
    state = pin(nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"), "n_children",
                             *weights, *[F.lit(0).cast("long").alias(a) for a in above]), "trie-state")
    raked: list[DataFrame] = []
    chains: list[DataFrame] = []
    while state.count():
        leaf = F.col("n_children") == 0
        raked.append(state.where(leaf).select(*NODE, *weights))
        # Rake: one aggregation by parent, over all nodes, adds the leaves and names an only child that is left.
        stays = F.when(~leaf, F.struct(F.col("conv_id").alias("conv"), "depth", *above))
        got = state.where("up_conv is not null").groupBy(*_node("up_conv", "up_depth")).agg(
            F.count_if(leaf).alias("gone"), F.min(stays).alias("only"),
            *[F.sum(F.when(leaf, F.col(w) + F.col(a))).alias(f"got_{w}") for w, a in zip(weights, above)])
        state = pin(state.where(~leaf).join(got, list(NODE), "left").select(
            *NODE, "up_conv", "up_depth", (F.col("n_children") - F.coalesce("gone", F.lit(0))).alias("n_children"),
            *[(F.col(w) + F.coalesce(f"got_{w}", F.lit(0))).alias(w) for w in weights], *above, "only"), "trie-state")
        # Compress: chains of nodes with one child, each pointing down to the first node that has not one child.
        one = F.col("n_children") == 1
        chain = pin(state.where(one).select(
            *NODE, "up_conv", "up_depth", *above, F.col("only.conv").alias("to_conv"), F.col("only.depth").alias("to_depth"),
            *[(F.col(w) + F.col(f"only.{a}")).alias(f"add_{w}") for w, a in zip(weights, above)]), "trie-chain")
        if not chain.take(1):
            state = state.drop("only")
            continue
        inner = chain.select(F.col("to_conv").alias("conv_id"), F.col("to_depth").alias("depth"))
        tops = pin(chain.select(*NODE).join(inner, list(NODE), "left_anti"), "trie-tops")
        while True:
            below = chain.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("next_conv"),
                                 F.col("to_depth").alias("next_depth"), *[F.col(f"add_{w}").alias(f"next_{w}") for w in weights])
            hop = pin(chain.join(below, ["to_conv", "to_depth"], "left"), "trie-chain")
            hopped = hop.where("next_conv is not null").take(1)
            chain = hop.select(*NODE, "up_conv", "up_depth", *above, F.coalesce("next_conv", "to_conv").alias("to_conv"),
                               F.coalesce("next_depth", "to_depth").alias("to_depth"),
                               *[(F.col(f"add_{w}") + F.coalesce(f"next_{w}", F.lit(0))).alias(f"add_{w}") for w in weights])
            if not hopped:
                break
        chains.append(chain.select(*NODE, "to_conv", "to_depth", *[f"add_{w}" for w in weights]))
        # The node below a chain takes the place of the chain's top.
        heads = chain.join(tops, list(NODE)).select(
            *_node("to_conv", "to_depth"), F.lit(True).alias("moved"), F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
            *[(F.col(f"add_{w}") + F.col(a)).alias(f"new_{a}") for w, a in zip(weights, above)])
        pick = lambda new, old: F.when(F.col("moved"), F.col(new)).otherwise(F.col(old)).alias(old)
        state = pin(state.where(~one).drop("only").join(heads, list(NODE), "left").select(
            *NODE, pick("new_conv", "up_conv"), pick("new_depth", "up_depth"), "n_children", *weights, *[pick(f"new_{a}", a) for a in above]),
            "trie-state")
    if not raked:
        return nodes.select(*NODE, *weights)
    totals = raked[0]
    for more in raked[1:]:
        totals = totals.unionByName(more)
    # ``add`` holds what lies between a chain node and the node below: its own weight up to that node's total.
    for chain in reversed(chains):
        found = totals.select(*[F.col(c).alias(n) for c, n in zip(NODE, ("to_conv", "to_depth"))],
                              *[F.col(w).alias(f"below_{w}") for w in weights])
        opened = chain.join(found, ["to_conv", "to_depth"]).select(
            *NODE, *[(F.col(f"add_{w}") + F.col(f"below_{w}")).alias(w) for w in weights])
        totals = totals.unionByName(pin(opened, "trie-opened"))
    return totals


def prefix_trie(conversations: DataFrame, block: int = BLOCK, most: int = MOST_BORROWED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node of the trie."""
    nodes = pin(trie_nodes(rebuild(numbered_turns(conversations), block, most)), "trie-full")
    weighed = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved_tokens", (F.col("n_convs") - 1) * F.col("length"))
    totals = contract(weighed, ["n_leaves", "saved_tokens"])
    return nodes.join(totals, list(NODE)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                 "ends_sha256")
