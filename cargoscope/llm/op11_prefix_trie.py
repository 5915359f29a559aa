"""Conversation prefix trie by fixed-length block hashing.

A turn's digest is a 128-bit hash of its place, role and text; the digest of a prefix is the XOR of its
turns' digests, so it can be summed over segments in any grouping. Conversations are first grouped by the
digests of successive blocks of ``BLOCK`` turns. Where all members that go on agree on the next block,
one of them stands for all in it; only in blocks where siblings diverge are the turns of every member
looked at, and grouped by the digest at each turn.

Sums over subtrees take the distance doubling: after k rounds a node holds the sum over its descendants
fewer than 2^k levels below, and its ancestor 2^k levels above. Nodes with one member lie on a bare
path (one leaf, nothing saved), so that only shared nodes take part.

No conversation, node or list of members is gathered: turns are numbered and blocks summed by segments of
range partitions, the ids that end at a node are joined to texts in parallel and then pass through
the hash in order.

Defined results: a null role or text is empty; turns with equal numbers follow role, then text; repeated
rows are turns of their own; a row without ``conv_id`` belongs to no conversation; no conversations
give no rows. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.joins import sized
from cargoscope.llm.op13_mixing import words_of
from cargoscope.operators.segments import Running, positions, running
from cargoscope.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of a block.
BLOCK = 4
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, t1, t2, words)``: every turn's place in its conversation, 128-bit hash and word count."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Only where turns share a number do role and text decide, so that other texts stay where they are.
    tied = turns.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tied = materialise(tied)
    marked = turns.join(sized(tied), (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    rows = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("_n") > 1, F.struct("role", "text")).alias("tie"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        words_of("text").alias("words"),
    )
    return positions(materialise(rows), ["conv_id"], ["turn", "tie"], "pos").drop("turn", "tie")


def salted(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, g1, g2, words)``: the turn's hash with its place."""
    return turns.select(
        "conv_id",
        "pos",
        F.xxhash64(F.lit(3), "pos", "t1", "t2").alias("g1"),
        F.xxhash64(F.lit(4), "pos", "t1", "t2").alias("g2"),
        "words",
    )


def members(turns: DataFrame) -> DataFrame:
    """``(conv_id, n)`` of every conversation with a turn."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(conversations: DataFrame, heads: int = 4, apart: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)`` in which every conversation begins like the first of its ``apart`` ids.

    Of conversation c the first crc32(c) % ``heads`` turns give way to those of c - c % ``apart`` (all
    that it has, none if it is absent). ``convs`` lists the conversations that have lost all turns too.
    """
    own = materialise(numbered(conversations))
    counts = members(own)
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    listed = materialise(counts.withColumns({"h": head, "donor": F.col("conv_id") - F.pmod("conv_id", F.lit(apart))}))
    donors = listed.select(F.col("conv_id").alias("donor"), F.col("n").alias("n_donor"))
    kept = F.least("h", F.coalesce("n_donor", F.lit(0)))
    convs = materialise(listed.join(donors, "donor", "left").select("conv_id", "h", "donor", kept.alias("kept")))
    first = own.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "donor")
    begun = first.join(convs, "donor").where("pos < kept").select("conv_id", "pos", "t1", "t2", "words")
    rest = own.join(sized(convs), "conv_id").where("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "t1", "t2", "words")
    return begun.unionByName(rest), convs.select("conv_id")


def prefix_trie(parts: tuple[DataFrame, DataFrame], block: int = BLOCK) -> DataFrame:
    """One row per node of the trie over ``parts``: (turns, convs) as of ``rebuilt``."""
    turns, convs = parts
    turns = materialise(salted(turns).withColumn("block", F.floor(F.col("pos") / block)))
    blocks = _blocks(turns)
    nodes = materialise(_nodes(turns, blocks, convs))
    sums = _subtree_sums(nodes)
    ends = materialise(_ends(blocks, convs))
    above = nodes.select(F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.where("depth > 0").join(above, ["q1", "q2"]).unionByName(
        nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    out = out.join(sums, ["d1", "d2"], "left").join(ends, ["d1", "d2"], "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        # Nodes without sums have one member: a bare path to one leaf.
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """Per conversation and block the digest before it (b1, b2) and at its end (p1, p2)."""
    summed = turns.groupBy("conv_id", "block").agg(
        F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"), F.count(F.lit(1)).alias("k")
    )
    chained = running(
        materialise(summed), ["conv_id"], ["block"], {"p1": Running("xor", "x1"), "p2": Running("xor", "x2")}
    )
    before = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"b{i}") for i in (1, 2)]
    return materialise(chained.select("conv_id", "block", "k", "p1", "p2", *before))


def _nodes(turns: DataFrame, blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``(d1, d2, depth, q1, q2, conv_id, n_convs, words, n_children)``; q is the parent's digest."""
    ends = F.struct("p1", "p2")
    groups = materialise(
        blocks.groupBy("block", "b1", "b2").agg(
            F.min(ends).alias("lo"), F.max(ends).alias("hi"), F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")
        )
    )
    agreed = groups.where("lo = hi").select("conv_id", "block", "b1", "b2", "weight")
    split = groups.where("lo != hi").select("block", "b1", "b2")
    diverging = blocks.join(sized(materialise(split)), ["block", "b1", "b2"])
    chosen = agreed.unionByName(diverging.select("conv_id", "block", "b1", "b2", F.lit(1).cast("long").alias("weight")))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = chosen.join(turns, ["conv_id", "block"]).withColumns(
        {f"d{i}": F.bit_xor(f"g{i}").over(inside).bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    )
    found = at.groupBy("d1", "d2").agg(
        (F.max("pos") + 1).alias("depth"),
        F.max(F.col("d1").bitwiseXOR(F.col("g1"))).alias("q1"),
        F.max(F.col("d2").bitwiseXOR(F.col("g2"))).alias("q2"),
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.max("words").alias("words"),
    )
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        none.alias("d1"), none.alias("d2"), none.alias("depth"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"),
        "conv_id", "n_convs", none.alias("words"),
    )
    nodes = materialise(found.unionByName(root))
    below = nodes.groupBy(F.col("q1").alias("d1"), F.col("q2").alias("d2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone")
    )
    return nodes.join(below, ["d1", "d2"], "left")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``(d1, d2, leaves, saved)`` of every node with two members or more, and of the root."""
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0) + F.coalesce("lone", F.lit(0))
    state = materialise(
        nodes.where("n_convs > 1 OR depth = 0").select(
            "d1",
            "d2",
            "depth",
            leaf.cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
            F.col("q1").alias("a1"),
            F.col("q2").alias("a2"),
        )
    )
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        given = state.where("a1 IS NOT NULL").groupBy("a1", "a2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        given = given.withColumnsRenamed({"a1": "d1", "a2": "d2"})
        onward = state.where("a1 IS NOT NULL").select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        moved = state.join(given, ["d1", "d2"], "left").join(onward, ["a1", "a2"], "left")
        state = materialise(
            moved.select(
                "d1",
                "d2",
                "depth",
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                F.col("n1").alias("a1"),
                F.col("n2").alias("a2"),
            )
        )
        step *= 2
    return state.select("d1", "d2", "leaves", "saved")


# The ids of the conversations that end at a node, as one hash.


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, conv_id) to one text of ids per node and batch."""
    for batch in batches:
        d1, d2, ids = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        starts = np.concatenate([[0], cuts]) if len(ids) else np.zeros(0, np.int64)
        stops = np.concatenate([cuts, [len(ids)]])[: len(starts)]
        listed = ids.tolist()
        texts = [",".join(map(str, listed[a:b])) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        at = starts.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d1[at]), pa.array(d2[at]), pa.array(ids[at]), pa.array(texts, pa.string())],
            names=["d1", "d2", "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, ids) to the hash of each node's ids; only one node's hash state is held."""
    at, state, out = None, None, []

    def handed() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        types = (pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["d1", "d2", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for d1, d2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d1, d2) != at:
                if state:
                    out.append((*at, state.hexdigest()))
                at, state = (d1, d2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield handed()
    if state:
        out.append((*at, state.hexdigest()))
        yield handed()


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``(d1, d2, ends_sha256)`` of every node at which a conversation ends."""
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", "p1", "p2")).alias("e"))
    none = F.lit(0).cast("long")
    ended = convs.join(last, "conv_id", "left").select(
        F.coalesce("e.p1", none).alias("d1"), F.coalesce("e.p2", none).alias("d2"), "conv_id"
    )
    texts = (
        materialise(ended)
        .repartitionByRange("d1", "d2", "conv_id")
        .sortWithinPartitions("d1", "d2", "conv_id")
        .mapInArrow(_joined, "d1 long, d2 long, first long, ids string")
    )
    return (
        texts.repartition("d1", "d2")
        .sortWithinPartitions("d1", "d2", "first")
        .select("d1", "d2", "ids")
        .mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string")
    )
