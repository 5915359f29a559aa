"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, the smallest and the largest hash of the document's
shingles, so a signature of 2k values costs k permutations. Bands of four values (both ends of two
permutations) are the candidate keys; at the similarity looked for, a pair misses all bands with a
probability under 1e-10.

Documents with the same shingle set are one node. Within a band, nodes are not paired with each
other: rounds compare a few pivots with the members that are still in another component (the
first pivot is, of those with the fewest shingles of their own, the one that meets most others), and
a pivot leaves its band afterwards. A band is done when what is left in it is one component, so
every pair of a band is either compared on the full sets, already connected, or ruled out by an
exact bound: shingles that one candidate alone has are in no intersection and in every union, and
two sets have no more in common than the smaller of their counts in each class of shingles. Copies
of one text then cost a comparison each, not one for every pair.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a
null key is nobody's component id unless all members' are null; rows with the same key and text
are one node; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain, repeat
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargoscope.llm.batches import bound_batches
from cargoscope.llm.components import components
from cargoscope.llm.joins import same_doc, sized, whole_rows
from cargoscope.llm.shingles import mix, odd_numbers, sets_of
from cargoscope.session import discard, empty_frame, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
#: At least so many bands; as many as it takes for a pair at the similarity looked for to miss all
#: with a probability under ``MISS``.
BANDS = 32
MISS = 1e-10
#: Classes of shingles whose counts bound what two sets have in common.
CLASSES = 64
#: Pivots per band in the first, second, ... round; the last number holds from then on.
PIVOTS = (1, 8, 64, 500)


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest hash under every permutation: two values each."""
    factor, shift = odd_numbers(permutations, 71)[:, None], odd_numbers(permutations, 72)[:, None]
    low, high = None, None
    for first in range(0, len(shingles), 4096):
        hashed = factor * shingles[None, first : first + 4096] + shift
        a, b = hashed.min(axis=1), hashed.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], axis=1)


def bands(values: np.ndarray, n: int) -> np.ndarray:
    """Candidate keys: one per band, different for different bands."""
    rows = values.reshape(n, -1)
    return mix((rows * odd_numbers(rows.shape[1], 73)).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64))


def bands_for(percent: int) -> int:
    """Bands that pairs of at least ``percent`` need, for every number of shingles together.

    Both ends of a permutation are shared with probability c (c - 1) / (u (u - 1)) at c shingles of u in
    common. Sets that are equal, or have one shingle in common, are not counted.
    """
    least = (percent / 100) ** 4
    for u in range(3, 1001):
        c = -(-percent * u // 100)
        if 1 < c < u:
            least = min(least, (c * (c - 1) / (u * (u - 1))) ** 2)
    return max(BANDS, ceil(log(MISS) / log1p(-least))) if 0 < least < 1 else BANDS


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signer(width: int, permutations: int, n_bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, width):
                keys = [bands(signature(s, permutations), n_bands).view(np.int64) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("th"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "th", "n_shingles", "digest", "bands"],
                )

    return sign


def _set_writer(width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, width):
                same = [_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                spread = pa.array([np.bincount(s % CLASSES, minlength=CLASSES) for s in sets], pa.list_(pa.int32()))
                rows = pa.RecordBatch.from_arrays([part.column("nid"), held, spread], ["nid", "shingles", "classes"])
                yield rows.filter(pa.array(same))

    return write


def _checker(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    return check


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = 85,
    width: int = WIDTH,
    permutations: int | None = None,
    n_bands: int | None = None,
) -> DataFrame:
    """Per document its set size, component and whether it stays.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets. The
    number of bands follows ``percent`` unless given, two permutations a band.
    """
    n_bands = n_bands or (permutations // 2 if permutations else bands_for(percent))
    permutations = permutations or 2 * n_bands
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    signed = materialise(
        texts.withColumn("th", F.xxhash64("text")).mapInArrow(
            _signer(width, permutations, n_bands),
            f"doc_id {kind}, th long, n_shingles long, digest binary, bands array<long>",
        )
    )
    # One node per shingle set, with a number of its own and its smallest document.
    real = signed.where("n_shingles > 0")
    nodes = real.groupBy("digest").agg(
        F.min(F.struct(F.isnull("doc_id").alias("no_key"), "doc_id", "th")).alias("least"),
        F.max("n_shingles").alias("size"),
        F.first("bands").alias("bands"),
    )
    nodes = nodes.select("digest", "least.doc_id", "least.th", "size", "bands")
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()))
    labels = _linked(nodes, texts, percent, width, n_bands)
    named = nodes.join(labels, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("digest", "component_id")
    full = signed.where("n_shingles > 0").join(by_set, "digest")
    empty = signed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return (
        full.select("doc_id", "n_shingles", "component_id", "th")
        .unionByName(empty.select("doc_id", "n_shingles", "component_id", "th"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "th")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of every component; rows without words all stay.

    Of several rows with the component's key the one with the smallest text hash stays, once.
    """
    judged = materialise(near_duplicates(docs, **how))
    chosen = judged.where("kept AND n_shingles > 0").groupBy("component_id").agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("n"))
    chosen = materialise(chosen.select(F.col("component_id").alias("c"), F.col("th").alias("t"), "n"))
    same = F.col("component_id").eqNullSafe(F.col("c")) & F.col("kept") & (F.col("th") == F.col("t"))
    gone = judged.where("n_shingles > 0").join(chosen, same, "left_anti").select("doc_id", "th").distinct()
    gone = sized(materialise(gone))
    rows = whole_rows(docs)
    left = rows.join(gone, same_doc(rows, gone), "left_anti")
    if not chosen.where("n > 1").isEmpty():
        # Rows with equal key and text: all but one go.
        words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]"))
        blank = F.coalesce(words, F.lit(0)) == 0
        left = left.where(blank).unionByName(left.where(~blank).dropDuplicates(["doc_id", "th"]))
    return left.select("row.*")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each node's text: that of its member, and not of other rows with the member's key."""
    hashed = texts.withColumn("th", F.xxhash64("text"))
    return hashed.join(wanted, same_doc(hashed, wanted)).select("nid", "digest", "text")


def _rounds() -> Iterator[int]:
    """Pivots per band, round after round without end."""
    return chain(PIVOTS, repeat(PIVOTS[-1]))


def _linked(nodes: DataFrame, texts: DataFrame, percent: int, width: int, n_bands: int) -> DataFrame:
    """``(nid, component)`` of the nodes that have a link.

    A row per node and band holds numbers only. What bounds a pair from inside the sets (``facts``) is kept
    once per node, and goes to the band rows after the first round, when few bands are left.
    """
    member = nodes.select("nid", F.posexplode("bands").alias("place", "band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = materialise(member.join(shared, "band"))
    weight = materialise(meeting.groupBy("nid").agg(F.sum("n").alias("weight")))
    marks = F.transform("bands", lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int"))
    wanted = nodes.join(weight, "nid").select("nid", "digest", "doc_id", "th")
    sets = materialise(_texts_of(texts, wanted).mapInArrow(_set_writer(width), "nid long, shingles array<long>, classes array<int>").dropDuplicates(["nid"]))
    # Shingles that no other candidate has: no partner can share them.
    own = sets.select("nid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("nid"))
    own = own.where("n = 1").groupBy("nid").agg(F.count(F.lit(1)).alias("own"))
    known = sets.select("nid", "classes").join(nodes.select("nid", "size", marks.alias("marks")), "nid").join(weight, "nid").join(own, "nid", "left")
    # A node with too many shingles of its own cannot be linked with any other.
    facts = materialise(known.withColumn("own", F.coalesce("own", F.lit(0))).where(100 * F.expr("size - own") >= percent * F.col("size")))
    numbers, inner = facts.select("nid", "size", "own", "weight"), facts.select("nid", "marks", "classes")
    waiting = materialise(meeting.drop("n").join(numbers, "nid"))
    discard(meeting, weight)
    labels = empty_frame(nodes.sparkSession, StructType.fromDDL("nid long, component long"))
    read = [waiting]
    for turn, pivots in enumerate(_rounds()):
        state = waiting.join(labels, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        spread = state.groupBy("band").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("own").alias("least_own")
        )
        # Out goes a band that is one component, and who has too little in common with all that is left.
        state = state.join(spread.where("c0 != c1"), "band").where(
            100 * F.expr("size - own") >= percent * F.expr("size + least_own")
        )
        state = materialise(state.drop("c0", "c1", "least_own"))
        discard(*read)
        if state.isEmpty():
            break
        first = Window.partitionBy("band").orderBy("own", F.desc("weight"), "nid")
        chosen = state.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= pivots)
        chosen = materialise(chosen.drop("place", "weight", "rank"))
        pairs = _first_pairs(state, chosen, facts, percent) if turn == 0 else _more_pairs(state, chosen, percent, n_bands)
        checked = (
            pairs.join(sets.select("nid", F.col("shingles").alias("left")), "nid")
            .join(sets.select(F.col("nid").alias("p_nid"), F.col("shingles").alias("right")), "p_nid")
            .mapInArrow(_checker(percent), "a long, b long")
        )
        checked = materialise(checked.distinct())
        if not checked.isEmpty():
            # What is linked are components so far; their own components name all their members anew.
            merged = components(checked).withColumnRenamed("component", "new")
            old = labels.unionByName(merged.select(F.col("node").alias("nid"), F.col("node").alias("component"))).distinct()
            old = old.join(merged, old["component"] == merged["node"], "left")
            labels = materialise(old.select("nid", F.coalesce("new", "component").alias("component")).distinct())
        waiting = state.join(chosen.select("band", "nid"), ["band", "nid"], "left_anti").drop("component")
        if turn == 0:
            waiting = waiting.join(inner, "nid")
        read = [state]
    discard(sets, facts)
    return labels


_SIDES = ("nid", "size", "own", "component")
#: What a pair can have in common at most, by the counts of both sets in every class of shingles.
_COMMON = " + ".join(f"least(classes[{i}], p_classes[{i}])" for i in range(CLASSES))


def _met(state: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Members and pivots of a band that are not yet connected and whose own shingles leave enough in common."""
    most = F.least(F.expr("size - own"), F.expr("p_size - p_own"))
    least = F.greatest(F.expr("size + p_own"), F.expr("p_size + own"))
    met = state.join(near, "band").where("nid != p_nid AND component != p_component")
    return met.where(100 * most >= percent * least)


def _first_pairs(state: DataFrame, chosen: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """One pivot a band: there are no more pairs than rows, so facts are fetched for the pairs.

    No node has a component other than itself yet.
    """
    near = chosen.select("band", *[F.col(c).alias(f"p_{c}") for c in _SIDES])
    met = _met(state, near, percent).select(
        F.least("nid", "p_nid").alias("nid"), F.greatest("nid", "p_nid").alias("p_nid")
    ).distinct()
    ones = facts.select("nid", "size", "classes")
    both = met.join(ones, "nid").join(ones.withColumnsRenamed({c: f"p_{c}" for c in ("nid", "size", "classes")}), "p_nid")
    return both.where(100 * F.expr(_COMMON) >= percent * (F.expr("size + p_size") - F.expr(_COMMON))).select(
        "nid", "p_nid", F.col("nid").alias("a"), F.col("p_nid").alias("b")
    )


def _more_pairs(state: DataFrame, chosen: DataFrame, percent: int, n_bands: int) -> DataFrame:
    """Many pivots a band: pairs are ruled out before they are made, and made in the first band that they share."""
    near = chosen.select("band", *[F.col(c).alias(f"p_{c}") for c in (*_SIDES, "marks", "classes")])
    same = " ".join(f"WHEN marks[{i}] = p_marks[{i}] THEN {i}" for i in range(n_bands))
    met = _met(state, near, percent).where(f"CASE {same} END = place")
    near_enough = 100 * F.expr(_COMMON) >= percent * (F.expr("size + p_size") - F.expr(_COMMON))
    sides = ("nid", "p_nid", F.col("component").alias("a"), F.col("p_component").alias("b"))
    return met.where(near_enough).select(*sides).distinct()
