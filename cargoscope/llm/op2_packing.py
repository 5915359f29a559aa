"""Best-fit packing with dominance reduction.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. What the packing depends
on is the histogram of piece lengths, which has at most ``capacity`` rows however large the corpus
is. On it:

1. reduction (Martello and Toth): going from the longest length down, a set of at most three pieces
   that dominates every other set holding the longest one is fixed as a sequence, for as many
   sequences as the counts allow; this repeats until nothing can be fixed;
2. what is left is placed best-fit, longest first, whole counts at a time.

The plan is a list of ranges: the r-th piece of a length goes to this sequence and offset. Pieces
get their rank within their length in blocks (rank inside a block, plus the counts of the blocks
before it), so a length that holds a third of all pieces is spread over all tasks.

Defined results: a null text is empty (one piece holding the end id); repeated rows are packed as
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, by_bytes
from cargoscope.llm.encoding import MAX_WORDS, encoder, with_end
from cargoscope.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text encoded at a time: words, places and ids of a slice take many times that.
SLICE_BYTES = 2 << 20
#: Pieces per block in which ranks are counted.
BLOCK_PIECES = 500_000


# --- pieces ------------------------------------------------------------------------------------


def _cutter(path: str, keeps_space: bool, end_id: int, capacity: int, with_ids: bool, slice_bytes: int, words: int):
    def pieces_of(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        total = np.diff(offsets)
        n = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        head = total - (n - 1) * capacity  # the first piece takes what is over
        start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
        length = np.where(piece == 0, head[row], capacity)
        raw, first = memoryview(ids.astype("<u4", copy=False)).cast("B"), (offsets[row] + start) * 4
        spans = [raw[a : a + 4 * k] for a, k in zip(first.tolist(), length.tolist(), strict=True)]
        columns = [
            part.column("doc_id").take(pa.array(row)),
            pa.array(piece.astype(np.int32)),
            pa.array(start),
            pa.array(length),
            pa.array([zlib.crc32(x) for x in spans], pa.int64()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, keeps_space, words=words)
        for batch in batches:
            for part in by_bytes(batch, "text", slice_bytes):
                yield pieces_of(part, *with_end(*own.encode(part.column("text")), end_id))
        own.rest()

    return cut


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int,
    keeps_space: bool,
    capacity: int,
    with_ids: bool = False,
    slice_bytes: int = SLICE_BYTES,
    words: int = MAX_WORDS,
) -> DataFrame:
    """One row per piece of every document, with its ids if asked for.

    ``slice_bytes`` of text are encoded at a time and about ``words`` words are remembered: they bound a
    worker's memory, not the result.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(
        _cutter(tokenizer_path, keeps_space, end_id, capacity, with_ids, slice_bytes, words), shape
    )


# --- plan on the histogram ---------------------------------------------------------------------

Pattern = tuple[tuple[tuple[int, int], ...], int]


def _largest_pair(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int]:
    """The two pieces with the largest sum within ``room``; (0, 0) if no two fit."""
    larger = np.arange(len(sizes))
    smaller = np.minimum(np.searchsorted(sizes, room - sizes, side="right") - 1, larger)
    smaller -= (smaller == larger) & (counts < 2)  # its own length again needs a second piece
    ok = smaller >= 0
    if not ok.any():
        return 0, 0
    a, b = sizes[ok], sizes[smaller[ok]]
    best = int(np.argmax(a + b))
    return int(a[best]), int(b[best])


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix dominating sets; ``counts`` (by length) keeps what is left."""
    fixed: list[Pattern] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        runs = tuple((x, lengths.count(x)) for x in dict.fromkeys(lengths))
        for x, c in runs:
            counts[x] -= c * times
        fixed.append((runs, times))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                rest = counts.copy()
                rest[j] -= 1
                sizes = np.flatnonzero(rest)
                room = capacity - j
                if not len(sizes) or sizes[0] > room:
                    fix((j,), int(counts[j]))
                    changed = True
                    continue
                partner = int(sizes[np.searchsorted(sizes, room, side="right") - 1])
                smallest = np.repeat(sizes[:3], np.minimum(rest[sizes[:3]], 3))[:3]
                pair = int(counts[j]) // 2 if partner == j else int(min(counts[j], counts[partner]))
                if partner == room or smallest[:2].sum() > room or len(smallest) < 2:
                    fix((j, partner), pair)
                    changed = True
                    continue
                if smallest.sum() <= room and len(smallest) == 3:
                    break  # three more pieces fit: nothing is known to dominate
                a, b = _largest_pair(sizes, rest[sizes], room)
                if partner >= a + b:
                    fix((j, partner), pair)
                    changed = True
                    continue
                above = sizes[sizes > b]
                two = np.repeat(above[:2], np.minimum(rest[above[:2]], 2))[:2]
                if a == partner and (len(two) < 2 or two.sum() > room):
                    need = {x: (j, a, b).count(x) for x in (j, a, b)}
                    fix((j, a, b), int(min(counts[x] // c for x, c in need.items())))
                    changed = True
                    continue
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit, longest first, for whole counts at a time; equal sequences are handled together."""
    groups: dict[tuple[tuple[int, int], ...], int] = {}
    by_room: dict[int, list[tuple[tuple[int, int], ...]]] = {}

    def put(runs: tuple[tuple[int, int], ...], room: int, times: int) -> None:
        if times:
            if runs not in groups:
                by_room.setdefault(room, []).append(runs)
            groups[runs] = groups.get(runs, 0) + times

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        if not left:
            continue
        for room in sorted(r for r in by_room if r >= size):
            fit = room // size
            for runs in by_room.pop(room):
                times = groups.pop(runs)
                full, over = (times, 0) if left >= fit * times else divmod(left, fit)
                left -= full * fit + over
                put((*runs, (size, fit)), room - fit * size, full)
                put((*runs, (size, over)), room - over * size, 1 if over else 0)
                put(runs, room, times - full - bool(over))
            if not left:
                break
        fit = capacity // size
        put(((size, fit),), capacity - fit * size, left // fit)
        if left % fit:
            put(((size, left % fit),), capacity - left % fit * size, 1)
    return list(groups.items())


def packing_plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Ranges of ranks per length with their sequence and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = reduce_dominated(counts, capacity)
    patterns += best_fit(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for runs, times in patterns:
        offset = 0
        for length, copies in runs:
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    plan = pd.DataFrame(rows, columns=["length", "first", "sequence", "copies", "offset"], dtype=np.int64)
    return plan.sort_values(["length", "first"], ignore_index=True)


# --- assignment --------------------------------------------------------------------------------


def _placer(plan: pd.DataFrame, names: list[str]):
    length, first, sequence, copies, offset = (plan[c].to_numpy(np.int64) for c in plan.columns)
    wide = 1 << 48
    order = length * wide + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(order, size * wide + rank, side="right") - 1
            i = rank - first[at]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(sequence[at] + i // copies[at]), pa.array(offset[at] + i % copies[at] * size)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 0,
    keeps_space: bool = True,
    capacity: int = 2048,
    with_ids: bool = False,
    slice_bytes: int = SLICE_BYTES,
    words: int = MAX_WORDS,
) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` there."""
    spark = docs.sparkSession
    how = {"end_id": end_id, "keeps_space": keeps_space, "capacity": capacity, "slice_bytes": slice_bytes, "words": words}
    cut = materialise(pieces(docs, tokenizer_path, with_ids=with_ids, **how))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_PIECES))
    names = cut.columns
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("in_block", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = ranked.join(bases, ["block", "length"]).select(*names, (F.col("base") + F.col("in_block")).alias("rank"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(packing_plan(histogram, capacity), names), shape)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (from ``pack(..., with_ids=True)``): at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return joined.select("sequence_id", "length", F.unhex(F.concat_ws("", "parts.ids")).alias("ids"))
