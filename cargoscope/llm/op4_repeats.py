"""Removal of repeated byte strings by a common-prefix-aware merge sort of sampled suffixes.

A byte goes when a ``LENGTH``-byte string over it also starts anywhere else. Sorting every suffix
would multiply the text; a content-defined sample is enough:

1. Every window of ``LENGTH`` bytes names an anchor, its smallest hashed 16-byte gram (leftmost of
   equals), so equal windows have equal anchors at equal places. Anchors whose 200 bytes on neither
   side occur twice cannot lie in a repeat and are dropped.
2. The suffixes at the other anchors, and their prefixes read backwards, are sorted in each task
   into runs of distinct strings. Runs are front-coded (length of the prefix shared with the string
   before, and the rest) and exchanged in blocks, split at sampled splitters.
3. Each range merges its runs with a loser tree that keeps, for every run's head, its common prefix
   with the last output; a comparison starts where known prefixes end. The merge gives each string
   its longest common prefix with any other: how far an anchor's context repeats on either side.
4. The windows that both sides allow form one span per anchor. Equal spans confirm each other; for
   the few that are left (the best partners of the two sides differ) pieces of ``PIECE`` neighbouring
   windows are compared: equal pieces confirm each other, and where what is common to a piece's windows
   occurs once, none of them repeats. Single windows are compared for the rest, one piece of each kind.

A stage is emptied as soon as the next one is written, so the disk holds few of them at a time. Workers
return freed memory after each batch, run or range: one that waits for its next task holds little.

Strings are compared across ranges through the splitter, which closes the range before it as well.
A passage that very many documents share costs each run one string. The splitters are at most
``SPLITTER_SAMPLE`` strings, whatever the input.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; rows with the
same key and text are two documents and repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, give_back
from cargoscope.llm.joins import hashed_sample, sized
from cargoscope.llm.shingles import mix
from cargoscope.session import discard, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 400, 16
HALF = LENGTH // 2
#: Window starts, by their distance to the anchor, whose common bytes are compared ahead of the windows.
PIECE = 32
#: Window starts handled at once; longer texts go in overlapping chunks.
CHUNK = 1 << 20
RUN_STRINGS, BLOCK_STRINGS, RANGE_STRINGS, SPLITTER_SAMPLE = 40_000, 64, 50_000, 40_000


# --- anchors -----------------------------------------------------------------------------------


def _grams(data: bytes) -> np.ndarray:
    """Hash of the gram at every position."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    return mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(words[8 : 8 + n]))


def anchors(data: bytes) -> np.ndarray:
    """Rows (anchor, first window start, last window start); every window start is in one row."""
    found = []
    for first in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[first : first + CHUNK + LENGTH - 1]
        ranked = (_grams(part) >> np.uint64(24) << np.uint64(24)) | np.arange(len(part) - GRAM + 1, dtype=np.uint64)
        width, size = LENGTH - GRAM + 1, 1
        while 2 * size <= width:
            ranked, size = np.minimum(ranked[:-size], ranked[size:]), 2 * size
        ranked = np.minimum(ranked[: len(ranked) - (width - size)], ranked[width - size :])
        at = (ranked & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(starts[1:], len(at)) - 1
        found.append(np.stack([at[starts], starts, ends], axis=1) + first)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _pack(a: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """An anchor with the range of its distances to window starts, in one number."""
    return (a << 20) | (near << 10) | far


def _unpack(v: int) -> tuple[int, int, int]:
    return v >> 20, (v >> 10) & 1023, v & 1023


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            row, pack, right, left = [], [], [], []
            for i, data in enumerate(part.column("data").to_pylist()):
                if data is None or len(data) < LENGTH:
                    continue
                own = anchors(data)
                row.append(np.full(len(own), i))
                pack.append(_pack(own[:, 0], own[:, 0] - own[:, 2], own[:, 0] - own[:, 1]))
                n = len(data)
                for a in own[:, 0].tolist():
                    right.append(digest(data[a : a + HALF]) if a + HALF <= n else None)
                    b = a + GRAM
                    left.append(digest(data[b - HALF : b], 1) if b >= HALF else None)
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            keys = [pa.array([None if v is None else v - (1 << 63) for v in side], pa.int64()) for side in (right, left)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("th").take(at), pa.array(np.concatenate(pack)), *keys],
                ["doc_id", "th", "pack", "after", "before"],
            )
        give_back()


# --- sorted runs -------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    differ = int.from_bytes(a[known:end]) ^ int.from_bytes(b[known:end])
    return end - (differ.bit_length() + 7) // 8


def encode_block(strings: list[bytes], counts: list[int]) -> bytes:
    """Front-coded strings: shared prefix, rest, and how often each occurs in its run."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False))]
    rest = [s[k:] for s, k in zip(strings, shared, strict=True)]
    head = np.array([shared, [len(x) for x in rest], np.minimum(counts, 2)], "<u2")
    return head.tobytes() + b"".join(rest)


def decode_block(payload: bytes, n: int) -> Iterator[tuple[bytes, int, int]]:
    """(string, prefix shared with the one before, count) of every entry."""
    shared, rest, counts = np.frombuffer(payload, "<u2", 3 * n).reshape(3, n).tolist()
    at, last = 6 * n, b""
    for k, r, c in zip(shared, rest, counts, strict=True):
        last = last[:k] + payload[at : at + r]
        at += r
        yield last, k, c


def _contexts(data: bytes, a: int) -> tuple[bytes, bytes]:
    """What follows an anchor, and what leads up to its gram's end, backwards."""
    b = a + GRAM
    return data[a : a + LENGTH], data[max(0, b - LENGTH) : b][::-1]


_RUN_COLUMNS = ["side", "run", "entry", "n", "first", "last", "payload", "doc_id", "th", "pack", "after", "before"]


def _run_writer(kind: pa.DataType):
    """Rows with side 0 or 1 are blocks of a run; rows with side -1 say which entries an anchor has."""
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), kind]
    shape = pa.schema(list(zip(_RUN_COLUMNS, [*types, pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)))

    def flush(run: int, members: list[tuple], tables: tuple[dict, dict]) -> Iterator[pa.RecordBatch]:
        place = []
        for side, table in enumerate(tables):
            ordered = sorted(table)
            place.append({s: i for i, s in enumerate(ordered)})
            rows = []
            for first in range(0, len(ordered), BLOCK_STRINGS):
                part = ordered[first : first + BLOCK_STRINGS]
                payload = encode_block(part, [table[s] for s in part])
                rows.append((side, run, first, len(part), part[0], part[-1], payload, None, None, None, None, None))
            yield _batch(rows, shape)
        named = []
        for doc_id, th, pack, after, before in members:
            named.append((-1, run, None, None, None, None, None, doc_id, th, pack, place[0][after], place[1][before]))
        yield _batch(named, shape)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, members, tables = TaskContext.get().partitionId() << 24, [], ({}, {})
        for batch in batches:
            for doc_id, th, data, packs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for pack in packs:
                    sides = _contexts(data, _unpack(pack)[0])
                    for table, s in zip(tables, sides, strict=True):
                        table[s] = table.get(s, 0) + 1
                    members.append((doc_id, th, pack, *sides))
                    if len(members) >= RUN_STRINGS:
                        yield from flush(run, members, tables)
                        run, members, tables = run + 1, [], ({}, {})
                        give_back()
        if members:
            yield from flush(run, members, tables)
            members, tables = [], ({}, {})
        give_back()

    return write


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


# --- exchange and merge ------------------------------------------------------------------------


def _splitter(splitters: list[list[bytes]]):
    """Deal blocks to ranges; a string equal to a splitter also closes the range before it."""
    shape = pa.schema(
        [("side", pa.int32()), ("part", pa.int32()), ("run", pa.int64()), ("entry", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())]
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for side, run, entry, n, first, last, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = splitters[side]
                low, high = bisect_left(cuts, first), bisect_right(cuts, last)
                if low == high:
                    rows.append((side, low, run, entry, n, payload))
                    continue
                strings, _, counts = zip(*decode_block(payload, n), strict=True)
                for part in range(low, high + 1):
                    a = bisect_left(strings, cuts[part - 1]) if part else 0
                    b = bisect_right(strings, cuts[part]) if part < len(cuts) else n
                    if a < b:
                        rows.append((side, part, run, entry + a, b - a, encode_block(list(strings[a:b]), list(counts[a:b]))))
            yield _batch(rows, shape)
        give_back()

    return deal


def merge_runs(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Merge sorted runs with a loser tree; gives (run, string, prefix shared with the output before, count).

    ``prefix[i]`` is what run i's head shares with the last output. Of two heads the one that
    shares more is smaller; only heads that share equally much are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [None] * k
    prefix, count = [0] * k, [0] * k

    def advance(i: int) -> None:
        got = next(runs[i], None) if i < len(runs) else None
        if got is None:
            head[i] = None
        else:
            head[i], prefix[i], count[i] = got

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes what it shares with the winner."""
        a, b = head[i], head[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if prefix[i] != prefix[j]:
            return (i, j) if prefix[i] > prefix[j] else (j, i)
        shared = common_prefix(a, b, prefix[i])
        if shared == len(a) and (shared < len(b) or i < j):
            first = True
        elif shared == len(b):
            first = False
        else:
            first = a[shared] < b[shared]
        winner, loser = (i, j) if first else (j, i)
        prefix[loser] = shared
        return winner, loser

    for i in range(k):
        advance(i)
        prefix[i] = 0
    losers = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        winners = []
        for at in range(node):
            w, losers[node + at] = play(level[2 * at], level[2 * at + 1])
            winners.append(w)
        level = winners
    best = level[0]
    while head[best] is not None:
        yield best, head[best], prefix[best], count[best]
        advance(best)
        at = (k + best) // 2
        while at:
            best, losers[at] = play(best, losers[at])
            at //= 2


def _merger(pdf: pd.DataFrame) -> pd.DataFrame:
    """Longest common prefix of every entry of a range with any other string of the range."""
    runs, names = [], []
    for run, own in pdf.sort_values(["run", "entry"]).groupby("run", sort=True):
        blocks = list(zip(own["payload"], own["n"], strict=True))
        names.append((run, np.concatenate([np.arange(e, e + n) for e, n in zip(own["entry"], own["n"], strict=True)])))
        runs.append(_stream(blocks))
    taken = [0] * len(runs)
    out_run, out_entry, out_prefix = [], [], []
    for i, string, shared, count in merge_runs(runs):
        run, entries = names[i]
        if out_prefix:
            out_prefix[-1] = max(out_prefix[-1], shared)
        out_run.append(run)
        out_entry.append(entries[taken[i]])
        out_prefix.append(len(string) if count > 1 else shared)
        taken[i] += 1
    side = np.full(len(out_run), pdf["side"].iloc[0], np.int32)
    merged = pd.DataFrame({"side": side, "run": out_run, "entry": out_entry, "prefix": out_prefix})
    del runs, names, out_run, out_entry, out_prefix
    give_back()
    return merged


def _stream(blocks: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, int, int]]:
    last = b""
    for payload, n in blocks:
        for k, (string, shared, count) in enumerate(decode_block(payload, n)):
            yield string, shared if k else common_prefix(last, string), count
            last = string


def _longest(runs: DataFrame) -> DataFrame:
    """``side, run, entry, prefix``: each string's longest common prefix with another one."""
    spark = runs.sparkSession
    blocks = runs.where("side >= 0").select("side", "run", "entry", "n", "first", "last", "payload")
    held = {r["side"]: r for r in blocks.groupBy("side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()}
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters: list[list[bytes]] = [[], []]
    for side, size in held.items():
        parts = min(max(ranges, -(-size["n"] // RANGE_STRINGS)), SPLITTER_SAMPLE // 4)
        seen = blocks.where(F.col("side") == side).select("run", "entry", "first")
        sample = sorted(bytes(r["first"]) for r in hashed_sample(seen, SPLITTER_SAMPLE, 4, "run", "entry").collect())
        splitters[side] = sorted({sample[len(sample) * i // parts] for i in range(1, parts)})
    dealt = blocks.mapInArrow(_splitter(splitters), "side int, part int, run long, entry int, n int, payload binary")
    merged = dealt.groupBy("side", "part").applyInPandas(_merger, "side int, run long, entry int, prefix int")
    return merged.groupBy("side", "run", "entry").agg(F.max("prefix").alias("prefix"))


# --- spans -------------------------------------------------------------------------------------


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every span's bytes, and of its anchor's gram."""
    import xxhash

    for batch in batches:
        row, pack, whole, gram = [], [], [], []
        for i, (data, packs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "packs")), strict=True)):
            for v in packs:
                a, near, far = _unpack(v)
                row.append(i)
                pack.append(v)
                whole.append(xxhash.xxh3_128_digest(data[a - far : a + LENGTH - near] + (v & 0xFFFFF).to_bytes(3)))
                gram.append(xxhash.xxh64_intdigest(data[a : a + GRAM]) - (1 << 63))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(pack, pa.int64()), pa.array(whole, pa.binary()), pa.array(gram, pa.int64())],
            ["doc_id", "th", "pack", "whole", "gram"],
        )
        give_back()


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans cut into pieces of neighbouring windows, with digests of all their bytes and of the common ones."""
    import xxhash

    for batch in batches:
        row, pack, core, whole = [], [], [], []
        for i, (data, packs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "packs")), strict=True)):
            for v in packs:
                a, near, far = _unpack(v)
                for piece in range(near // PIECE, far // PIECE + 1):
                    first, last = piece * PIECE, piece * PIECE + PIECE - 1
                    row.append(i)
                    low, high = max(near, first), min(far, last)
                    ends = (low << 10) | high
                    pack.append((a << 20) | ends)
                    whole.append(xxhash.xxh3_128_digest(data[a - high : a - low + LENGTH] + ends.to_bytes(3)))
                    # Inside every window of the piece, wherever the span ends.
                    core.append(xxhash.xxh64_intdigest(data[a - first : a - last + LENGTH], piece) - (1 << 63))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(pack, pa.int64()), pa.array(core, pa.int64()), pa.array(whole, pa.binary())],
            ["doc_id", "th", "pack", "core", "whole"],
        )
        give_back()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every window of the spans."""
    import xxhash

    for batch in batches:
        row, start, digest = [], [], []
        for i, (data, packs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "packs")), strict=True)):
            for v in packs:
                a, near, far = _unpack(v)
                for s in range(a - far, a - near + 1):
                    row.append(i)
                    start.append(s)
                    digest.append(xxhash.xxh3_128_digest(data[s : s + LENGTH]))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(start, pa.int64()), pa.array(digest, pa.binary())],
            ["doc_id", "th", "start", "digest"],
        )
        give_back()


def bucketed_texts(docs: DataFrame) -> DataFrame:
    """The texts as bytes, dealt once to buckets by a row hash ``rid``.

    Every later pass joins what was found on ``rid``; only the found side is shuffled then.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    th = F.xxhash64("text")
    rows = docs.select(_row_hash(th), _row_hash(th, 1).alias("rid2"), "doc_id", th.alias("th"), F.col("text").cast("binary").alias("data"))
    name = f"cargoscope_texts_{uuid4().hex}"
    rows.repartition(buckets, "rid").write.bucketBy(buckets, "rid").format("parquet").saveAsTable(name)
    return spark.table(name)


def _row_hash(th: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), F.isnull("doc_id"), "doc_id", th).alias("rid")


def _joined(base: DataFrame, per_doc: DataFrame, found: str, how: str = "inner") -> DataFrame:
    """Texts with what was found in them.

    Rows match on two row hashes. Only the first is a join key, so that the buckets are used; the
    second is compared as a difference, which is a plain condition.
    """
    keyed = per_doc.select(_row_hash(F.col("th")), _row_hash(F.col("th"), 1).alias("_check"), found)
    check = base["rid2"].bitwiseXOR(keyed["_check"]) == 0
    same = (base["rid"] == keyed["rid"]) & check
    return base.join(sized(keyed, F.size(found)), same, how).select(base["doc_id"], base["th"], base["data"], keyed[found])


def _with_texts(base: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with the packed anchors found in them, for a pass over the bytes."""
    per_doc = materialise(found.groupBy("doc_id", "th").agg(F.collect_set("pack").alias("packs")))
    return _joined(base, per_doc, "packs")


def repeated_windows(base: DataFrame) -> DataFrame:
    """``doc_id, th, windows`` of bucketed texts: repeated window starts as first * 1024 + (last - first)."""
    bound_batches(base.sparkSession)
    kind = base.schema["doc_id"].dataType.simpleString()
    found = materialise(
        base.select("doc_id", "th", "data").mapInArrow(_anchor_rows, f"doc_id {kind}, th long, pack long, after long, before long")
    )
    # Anchors with a half that occurs twice.
    halves = found.select("doc_id", "th", "pack", F.explode(F.array("after", "before")).alias("half")).where("half IS NOT NULL")
    twice = materialise(_repeated(halves, "half"))
    candidates = halves.join(sized(twice), "half").select("doc_id", "th", "pack")
    # Sorted runs, and their merge.
    run_kind = pa.schema([("doc_id", _arrow_type(base))]).field(0).type
    shape = "side int, run long, entry int, n int, first binary, last binary, payload binary, "
    shape += f"doc_id {kind}, th long, pack long, after int, before int"
    runs = materialise(_with_texts(base, candidates).mapInArrow(_run_writer(run_kind), shape))
    discard(found, twice)
    longest = materialise(_longest(runs))
    members = runs.where("side = -1").select("doc_id", "th", "pack", "run", "after", "before")
    right = longest.where("side = 0").select("run", F.col("entry").alias("after"), F.col("prefix").alias("right"))
    left = longest.where("side = 1").select("run", F.col("entry").alias("before"), (F.col("prefix") - GRAM).alias("left"))
    reach = members.join(right, ["run", "after"]).join(left, ["run", "before"])
    near = F.greatest(F.expr("(pack >> 10) & 1023"), LENGTH - F.col("right").cast("long"))
    far = F.least(F.expr("pack & 1023"), F.col("left").cast("long"))
    spans = reach.withColumns({"near": near, "far": far}).where("near <= far AND near >= 0").select(
        "doc_id", "th", F.expr("((pack >> 20) << 20) | (near << 10) | far").alias("pack")
    )
    # Equal spans confirm each other.
    seen = materialise(
        _with_texts(base, spans).mapInArrow(_span_rows, f"doc_id {kind}, th long, pack long, whole binary, gram long")
    )
    discard(runs, longest)
    sizes = seen.groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    sure = seen.join(sizes.where("n > 1"), "whole").select("doc_id", "th", "pack")
    open_ = materialise(sizes.where("n = 1").join(seen, "whole").select("doc_id", "th", "pack", "gram"))
    # For the others, single windows of all distinct spans at the same gram are compared.
    asked = open_.select("gram").distinct()
    one = F.min_by(F.struct("doc_id", "th", "pack"), F.xxhash64("doc_id", "th", "pack"))
    others = seen.join(asked, "gram", "left_semi").groupBy("whole").agg(one.alias("one")).select("one.*")
    pieces = materialise(
        _with_texts(base, others).mapInArrow(_piece_rows, f"doc_id {kind}, th long, pack long, core long, whole binary")
    )
    one = F.min_by(F.struct("doc_id", "th", "pack"), F.xxhash64("doc_id", "th", "pack")).alias("one")
    wholes = materialise(pieces.groupBy("whole", "core").agg(F.count(F.lit(1)).alias("n"), one))
    alike = pieces.join(sized(wholes.where("n > 1").select("whole")), "whole").select("doc_id", "th", "pack")
    unsure = wholes.groupBy("core").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"))
    unsure = materialise(unsure.where("least = 1 AND kinds > 1").select("core"))
    left_over = wholes.join(sized(unsure), "core").select("one.*")
    windows = materialise(
        _with_texts(base, left_over).mapInArrow(_window_rows, f"doc_id {kind}, th long, start long, digest binary")
    )
    # A window is in one piece only; copies of a row repeat each other.
    again = materialise(_repeated(windows, "digest"))
    single = windows.join(sized(again), "digest").select("doc_id", "th", (F.col("start") * 1024).alias("window"))
    whole = sure.unionByName(alike).select("doc_id", "th", F.expr("((pack >> 20) - (pack & 1023)) * 1024 + (pack & 1023) - ((pack >> 10) & 1023)").alias("window"))
    per_doc = whole.unionByName(single).groupBy("doc_id", "th").agg(F.collect_set("window").alias("windows"))
    result = materialise(per_doc)
    discard(seen, open_, pieces, wholes, unsure, windows, again)
    return result


def _repeated(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur more than once."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(column)


def _arrow_type(base: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(base.schema["doc_id"].dataType)


def _remover(full: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept_bytes = [], [], [], [], []
            for data, windows in zip(*(batch.column(c).to_pylist() for c in ("data", "windows")), strict=True):
                data = data or b""
                n = len(data)
                kept, runs, gone = data, 0, 0
                if windows:
                    w = np.array(windows, np.int64)
                    start = w >> 10
                    level = np.bincount(start, minlength=n + 1) - np.bincount(start + (w & 1023) + LENGTH, minlength=n + 1)
                    out = np.cumsum(level[:n]) > 0
                    runs = int((np.diff(out, prepend=False) & out).sum())
                    gone = int(out.sum())
                    kept = np.frombuffer(data, np.uint8)[~out].tobytes()
                sizes.append(n)
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_bytes.append(kept)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if full:
                columns.append(pa.array(kept_bytes, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    return remove


def remove_repeats(docs: DataFrame, *, full: bool = True) -> DataFrame:
    """Per document what was removed, a digest of the remaining bytes, and those bytes (``full``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = bucketed_texts(docs)
    joined = _joined(base, repeated_windows(base), "windows", "left")
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    return joined.select("doc_id", "data", "windows").mapInArrow(_remover(full), shape)
