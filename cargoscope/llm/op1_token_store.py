"""Token-id files with a minimal perfect hash index.

``write_store`` encodes whole texts and lays their ids down as raw little-endian integers, one file
per range of keys, in ascending key order. A minimal perfect hash (one small structure per bucket
of keys: levels of bit arrays, a key sits on the first level where no other key hits its bit, its
slot is the number of set bits before it) maps every key to its place without storing keys; a
32-bit fingerprint per slot tells absent keys. ``lookup`` and ``read_ids`` answer keyed access in
constant time per key.

Defined results: a null text is empty and holds the end id alone; a null key sorts first; rows with
the same key are kept in the order of their first ``LEAD`` characters (then of the text's hash) and told
apart by ``copy`` (0, 1, ...); an empty table gives an empty store. A key may hold any share of the rows:
its texts are dealt over the files and its copies numbered by a segmented scan. An id that does not fit
the width of a stored id is an error. An absent key is taken for a present one with probability 2**-32.

Files go through Arrow's file systems (local, HDFS, S3, GCS) to a folder all executors share. A
task writes under a name of its own and moves the finished file, so a repeated task replaces it
with the same bytes.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, by_bytes
from cargoscope.llm.encoding import encoder, with_end
from cargoscope.operators.segments import positions
from cargoscope.session import materialise, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys per bucket of the index: bounds the memory of a task that builds or reads one.
BUCKET_KEYS = 50_000
#: Bits per key and level; more of them make fewer levels.
GAMMA = 2.0
#: Leading characters by which rows with the same key are ordered and dealt to files.
LEAD = 64
MAX_LEVELS = 40


@dataclass
class TokenStore:
    folder: str
    id_bytes: int
    buckets: int
    manifest: DataFrame
    index: DataFrame


# --- payload -----------------------------------------------------------------------------------


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":", "://", 1))


def _shard(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.bin"


def _writer(folder: str, path: str, keeps_space: bool, end_id: int, id_bytes: int):
    kind = np.dtype(f"<u{id_bytes}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        shard = TaskContext.get().partitionId()
        own = encoder(path, keeps_space)
        draft = f"{root}/_draft-{shard:06d}-{uuid4().hex}"
        at, out = 0, None
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids, offsets = with_end(*own.encode(part.column("text")), end_id)
                if len(ids) and int(ids.max()) >= 1 << (8 * id_bytes):
                    raise ValueError(f"token id {int(ids.max())} does not fit {id_bytes} bytes")
                if out is None:
                    out = files.open_output_stream(draft)
                out.write(ids.astype(kind).tobytes())
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(offsets[:-1] + at),
                        pa.array(np.diff(offsets)),
                    ],
                    ["key", "shard", "offset", "n_tokens"],
                )
                at += len(ids)
        if out is not None:
            out.close()
            files.move(draft, _shard(root, shard))
        own.rest()

    return write


# --- minimal perfect hash ----------------------------------------------------------------------


def _spread(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Bits of all levels, bits per level, and every key's slot. Keys are distinct (h1, h2) pairs."""
    left, bits, sizes = np.arange(len(h1)), [], []
    slot = np.full(len(h1), -1, np.int64)
    taken = 0
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = int(GAMMA * len(left)) // 64 * 64 + 64
        at = (_spread(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        row = np.zeros(size, bool)
        row[at[alone]] = True
        slot[left[alone]] = taken + np.cumsum(row)[at[alone]] - 1
        taken += int(alone.sum())
        bits.append(row)
        sizes.append(size)
        left = left[~alone]
    # Keys that met on every level (never seen) take the last slots and are found by fingerprint.
    slot[left] = taken + np.arange(len(left))
    return np.concatenate(bits) if bits else np.zeros(0, bool), sizes, slot


def find_slots(bits: np.ndarray, sizes: list[int], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot, -1 if no level has its bit set."""
    before = np.cumsum(bits) - bits
    slot, left, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = start + (_spread(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slot[left[hit]] = before[at[hit]]
        left, start = left[~hit], start + size
    return slot


_INDEX = "bucket long, n_keys int, n_set int, levels array<int>, bits binary, fingerprints binary, places binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    bits, sizes, slot = build_hash(h1, h2)
    prints, places = np.empty(len(pdf), "<u4"), np.empty((len(pdf), 3), "<i8")
    prints[slot] = (h2 >> np.uint64(32)).astype("<u4")
    places[slot] = pdf[["shard", "offset", "n_tokens"]].to_numpy(np.int64)
    return pd.DataFrame(
        {
            "bucket": [pdf["bucket"].iloc[0]],
            "n_keys": [len(pdf)],
            "n_set": [int(bits.sum())],
            "levels": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "fingerprints": [prints.tobytes()],
            "places": [places.tobytes()],
        }
    )


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    found = keys.drop(columns=["bucket", "h1", "h2"])
    if index.empty:
        return found.assign(shard=0, offset=0, n_tokens=0).iloc[:0]
    one = index.iloc[0]
    h1, h2 = (keys[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    sizes = [int(x) for x in one["levels"]]
    bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=sum(sizes)).astype(bool)
    prints = np.frombuffer(one["fingerprints"], "<u4")
    places = np.frombuffer(one["places"], "<i8").reshape(-1, 3)
    slot, own = find_slots(bits, sizes, h1, h2), (h2 >> np.uint64(32)).astype("<u4")
    for i in np.flatnonzero(slot < 0):
        rest = np.flatnonzero(prints[one["n_set"] :] == own[i])
        slot[i] = one["n_set"] + rest[0] if len(rest) else -1
    ok = (slot >= 0) & (prints[slot] == own)
    at = places[slot[ok]]
    return found[ok].assign(shard=at[:, 0].astype(np.int32), offset=at[:, 1], n_tokens=at[:, 2])


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    """Two independent hashes of (key, copy) and the bucket."""
    return df.withColumns(
        {
            "h1": F.xxhash64(F.lit(1), F.isnull("key"), "key", "copy"),
            "h2": F.xxhash64(F.lit(2), F.isnull("key"), "key", "copy"),
        }
    ).withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), F.isnull("key"), "key", "copy"), F.lit(buckets)))


# --- store -------------------------------------------------------------------------------------


def write_store(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int,
    keeps_space: bool = False,
    key: str = "doc_id",
    text: str = "text",
    id_bytes: int = 2,
    folder: str | None = None,
) -> TokenStore:
    """Encode ``docs`` into files in ascending key order and index them.

    ``id_bytes`` is the width of a stored id (2 holds vocabularies of up to 65,536 ids).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/token-store-{uuid4().hex}"
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    order = [F.col("key"), F.substring("text", 1, LEAD), F.xxhash64("text")]
    laid = (
        # The salt deals equal rows over several files; rows that are alike may be in any order.
        rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(shards, *order, "salt")
        .sortWithinPartitions(*order, "text")
        .select("key", "text")
        .mapInArrow(
            _writer(folder, tokenizer_path, keeps_space, end_id, id_bytes),
            f"key {kind}, shard int, offset long, n_tokens long",
        )
    )
    laid = materialise(laid)
    manifest = positions(laid, ["key"], ["shard", "offset"], "copy").withColumn("copy", F.col("copy").cast("int"))
    manifest = materialise(manifest)
    buckets = max(1, -(-laid.count() // BUCKET_KEYS))
    index = _hashed(manifest, buckets).groupBy("bucket").applyInPandas(_build, _INDEX)
    return TokenStore(folder, id_bytes, buckets, manifest, materialise(index))


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Places of keys: ``key``, ``copy`` in; those present come back with shard, offset, n_tokens."""
    asked = _hashed(keys.select("key", "copy").distinct(), store.buckets)
    kind = asked.schema["key"].dataType.simpleString()
    return (
        asked.groupBy("bucket")
        .cogroup(store.index.groupBy("bucket"))
        .applyInPandas(_find, f"key {kind}, copy int, shard int, offset long, n_tokens long")
    )


def _reader(folder: str, id_bytes: int, digest: bool):
    """Ids (or their crc32) of rows that come sorted by shard and offset; one open file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        now, file = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")]
            out = []
            for shard, offset, n in zip(*columns, strict=True):
                if shard != now:
                    now, file = shard, files.open_input_file(_shard(root, shard))
                raw = file.read_at(n * id_bytes, offset * id_bytes)
                ids = np.frombuffer(raw, f"<u{id_bytes}").astype("<u4").tobytes()
                out.append(zlib.crc32(ids) if digest else ids)
            value = pa.array(out, pa.int64() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, "value"])

    return read


def read_ids(store: TokenStore, places: DataFrame, digest: bool = False) -> DataFrame:
    """The ids at ``places`` from the files: ``ids`` (little-endian unsigned 32-bit) or ``ids_crc32``."""
    kind = places.schema["key"].dataType.simpleString()
    columns = ["key", "copy", "shard", "offset", "n_tokens"]
    shape = f"key {kind}, copy int, shard int, offset long, n_tokens long, value {'long' if digest else 'binary'}"
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By range of (shard, offset), so that a file with very many rows is read by several tasks.
    ordered = places.select(*columns).repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")
    read = ordered.mapInArrow(_reader(store.folder, store.id_bytes, digest), shape)
    return read.withColumnRenamed("value", "ids_crc32" if digest else "ids")


def starts(store: TokenStore) -> DataFrame:
    """Ids before each shard: one row per shard."""
    sizes = store.manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def document_index(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write a store, ask it for every document, and return what its files hold."""
    store = write_store(docs, tokenizer_path, **how)
    key = how.get("key", "doc_id")
    asked = store.manifest.select("key", "copy")
    got = read_ids(store, lookup(store, asked), digest=True)
    return got.join(starts(store), "shard").select(
        F.col("key").alias(key),
        (F.col("shard_start") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
        "offset",
    )
