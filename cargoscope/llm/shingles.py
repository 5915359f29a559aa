"""Hashed word shingles of whole texts, a batch at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from cargoscope.llm.batches import by_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (bijective)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[lists.offsets.to_numpy()]


def hash_words(words: pa.Array) -> np.ndarray:
    import xxhash

    coded = words.dictionary_encode()
    known = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()]
    return np.array(known, np.uint64)[coded.indices.to_numpy()] if known else np.zeros(0, np.uint64)


def hash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every position (as many as fit)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    factors, total = odd_numbers(width, width), None
    for k in range(width):
        term = words[k : len(words) - width + 1 + k] * factors[k]
        total = term if total is None else total + term
    return mix(total)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; fewer words than ``width`` are one shingle."""
    words, offsets = split_words(pc.ascii_lower(texts))
    hashes = hash_words(words)
    windows = hash_windows(hashes, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield mix(hash_windows(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in by_bytes(batch, "text"):
        yield part, list(shingle_sets(part.column("text"), width))
