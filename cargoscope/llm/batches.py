"""Arrow-batch helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Functions travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that rows with very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def kept_in_worker(key: str, make: Callable):
    """A value that later tasks of the same Python worker find again (tokenizers, word caches)."""
    store = sys.modules.setdefault("_cargoscope_worker", types.ModuleType("_cargoscope_worker"))
    if key not in store.__dict__:
        setattr(store, key, make())
    return getattr(store, key)


def by_bytes(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths.astype(np.int64)) // limit
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def span_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty spans give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
