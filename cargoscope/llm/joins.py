"""Joins of documents with what was found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A written side with at most this many rows or array entries (of 8 to 24 bytes) is broadcast.
BROADCAST_ENTRIES = 1_500_000


def sized(df: DataFrame, entries: Column | None = None, limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """Broadcast hint if the written table is small; else it is left to a shuffled join.

    ``entries`` counts what a row holds (default 1). The result is the same either way.
    """
    total = df.agg(F.sum(entries if entries is not None else F.lit(1))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    """Equal key (nulls equal) and equal text hash ``th``."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def whole_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, the text's hash ``th`` and the whole row as ``row``, whatever its columns are called."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct("*").alias("row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows named by the written table ``gone`` (doc_id, th)."""
    rows, small = whole_rows(docs), sized(gone)
    return rows.join(small, same_doc(rows, small), "left_anti").select("row.*")


def hashed_sample(df: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """At most ``n`` rows: those with the lowest hash of ``columns``.

    A cut on the hash, from the row count, comes first: what is ordered then follows ``n``, and not
    the number of tasks, each of which would otherwise hand on ``n`` rows.
    """
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)))
    share = min(1.0, 2.0 * n / max(df.count(), 1))
    return hashed.where(F.col("_h") < int(share * (1 << 40))).orderBy("_h", *columns).limit(n).drop("_h")
