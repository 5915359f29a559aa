"""Rows of several frames side by side, matched by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.session import materialise

#: Low bits of ``monotonically_increasing_id``: the row's place in its partition.
_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based position, in partition order.

    Each row is written with its partition and its place there; one count per partition, never more
    rows than partitions, gives the offsets. Only a frame in a fixed order (sorted by a key without
    ties, or a scan) has positions with a meaning; no rows pass through one task.
    """
    placed = df.select(
        F.struct("*").alias("row"),
        F.spark_partition_id().alias("seg"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("place"),
    )
    placed = materialise(placed)
    counts = placed.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("seg", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    position = (F.col("offset") + F.col("place")).alias(name)
    return placed.join(F.broadcast(offsets), "seg").select(position, "row")


def bind_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of both frames, row by row in their own order.

    Frames of unequal length, and columns that both frames have, are refused.
    """
    twice = sorted(set(left.columns) & set(right.columns))
    if twice:
        raise ValueError(f"columns in both frames: {', '.join(twice)}")
    a, b = materialise(numbered(left)), materialise(numbered(right))
    lengths = a.count(), b.count()
    if lengths[0] != lengths[1]:
        raise ValueError(f"frames of {lengths[0]} and {lengths[1]} rows cannot be bound by position")
    both = a.withColumnRenamed("row", "_left").join(b.withColumnRenamed("row", "_right"), "position")
    return both.select("_left.*", "_right.*")
