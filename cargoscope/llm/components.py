"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.session import materialise


def _minima(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every ``a``, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b); the component is its smallest node.

    Every step is an aggregate joined back to the edges, so a node with very many neighbours is
    combined before the shuffle and its edges can be split over tasks; each step is written, so a
    lost executor costs one step at most.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minima(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()
        low = _minima(down)
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b``, and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down + up > 1 AND down > 0").isEmpty()
