"""Running values within a key of any size: a segmented prefix scan over range partitions.

The rows are range-partitioned by key and order, so that a dominant key is cut into as many segments
as it needs. Running values are computed inside each segment; what a segment inherits follows from one
summary row per segment, of which there are never more than partitions. No window covers a whole key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.session import materialise, shared_dir

#: Spark's own limit for the buckets of a table is 100,000.
_MOST_BUCKETS = 10_000


@dataclass(frozen=True)
class Running:
    """A running value of ``column``, a name (``row``: the 0-based position, without a column).

    ``sum`` and ``xor`` include the row itself; ``last`` is the latest known value up to the row,
    ``before`` the latest known one ahead of it, ``previous`` the value of the row ahead, known or not,
    ``next`` the first known value from the row on.
    """

    kind: str
    column: str | None = None


def running(
    df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, Running], in_buckets: bool = False
) -> DataFrame:
    """``df`` with running values per key in ascending ``order`` (nulls first).

    Null keys form one key; no keys make the frame one. Rows that ``order`` does not tell apart follow
    each other in any order. The frame is read once and written once; as rows are also spread by their
    place, it should be a scan or a written frame, whose places do not change when a task runs again.
    ``in_buckets`` writes every segment to a bucket of a table: its rows are then not shuffled once more.
    """
    scan = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all")))
    scan = scan.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    scan = scan.repartitionByRange("_key", *order, "_salt").drop("_salt").withColumn("_seg", F.spark_partition_id())
    scan = _bucketed(scan) if in_buckets else materialise(scan)
    forward = {name: what for name, what in wanted.items() if what.kind != "next"}
    inside = Window.partitionBy("_seg", "_key").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    # A growing frame in reversed order: a shrinking one would be read anew for every row.
    back = Window.partitionBy("_seg", "_key").orderBy(*[F.desc(_name(c)) for c in order])
    from_here = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = scan.withColumns(
        {f"_l_{n}": _inside(what, from_here if what.kind == "next" else so_far, ahead) for n, what in wanted.items()}
    )
    for part, backwards in ((forward, False), ({n: w for n, w in wanted.items() if n not in forward}, True)):
        if part:
            carried = F.broadcast(_carried(scan, order, part, backwards))
            on = (F.col("_seg") == F.col("_c_seg")) & F.col("_key").eqNullSafe(F.col("_c_key"))
            joined = joined.join(carried, on, "left").drop("_c_seg", "_c_key")
    return joined.select(
        *[_name(c) for c in df.columns], *[_whole(name, what).alias(name) for name, what in wanted.items()]
    )


def _bucketed(scan: DataFrame) -> DataFrame:
    """The written frame, each segment whole in one bucket: what is grouped by segment stays where it is read."""
    spark = scan.sparkSession
    default = spark.conf.get("spark.sql.shuffle.partitions")
    buckets = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default))
    name = f"cargoscope_segments_{uuid4().hex}"
    writer = scan.write.option("path", f"{shared_dir(spark)}/cargoscope-stages/{name}").option("compression", "zstd")
    writer.bucketBy(min(buckets, _MOST_BUCKETS), "_seg").format("parquet").saveAsTable(name)
    return spark.table(name)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's 0-based place within its key."""
    return running(df, keys, order, {name: Running("row")})


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def _inside(what: Running, so_far: Window, ahead: Window) -> Column:
    """The running value within the row's own segment."""
    if what.kind == "row":
        return F.count(F.lit(1)).over(so_far) - 1
    column = _name(what.column)
    if what.kind == "sum":
        return F.sum(column).over(so_far)
    if what.kind == "xor":
        return F.bit_xor(column).over(so_far)
    if what.kind in ("last", "next"):
        return F.last(column, ignorenulls=True).over(so_far)
    if what.kind == "before":
        return F.last(column, ignorenulls=True).over(ahead)
    return F.last(F.struct(column.alias("v"))).over(ahead)


def _summary(what: Running, order: Iterable[str]) -> Column:
    """What the rows of one segment and key hand on."""
    if what.kind == "row":
        return F.count(F.lit(1))
    column, place = _name(what.column), F.struct(*map(_name, order))
    if what.kind == "sum":
        return F.sum(column)
    if what.kind == "xor":
        return F.bit_xor(column)
    if what.kind == "previous":
        return F.max_by(F.struct(column.alias("v")), place)
    if what.kind == "next":
        return F.min_by(column, F.when(column.isNotNull(), place))
    return F.max_by(column, F.when(column.isNotNull(), place))


def _merged(what: Running, column: str, over: Window) -> Column:
    if what.kind in ("row", "sum"):
        return F.sum(column).over(over)
    if what.kind == "xor":
        return F.bit_xor(column).over(over)
    return F.last(column, ignorenulls=True).over(over)


def _whole(name: str, what: Running) -> Column:
    local, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if what.kind == "row":
        return local + F.coalesce(carry, F.lit(0))
    if what.kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if what.kind == "xor":
        return F.coalesce(local.bitwiseXOR(carry), local, carry)
    best = F.coalesce(local, carry)
    return best["v"] if what.kind == "previous" else best


def _carried(scan: DataFrame, order: list[str], wanted: dict[str, Running], backwards: bool) -> DataFrame:
    """What each segment's first key brings from the segments before, or its last key from those after.

    At most one row per segment: of a segment only the key at its end can go on in the next one.
    """
    ends = scan.groupBy("_seg").agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
    giving, taking, turn = ("first", "last", F.desc("_seg")) if backwards else ("last", "first", F.asc("_seg"))
    edge = ends.select(F.col("_seg").alias("_e_seg"), giving)
    at_edge = scan.join(F.broadcast(edge), (F.col("_seg") == F.col("_e_seg")) & (F.col("_key") == F.col(giving)))
    sums = at_edge.groupBy("_e_seg").agg(*[_summary(what, order).alias(f"t_{name}") for name, what in wanted.items()])
    by_key = Window.partitionBy(giving).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_turn = Window.partitionBy(F.lit(0)).orderBy(turn)
    whole = ends.join(F.broadcast(sums), F.col("_seg") == F.col("_e_seg")).withColumns(
        {f"m_{name}": _merged(what, f"t_{name}", by_key) for name, what in wanted.items()}
    )
    handed = whole.withColumns(
        {"from": F.lag(giving).over(in_turn)} | {f"_c_{n}": F.lag(f"m_{n}").over(in_turn) for n in wanted}
    )
    return handed.where(F.col("from") == F.col(taking)).select(
        F.col("_seg").alias("_c_seg"), F.col(taking).alias("_c_key"), *[f"_c_{n}" for n in wanted]
    )
