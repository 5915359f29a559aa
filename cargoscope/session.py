"""Session helpers: checkpoint location, stage materialisation, size-checked broadcast."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_ROW_LIMIT = 1_000_000
#: Compressed bytes of a split: columns with few values unfold to many times that in a task.
SPLIT_BYTES = 16 << 20
#: Shuffle partitions for each split of the input, ahead of merging.
PARTITIONS_PER_SPLIT = 4


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, the warehouse is used: the
    one other folder that driver and executors share by definition.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def materialise(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a frame that several later branches read, and continue from the written table.

    The copy is columnar, so each branch reads only its own columns, and it outlives any executor.
    ``codec`` names a compression other than the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cargoscope-stages/{uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.__dict__["_stage_path"] = path
    return stage


def empty_frame(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema. An empty list would start Python workers for them, which then wait in every executor."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def discard(*stages: DataFrame) -> None:
    """Empty written frames that nobody reads any more; whatever was made of them must be written itself.

    Writing no rows in their place removes the files wherever Spark can write.
    """
    for stage in stages:
        path = stage.__dict__.pop("_stage_path", None)
        if path:
            empty_frame(stage.sparkSession, stage.schema).coalesce(1).write.mode("overwrite").parquet(path)


def size_tasks(spark: SparkSession, splits: int) -> None:
    """Shuffles start with partitions in proportion to the input's splits; adaptive execution merges small ones.

    A fixed number would let the sorts and hash tables of one task grow with the input, until they spill.
    """
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(default, PARTITIONS_PER_SPLIT * splits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SPLIT_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint for a reference table, given only after counting that it is small.

    A larger table goes back unhinted: the join then shuffles both sides, and adaptive
    execution splits any skewed partition of the fact side.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def local_session(app: str = "cargoscope", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

