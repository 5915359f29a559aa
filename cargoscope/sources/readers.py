"""Scans of the declared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargoscope.functions.cleaning import present


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_spread(spark: SparkSession, path: str, key: str | None) -> DataFrame:
    """Parquet scan whose rows are spread over all cores when the file has fewer splits than cores.

    A file of one row group would otherwise leave all per-row work to one task. Large inputs have
    splits in plenty and are read as they are.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key is None or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def scan_lines(lines: DataFrame, row_filter: str = "1=1") -> DataFrame:
    """Lines under a SQL row predicate, e.g. one month for a trial run; it is pushed to the scan."""
    return lines.where(F.expr(row_filter))


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    null_text: str = "null",
    line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header, a fixed schema and a text that stands for null.

    ``line_breaks`` reads quoted texts with line breaks whole; a file is then one split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_text)
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .csv(path)
    )


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def entity_ids(cases: DataFrame, column: str, exclude: list[int] | None = None) -> DataFrame:
    """Distinct numeric ids of a case list, less an exclusion list; unreadable ids are dropped."""
    ids = cases.select(F.col(column).try_cast("long").alias("entity_id")).where("entity_id is not null")
    if exclude:
        ids = ids.where(~F.col("entity_id").isin(*exclude))
    return ids.distinct()


def drop_missing_key(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text dimension is present."""
    return df.where(present(F.col(column)))


def exclude_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Drop rows whose id contains a text; rows without an id go too."""
    return df.where(~F.col(column).contains(text))


def left_join_all(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Fold a left join over several tables on one key.

    A payload column found in more than one table is prefixed with its table's name.
    """
    payloads = [c for df in frames.values() for c in df.columns if c != key]

    def prefixed(name: str, df: DataFrame) -> DataFrame:
        return df.select(
            key,
            *[
                F.col(c).alias(f"{name}_{c}" if payloads.count(c) > 1 else c)
                for c in df.columns
                if c != key
            ],
        )

    named = [prefixed(name, df) for name, df in frames.items()]
    return reduce(lambda left, right: left.join(right, key, "left"), named)
