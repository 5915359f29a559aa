"""Entries of a text column that hold no usable number: how many, why, and which rows to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import clean_number, present
from cargoscope.session import small_side

# Why an entry cannot be used.
REASONS = ("null", "blank", "mark", "unreadable")


def unusable_reason(c: Column, dtype: str = "double") -> Column:
    """One of ``REASONS``, or null where the text reads as a number."""
    null, blank, mark, unreadable = REASONS
    return (
        F.when(c.isNull(), null)
        .when(F.trim(c) == "", blank)
        .when(~present(c), mark)
        .when(clean_number(c, dtype).isNull(), unreadable)
    )


def unusable_counts(df: DataFrame, column: str, keys: list[str], dtype: str = "double") -> DataFrame:
    """Unusable entries per key and reason; reasons that do not occur give no row."""
    reason = unusable_reason(F.col(column), dtype).alias("reason")
    return df.select(*keys, reason).where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n_records"))


def unusable_sample(
    df: DataFrame, column: str, keys: list[str], size: int = 20, dtype: str = "double"
) -> DataFrame:
    """Per reason its count and the ``size`` rows with the lowest hash of ``keys``, numbered from 1.

    The hash makes the sample independent of partitioning. Each task hands on at most ``size`` rows a
    reason (the ranking limit is pushed ahead of the shuffle), and samples of parts merge into that of the
    whole. Ties of the hash are broken by the keys and the entry; a null key counts as empty in the hash.
    """
    rows = df.select(*keys, column, unusable_reason(F.col(column), dtype).alias("reason")).where("reason is not null")
    hashed = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    order = Window.partitionBy("reason").orderBy("_hash", *keys, column)
    lowest = rows.withColumn("_hash", hashed).withColumn("sample_no", F.row_number().over(order))
    counts = small_side(rows.groupBy("reason").agg(F.count("*").alias("n_records")))
    sample = lowest.where(F.col("sample_no") <= size).drop("_hash")
    return sample.join(counts, "reason").select("reason", "n_records", "sample_no", *keys, column)
