"""Joins and row selection on keys that may be null or dominated by one value.

Statistics are aggregated per key (combined map-side) and joined back, rather than computed in
a window over the key: an aggregate never gathers a key's rows in one task, and adaptive
execution splits a skewed join partition, while a window partition cannot be split.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import clean_number
from cargoscope.operators.segments import Running, running
from cargoscope.session import materialise

#: Bits of one row of a key bitmap, of a whole one (32 MB in every executor), and for each key as far as that goes.
_ROW_BITS, _MOST_BITS, _KEY_BITS = 1 << 15, 1 << 28, 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, all columns kept: the first in an explicit order.

    Only one row per key and task survives ahead of the shuffle (the top-1 limit is pushed
    below it), so a dominant key costs no more than any other.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows carrying the highest version of their key; ties stay, as do all-null groups."""
    newest = df.groupBy(*keys).agg(F.max(version).alias("_newest"))
    joined = null_safe_join(df, newest, keys)
    return joined.where(F.col(version).eqNullSafe(F.col("_newest"))).drop("_newest")


def previous_value(
    df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """Value of the previous row within a key.

    ``block`` must not decrease along ``order`` (for instance the day of a timestamp) and goes ahead of it.
    A dominant key is cut into segments, even where all its rows fall into one block.
    """
    blocked = df.withColumn("_block", block)
    found = running(blocked, keys, ["_block", *order], {"_prev": Running("previous", value)}, in_buckets=True)
    return found.withColumnRenamed("_prev", out).drop("_block")


def fill_down_up(
    df: DataFrame, keys: list[str], block: list[str], order: list[str], columns: list[str]
) -> DataFrame:
    """Fill nulls per key from the last known value before, else the first known one after.

    Rows are taken in ascending ``block + order``, which must tell all rows of a key apart as
    far as ``columns`` differ. A dominant key is cut into segments of that order.
    """
    wanted = {f"_dn_{c}": Running("last", c) for c in columns} | {f"_up_{c}": Running("next", c) for c in columns}
    filled = running(df, keys, [*block, *order], wanted)
    return filled.select(*[F.coalesce(f"_dn_{c}", f"_up_{c}").alias(c) if c in columns else c for c in df.columns])


def dedup_latest_version(lines: DataFrame, key: str = "clnt_sply_req_id") -> DataFrame:
    """Lines of each key's highest version; the version may be padded text with missing marks."""
    numbered = lines.withColumn("_version", clean_number(F.col("req_vers_nbr"), "int"))
    return latest_version(numbered, [key], "_version").drop("_version")


def current_lines(lines: DataFrame, key: str | None) -> DataFrame:
    """The lines to count: all of them, or each key's highest version."""
    return lines if key is None else dedup_latest_version(lines, key)


def version_magnitude(lines: DataFrame, key: str = "clnt_sply_req_id") -> DataFrame:
    """Keys filed under more than one version, with the number of versions."""
    versions = F.countDistinct(clean_number(F.col("req_vers_nbr"), "int"))
    return lines.groupBy(key).agg(versions.alias("n_versions")).where("n_versions > 1")


@dataclass(frozen=True)
class KeyBitmap:
    """Hashes of a list of keys as bits: it never denies a listed key and is broadcast however long the list.

    For rows that an exact step looks at later: a row kept in error (one in 16, more only beyond 17 million keys) is no more than a row not saved.
    """

    rows: DataFrame
    bits: int

    @classmethod
    def of(cls, listed: DataFrame, keys: list[str]) -> KeyBitmap:
        """``listed`` is read twice: pass a written frame."""
        wanted = -(-listed.count() * _KEY_BITS // _ROW_BITS)
        bits = _ROW_BITS * max(1, min(wanted, _MOST_BITS // _ROW_BITS))
        place = _place(keys, bits)
        marks = F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
        return cls(materialise(listed.groupBy(F.bitmap_bucket_number(place).alias("_row")).agg(marks)), bits)

    def marked(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """``df`` with a boolean column: false where the key is not in the list."""
        place = _place(keys, self.bits)
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = df.join(F.broadcast(self.rows), F.bitmap_bucket_number(place) == F.col("_row"), "left")
        set_bit = F.getbit(byte, (at % 8).cast("int")) == 1
        return found.withColumn(name, F.coalesce(set_bit, F.lit(False))).drop("_row", "_bits")


def _place(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1
