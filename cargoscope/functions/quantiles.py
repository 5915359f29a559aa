"""Exact linear-interpolated quantiles that never gather a whole group in one task.

A mergeable sketch first brackets the wanted rank; the distinct values inside the bracket (about 0.1 % of a
large group) are then counted in a distributed aggregate. Where no key has more than ``LISTED`` of them
they are sorted in a list per key; else running counts over range partitions find the rank, so that no
task holds more than its partition. The answer equals ``percentile(x, q)`` exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.operators.keys import null_safe_join
from cargoscope.operators.segments import Running, running
from cargoscope.session import materialise

ACCURACY = 10_000
_MARGIN = 5.0 / ACCURACY
#: Most values of one key that are sorted in a list: those of a group too small for a bracket.
LISTED = ACCURACY + 1


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """One row per key with the ``q`` quantile of ``value`` (nulls ignored)."""
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    lower, upper = max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0)
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", [0.0, lower, upper, 1.0], ACCURACY).alias("_b"),
        F.count("*").alias("_n"),
    )
    # Below ACCURACY rows the margin is less than a few ranks wide, so keep every distinct value.
    wide = F.col("_n") <= ACCURACY
    sketch = sketch.select(
        *keys,
        "_n",
        F.when(wide, F.col("_b")[0]).otherwise(F.col("_b")[1]).alias("_lo"),
        F.when(wide, F.col("_b")[3]).otherwise(F.col("_b")[2]).alias("_hi"),
    )
    # All values below the bracket make one row, the null one; it comes first.
    kept = null_safe_join(values, sketch, keys).where("_v <= _hi")
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counts = materialise(kept.groupBy(*keys, "_n", inside.alias("_w")).agg(F.count("*").alias("_c")))
    longest = counts.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    rank = (F.col("_n") - 1) * F.lit(float(q))
    ends = (F.floor(rank), F.ceil(rank))
    found = _from_lists(counts, keys, ends) if longest <= LISTED else _from_sums(counts, keys, ends)
    low, high = (F.coalesce(c, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")) for c in ("_low", "_high"))
    return found.select(*keys, (low + (high - low) * (rank - F.floor(rank))).alias(name))


def _from_lists(counts: DataFrame, keys: list[str], ends: tuple[Column, Column]) -> DataFrame:
    """The values at both ranks, where every key's distinct values fit a short sorted list."""
    listed = counts.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_w", "_c"))).alias("_in")
    )
    return listed.select(*keys, "_n", *[_value_at(r).alias(c) for r, c in zip(ends, ("_low", "_high"), strict=True)])


def _from_sums(counts: DataFrame, keys: list[str], ends: tuple[Column, Column]) -> DataFrame:
    """The same for any number of values: running counts over range partitions, of which two rows are kept."""
    summed = running(counts, keys, ["_w"], {"_upto": Running("sum", "_c")})
    at = [(F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r) for r in ends]
    return summed.where(at[0] | at[1]).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.max(F.when(at[0], F.col("_w"))).alias("_low"), F.max(F.when(at[1], F.col("_w"))).alias("_high")
    )


def _value_at(rank: Column) -> Column:
    """Value holding the 0-based ``rank`` among sorted (value, count) pairs; null if it lies below the bracket."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("hit"))

    def step(acc, pair):
        seen = acc["seen"] + pair["_c"]
        hit = F.coalesce(acc["hit"], F.when((rank >= acc["seen"]) & (rank < seen), pair["_w"]))
        return F.struct(seen.alias("seen"), hit.alias("hit"))

    return F.aggregate("_in", start, step, lambda acc: acc["hit"])


def named_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row, one column per name: the quantile of an expression over the whole frame.

    Rows where the expression is null are left out, so a filter is written as ``when(cond, x)``.
    """
    by_q: dict[float, list[str]] = {}
    for name, (_, q) in wanted.items():
        by_q.setdefault(q, []).append(name)
    out = None
    for q, names in by_q.items():
        pairs = F.array(
            *[F.struct(F.lit(n).alias("_name"), wanted[n][0].cast("double").alias("_x")) for n in names]
        )
        long = df.select(F.inline(pairs))
        found = exact_quantile(long, ["_name"], "_x", q, "_q")
        wide = found.groupBy().agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names])
        # Both sides are single-row global aggregates.
        out = wide if out is None else out.withColumns(
            {n: wide.select(n).scalar() for n in names}
        )
    return out
