"""Digit-distribution tests per importer."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import add_all
from cargoscope.functions.digits import expected_shares, integer_digit, significant_digits
from cargoscope.session import materialise

# The recursion runs in executor processes that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_POSITION = {"first": 1, "second": 2}


def benford_digit_counts(txn: DataFrame, value: str, test: str, keys: tuple = ("bn_9",)) -> DataFrame:
    """Digit histogram per importer; values too small to have the digit are left out."""
    digit = integer_digit(F.col(value), _POSITION[test])
    return (
        txn.select(*keys, digit.alias("d"))
        .where(F.col("d").isin(*expected_shares(test)))
        .groupBy(*keys, "d")
        .agg(F.count("*").alias("n"))
    )


def pivot_digits(counts: DataFrame, test: str) -> DataFrame:
    """One count column per digit, absent digits as 0."""
    digits = list(expected_shares(test))
    wide = counts.groupBy("bn_9").pivot("d", digits).agg(F.sum("n"))
    return wide.select("bn_9", *[F.coalesce(F.col(str(d)), F.lit(0)).alias(f"d{d}") for d in digits])


def tested_digit(value: str, test: str) -> Column:
    """The digit a test looks at. As a column of its own it is worked out once, not for every count."""
    return integer_digit(F.col(value), _POSITION[test])


def digit_aggregates(digit: str, test: str, prefix: str) -> list[Column]:
    """One conditional count per digit, for use beside other per-importer aggregates."""
    return [F.count_if(F.col(digit) == d).alias(f"{prefix}{d}") for d in expected_shares(test)]


def deviation(prefix: str, test: str) -> tuple[Column, Column]:
    """(observations, mean absolute deviation from the expected shares) of digit count columns."""
    shares = expected_shares(test)
    total = add_all([F.col(f"{prefix}{d}") for d in shares])
    gaps = [F.abs(F.col(f"{prefix}{d}") / total - F.lit(p)) for d, p in shares.items()]
    return total, F.when(total > 0, add_all(gaps) / len(shares))


def benford_mad(
    txn: DataFrame,
    value: str,
    test: str,
    min_txns: int,
    threshold: float | Column,
    keys: tuple = ("bn_9",),
) -> DataFrame:
    """Deviation, observations and flag per importer with at least one tested value.

    ``threshold`` may be an expression over ``n``, see ``size_adjusted_threshold``.
    """
    digits = txn.select(*keys, tested_digit(value, test).alias("_digit"))
    counts = digits.groupBy(*keys).agg(*digit_aggregates("_digit", test, "_d"))
    n, mad = deviation("_d", test)
    flag = (F.col("n") >= min_txns) & (F.col("mad") > threshold)
    return (
        counts.select(*keys, mad.alias("mad"), n.alias("n"))
        .where("n > 0")
        .withColumn("flag", flag.cast("int"))
    )


def size_adjusted_threshold(test: str, sds: float = 3.0) -> Column:
    """Deviation a conforming sample of size ``n`` exceeds only by chance.

    Expected mean absolute deviation of a conforming sample under the normal approximation plus
    ``sds`` standard deviations (digits treated as independent).
    """
    shares = expected_shares(test).values()
    spread = [math.sqrt(p * (1 - p)) for p in shares]
    mean = math.sqrt(2 / math.pi) * math.fsum(spread) / len(spread)
    sd = math.sqrt((1 - 2 / math.pi) * math.fsum(s * s for s in spread)) / len(spread)
    return F.lit(mean + sds * sd) / F.sqrt("n")


# -- Kolmogorov-Smirnov form ---------------------------------------------------------------

#: Gaps of a sample and of the null distribution lie on one lattice: the margin keeps equal ones equal.
KS_MARGIN = 1e-9
#: Statistics beyond this are exceeded with a probability under 2 exp(-2 x^2) < 1e-12 and count as 0.
KS_CERTAIN = 3.8


def leading_pairs(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, two significant digits, count): what both tests need, from one reading of the values."""
    return (
        values.select(key, significant_digits(F.col(value), 2).alias("pair"))
        .where("pair is not null")
        .groupBy(key, "pair")
        .agg(F.count("*").alias("c"))
    )


def ks_statistic(values: DataFrame, key: str, value: str, test: str) -> DataFrame:
    """sqrt(n) times the largest gap between observed and expected cumulative digit shares."""
    return ks_of_pairs(leading_pairs(values, key, value), key, test)


def ks_of_pairs(pairs: DataFrame, key: str, test: str) -> DataFrame:
    """The statistic of the first digit, or of the first two, from ``leading_pairs``.

    Between two digits that occur the observed share is flat while the expected one grows, so
    the gap peaks either at an occurring digit or just ahead of one.
    """
    lowest = min(expected_shares(test))
    digit = F.col("pair") if lowest > 9 else F.floor(F.col("pair") / 10).cast("int")
    counts = pairs.groupBy(key, digit.alias("d")).agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen, n = F.sum("c").over(upto), F.sum("c").over(whole)
    ahead = F.abs((seen - F.col("c")) / n - F.log10(F.col("d") / lowest))
    here = F.abs(seen / n - F.log10((F.col("d") + 1) / lowest))
    return (
        counts.select(key, n.alias("n"), F.greatest(ahead, here).alias("gap"))
        .groupBy(key)
        .agg(F.max("n").alias("n"), F.max("gap").alias("gap"))
        .select(key, "n", (F.col("gap") * F.sqrt("n")).alias("statistic"))
    )


def ks_p_value(n: int, statistic: float, shares: list[float]) -> float:
    """Probability that a conforming sample of ``n`` values reaches ``statistic``; exact to about 1e-12.

    A sample's digit counts are independent Poisson numbers, given that they sum to n. Its cumulative
    counts walk over the digits, and the weights of all walks that stay inside the band around the
    expected line follow from one convolution per digit.
    """
    if statistic >= KS_CERTAIN:
        return 0.0
    reach = (statistic - KS_MARGIN) * math.sqrt(n)
    low, walk, expected = 0, np.ones(1), 0.0
    for share in shares:
        expected += share
        line = n * min(expected, 1.0)
        below = max(0, math.floor(line - reach) + 1)
        above = min(n, math.ceil(line + reach) - 1)
        if below > above:
            return 1.0
        least, most = max(0, below - low - len(walk) + 1), above - low
        if most < 0:
            return 1.0
        x = np.arange(least, most + 1)
        rate = n * share
        weights = np.exp(x * math.log(rate) - rate - _log_factorial(least, most))
        both = _convolved(walk, weights)
        # Neither end of the band ever moves back, so the sums begin at or ahead of it.
        walk = both[below - low - least : above - low - least + 1]
        low = below
    inside = walk[n - low] * math.exp(math.lgamma(n + 1) + n - n * math.log(n)) if 0 <= n - low < len(walk) else 0.0
    return min(1.0, max(0.0, 1.0 - inside))


def _log_factorial(least: int, most: int) -> np.ndarray:
    """log x! for x from ``least`` to ``most``."""
    steps = np.concatenate([[math.lgamma(least + 1)], np.log(np.arange(least + 1, most + 1, dtype=float))])
    return np.cumsum(steps)


def _convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) * len(b) < 1 << 24:
        return np.convolve(a, b)
    size = 1 << (len(a) + len(b) - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1], 0.0)


def _p_values(test: str):
    shares = list(expected_shares(test).values())

    def look_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = [ks_p_value(int(n), float(x), shares) for n, x in zip(part["n"], part["statistic"], strict=True)]
            yield part.assign(p_value=np.array(p, float))

    return look_up


def with_p_values(stats: DataFrame, key: str, test: str, alpha: float = 0.05) -> DataFrame:
    """Statistics (key, n, statistic) with their exact p-values and the non-conformity mark.

    The distinct (n, statistic) pairs are spread over the tasks; each is a recursion over the digits
    whose width grows with the root of n.
    """
    stats = materialise(stats)
    pairs = stats.select("n", "statistic").distinct()
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p_values = pairs.repartition(parts, "n", "statistic").mapInPandas(
        _p_values(test), "n long, statistic double, p_value double"
    )
    return (
        stats.join(p_values, ["n", "statistic"])
        .select(key, "n", "statistic", "p_value")
        .withColumn("does_not_conform", (F.col("p_value") <= alpha).cast("int"))
    )


def benford_ks(values: DataFrame, key: str, value: str, test: str, alpha: float = 0.05) -> DataFrame:
    """Statistic, exact p-value and non-conformity mark per key."""
    return with_p_values(ks_statistic(values, key, value, test), key, test, alpha)


def benford_ks_both(values: DataFrame, key: str, value: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The tests of the first digit and of the first two, from one reading of the values."""
    pairs = materialise(leading_pairs(values, key, value))
    return tuple(with_p_values(ks_of_pairs(pairs, key, t), key, t, alpha) for t in ("first", "first_two"))
