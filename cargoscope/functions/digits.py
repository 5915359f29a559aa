"""Expected digit distributions and digit extraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_shares(test: str) -> dict[int, float]:
    """Digit -> expected share under the logarithmic law for one of the three tests."""

    def mass(lead: int) -> float:
        return math.log10((lead + 1) / lead)

    if test == "first":
        return {d: mass(d) for d in range(1, 10)}
    if test == "second":
        return {d: math.fsum(mass(10 * lead + d) for lead in range(1, 10)) for d in range(10)}
    if test == "first_two":
        return {d: mass(d) for d in range(10, 100)}
    raise ValueError(f"unknown digit test {test!r}")


def integer_digit(value: Column, position: int) -> Column:
    """Digit at ``position`` of the integer part; null when the value is too small to have it."""
    digits = F.floor(value).cast("string")
    return F.when(value >= 10 ** (position - 1), F.substring(digits, position, 1).cast("int"))


def significant_digits(value: Column, count: int) -> Column:
    """Leading ``count`` significant digits as an integer; null for zero or null values.

    Works on the decimal text, so a value such as 0.3 gives 3 (or 30) whatever its binary form.
    Values too large or too small for ten decimal places are read from their mantissa.
    """
    size = F.abs(value)
    plain = F.when(size >= 1e-6, size.try_cast("decimal(38,10)")).cast("string")
    mantissa = F.regexp_replace(size.cast("double").cast("string"), "E.*", "")
    text = F.coalesce(plain, mantissa)
    digits = F.regexp_replace(F.regexp_replace(text, r"[^0-9]", ""), "^0+", "")
    return F.when(F.length(digits) > 0, F.rpad(F.substring(digits, 1, count), count, "0").cast("int"))
