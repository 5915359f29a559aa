"""Column expressions that turn raw declared text into typed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a missing entry is written in the source text columns.
MISSING_MARKERS = ("", "NULL")
# The price code that marks a line total, and the two names it maps to.
TOTAL_PRICE_CODE = "66"
PRICE_KINDS = ("Total", "PPU")


def present(c: Column) -> Column:
    """True where the text holds a value (not null, blank or a missing marker)."""
    return c.isNotNull() & ~F.trim(c).isin(*MISSING_MARKERS)


def clean_number(c: Column, dtype: str = "double") -> Column:
    """Number held as text; missing markers, junk and NaN become null.

    A tolerant cast trims by itself and turns every marker into null.
    """
    value = c.cast("string").try_cast(dtype)
    return F.nanvl(value, F.lit(None).cast("double")) if dtype == "double" else value


def arrival_day(c: Column) -> Column:
    """Date from the first ten characters of a timestamp or its text form."""
    day = F.substring(c.cast("string"), 1, 10)
    # The cast alone would also take a bare year or month.
    return F.when(F.length(day) == 10, day.try_cast("date"))


def starts_with_digits(c: Column, n: int = 4, skip_blanks: bool = True) -> Column:
    name = F.ltrim(c) if skip_blanks else c
    return name.rlike(f"^[0-9]{{{n}}}")


def is_round(value: Column, multiple: int, cents: bool = False) -> Column:
    """Value of at least 1 that is a multiple once rounded (``cents``: exact to the cent)."""
    scale = 100 if cents else 1
    units = F.round(value * scale).cast("long")
    return (value >= 1) & (units % (multiple * scale) == 0)


def hs6(chapter: Column, heading: Column, subheading: Column) -> Column:
    """Six-digit commodity code; null when any part is null."""
    return F.concat(chapter, heading, subheading)


def business_number(c: Column, anchored: bool = True) -> Column:
    """First run of nine digits (``anchored``: only at the start); null when absent."""
    return F.regexp_substr(c, F.lit("^[0-9]{9}" if anchored else "[0-9]{9}"))


def price_kind(code: Column) -> Column:
    total, per_unit = PRICE_KINDS
    trimmed = F.trim(code)
    return F.when(trimmed == TOTAL_PRICE_CODE, total).when(trimmed.isNotNull(), per_unit)


def is_near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def joined_lines(*parts: Column) -> Column:
    """Address-style lines glued without separator, a null line counting as one space."""
    return F.concat(*[F.coalesce(p, F.lit(" ")) for p in parts])


def share_where(condition: Column) -> Column:
    """Share of rows meeting a condition; a null condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def as_flag(condition: Column) -> Column:
    """0/1 integer from a condition, null counting as 0."""
    return F.when(condition, 1).otherwise(0).cast("int")


def add_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    """Standard score; null unless the spread is positive."""
    return F.when(sd > 0, (value - mean) / sd)
