"""Preparation of the small reference tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import clean_number

# The name pattern of a rate column, its home currency, and a section heading line.
RATE_COLUMN = r"^FX([A-Z]{3})CAD$"
HOME_CURRENCY = "CAD"
SECTION_LINE = r"^\s*Section\s+([IVXL]+):\s+Chapters?\s+([0-9]+)(?:\s*-\s*([0-9]+))?"


def fx_wide_to_long(wide: DataFrame, date_column: str = "date", rate_type: str = "double") -> DataFrame:
    """One row per (day, currency) from a table with one rate column per currency.

    Blank rates are dropped and the home currency is added at 1 for every day.
    """
    rates = [c for c in wide.columns if re.match(RATE_COLUMN, c, re.IGNORECASE)]
    day = F.col(date_column).cast("date").alias("fx_date")
    text = wide.select(day, *[F.col(c).cast("string") for c in rates])
    foreign = text.unpivot(["fx_date"], rates, "rate_column", "rate_text").select(
        "fx_date",
        F.upper(F.substring("rate_column", 3, 3)).alias("ccy"),
        clean_number(F.col("rate_text"), rate_type).alias("rate_to_cad"),
    )
    home = wide.select(day).distinct().select(
        "fx_date",
        F.lit(HOME_CURRENCY).alias("ccy"),
        F.lit(1).cast(rate_type).alias("rate_to_cad"),
    )
    return foreign.where("rate_to_cad is not null").unionByName(home)


def fx_coverage(fx: DataFrame) -> DataFrame:
    return fx.agg(
        F.count("*").alias("n_rows"),
        F.min("fx_date").alias("min_date"),
        F.max("fx_date").alias("max_date"),
    )


def hs_section_map(text: DataFrame, column: str = "value") -> DataFrame:
    """Chapter -> section from heading lines; a range of chapters becomes one row per chapter."""
    line = F.col(column)
    first = F.regexp_extract(line, SECTION_LINE, 2).try_cast("int")
    last = F.regexp_extract(line, SECTION_LINE, 3).try_cast("int")
    chapter = F.explode(F.sequence(first, F.coalesce(last, first)))
    return (
        text.where(line.rlike(SECTION_LINE))
        .select(F.regexp_extract(line, SECTION_LINE, 1).alias("hs_section"), chapter.alias("chapter"))
        .select(F.lpad(F.col("chapter").cast("string"), 2, "0").alias("hs_chap_nbr"), "hs_section")
    )


def basel_index(raw: DataFrame, high_risk_min: float = 5.5) -> DataFrame:
    """Country risk index with its high-risk mark."""
    score = F.col("basel_ml_tf_risk").cast("double")
    return raw.select(
        F.upper(F.trim("iso_code")).alias("iso_code"),
        "country",
        score.alias("basel_ml_tf_risk"),
        (score >= high_risk_min).cast("int").alias("high_risk_ind"),
    )


def country_codes(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Country names and regions; ``names`` maps source columns to the four standard ones."""
    return raw.select(
        *[
            (F.upper(F.trim(source)) if target == "country_code" else F.col(source)).alias(target)
            for source, target in names.items()
        ]
    )


def explode_codes(df: DataFrame, column: str, delimiter: str = "or") -> DataFrame:
    """One row per code of a delimited code column (the delimiter is literal, blanks are trimmed)."""
    pieces = F.split(F.col(column), re.escape(delimiter))
    return df.withColumn(column, F.explode(pieces)).withColumn(column, F.trim(column))


def party_type_codes(raw: DataFrame, code: str = "rltd_pty_tcde", delimiter: str = "or") -> DataFrame:
    return (
        explode_codes(raw, code, delimiter)
        .select(F.col(code).alias("pty_tcde"), "description")
        .dropna("any")
    )


def party_descriptions(codes: DataFrame) -> DataFrame:
    return codes.select("description").distinct()
