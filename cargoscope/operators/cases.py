"""Case indicators on accounting lines, export lines and released records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.config import CaseConfig
from cargoscope.functions.cleaning import (
    add_all,
    business_number,
    is_near,
    share_where,
    starts_with_digits,
)
from cargoscope.functions.quantiles import named_quantiles
from cargoscope.operators.benford import benford_ks_both
from cargoscope.operators.keys import keep_first, previous_value
from cargoscope.session import materialise, small_side

# The percentile text of the precomputed indicators, a token, the marks that do not end
# a word between two letters or two digits (Unicode text segmentation), and the 13 indicators.
TOP_QUARTILE_TEXT = "Above 75th percentile"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
INNER_MARKS = (
    (r"\p{L}\p{M}*", ".:'\u00b7\u2018\u2019\u2024\u2027\ufe13\ufe52\ufe55\uff07\uff0e\uff1a", r"\p{L}"),
    (r"\p{N}", ".,;'\u037e\u2018\u2019\u2024\ufe10\ufe14\ufe50\ufe52\ufe54\uff07\uff0c\uff0e\uff1b", r"\p{N}"),
)
CASE_INDICATORS = [
    "miscalculations",
    "inconsistent_values",
    "numbered_company",
    "has_trade",
    "does_not_conform_benford_ks_1st_digit",
    "does_not_conform_benford_ks_2nd_digit",
    "high_dormancy",
    "rounded_transactions",
    "high_first_transaction",
    "inconsistent_lines_of_trade",
    "has_1_to_1_relationship",
    "trades_with_high_risk_jurisdictions",
    "has_vague_descriptions",
]


def companies(accounting: DataFrame) -> DataFrame:
    """One row per business number with the first importer id and name in id order."""
    named = accounting.select(
        "importer_id", "importer_name", business_number(F.col("importer_id")).alias("bn")
    )
    return keep_first(named, ["bn"], [F.asc("importer_id"), F.asc("importer_name")])


def numbered_company_flag(accounting: DataFrame) -> DataFrame:
    numbered = starts_with_digits(F.col("importer_name"), skip_blanks=False)
    return companies(accounting).withColumns(
        {"numbered_company": numbered, "has_trade": F.lit(True)}
    )


#: What the indicators read of the release records.
MISCALCULATION_COLUMNS = ["ax_clnt_nbr", "invoice_ppu", "unit_cnt", "invoice_total"]
PRICE_CHANGE_COLUMNS = [
    "ax_clnt_nbr", "class_cde", "msr_unit_tcde", "invoice_ppu", "audt_ins_tstmp", "clnt_sply_req_id",
    "cmrc_invc_nbr", "gagi_nbr", "gds_itm_nbr",
]
TEXT_COLUMNS = ["clnt_sply_req_id", "ax_clnt_nbr", "itm_desc_txt"]
CASE_COLUMNS = list(dict.fromkeys([*MISCALCULATION_COLUMNS, *PRICE_CHANGE_COLUMNS, *TEXT_COLUMNS]))


def price_miscalculation(release: DataFrame, tolerance: float = 1.5e-8) -> DataFrame:
    """Entities with a record whose unit price times units misses its total."""
    near = is_near(F.col("invoice_ppu") * F.col("unit_cnt"), F.col("invoice_total"), tolerance)
    return (
        release.where(~near)
        .select(F.col("ax_clnt_nbr").cast("string").alias("bn"))
        .distinct()
        .withColumn("miscalculations", F.lit(True))
    )


def price_change(release: DataFrame, strict: bool = False) -> DataFrame:
    """Entities whose unit price follows an earlier one for the same class and unit.

    The literal rule keeps any pair of consecutive known prices; ``strict`` wants them to differ.
    """
    order = ["audt_ins_tstmp", "clnt_sply_req_id", "cmrc_invc_nbr", "gagi_nbr", "gds_itm_nbr"]
    keys = ["ax_clnt_nbr", "class_cde", "msr_unit_tcde"]
    followed = previous_value(
        release.select(*keys, *order, "invoice_ppu"),
        keys,
        F.to_date("audt_ins_tstmp"),
        order,
        "invoice_ppu",
        "_prev_ppu",
    )
    difference = F.col("_prev_ppu") - F.col("invoice_ppu")
    hit = difference.isNotNull() & (difference != 0) if strict else difference.isNotNull()
    return (
        followed.where(hit)
        .select(F.col("ax_clnt_nbr").cast("string").alias("bn"))
        .distinct()
        .withColumn("inconsistent_values", F.lit(True))
    )


def trade_values(accounting: DataFrame, exports: DataFrame) -> DataFrame:
    """Import and export values on one business-number column."""
    imports = accounting.select(
        business_number(F.col("importer_id")).alias("bn"),
        F.col("value_currency_conversion").alias("value"),
    )
    out = exports.select(
        business_number(F.col("exporter_bn15")).alias("bn"),
        F.col("total_commodity_value").alias("value"),
    )
    return imports.unionByName(out)


def digit_flags(accounting: DataFrame, exports: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both Kolmogorov-Smirnov marks per business number."""
    first, pairs = benford_ks_both(trade_values(accounting, exports), "bn", "value", alpha)

    def mark(result: DataFrame, name: str) -> DataFrame:
        return result.select("bn", F.col("does_not_conform").cast("boolean").alias(name))

    return mark(first, "does_not_conform_benford_ks_1st_digit").join(
        mark(pairs, "does_not_conform_benford_ks_2nd_digit"), "bn"
    )


def one_to_one_flag(company: DataFrame, listed: DataFrame, column: str = "importer") -> DataFrame:
    marks = (
        listed.select(F.col(column).cast("string").alias("bn"))
        .distinct()
        .withColumn("has_1_to_1_relationship", F.lit(True))
    )
    return company.join(marks, "bn", "left")


def high_risk_entities(accounting: DataFrame, basel: DataFrame, minimum: float = 5.5) -> DataFrame:
    """Entities trading with a country scored at or above the minimum."""
    risky = basel.where(F.col("basel_ml_tf_risk") >= minimum).select(
        F.col("iso_code").alias("country_of_export")
    )
    return (
        accounting.join(small_side(risky), "country_of_export", "left_semi")
        .select(business_number(F.col("importer_id")).alias("bn"))
        .distinct()
        .withColumn("trades_with_high_risk_jurisdictions", F.lit(True))
    )


def precomputed_percentile_flags(indicators: DataFrame) -> DataFrame:
    """Flags from the joined precomputed indicator tables; unknown counts as false."""

    def known(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return indicators.select(
        "importer_id",
        known(F.col("dormancy_percentile_range") == TOP_QUARTILE_TEXT).alias("high_dormancy"),
        known(F.col("num_rounded_transactions") > 1).alias("rounded_transactions"),
        known(F.col("first_txn_percentile_range") == TOP_QUARTILE_TEXT).alias(
            "high_first_transaction"
        ),
        known(F.col("num_sections") > 1).alias("inconsistent_lines_of_trade"),
    ).distinct()


def natural_right_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right join on every shared column, nulls matching nulls."""
    shared = [c for c in left.columns if c in right.columns]
    added = [c for c in left.columns if c not in shared]
    renamed = left.withColumnsRenamed({c: f"_l_{c}" for c in shared})
    on = reduce(lambda a, b: a & b, [F.col(f"_l_{c}").eqNullSafe(F.col(c)) for c in shared])
    return renamed.join(right, on, "right").select(*right.columns, *added)


# -- goods descriptions --------------------------------------------------------------------


def goods_text_stats(df: DataFrame, column: str) -> DataFrame:
    """Tokens (words and single marks) and characters of the whole text; null counts as empty.

    Apostrophes, points and the like between two letters, and decimal marks between two digits, belong
    to the word around them: "don't" and "3.5" are one token each.
    """
    text = F.coalesce(column, F.lit(""))
    joined = text
    for before, marks, after in INNER_MARKS:
        joined = F.regexp_replace(joined, f"({before})[{marks}](?={after})", "$1_")
    tokens = F.regexp_count(joined, F.lit(TOKEN))
    return df.withColumns({"tokens": tokens, "chars": F.char_length(text)})


def is_vague(config: CaseConfig = CaseConfig()) -> Column:
    return (F.col("tokens") < config.vague_max_tokens) & (F.col("chars") <= config.vague_max_chars)


def vague_description(df: DataFrame, column: str, config: CaseConfig = CaseConfig()) -> DataFrame:
    return goods_text_stats(df, column).withColumn("vague_description", is_vague(config))


def vague_description_share(
    df: DataFrame, key: str, column: str, config: CaseConfig = CaseConfig()
) -> DataFrame:
    return (
        goods_text_stats(df, column)
        .groupBy(key)
        .agg(share_where(is_vague(config)).alias("prop_vague"), F.count("*").alias("row_count"))
        .withColumn("has_vague_descriptions", F.col("prop_vague") >= config.vague_share_min)
    )


def vague_bottom_quartile(df: DataFrame, column: str, q: float = 0.25) -> DataFrame:
    """Texts whose token count or length lies in the lowest quarter of all texts."""
    stats = goods_text_stats(df, column)
    # The quantile reads its input twice: keep two numbers per text rather than parse it again.
    sizes = materialise(stats.select("tokens", "chars"))
    wanted = {"token_cut": (F.col("tokens"), q), "char_cut": (F.col("chars"), q)}
    cut = named_quantiles(sizes, wanted).first()
    low = (F.col("tokens") <= cut["token_cut"]) | (F.col("chars") <= cut["char_cut"])
    return stats.withColumn("in_bottom_quartile", low)


def trade_texts(release: DataFrame, exports: DataFrame) -> DataFrame:
    """Goods descriptions of released records and export lines on common columns."""
    imports = release.select(
        F.col("clnt_sply_req_id").cast("string").alias("clnt_sply_req_id"),
        F.col("ax_clnt_nbr").cast("string").alias("bn"),
        "itm_desc_txt",
    )
    out = exports.select(
        F.col("proof_of_report_number").cast("string").alias("clnt_sply_req_id"),
        business_number(F.col("exporter_bn15")).alias("bn"),
        F.col("cargo_description").alias("itm_desc_txt"),
    )
    return imports.unionByName(out)


# -- final matrix --------------------------------------------------------------------------


def company_flag_joins(company: DataFrame, flags: list[DataFrame]) -> DataFrame:
    """Each indicator table left-joined onto the companies."""
    return reduce(lambda c, f: c.join(f, "bn", "left"), flags, company)


def case_indicator_matrix(flagged: DataFrame, config: CaseConfig = CaseConfig()) -> DataFrame:
    """The 13 indicators with nulls as false, their count and their share of 13."""
    known = {c: F.coalesce(F.col(c), F.lit(False)) for c in CASE_INDICATORS}
    total = add_all([F.col(c).cast("int") for c in CASE_INDICATORS])
    return (
        flagged.withColumns(known)
        .withColumn("total_indicators", total)
        .withColumn("proportion_of_indicators", F.col("total_indicators") / config.n_indicators)
    )
