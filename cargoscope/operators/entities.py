"""Lines and transactions -> one row per importer.

Each operator is an aggregate over a list of expressions, so a plan can put several lists into
one pass over the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.config import RiskConfig
from cargoscope.functions.cleaning import (
    as_flag,
    clean_number,
    count_where,
    hs6,
    is_round,
    present,
    share_where,
    starts_with_digits,
)
from cargoscope.operators.keys import null_safe_join
from cargoscope.session import materialise, small_side


def section_lookup(lines: DataFrame, sections: DataFrame) -> DataFrame:
    return lines.join(small_side(sections), "hs_chap_nbr", "left")


def basel_lookup(lines: DataFrame, basel: DataFrame) -> DataFrame:
    """Lines with the high-risk mark of the vendor country; an unknown country counts as 0."""
    index = basel.select(F.col("iso_code").alias("_iso"), F.col("high_risk_ind").alias("_risk"))
    return (
        lines.join(small_side(index), F.col("vendor_cntry_cde") == F.col("_iso"), "left")
        .withColumn("high_risk_ind", F.coalesce("_risk", F.lit(0)))
        .drop("_iso", "_risk")
    )


def consolidator_mark(config: RiskConfig) -> Column:
    return as_flag(F.countDistinct("importer_name") >= config.consolidator_min_names)


def consolidators(lines: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Name, consignee and transaction diversity per importer, and the consolidator mark."""
    return lines.groupBy("bn_9").agg(*consolidator_aggregates(config))


def consolidator_aggregates(config: RiskConfig) -> list[Column]:
    return [
        F.countDistinct("importer_name").alias("distinct_importer_names"),
        F.countDistinct("consignee_name").alias("distinct_consignees"),
        F.countDistinct("clnt_sply_req_id").alias("txn_cnt"),
        consolidator_mark(config).alias("is_consolidator"),
    ]


def consolidator_summary(cons: DataFrame) -> DataFrame:
    return cons.agg(
        F.count("*").alias("n_entities"), F.sum("is_consolidator").alias("n_consolidators")
    )


def value_aggregates() -> list[Column]:
    """Per-importer value figures over the transaction table."""
    exact = F.sum(F.col("txn_value_cad").cast("decimal(28,6)"))
    return [
        F.count("*").alias("txn_cnt"),
        exact.cast("double").alias("total_value_cad"),
        F.try_divide(exact.cast("double"), F.count("txn_value_cad")).alias("avg_txn_value_cad"),
        F.max("txn_value_cad").alias("max_txn_value_cad"),
        F.min("arrival_date").alias("first_arrival"),
        F.max("arrival_date").alias("last_arrival"),
    ]


def entity_value_features(txn: DataFrame) -> DataFrame:
    return txn.groupBy("bn_9").agg(*value_aggregates())


def goods_diversity_aggregates() -> list[Column]:
    code = hs6(F.col("hs_chap_nbr"), F.col("hs_hd_sfx"), F.col("hs_sbhd_sfx"))
    return [
        F.countDistinct(code).alias("distinct_hs6"),
        F.countDistinct("hs_chap_nbr").alias("distinct_chapters"),
        F.countDistinct("hs_section").alias("distinct_sections"),
    ]


def line_diversity_aggregates() -> list[Column]:
    return [
        F.count("*").alias("line_cnt"),
        *goods_diversity_aggregates(),
        F.countDistinct("vendor_name").alias("distinct_vendors"),
        F.countDistinct("vendor_cntry_cde").alias("distinct_vendor_countries"),
    ]


def entity_line_features(lines: DataFrame, sections: DataFrame) -> DataFrame:
    return section_lookup(lines, sections).groupBy("bn_9").agg(*line_diversity_aggregates())


def entity_line_side(lines: DataFrame, sections: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Line features and the consolidator mark from one reading of the lines.

    A value's copies meet in a hash aggregate ahead of the shuffle, so counting several columns costs
    expressions per line, not rows on the network. (Dictionary-coded bit sets were measured slower.)
    """
    return section_lookup(lines, sections).groupBy("bn_9").agg(
        *line_diversity_aggregates(), consolidator_mark(config).alias("is_consolidator")
    )


def line_share_aggregates() -> list[Column]:
    """Shares over all lines; a line without a usable price counts as not round."""
    price = F.col("price_val")
    return [
        share_where(starts_with_digits(F.col("importer_name"))).alias("importer_numbered_share"),
        share_where(starts_with_digits(F.col("vendor_name"))).alias("vendor_numbered_share"),
        share_where(is_round(price, 1000)).alias("round_1000_share"),
        share_where(is_round(price, 100)).alias("round_100_share"),
        F.max("high_risk_ind").alias("any_high_risk"),
        share_where(F.col("high_risk_ind") == 1).alias("high_risk_share"),
    ]


def entity_line_indicators(
    lines: DataFrame, basel: DataFrame, config: RiskConfig = RiskConfig()
) -> DataFrame:
    priced = lines.withColumn("price_val", clean_number(F.col("price_val_total"), config.price_type))
    return basel_lookup(priced, basel).groupBy("bn_9").agg(*line_share_aggregates())


def entity_line_profile(
    lines: DataFrame, sections: DataFrame, basel: DataFrame, config: RiskConfig = RiskConfig()
) -> DataFrame:
    """Diversity, shares and consolidator mark in a single pass over the lines.

    A line counts in three groups: its goods and country, its vendor, its importer's name. The groups, with
    their line counts, are written; marks of a name and distinct values are taken from them, not from lines.
    """
    price = F.col("price_val")
    priced = lines.withColumn("price_val", clean_number(F.col("price_val_total"), config.price_type))
    goods = ["hs_chap_nbr", "hs_hd_sfx", "hs_sbhd_sfx", "hs_section", "vendor_cntry_cde", "high_risk_ind"]
    named = ["vendor_name", "importer_name"]
    looked_up = basel_lookup(section_lookup(priced, sections), basel).select(
        "bn_9",
        *goods,
        *named,
        as_flag(is_round(price, 1000)).alias("_round_1000"),
        as_flag(is_round(price, 100)).alias("_round_100"),
    )
    sets = [["bn_9", *goods], *[["bn_9", name] for name in named]]
    groups = looked_up.groupingSets([[F.col(c) for c in s] for s in sets], "bn_9", *goods, *named).agg(
        F.grouping("hs_chap_nbr").alias("_no_goods"),
        F.grouping("vendor_name").alias("_no_vendor"),
        F.grouping("importer_name").alias("_no_importer"),
        F.count("*").alias("_n"),
        F.sum("_round_1000").alias("_round_1000"),
        F.sum("_round_100").alias("_round_100"),
    )
    groups = materialise(groups)
    line_cnt = F.sum("_n")

    def share(lines_meeting: Column) -> Column:
        return lines_meeting.cast("double") / line_cnt.cast("double")

    def numbered(name: str) -> Column:
        return share(F.sum(F.when(starts_with_digits(F.col(name)), F.col("_n")).otherwise(0)))

    by_goods = groups.where("_no_goods = 0").groupBy("bn_9").agg(
        line_cnt.alias("line_cnt"),
        *goods_diversity_aggregates(),
        F.countDistinct("vendor_cntry_cde").alias("distinct_vendor_countries"),
        share(F.sum("_round_1000")).alias("round_1000_share"),
        share(F.sum("_round_100")).alias("round_100_share"),
        F.max("high_risk_ind").alias("any_high_risk"),
        share(F.sum(F.when(F.col("high_risk_ind") == 1, F.col("_n")).otherwise(0))).alias("high_risk_share"),
    )
    # A group per name: counting the groups with a name counts the names.
    by_vendor = groups.where("_no_vendor = 0").groupBy("bn_9").agg(
        F.count("vendor_name").alias("distinct_vendors"), numbered("vendor_name").alias("vendor_numbered_share")
    )
    by_importer = groups.where("_no_importer = 0").groupBy("bn_9").agg(
        as_flag(F.count("importer_name") >= config.consolidator_min_names).alias("is_consolidator"),
        numbered("importer_name").alias("importer_numbered_share"),
    )
    joined = null_safe_join(null_safe_join(by_goods, by_vendor, ["bn_9"]), by_importer, ["bn_9"])
    return joined.select(
        "bn_9",
        "line_cnt",
        "distinct_hs6",
        "distinct_chapters",
        "distinct_sections",
        "distinct_vendors",
        "distinct_vendor_countries",
        "importer_numbered_share",
        "vendor_numbered_share",
        "round_1000_share",
        "round_100_share",
        "any_high_risk",
        "high_risk_share",
        "is_consolidator",
    )


def entity_features_join(value: DataFrame, line_side: DataFrame) -> DataFrame:
    """Value side and line side with its consolidator mark; an importer without a mark counts as 0."""
    return value.join(line_side, "bn_9", "left").withColumn(
        "is_consolidator", F.coalesce("is_consolidator", F.lit(0))
    )


def active_days(txn: DataFrame) -> DataFrame:
    """One row per (importer, arrival day) with the day before it on which the importer was active.

    A calendar bounds the days of any one importer, however many transactions it files, so the
    ordered window below stays small even for a dominant importer.
    """
    days = (
        txn.where("arrival_date is not null")
        .groupBy("bn_9", "arrival_date")
        .agg(
            F.count("*").alias("n_txn"),
            F.min(F.struct("clnt_sply_req_id", "txn_value_cad")).alias("_first"),
        )
    )
    history = Window.partitionBy("bn_9").orderBy("arrival_date")
    return days.select(
        "bn_9",
        "arrival_date",
        "n_txn",
        F.col("_first.clnt_sply_req_id").alias("first_id"),
        F.col("_first.txn_value_cad").alias("first_value"),
        F.lag("arrival_date").over(history).alias("prev_date"),
    )


def entity_txn_indicators(txn: DataFrame) -> DataFrame:
    """Longest gap and first transaction value of importers with a dated transaction.

    The gap is null for a single transaction; the first value goes by day, then by id.
    """
    gap = F.datediff("arrival_date", "prev_date")
    same_day = F.when(F.col("n_txn") > 1, 0)
    first_day = F.col("prev_date").isNull()
    return active_days(txn).groupBy("bn_9").agg(
        F.max(F.coalesce(gap, same_day)).alias("max_gap_days"),
        F.max(F.when(first_day, F.col("first_value"))).alias("first_txn_value_cad"),
    )


def gap_days(txn: DataFrame) -> DataFrame:
    """Days since the importer's previous transaction, for every dated transaction.

    Within a day transactions follow each other by id, so all but the first have a gap of 0; the
    first looks back to the previous active day. The join is on (importer, day).
    """
    days = active_days(txn).select("bn_9", "arrival_date", "first_id", "prev_date")
    gap = F.when(
        F.col("clnt_sply_req_id") == F.col("first_id"), F.datediff("arrival_date", "prev_date")
    ).otherwise(0)
    dated = txn.where("arrival_date is not null")
    return (
        null_safe_join(dated, days, ["bn_9", "arrival_date"])
        .withColumn("gap_days", gap)
        .drop("first_id", "prev_date")
    )


def indicator_assembly(features: DataFrame, line: DataFrame, txn: DataFrame) -> DataFrame:
    return features.join(line, "bn_9", "left").join(txn, "bn_9", "left")


def one_to_one_relationship(lines: DataFrame, share_min: float = 1.0) -> DataFrame:
    """Importer-vendor pairs with each side's partner count and line share.

    ``is_exclusive`` marks pairs where both sides do at least ``share_min`` of their lines
    with each other.
    """
    pairs = (
        lines.where("bn_9 is not null and vendor_name is not null")
        .groupBy("bn_9", "vendor_name")
        .agg(F.count("*").alias("pair_lines"))
    )
    importers = pairs.groupBy("bn_9").agg(
        F.count("*").alias("vendors_of_importer"), F.sum("pair_lines").alias("_importer_lines")
    )
    vendors = pairs.groupBy("vendor_name").agg(
        F.count("*").alias("importers_of_vendor"), F.sum("pair_lines").alias("_vendor_lines")
    )
    importer_share = F.col("pair_lines") / F.col("_importer_lines")
    vendor_share = F.col("pair_lines") / F.col("_vendor_lines")
    return (
        pairs.join(importers, "bn_9")
        .join(vendors, "vendor_name")
        .select(
            "bn_9",
            "vendor_name",
            "pair_lines",
            "vendors_of_importer",
            "importers_of_vendor",
            importer_share.alias("importer_share"),
            vendor_share.alias("vendor_share"),
            as_flag((importer_share >= share_min) & (vendor_share >= share_min)).alias("is_exclusive"),
        )
    )


def code_coverage(lines: DataFrame, basel: DataFrame) -> DataFrame:
    """Distinct vendor countries in use and how many of them the risk index knows."""
    used = lines.select(F.col("vendor_cntry_cde").alias("iso_code")).distinct()
    known = small_side(basel.select("iso_code").distinct().withColumn("matched", F.lit(1)))
    return (
        used.where(present(F.col("iso_code")))
        .join(known, "iso_code", "left")
        .agg(
            F.count("*").alias("distinct_vendor_cntry"),
            count_where(F.col("matched") == 1).alias("matched_basel_codes"),
        )
    )


def unmatched_codes(lines: DataFrame, basel: DataFrame, countries: DataFrame) -> DataFrame:
    """Vendor countries missing from the risk index, with name and reach, most lines first."""
    names = countries.groupBy(F.col("country_code").alias("vendor_cntry_cde")).agg(
        F.max("country_name").alias("country_name")
    )
    known = small_side(basel.select(F.col("iso_code").alias("vendor_cntry_cde")))
    reach = (
        lines.where("vendor_cntry_cde is not null and trim(vendor_cntry_cde) <> ''")
        .join(known, "vendor_cntry_cde", "left_anti")
        .groupBy("vendor_cntry_cde")
        .agg(
            F.count("*").alias("n_lines"),
            F.countDistinct("bn_9").alias("n_importers"),
            F.countDistinct("clnt_sply_req_id").alias("n_transactions"),
        )
    )
    return (
        reach.join(small_side(names), "vendor_cntry_cde", "left")
        .select("vendor_cntry_cde", "country_name", "n_lines", "n_importers", "n_transactions")
        .orderBy(F.desc("n_lines"), "vendor_cntry_cde")
    )
