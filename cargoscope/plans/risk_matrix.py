"""Typology risk matrix: one row per importer with eight flags and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.config import FLAG_LABELS, RiskConfig
from cargoscope.operators.benford import deviation, digit_aggregates, tested_digit
from cargoscope.operators.entities import (
    entity_line_profile,
    entity_txn_indicators,
    value_aggregates,
)
from cargoscope.operators.keys import current_lines
from cargoscope.operators.scoring import typology_flags
from cargoscope.operators.transactions import txn_value
from cargoscope.session import materialise
from cargoscope.sources.sinks import report_columns

# Output prefix -> (value column, digit test, flag it feeds, threshold name).
_DIGIT_TESTS = {
    "benford1_decl": ("txn_value_decl", "first", "i4_benford1", "mad1_threshold"),
    "benford2_decl": ("txn_value_decl", "second", "i5_benford2", "mad2_threshold"),
    "benford1_cad": ("txn_value_cad", "first", "i4_benford1_cad", "mad1_threshold"),
    "benford2_cad": ("txn_value_cad", "second", "i5_benford2_cad", "mad2_threshold"),
}

MAD_COLUMNS = ["benford1_mad_decl", "benford2_mad_decl", "benford1_mad_cad", "benford2_mad_cad"]
MATRIX_COLUMNS = [
    "bn_9",
    "is_consolidator",
    "txn_cnt",
    "total_value_cad",
    "avg_txn_value_cad",
    "max_txn_value_cad",
    "first_arrival",
    "last_arrival",
    "distinct_hs6",
    "distinct_sections",
    "distinct_vendors",
    "distinct_vendor_countries",
    "importer_numbered_share",
    "round_1000_share",
    "high_risk_share",
    "max_gap_days",
    "first_txn_value_cad",
    *MAD_COLUMNS,
    "i4_benford1_cad",
    "i5_benford2_cad",
    *FLAG_LABELS,
    "flag_count",
    "risk_score",
]


def entity_txn_profile(txn: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Value figures and all four digit tests from one hash aggregate over the transactions."""
    counts = [
        c
        for prefix, (_, test, _, _) in _DIGIT_TESTS.items()
        for c in digit_aggregates(f"_{prefix}", test, f"_{prefix}_")
    ]
    digits = {f"_{prefix}": tested_digit(value, test) for prefix, (value, test, _, _) in _DIGIT_TESTS.items()}
    wide = txn.withColumns(digits).groupBy("bn_9").agg(*value_aggregates(), *counts)
    added = {}
    for prefix, (_, test, _, _) in _DIGIT_TESTS.items():
        n, mad = deviation(f"_{prefix}_", test)
        kind, basis = prefix.split("_")
        added[f"{kind}_n_{basis}"], added[f"{kind}_mad_{basis}"] = n, mad
    flags = {}
    for prefix, (_, _, flag, threshold) in _DIGIT_TESTS.items():
        kind, basis = prefix.split("_")
        n, mad = F.col(f"{kind}_n_{basis}"), F.col(f"{kind}_mad_{basis}")
        hit = (n >= config.benford_min_txns) & (mad > getattr(config, threshold))
        flags[flag] = F.when(n > 0, hit.cast("int"))
    spent = [c for c in wide.columns if c.startswith("_benford")]
    return wide.withColumns(added).drop(*spent).withColumns(flags)


def entity_table(
    txn: DataFrame,
    lines: DataFrame,
    sections: DataFrame,
    basel: DataFrame,
    config: RiskConfig = RiskConfig(),
) -> DataFrame:
    """Everything known per importer before flags: one pass over lines, two over transactions."""
    profile = entity_txn_profile(txn, config)
    line = entity_line_profile(lines, sections, basel, config)
    joined = profile.join(line, "bn_9", "left").join(entity_txn_indicators(txn), "bn_9", "left")
    return joined.withColumn("is_consolidator", F.coalesce("is_consolidator", F.lit(0)))


def risk_matrix(
    lines: DataFrame,
    fx: DataFrame,
    sections: DataFrame,
    basel: DataFrame,
    config: RiskConfig = RiskConfig(),
    txn: DataFrame | None = None,
) -> DataFrame:
    """The scored matrix. ``txn`` may be a transaction table that is already written.

    With ``config.dedup_key`` re-sent declarations count once, in transactions and line features.
    """
    if config.dedup_key:
        lines = materialise(current_lines(lines, config.dedup_key))
    if txn is None:
        txn = materialise(txn_value(lines, fx, config))
    entities = materialise(entity_table(txn, lines, sections, basel, config))
    return typology_flags(entities, config)


def matrix_report(scored: DataFrame) -> DataFrame:
    """The columns of the written matrix; a deviation that was not computed becomes -1."""
    return report_columns(scored, MATRIX_COLUMNS, MAD_COLUMNS)
