"""Behavioural anomaly profile: each importer against its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.config import RULE_FLAGS, AnomalyConfig
from cargoscope.operators.forest import isolation_forest
from cargoscope.operators.history import (
    entity_baseline,
    monthly_counts,
    monthly_rollup,
    monthly_volume_zscore,
    novelty_profile,
    txn_anomaly_rollup,
    txn_value_zscore,
)
from cargoscope.operators.scoring import anomaly_flags, coerce_fill_zero
from cargoscope.session import materialise
from cargoscope.sources.sinks import report_columns

NOVELTY_DIMS = {"vendor_cntry_cde": "countries", "hs_chap_nbr": "chapters"}

# The model's inputs.
ML_FEATURES = [
    "txn_cnt",
    "std_log_val",
    "tenure_days",
    "n_value_anom",
    "n_reactivation",
    "max_abs_z",
    "recent_new_countries",
    "recent_new_chapters",
    "n_spike_months",
    "max_vol_z",
    "distinct_vendor_countries",
    "distinct_sections",
]
PROFILE_COLUMNS = [
    "bn_9",
    "is_consolidator",
    "txn_cnt",
    "std_log_val",
    "tenure_days",
    "n_value_anom",
    "n_reactivation",
    "max_abs_z",
    "recent_new_countries",
    "recent_new_chapters",
    "n_spike_months",
    "max_vol_z",
    *RULE_FLAGS,
    "rule_score",
]
SENTINEL_COLUMNS = ["max_abs_z", "max_vol_z", "ml_score", "std_log_val", "tenure_days"]


def anomaly_rollup(
    txn: DataFrame, lines: DataFrame, features: DataFrame, config: AnomalyConfig = AnomalyConfig()
) -> DataFrame:
    """Baselines with everything counted against them, one row per importer."""
    parts = [
        txn_anomaly_rollup(txn_value_zscore(txn, config), config),
        novelty_profile(lines, NOVELTY_DIMS, config).select(
            "bn_9", "recent_new_countries", "recent_new_chapters"
        ),
        monthly_rollup(monthly_volume_zscore(monthly_counts(txn)), config),
        features.select(
            "bn_9", "is_consolidator", "distinct_vendor_countries", "distinct_sections"
        ),
    ]
    out = entity_baseline(txn).select("bn_9", "txn_cnt", "std_log_val", "tenure_days")
    for part in parts:
        out = out.join(part, "bn_9", "left")
    counted = [
        "n_value_anom",
        "n_reactivation",
        "recent_new_countries",
        "recent_new_chapters",
        "n_spike_months",
        "is_consolidator",
    ]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})


def anomaly_profile(
    txn: DataFrame, lines: DataFrame, features: DataFrame, config: AnomalyConfig = AnomalyConfig()
) -> DataFrame:
    """Rollup plus rule flags; remaining nulls become 0 ahead of the rules."""
    rollup = anomaly_rollup(txn, lines, features, config)
    return anomaly_flags(
        coerce_fill_zero(
            rollup,
            ["std_log_val", "max_abs_z", "max_vol_z", "tenure_days"],
        ).fillna(0, ["distinct_vendor_countries", "distinct_sections"])
    )


def with_model(profile: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """The profile plus the optional model score and outlier mark."""
    fit = (F.col("is_consolidator") == 0) & (F.col("txn_cnt") >= config.min_txns)
    return isolation_forest(
        materialise(profile),
        "bn_9",
        ML_FEATURES,
        fit,
        config.outlier_pctl,
        config.n_trees,
        config.sample_size,
        config.seed,
    )


def profile_report(profile: DataFrame) -> DataFrame:
    """The columns of the written profile, with the model columns when they were computed."""
    extra = [c for c in ("ml_score", "ml_outlier") if c in profile.columns]
    return report_columns(profile, PROFILE_COLUMNS + extra, SENTINEL_COLUMNS)


def review_queue(profile: DataFrame, n: int = 25) -> DataFrame:
    """Importers by rule score, the model score breaking ties."""
    columns = ["bn_9", "is_consolidator", "txn_cnt", *RULE_FLAGS, "rule_score", "ml_score", "ml_outlier"]
    return (
        profile.select(*columns)
        .orderBy(F.desc("rule_score"), F.desc("ml_score"), "bn_9")
        .limit(n)
    )
