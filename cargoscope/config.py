"""Every threshold in one place; plans and operators take these as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

# The eight typology flags and how reports label them.
FLAG_LABELS = {
    "i3_numbered": "I3 Numbered",
    "i4_benford1": "I4 Benford 1st",
    "i5_benford2": "I5 Benford 2nd",
    "i7_high_risk_juris": "I7 High Risk Juris",
    "i8_dormancy": "I8 Dormancy",
    "i9_rounded": "I9 Rounded",
    "i10_high_first_txn": "I10 High First Txn",
    "i11_lines_of_trade": "I11 Lines of Trade",
}

# The five behavioural rules.
RULE_FLAGS = ("a_value", "a_reactivation", "a_new_country", "a_new_chapter", "a_volume_spike")


@dataclass(frozen=True)
class RiskConfig:
    """Typology thresholds."""

    high_risk_min: float = 5.5
    consolidator_min_names: int = 100
    numbered_share_min: float = 0.5
    sections_flag_min: int = 3
    benford_min_txns: int = 50
    mad1_threshold: float = 0.015
    mad2_threshold: float = 0.012
    flag_pctl: float = 0.75
    round_share_floor: float = 0.10
    # Exact decimals make totals independent of partitioning and task retries;
    # set both to "double" for the faster, order-dependent arithmetic.
    price_type: str = "decimal(20,4)"
    rate_type: str = "decimal(12,8)"
    # Key whose highest filed version counts, e.g. "clnt_sply_req_id"; None counts every version.
    dedup_key: str | None = None
    weights: dict = field(default_factory=lambda: dict.fromkeys(FLAG_LABELS, 1.0))


@dataclass(frozen=True)
class AnomalyConfig:
    """Self-baseline thresholds."""

    value_z: float = 3.0
    min_txns: int = 12
    reactivation_days: int = 365
    novelty_grace_days: int = 180
    recent_window_days: int = 90
    monthly_z: float = 3.0
    min_months: int = 6
    outlier_pctl: float = 0.99
    n_trees: int = 200
    sample_size: int = 256
    seed: int = 42


# The retuned set for histories of about one year.
TUNED_ANOMALY = AnomalyConfig(reactivation_days=120, monthly_z=2.5, novelty_grace_days=90)


@dataclass(frozen=True)
class CaseConfig:
    """Case-matrix thresholds."""

    price_tolerance: float = 1.5e-8
    ks_alpha: float = 0.05
    high_risk_min: float = 5.5
    vague_max_tokens: int = 3
    vague_max_chars: int = 13
    vague_share_min: float = 0.05
    n_indicators: int = 13
