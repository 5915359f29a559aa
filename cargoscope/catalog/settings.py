"""Thresholds that suit the star-schema line view."""

from cargoscope.config import AnomalyConfig, CaseConfig, RiskConfig

RISK = RiskConfig(consolidator_min_names=20, mad1_threshold=0.05, mad2_threshold=0.03)
ANOMALY = AnomalyConfig()
CASES = CaseConfig()

FIRST_DAY, LAST_DAY, OFFICE = "1996-01-01", "2001-06-30", "911"
EXCLUDED_ENTITIES = [100000003]
EXCLUDED_TEXT = "100000003"
