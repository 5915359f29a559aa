"""Baselines, anomalies, novelty, volume, the anomaly profile and its model layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoscope.catalog.lookups import features, transactions, written_transactions
from cargoscope.catalog.registry import query
from cargoscope.catalog.risk import matrix, rounded
from cargoscope.catalog.settings import ANOMALY, RISK
from cargoscope.config import RULE_FLAGS, TUNED_ANOMALY
from cargoscope.operators import entities as ent
from cargoscope.operators import history as his
from cargoscope.operators import scoring
from cargoscope.plans import anomaly_profile as plan


def _r6(*columns: str) -> str:
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in columns)


_BASELINE = f"bn_9, txn_cnt, {_r6('mean_log_val', 'std_log_val')}, first_arrival, last_arrival, tenure_days"


@query("entity_baseline", f"SELECT {_BASELINE} FROM {{baseline}}")
def _(s):
    return rounded(his.entity_baseline(transactions(s)), ["mean_log_val", "std_log_val"])


@query(
    "baseline_summary",
    """SELECT COUNT(*) AS n_entities, COUNT(*) FILTER (txn_cnt >= 12) AS n_with_baseline, AVG(txn_cnt) AS avg_txn_cnt,
        AVG(tenure_days) AS avg_tenure_days FROM {baseline}""",
)
def _(s):
    return his.baseline_summary(his.entity_baseline(transactions(s)), ANOMALY)


_SCORED = (
    "clnt_sply_req_id, bn_9, arrival_date, txn_value_cad, entity_txn_cnt, ROUND(value_z, 6) AS value_z, "
    "days_since_prev, is_reactivation"
)


def scored(s, config=ANOMALY):
    return his.txn_value_zscore(written_transactions(s), config)


@query("txn_value_zscore", f"SELECT {_SCORED} FROM {{scored}}")
def _(s):
    return rounded(scored(s), ["value_z"])


@query(
    "txn_anomaly_rollup",
    f"SELECT bn_9, n_value_anom, n_reactivation, {_r6('max_abs_z')} FROM {{scored_rollup}}",
)
def _(s):
    return rounded(his.txn_anomaly_rollup(scored(s), ANOMALY), ["max_abs_z"])


@query(
    "top_value_anomalies",
    f"""SELECT * EXCLUDE (is_reactivation) FROM (SELECT {_SCORED} FROM {{scored}}) t
    WHERE ABS(value_z) >= 3 AND entity_txn_cnt >= 12 ORDER BY ABS(value_z) DESC, clnt_sply_req_id LIMIT 50""",
)
def _(s):
    return rounded(scoring.top_value_anomalies(scored(s), ANOMALY), ["value_z"])


_ROBUST = """WITH m AS (SELECT bn_9, MEDIAN(log_val) AS median_log FROM {scorable} GROUP BY bn_9),
    d AS (SELECT clnt_sply_req_id, bn_9, log_val, median_log, ABS(log_val - median_log) AS dev
        FROM {scorable} JOIN m USING (bn_9)),
    a AS (SELECT bn_9, MEDIAN(dev) AS mad_log FROM d GROUP BY bn_9)
    SELECT clnt_sply_req_id, bn_9, ROUND(median_log, 6) AS median_log, ROUND(mad_log, 6) AS mad_log,
        ROUND(CASE WHEN mad_log > 0 THEN (log_val - median_log) / mad_log END, 6) AS robust_z
    FROM d JOIN a USING (bn_9)"""


@query("value_z_robust", _ROBUST)
def _(s):
    robust = his.value_z_robust(written_transactions(s))
    return rounded(robust, ["median_log", "mad_log", "robust_z"])


# -- novelty -------------------------------------------------------------------------------


@query("dim_first_seen", "SELECT * FROM {first_vendor_cntry_cde}")
def _(s):
    return his.dim_first_seen(s["lines_core"], "vendor_cntry_cde")


@query("entity_span", "SELECT * FROM {span}")
def _(s):
    return his.entity_span(s["lines_core"])


@query("novelty_join", "SELECT * FROM {first_hs_chap_nbr} JOIN {span} USING (bn_9)")
def _(s):
    first = his.dim_first_seen(s["lines_core"], "hs_chap_nbr")
    return his.novelty_join(first, his.entity_span(s["lines_core"]))


@query("novelty_country", "SELECT * FROM {nov_country}")
def _(s):
    return his.novelty(s["lines_core"], "vendor_cntry_cde", ANOMALY)


@query("novelty_chapter", "SELECT * FROM {nov_chapter}")
def _(s):
    return his.novelty(s["lines_core"], "hs_chap_nbr", ANOMALY)


_PAIR = """SELECT c.bn_9, c.n_distinct_dim AS n_countries, c.n_recent_new AS recent_new_countries,
        h.n_distinct_dim AS n_chapters, h.n_recent_new AS recent_new_chapters
    FROM {nov_country} c JOIN {nov_chapter} h ON h.bn_9 = c.bn_9 WHERE c.n_recent_new > 0 OR h.n_recent_new > 0"""


def _novelty_pairs(s):
    return his.novelty_pair_join(his.novelty_profile(s["lines_core"], plan.NOVELTY_DIMS, ANOMALY))


@query("novelty_pair_join", _PAIR)
def _(s):
    return _novelty_pairs(s)


@query(
    "top_novelty",
    f"{_PAIR} ORDER BY c.n_recent_new + h.n_recent_new DESC, c.bn_9 LIMIT 25",
)
def _(s):
    total = F.col("recent_new_countries") + F.col("recent_new_chapters")
    return scoring.top_rows(_novelty_pairs(s), 25, total.desc(), "bn_9")


@query(
    "novelty_normalised",
    "SELECT *, n_recent_new / n_distinct_dim AS recent_new_share FROM {nov_country}",
)
def _(s):
    return his.novelty_normalised(his.novelty(s["lines_core"], "vendor_cntry_cde", ANOMALY))


# -- volume --------------------------------------------------------------------------------


@query("monthly_counts", "SELECT * FROM {months}")
def _(s):
    return his.monthly_counts(transactions(s))


_MONTHLY = "bn_9, ym, n_txn, n_months, ROUND(vol_z, 6) AS vol_z"


@query("monthly_volume_zscore", f"SELECT {_MONTHLY} FROM {{monthly}}")
def _(s):
    return rounded(his.monthly_volume_zscore(his.monthly_counts(transactions(s))), ["vol_z"])


@query("monthly_rollup", f"SELECT bn_9, n_spike_months, {_r6('max_vol_z')} FROM {{monthly_roll}}")
def _(s):
    monthly = his.monthly_volume_zscore(his.monthly_counts(transactions(s)))
    return rounded(his.monthly_rollup(monthly, ANOMALY), ["max_vol_z"])


@query(
    "top_volume_spikes",
    f"""SELECT * FROM (SELECT {_MONTHLY} FROM {{monthly}}) t WHERE vol_z >= 3 AND n_months >= 6
    ORDER BY vol_z DESC, bn_9, ym LIMIT 25""",
)
def _(s):
    monthly = rounded(his.monthly_volume_zscore(his.monthly_counts(transactions(s))), ["vol_z"])
    return scoring.top_rows(
        monthly.where(his.is_volume_spike(ANOMALY)), 25, F.desc("vol_z"), "bn_9", "ym"
    )


@query(
    "monthly_zero_filled",
    """WITH r AS (SELECT bn_9, UNNEST(RANGE(DATE_TRUNC('month', MIN(arrival_date))::TIMESTAMP,
            DATE_TRUNC('month', MAX(arrival_date))::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m
        FROM {txn} WHERE arrival_date IS NOT NULL GROUP BY bn_9),
    c AS (SELECT bn_9, STRFTIME(m, '%Y-%m') AS ym FROM r)
    SELECT c.bn_9, c.ym, COALESCE(n_txn, 0) AS n_txn, COUNT(*) OVER e AS n_months,
        ROUND(CASE WHEN STDDEV_SAMP(COALESCE(n_txn, 0)) OVER e > 0 THEN (COALESCE(n_txn, 0)
            - AVG(COALESCE(n_txn, 0)) OVER e) / STDDEV_SAMP(COALESCE(n_txn, 0)) OVER e END, 6) AS vol_z
    FROM c LEFT JOIN {months} m ON m.bn_9 = c.bn_9 AND m.ym = c.ym WINDOW e AS (PARTITION BY c.bn_9)""",
)
def _(s):
    complete = his.monthly_zero_filled(transactions(s))
    return rounded(his.monthly_volume_zscore(complete), ["vol_z"])


@query(
    "peak_to_median_ratio",
    """SELECT bn_9, MAX(n_txn) AS peak_month, MEDIAN(n_txn) AS median_month, MAX(n_txn) / MEDIAN(n_txn) AS peak_ratio
    FROM {months} GROUP BY bn_9""",
)
def _(s):
    return his.peak_to_median_ratio(his.monthly_counts(transactions(s)))


@query(
    "series_volume_zscore",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} GROUP BY ALL)
    SELECT user_id AS bn_9, day AS ym, n AS n_txn, COUNT(*) OVER e AS n_months,
        ROUND(CASE WHEN STDDEV_SAMP(n) OVER e > 0 THEN (n - AVG(n) OVER e) / STDDEV_SAMP(n) OVER e END, 6) AS vol_z
    FROM d WINDOW e AS (PARTITION BY user_id)""",
)
def _(s):
    daily = his.series_volume_zscore(s["events"], "user_id", F.to_date("ts"))
    return rounded(daily, ["vol_z"])


# -- profile -------------------------------------------------------------------------------

_Z = ["std_log_val", "max_abs_z", "max_vol_z"]


def _inputs(s):
    txn = written_transactions(s)
    return txn, s["lines"], features(s, txn)


def profile(s, config=ANOMALY):
    return plan.anomaly_profile(*_inputs(s), config)


def modelled(s):
    """The profile with model columns, written once."""
    return plan.with_model(profile(s), ANOMALY)


_ROLLUP = (
    "bn_9, txn_cnt, tenure_days, n_value_anom, n_reactivation, recent_new_countries, recent_new_chapters, "
    f"n_spike_months, is_consolidator, distinct_vendor_countries, distinct_sections, {_r6(*_Z)}"
)


@query("anomaly_rollup_join", f"SELECT {_ROLLUP} FROM {{rollup}}")
def _(s):
    return rounded(plan.anomaly_rollup(*_inputs(s), ANOMALY), _Z)


@query(
    "anomaly_flags",
    f"SELECT bn_9, {', '.join(RULE_FLAGS)}, rule_score FROM {{profile}}",
)
def _(s):
    return profile(s).select("bn_9", *RULE_FLAGS, "rule_score")


@query(
    "anomaly_flag_rates",
    f"""SELECT flag, AVG(v) AS flag_rate FROM (SELECT {', '.join(RULE_FLAGS)} FROM {{profile}})
    UNPIVOT (v FOR flag IN ({', '.join(RULE_FLAGS)})) GROUP BY flag""",
)
def _(s):
    return scoring.flag_rates(profile(s), list(RULE_FLAGS))


@query("rule_score_histogram", "SELECT rule_score, COUNT(*) AS n_entities FROM {profile} GROUP BY rule_score")
def _(s):
    return scoring.score_histogram(profile(s), "rule_score")


_PROFILE = ", ".join(f"ROUND({c}, 6) AS {c}" if c in _Z else c for c in plan.PROFILE_COLUMNS)


@query("anomaly_profile", f"SELECT {_PROFILE} FROM {{profile}}")
def _(s):
    return rounded(plan.profile_report(profile(s)), _Z)


_MODELLED = [*_Z, "ml_score"]
_SAVED = ", ".join(f"ROUND({c}, 6) AS {c}" if c in _MODELLED else c for c in [*plan.PROFILE_COLUMNS, "ml_score", "ml_outlier"])


@query("save_anomaly_profile", f"SELECT {_SAVED} FROM {{modelled}}")
def _(s):
    from cargoscope.catalog.scans import _folder
    from cargoscope.sources.sinks import write_parquet

    path = _folder(s, "anomaly-profile")
    write_parquet(plan.profile_report(modelled(s)), path)
    return rounded(s.spark.read.parquet(path), _MODELLED)


@query(
    "tuned_thresholds",
    """SELECT r.*, COALESCE(c.n_recent_new, 0) AS recent_new_countries, COALESCE(h.n_recent_new, 0) AS recent_new_chapters
    FROM (SELECT r.bn_9, CAST(SUM(CASE WHEN days_since_prev >= 120 THEN 1 ELSE 0 END) AS BIGINT) AS n_reactivation,
            COALESCE(MAX(n_spike), 0) AS n_spike_months
        FROM {scored} r LEFT JOIN (SELECT bn_9, COUNT(*) FILTER (vol_z >= 2.5 AND n_months >= 6) AS n_spike
            FROM {monthly} GROUP BY bn_9) m ON m.bn_9 = r.bn_9 GROUP BY r.bn_9) r
    LEFT JOIN {tuned_country} c ON c.bn_9 = r.bn_9 LEFT JOIN {tuned_chapter} h ON h.bn_9 = r.bn_9""",
)
def _(s):
    tuned = plan.anomaly_rollup(*_inputs(s), TUNED_ANOMALY)
    return tuned.select("bn_9", "n_reactivation", "n_spike_months", "recent_new_countries", "recent_new_chapters")


@query("isolation_forest", "SELECT bn_9, txn_cnt, ROUND(ml_score, 6) AS ml_score, ml_outlier FROM {modelled}")
def _(s):
    return modelled(s).select("bn_9", "txn_cnt", F.round("ml_score", 6).alias("ml_score"), "ml_outlier")


_QUEUE = ", ".join(["bn_9", "is_consolidator", "txn_cnt", *RULE_FLAGS, "rule_score", "ROUND(ml_score, 6) AS ml_score", "ml_outlier"])


@query(
    "review_queue",
    f"""SELECT {_QUEUE} FROM (SELECT * FROM {{modelled}} ORDER BY rule_score DESC, ml_score DESC, bn_9 LIMIT 25) t""",
)
def _(s):
    return rounded(plan.review_queue(modelled(s)), ["ml_score"])


@query(
    "rule_ml_overlap",
    "SELECT COUNT(*) FILTER (rule_score >= 2 AND ml_outlier = 1) AS n_overlap FROM {modelled}",
)
def _(s):
    return scoring.rule_ml_overlap(modelled(s))


@query(
    "entity_drilldown",
    f"""SELECT clnt_sply_req_id, arrival_date, txn_value_cad, value_z, days_since_prev, is_reactivation
    FROM (SELECT {_SCORED} FROM {{scored}}) t
    WHERE bn_9 = (SELECT bn_9 FROM {{profile}} ORDER BY rule_score DESC, bn_9 LIMIT 1)
    ORDER BY ABS(value_z) DESC, clnt_sply_req_id LIMIT 25""",
)
def _(s):
    txn = written_transactions(s)
    ranked = plan.anomaly_profile(txn, s["lines"], features(s, txn), ANOMALY)
    chosen = scoring.top_rows(ranked, 1, F.desc("rule_score"), "bn_9").select("bn_9").scalar()
    rows = scoring.entity_drilldown(his.txn_value_zscore(txn, ANOMALY), chosen)
    return rounded(rows, ["value_z"])


@query(
    "combined_risk_view",
    """SELECT m.bn_9, m.is_consolidator, m.txn_cnt, total_value_cad, flag_count, risk_score, rule_score,
        risk_score + rule_score AS combined_score, LEAST(risk_score, CAST(rule_score AS DOUBLE)) AS lower_score
    FROM {matrix} m JOIN {profile} p ON p.bn_9 = m.bn_9""",
)
def _(s):
    txn = written_transactions(s)
    behaviour = plan.anomaly_profile(txn, s["lines"], features(s, txn), ANOMALY)
    return scoring.combined_risk_view(matrix(s, txn), behaviour)


@query(
    "entity_count_reconcile",
    """WITH st AS (SELECT 'lines' AS stage, bn_9 FROM {cons} UNION ALL SELECT 'transactions', bn_9 FROM {ent_value}
        UNION ALL SELECT 'baselines', bn_9 FROM {baseline} WHERE txn_cnt >= 12)
    SELECT stage, COUNT(*) AS n_entities, (SELECT COUNT(*) FROM {cons} c
        WHERE c.bn_9 NOT IN (SELECT x.bn_9 FROM st x WHERE x.stage = st.stage)) AS n_dropped
    FROM st GROUP BY stage""",
)
def _(s):
    return scoring.entity_count_reconcile(_stages(s))


def _stages(s) -> dict:
    txn = written_transactions(s)
    return {
        "lines": ent.consolidators(s["lines"], RISK),
        "transactions": ent.entity_value_features(txn),
        "baselines": his.entity_baseline(txn).where(F.col("txn_cnt") >= ANOMALY.min_txns),
    }


@query(
    "dropped_entities",
    """WITH st AS (SELECT 'transactions' AS stage, bn_9 FROM {ent_value}
        UNION ALL SELECT 'baselines', bn_9 FROM {baseline} WHERE txn_cnt >= 12)
    SELECT n.stage, c.bn_9 FROM {cons} c CROSS JOIN (SELECT * FROM (VALUES ('transactions'), ('baselines')) v(stage)) n
    WHERE NOT EXISTS (SELECT 1 FROM st x WHERE x.stage = n.stage AND x.bn_9 IS NOT DISTINCT FROM c.bn_9)""",
)
def _(s):
    return scoring.dropped_entities(_stages(s))


@query(
    "count_with_share",
    """SELECT bn, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM (
        SELECT SUBSTR(importer_id, 1, 9) AS bn FROM {accounting}) t GROUP BY bn""",
)
def _(s):
    from cargoscope.functions.cleaning import business_number

    rows = s["accounting"].select(business_number(F.col("importer_id"), anchored=False).alias("bn"))
    return scoring.count_with_share(rows, "bn")


@query(
    "share_of_total",
    "SELECT bn_9, line_cnt, line_cnt / SUM(line_cnt) OVER () AS share FROM (SELECT bn_9, COUNT(*) AS line_cnt "
    "FROM {lines_core} GROUP BY bn_9) t",
)
def _(s):
    counts = s["lines_core"].groupBy("bn_9").agg(F.count("*").alias("line_cnt"))
    return scoring.share_of_total(counts, "line_cnt")


