"""Digit tests, typology flags, the risk matrix and its reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cargoscope.catalog.lookups import rates, transactions, written_transactions
from cargoscope.catalog.registry import query
from cargoscope.catalog.settings import RISK
from cargoscope.config import FLAG_LABELS
from cargoscope.operators import benford as ben
from cargoscope.operators import scoring
from cargoscope.plans import risk_matrix as plan

FLAGS = list(FLAG_LABELS)


def matrix(s, txn=None):
    """The scored matrix."""
    return plan.risk_matrix(s["lines"], rates(s), s.sections, s.basel, RISK, txn)


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(
    "benford_digit_counts",
    """SELECT bn_9, CAST(SUBSTR(CAST(CAST(FLOOR(txn_value_decl) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS d,
        COUNT(*) AS n FROM {txn} WHERE txn_value_decl >= 1 GROUP BY ALL""",
)
def _(s):
    return ben.benford_digit_counts(transactions(s), "txn_value_decl", "first")


@query(
    "pivot_digits",
    "WITH t AS (SELECT bn_9, SUBSTR(CAST(CAST(FLOOR(txn_value_decl) AS BIGINT) AS VARCHAR), 2, 1) AS d "
    "FROM {txn} WHERE txn_value_decl >= 10) SELECT bn_9, "
    + ", ".join(f"COUNT(*) FILTER (d = '{d}') AS d{d}" for d in range(10))
    + " FROM t GROUP BY bn_9",
)
def _(s):
    counts = ben.benford_digit_counts(transactions(s), "txn_value_decl", "second")
    return ben.pivot_digits(counts, "second")


def _mad(s, value, test):
    threshold = RISK.mad1_threshold if test == "first" else RISK.mad2_threshold
    result = ben.benford_mad(transactions(s), value, test, RISK.benford_min_txns, threshold)
    return rounded(result, ["mad"])


def _mad_sql(view, threshold):
    return f"""SELECT bn_9, ROUND(mad, 6) AS mad, n, CAST(n >= 50 AND mad > {threshold} AS INT) AS flag
    FROM {{{view}}}"""


@query("benford_mad", _mad_sql("b1_decl", 0.05))
def _(s):
    return _mad(s, "txn_value_decl", "first")


@query("i4_benford1", "SELECT bn_9, i4_benford1 FROM {matrix}")
def _(s):
    return matrix(s).select("bn_9", "i4_benford1")


@query("i5_benford2", _mad_sql("b2_decl", 0.03))
def _(s):
    return _mad(s, "txn_value_decl", "second")


@query(
    "i4_i5_cad_reference",
    """SELECT bn_9, ROUND(benford1_mad_cad, 6) AS benford1_mad_cad, ROUND(benford2_mad_cad, 6) AS benford2_mad_cad,
        i4_benford1_cad, i5_benford2_cad FROM {assembled}""",
)
def _(s):
    profile = plan.entity_txn_profile(transactions(s), RISK).select(
        "bn_9", "benford1_mad_cad", "benford2_mad_cad", "i4_benford1_cad", "i5_benford2_cad"
    )
    return rounded(profile, ["benford1_mad_cad", "benford2_mad_cad"])


@query(
    "benford_merge",
    """SELECT bn_9, ROUND(benford1_mad_decl, 6) AS benford1_mad_decl, ROUND(benford2_mad_decl, 6) AS benford2_mad_decl,
        ROUND(benford1_mad_cad, 6) AS benford1_mad_cad, ROUND(benford2_mad_cad, 6) AS benford2_mad_cad
    FROM {assembled}""",
)
def _(s):
    profile = plan.entity_txn_profile(transactions(s), RISK).select("bn_9", *plan.MAD_COLUMNS)
    return rounded(profile, plan.MAD_COLUMNS)


_EXPECTED1 = ", ".join(f"({d}, {math.log10(1 + 1 / d)!r})" for d in range(1, 10))


@query(
    "benford_by_currency",
    f"""WITH h AS (SELECT bn_9, decl_ccy, SUBSTR(CAST(CAST(FLOOR(txn_value_decl) AS BIGINT) AS VARCHAR), 1, 1) AS d
        FROM {{txn}} WHERE txn_value_decl >= 1),
    t AS (SELECT bn_9, decl_ccy, COUNT(*) AS n FROM h GROUP BY ALL),
    e(d, p) AS (VALUES {_EXPECTED1})
    SELECT t.bn_9, t.decl_ccy, ROUND(AVG(ABS(c / n - p)), 6) AS mad, n,
        CAST(n >= 20 AND AVG(ABS(c / n - p)) > 0.05 AS INT) AS flag
    FROM (SELECT t.bn_9, t.decl_ccy, t.n, e.p, COUNT(h.d) AS c FROM t CROSS JOIN e
        LEFT JOIN h ON h.bn_9 = t.bn_9 AND h.decl_ccy = t.decl_ccy AND h.d = CAST(e.d AS VARCHAR)
        GROUP BY t.bn_9, t.decl_ccy, t.n, e.d, e.p) t
    GROUP BY t.bn_9, t.decl_ccy, t.n""",
)
def _(s):
    result = ben.benford_mad(
        transactions(s), "txn_value_decl", "first", 20, RISK.mad1_threshold, ("bn_9", "decl_ccy")
    )
    return rounded(result, ["mad"])


@query("percentile_thresholds", "SELECT round_thr, gap_thr, first_thr FROM {cuts}")
def _(s):
    txn = written_transactions(s)
    entities = plan.materialise(plan.entity_table(txn, s["lines"], s.sections, s.basel, RISK))
    filled = scoring.coerce_fill_zero(entities, scoring._ZERO_FILLED)
    cut = scoring.percentile_thresholds(filled, RISK)
    return rounded(cut, ["round_thr", "gap_thr", "first_thr"], 9)


def _flag(name, extra):
    columns = ["bn_9", *extra, name]

    @query(name.replace("i7_high_risk_juris", "i7_high_risk"), f"SELECT {', '.join(columns)} FROM {{matrix}}")
    def _(s):
        return matrix(s).select(*[F.col(c).cast("bigint").alias(c) if c in _WHOLE else c for c in columns])


_WHOLE = {"txn_cnt", "distinct_sections"}
_flag("i3_numbered", ["importer_numbered_share", "vendor_numbered_share"])
_flag("i7_high_risk_juris", ["high_risk_share"])
_flag("i8_dormancy", ["txn_cnt"])
_flag("i9_rounded", ["round_1000_share", "is_consolidator"])
_flag("i10_high_first_txn", ["first_txn_value_cad"])
_flag("i11_lines_of_trade", ["distinct_sections", "is_consolidator"])

_REPORTED = ", ".join(
    f"COALESCE(ROUND({c}, 6), -1) AS {c}"
    if c in plan.MAD_COLUMNS
    else f"CAST({c} AS DOUBLE) AS {c}"
    if c in ("max_gap_days", "distinct_sections")
    else c
    for c in plan.MATRIX_COLUMNS
)


def report(s):
    return rounded(plan.matrix_report(matrix(s)), plan.MAD_COLUMNS)


@query("risk_matrix", f"SELECT {_REPORTED} FROM {{matrix}}")
def _(s):
    return report(s)


@query("save_risk_matrix", f"SELECT {_REPORTED} FROM {{matrix}}")
def _(s):
    from cargoscope.catalog.scans import _folder
    from cargoscope.sources.sinks import write_parquet

    path = _folder(s, "risk-matrix")
    write_parquet(report(s), path)
    return s.spark.read.parquet(path)


_TOP = ["bn_9", "is_consolidator", "txn_cnt", "total_value_cad", *FLAGS, "flag_count", "risk_score"]


@query(
    "top_risk_entities",
    f"SELECT {', '.join(_TOP)} FROM {{matrix}} ORDER BY risk_score DESC, total_value_cad DESC, bn_9 LIMIT 25",
)
def _(s):
    order = [F.desc("risk_score"), F.desc("total_value_cad"), F.col("bn_9")]
    return scoring.top_rows(matrix(s).select(*_TOP), 25, *order)


@query(
    "flag_rates",
    f"""SELECT flag, AVG(v) AS flag_rate FROM (SELECT {', '.join(FLAGS)} FROM {{matrix}})
    UNPIVOT (v FOR flag IN ({', '.join(FLAGS)})) GROUP BY flag""",
)
def _(s):
    return scoring.flag_rates(matrix(s), FLAGS)


@query("flag_count_histogram", "SELECT flag_count, COUNT(*) AS n_entities FROM {matrix} GROUP BY flag_count")
def _(s):
    return scoring.score_histogram(matrix(s), "flag_count")


_LABEL_ROWS = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(FLAG_LABELS.items()))


@query(
    "single_flag_counts",
    f"""SELECT u.flag, label, CAST(SUM(v) AS BIGINT) AS n_importers, ROUND(SUM(v) / COUNT(*), 4) AS pct
    FROM (SELECT {', '.join(FLAGS)} FROM {{matrix}}) UNPIVOT (v FOR flag IN ({', '.join(FLAGS)})) u
    JOIN (VALUES {_LABEL_ROWS}) l(flag, label, i) ON l.flag = u.flag GROUP BY u.flag, label""",
)
def _(s):
    return scoring.single_flag_counts(matrix(s))


_MASK = " + ".join(f"{c} * {1 << i}" for i, c in enumerate(FLAGS))
_COMBOS = f"""
    SELECT CAST(BIT_COUNT(c) AS INT) AS k,
        (SELECT STRING_AGG(flag, ', ' ORDER BY i) FROM (VALUES {_LABEL_ROWS}) l(flag, label, i) WHERE (c >> i) & 1 = 1)
            AS flags,
        (SELECT STRING_AGG(label, ' + ' ORDER BY i) FROM (VALUES {_LABEL_ROWS}) l(flag, label, i) WHERE (c >> i) & 1 = 1)
            AS label,
        (SELECT COUNT(*) FROM m WHERE mask & c = c) AS n_importers,
        (SELECT COUNT(*) FROM m WHERE mask & c = c) / (SELECT COUNT(*) FROM m) AS pct
    FROM (SELECT CAST(range AS INT) AS c FROM RANGE(1, {1 << len(FLAGS)})) r WHERE BIT_COUNT(c) >= 2"""


@query(
    "flag_combinations",
    f"WITH m AS (SELECT {_MASK} AS mask FROM {{matrix}}) {_COMBOS}",
)
def _(s):
    return scoring.flag_combinations(plan.materialise(matrix(s).select(*FLAGS)))


@query(
    "flag_lift",
    f"""WITH m AS (SELECT {_MASK} AS mask FROM {{matrix}}), q AS ({_COMBOS}),
    r AS (SELECT flag, AVG(v) AS rate FROM (SELECT {', '.join(FLAGS)} FROM {{matrix}})
        UNPIVOT (v FOR flag IN ({', '.join(FLAGS)})) GROUP BY flag)
    SELECT q.k, q.flags, q.n_importers, ROUND(PRODUCT(rate), 6) AS expected_pct,
        ROUND(CASE WHEN PRODUCT(rate) > 0 THEN MAX(pct) / PRODUCT(rate) END, 6) AS lift
    FROM q JOIN r ON LIST_CONTAINS(STRING_SPLIT(q.flags, ', '), r.flag) GROUP BY q.k, q.flags, q.n_importers""",
)
def _(s):
    lift = scoring.flag_lift(plan.materialise(matrix(s).select(*FLAGS)))
    return rounded(
        lift.select("k", "flags", "n_importers", "expected_pct", "lift"), ["expected_pct", "lift"]
    )
