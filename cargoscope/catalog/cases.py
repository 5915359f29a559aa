"""Case indicators and the case matrix."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cargoscope.catalog.registry import query
from cargoscope.catalog.release import released
from cargoscope.catalog.scans import precomputed
from cargoscope.catalog.settings import CASES
from cargoscope.operators import benford as ben
from cargoscope.operators import cases
from cargoscope.operators.bind import bind_columns
from cargoscope.plans.case_matrix import case_matrix
from cargoscope.session import materialise, shared_dir
from cargoscope.sources.sinks import write_parquet

_NUMBERED = "CAST(REGEXP_MATCHES(importer_name, '^[0-9][0-9][0-9][0-9]') AS INT)"


def ints(df, *columns):
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


@query(
    "numbered_company_flag",
    f"SELECT *, {_NUMBERED} AS numbered_company, 1 AS has_trade FROM {{company}}",
)
def _(s):
    return ints(cases.numbered_company_flag(s["accounting"]), "numbered_company", "has_trade")


@query(
    "union_all",
    "SELECT bn, value FROM {trade_values}",
)
def _(s):
    return cases.trade_values(s["accounting"], s["exports"])


def _values(s):
    return cases.trade_values(s["accounting"], s["exports"])


@query(
    "benford_ks_first",
    "SELECT bn, n, ROUND(statistic, 6) AS statistic FROM {ks1}",
)
def _(s):
    stats = ben.ks_statistic(_values(s), "bn", "value", "first")
    return stats.withColumn("statistic", F.round("statistic", 6))


@query(
    "benford_ks_first_two",
    "SELECT bn, n, ROUND(statistic, 6) AS statistic FROM {ks2}",
)
def _(s):
    stats = ben.ks_statistic(_values(s), "bn", "value", "first_two")
    return stats.withColumn("statistic", F.round("statistic", 6))


_KS_SQL = """SELECT bn, n, ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value,
    CAST(p_value <= 0.05 AS INT) AS does_not_conform FROM """


def _ks_result(s, test: str):
    found = ben.benford_ks(_values(s), "bn", "value", test, CASES.ks_alpha)
    return found.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})


@query("benford_ks", _KS_SQL + "{ksp1}")
def _(s):
    return _ks_result(s, "first")


@query("benford_ks_first_two_flag", _KS_SQL + "{ksp2}")
def _(s):
    return _ks_result(s, "first_two")


@query(
    "positional_bind",
    """SELECT bn, statistic_1st_digit, statistic_2nd_digit FROM
    (SELECT bn, ROUND(statistic, 6) AS statistic_1st_digit, ROW_NUMBER() OVER (ORDER BY bn) AS i FROM {ks1}) a
    JOIN (SELECT ROUND(statistic, 6) AS statistic_2nd_digit, ROW_NUMBER() OVER (ORDER BY bn) AS i FROM {ks2}) b USING (i)""",
)
def _(s):
    pairs = materialise(ben.leading_pairs(_values(s), "bn", "value"))

    def result(test, name):
        stats = ben.ks_of_pairs(pairs, "bn", test)
        return stats.select("bn", F.round("statistic", 6).alias(name)).orderBy("bn")

    second = result("first_two", "statistic_2nd_digit")
    return bind_columns(result("first", "statistic_1st_digit"), second.select("statistic_2nd_digit"))


@query(
    "one_to_one_flag",
    """SELECT bn, importer_id, CAST(l.importer IS NOT NULL AS INT) AS has_1_to_1_relationship
    FROM {company} c LEFT JOIN {one_to_one_list} l ON CAST(l.importer AS VARCHAR) = c.bn""",
)
def _(s):
    flagged = cases.one_to_one_flag(cases.companies(s["accounting"]), s["one_to_one_list"])
    flag = F.coalesce("has_1_to_1_relationship", F.lit(False)).cast("int")
    return flagged.select("bn", "importer_id", flag.alias("has_1_to_1_relationship"))


@query(
    "high_risk_entities",
    """SELECT DISTINCT SUBSTR(importer_id, 1, 9) AS bn, 1 AS trades_with_high_risk_jurisdictions
    FROM {accounting} a JOIN {basel} b ON b.iso_code = a.country_of_export WHERE basel_ml_tf_risk >= 5.5""",
)
def _(s):
    risky = cases.high_risk_entities(s["accounting"], s.basel, CASES.high_risk_min)
    return ints(risky, "trades_with_high_risk_jurisdictions")


_PRE = ["high_dormancy", "rounded_transactions", "high_first_transaction", "inconsistent_lines_of_trade"]
_PRE_SQL = ", ".join(f"CAST({c} AS INT) AS {c}" for c in _PRE)


@query("precomputed_percentile_flags", f"SELECT importer_id, {_PRE_SQL} FROM {{precomputed}}")
def _(s):
    return ints(cases.precomputed_percentile_flags(precomputed(s)), *_PRE)


@query(
    "natural_right_join",
    f"""SELECT c.importer_id, c.importer_name, c.bn, {_PRE_SQL} FROM {{precomputed}} p
    RIGHT JOIN {{company}} c ON c.importer_id IS NOT DISTINCT FROM p.importer_id""",
)
def _(s):
    flags = cases.precomputed_percentile_flags(precomputed(s))
    return ints(cases.natural_right_join(flags, cases.companies(s["accounting"])), *_PRE)


@query("price_miscalculation", "SELECT bn, 1 AS miscalculations FROM {miscalc}")
def _(s):
    return ints(cases.price_miscalculation(released(s, *cases.MISCALCULATION_COLUMNS), CASES.price_tolerance), "miscalculations")


@query(
    "price_change",
    """SELECT DISTINCT CAST(ax_clnt_nbr AS VARCHAR) AS bn, 1 AS inconsistent_values FROM {price_steps}
    WHERE prev_ppu - invoice_ppu IS NOT NULL""",
)
def _(s):
    return ints(cases.price_change(materialise(released(s, *cases.PRICE_CHANGE_COLUMNS))), "inconsistent_values")


@query(
    "price_change_strict",
    """SELECT DISTINCT CAST(ax_clnt_nbr AS VARCHAR) AS bn, 1 AS inconsistent_values FROM {price_steps}
    WHERE prev_ppu - invoice_ppu <> 0""",
)
def _(s):
    return ints(cases.price_change(materialise(released(s, *cases.PRICE_CHANGE_COLUMNS)), strict=True), "inconsistent_values")


@query(
    "vague_description_share",
    """SELECT bn, prop_vague, row_count, CAST(prop_vague >= 0.05 AS INT) AS has_vague_descriptions FROM {vague}""",
)
def _(s):
    texts = cases.trade_texts(released(s, *cases.TEXT_COLUMNS), s["exports"])
    share = cases.vague_description_share(texts, "bn", "itm_desc_txt", CASES)
    return ints(share, "has_vague_descriptions")


@query(
    "company_flag_joins",
    f"""SELECT c.bn, {_NUMBERED} AS numbered_company, CAST(m.bn IS NOT NULL AS INT) AS miscalculations,
        CAST(h.bn IS NOT NULL AS INT) AS trades_with_high_risk_jurisdictions
    FROM {{company}} c LEFT JOIN {{miscalc}} m ON m.bn = c.bn
    LEFT JOIN (SELECT DISTINCT SUBSTR(importer_id, 1, 9) AS bn FROM {{accounting}} a
        JOIN {{basel}} b ON b.iso_code = a.country_of_export WHERE basel_ml_tf_risk >= 5.5) h ON h.bn = c.bn""",
)
def _(s):
    flagged = cases.company_flag_joins(
        cases.numbered_company_flag(s["accounting"]),
        [
            cases.price_miscalculation(released(s, *cases.MISCALCULATION_COLUMNS), CASES.price_tolerance),
            cases.high_risk_entities(s["accounting"], s.basel, CASES.high_risk_min),
        ],
    )
    found = ["miscalculations", "trades_with_high_risk_jurisdictions"]
    return flagged.select(
        "bn",
        F.col("numbered_company").cast("int").alias("numbered_company"),
        *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in found],
    )


def matrix(s, config=CASES):
    return case_matrix(
        materialise(s["accounting"], "zstd"),
        s["exports"],
        materialise(released(s, *cases.CASE_COLUMNS), "zstd"),
        s["one_to_one_list"],
        precomputed(s),
        s.basel,
        config,
    )


_WITHOUT_KS = [
    c for c in cases.CASE_INDICATORS if c not in (
        "does_not_conform_benford_ks_1st_digit",
        "does_not_conform_benford_ks_2nd_digit",
    )
]


_INDICATORS_SQL = f"""SELECT bn, importer_id, importer_name, CAST(mi AS INT) AS miscalculations, CAST(pc AS INT) AS inconsistent_values,
        nc AS numbered_company, 1 AS has_trade, CAST(COALESCE(high_dormancy, FALSE) AS INT) AS high_dormancy,
        CAST(COALESCE(rounded_transactions, FALSE) AS INT) AS rounded_transactions,
        CAST(COALESCE(high_first_transaction, FALSE) AS INT) AS high_first_transaction,
        CAST(COALESCE(inconsistent_lines_of_trade, FALSE) AS INT) AS inconsistent_lines_of_trade,
        CAST(oo AS INT) AS has_1_to_1_relationship, CAST(hr AS INT) AS trades_with_high_risk_jurisdictions,
        CAST(COALESCE(vg, FALSE) AS INT) AS has_vague_descriptions
    FROM (SELECT c.*, COALESCE({_NUMBERED}, 0) AS nc,
        c.bn IS NOT NULL AND c.bn IN (SELECT bn FROM {{miscalc}}) AS mi,
        c.bn IS NOT NULL AND c.bn IN (SELECT CAST(ax_clnt_nbr AS VARCHAR) FROM {{price_steps}}
            WHERE prev_ppu - invoice_ppu IS NOT NULL) AS pc,
        c.bn IS NOT NULL AND c.bn IN (SELECT CAST(importer AS VARCHAR) FROM {{one_to_one_list}}) AS oo,
        c.bn IS NOT NULL AND c.bn IN (SELECT SUBSTR(importer_id, 1, 9) FROM {{accounting}} a JOIN {{basel}} b
            ON b.iso_code = a.country_of_export
            WHERE basel_ml_tf_risk >= 5.5 AND importer_id IS NOT NULL) AS hr,
        (SELECT MAX(prop_vague >= 0.05) FROM {{vague}} v WHERE v.bn = c.bn) AS vg,
        p.* EXCLUDE (importer_id)
    FROM {{company}} c LEFT JOIN {{precomputed}} p ON p.importer_id = c.importer_id) t"""


@query("case_indicators_without_ks", _INDICATORS_SQL)
def _(s):
    return matrix(s).select("bn", "importer_id", "importer_name", *_WITHOUT_KS)


CASE_MATRIX_SQL = f"""SELECT *, {" + ".join(cases.CASE_INDICATORS)} AS total_indicators,
        ({" + ".join(cases.CASE_INDICATORS)}) / 13 AS proportion_of_indicators
    FROM (SELECT i.*, CAST(COALESCE(a.p_value <= 0.05, FALSE) AS INT) AS does_not_conform_benford_ks_1st_digit,
            CAST(COALESCE(b.p_value <= 0.05, FALSE) AS INT) AS does_not_conform_benford_ks_2nd_digit
        FROM ({_INDICATORS_SQL}) i LEFT JOIN {{ksp1}} a ON a.bn = i.bn LEFT JOIN {{ksp2}} b ON b.bn = i.bn) t"""


@query("case_indicator_matrix", CASE_MATRIX_SQL)
def _(s):
    return matrix(s)


@query("write_case_matrix", CASE_MATRIX_SQL)
def _(s):
    path = f"{shared_dir(s.spark)}/cargoscope-case-matrix-{uuid4().hex}"
    write_parquet(matrix(s), path)
    return s.spark.read.parquet(path)
