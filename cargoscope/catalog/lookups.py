"""Rates, transactions, lookups and per-importer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoscope.catalog.registry import query
from cargoscope.catalog.settings import RISK
from cargoscope.operators import entities as ent
from cargoscope.operators import fx as fxo
from cargoscope.operators import keys
from cargoscope.operators import transactions as tx
from cargoscope.operators.scoring import top_rows
from cargoscope.session import materialise

AS_OF = "1999-06-15"


def rates(s):
    """The prepared rate table, written once and read by each step of the as-of lookup."""
    return materialise(s.fx)


def transactions(s):
    return tx.txn_value(s["lines_core"], rates(s), RISK)


def written_transactions(s):
    """Transactions written once, for reports that read them more than once."""
    return materialise(transactions(s))


@query("distinct_pairs", "SELECT DISTINCT ccy, arrival_date FROM {base}")
def _(s):
    return fxo.distinct_pairs(tx.parsed_lines(s["lines_core"], RISK))


@query(
    "fx_asof_join",
    """SELECT p.ccy, p.arrival_date, CAST(f.rate AS DOUBLE) AS rate_to_cad
    FROM (SELECT DISTINCT ccy, arrival_date FROM {base}) p
    ASOF LEFT JOIN {fx} f ON p.ccy = f.ccy AND p.arrival_date >= f.fx_date""",
)
def _(s):
    pairs = fxo.fx_asof_join(tx.parsed_lines(s["lines_core"], RISK), rates(s))
    return pairs.withColumn("rate_to_cad", F.col("rate_to_cad").cast("double"))


_FIXING = "INTERVAL 16 HOUR"


@query(
    "fx_asof_times",
    f"""SELECT l.clnt_sply_req_id, l.line_no, l.ccy, l.arrived, CAST(f.rate AS DOUBLE) AS rate_to_cad
    FROM (SELECT clnt_sply_req_id, line_no, price_crncy_total AS ccy, CASE WHEN actual_arrival_dttm <> 'NULL'
            THEN CAST(actual_arrival_dttm AS TIMESTAMP) + INTERVAL 5 HOUR * line_no END AS arrived
        FROM {{lines_core}}) l
    ASOF LEFT JOIN (SELECT ccy, rate, CAST(fx_date AS TIMESTAMP) + {_FIXING} AS fixed FROM {{fx}}) f
        ON l.ccy = f.ccy AND l.arrived >= f.fixed""",
)
def _(s):
    known = F.when(F.col("actual_arrival_dttm") != "NULL", F.col("actual_arrival_dttm"))
    arrived = known.cast("timestamp_ntz") + F.expr("INTERVAL '5' HOUR * line_no")
    lines = s["lines_core"].select(
        "clnt_sply_req_id", "line_no", F.col("price_crncy_total").alias("ccy"), arrived.alias("arrived")
    )
    fixed = s.fx.withColumn("fixed", F.col("fx_date").cast("timestamp_ntz") + F.expr("INTERVAL '16' HOUR"))
    rated = fxo.with_rate(materialise(lines), fixed, "ccy", "arrived", "fixed")
    return rated.withColumn("rate_to_cad", F.col("rate_to_cad").cast("double"))


@query(
    "latest_rate",
    f"""SELECT ccy, fx_date, CAST(rate AS DOUBLE) AS rate_to_cad FROM {{fx}} WHERE fx_date <= DATE '{AS_OF}'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY ccy ORDER BY fx_date DESC) = 1""",
)
def _(s):
    latest = fxo.latest_rate(s.fx, AS_OF)
    return latest.withColumn("rate_to_cad", F.col("rate_to_cad").cast("double"))


@query(
    "line_rate_join",
    """SELECT clnt_sply_req_id, bn_9, arrival_date, ccy, CAST(price_val AS DOUBLE) AS price_val,
        CAST(rate AS DOUBLE) AS rate_to_cad FROM {rated}""",
)
def _(s):
    rated = tx.line_rate_join(s["lines_core"], rates(s), RISK)
    return rated.withColumns({c: F.col(c).cast("double") for c in ("price_val", "rate_to_cad")})


_PROFILE = """SELECT clnt_sply_req_id, COUNT(DISTINCT price_crncy_total) AS ccy_cnt,
    MAX(price_crncy_total) AS decl_ccy FROM {lines_core} GROUP BY clnt_sply_req_id"""


@query("txn_currency_profile", _PROFILE)
def _(s):
    return tx.txn_currency_profile(s["lines_core"])


@query(
    "txn_ccy_join",
    f"""SELECT clnt_sply_req_id, bn_9, arrival_date, ccy, CAST(price_val AS DOUBLE) AS price_val, ccy_cnt, decl_ccy
    FROM {{base}} JOIN ({_PROFILE}) p USING (clnt_sply_req_id)""",
)
def _(s):
    joined = tx.txn_ccy_join(s["lines_core"], RISK)
    return joined.withColumn("price_val", F.col("price_val").cast("double"))


@query("txn_value", "SELECT * FROM {txn}")
def _(s):
    return transactions(s)


@query("txn_value_dedup", "SELECT * FROM {txn_now}")
def _(s):
    return tx.txn_value(keys.current_lines(s["lines_core"], "clnt_sply_req_id"), rates(s), RISK)


@query(
    "txn_value_summary",
    """SELECT COUNT(*) AS n_transactions, COUNT(DISTINCT bn_9) AS n_entities,
        COUNT(*) FILTER (lines_fx_missing > 0) AS txns_with_fx_gaps,
        COUNT(*) FILTER (is_mixed_ccy_txn = 1) AS txns_mixed_ccy, COUNT(txn_value_decl) AS txns_with_decl_value,
        MIN(line_cnt) AS min_lines, AVG(line_cnt) AS avg_lines, MAX(line_cnt) AS max_lines,
        CAST(ROUND(SUM(CAST(txn_value_cad AS DECIMAL(28,6))), 2) AS DOUBLE) AS total_value_cad FROM {txn}""",
)
def _(s):
    total = F.round("total_value_cad", 2).cast("double")
    return tx.txn_value_summary(transactions(s)).withColumn("total_value_cad", total)


@query(
    "mixed_ccy_sample",
    "SELECT * FROM {txn} WHERE is_mixed_ccy_txn = 1 ORDER BY clnt_sply_req_id LIMIT 5",
)
def _(s):
    return tx.mixed_ccy_sample(transactions(s))


@query("preview_samples", "SELECT * FROM {txn} ORDER BY clnt_sply_req_id LIMIT 5")
def _(s):
    return top_rows(transactions(s), 5, "clnt_sply_req_id")


@query(
    "basel_lookup",
    """SELECT clnt_sply_req_id, line_no, vendor_cntry_cde, COALESCE(high_risk_ind, 0) AS high_risk_ind
    FROM {lines_core} l LEFT JOIN {basel} b ON b.iso_code = l.vendor_cntry_cde""",
)
def _(s):
    rows = ent.basel_lookup(s["lines_core"], s.basel)
    return rows.select("clnt_sply_req_id", "line_no", "vendor_cntry_cde", "high_risk_ind")


@query(
    "section_lookup",
    """SELECT clnt_sply_req_id, line_no, l.hs_chap_nbr, hs_section
    FROM {lines_core} l LEFT JOIN {sections} s ON s.hs_chap_nbr = l.hs_chap_nbr""",
)
def _(s):
    rows = ent.section_lookup(s["lines_core"], s.sections)
    return rows.select("clnt_sply_req_id", "line_no", "hs_chap_nbr", "hs_section")


@query(
    "code_coverage",
    """SELECT COUNT(DISTINCT vendor_cntry_cde) AS distinct_vendor_cntry, COUNT(DISTINCT iso_code) AS matched_basel_codes
    FROM {lines_core} l LEFT JOIN {basel} b ON b.iso_code = l.vendor_cntry_cde
    WHERE vendor_cntry_cde <> 'NULL' AND vendor_cntry_cde <> ''""",
)
def _(s):
    return ent.code_coverage(s["lines_core"], s.basel)


@query(
    "unmatched_codes",
    """SELECT vendor_cntry_cde, MAX(country_name) AS country_name, COUNT(*) AS n_lines,
        COUNT(DISTINCT bn_9) AS n_importers, COUNT(DISTINCT clnt_sply_req_id) AS n_transactions
    FROM {lines_core} l LEFT JOIN {basel} b ON b.iso_code = l.vendor_cntry_cde
    LEFT JOIN {countries} c ON c.country_code = l.vendor_cntry_cde
    WHERE TRIM(vendor_cntry_cde) <> '' AND iso_code IS NULL GROUP BY vendor_cntry_cde""",
)
def _(s):
    return ent.unmatched_codes(s["lines_core"], s.basel, s.countries)


@query("consolidators", "SELECT * FROM {cons}")
def _(s):
    return ent.consolidators(s["lines"], RISK)


@query(
    "consolidator_summary",
    "SELECT COUNT(*) AS n_entities, CAST(SUM(is_consolidator) AS BIGINT) AS n_consolidators FROM {cons}",
)
def _(s):
    return ent.consolidator_summary(ent.consolidators(s["lines"], RISK))


@query("entity_value_features", "SELECT * FROM {ent_value}")
def _(s):
    return ent.entity_value_features(transactions(s))


@query("entity_line_features", "SELECT * FROM {ent_line}")
def _(s):
    return ent.entity_line_features(s["lines"], s.sections)


def features(s, txn):
    return ent.entity_features_join(
        ent.entity_value_features(txn), ent.entity_line_side(s["lines"], s.sections, RISK)
    )


@query("entity_features_join", "SELECT * FROM {features}")
def _(s):
    return features(s, transactions(s))


@query(
    "top_entities_by_value",
    "SELECT bn_9, txn_cnt, total_value_cad FROM {ent_value} ORDER BY total_value_cad DESC, bn_9 LIMIT 15",
)
def _(s):
    values = ent.entity_value_features(transactions(s)).select("bn_9", "txn_cnt", "total_value_cad")
    return top_rows(values, 15, F.desc("total_value_cad"), "bn_9")


@query("entity_line_indicators", "SELECT * FROM {ind_src}")
def _(s):
    return ent.entity_line_indicators(s["lines"], s.basel, RISK)


@query("entity_txn_indicators", "SELECT * FROM {ind_txn}")
def _(s):
    return ent.entity_txn_indicators(written_transactions(s))


@query("gap_days", "SELECT clnt_sply_req_id, bn_9, arrival_date, gap_days FROM {gaps}")
def _(s):
    gaps = ent.gap_days(written_transactions(s))
    return gaps.select("clnt_sply_req_id", "bn_9", "arrival_date", "gap_days")


@query("first_txn_value", "SELECT bn_9, first_txn_value_cad FROM {ind_txn}")
def _(s):
    return ent.entity_txn_indicators(transactions(s)).select("bn_9", "first_txn_value_cad")


@query(
    "indicator_assembly",
    """SELECT f.*, s.* EXCLUDE (bn_9), t.* EXCLUDE (bn_9) FROM {features} f
    LEFT JOIN {ind_src} s ON s.bn_9 = f.bn_9 LEFT JOIN {ind_txn} t ON t.bn_9 = f.bn_9""",
)
def _(s):
    txn = written_transactions(s)
    return ent.indicator_assembly(
        features(s, txn),
        ent.entity_line_indicators(s["lines"], s.basel, RISK),
        ent.entity_txn_indicators(txn),
    )


@query(
    "one_to_one_relationship",
    """WITH p AS (SELECT bn_9, vendor_name, COUNT(*) AS pair_lines FROM {lines} GROUP BY ALL)
    SELECT bn_9, vendor_name, pair_lines, COUNT(*) OVER i AS vendors_of_importer, COUNT(*) OVER v AS importers_of_vendor,
        pair_lines / SUM(pair_lines) OVER i AS importer_share, pair_lines / SUM(pair_lines) OVER v AS vendor_share,
        CAST(pair_lines / SUM(pair_lines) OVER i >= 0.02 AND pair_lines / SUM(pair_lines) OVER v >= 0.02 AS INT)
            AS is_exclusive
    FROM p WINDOW i AS (PARTITION BY bn_9), v AS (PARTITION BY vendor_name)""",
)
def _(s):
    return ent.one_to_one_relationship(s["lines"], share_min=0.02)


_VERSION_KEEP = "clnt_sply_req_id, line_no, req_vers_nbr, price_val_total"


@query(
    "dedup_latest_version",
    f"""SELECT {_VERSION_KEEP} FROM {{lines_core}}
    QUALIFY req_vers_nbr = MAX(req_vers_nbr) OVER (PARTITION BY clnt_sply_req_id)""",
)
def _(s):
    rows = s["lines_core"].withColumn("req_vers_nbr", F.lpad(F.col("req_vers_nbr").cast("string"), 4, "0"))
    kept = keys.dedup_latest_version(rows).select(*_VERSION_KEEP.split(", "))
    return kept.withColumn("req_vers_nbr", F.col("req_vers_nbr").cast("int"))


@query(
    "version_magnitude",
    """SELECT clnt_sply_req_id, COUNT(DISTINCT req_vers_nbr) AS n_versions FROM {lines_core}
    GROUP BY clnt_sply_req_id HAVING COUNT(DISTINCT req_vers_nbr) > 1""",
)
def _(s):
    return keys.version_magnitude(s["lines_core"])


@query(
    "distinct_project",
    "SELECT DISTINCT bn_9, vendor_cntry_cde, hs_chap_nbr FROM {lines_core}",
)
def _(s):
    return s["lines_core"].select("bn_9", "vendor_cntry_cde", "hs_chap_nbr").distinct()
