"""Checking SQL shared by several queries, written directly from the definitions.

Nothing here follows the Spark plans: values are found with as-of joins, whole-partition
windows, correlated ranks and built-in quantiles.
"""

from __future__ import annotations

import math

from cargoscope.sources.schemas import DECLARATION_KEYS, EXTRACTS

_MISSING = "({c} IS NULL OR TRIM({c}) IN ('', 'NULL'))"


def _ok(c: str) -> str:
    return "NOT " + _MISSING.replace("{c}", c)


def _benford(value: str, digit: int) -> str:
    """Deviation per importer of one digit of one value."""
    if digit == 1:
        domain, floor = range(1, 10), 1
        share = {d: math.log10(1 + 1 / d) for d in domain}
    else:
        domain, floor = range(10), 10
        share = {d: sum(math.log10(1 + 1 / (10 * k + d)) for k in range(1, 10)) for d in domain}
    expected = ", ".join(f"({d}, {p!r})" for d, p in share.items())
    return f"""
        SELECT t.bn_9, AVG(ABS(COALESCE(h.n, 0) / t.n - e.p)) AS mad, MAX(t.n) AS n
        FROM (SELECT bn_9, COUNT(*) AS n FROM {{txn}} WHERE {value} >= {floor} GROUP BY bn_9) t
        CROSS JOIN (SELECT * FROM (VALUES {expected}) v(d, p)) e
        LEFT JOIN (SELECT bn_9, CAST(SUBSTR(CAST(CAST(FLOOR({value}) AS BIGINT) AS VARCHAR), {digit}, 1) AS INT)
                AS d, COUNT(*) AS n FROM {{txn}} WHERE {value} >= {floor} GROUP BY ALL) h
            ON h.bn_9 = t.bn_9 AND h.d = e.d
        GROUP BY t.bn_9"""


def _novelty(dim: str, grace: int = 180) -> str:
    return f"""
        SELECT f.bn_9, COUNT(*) AS n_distinct_dim,
            COUNT(*) FILTER (dim_first > ent_first + {grace}) AS n_late,
            COUNT(*) FILTER (dim_first > ent_first + {grace} AND dim_first >= ent_last - 90) AS n_recent_new
        FROM {{first_{dim}}} f JOIN {{span}} s ON s.bn_9 = f.bn_9 GROUP BY f.bn_9"""


def _first_seen(dim: str) -> str:
    return f"""
        SELECT bn_9, {dim} AS dim_val, MIN(arrival_date) AS dim_first FROM {{base}}
        WHERE arrival_date IS NOT NULL AND {_ok(dim)} GROUP BY ALL"""


def _expected_rows(test: str) -> str:
    domain = range(1, 10) if test == "1" else range(10, 100)
    total, rows = 0.0, []
    for d in domain:
        total += math.log10(1 + 1 / d)
        rows.append(f"({d}, {total!r})")
    return ", ".join(rows)


def _ks(test: str) -> str:
    """Statistic from observed and expected cumulative shares."""
    digits = int(test)
    text = (
        "LTRIM(REGEXP_REPLACE(CAST(CAST(ABS(value) AS DECIMAL(38,10)) AS VARCHAR), '[^0-9]', '', 'g'), '0')"
    )
    return f"""
        SELECT bn, MAX(n) AS n, MAX(ABS(seen / n - cum)) * SQRT(MAX(n)) AS statistic FROM (
            SELECT t.bn, t.n, e.cum, COUNT(v.d) AS seen
            FROM (SELECT bn, COUNT(*) AS n FROM (SELECT bn FROM {{trade_values}}
                    WHERE {text} <> '') q GROUP BY bn) t
            CROSS JOIN (SELECT * FROM (VALUES {_expected_rows(test)}) x(d, cum)) e
            LEFT JOIN (SELECT bn, CAST(RPAD(SUBSTR({text}, 1, {digits}), {digits}, '0') AS INT) AS d
                FROM {{trade_values}} WHERE {text} <> '') v
                ON v.bn IS NOT DISTINCT FROM t.bn AND v.d <= e.d
            GROUP BY ALL) g
        GROUP BY bn"""


def _ks_p(test: str) -> str:
    """Exact p-value: weights of all walks inside the band, a list per digit (see ``ks_p_value``)."""
    digits = range(1, 10) if test == "1" else range(10, 100)
    rows = ", ".join(f"({k}, LOG10({d + 1}.0 / {d}.0))" for k, d in enumerate(digits, 1))
    return f"""
        WITH RECURSIVE shares AS (
            SELECT k, p, SUM(p) OVER (ORDER BY k) AS cum FROM (VALUES {rows}) x(k, p)),
        walk AS (
            SELECT n, statistic, (statistic - 1e-9) * SQRT(n) AS reach, 0 AS k, CAST(0 AS BIGINT) AS low,
                [CAST(1 AS DOUBLE)] AS q
            FROM (SELECT DISTINCT n, statistic FROM {{ks{test}}}) d WHERE statistic < 3.8
            UNION ALL
            SELECT n, statistic, reach, k, below, CASE WHEN LEN(q) = 0 OR below > above THEN CAST([] AS DOUBLE[])
                ELSE LIST_TRANSFORM(RANGE(below, above + 1), LAMBDA s: LIST_DOT_PRODUCT(q,
                    w[(above - s + 1):(above - s + LEN(q))])) END
            FROM (SELECT *, LIST_TRANSFORM(RANGE(above - low, below - low - LEN(q), -1), LAMBDA x: CASE WHEN x < 0 THEN 0
                    ELSE EXP(x * LN(n * p) - n * p - LGAMMA(GREATEST(x, 0) + 1)) END) AS w
                FROM (SELECT w.n, w.statistic, w.reach, s.k, w.low, w.q, s.p,
                        GREATEST(0, CAST(FLOOR(n * LEAST(cum, 1) - reach) AS BIGINT) + 1) AS below,
                        LEAST(CAST(n AS BIGINT), CAST(CEIL(n * LEAST(cum, 1) + reach) AS BIGINT) - 1) AS above
                    FROM walk w JOIN shares s ON s.k = w.k + 1) b) c),
        ended AS (
            SELECT n, statistic, COALESCE(q[n - low + 1], 0) * EXP(LGAMMA(n + 1) + n - n * LN(n)) AS inside
            FROM walk WHERE k = {len(digits)})
        SELECT v.bn, v.n, v.statistic, COALESCE(LEAST(1, GREATEST(0, 1 - inside)), 0) AS p_value
        FROM {{ks{test}}} v LEFT JOIN ended e ON e.n = v.n AND e.statistic = v.statistic"""


#: The model of the queries: trees, rows of a tree, seed, and the profile columns it reads.
_TREES, _SAMPLE, _SEED = 200, 256, 42
_ML = (
    "txn_cnt", "std_log_val", "tenure_days", "n_value_anom", "n_reactivation", "max_abs_z", "recent_new_countries",
    "recent_new_chapters", "n_spike_months", "max_vol_z", "distinct_vendor_countries", "distinct_sections",
)


def _drawn(what: str) -> str:
    return f"('0x' || SUBSTR(MD5('{_SEED}:' || tree || ':' || node || ':{what}'), 1, 13))::BIGINT / 4503599627370496.0"


def _split(over: str) -> str:
    """A node's size, depth limit, chosen feature and cut, over a window or a group."""
    lows, highs = (", ".join(f"{f}(x[{i}]){over}" for i in range(1, len(_ML) + 1)) for f in ("MIN", "MAX"))
    return f"""SELECT *, lows[feature] + {_drawn("cut")} * (highs[feature] - lows[feature]) AS cut FROM (
            SELECT *, CASE WHEN n >= 2 AND depth < (SELECT depth_limit FROM {{ml_size}})
                THEN varied[1 + CAST(FLOOR({_drawn("feature")} * LEN(varied)) AS INT)] END AS feature FROM (
            SELECT *, LIST_FILTER(RANGE(1, {len(_ML) + 1}), LAMBDA i: highs[i] > lows[i]) AS varied FROM (
            SELECT %s, COUNT(*){over} AS n, [{lows}] AS lows, [{highs}] AS highs FROM %s) a) b) c"""


def _mean_depth(n: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (LN({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} END"


_MODEL = {
    "ml_input": f"""
        SELECT bn_9, is_consolidator = 0 AND txn_cnt >= 12 AS fit,
            [{", ".join(f"CAST(SIGN(COALESCE({c}, 0)) * LN(1 + ABS(COALESCE({c}, 0))) AS DOUBLE)" for c in _ML)}] AS x
        FROM {{profile}}""",
    "ml_sample": f"""
        SELECT tree, bn_9, x FROM (SELECT CAST(range AS INT) AS tree FROM RANGE({_TREES})) t CROSS JOIN {{ml_input}} WHERE fit
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tree ORDER BY MD5(COALESCE(bn_9, '') || ':' || tree || ':{_SEED}'), bn_9) <= {_SAMPLE}""",
    "ml_size": """
        SELECT CEIL(LOG2(GREATEST(COUNT(*), 2))) AS depth_limit, COUNT(*) AS psi FROM {ml_sample} WHERE tree = 0""",
    "ml_nodes": f"""
        WITH RECURSIVE grown AS (
            SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, bn_9, x FROM {{ml_sample}}
            UNION ALL
            SELECT tree, 2 * node + CASE WHEN x[feature] <= cut THEN 0 ELSE 1 END, depth + 1, bn_9, x
            FROM ({_split(" OVER (PARTITION BY tree, node)") % ("tree, node, depth, bn_9, x", "grown")}) d
            WHERE feature IS NOT NULL)
        {_split("") % ("tree, node, depth", "grown GROUP BY tree, node, depth")}""",
    "ml_scored": f"""
        WITH RECURSIVE walk AS (
            SELECT bn_9, x, CAST(range AS INT) AS tree, CAST(1 AS BIGINT) AS node FROM {{ml_input}} CROSS JOIN RANGE({_TREES}) t
            UNION ALL
            SELECT bn_9, x, w.tree, 2 * w.node + CASE WHEN x[feature] <= cut THEN 0 ELSE 1 END
            FROM walk w JOIN {{ml_nodes}} m ON m.tree = w.tree AND m.node = w.node WHERE feature IS NOT NULL)
        SELECT bn_9, ROUND(POWER(2, -AVG(depth + {_mean_depth("n")})
            / (SELECT GREATEST({_mean_depth("psi")}, 1) FROM {{ml_size}})), 9) AS ml_score
        FROM walk w JOIN {{ml_nodes}} m ON m.tree = w.tree AND m.node = w.node WHERE feature IS NULL GROUP BY bn_9""",
    "modelled": """
        SELECT p.*, s.ml_score, CAST(i.fit AND s.ml_score >= (SELECT QUANTILE_CONT(ml_score, 0.99)
            FROM {ml_scored} q JOIN {ml_input} f ON f.bn_9 IS NOT DISTINCT FROM q.bn_9 WHERE f.fit) AS INT) AS ml_outlier
        FROM {profile} p JOIN {ml_scored} s ON s.bn_9 IS NOT DISTINCT FROM p.bn_9
        JOIN {ml_input} i ON i.bn_9 IS NOT DISTINCT FROM p.bn_9""",
}


def _kept(name: str, ids: bool = True) -> str:
    keys, payload = EXTRACTS[name]
    semi = " WHERE ax_clnt_nbr IN (SELECT entity_id FROM {entity_ids})" if ids else ""
    return f"SELECT {', '.join((*keys, *payload))} FROM {{x_{name}}}{semi}"


_D = ", ".join(DECLARATION_KEYS)
_ITEM = "drv_req_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr"
_RECORD = "clnt_sply_req_id, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr"
_ORDER = (
    f"{_D}, pty_tcde NULLS FIRST, price_tcde NULLS FIRST, pty_id NULLS FIRST, itm_char_sqnbr NULLS FIRST, "
    "price_val NULLS FIRST, dprt_dt NULLS FIRST, msr_unit_tcde NULLS FIRST"
)
_PARTY_VALUES = ("rltd_pty_nm", "addr", "cty_nm", "pstl_zip_cde", "prov_st_cde", "cntry_cde", "pty_id")
_PARTIES = ("BROKER", "IMPORTER", "VENDOR")


def _downup(c: str, keys: str, order: str) -> str:
    window = f"(PARTITION BY {keys} ORDER BY {order}"
    return (
        f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER {window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"FIRST_VALUE({c} IGNORE NULLS) OVER {window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


_FILLED = ("class_cde", "dprt_dt", "itm_desc_txt", "invc_cntry_cde", "invc_st_cde", "clnt_sply_req_id")
_PARTY_COLUMNS = [f"{v}_{p.lower()}" for v in _PARTY_VALUES for p in _PARTIES]
_CARRIED = (
    f"{_D}, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr, clnt_sply_req_id, audt_ins_tstmp, ext_cus_clnt_id, "
    "cntry_orig_cde, ste_orig_cde, class_cde, itm_desc_txt, itm_char_sqnbr, msr_unit_tcde, unit_cnt, pkg_un_tcde, "
    "pkg_qty, un_pkg_tcde, qty, cmrc_invc_qty, invc_qty_uom_cde, cmrc_invc_wt_vol, invc_wt_uom_cde, invc_tamt, "
    "tamt_curcy_cde, invc_cntry_cde, invc_st_cde, dprt_dt, net_wt, net_wt_uom_cde, gro_wt, gro_wt_uom_cde, "
    "ttl_trans_val, price_crncy_cde"
)
RELEASE_COLUMNS = f"{_CARRIED}, invoice_total, invoice_ppu, {', '.join(_PARTY_COLUMNS)}"

VIEWS: dict[str, str] = {
    "fx": """
        SELECT * FROM (
            SELECT fx_day AS fx_date, 'USD' AS ccy, CAST(NULLIF(TRIM(FXUSDCAD), '') AS DECIMAL(9,3)) AS rate
            FROM {fx_wide}
            UNION ALL SELECT fx_day, 'EUR', CAST(NULLIF(TRIM(FXEURCAD), '') AS DECIMAL(9,3)) FROM {fx_wide}
            UNION ALL SELECT fx_day, 'GBP', CAST(NULLIF(TRIM(FXGBPCAD), '') AS DECIMAL(9,3)) FROM {fx_wide}
            UNION ALL SELECT DISTINCT fx_day, 'CAD', CAST(1 AS DECIMAL(9,3)) FROM {fx_wide}) u
        WHERE rate IS NOT NULL""",
    "sections": r"""
        SELECT LPAD(CAST(UNNEST(RANGE(a, b + 1)) AS VARCHAR), 2, '0') AS hs_chap_nbr, hs_section FROM (
            SELECT REGEXP_EXTRACT(value, 'Section ([IVXL]+):', 1) AS hs_section,
                CAST(REGEXP_EXTRACT(value, 'Chapters? (\d+)', 1) AS BIGINT) AS a,
                CAST(REGEXP_EXTRACT(value, '(\d+)$', 1) AS BIGINT) AS b
            FROM {section_text} WHERE value LIKE 'Section %') r""",
    "basel": """
        SELECT UPPER(TRIM(iso_code)) AS iso_code, country, basel_ml_tf_risk,
            CASE WHEN basel_ml_tf_risk >= 5.5 THEN 1 ELSE 0 END AS high_risk_ind FROM {basel_raw}""",
    "countries": """
        SELECT name AS country_name, UPPER(TRIM(code)) AS country_code, region AS region_world, sub_region
        FROM {country_raw}""",
    "party_codes": """
        SELECT TRIM(UNNEST(STRING_SPLIT(rltd_pty_tcde, 'or'))) AS pty_tcde, description
        FROM {party_codes_raw} WHERE description IS NOT NULL""",
    "base": """
        SELECT *, TRY_CAST(SUBSTR(actual_arrival_dttm, 1, 10) AS DATE) AS arrival_date, price_crncy_total AS ccy,
            CAST(NULLIF(NULLIF(TRIM(price_val_total), 'NULL'), '') AS DECIMAL(18,2)) AS price_val
        FROM {lines}""",
    "rated": """
        SELECT b.*, f.rate FROM {base} b ASOF LEFT JOIN {fx} f
            ON b.ccy = f.ccy AND b.arrival_date >= f.fx_date""",
    "txn": """
        SELECT clnt_sply_req_id, MAX(bn_9) AS bn_9, MAX(arrival_date) AS arrival_date,
            CAST(SUM(price_val * rate) AS DOUBLE) AS txn_value_cad,
            CASE WHEN COUNT(DISTINCT ccy) = 1 THEN CAST(SUM(price_val) AS DOUBLE) END AS txn_value_decl,
            CASE WHEN COUNT(DISTINCT ccy) = 1 THEN MAX(ccy) END AS decl_ccy,
            CASE WHEN COUNT(DISTINCT ccy) > 1 THEN 1 ELSE 0 END AS is_mixed_ccy_txn,
            CAST(SUM(CASE WHEN rate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lines_fx_missing,
            COUNT(*) AS line_cnt
        FROM {rated} GROUP BY clnt_sply_req_id""",
    "cons": """
        SELECT bn_9, COUNT(DISTINCT importer_name) AS distinct_importer_names,
            COUNT(DISTINCT consignee_name) AS distinct_consignees,
            COUNT(DISTINCT clnt_sply_req_id) AS txn_cnt,
            CASE WHEN COUNT(DISTINCT importer_name) >= 20 THEN 1 ELSE 0 END AS is_consolidator
        FROM {lines} GROUP BY bn_9""",
    "ent_value": """
        SELECT bn_9, COUNT(*) AS txn_cnt,
            CAST(SUM(CAST(txn_value_cad AS DECIMAL(28,6))) AS DOUBLE) AS total_value_cad,
            CAST(SUM(CAST(txn_value_cad AS DECIMAL(28,6))) AS DOUBLE) / COUNT(txn_value_cad) AS avg_txn_value_cad,
            MAX(txn_value_cad) AS max_txn_value_cad, MIN(arrival_date) AS first_arrival,
            MAX(arrival_date) AS last_arrival
        FROM {txn} GROUP BY bn_9""",
    "ent_line": """
        SELECT l.bn_9, COUNT(*) AS line_cnt, COUNT(DISTINCT l.hs_chap_nbr || hs_hd_sfx || hs_sbhd_sfx) AS distinct_hs6,
            COUNT(DISTINCT l.hs_chap_nbr) AS distinct_chapters, COUNT(DISTINCT hs_section) AS distinct_sections,
            COUNT(DISTINCT vendor_name) AS distinct_vendors,
            COUNT(DISTINCT vendor_cntry_cde) AS distinct_vendor_countries
        FROM {lines} l LEFT JOIN {sections} s ON s.hs_chap_nbr = l.hs_chap_nbr GROUP BY l.bn_9""",
    "features": """
        SELECT v.*, l.* EXCLUDE (bn_9), COALESCE(c.is_consolidator, 0) AS is_consolidator
        FROM {ent_value} v LEFT JOIN {ent_line} l ON l.bn_9 = v.bn_9 LEFT JOIN {cons} c ON c.bn_9 = v.bn_9""",
    "ind_src": """
        SELECT bn_9, AVG(CASE WHEN REGEXP_MATCHES(LTRIM(importer_name), '^[0-9][0-9][0-9][0-9]') THEN 1.0::DOUBLE
                ELSE 0 END) AS importer_numbered_share,
            AVG(CASE WHEN REGEXP_MATCHES(LTRIM(vendor_name), '^[0-9][0-9][0-9][0-9]') THEN 1.0::DOUBLE ELSE 0 END)
                AS vendor_numbered_share,
            AVG(CASE WHEN price_val >= 1 AND CAST(ROUND(price_val) AS BIGINT) % 1000 = 0 THEN 1.0::DOUBLE
                ELSE 0 END) AS round_1000_share,
            AVG(CASE WHEN price_val >= 1 AND CAST(ROUND(price_val) AS BIGINT) % 100 = 0 THEN 1.0::DOUBLE
                ELSE 0 END) AS round_100_share,
            MAX(COALESCE(high_risk_ind, 0)) AS any_high_risk,
            AVG(CASE WHEN high_risk_ind = 1 THEN 1.0::DOUBLE ELSE 0 END) AS high_risk_share
        FROM {base} l LEFT JOIN {basel} b ON b.iso_code = l.vendor_cntry_cde GROUP BY bn_9""",
    "gaps": """
        SELECT *, CAST(arrival_date - LAG(arrival_date) OVER w AS INT) AS gap_days, ROW_NUMBER() OVER w AS rn
        FROM {txn} WHERE arrival_date IS NOT NULL
        WINDOW w AS (PARTITION BY bn_9 ORDER BY arrival_date, clnt_sply_req_id)""",
    "ind_txn": """
        SELECT bn_9, MAX(gap_days) AS max_gap_days, MAX(CASE WHEN rn = 1 THEN txn_value_cad END) AS first_txn_value_cad
        FROM {gaps} GROUP BY bn_9""",
    "b1_decl": _benford("txn_value_decl", 1),
    "b2_decl": _benford("txn_value_decl", 2),
    "b1_cad": _benford("txn_value_cad", 1),
    "b2_cad": _benford("txn_value_cad", 2),
    "assembled": """
        SELECT f.*, s.* EXCLUDE (bn_9), t.* EXCLUDE (bn_9), b1.mad AS benford1_mad_decl, b2.mad AS benford2_mad_decl,
            c1.mad AS benford1_mad_cad, c2.mad AS benford2_mad_cad,
            CASE WHEN b1.n >= 50 AND b1.mad > 0.05 THEN 1 ELSE 0 END AS i4_benford1,
            CASE WHEN b2.n >= 50 AND b2.mad > 0.03 THEN 1 ELSE 0 END AS i5_benford2,
            CASE WHEN c1.n IS NOT NULL THEN CASE WHEN c1.n >= 50 AND c1.mad > 0.05 THEN 1 ELSE 0 END END
                AS i4_benford1_cad,
            CASE WHEN c2.n IS NOT NULL THEN CASE WHEN c2.n >= 50 AND c2.mad > 0.03 THEN 1 ELSE 0 END END
                AS i5_benford2_cad
        FROM {features} f LEFT JOIN {ind_src} s ON s.bn_9 = f.bn_9 LEFT JOIN {ind_txn} t ON t.bn_9 = f.bn_9
        LEFT JOIN {b1_decl} b1 ON b1.bn_9 = f.bn_9 LEFT JOIN {b2_decl} b2 ON b2.bn_9 = f.bn_9
        LEFT JOIN {b1_cad} c1 ON c1.bn_9 = f.bn_9 LEFT JOIN {b2_cad} c2 ON c2.bn_9 = f.bn_9""",
    "filled": """
        SELECT * REPLACE (COALESCE(max_gap_days, 0) AS max_gap_days,
            COALESCE(first_txn_value_cad, 0) AS first_txn_value_cad) FROM {assembled}""",
    "cuts": """
        SELECT ROUND(GREATEST(QUANTILE_CONT(round_1000_share, 0.75) FILTER (is_consolidator = 0), 0.1), 9) AS round_thr,
            ROUND(QUANTILE_CONT(CAST(max_gap_days AS DOUBLE), 0.75) FILTER (txn_cnt >= 2), 9) AS gap_thr,
            ROUND(QUANTILE_CONT(first_txn_value_cad, 0.75), 9) AS first_thr
        FROM {filled}""",
    "flagged": """
        SELECT f.*, CAST(importer_numbered_share >= 0.5 OR vendor_numbered_share >= 0.5 AS INT) AS i3_numbered,
            CAST(any_high_risk = 1 AS INT) AS i7_high_risk_juris,
            CAST(ROUND(CAST(max_gap_days AS DOUBLE), 9) >= gap_thr AND txn_cnt >= 2 AS INT) AS i8_dormancy,
            CAST(ROUND(round_1000_share, 9) >= round_thr AND is_consolidator = 0 AS INT) AS i9_rounded,
            CAST(ROUND(first_txn_value_cad, 9) >= first_thr AS INT) AS i10_high_first_txn,
            CAST(distinct_sections >= 3 AND is_consolidator = 0 AS INT) AS i11_lines_of_trade
        FROM {filled} f CROSS JOIN {cuts} c""",
    "matrix": """
        SELECT *, CAST(i3_numbered + i4_benford1 + i5_benford2 + i7_high_risk_juris + i8_dormancy + i9_rounded
            + i10_high_first_txn + i11_lines_of_trade AS INT) AS flag_count,
            CAST(i3_numbered + i4_benford1 + i5_benford2 + i7_high_risk_juris + i8_dormancy + i9_rounded
            + i10_high_first_txn + i11_lines_of_trade AS DOUBLE) AS risk_score
        FROM {flagged}""",
    # -- behaviour -----------------------------------------------------------------------------
    "scorable": """
        SELECT *, LN(txn_value_cad) AS log_val FROM {txn} WHERE txn_value_cad > 0 AND arrival_date IS NOT NULL""",
    "baseline": """
        SELECT bn_9, COUNT(*) AS txn_cnt, AVG(log_val) AS mean_log_val, STDDEV_SAMP(log_val) AS std_log_val,
            MIN(arrival_date) AS first_arrival, MAX(arrival_date) AS last_arrival,
            CAST(MAX(arrival_date) - MIN(arrival_date) AS INT) AS tenure_days
        FROM {scorable} GROUP BY bn_9""",
    "scored": """
        SELECT clnt_sply_req_id, bn_9, arrival_date, txn_value_cad, entity_txn_cnt,
            CASE WHEN sd > 0 THEN (log_val - mean) / sd END AS value_z, days_since_prev,
            CASE WHEN days_since_prev >= 365 THEN 1 ELSE 0 END AS is_reactivation
        FROM (SELECT *, AVG(log_val) OVER e AS mean, STDDEV_SAMP(log_val) OVER e AS sd, COUNT(*) OVER e AS entity_txn_cnt,
                CAST(arrival_date - LAG(arrival_date) OVER (PARTITION BY bn_9 ORDER BY arrival_date, clnt_sply_req_id)
                    AS INT) AS days_since_prev
            FROM {scorable} WINDOW e AS (PARTITION BY bn_9)) x""",
    "scored_rollup": """
        SELECT bn_9, CAST(SUM(CASE WHEN ABS(value_z) >= 3 AND entity_txn_cnt >= 12 THEN 1 ELSE 0 END) AS BIGINT)
                AS n_value_anom,
            CAST(SUM(is_reactivation) AS BIGINT) AS n_reactivation, MAX(ABS(value_z)) AS max_abs_z
        FROM {scored} GROUP BY bn_9""",
    "span": """
        SELECT bn_9, MIN(arrival_date) AS ent_first, MAX(arrival_date) AS ent_last FROM {base}
        WHERE arrival_date IS NOT NULL GROUP BY bn_9""",
    "first_vendor_cntry_cde": _first_seen("vendor_cntry_cde"),
    "first_hs_chap_nbr": _first_seen("hs_chap_nbr"),
    "nov_country": _novelty("vendor_cntry_cde"),
    "nov_chapter": _novelty("hs_chap_nbr"),
    "tuned_country": _novelty("vendor_cntry_cde", 90),
    "tuned_chapter": _novelty("hs_chap_nbr", 90),
    "months": """
        SELECT bn_9, STRFTIME(arrival_date, '%Y-%m') AS ym, COUNT(*) AS n_txn FROM {txn}
        WHERE arrival_date IS NOT NULL GROUP BY ALL""",
    "monthly": """
        SELECT bn_9, ym, n_txn, n_months, CASE WHEN sd > 0 THEN (n_txn - mean) / sd END AS vol_z
        FROM (SELECT *, AVG(n_txn) OVER e AS mean, STDDEV_SAMP(n_txn) OVER e AS sd, COUNT(*) OVER e AS n_months
            FROM {months} WINDOW e AS (PARTITION BY bn_9)) x""",
    "monthly_roll": """
        SELECT bn_9, CAST(SUM(CASE WHEN vol_z >= 3 AND n_months >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_spike_months,
            MAX(vol_z) AS max_vol_z
        FROM {monthly} GROUP BY bn_9""",
    "rollup": """
        SELECT b.bn_9, b.txn_cnt, std_log_val, tenure_days, COALESCE(n_value_anom, 0) AS n_value_anom,
            COALESCE(n_reactivation, 0) AS n_reactivation, max_abs_z,
            COALESCE(c.n_recent_new, 0) AS recent_new_countries, COALESCE(h.n_recent_new, 0) AS recent_new_chapters,
            COALESCE(n_spike_months, 0) AS n_spike_months, max_vol_z, COALESCE(is_consolidator, 0) AS is_consolidator,
            distinct_vendor_countries, distinct_sections
        FROM {baseline} b LEFT JOIN {scored_rollup} a ON a.bn_9 = b.bn_9 LEFT JOIN {nov_country} c ON c.bn_9 = b.bn_9
        LEFT JOIN {nov_chapter} h ON h.bn_9 = b.bn_9 LEFT JOIN {monthly_roll} m ON m.bn_9 = b.bn_9
        LEFT JOIN {features} f ON f.bn_9 = b.bn_9""",
    "profile": """
        SELECT *, a_value + a_reactivation + a_new_country + a_new_chapter + a_volume_spike AS rule_score FROM (
            SELECT * REPLACE (COALESCE(std_log_val, 0) AS std_log_val, COALESCE(max_abs_z, 0) AS max_abs_z,
                    COALESCE(max_vol_z, 0) AS max_vol_z, CAST(tenure_days AS DOUBLE) AS tenure_days),
                CAST(n_value_anom > 0 AS INT) AS a_value, CAST(n_reactivation > 0 AS INT) AS a_reactivation,
                CAST(recent_new_countries > 0 AND is_consolidator = 0 AS INT) AS a_new_country,
                CAST(recent_new_chapters > 0 AND is_consolidator = 0 AS INT) AS a_new_chapter,
                CAST(n_spike_months > 0 AS INT) AS a_volume_spike
            FROM {rollup}) r""",
    **_MODEL,
    # -- declarations --------------------------------------------------------------------------
    "entity_ids": """
        SELECT DISTINCT TRY_CAST(bn_number AS BIGINT) AS entity_id FROM {case_list}
        WHERE TRY_CAST(bn_number AS BIGINT) IS NOT NULL AND TRY_CAST(bn_number AS BIGINT) <> 100000003""",
    "k_root": _kept("root", False)
    + """ WHERE CAST(audt_ins_tstmp AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'
            AND so_id = '911' AND ax_clnt_nbr IN (SELECT entity_id FROM {entity_ids})""",
    **{f"k_{name}": _kept(name) for name in EXTRACTS if name != "root"},
    "joined": """
        SELECT * FROM {k_goods_source}
        LEFT JOIN {k_item_description} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr)
        LEFT JOIN {k_package_count} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr)
        LEFT JOIN {k_price} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr)
        LEFT JOIN {k_package_qty} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr, gagi_nbr)
        LEFT JOIN {k_invoice} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr)
        LEFT JOIN {k_invoice_country} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id,
            req_vers_nbr, cmrc_invc_nbr)
        LEFT JOIN {k_party} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id, req_vers_nbr)
        LEFT JOIN {k_shipment} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id, req_vers_nbr)""",
    "rooted": """
        SELECT * FROM {joined} RIGHT JOIN {k_root} USING (drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr,
            so_id, req_vers_nbr)""",
    "newest": f"""
        SELECT * FROM {{rooted}} QUALIFY RANK() OVER (PARTITION BY {_ITEM} ORDER BY req_vers_nbr DESC NULLS LAST) = 1""",
    # The wide record exactly as described: fill, first rows, recode, pivot, fill, first rows, pivot.
    "w1": f"""
        SELECT * REPLACE ({", ".join(_downup(c, _ITEM, _ORDER) for c in _FILLED)}) FROM {{newest}}""",
    "w2": f"""
        SELECT * REPLACE (CASE WHEN TRIM(price_tcde) = '66' THEN 'Total' WHEN price_tcde IS NOT NULL THEN 'PPU' END
                AS price_tcde, c.description AS pty_tcde), w.pty_tcde AS pty_code, w.price_tcde AS price_code
        FROM (SELECT * FROM {{w1}} QUALIFY ROW_NUMBER() OVER (PARTITION BY {_ITEM}, pty_tcde, price_tcde
            ORDER BY {_ORDER}) = 1) w
        LEFT JOIN (SELECT pty_tcde AS code, description FROM {{party_codes}}) c ON c.code = TRIM(w.pty_tcde)""",
    "w3": f"""
        SELECT {_CARRIED}, pty_code, pty_tcde, pty_id, rltd_pty_nm_ln1, rltd_pty_nm_ln2, rltd_pty_nm_ln3, addr_ln1,
            addr_ln2, addr_ln3, cty_nm, pstl_zip_cde, prov_st_cde, cntry_cde, MIN(price_code) AS price_code,
            MAX(CASE WHEN price_tcde = 'Total' THEN price_val END) AS invoice_total,
            MAX(CASE WHEN price_tcde = 'PPU' THEN price_val END) AS invoice_ppu
        FROM {{w2}} GROUP BY ALL""",
    "w4": f"""
        SELECT * EXCLUDE (rltd_pty_nm_ln1, rltd_pty_nm_ln2, rltd_pty_nm_ln3, addr_ln1, addr_ln2, addr_ln3)
            REPLACE ({", ".join(_downup(c, _RECORD, f"{_D}, pty_code NULLS FIRST, price_code NULLS FIRST, pty_id NULLS FIRST") for c in ("invoice_total", "invoice_ppu"))}),
            COALESCE(rltd_pty_nm_ln1, ' ') || COALESCE(rltd_pty_nm_ln2, ' ') || COALESCE(rltd_pty_nm_ln3, ' ')
                AS rltd_pty_nm,
            COALESCE(addr_ln1, ' ') || COALESCE(addr_ln2, ' ') || COALESCE(addr_ln3, ' ') AS addr
        FROM {{w3}}""",
    "w5": f"""
        SELECT *, {", ".join(f"CASE WHEN pty_tcde = '{p}' THEN {v} END AS {v}_{p.lower()}" for v in _PARTY_VALUES for p in _PARTIES)}
        FROM {{w4}}""",
    "released": f"""
        SELECT * REPLACE (TRIM(clnt_sply_req_id) AS clnt_sply_req_id, TRIM(class_cde) AS class_cde) FROM (
            SELECT {_CARRIED}, invoice_total, invoice_ppu,
                {", ".join(f"FIRST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY {_RECORD} ORDER BY {_D}, pty_code NULLS FIRST, price_code NULLS FIRST, pty_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}" for c in _PARTY_COLUMNS)}
            FROM {{w5}} QUALIFY ROW_NUMBER() OVER (PARTITION BY {_RECORD}
                ORDER BY {_D}, pty_code NULLS FIRST, price_code NULLS FIRST, pty_id NULLS FIRST) = 1) r""",
    # -- case files ----------------------------------------------------------------------------
    "company": """
        SELECT importer_id, importer_name, REGEXP_EXTRACT(importer_id, '^[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]') AS bn FROM {accounting}
        WHERE importer_id IS NOT NULL
        QUALIFY ROW_NUMBER() OVER (PARTITION BY bn ORDER BY importer_id, importer_name) = 1
        UNION ALL
        SELECT * FROM (SELECT importer_id, importer_name, NULL AS bn FROM {accounting} WHERE importer_id IS NULL
            ORDER BY importer_name LIMIT 1) n""",
    "trade_values": """
        SELECT NULLIF(SUBSTR(importer_id, 1, 9), '') AS bn, value_currency_conversion AS value FROM {accounting}
        UNION ALL SELECT SUBSTR(exporter_bn15, 1, 9), total_commodity_value FROM {exports}""",
    "ks1": _ks("1"),
    "ks2": _ks("2"),
    "ksp1": _ks_p("1"),
    "ksp2": _ks_p("2"),
    "precomputed": """
        SELECT DISTINCT importer_id, COALESCE(d.percentile_range = 'Above 75th percentile', FALSE) AS high_dormancy,
            COALESCE(num_rounded_transactions > 1, FALSE) AS rounded_transactions,
            COALESCE(f.percentile_range = 'Above 75th percentile', FALSE) AS high_first_transaction,
            COALESCE(num_sections > 1, FALSE) AS inconsistent_lines_of_trade
        FROM {pre_dormancy} d LEFT JOIN {pre_rounded} r USING (importer_id)
        LEFT JOIN {pre_first_txn} f USING (importer_id) LEFT JOIN {pre_sections} s USING (importer_id)""",
    "miscalc": """
        SELECT DISTINCT CAST(ax_clnt_nbr AS VARCHAR) AS bn FROM {released}
        WHERE NOT ABS(invoice_ppu * unit_cnt - invoice_total) < 1.5e-8""",
    "price_steps": """
        SELECT ax_clnt_nbr, invoice_ppu, LAG(invoice_ppu) OVER (PARTITION BY ax_clnt_nbr, class_cde, msr_unit_tcde
            ORDER BY audt_ins_tstmp, clnt_sply_req_id NULLS FIRST, cmrc_invc_nbr NULLS FIRST, gagi_nbr NULLS FIRST,
                gds_itm_nbr NULLS FIRST) AS prev_ppu
        FROM {released}""",
    "texts": """
        SELECT clnt_sply_req_id, CAST(ax_clnt_nbr AS VARCHAR) AS bn, itm_desc_txt FROM {released}
        UNION ALL SELECT proof_of_report_number, SUBSTR(exporter_bn15, 1, 9), cargo_description FROM {exports}""",
    "text_stats": r"""
        SELECT *, CAST(LEN(REGEXP_EXTRACT_ALL(COALESCE(itm_desc_txt, ''), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) AS INT) AS tokens,
            CAST(LENGTH(COALESCE(itm_desc_txt, '')) AS INT) AS chars
        FROM {texts}""",
    "vague": """
        SELECT bn, AVG(CASE WHEN tokens < 3 AND chars <= 13 THEN 1.0::DOUBLE ELSE 0 END) AS prop_vague,
            COUNT(*) AS row_count
        FROM {text_stats} GROUP BY bn""",
}

# The transaction table over each transaction's highest version only.
VIEWS["lines_now"] = """
    SELECT * FROM {lines} QUALIFY req_vers_nbr = MAX(req_vers_nbr) OVER (PARTITION BY clnt_sply_req_id)"""
for _name, _source in (("base", "lines"), ("rated", "base"), ("txn", "rated")):
    VIEWS[f"{_name}_now"] = VIEWS[_name].replace(f"{{{_source}}}", f"{{{_source}_now}}")
