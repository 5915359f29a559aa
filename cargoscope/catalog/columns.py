"""Projections, predicates and scalar cleaning over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoscope.catalog.registry import query
from cargoscope.catalog.settings import EXCLUDED_TEXT
from cargoscope.functions import cleaning as cl
from cargoscope.operators import cases, release, scoring, unusable
from cargoscope.sources import readers

_LINE = "clnt_sply_req_id, line_no, l_partkey, l_suppkey"
LINE = _LINE.split(", ")


@query("clean_text_number", f"SELECT {_LINE}, CAST(price_val AS DOUBLE) AS price_val FROM {{base}}")
def _(s):
    price = cl.clean_number(F.col("price_val_total"))
    return s["lines_core"].select(*LINE, price.alias("price_val"))


@query(
    "missing_value_qa",
    """SELECT bn_9, COUNT(*) AS n_records FROM {lines_core}
    WHERE price_val_total IS NULL OR TRIM(price_val_total) IN ('', 'NULL') GROUP BY bn_9""",
)
def _(s):
    missing = s["lines_core"].where(~cl.present(F.col("price_val_total")))
    return missing.groupBy("bn_9").agg(F.count("*").alias("n_records"))


_REASON = """CASE WHEN price_val_total IS NULL THEN 'null' WHEN TRIM(price_val_total) = '' THEN 'blank'
    WHEN TRIM(price_val_total) = 'NULL' THEN 'mark' WHEN TRY_CAST(price_val_total AS DOUBLE) IS NULL THEN 'unreadable' END"""


@query(
    "missing_value_counts",
    f"""SELECT bn_9, reason, COUNT(*) AS n_records FROM (SELECT bn_9, {_REASON} AS reason FROM {{lines_core}}) t
    WHERE reason IS NOT NULL GROUP BY ALL""",
)
def _(s):
    return unusable.unusable_counts(s["lines_core"], "price_val_total", ["bn_9"])


@query(
    "missing_value_sample",
    f"""SELECT reason, n_records, sample_no, {_LINE}, price_val_total FROM (
        SELECT *, COUNT(*) OVER (PARTITION BY reason) AS n_records,
            CAST(ROW_NUMBER() OVER (PARTITION BY reason ORDER BY MD5(CONCAT_WS('|', {_LINE})), {_LINE}) AS INT) AS sample_no
        FROM (SELECT {_LINE}, price_val_total, {_REASON} AS reason FROM {{lines_core}}) t WHERE reason IS NOT NULL) r
    WHERE sample_no <= 20""",
)
def _(s):
    return unusable.unusable_sample(s["lines_core"], "price_val_total", LINE)


@query("arrival_date", f"SELECT {_LINE}, arrival_date FROM {{base}} WHERE arrival_date IS NOT NULL")
def _(s):
    day = cl.arrival_day(F.col("actual_arrival_dttm"))
    return s["lines_core"].select(*LINE, day.alias("arrival_date")).where("arrival_date is not null")


@query(
    "valid_dim_filter",
    f"SELECT {_LINE}, vendor_cntry_cde FROM {{lines_core}} WHERE vendor_cntry_cde <> 'NULL' AND vendor_cntry_cde <> ''",
)
def _(s):
    return readers.usable(s["lines_core"], "vendor_cntry_cde").select(*LINE, "vendor_cntry_cde")


@query(
    "starts_with_4_digits",
    f"""SELECT {_LINE}, importer_name,
        CAST(REGEXP_MATCHES(LTRIM(importer_name), '^[0-9][0-9][0-9][0-9]') AS INT) AS is_numbered
    FROM {{lines}}""",
)
def _(s):
    numbered = cl.as_flag(cl.starts_with_digits(F.col("importer_name")))
    return s["lines"].select(*LINE, "importer_name", numbered.alias("is_numbered"))


_ROUND = """SELECT {line}, CAST(COALESCE(price_val >= 1 AND CAST(ROUND(price_val * {x}) AS BIGINT) % (1000 * {x}) = 0, FALSE)
    AS INT) AS is_round_1000, CAST(COALESCE(price_val >= 1 AND CAST(ROUND(price_val * {x}) AS BIGINT) % (100 * {x}) = 0,
    FALSE) AS INT) AS is_round_100 FROM {{base}}"""


def _rounded(s, cents):
    price = cl.clean_number(F.col("price_val_total"))
    return s["lines_core"].select(
        *LINE,
        *[cl.as_flag(cl.is_round(price, m, cents)).alias(f"is_round_{m}") for m in (1000, 100)],
    )


@query("round_multiple", _ROUND.format(line=_LINE, x=1))
def _(s):
    return _rounded(s, cents=False)


@query("round_multiple_strict", _ROUND.format(line=_LINE, x=100))
def _(s):
    return _rounded(s, cents=True)


@query("hs6_code", f"SELECT {_LINE}, hs_chap_nbr || hs_hd_sfx || hs_sbhd_sfx AS hs6 FROM {{lines_core}}")
def _(s):
    code = cl.hs6(F.col("hs_chap_nbr"), F.col("hs_hd_sfx"), F.col("hs_sbhd_sfx"))
    return s["lines_core"].select(*LINE, code.alias("hs6"))


_NINE = "[0-9]" * 9


@query(
    "extract_bn",
    f"""SELECT importer_id, NULLIF(REGEXP_EXTRACT(importer_id, '^{_NINE}'), '') AS bn_anchored,
        NULLIF(REGEXP_EXTRACT('A' || importer_id, '^{_NINE}'), '') AS bn_missing,
        NULLIF(REGEXP_EXTRACT('A' || importer_id, '{_NINE}'), '') AS bn_anywhere FROM {{accounting}}""",
)
def _(s):
    raw, prefixed = F.col("importer_id"), F.concat(F.lit("A"), "importer_id")
    return s["accounting"].select(
        "importer_id",
        cl.business_number(raw).alias("bn_anchored"),
        cl.business_number(prefixed).alias("bn_missing"),
        cl.business_number(prefixed, anchored=False).alias("bn_anywhere"),
    )


@query(
    "exclude_by_pattern",
    f"SELECT importer_id, importer_name FROM {{accounting}} WHERE NOT CONTAINS(importer_id, '{EXCLUDED_TEXT}')",
)
def _(s):
    kept = readers.exclude_containing(s["accounting"], "importer_id", EXCLUDED_TEXT)
    return kept.select("importer_id", "importer_name")


@query(
    "price_type_recode",
    """SELECT drv_req_nbr, gds_itm_nbr, price_val, CASE WHEN TRIM(price_tcde) = '66' THEN 'Total'
        WHEN price_tcde IS NOT NULL THEN 'PPU' END AS price_tcde FROM {x_price}""",
)
def _(s):
    rows = release.price_type_recode(s["x_price"])
    return rows.select("drv_req_nbr", "gds_itm_nbr", "price_val", "price_tcde")


@query("trim_columns", "SELECT drv_req_nbr, TRIM(pty_tcde) AS pty_tcde, pty_id FROM {x_party}")
def _(s):
    return release.trim_columns(s["x_party"], ["pty_tcde"]).select("drv_req_nbr", "pty_tcde", "pty_id")


@query(
    "concat_name_address",
    """SELECT drv_req_nbr, pty_id, COALESCE(rltd_pty_nm_ln1, ' ') || COALESCE(rltd_pty_nm_ln2, ' ')
        || COALESCE(rltd_pty_nm_ln3, ' ') AS rltd_pty_nm,
        COALESCE(addr_ln1, ' ') || COALESCE(addr_ln2, ' ') || COALESCE(addr_ln3, ' ') AS addr FROM {x_party}""",
)
def _(s):
    return release.concat_name_address(s["x_party"]).select("drv_req_nbr", "pty_id", "rltd_pty_nm", "addr")


@query(
    "near_equal",
    f"""SELECT {_LINE}, CAST(ABS(CAST(price_val AS DOUBLE) - l_extendedprice) < 1.5e-8 AS INT) AS is_near
    FROM {{base}}""",
)
def _(s):
    price = cl.clean_number(F.col("price_val_total"))
    near = cl.is_near(price, F.col("l_extendedprice"), 1.5e-8)
    return s["lines_core"].select(*LINE, near.cast("int").alias("is_near"))


@query(
    "signed_log1p",
    "SELECT c_custkey, ROUND(SIGN(c_acctbal) * LN(1 + ABS(c_acctbal)), 6) AS log_balance FROM {customer}",
)
def _(s):
    value = F.round(cl.signed_log1p(F.col("c_acctbal")), 6)
    return s["customer"].select("c_custkey", value.alias("log_balance"))


@query(
    "year_month",
    "SELECT clnt_sply_req_id, line_no, STRFTIME(arrival_date, '%Y-%m') AS ym FROM {base}",
)
def _(s):
    day = cl.arrival_day(F.col("actual_arrival_dttm"))
    return s["lines_core"].select("clnt_sply_req_id", "line_no", cl.year_month(day).alias("ym"))


@query(
    "coerce_fill_zero",
    f"""SELECT {_LINE}, COALESCE(CAST(price_val AS DOUBLE), 0) AS price_val_total,
        COALESCE(TRY_CAST(vendor_cntry_cde AS DOUBLE), 0) AS vendor_cntry_cde FROM {{base}}""",
)
def _(s):
    rows = s["lines_core"].select(*LINE, "price_val_total", "vendor_cntry_cde")
    return scoring.coerce_fill_zero(rows, ["price_val_total", "vendor_cntry_cde"])


_FLAG_SAMPLE = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 2 = 0 END AS is_even,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS is_done FROM {orders}"""


@query(
    "fill_flags_false",
    f"""SELECT o_orderkey, CAST(COALESCE(is_even, FALSE) AS INT) AS is_even,
        CAST(COALESCE(is_done, FALSE) AS INT) AS is_done FROM ({_FLAG_SAMPLE}) t""",
)
def _(s):
    rows = s.spark.sql(_FLAG_SAMPLE, orders=s["orders"])
    filled = scoring.fill_flags_false(rows, ["is_even", "is_done"])
    return filled.select("o_orderkey", *[F.col(c).cast("int").alias(c) for c in ("is_even", "is_done")])


@query(
    "column_range_select",
    "SELECT drv_req_nbr, cty_nm, pstl_zip_cde, prov_st_cde, cntry_cde, pty_id FROM {x_party}",
)
def _(s):
    party = s["x_party"]
    places = scoring.columns_between(party, "cty_nm", "cntry_cde")
    kept = party.select("drv_req_nbr", *places, "pty_id")
    return scoring.move_columns(kept, ["pty_id"], after="drv_req_nbr")


_WEIGHTS = {"f_even": 1.0, "f_done": 2.0, "f_big": 0.5}
_WEIGHT_FLAGS = """SELECT o_orderkey, CAST(o_custkey % 2 = 0 AS INT) AS f_even,
    CAST(o_orderstatus = 'F' AS INT) AS f_done, CAST(o_totalprice > 200000 AS INT) AS f_big FROM {orders}"""


@query(
    "weighted_flag_sum",
    f"""SELECT *, CAST(f_even + f_done + f_big AS INT) AS flag_count,
        CAST(f_even + f_done * 2.0 + f_big * 0.5 AS DOUBLE) AS risk_score FROM ({_WEIGHT_FLAGS}) t""",
)
def _(s):
    return scoring.weighted_flag_sum(s.spark.sql(_WEIGHT_FLAGS, orders=s["orders"]), _WEIGHTS)


def _tokens(column: str) -> str:
    """Tokens by the word rule; each replacement runs twice, as its matches may share a character."""
    joined = column
    for before, marks, after in cases.INNER_MARKS:
        for _ in range(2):
            joined = f"REGEXP_REPLACE({joined}, '({before})[{marks.replace(chr(39), chr(39) * 2)}]({after})', '\\1_\\2', 'g')"
    return rf"CAST(LEN(REGEXP_EXTRACT_ALL({joined}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) AS INT)"


@query(
    "goods_text_stats",
    f"SELECT doc_id, {_tokens("text")} AS tokens, CAST(LENGTH(text) AS INT) AS chars FROM {{documents}}",
)
def _(s):
    return cases.goods_text_stats(s["documents"], "text").select("doc_id", "tokens", "chars")


@query(
    "vague_description",
    f"""SELECT clnt_sply_req_id, line_no, itm_desc_txt,
        CAST({_tokens("itm_desc_txt")} < 3 AND LENGTH(itm_desc_txt) <= 13 AS INT) AS vague_description
    FROM {{described_lines}}""",
)
def _(s):
    rows = cases.vague_description(s["described_lines"], "itm_desc_txt")
    return rows.select(
        "clnt_sply_req_id",
        "line_no",
        "itm_desc_txt",
        F.col("vague_description").cast("int").alias("vague_description"),
    )


@query(
    "vague_bottom_quartile",
    f"""WITH t AS (SELECT doc_id, {_tokens("text")} AS tokens, CAST(LENGTH(text) AS INT) AS chars
        FROM {{documents}})
    SELECT doc_id, tokens, chars, CAST(tokens <= (SELECT QUANTILE_CONT(tokens, 0.25) FROM t)
        OR chars <= (SELECT QUANTILE_CONT(chars, 0.25) FROM t) AS INT) AS in_bottom_quartile FROM t""",
)
def _(s):
    rows = cases.vague_bottom_quartile(s["documents"], "text")
    return rows.select(
        "doc_id", "tokens", "chars", F.col("in_bottom_quartile").cast("int").alias("in_bottom_quartile")
    )


