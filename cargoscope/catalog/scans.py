"""Sources, reference tables and sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cargoscope.catalog.registry import query
from cargoscope.catalog.settings import (
    CASES,
    EXCLUDED_ENTITIES,
    FIRST_DAY,
    LAST_DAY,
    OFFICE,
    RISK,
)
from cargoscope.catalog.views import RELEASE_COLUMNS
from cargoscope.operators import release as rel
from cargoscope.operators.transactions import txn_value
from cargoscope.session import materialise, shared_dir, small_side
from cargoscope.sources import readers, reference, schemas, sinks

MONTH = "actual_arrival_dttm >= '1998-03-01' and actual_arrival_dttm < '1998-04-01'"
LINE_COLUMNS = ["bn_9", "clnt_sply_req_id", "line_no", "price_val_total", "price_crncy_total"]


@query("scan_lines", f"SELECT {', '.join(LINE_COLUMNS)} FROM {{lines_core}} WHERE {MONTH}")
def _(s):
    return readers.scan_lines(s["lines_core"], MONTH).select(*LINE_COLUMNS)


@query("fx_wide_to_long", "SELECT fx_date, ccy, CAST(rate AS DOUBLE) AS rate_to_cad FROM {fx}")
def _(s):
    return reference.fx_wide_to_long(s["fx_wide"], "fx_day")


@query(
    "melt_fx",
    """SELECT fx_day, rate_column, rate_text FROM (SELECT fx_day, FXUSDCAD, FXEURCAD, FXGBPCAD FROM {fx_wide})
    UNPIVOT INCLUDE NULLS (rate_text FOR rate_column IN (FXUSDCAD, FXEURCAD, FXGBPCAD))""",
)
def _(s):
    rates = ["FXUSDCAD", "FXEURCAD", "FXGBPCAD"]
    return s["fx_wide"].unpivot("fx_day", rates, "rate_column", "rate_text")


@query(
    "fx_coverage",
    "SELECT COUNT(*) AS n_rows, MIN(fx_date) AS min_date, MAX(fx_date) AS max_date FROM {fx}",
)
def _(s):
    return reference.fx_coverage(s.fx)


@query("hs_section_map", "SELECT hs_chap_nbr, hs_section FROM {sections}")
def _(s):
    return s.sections


@query("explode_chapters", "SELECT hs_section, CAST(hs_chap_nbr AS INT) AS chapter FROM {sections}")
def _(s):
    return s.sections.select("hs_section", F.col("hs_chap_nbr").cast("int").alias("chapter"))


@query("basel_index", "SELECT * FROM {basel}")
def _(s):
    return s.basel


@query("country_codes", "SELECT * FROM {countries}")
def _(s):
    return s.countries


@query("party_type_codes", "SELECT * FROM {party_codes}")
def _(s):
    return s.party_codes


@query(
    "explode_codes",
    """SELECT TRIM(UNNEST(STRING_SPLIT(rltd_pty_tcde, 'or'))) AS rltd_pty_tcde, description
    FROM {party_codes_raw}""",
)
def _(s):
    return reference.explode_codes(s["party_codes_raw"], "rltd_pty_tcde")


@query("party_descriptions", "SELECT DISTINCT description FROM {party_codes}")
def _(s):
    return reference.party_descriptions(s.party_codes)


def _folder(s, name: str) -> str:
    return f"{shared_dir(s.spark)}/cargoscope-{name}-{uuid4().hex}"


_ACCOUNTING = "SELECT importer_id, importer_name, value_currency_conversion, country_of_export FROM {accounting}"


@query("scan_csv_nullstr", _ACCOUNTING)
def _(s):
    path = _folder(s, "accounting-csv")
    rows = s["accounting"].select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in schemas.ACCOUNTING.names]
    )
    sinks.write_csv(rows, path)
    return readers.scan_csv(s.spark, path, schemas.ACCOUNTING, line_breaks=True)


PRECOMPUTED = {
    "dormancy": "pre_dormancy",
    "rounded": "pre_rounded",
    "first_txn": "pre_first_txn",
    "sections": "pre_sections",
}


def precomputed(s):
    return readers.left_join_all({n: s[t] for n, t in PRECOMPUTED.items()}, "importer_id")


@query(
    "multi_table_left_join",
    """SELECT importer_id, d.percentile_range AS dormancy_percentile_range, num_rounded_transactions,
        f.percentile_range AS first_txn_percentile_range, num_sections
    FROM {pre_dormancy} d LEFT JOIN {pre_rounded} r USING (importer_id)
    LEFT JOIN {pre_first_txn} f USING (importer_id) LEFT JOIN {pre_sections} c USING (importer_id)""",
)
def _(s):
    return precomputed(s)


@query(
    "drop_missing_key",
    """SELECT trade_document_id, exporter_bn15, total_commodity_value FROM {exports}
    WHERE trade_document_id IS NOT NULL""",
)
def _(s):
    kept = readers.drop_missing_key(s["exports"], "trade_document_id")
    return kept.select("trade_document_id", "exporter_bn15", "total_commodity_value")


def entity_ids(s):
    return readers.entity_ids(s["case_list"], "bn_number", EXCLUDED_ENTITIES)


def listed_entities(s):
    """The case list, written once and broadcast to every extract if short."""
    return small_side(materialise(entity_ids(s)))


def extracts(s) -> dict:
    """All extracts restricted to the case list."""
    ids = listed_entities(s)
    kept = {n: rel.extract(df, ids, n) for n, df in s.extracts.items() if n != "root"}
    return kept | {"root": rel.extract_root(s["x_root"], ids, FIRST_DAY, LAST_DAY, OFFICE)}


@query("entity_id_list", "SELECT entity_id FROM {entity_ids}")
def _(s):
    return entity_ids(s)


_COUNTED = [n for n in schemas.EXTRACTS if n != "root"]


@query(
    "extract_project_filter",
    " UNION ALL ".join(
        f"SELECT '{n}' AS extract_name, drv_req_nbr, ax_clnt_nbr, COUNT(*) AS n_rows FROM {{k_{n}}} GROUP BY ALL"
        for n in _COUNTED
    ),
)
def _(s):
    found, out = extracts(s), None
    for name in _COUNTED:
        rows = (
            found[name]
            .groupBy(F.lit(name).alias("extract_name"), "drv_req_nbr", "ax_clnt_nbr")
            .agg(F.count("*").alias("n_rows"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("extract_root_filter", "SELECT * FROM {k_root}")
def _(s):
    return rel.extract_root(s["x_root"], listed_entities(s), FIRST_DAY, LAST_DAY, OFFICE)


@query("in_list_semi", "SELECT * FROM {k_price}")
def _(s):
    return rel.extract(s["x_price"], listed_entities(s), "price")


@query("stage_table", "SELECT * FROM {txn}")
def _(s):
    root = _folder(s, "stages")

    def build():
        return txn_value(s["lines_core"], materialise(s.fx), RISK)

    made_of = {"inputs": [f"{s.folder}/{t}.parquet" for t in ("lineitem", "orders")], "settings": RISK}
    sinks.stage_table(s.spark, root, "txn_value", build, **made_of)
    return sinks.stage_table(s.spark, root, "txn_value", build, **made_of)


@query("write_csv_release", f"SELECT {RELEASE_COLUMNS} FROM {{released}}")
def _(s):
    from cargoscope.catalog.release import released

    path = _folder(s, "release-csv")
    out = released(s)
    sinks.write_csv(out, path)
    return readers.scan_csv(s.spark, path, out.schema, null_text="", line_breaks=True)
