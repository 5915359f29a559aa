"""Declaration assembly and the wide release record."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoscope.catalog.registry import query
from cargoscope.catalog.scans import extracts
from cargoscope.catalog.views import _ITEM, _PARTIES, _PARTY_VALUES, RELEASE_COLUMNS
from cargoscope.operators import keys
from cargoscope.operators import release as rel
from cargoscope.sources.reference import party_descriptions
from cargoscope.sources.schemas import DECLARATION_KEYS, ITEM_KEYS

ITEM = rel.ITEM


def parties(s) -> list[str]:
    """The descriptions of the party code table: a column group each."""
    return sorted(r["description"] for r in party_descriptions(s.party_codes).collect())


def released(s, *columns: str):
    """The wide records of the listed entities: the named columns, or all."""
    wanted = list(columns) or RELEASE_COLUMNS.split(", ")
    return rel.release_wide(extracts(s), s.party_codes, parties(s), wanted)


_ASSEMBLED = (
    "drv_req_nbr, req_vers_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr, itm_char_sqnbr, itm_desc_txt, unit_cnt, "
    "price_tcde, price_val, qty, invc_tamt, invc_cntry_cde, pty_tcde, pty_id, net_wt"
)


@query("release_assembly", f"SELECT {_ASSEMBLED} FROM {{joined}}")
def _(s):
    return rel.release_assembly(extracts(s)).select(*_ASSEMBLED.split(", "))


@query("release_root_join", f"SELECT {_ASSEMBLED}, clnt_sply_req_id, audt_ins_tstmp FROM {{rooted}}")
def _(s):
    x = rel.wanted_declarations(extracts(s))
    rooted = rel.release_root_join(rel.release_assembly(x), x["root"])
    return rooted.select(*_ASSEMBLED.split(", "), "clnt_sply_req_id", "audt_ins_tstmp")


_VERSIONED = "drv_req_nbr, req_vers_nbr, cmrc_invc_nbr, gagi_nbr, gds_itm_nbr, price_tcde, price_val"


@query(
    "latest_version",
    f"""SELECT {_VERSIONED} FROM {{x_price}}
    QUALIFY RANK() OVER (PARTITION BY {_ITEM} ORDER BY req_vers_nbr DESC) = 1""",
)
def _(s):
    return keys.latest_version(s["x_price"], ITEM, "req_vers_nbr").select(*_VERSIONED.split(", "))


_FILL_KEYS = ["drv_req_nbr", "req_vers_nbr", "pty_tcde", "pty_id"]
_FILL_ORDER = "pty_tcde, pty_id"


def _fill_sql(c: str) -> str:
    w = f"(PARTITION BY drv_req_nbr, req_vers_nbr ORDER BY {_FILL_ORDER}"
    return (
        f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"FIRST_VALUE({c} IGNORE NULLS) OVER {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


_FILL_COLUMNS = ["rltd_pty_nm_ln2", "rltd_pty_nm_ln3", "pstl_zip_cde", "prov_st_cde"]


@query(
    "fill_down_up",
    f"SELECT {', '.join(_FILL_KEYS)}, {', '.join(_fill_sql(c) for c in _FILL_COLUMNS)} FROM {{x_party}}",
)
def _(s):
    rows = s["x_party"].select(*_FILL_KEYS, *_FILL_COLUMNS)
    return keys.fill_down_up(
        rows, ["drv_req_nbr", "req_vers_nbr"], ["pty_tcde"], ["pty_id"], _FILL_COLUMNS
    )


@query(
    "distinct_keep_first",
    """SELECT drv_req_nbr, pty_tcde, pty_id, rltd_pty_nm_ln1, cty_nm FROM {x_party}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY drv_req_nbr, pty_tcde ORDER BY pty_id, req_vers_nbr) = 1""",
)
def _(s):
    first = keys.keep_first(s["x_party"], ["drv_req_nbr", "pty_tcde"], [F.asc("pty_id"), F.asc("req_vers_nbr")])
    return first.select("drv_req_nbr", "pty_tcde", "pty_id", "rltd_pty_nm_ln1", "cty_nm")


_ITEM_SQL = ", ".join(ITEM_KEYS)


@query(
    "pivot_price_type",
    f"""SELECT {_ITEM_SQL}, price_crncy_cde, MIN(price_val) FILTER (TRIM(price_tcde) = '66') AS invoice_total,
        MIN(price_val) FILTER (TRIM(price_tcde) <> '66') AS invoice_ppu FROM {{x_price}} GROUP BY ALL""",
)
def _(s):
    return rel.pivot_price_type(rel.price_type_recode(s["x_price"]), [*ITEM_KEYS, "price_crncy_cde"])


_DESCRIBED = """SELECT p.* EXCLUDE (pty_tcde), c.description AS pty_tcde, p.pty_tcde AS pty_code,
    COALESCE(rltd_pty_nm_ln1, ' ') || COALESCE(rltd_pty_nm_ln2, ' ') || COALESCE(rltd_pty_nm_ln3, ' ') AS rltd_pty_nm,
    COALESCE(addr_ln1, ' ') || COALESCE(addr_ln2, ' ') || COALESCE(addr_ln3, ' ') AS addr
    FROM {x_party} p LEFT JOIN {party_codes} c ON c.pty_tcde = TRIM(p.pty_tcde)"""


@query(
    "party_description_join",
    f"SELECT drv_req_nbr, req_vers_nbr, pty_id, pty_tcde FROM ({_DESCRIBED}) t",
)
def _(s):
    described = rel.party_description_join(s["x_party"], s.party_codes)
    return described.select("drv_req_nbr", "req_vers_nbr", "pty_id", "pty_tcde")


_PIVOTED = ", ".join(
    f"ARG_MIN({v}, (pty_code, pty_id)) FILTER (pty_tcde = '{p}' AND {v} IS NOT NULL) AS {v}_{p.lower()}"
    for v in _PARTY_VALUES
    for p in _PARTIES
)


@query(
    "pivot_party_type",
    f"SELECT {', '.join(DECLARATION_KEYS)}, {_PIVOTED} FROM ({_DESCRIBED}) t GROUP BY ALL",
)
def _(s):
    coded = s["x_party"].withColumn("pty_code", F.col("pty_tcde"))
    described = rel.concat_name_address(rel.party_description_join(coded, s.party_codes))
    return rel.pivot_party_type(described, list(DECLARATION_KEYS), parties(s))


@query("release_wide", f"SELECT {RELEASE_COLUMNS} FROM {{released}}")
def _(s):
    return released(s)
