"""Explicit input schemas, so no read ever has to infer one."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in columns.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()

LINES = _table(
    bn_9=_S,
    clnt_sply_req_id=_S,
    req_vers_nbr=_I,
    line_no=_I,
    actual_arrival_dttm=_S,
    importer_name=_S,
    consignee_name=_S,
    vendor_name=_S,
    vendor_cntry_cde=_S,
    hs_chap_nbr=_S,
    hs_hd_sfx=_S,
    hs_sbhd_sfx=_S,
    price_val_total=_S,
    price_crncy_total=_S,
)

FX_LONG = _table(fx_date=DateType(), ccy=_S, rate_to_cad=_D)
SECTION_MAP = _table(hs_chap_nbr=_S, hs_section=_S)
JURISDICTIONS = _table(iso_code=_S, country=_S, basel_ml_tf_risk=_D, high_risk_ind=_I)
COUNTRIES = _table(country_name=_S, country_code=_S, region_world=_S, sub_region=_S)
PARTY_CODES = _table(pty_tcde=_S, description=_S)

ACCOUNTING = _table(
    importer_id=_S, importer_name=_S, value_currency_conversion=_D, country_of_export=_S
)
EXPORTS = _table(
    trade_document_id=_L,
    exporter_bn15=_S,
    total_commodity_value=_D,
    proof_of_report_number=_S,
    cargo_description=_S,
)

# Declaration extracts. Keys nest: declaration < invoice < goods group < item.
DECLARATION_KEYS = (
    "drv_req_nbr",
    "ax_clnt_nbr",
    "sbrn_pgm_id",
    "sbrn_pgm_acnt_nbr",
    "so_id",
    "req_vers_nbr",
)
INVOICE_KEYS = (*DECLARATION_KEYS, "cmrc_invc_nbr")
GROUP_KEYS = (*INVOICE_KEYS, "gagi_nbr")
ITEM_KEYS = (*GROUP_KEYS, "gds_itm_nbr")

# Payload columns of each extract and the key level it is joined on.
EXTRACTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "root": (DECLARATION_KEYS, ("ext_cus_clnt_id", "clnt_sply_req_id", "audt_ins_tstmp")),
    "party": (
        DECLARATION_KEYS,
        (
            "pty_tcde",
            "pty_id",
            "rltd_pty_nm_ln1",
            "rltd_pty_nm_ln2",
            "rltd_pty_nm_ln3",
            "addr_ln1",
            "addr_ln2",
            "addr_ln3",
            "cty_nm",
            "pstl_zip_cde",
            "prov_st_cde",
            "cntry_cde",
        ),
    ),
    "goods_source": (ITEM_KEYS, ("cntry_orig_cde", "ste_orig_cde")),
    "invoice": (
        INVOICE_KEYS,
        (
            "cmrc_invc_qty",
            "invc_qty_uom_cde",
            "cmrc_invc_wt_vol",
            "invc_wt_uom_cde",
            "invc_tamt",
            "tamt_curcy_cde",
        ),
    ),
    "item_detail": (ITEM_KEYS, ("gds_cntry_orig_cde", "gds_st_prov_cde")),
    "invoice_country": (INVOICE_KEYS, ("invc_cntry_cde", "invc_st_cde", "dprt_dt")),
    "item_description": (ITEM_KEYS, ("class_cde", "itm_desc_txt", "itm_char_sqnbr")),
    "shipment": (
        DECLARATION_KEYS,
        ("net_wt", "net_wt_uom_cde", "gro_wt", "gro_wt_uom_cde", "ttl_trans_val"),
    ),
    "price": (ITEM_KEYS, ("price_tcde", "price_val", "price_crncy_cde")),
    "package_qty": (GROUP_KEYS, ("un_pkg_tcde", "qty")),
    "package_count": (ITEM_KEYS, ("msr_unit_tcde", "unit_cnt", "pkg_un_tcde", "pkg_qty")),
}

TIMESTAMP = TimestampNTZType()
