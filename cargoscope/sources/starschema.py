"""Declared trade tables derived from a retail star schema.

Every table below is one SQL text that runs unchanged on Spark and on the checking engine.
``{name}`` refers to a base parquet table or to another derived table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cargoscope.session import materialise, size_tasks
from cargoscope.sources import reference
from cargoscope.sources.readers import scan_spread

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
)

# Importer number of a customer; importers 0 to 4 act for many customers.
_E = (
    "CASE WHEN o_custkey % 10 = 0 THEN CAST(FLOOR(o_custkey / 10) AS BIGINT) % 5 "
    "ELSE 5 + o_custkey % 145 END"
)
_ROMAN = "I,II,III,IV,V,VI,VII,VIII,IX,X,XI,XII,XIII,XIV,XV,XVI,XVII,XVIII,XIX,XX,XXI,XXII,XXIII,XXIV,XXV"
_D = "drv_req_nbr, ax_clnt_nbr, sbrn_pgm_id, sbrn_pgm_acnt_nbr, so_id, req_vers_nbr"
_V = f"{_D}, cmrc_invc_nbr"
_G = f"{_V}, gagi_nbr"
_I = f"{_G}, gds_itm_nbr"


def _keyed(order_key: str, version: str) -> str:
    return f"""
        'D' || CAST({order_key} AS STRING) AS drv_req_nbr, 100000000 + e AS ax_clnt_nbr,
        'RM' AS sbrn_pgm_id, '0001' AS sbrn_pgm_acnt_nbr,
        CASE WHEN {order_key} % 20 = 3 THEN '912' ELSE '911' END AS so_id,
        {version} AS req_vers_nbr"""


DERIVED: dict[str, str] = {
    "order_entities": f"SELECT *, {_E} AS e FROM {{orders}}",
    "lines_core": """
        SELECT CAST(100000000 + e AS STRING) AS bn_9,
            CAST(l_orderkey AS STRING) AS clnt_sply_req_id,
            l_linenumber AS line_no, l_linenumber % 3 + 1 AS req_vers_nbr,
            CASE WHEN l_orderkey % 997 = 0 THEN 'NULL'
                ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) || ' 00:00:00' END AS actual_arrival_dttm,
            'Consignee ' || CAST(l_partkey % 50 AS STRING) AS consignee_name,
            CASE WHEN l_orderkey % 211 = 0 THEN 'NULL'
                WHEN e % 4 = 0 AND CAST(l_shipdate AS DATE) >= DATE '2001-09-01' THEN 'C24'
                ELSE 'C' || LPAD(CAST((e * 3 + l_suppkey % 4) % 24 AS STRING), 2, '0')
                END AS vendor_cntry_cde,
            CASE WHEN e % 4 = 1 AND CAST(l_shipdate AS DATE) >= DATE '2001-09-01' THEN '93'
                ELSE LPAD(CAST((e * 7 + (l_partkey % (1 + e % 5)) * 11) % 97 + 1 AS STRING), 2, '0')
                END AS hs_chap_nbr,
            LPAD(CAST(l_partkey % 10 AS STRING), 2, '0') AS hs_hd_sfx,
            LPAD(CAST(l_suppkey % 10 AS STRING), 2, '0') AS hs_sbhd_sfx,
            CASE (l_orderkey * 7 + l_linenumber) % 101 WHEN 0 THEN 'NULL' WHEN 1 THEN '' WHEN 2 THEN NULL
                ELSE CAST(CAST(CASE WHEN l_partkey % 20 < e % 4 THEN ROUND(l_extendedprice / 1000) * 1000
                    ELSE l_extendedprice END AS DECIMAL(18,2)) AS STRING) END AS price_val_total,
            CASE WHEN l_orderkey % 50 = 0 THEN CASE l_linenumber % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END
                WHEN l_orderkey % 50 = 1 THEN 'XXX'
                ELSE CASE l_orderkey % 4 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END
                END AS price_crncy_total,
            e, l_orderkey, l_partkey, l_suppkey, o_custkey, l_extendedprice
        FROM {lineitem} l JOIN {order_entities} o ON l.l_orderkey = o.o_orderkey""",
    "lines": """
        SELECT x.*, CASE WHEN e % 40 = 7 THEN CAST(1000 + o_custkey AS STRING) || ' CANADA INC'
            ELSE c_name END AS importer_name, s_name AS vendor_name
        FROM {lines_core} x JOIN {customer} c ON x.o_custkey = c.c_custkey
        JOIN {supplier} s ON x.l_suppkey = s.s_suppkey""",
    "described_lines": """
        SELECT x.bn_9, x.clnt_sply_req_id, x.line_no, x.l_partkey,
            p_name || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE ' of type ' || p_type END AS itm_desc_txt
        FROM {lines_core} x JOIN {part} p ON x.l_partkey = p.p_partkey""",
    "fx_wide": """
        SELECT CAST(o_orderdate AS DATE) AS fx_day,
            CAST(CAST(1.300 + (SUM(o_orderkey) % 100) * 0.001 AS DECIMAL(9,3)) AS STRING) AS FXUSDCAD,
            CAST(CAST(1.500 + (COUNT(*) % 50) * 0.001 AS DECIMAL(9,3)) AS STRING) AS FXEURCAD,
            CASE WHEN SUM(o_orderkey) % 7 = 0 THEN '' WHEN SUM(o_orderkey) % 11 = 0 THEN NULL
                ELSE CAST(CAST(1.700 + (SUM(o_custkey) % 100) * 0.001 AS DECIMAL(9,3)) AS STRING)
                END AS FXGBPCAD,
            'published' AS FXNOTE
        FROM {orders} WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-31'
        GROUP BY CAST(o_orderdate AS DATE)""",
    "section_text": f"""
        SELECT 'Section ' || SPLIT_PART('{_ROMAN}', ',', CAST(k + 1 AS INT))
            || CASE WHEN lo = hi THEN ': Chapter ' || CAST(lo AS STRING)
                ELSE ': Chapters ' || CAST(lo AS STRING) || '-' || CAST(hi AS STRING) END AS value
        FROM (SELECT CAST(FLOOR((p_partkey % 97) / 4) AS INT) AS k, MIN(p_partkey % 97) + 1 AS lo,
                MAX(p_partkey % 97) + 1 AS hi
            FROM {{part}} GROUP BY CAST(FLOOR((p_partkey % 97) / 4) AS INT)) ranges
        UNION ALL SELECT 'Notes on ' || p_type AS value FROM {{part}} GROUP BY p_type""",
    "basel_raw": """
        SELECT ' c' || LPAD(CAST(n_nationkey AS STRING), 2, '0') || ' ' AS iso_code, n_name AS country,
            CAST(CASE WHEN n_nationkey IN (5, 11, 24) THEN 6.0 ELSE 3.0 + (n_nationkey % 5) * 0.4 END
                AS DOUBLE) AS basel_ml_tf_risk
        FROM {nation} WHERE n_nationkey <> 20
            AND n_nationkey IN (SELECT c_nationkey FROM {customer})""",
    "country_raw": """
        SELECT n_name AS name, ' c' || LPAD(CAST(n_nationkey AS STRING), 2, '0') AS code,
            r_name AS region, r_name || ' / ' || n_name AS sub_region
        FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
        WHERE n_nationkey IN (SELECT c_nationkey FROM {customer})""",
    "party_codes_raw": """
        SELECT DISTINCT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'IM or IP'
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'BR or CB' ELSE 'XX' END AS rltd_pty_tcde,
            CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'IMPORTER'
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'BROKER' END AS description
        FROM {customer}
        UNION ALL SELECT DISTINCT 'VN or VD' AS rltd_pty_tcde, 'VENDOR' AS description FROM {supplier}""",
    "case_list": """
        SELECT DISTINCT CASE WHEN e % 29 = 28 THEN 'n/a' ELSE CAST(100000000 + e AS STRING) END AS bn_number
        FROM {order_entities} WHERE e % 3 <> 1""",
    # -- declarations: every fifth order was sent twice, the first time with lower prices ------
    "decl_orders": f"""
        SELECT {_keyed("o_orderkey", "1")}, o_orderkey, o_custkey, o_orderdate FROM {{order_entities}}
        UNION ALL
        SELECT {_keyed("o_orderkey", "2")}, o_orderkey, o_custkey, o_orderdate FROM {{order_entities}}
        WHERE o_orderkey % 5 = 0""",
    "decl_items": f"""
        SELECT {_D}, inv AS cmrc_invc_nbr, gagi AS gagi_nbr, itm AS gds_itm_nbr, o_orderkey, partkey,
            suppkey, shipdate, qty, price - CASE WHEN o_orderkey % 5 = 0 AND req_vers_nbr = 1
                THEN 5 ELSE 0 END AS price
        FROM (SELECT l_orderkey, l_suppkey % 3 AS inv, l_linenumber AS gagi, l_partkey % 5 AS itm,
                MIN(l_partkey) AS partkey, MIN(l_suppkey) AS suppkey, MIN(l_extendedprice) AS price,
                MIN(l_quantity) AS qty, MIN(l_shipdate) AS shipdate
            FROM {{lineitem}} GROUP BY l_orderkey, l_suppkey % 3, l_linenumber, l_partkey % 5) i
        JOIN {{decl_orders}} o ON i.l_orderkey = o.o_orderkey""",
    "x_root": f"""
        SELECT {_D}, 'X' || CAST(o_custkey AS STRING) AS ext_cus_clnt_id,
            CASE WHEN o_orderkey % 23 = 0 THEN NULL
                WHEN o_custkey % 4 = 0 THEN ' S' || CAST(o_custkey AS STRING) || ' '
                ELSE ' ' || CAST(o_orderkey AS STRING) || ' ' END AS clnt_sply_req_id, o_orderdate AS audt_ins_tstmp
        FROM {{decl_orders}}""",
    "x_goods_source": f"""
        SELECT {_I}, 'C' || LPAD(CAST(suppkey % 24 AS STRING), 2, '0') AS cntry_orig_cde,
            CASE WHEN partkey % 3 = 0 THEN 'S' || CAST(partkey % 7 AS STRING) END AS ste_orig_cde
        FROM {{decl_items}}""",
    "x_item_detail": f"""
        SELECT {_I}, 'C' || LPAD(CAST(suppkey % 24 AS STRING), 2, '0') AS gds_cntry_orig_cde,
            CASE WHEN partkey % 3 = 0 THEN 'P' || CAST(partkey % 7 AS STRING) END AS gds_st_prov_cde
        FROM {{decl_items}}""",
    "x_item_description": f"""
        SELECT {_I}, CASE WHEN partkey % 7 = 0 THEN NULL
                ELSE ' ' || CAST(1000 + partkey % 40 AS STRING) || ' ' END AS class_cde,
            CASE WHEN partkey % 19 = 0 THEN NULL ELSE p_name || CASE WHEN partkey % 3 = 0 THEN ''
                ELSE ' of type ' || p_type END END AS itm_desc_txt, 1 AS itm_char_sqnbr
        FROM {{decl_items}} i JOIN {{part}} p ON i.partkey = p.p_partkey
        UNION ALL
        SELECT {_I}, ' 9999 ' AS class_cde, 'continued' AS itm_desc_txt, 2 AS itm_char_sqnbr
        FROM {{decl_items}} WHERE partkey % 4 = 0""",
    "x_package_count": f"""
        SELECT {_I}, CASE partkey % 2 WHEN 0 THEN 'KGM' ELSE 'PCE' END AS msr_unit_tcde, qty AS unit_cnt,
            'CT' AS pkg_un_tcde, partkey % 9 AS pkg_qty
        FROM {{decl_items}}""",
    "x_price": f"""
        SELECT {_I}, CASE WHEN partkey % 13 = 0 THEN NULL ELSE '66 ' END AS price_tcde,
            price + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS price_val,
            CASE o_orderkey % 2 WHEN 0 THEN 'CAD' ELSE 'USD' END AS price_crncy_cde
        FROM {{decl_items}} WHERE o_orderkey % 7 <> 1
        UNION ALL
        SELECT {_I}, '65' AS price_tcde, price / qty AS price_val,
            CASE o_orderkey % 2 WHEN 0 THEN 'CAD' ELSE 'USD' END AS price_crncy_cde
        FROM {{decl_items}} WHERE partkey % 13 <> 0 AND o_orderkey % 7 <> 1""",
    "x_package_qty": f"""
        SELECT {_G}, 'BX' AS un_pkg_tcde, SUM(qty) AS qty FROM {{decl_items}} GROUP BY {_G}""",
    "x_invoice": f"""
        SELECT {_V}, COUNT(*) AS cmrc_invc_qty, 'PCE' AS invc_qty_uom_cde, SUM(qty) AS cmrc_invc_wt_vol,
            'KGM' AS invc_wt_uom_cde, CAST(SUM(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS invc_tamt,
            'CAD' AS tamt_curcy_cde
        FROM {{decl_items}} GROUP BY {_V}""",
    "x_invoice_country": f"""
        SELECT {_V}, CASE WHEN MIN(o_orderkey) % 6 = 0 THEN NULL ELSE 'C' ||
                LPAD(CAST(MIN(suppkey) % 24 AS STRING), 2, '0') END AS invc_cntry_cde,
            CASE WHEN MIN(o_orderkey) % 4 = 0 THEN 'ON' END AS invc_st_cde,
            MIN(CAST(shipdate AS DATE)) AS dprt_dt
        FROM {{decl_items}} GROUP BY {_V}""",
    "x_shipment": f"""
        SELECT {_D}, SUM(qty) AS net_wt, 'KGM' AS net_wt_uom_cde, SUM(qty) + 10 AS gro_wt,
            'KGM' AS gro_wt_uom_cde, CAST(SUM(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS ttl_trans_val
        FROM {{decl_items}} GROUP BY {_D}""",
    "x_party": f"""
        SELECT {_D}, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'IM ' WHEN 'BUILDING' THEN 'IP'
                WHEN 'FURNITURE' THEN 'BR' WHEN 'HOUSEHOLD' THEN 'CB ' ELSE 'XX' END AS pty_tcde,
            'P' || CAST(c_custkey AS STRING) AS pty_id, c_name AS rltd_pty_nm_ln1,
            CAST(NULL AS STRING) AS rltd_pty_nm_ln2,
            CASE WHEN c_custkey % 3 = 0 THEN 'INC' END AS rltd_pty_nm_ln3,
            CAST(c_custkey % 100 AS STRING) || ' Main St' AS addr_ln1, CAST(NULL AS STRING) AS addr_ln2,
            CASE WHEN c_custkey % 2 = 0 THEN 'Unit ' || CAST(c_custkey % 10 AS STRING) END AS addr_ln3,
            'City ' || CAST(c_nationkey AS STRING) AS cty_nm,
            'K' || CAST(c_custkey % 10 AS STRING) || 'A' AS pstl_zip_cde,
            CASE WHEN c_custkey % 4 <> 0 THEN 'ON' END AS prov_st_cde,
            'C' || LPAD(CAST(c_nationkey AS STRING), 2, '0') AS cntry_cde
        FROM {{decl_orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
        UNION ALL
        SELECT {_D}, CASE s_suppkey % 2 WHEN 0 THEN 'VN' ELSE 'VD' END AS pty_tcde,
            'S' || CAST(s_suppkey AS STRING) AS pty_id, s_name AS rltd_pty_nm_ln1,
            CASE WHEN s_suppkey % 5 = 0 THEN ' LTD' END AS rltd_pty_nm_ln2,
            CAST(NULL AS STRING) AS rltd_pty_nm_ln3, 'Dock ' || CAST(s_suppkey % 9 AS STRING) AS addr_ln1,
            CAST(NULL AS STRING) AS addr_ln2, CAST(NULL AS STRING) AS addr_ln3,
            'Port ' || CAST(s_nationkey AS STRING) AS cty_nm, CAST(NULL AS STRING) AS pstl_zip_cde,
            CAST(NULL AS STRING) AS prov_st_cde,
            'C' || LPAD(CAST(s_nationkey AS STRING), 2, '0') AS cntry_cde
        FROM (SELECT DISTINCT {_D}, suppkey FROM {{decl_items}} WHERE o_orderkey % 7 <> 2) d
        JOIN {{supplier}} s ON d.suppkey = s.s_suppkey""",
    # -- case files ---------------------------------------------------------------------------
    "accounting": """
        SELECT CASE WHEN l_orderkey % 499 = 0 THEN NULL
                ELSE bn_9 || CASE l_orderkey % 2 WHEN 0 THEN 'RM0001' ELSE 'RM0002' END END AS importer_id,
            importer_name, l_extendedprice AS value_currency_conversion,
            vendor_cntry_cde AS country_of_export
        FROM {lines}""",
    "exports": """
        SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id END AS trade_document_id,
            CAST(100000000 + user_id AS STRING) || 'RM0001' AS exporter_bn15,
            value AS total_commodity_value, 'R' || CAST(event_id AS STRING) AS proof_of_report_number,
            event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || props END AS cargo_description
        FROM {events}""",
    "one_to_one_list": """
        SELECT DISTINCT 100000000 + e AS importer FROM {order_entities} WHERE e % 6 = 0""",
    "pre_dormancy": """
        SELECT CAST(100000000 + e AS STRING) || 'RM0001' AS importer_id,
            CASE WHEN COUNT(*) % 4 = 0 THEN 'Above 75th percentile' ELSE 'Below 75th percentile' END
                AS percentile_range
        FROM {order_entities} GROUP BY e""",
    "pre_first_txn": """
        SELECT CAST(100000000 + e AS STRING) || 'RM0001' AS importer_id,
            CASE WHEN SUM(o_custkey) % 3 = 0 THEN 'Above 75th percentile' ELSE 'Below 75th percentile' END
                AS percentile_range
        FROM {order_entities} GROUP BY e""",
    "pre_rounded": """
        SELECT CAST(100000000 + e AS STRING) || 'RM0001' AS importer_id,
            COUNT(*) % 4 AS num_rounded_transactions
        FROM {order_entities} WHERE e % 9 <> 0 GROUP BY e""",
    "pre_sections": """
        SELECT CAST(100000000 + e AS STRING) || 'RM0001' AS importer_id,
            COUNT(DISTINCT o_orderpriority) % 4 + CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END AS num_sections
        FROM {order_entities} WHERE e % 7 <> 0 GROUP BY e""",
}

# Fact tables and the key their rows are spread on when the file has too few splits.
SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}
# Tables that many others derive from: written once per query, like the stored table they stand for.
STAGED = {"decl_items"}

# A table dealt by the key on which it is first grouped and then joined: one shuffle serves both.
DEALT = {"decl_items": ("lineitem", ("l_orderkey",))} | {
    name: ("decl_items", tuple(_D.split(", "))) for name in ("x_package_qty", "x_invoice", "x_invoice_country")
}

_REFERENCE = re.compile(r"\{(\w+)\}")

EXTRACT_NAMES = tuple(name[2:] for name in DERIVED if name.startswith("x_"))


def needs(sql: str) -> list[str]:
    """Tables a text refers to, in order of appearance."""
    return list(dict.fromkeys(_REFERENCE.findall(sql)))


class Star:
    """The derived tables of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}
        self._splits = 0
        size_tasks(spark, 0)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = scan_spread(self.spark, f"{self.folder}/{name}.parquet", SPREAD_KEYS.get(name))
            if name in SPREAD_KEYS:
                self._splits += table.rdd.getNumPartitions()
                size_tasks(self.spark, self._splits)
            return table
        sql = DERIVED[name]
        inputs = {t: self[t] for t in needs(sql)}
        if name in DEALT:
            table, keys = DEALT[name]
            inputs[table] = inputs[table].repartition(*keys)
        table = self.spark.sql(sql, **inputs)
        return materialise(table, "zstd") if name in STAGED else table

    @cached_property
    def fx(self) -> DataFrame:
        return reference.fx_wide_to_long(self["fx_wide"], "fx_day", "decimal(12,8)")

    @cached_property
    def sections(self) -> DataFrame:
        return reference.hs_section_map(self["section_text"])

    @cached_property
    def basel(self) -> DataFrame:
        return reference.basel_index(self["basel_raw"])

    @cached_property
    def countries(self) -> DataFrame:
        return reference.country_codes(
            self["country_raw"],
            {
                "name": "country_name",
                "code": "country_code",
                "region": "region_world",
                "sub_region": "sub_region",
            },
        )

    @cached_property
    def party_codes(self) -> DataFrame:
        return reference.party_type_codes(self["party_codes_raw"])

    @property
    def extracts(self) -> dict[str, DataFrame]:
        return {name: self[f"x_{name}"] for name in EXTRACT_NAMES}
