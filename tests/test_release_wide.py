"""The wide release record: shuffles of its rows, and records of several declarations."""

import re

import pytest
from pyspark.sql import functions as F

from cargoscope.catalog import cases as catalog_cases
from cargoscope.operators import keys
from cargoscope.operators import release as rel
from cargoscope.sources.schemas import DECLARATION_KEYS, EXTRACTS, ITEM_KEYS
from cargoscope.sources.starschema import Star

_TYPES = {"req_vers_nbr": "int", "price_val": "double", "unit_cnt": "double", "itm_char_sqnbr": "int"}


def _extracts(spark, **given) -> dict:
    """Every extract with the given rows, a dictionary each; what a row does not name is null."""
    out = {}
    for name, (keys, payload) in EXTRACTS.items():
        columns = list(dict.fromkeys([*keys, *payload]))
        schema = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in columns)
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in given.get(name, [])], schema)
    return out


@pytest.fixture
def codes(rows):
    return rows("pty_tcde string, description string", ("BR", "BROKER"), ("IM", "IMPORTER"))


def _declaration(number, version=1, **more):
    return dict(zip(DECLARATION_KEYS, (number, "1", "RM", "0001", "911", version), strict=True)) | more


def _item(number, version=1, item="1", **more):
    return _declaration(number, version) | dict(zip(ITEM_KEYS[6:], ("I", "G", item), strict=True)) | more


def test_rows_and_extracts_are_dealt_by_declaration_once(spark, codes):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = _extracts(spark)
        wide = rel.release_wide(x, codes, ["BROKER"], [*rel.RECORD_KEYS, "class_cde", "unit_cnt", "invc_tamt", *rel.PRICE_COLUMNS])
        party = rel.wide_parties(x["party"], codes, ["BROKER"])
        plan = "\n".join(df._jdf.queryExecution().executedPlan().toString() for df in (wide, party))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [re.sub(r"#\d+", "", k).split(", ")[:-1] for k in re.findall(r"Exchange hashpartitioning\((.*)\), ", plan)]
    # What is left by record are the records with several declarations.
    assert [k for k in dealt if k[:6] != [*DECLARATION_KEYS]] == [rel.RECORD_KEYS]


def test_a_record_takes_from_its_next_declaration_what_the_first_lacks(spark, codes):
    x = _extracts(
        spark,
        root=[_declaration(d, clnt_sply_req_id=" S ") for d in ("A", "B", "C")] + [_declaration("D")],
        goods_source=[_item(d, cntry_orig_cde=d) for d in ("A", "B", "C")],
        price=[
            _item("A", price_tcde="66", price_val=None, price_crncy_cde="CAD"),
            _item("B", price_tcde="66", price_val=7.0, price_crncy_cde="USD"),
            _item("C", price_tcde="66", price_val=9.0), _item("C", price_tcde="65", price_val=3.0),
        ],
        party=[
            _declaration("C", pty_tcde="BR", pty_id="b"), _declaration("B", pty_tcde="IM ", pty_id="i"),
            _declaration("D", pty_tcde="BR", pty_id="d"), _declaration(None, pty_tcde="BR", pty_id="n"),
        ],
        package_count=[_item("B", unit_cnt=5.0), _item("A", unit_cnt=2.0)],
    )
    wide = rel.release_wide(x, codes, ["BROKER", "IMPORTER"]).select(
        "clnt_sply_req_id", "drv_req_nbr", "cntry_orig_cde", "price_crncy_cde", "invoice_total", "invoice_ppu",
        "pty_id_broker", "pty_id_importer", "unit_cnt",
    )
    assert {tuple(r) for r in wide.collect()} == {
        ("S", "A", "A", "CAD", 7.0, 3.0, "b", "i", 2.0),
        # A root without goods gets nothing but its own columns.
        (None, "D", None, None, None, None, None, None, None),
    }


def test_the_newest_version_stands_and_submissions_are_filled(spark, codes):
    x = _extracts(
        spark,
        root=[
            _declaration("A", 1, clnt_sply_req_id="old"), _declaration("A", 2, clnt_sply_req_id="s"),
            _declaration("A", 2, ax_clnt_nbr="2"), _declaration("B", 1), _declaration(None, 1, clnt_sply_req_id="n"),
        ],
        goods_source=[
            _item("A", 1), _item("A", 2), _item("A", 2, ax_clnt_nbr="2"), _item("A", 2, "2", ax_clnt_nbr="2"),
            _item("A", 1, "3"), _item("B", 1),
        ],
    )
    wide = rel.release_wide(x, codes, ["BROKER", "IMPORTER"], ["clnt_sply_req_id", "drv_req_nbr", "req_vers_nbr", "ax_clnt_nbr", "gds_itm_nbr"])
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(
        [("s", "A", 2, "1", "1"), (None, "A", 2, "2", "2"), ("old", "A", 1, "1", "3"), (None, "B", 1, "1", "1"), ("n", None, 1, "1", None)],
        key=str,
    )


def test_a_long_list_of_declarations_still_filters_the_extracts(spark, codes, monkeypatch):
    monkeypatch.setattr(rel, "BROADCAST_ROW_LIMIT", 1)
    listed = [f"D{i}" for i in range(40)]
    x = _extracts(
        spark,
        root=[_declaration(d, clnt_sply_req_id=d) for d in listed] + [_declaration(None)],
        price=[_item(f"D{i}", price_tcde="66", price_val=1.0) for i in range(400)] + [_item(None)],
    )
    kept = [r.drv_req_nbr for r in rel.wanted_declarations(x)["price"].collect()]
    assert {*listed} <= {*kept} and len(kept) < 100
    # An extract with another type of key hashes otherwise: it goes on whole.
    other = x | {"price": x["price"].withColumn("req_vers_nbr", F.col("req_vers_nbr").cast("long"))}
    assert rel.wanted_declarations(other)["price"].count() == 401


def test_a_short_list_of_ids_goes_below_aggregates(spark, rows):
    lines = rows("ax_clnt_nbr long, n int", (1, 5), (2, 6), (None, 7), (1, 8))
    ids = rows("entity_id long", (1,), (3,), (None,))
    summed = lines.groupBy("ax_clnt_nbr").agg(F.sum("n").alias("n"))
    found = rel.in_list(summed, F.broadcast(ids), "ax_clnt_nbr")
    assert [tuple(r) for r in found.collect()] == [(1, 13)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Filter" not in plan.split("Aggregate")[0]
    assert rel.in_list(lines, rows("entity_id string", ("1",)), "ax_clnt_nbr").count() == 2


def test_invoice_extracts_meet_their_declaration_where_they_are_grouped(spark):
    star = Star(spark, "")
    columns = f"{', '.join(ITEM_KEYS)}, o_orderkey, partkey, suppkey, shipdate, qty, price".split(", ")
    star._built["decl_items"] = rows = spark.createDataFrame([], ", ".join(f"{c} {'date' if c == 'shipdate' else 'int'}" for c in columns))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rel._join_in_place(rows)
        for name in ("package_qty", "invoice", "invoice_country"):
            joined = rows.repartition(*DECLARATION_KEYS).join(star[f"x_{name}"], list(rel.INVOICE_KEYS))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_are_not_shuffled_again(spark, rows):
    df = rows("k string, t int, v int", *[("a", t, t * t) for t in range(50)], (None, 1, 7), ("b", 3, None), ("b", 4, 1))
    found = keys.previous_value(df, ["k"], F.lit(0), ["t"], "v", "prev")
    got = {(r.k, r.t): r.prev for r in found.collect()}
    assert got == {("a", t): (t - 1) ** 2 if t else None for t in range(50)} | {(None, 1): None, ("b", 3): None, ("b", 4): None}
    plan = found.select("v", "prev")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_seg#" not in plan


def test_a_key_bitmap_denies_no_listed_key(rows):
    listed = rows("k string, n int", *[(str(i), i) for i in range(300)], (None, 1), ("x", None))
    bitmap = keys.KeyBitmap.of(listed, ["k", "n"])
    assert bitmap.marked(listed, ["k", "n"], "in").where("in").count() == 302
    others = rows("k string, n int", *[(str(i), i + 1) for i in range(300)], (None, None))
    assert bitmap.marked(others, ["k", "n"], "in").where("in").count() < 60
    assert keys.KeyBitmap.of(listed.limit(0), ["k", "n"]).marked(others, ["k", "n"], "in").where("in").isEmpty()


def test_the_case_matrix_reads_written_lines(spark, rows, monkeypatch):
    lines = rows("importer_id string, n int", ("1", 1)).join(rows("importer_id string, m int", ("1", 2)), "importer_id")
    given = []
    monkeypatch.setattr(catalog_cases, "released", lambda s, *columns: lines)
    monkeypatch.setattr(catalog_cases, "precomputed", lambda s: lines)
    monkeypatch.setattr(catalog_cases, "case_matrix", lambda *frames: given.extend(frames))
    star = type("S", (dict,), {"basel": lines})(accounting=lines, exports=lines, one_to_one_list=lines)
    catalog_cases.matrix(star)
    accounting, release = given[0], given[2]
    for df in (accounting, release):
        assert [tuple(r) for r in df.collect()] == [("1", 1, 2)]
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
