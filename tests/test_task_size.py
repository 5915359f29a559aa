"""Shuffles of the assembly and of prices, and partitions that follow the input."""

import re
from datetime import date

from pyspark.sql import functions as F

from cargoscope.config import RiskConfig
from cargoscope.functions.cleaning import clean_number
from cargoscope.operators import entities as ent
from cargoscope.operators import release as rel
from cargoscope.operators.transactions import txn_value
from cargoscope.session import size_tasks
from cargoscope.sources.schemas import EXTRACTS, ITEM_KEYS


def test_partitions_follow_the_splits_and_come_back(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size_tasks(spark, 0)
    least = int(spark.conf.get(name))
    size_tasks(spark, 100)
    hundred = int(spark.conf.get(name))
    size_tasks(spark, 1000)
    assert int(spark.conf.get(name)) == 10 * hundred > least
    size_tasks(spark, 0)
    assert int(spark.conf.get(name)) == least


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def _extracts(spark) -> dict:
    return {
        n: spark.createDataFrame([], ", ".join(f"{c} string" for c in dict.fromkeys([*keys, *payload])))
        for n, (keys, payload) in EXTRACTS.items()
    }


def test_the_assembly_shuffles_every_extract_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(rel.release_assembly(_extracts(spark))) == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prices_are_shuffled_once_and_their_rows_stay(spark):
    assert _shuffles(rel.wide_prices(_extracts(spark)["price"])) == 1
    key = dict(zip(ITEM_KEYS, map(str, range(9)), strict=True))
    rows = [("66 ", None, "CAD"), ("66 ", 5.0, "CAD"), ("66", 7.0, "USD"), ("65", 3.0, "EUR"), ("65", 2.0, "GBP")]
    shape = ", ".join([*[f"{k} string" for k in ITEM_KEYS], "price_tcde string, price_val double, price_crncy_cde string"])
    price = spark.createDataFrame([(*key.values(), *r) for r in rows] + [(None, *list(key.values())[1:], *rows[3])], shape)
    got = [(r.price_crncy_cde, r.invoice_total, r.invoice_ppu) for r in rel.wide_prices(price).collect()]
    assert got == [("GBP", 7.0, 2.0)]


_LINE = (
    "bn_9 string, clnt_sply_req_id string, actual_arrival_dttm string, price_val_total string, price_crncy_total string, "
    "importer_name string, vendor_name string, vendor_cntry_cde string, hs_chap_nbr string, hs_hd_sfx string, hs_sbhd_sfx string"
)
_LINES = [
    ("1", "a", "2025-01-07 00:00:00", "2000", "USD", "1234 Inc", "V", "C01", "01", "02", "03"),
    ("1", "a", "2025-01-08 00:00:00", "100", "USD", "Other", "V", "C02", "01", "02", "04"),
    ("1", "b", "2025-01-09 00:00:00", None, None, None, " 9999 W", None, None, "02", "04"),
    (None, None, None, "3000", "CAD", None, None, "C01", "02", "02", "03"),
]


def _reference_tables(spark):
    # C01 and chapter 01 are listed twice: their lines count twice.
    sections = spark.createDataFrame([("01", "I"), ("01", "II"), ("02", "I")], "hs_chap_nbr string, hs_section string")
    return sections, spark.createDataFrame([("C01", 1), ("C01", 0)], "iso_code string, high_risk_ind int")


def test_line_profile_equals_one_aggregate_over_the_lines(spark):
    lines, (sections, basel) = spark.createDataFrame(_LINES, _LINE), _reference_tables(spark)
    priced = lines.withColumn("price_val", clean_number(F.col("price_val_total"), "decimal(20,4)"))
    config = RiskConfig(consolidator_min_names=2)
    plain = ent.basel_lookup(ent.section_lookup(priced, sections), basel).groupBy("bn_9").agg(
        *ent.line_diversity_aggregates(), *ent.line_share_aggregates(), ent.consolidator_mark(config).alias("is_consolidator")
    )
    got = ent.entity_line_profile(lines, sections, basel, config)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


def test_line_profile_turns_a_line_into_three_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ent, "materialise", lambda df: written.append(df) or df)
    ent.entity_line_profile(spark.createDataFrame(_LINES, _LINE), *_reference_tables(spark))
    # With the reference tables the lines are 4, 2, 1 and 2 rows.
    assert written[0].agg(F.sum("_n")).first()[0] == 3 * (4 + 2 + 1 + 2)


def test_lines_of_several_days_are_one_row_in_the_shuffles(spark):
    fx = spark.createDataFrame([("USD", date(2025, 1, 1), 1.4)], "ccy string, fx_date date, rate_to_cad double")
    plan = txn_value(spark.createDataFrame(_LINES, _LINE), fx)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("clnt_sply_req_id" in k for k in keys)
    assert not any("clnt_sply_req_id" in k and "arrival_date" in k for k in keys)
    got = {r.clnt_sply_req_id: (r.txn_value_decl, round(r.txn_value_cad or 0, 6), r.line_cnt, r.lines_fx_missing) for r in txn_value(spark.createDataFrame(_LINES, _LINE), fx).collect()}
    assert got == {"a": (2100.0, 2940.0, 2, 0), "b": (None, 0, 1, 1), None: (3000.0, 0, 1, 1)}
