import pytest
from pyspark.sql import functions as F

from cargoscope.operators import cases
from cargoscope.operators import release as rel
from cargoscope.sources import readers, schemas, sinks


def test_names_and_addresses(rows):
    parts = [*rel.NAME_LINES, *rel.ADDRESS_LINES]
    df = rows(", ".join(f"{c} string" for c in parts), ("ACME", None, "INC", "1 Main", "Unit 2", None))
    got = rel.concat_name_address(df).first()
    assert (got.rltd_pty_nm, got.addr) == ("ACME INC", "1 MainUnit 2 ")


def test_party_code_without_description_becomes_null(rows):
    party = rows("pty_tcde string, x int", (" IM ", 1), ("ZZ", 2), (None, 3))
    codes = rows("pty_tcde string, description string", ("IM", "IMPORTER"))
    got = {r.x: r.pty_tcde for r in rel.party_description_join(party, codes).collect()}
    assert got == {1: "IMPORTER", 2: None, 3: None}


def test_price_pivot_keeps_untyped_rows(rows):
    prices = rows("k string, price_tcde string, price_val double", ("a", "Total", 10.0), ("a", "PPU", 2.0), ("b", None, 5.0))
    got = {r.k: (r.invoice_total, r.invoice_ppu) for r in rel.pivot_price_type(prices, ["k"]).collect()}
    assert got == {"a": (10.0, 2.0), "b": (None, None)}


def test_projection_tolerates_missing_columns(rows):
    df = rows("a int, b int", (1, 2))
    assert rel.project(df, ["a", "zz"], ["b", "yy"]).columns == ["a", "b"]


def test_entity_list(rows):
    listed = rows("bn string", ("1",), ("1",), (" 2 ",), ("n/a",), (None,), ("9",))
    assert sorted(r[0] for r in readers.entity_ids(listed, "bn", [9]).collect()) == [1, 2]


def test_left_join_all_prefixes_shared_columns(rows):
    frames = {
        "one": rows("k int, p string, a int", (1, "x", 5), (2, "y", 6)),
        "two": rows("k int, p string", (1, "z")),
    }
    out = readers.left_join_all(frames, "k")
    assert out.columns == ["k", "one_p", "a", "two_p"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 5, "z"), (2, "y", 6, None)]


def test_exclusion_drops_null_ids(rows):
    df = rows("i string", ("123RM",), ("999RM",), (None,))
    assert [r.i for r in readers.exclude_containing(df, "i", "999").collect()] == ["123RM"]


def test_miscalculation_needs_all_three_numbers(rows):
    df = rows(
        "ax_clnt_nbr long, invoice_ppu double, unit_cnt double, invoice_total double",
        (1, 2.0, 3.0, 6.0),
        (2, 2.0, 3.0, 7.0),
        (3, None, 3.0, 7.0),
        (4, 0.1, 3.0, 0.30000000000000004),
    )
    assert [r.bn for r in cases.price_miscalculation(df).collect()] == ["2"]


@pytest.mark.parametrize("strict, expected", [(False, ["1", "2"]), (True, ["2"])])
def test_price_change(rows, strict, expected):
    schema = (
        "ax_clnt_nbr long, class_cde string, msr_unit_tcde string, audt_ins_tstmp string, clnt_sply_req_id string, "
        "cmrc_invc_nbr int, gagi_nbr int, gds_itm_nbr int, invoice_ppu double"
    )
    df = rows(
        schema,
        (1, "c", "KGM", "2025-01-01 01:00:00", "a", 1, 1, 1, 5.0),
        (1, "c", "KGM", "2025-01-02 01:00:00", "b", 1, 1, 1, 5.0),
        (2, "c", "KGM", "2025-01-01 01:00:00", "c", 1, 1, 1, 5.0),
        (2, "c", "KGM", "2025-01-01 02:00:00", "d", 1, 1, 1, 6.0),
        (3, "c", "KGM", "2025-01-01 01:00:00", "e", 1, 1, 1, 5.0),
        (3, "c", "PCE", "2025-01-02 01:00:00", "f", 1, 1, 1, 7.0),
        (3, "c", "KGM", "2025-01-03 01:00:00", "g", 1, 1, 1, None),
        (3, "c", "KGM", "2025-01-04 01:00:00", "h", 1, 1, 1, 8.0),
    ).withColumn("audt_ins_tstmp", F.col("audt_ins_tstmp").cast("timestamp"))
    assert sorted(r.bn for r in cases.price_change(df, strict).collect()) == expected


def test_text_statistics(rows):
    df = rows("t string", ("parts, of car",), ("",), (None,), ("shoes",), ("a b c",), ("fourteen chars",))
    got = {r.t: (r.tokens, r.chars, r.vague_description) for r in cases.vague_description(df, "t").collect()}
    assert got == {
        "parts, of car": (4, 13, False),
        "": (0, 0, True),
        None: (0, 0, True),
        "shoes": (1, 5, True),
        "a b c": (3, 5, False),
        "fourteen chars": (2, 14, False),
    }


def test_natural_right_join_matches_nulls(rows):
    left = rows("k string, f int", ("a", 1), (None, 2), ("zz", 3))
    right = rows("k string, x int", ("a", 10), (None, 20), ("b", 30))
    got = sorted(tuple(r) for r in cases.natural_right_join(left, right).select("x", "f").collect())
    assert got == [(10, 1), (20, 2), (30, None)]


def test_case_total_counts_nulls_as_false(rows):
    names = cases.CASE_INDICATORS
    df = rows(", ".join(f"{c} boolean" for c in names), tuple([True, None, False] + [None] * 10))
    got = cases.case_indicator_matrix(df).first()
    assert got.total_indicators == 1
    assert got.proportion_of_indicators == pytest.approx(1 / 13)


def test_csv_round_trip_with_null_text(spark, rows, tmp_path):
    path = str(tmp_path / "a.csv")
    source = rows("importer_id string, importer_name string, value_currency_conversion string, country_of_export string",
                  ("1", 'say "hi", you', "5.5", "null"), ("null", "x", "null", "CA"))
    sinks.write_csv(source, path)
    got = sorted((tuple(r) for r in readers.scan_csv(spark, path, schemas.ACCOUNTING).collect()), key=str)
    assert got == [("1", 'say "hi", you', 5.5, None), (None, "x", None, "CA")]


def test_stage_table_is_reused_until_rebuild(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    root = str(tmp_path)
    assert sinks.stage_table(spark, root, "t", build).count() == 1
    assert sinks.stage_table(spark, root, "t", build).count() == 1
    assert sinks.stage_table(spark, root, "t", build, rebuild={"other"}).count() == 1
    assert sinks.stage_table(spark, root, "t", build, rebuild={"t"}).count() == 2
    assert len(calls) == 2


def test_stage_follows_its_inputs_and_settings(spark, tmp_path):
    root, source = str(tmp_path / "stages"), str(tmp_path / "in")
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    def staged(settings=0.5):
        return sinks.stage_table(spark, root, "t", build, inputs=[source], settings=settings)

    spark.range(3).write.parquet(source)
    first = staged()
    assert (first.count(), staged().count(), len(calls)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(source)
    assert (staged().count(), len(calls)) == (5, 2)
    # The earlier stage is still there for whoever reads it.
    assert first.count() == 3
    assert (staged(0.7).count(), len(calls)) == (5, 3)
    assert sinks.sweep_stages(spark, root, "t") == 2
    assert (staged(0.7).count(), len(calls)) == (5, 3)
    assert [spark.read.parquet(f"{root}/t/{p.name}").count() for p in (tmp_path / "stages/t").iterdir()].count(5) == 1
    assert sinks.sweep_stages(spark, root, "t") == 0


def test_unfinished_stage_is_built_anew(spark, tmp_path):
    root = str(tmp_path)

    def broken():
        return spark.range(3).selectExpr("raise_error('lost') AS x")

    with pytest.raises(Exception, match="lost"):
        sinks.stage_table(spark, root, "t", broken)
    assert sinks.stage_table(spark, root, "t", lambda: spark.range(4)).count() == 4


def test_tokens_follow_the_word_rule(spark, rows):
    given = {
        "don't": 1, "o\u2019clock 3.5": 2, "1,234.56": 1, "a.b.c.d.e": 1, "U.S.A.": 2, "end. Next": 3, "3.a": 3,
        "a,b": 3, "x:y": 1, "1:2": 3, "rock 'n' roll": 5, "e\u0301'e": 1, "a''b": 4, "": 0, "  ": 0, "a-b": 3, "snake_case": 1,
    }
    df = rows("t string", *[(t,) for t in given])
    got = {r["t"]: r["tokens"] for r in cases.goods_text_stats(df, "t").collect()}
    assert got == given
