from datetime import date

import pytest
from pyspark.sql import functions as F

from cargoscope.config import RiskConfig
from cargoscope.operators import transactions as tx
from cargoscope.operators.fx import with_rate
from cargoscope.sources import reference

LINE = (
    "bn_9 string, clnt_sply_req_id string, actual_arrival_dttm string, "
    "price_val_total string, price_crncy_total string"
)


@pytest.fixture
def fx(rows):
    wide = rows(
        "date date, FXUSDCAD string, FXEURCAD string, FXNOTE string",
        (date(2025, 1, 6), "1.30", "", "x"),
        (date(2025, 1, 7), " 1.40 ", "1.50", "x"),
        (date(2025, 1, 10), None, "1.60", "x"),
    )
    return reference.fx_wide_to_long(wide, rate_type="decimal(12,8)")


def test_wide_rates_become_long(fx):
    got = {(r.fx_date.day, r.ccy): float(r.rate_to_cad) for r in fx.collect()}
    assert got == {
        (6, "USD"): 1.3,
        (7, "USD"): 1.4,
        (7, "EUR"): 1.5,
        (10, "EUR"): 1.6,
        (6, "CAD"): 1.0,
        (7, "CAD"): 1.0,
        (10, "CAD"): 1.0,
    }


def test_as_of_rate_against_brute_force(rows, fx):
    days = [date(2025, 1, d) for d in range(4, 14)] + [date(2026, 1, 1), None]
    pairs = [(c, d) for c in ("USD", "EUR", "CAD", "XXX", None) for d in days]
    got = with_rate(rows("ccy string, d date", *pairs), fx, "ccy", "d").collect()
    known = fx.collect()

    def expected(ccy, day):
        past = [r for r in known if r.ccy == ccy and day is not None and r.fx_date <= day]
        return max(past, key=lambda r: r.fx_date).rate_to_cad if past else None

    assert len(got) == len(pairs)
    for r in got:
        assert r.rate_to_cad == expected(r.ccy, r.d), r


@pytest.mark.parametrize("money", ["decimal", "double"])
def test_transaction_rules(rows, fx, money):
    lines = rows(
        LINE,
        # one currency plus a line without one: declared value is kept, its line has no rate
        ("100000001", "one", "2025-01-07 00:00:00", "10.00", "USD"),
        ("100000001", "one", "2025-01-07 00:00:00", "5.00", None),
        # two currencies, one without a price: mixed, no declared value
        ("100000001", "mixed", "2025-01-08 00:00:00", "10", "USD"),
        ("100000001", "mixed", "2025-01-08 00:00:00", "NULL", "CAD"),
        # no currency at all: neither declared nor mixed
        ("100000002", "none", "2025-01-08 00:00:00", "10", None),
        # unreadable day and a day before the first rate
        ("100000002", "undated", "NULL", "10", "CAD"),
        ("100000002", "early", "2024-12-31 00:00:00", "10", "CAD"),
        # a transaction filed under two importers goes to the higher number
        ("100000001", "shared", "2025-01-07 00:00:00", "1", "CAD"),
        ("100000003", "shared", "2025-01-09 00:00:00", "", "CAD"),
    )
    config = RiskConfig() if money == "decimal" else RiskConfig(price_type="double", rate_type="double")
    got = {r.clnt_sply_req_id: r for r in tx.txn_value(lines, fx, config).collect()}

    def values(name):
        r = got[name]
        return (
            r.txn_value_cad,
            r.txn_value_decl,
            r.decl_ccy,
            r.is_mixed_ccy_txn,
            r.lines_fx_missing,
            r.line_cnt,
        )

    assert values("one") == (14.0, 15.0, "USD", 0, 1, 2)
    assert values("mixed") == (14.0, None, None, 1, 0, 2)
    assert values("none") == (None, None, None, 0, 1, 1)
    assert values("undated") == (None, 10.0, "CAD", 0, 1, 1)
    assert values("early") == (None, 10.0, "CAD", 0, 1, 1)
    assert values("shared") == (1.0, 1.0, "CAD", 0, 0, 2)
    assert got["shared"].bn_9 == "100000003"
    assert got["shared"].arrival_date == date(2025, 1, 9)


def test_currency_profile_ignores_nulls(rows):
    lines = rows(LINE, ("1", "a", None, "1", "USD"), ("1", "a", None, "1", None), ("1", "b", None, "1", None))
    got = {r.clnt_sply_req_id: (r.ccy_cnt, r.decl_ccy) for r in tx.txn_currency_profile(lines).collect()}
    assert got == {"a": (1, "USD"), "b": (0, None)}


def test_section_lines(rows):
    text = rows(
        "value string",
        ("Section I: Chapters 1-3",),
        ("Section XV: Chapter 15",),
        ("  Section II:  Chapters 6 - 7 live plants",),
        ("Chapter 99",),
        ("",),
    )
    got = {(r.hs_section, r.hs_chap_nbr) for r in reference.hs_section_map(text).collect()}
    assert got == {("I", "01"), ("I", "02"), ("I", "03"), ("XV", "15"), ("II", "06"), ("II", "07")}


def test_party_codes_split_on_literal_delimiter(rows):
    raw = rows(
        "rltd_pty_tcde string, description string", ("A or B", "IMPORTER"), ("C", None), ("DorE", "VENDOR")
    )
    got = sorted((r.pty_tcde, r.description) for r in reference.party_type_codes(raw).collect())
    assert got == [("A", "IMPORTER"), ("B", "IMPORTER"), ("D", "VENDOR"), ("E", "VENDOR")]


def test_no_rates_at_all(rows, fx):
    got = with_rate(rows("ccy string, d date", ("CAD", date(2025, 1, 7))), fx.where(F.lit(False)), "ccy", "d")
    assert got.first().rate_to_cad is None
