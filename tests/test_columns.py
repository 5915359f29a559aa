import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cargoscope.functions import cleaning as cl
from cargoscope.functions.digits import expected_shares, integer_digit, significant_digits


def test_numbers_held_as_text(apply):
    got = apply(cl.clean_number, "string", " 12.50 ", "", "NULL", None, "abc", "nan", "-3")
    assert got == [12.5, None, None, None, None, None, -3.0]


def test_numbers_as_decimal_keep_cents(apply):
    got = apply(lambda c: cl.clean_number(c, "decimal(20,4)").cast("string"), "string", "0.10", "NULL")
    assert got == ["0.1000", None]


def test_arrival_day_ignores_markers_and_partial_dates(apply):
    got = apply(cl.arrival_day, "string", "2025-03-04 10:11:12", "NULL", "", None, "2025", "2025-13-01")
    assert got == [date(2025, 3, 4), None, None, None, None, None]


def test_numbered_names(apply):
    names = ["1234 CO", "  1234567 CANADA", "3M", "12A4", None]
    assert apply(cl.starts_with_digits, "string", *names) == [True, True, False, False, None]
    untrimmed = apply(lambda c: cl.starts_with_digits(c, skip_blanks=False), "string", *names)
    assert untrimmed == [True, False, False, False, None]


def test_round_values(apply):
    values = [1000.0, 1000.37, 0.0, 500.0, 999.6, None]
    loose = apply(lambda c: cl.as_flag(cl.is_round(c, 1000)), "double", *values)
    strict = apply(lambda c: cl.as_flag(cl.is_round(c, 1000, cents=True)), "double", *values)
    assert loose == [1, 1, 0, 0, 1, 0]
    assert strict == [1, 0, 0, 0, 0, 0]


def test_commodity_code_needs_every_part(rows):
    df = rows("a string, b string, c string", ("01", "02", "03"), ("01", None, "03"))
    got = [r[0] for r in df.select(cl.hs6(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["010203", None]


def test_business_number(apply):
    ids = ["123456789RM0001", "X123456789", "12345", None]
    assert apply(cl.business_number, "string", *ids) == ["123456789", None, None, None]
    anywhere = apply(lambda c: cl.business_number(c, anchored=False), "string", *ids)
    assert anywhere == ["123456789", "123456789", None, None]


def test_price_kind(apply):
    assert apply(cl.price_kind, "string", " 66 ", "65", "", None) == ["Total", "PPU", "PPU", None]


def test_signed_log(apply):
    got = apply(cl.signed_log1p, "double", 0.0, math.e - 1, 1 - math.e)
    assert got == pytest.approx([0.0, 1.0, -1.0])


def test_integer_digits(apply):
    values = [7.0, 9.99, 10.0, 0.5, 1234.5]
    assert apply(lambda c: integer_digit(c, 1), "double", *values) == [7, 9, 1, None, 1]
    assert apply(lambda c: integer_digit(c, 2), "double", *values) == [None, None, 0, None, 2]


def test_significant_digits(apply):
    values = [0.3, 0.05, 1000.0, -29.9, 0.0, None, 7.0]
    assert apply(lambda c: significant_digits(c, 1), "double", *values) == [3, 5, 1, 2, None, None, 7]
    assert apply(lambda c: significant_digits(c, 2), "double", *values) == [30, 50, 10, 29, None, None, 70]


@pytest.mark.parametrize("test", ["first", "second", "first_two"])
def test_expected_shares_add_up(test):
    shares = expected_shares(test)
    assert math.fsum(shares.values()) == pytest.approx(1.0)
    assert list(shares.values()) == sorted(shares.values(), reverse=True)
