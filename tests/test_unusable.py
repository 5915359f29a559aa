"""Unusable entries: reasons, counts and the sample against a plain loop."""

import hashlib
from collections import defaultdict

import pytest

from cargoscope.operators.unusable import unusable_counts, unusable_reason, unusable_sample


def test_reasons(apply):
    given = [None, "", "  ", "NULL", " NULL ", "12x", "1,5", "nan", "1e3", " 7 ", "-2"]
    expected = ["null", "blank", "blank", "mark", "mark", "unreadable", "unreadable", "unreadable", None, None, None]
    assert apply(unusable_reason, "string", *given) == expected


def _plain_reason(v):
    if v is None:
        return "null"
    if not v.strip(" "):
        return "blank"
    if v.strip(" ") == "NULL":
        return "mark"
    return None if v.isdigit() else "unreadable"


@pytest.mark.parametrize("parts", [1, 6])
def test_sample_is_the_lowest_hashes_whatever_the_partitioning(spark, parts):
    kinds = [None, "", "NULL", "x1", "5"]
    # One reason holds most rows; keys repeat and may be null.
    data = [(None if i % 50 == 0 else f"k{i % 300}", i % 4, kinds[0] if i % 3 else kinds[i % 5]) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, line int, price string").repartition(parts)
    by_reason, by_key = defaultdict(list), defaultdict(int)
    for k, line, price in data:
        reason = _plain_reason(price)
        if reason:
            mark = hashlib.md5(f"{k or ''}|{line}".encode()).hexdigest()
            by_reason[reason].append((mark, (k is not None, k or ""), line, price))
            by_key[k, reason] += 1
    got = defaultdict(list)
    for r in unusable_sample(df, "price", ["k", "line"], 7).orderBy("sample_no").collect():
        assert r["n_records"] == len(by_reason[r["reason"]])
        got[r["reason"]].append((r["sample_no"], r["k"], r["line"], r["price"]))
    for reason, rows in by_reason.items():
        lowest = sorted(rows, key=lambda x: x[:3])[:7]
        assert got[reason] == [(i + 1, k if known else None, line, p) for i, (_, (known, k), line, p) in enumerate(lowest)]
    counts = {(r["k"], r["reason"]): r["n_records"] for r in unusable_counts(df, "price", ["k"]).collect()}
    assert counts == by_key


def test_ranking_limit_goes_ahead_of_the_shuffle(spark, rows):
    df = rows("k string, price string", ("a", None), ("b", ""))
    plan = unusable_sample(df, "price", ["k"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_table(spark, rows):
    assert unusable_sample(rows("k string, price string"), "price", ["k"]).count() == 0
