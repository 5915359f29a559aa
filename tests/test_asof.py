"""The sorted as-of merge against a plain search."""

import bisect
import random
from datetime import date, datetime, timedelta

import pytest

from cargoscope.operators import fx as fxo
from cargoscope.operators.asof import asof_join


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_search_with_one_key_in_most_rows(spark, seed):
    rng = random.Random(seed)
    start = datetime(1970, 1, 1)
    at = lambda: rng.choice([None, start + timedelta(minutes=rng.randrange(30_000_000) // 7 * 7)])
    key = lambda: rng.choice(["USD", "USD", "USD", "EUR", None, "ZZZ"])
    left = [(key(), at(), i) for i in range(500)]
    right = [(rng.choice(["USD", "EUR", "GBP", None]), at(), rng.choice([None, float(i)])) for i in range(200)]
    right += [(k, t, 0.5) for k, t, _ in left[:60]] + [(k, t, 0.25) for k, t, _ in left[:30]]
    got = asof_join(
        spark.createDataFrame(left, "ccy string, t timestamp_ntz, _row int").repartition(4),
        spark.createDataFrame(right, "ccy string, at timestamp_ntz, rate double"),
        ["ccy"], "t", "at", ["rate"],
    )
    assert got.columns == ["ccy", "t", "_row", "rate"]
    best = {}
    for k, t, v in right:
        if k is not None and t is not None:
            old = best.setdefault(k, {}).get(t)
            best[k][t] = v if old is None else old if v is None else max(old, v)
    rows = {r["_row"]: r["rate"] for r in got.collect()}
    assert len(rows) == len(left)
    for k, t, i in left:
        times = sorted(best.get(k, {})) if t is not None else []
        n = bisect.bisect_right(times, t) if times else 0
        assert rows[i] == (best[k][times[n - 1]] if n else None)


def test_long_history_is_merged_and_gives_the_calendars_rates(spark, monkeypatch):
    rates = [("USD", date(1900, 1, 1) + timedelta(days=97 * i), float(i)) for i in range(200)]
    days = [(c, date(1899, 12, 1) + timedelta(days=61 * i)) for c in ("USD", "CAD", None) for i in range(400)]
    fx = spark.createDataFrame(rates, "ccy string, fx_date date, rate_to_cad double")
    asked = spark.createDataFrame([*days, ("USD", None)], "ccy string, d date")
    by_day = {tuple(r) for r in fxo.with_rate(asked, fx, "ccy", "d").collect()}
    monkeypatch.setattr(fxo, "BROADCAST_ROW_LIMIT", 1000)
    merged = fxo.with_rate(asked, fx, "ccy", "d")
    assert {tuple(r) for r in merged.collect()} == by_day
    assert "sequence" not in merged._jdf.queryExecution().toString()


def test_no_rates_and_no_rows(spark):
    fx = spark.createDataFrame([], "ccy string, at timestamp_ntz, rate double")
    left = spark.createDataFrame([("USD", datetime(2025, 1, 1))], "ccy string, t timestamp_ntz")
    assert asof_join(left, fx, ["ccy"], "t", "at", ["rate"]).collect()[0]["rate"] is None
    assert asof_join(left.where("false"), fx, ["ccy"], "t", "at", ["rate"]).count() == 0
