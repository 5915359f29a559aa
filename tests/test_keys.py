import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cargoscope.functions import quantiles
from cargoscope.functions.quantiles import exact_quantile, named_quantiles
from cargoscope.operators import keys


def test_latest_version_keeps_ties_and_all_null_groups(rows):
    df = rows(
        "k string, v int, x int",
        ("a", 1, 1),
        ("a", 2, 2),
        ("a", 2, 3),
        ("a", None, 4),
        ("b", None, 5),
        (None, 1, 6),
        (None, 2, 7),
    )
    got = sorted(r.x for r in keys.latest_version(df, ["k"], "v").collect())
    assert got == [2, 3, 5, 7]


def test_padded_text_versions(rows):
    df = rows(
        "clnt_sply_req_id string, req_vers_nbr string", ("a", "009"), ("a", "010"), ("a", "NULL"), ("b", " 1")
    )
    got = sorted(tuple(r) for r in keys.dedup_latest_version(df).collect())
    assert got == [("a", "010"), ("b", " 1")]
    assert [tuple(r) for r in keys.version_magnitude(df).collect()] == [("a", 2)]


def _filled(values):
    down, last = [], None
    for v in values:
        last = v if v is not None else last
        down.append(last)
    up, following = [None] * len(values), None
    for i in range(len(values) - 1, -1, -1):
        following = values[i] if values[i] is not None else following
        up[i] = following
    return [d if d is not None else u for d, u in zip(down, up, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_across_blocks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for key in ["hot", None, "c"]:
        for i in range(400 if key == "hot" else 12):
            value = rng.choice([None, None, None, f"v{i}"])
            data.append((key, i // 7 if i > 20 else None, i, value, rng.choice([None, i])))
    df = spark.createDataFrame(data, "k string, b int, o int, s string, n int")
    got = keys.fill_down_up(df, ["k"], ["b"], ["o"], ["s", "n"]).collect()
    assert len(got) == len(data)
    for key in ["hot", None, "c"]:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        out = {r.o: (r.s, r.n) for r in got if r.k == key}
        expected = zip(_filled([d[3] for d in mine]), _filled([d[4] for d in mine]), strict=True)
        assert [out[d[2]] for d in mine] == list(expected)


def test_previous_value_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2025, 1, 1)
    data = [
        (rng.choice(["hot", "hot", "b", None]), start + timedelta(hours=7 * i), i, rng.choice([None, 1.0 * i]))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, i int, v double")
    got = keys.previous_value(df, ["k"], F.to_date("t"), ["t", "i"], "v", "p").collect()
    for key in ["hot", "b", None]:
        mine = sorted(d for d in data if d[0] == key) if key else [d for d in data if d[0] is None]
        mine.sort(key=lambda d: (d[1], d[2]))
        out = {r.i: r.p for r in got if r.k == key}
        assert [out[d[2]] for d in mine] == [None] + [d[3] for d in mine[:-1]]


def test_keep_first_is_ordered(rows):
    df = rows("k string, o int, x string", ("a", 2, "late"), ("a", 1, "early"), (None, 5, "only"))
    got = sorted(r.x for r in keys.keep_first(df, ["k"], [F.asc("o")]).collect())
    assert got == ["early", "only"]


@pytest.mark.parametrize("n", [1, 2, 5, 37, 30_000])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.99, 1.0])
def test_exact_quantile_equals_percentile(spark, n, q):
    # A third of the rows share one value, and the rest is skewed.
    value = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.exp(F.rand(7) * 9))
    df = spark.range(n).select(F.lit("g").alias("g"), value.alias("x"))
    got = exact_quantile(df, ["g"], "x", q, "q").first()["q"]
    assert got == pytest.approx(df.agg(F.expr(f"percentile(x, {q}D)")).first()[0], rel=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_quantile_of_long_lists_comes_from_running_counts(spark, monkeypatch, q):
    monkeypatch.setattr(quantiles, "LISTED", 5)
    df = spark.range(24_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 > 0, F.lit("b")).alias("g"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(F.exp(F.rand(3) * 9)).alias("x"),
    )
    got = {r["g"]: r["q"] for r in exact_quantile(df, ["g"], "x", q, "q").collect()}
    expected = {r[0]: r[1] for r in df.groupBy("g").agg(F.expr(f"percentile(x, {q}D)")).collect()}
    assert got == pytest.approx(expected, rel=1e-12) and len(got) == 3


def test_named_quantiles_skip_nulls(rows):
    df = rows("a double, b double", (1.0, 1.0), (2.0, None), (3.0, 5.0))
    cut = named_quantiles(df, {"m": (F.col("a"), 0.5), "n": (F.col("b"), 0.5), "o": (F.col("a"), 1.0)})
    assert tuple(cut.select("m", "n", "o").first()) == (2.0, 3.0, 3.0)


