"""Running values over range partitions against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from cargoscope.operators.segments import Running, positions, running

KINDS = {
    "place": Running("row"),
    "total": Running("sum", "v"),
    "bits": Running("xor", "v"),
    "known": Running("last", "v"),
    "earlier": Running("before", "v"),
    "prev": Running("previous", "v"),
    "following": Running("next", "v"),
}


def loop(data):
    """(key, at, v) -> the running values, by a plain loop."""
    out, state = {}, {}
    for k, at, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n, total, bits, known, prev = state.get(k, (0, None, None, None, None))
        earlier = known
        if v is not None:
            total, bits, known = (total or 0) + v, (bits or 0) ^ v, v
        out[k, at] = (n, total, bits, known, earlier, prev)
        state[k] = (n + 1, total, bits, known, v)
    coming = {}
    for k, at, v in sorted(data, key=lambda r: -r[1]):
        coming[k] = v if v is not None else coming.get(k)
        out[k, at] += (coming[k],)
    return out


@pytest.mark.parametrize("hot", [0.0, 0.34, 1.0])
def test_running_values_match_a_loop(spark, hot):
    rng = random.Random(hot)
    data = [
        (7 if rng.random() < hot else rng.choice([None, 1, 2, 3]), i, rng.choice([None, rng.randrange(100)]))
        for i in range(600)
    ]
    df = spark.createDataFrame(data, "k int, at int, v long").repartition(5)
    got = running(df, ["k"], ["at"], KINDS).collect()
    expected = loop(data)
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[3:] == expected[r["k"], r["at"]]


def test_positions_without_keys_and_with_repeated_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), F.lit("x").alias("_key_like"))
    got = positions(df, [], ["a"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(500))
    assert [r["a"] for r in sorted(got, key=lambda r: r["n"])] == sorted(r["a"] for r in got)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k int, at int, v long")
    assert running(df, ["k"], ["at"], KINDS).count() == 0


def test_a_hot_key_is_cut_into_segments(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    plan = positions(df, ["k"], ["at"], "n")._jdf.queryExecution().toString()
    assert "_seg" in plan and "windowspecdefinition(k#" not in plan


def test_discarded_stages_leave_no_rows(spark):
    from cargoscope.session import discard, materialise

    stage = materialise(spark.range(1000))
    path = stage.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(path).count() == 1000
    discard(stage, spark.range(3))
    assert spark.read.parquet(path).count() == 0
    discard(stage)
