"""op13: targets, thresholds and whole mixes against a plain loop, and edge cases."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cargoscope.llm import op13_mixing as op13
from tests.oracle import connect, spark_rows, sql_rows

SHAPE = "doc_id long, text string, source string"


def plain(data, weights=op13.WEIGHTS, most=op13.MOST):
    """Sorted (doc_id, size, source_size, target, taken) by the definition."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(list)
    for doc_id, text, source in data:
        by_source[source].append((doc_id, text))
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    s = {n: sum(size(t) for _, t in by_source[n]) for n in names}
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    held, total = set(), sum(s.values())
    while True:
        free = [n for n in names if n not in held]
        rest = total - sum(most * s[n] for n in held)
        share = {n: Fraction(w[n] * rest, sum(w[m] for m in free)) for n in free}
        over = {n for n in free if share[n] >= most * s[n]}
        if not over:
            break
        held |= over
    out = []
    for n in names:
        target = float(most * s[n]) if n in held else float(share[n])
        whole = math.floor(target / s[n]) if s[n] else 0
        rest = target - whole * s[n]
        key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
        below = 0
        for doc_id, text in sorted(by_source[n], key=key):
            k = size(text)
            more = rest > 0 and (below + k <= rest or (below <= rest and below + k - rest < rest - below))
            below += k
            out.append((doc_id, k, s[n], target, k * (whole + more)))
    return sorted(out, key=repr)


def rows_of(df):
    got = df.select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_matches_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "z\U0001f600"][: 2 + seed]
    data = [
        (
            rng.choice([None, i]),
            rng.choice([None, "", " \n", "w " * rng.randrange(1, 40), "ä\tb"]),
            sources[0] if rng.random() < 0.5 else rng.choice(sources),
        )
        for i in range(300)
    ]
    data += [(5, "the same row", sources[1])] * 60
    df = spark.createDataFrame(data, SHAPE).repartition(4)
    got = rows_of(op13.mix(df))
    assert got == plain(data)


def test_caps_spread_the_excess(spark):
    data = [(i, "w " * 10, s) for i, s in enumerate(["a"] + ["b"] * 5 + ["c"] * 30)]
    got = {r["target"] for r in op13.mix(spark.createDataFrame(data, SHAPE)).collect()}
    assert got == {30.0, 150.0, 180.0}  # a and b are held at three times 10 and 50; c takes the rest
    assert rows_of(op13.mix(spark.createDataFrame(data, SHAPE))) == plain(data)


@pytest.mark.parametrize("data", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "a b", "a")]])
def test_small_tables(spark, data):
    assert rows_of(op13.mix(spark.createDataFrame(data, SHAPE))) == plain(data)


def test_repeated_rows_meet_the_target(spark):
    data = [(1, "a b c d", "a")] * 300 + [(2, "a b c d", "b")] * 100
    got = op13.mix(spark.createDataFrame(data, SHAPE)).groupBy("doc_id").agg(F.sum("taken"), F.max("target"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {1: (1144, 1600 * 5 / 7), 2: (456, 1600 * 2 / 7)}


def test_very_long_text(spark):
    got = op13.mix(spark.createDataFrame([(1, "wörd \n" * 400_000, "a"), (2, " " * 500_000, "a")], SHAPE))
    assert {r["doc_id"]: r["size"] for r in got.collect()} == {1: 400_000, 2: 0}


def test_smaller_mix_is_nested_and_rows_come_whole(spark):
    names = "doc_id text source size mark upto full row copies _s _e _i _null _key _seg target".split()
    data = [(i, f"a{i} b c", "xy"[i % 3 == 0], *[f"v{i}"] * (len(names) - 3)) for i in range(90)]
    df = spark.createDataFrame(data, ["doc_id", "text", "source", *names[3:]])
    full = op13.mixed_rows(op13.mix(df, full=True))
    assert full.columns == names
    taken = {r["doc_id"]: r["copies"] for r in op13.mix(df).collect()}
    back = full.collect()
    assert len(back) == sum(taken.values())
    assert all(set(r[3:]) == {f"v{r['doc_id']}"} for r in back)
    low = {r["doc_id"]: r["copies"] for r in op13.mix(df, weights=(1, 1)).where("source_size > 0").collect()}
    y = [i for i in taken if i % 3 == 0]
    grown = sorted((low, taken), key=lambda m: sum(m[i] for i in y))
    assert all(grown[0][i] <= grown[1][i] for i in y)


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    df = op13.mix(spark.read.parquet(f"{folder}/documents.parquet"))
    assert spark_rows(df) == sql_rows(connect(folder), op13.mixing_sql("documents"))


def test_native_plan(spark):
    df = op13.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
