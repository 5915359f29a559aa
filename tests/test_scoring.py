import itertools
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoscope.config import FLAG_LABELS, RiskConfig
from cargoscope.functions.digits import expected_shares
from cargoscope.operators import benford as ben
from cargoscope.operators import scoring
from cargoscope.operators.forest import isolation_forest, isolation_scores
from cargoscope.sources.sinks import report_columns


def test_deviation_counts_absent_digits(rows):
    txn = rows("bn_9 string, v double", *[("A", 1.5)] * 60, ("B", 0.5), ("A", None))
    got = ben.benford_mad(txn, "v", "first", 50, 0.015).collect()
    shares = expected_shares("first")
    expected = (1 - shares[1] + sum(p for d, p in shares.items() if d > 1)) / 9
    assert [(r.bn_9, r.n, r.flag) for r in got] == [("A", 60, 1)]
    assert got[0].mad == pytest.approx(expected)


def test_conforming_sample_passes_the_size_adjusted_threshold(spark):
    rng = np.random.default_rng(5)
    values = 10 ** rng.uniform(0, 6, 200)
    txn = spark.createDataFrame([("A", float(v)) for v in values], "bn_9 string, v double")
    literal = ben.benford_mad(txn, "v", "second", 50, 0.012).first()
    adjusted = ben.benford_mad(txn, "v", "second", 50, ben.size_adjusted_threshold("second")).first()
    assert adjusted.flag == 0 and literal.mad == adjusted.mad


@pytest.mark.parametrize("test", ["first", "first_two"])
def test_ks_statistic_against_brute_force(spark, test):
    rng = np.random.default_rng(11)
    data = [("A", float(v)) for v in 10 ** rng.uniform(-1, 3, 40)] + [("B", 5.0), ("B", 5.1), ("C", None)]
    got = {r.k: r for r in ben.ks_statistic(spark.createDataFrame(data, "k string, v double"), "k", "v", test).collect()}
    places = 0 if test == "first" else 1
    for key in ("A", "B"):
        digits = [int(f"{v:.9e}".replace(".", "")[: places + 1]) for k, v in data if k == key]
        shares, cum, worst = expected_shares(test), 0.0, 0.0
        for d, p in shares.items():
            cum += p
            worst = max(worst, abs(sum(x <= d for x in digits) / len(digits) - cum))
        assert got[key].n == len(digits)
        assert got[key].statistic == pytest.approx(worst * math.sqrt(len(digits)))
    assert "C" not in got


def test_ks_p_value_falls_as_the_statistic_grows(spark):
    data = [(f"k{i}", 1.0 if j < i else 10.0 ** (j / 50)) for i in (0, 10, 20, 50) for j in range(50)]
    df = spark.createDataFrame(data, "k string, v double")
    got = sorted(ben.benford_ks(df, "k", "v", "first").collect(), key=lambda r: r.statistic)
    assert [r.p_value for r in got] == sorted((r.p_value for r in got), reverse=True)
    assert got[0].p_value > 0.5 and got[-1].does_not_conform == 1


@pytest.mark.parametrize(("n", "shares"), [(1, [0.5, 0.5]), (6, [0.2, 0.5, 0.3]), (5, list(expected_shares("first").values()))])
def test_ks_p_value_equals_full_enumeration(n, shares):
    outcomes = {}
    for counts in itertools.product(range(n + 1), repeat=len(shares)):
        if sum(counts) == n:
            weight = math.factorial(n) * math.prod(p**c / math.factorial(c) for p, c in zip(shares, counts, strict=True))
            gaps = np.abs(np.cumsum(counts) / n - np.cumsum(shares))
            outcomes[counts] = (gaps.max() * math.sqrt(n), weight)
    for reached in sorted({round(x, 12) for x, _ in outcomes.values()})[:40]:
        exact = sum(w for x, w in outcomes.values() if x >= reached - 1e-9)
        assert ben.ks_p_value(n, reached, shares) == pytest.approx(exact, abs=1e-10)


def test_ks_p_value_of_large_samples_nears_the_limit():
    fine = [1 / 400] * 400
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * 1.2**2) for j in range(1, 20))
    # A grid sees less of the gap than the continuous limit does.
    assert 0.8 * limit < ben.ks_p_value(20_000, 1.2, fine) < limit
    assert ben.ks_p_value(10**6, 0.8, list(expected_shares("first_two").values())) < 1
    assert ben.ks_p_value(50, 4.0, fine) == 0.0 and ben.ks_p_value(50, 0.0, fine) == 1.0


ENTITY = (
    "bn_9 string, is_consolidator int, txn_cnt long, importer_numbered_share double, vendor_numbered_share double, "
    "round_1000_share double, round_100_share double, any_high_risk int, high_risk_share double, max_gap_days int, "
    "first_txn_value_cad double, distinct_sections long, i4_benford1 int, i5_benford2 int"
)


def test_typology_rules(rows):
    entities = rows(
        ENTITY,
        ("A", 0, 5, 0.5, 0.0, 0.05, 0.1, 1, 0.2, 100, 50.0, 3, 1, None),
        ("B", 1, 5, 0.0, 0.4, 0.90, 0.9, 0, 0.0, 10, 10.0, 9, None, 1),
        ("C", 0, 1, 0.0, 0.0, 0.10, 0.1, 0, 0.0, 900, None, 2, 0, 0),
        ("D", 0, 2, None, None, None, None, None, None, None, None, None, None, None),
    )
    got = {r.bn_9: r for r in scoring.typology_flags(entities, RiskConfig()).collect()}
    flags = {k: [got[k][c] for c in FLAG_LABELS] for k in got}
    # order: I3 I4 I5 I7 I8 I9 I10 I11
    assert flags["A"] == [1, 1, 0, 1, 1, 0, 1, 1]
    assert flags["B"] == [0, 0, 1, 0, 0, 0, 0, 0]  # a consolidator: no I9, no I11
    assert flags["C"] == [0, 0, 0, 0, 0, 1, 0, 0]  # one transaction: no I8; share at the 10 % floor
    assert flags["D"] == [0] * 8
    assert got["A"].flag_count == 6 and got["A"].risk_score == 6.0


def test_flag_combinations_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [tuple(int(x) for x in rng.integers(0, 2, 8)) for _ in range(40)]
    df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in FLAG_LABELS))
    got = {r.flags: (r.k, r.n_importers) for r in scoring.flag_combinations(df).collect()}
    names = list(FLAG_LABELS)
    expected = {
        ", ".join(names[i] for i in chosen): (k, sum(all(d[i] for i in chosen) for d in data))
        for k in range(2, 9)
        for chosen in combinations(range(8), k)
    }
    assert len(got) == 247 and got == expected


def test_report_marks_nulls_and_warns(rows):
    df = rows("a int, b double", (1, None))
    with pytest.warns(UserWarning, match="zzz"):
        out = report_columns(df, ["b", "a", "zzz"], ["b"])
    assert out.columns == ["b", "a"] and tuple(out.first()) == (-1.0, 1)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    data = [(f"e{i}", *map(float, rng.normal(5, 1, 3)), True) for i in range(600)]
    data += [("planted", 400.0, -300.0, 900.0, True), ("unfit", 5.0, 5.0, 5.0, False)]
    return spark.createDataFrame(data, "id string, a double, b double, c double, fit boolean")


def test_forest_finds_the_planted_outlier(points):
    scored = isolation_forest(points, "id", ["a", "b", "c"], F.col("fit"), n_trees=60)
    got = {r.id: (r.ml_score, r.ml_outlier) for r in scored.collect()}
    assert all(0 < s <= 1 for s, _ in got.values())
    assert max(got, key=lambda k: got[k][0]) == "planted"
    assert got["planted"][1] == 1 and got["unfit"][1] == 0
    assert sum(o for _, o in got.values()) <= 8


def test_forest_does_not_depend_on_partitioning(points):
    def scores(df):
        out = isolation_scores(df, "id", ["a", "b", "c"], F.col("fit"), n_trees=20)
        return {r.id: round(r.ml_score, 9) for r in out.collect()}

    assert scores(points.repartition(3)) == scores(points.orderBy("a").coalesce(1))
