import math
import statistics
from datetime import date, timedelta

import pytest

from cargoscope.config import AnomalyConfig
from cargoscope.operators import entities as ent
from cargoscope.operators import history as his

TXN = "clnt_sply_req_id string, bn_9 string, arrival_date date, txn_value_cad double"
DAY = date(2025, 1, 1)


@pytest.fixture
def txn(rows):
    return rows(
        TXN,
        ("a1", "A", DAY, 10.0),
        ("a2", "A", DAY, 20.0),
        ("a3", "A", DAY + timedelta(400), 5000.0),
        ("a4", "A", None, 1.0),
        ("a5", "A", DAY + timedelta(410), 0.0),
        ("b1", "B", DAY, 7.0),
        ("c1", "C", DAY, 3.0),
        ("c2", "C", DAY, 3.0),
        ("n1", None, DAY, 3.0),
        ("n2", None, DAY + timedelta(5), 9.0),
    )


def test_gap_and_first_value(txn):
    got = {r.bn_9: (r.max_gap_days, r.first_txn_value_cad) for r in ent.entity_txn_indicators(txn).collect()}
    assert got == {"A": (400, 10.0), "B": (None, 7.0), "C": (0, 3.0), None: (5, 3.0)}


def test_gap_per_transaction(txn):
    got = {r.clnt_sply_req_id: r.gap_days for r in ent.gap_days(txn).collect()}
    assert got == {
        "a1": None, "a2": 0, "a3": 400, "a5": 10, "b1": None, "c1": None, "c2": 0, "n1": None, "n2": 5,
    }


def test_value_scores(txn):
    got = {r.clnt_sply_req_id: r for r in his.txn_value_zscore(txn).collect()}
    logs = [math.log(v) for v in (10, 20, 5000)]
    mean, sd = statistics.mean(logs), statistics.stdev(logs)
    assert got["a3"].value_z == pytest.approx((logs[2] - mean) / sd)
    assert (got["a3"].days_since_prev, got["a3"].is_reactivation, got["a3"].entity_txn_cnt) == (400, 1, 3)
    assert got["b1"].value_z is None  # a single value has no spread
    assert got["c1"].value_z is None  # equal values have no spread
    assert not {"a4", "a5"} & set(got)  # undated or not positive


def test_robust_score(txn):
    got = {r.clnt_sply_req_id: r for r in his.value_z_robust(txn).collect()}
    logs = [math.log(v) for v in (10, 20, 5000)]
    mad = statistics.median(abs(x - logs[1]) for x in logs)
    assert got["a3"].robust_z == pytest.approx((logs[2] - logs[1]) / mad)
    assert got["c1"].robust_z is None


LINES = "bn_9 string, actual_arrival_dttm string, vendor_cntry_cde string, hs_chap_nbr string"


def _at(days):
    return f"{DAY + timedelta(days)} 00:00:00"


def test_novelty_limits(rows):
    lines = rows(
        LINES,
        ("A", _at(0), "US", "01"),
        ("A", _at(180), "CN", "02"),  # exactly at the end of the grace period: not late
        ("A", _at(181), "FR", "03"),  # late, and more than 90 days before the end: not recent
        ("A", _at(272), "DE", "NULL"),  # late and exactly 90 days before the end: recent
        ("A", _at(362), "US", "01"),
        ("A", "NULL", "XX", "99"),
        ("B", _at(0), "", None),
    )
    country = {r.bn_9: r for r in his.novelty(lines, "vendor_cntry_cde").collect()}
    assert (country["A"].n_distinct_dim, country["A"].n_late, country["A"].n_recent_new) == (4, 2, 1)
    assert "B" not in country
    both = {
        r.bn_9: r
        for r in his.novelty_profile(
            lines, {"vendor_cntry_cde": "countries", "hs_chap_nbr": "chapters"}
        ).collect()
    }
    a = both["A"]
    assert (a.n_countries, a.late_countries, a.recent_new_countries) == (4, 2, 1)
    assert (a.n_chapters, a.late_chapters, a.recent_new_chapters) == (3, 1, 0)


def test_months(rows):
    txn = rows(
        TXN,
        *[(f"x{i}", "A", date(2025, 1, 1 + i), 1.0) for i in range(3)],
        ("y", "A", date(2025, 4, 2), 1.0),
        ("z", "A", None, 1.0),
    )
    active = {r.ym: r.n_txn for r in his.monthly_counts(txn).collect()}
    assert active == {"2025-01": 3, "2025-04": 1}
    complete = {r.ym: r.n_txn for r in his.monthly_zero_filled(txn).collect()}
    assert complete == {"2025-01": 3, "2025-02": 0, "2025-03": 0, "2025-04": 1}
    ratio = his.peak_to_median_ratio(his.monthly_counts(txn)).first()
    assert (ratio.peak_month, ratio.median_month, ratio.peak_ratio) == (3, 2.0, 1.5)
    z = {r.ym: r.vol_z for r in his.monthly_volume_zscore(his.monthly_counts(txn)).collect()}
    assert z["2025-01"] == pytest.approx(1 / math.sqrt(2))


def test_spike_needs_enough_months(rows):
    months = rows(
        "bn_9 string, ym string, n_txn long, n_months long, vol_z double",
        ("A", "2025-01", 9, 6, 3.0),
        ("A", "2025-02", 9, 5, 4.0),
        ("B", "2025-01", 9, 6, None),
    )
    got = {r.bn_9: (r.n_spike_months, r.max_vol_z) for r in his.monthly_rollup(months, AnomalyConfig()).collect()}
    assert got == {"A": (1, 4.0), "B": (0, None)}
