"""Catalog queries against their SQL. CHECK_SF_DIR and CHECK_QUERIES (a list, or ``all``) widen it."""

import os
from pathlib import Path

import pytest

from cargoscope.catalog import oracle_sql, queries
from tests.oracle import connect, spark_rows, sql_rows

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "fx_wide_to_long hs_section_map fx_asof_join txn_value unmatched_codes consolidators entity_line_features "
    "entity_txn_indicators gap_days benford_mad txn_value_zscore value_z_robust novelty_country "
    "monthly_zero_filled latest_version fill_down_up pivot_party_type release_wide benford_ks_first_two "
    "vague_bottom_quartile natural_right_join risk_matrix flag_combinations anomaly_profile"
)
CHECKED = oracle_sql()
_WANTED = os.environ.get("CHECK_QUERIES", QUICK).replace(",", " ").split()
NAMES = sorted(CHECKED) if _WANTED == ["all"] else _WANTED

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    columns, got = spark_rows(queries()[name](spark, FOLDER))
    expected_columns, expected = sql_rows(con, CHECKED[name])
    assert columns == expected_columns
    assert got.total() == expected.total()
    extra, missing = got - expected, expected - got
    assert not extra and not missing, (list(extra)[:2], list(missing)[:2])


def test_every_check_belongs_to_a_query():
    assert set(CHECKED) <= set(queries())
