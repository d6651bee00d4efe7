"""Every query with an SQL twin equals it; the others give rows with a stable schema."""

import oracle
import pytest

import __spark_entry__ as entry

SLOW = {"c16_compare_cluster_counts", "study_two_groups_with_policies", "c05_k_sweep"}  # covered on small frames elsewhere
WITH_SQL = sorted(entry.oracle_sql())
ROWS_ONLY = sorted(set(entry.queries()) - set(WITH_SQL) - SLOW)


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, sf, con, name):
    assert oracle.compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
