"""Every query that has SQL gives the same rows as the SQL."""

import pytest
from parity import connect, difference, rows_of

import __spark_entry__ as entry
from conftest import SF_DIR

SLOW_SQL = {"sequence_identity_pairs", "sequence_identity_histogram"}  # see test_pairs


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW_SQL))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas().astype(object)
    got = got.where(got.notna(), None)
    assert difference(got, rows_of(con, entry.oracle_sql()[name])) is None


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq_id", "ensemble_score", "mean", "max"]
    assert df.count() == 200
