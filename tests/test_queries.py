"""Every registered query against its SQL text on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_tiny):
    return connect(sf_tiny)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, sf_tiny, name):
    ok, note = compare(spark, con, sf_tiny, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_library_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "value_sum" in rows.columns
