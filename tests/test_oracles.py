"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query(spark, con, key):
    _, error = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert error is None


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
