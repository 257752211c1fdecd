"""Every registered query against its DuckDB statement, value by value."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from quillon.plans import registry

# the library's own queries; those of the optional operators are tested with them
QUERIES = {name: query for name, query in entry.queries().items() if name in registry.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, con, sf, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
