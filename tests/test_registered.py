"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from airlattice import registry
from compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    extra, missing, n = differences(spark, con, QUERIES[name], SQL[name], SF_DIR)
    assert not extra and not missing
    assert n > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["bucket", "mean"]
