"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry
from lifetrace.suite import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    problem = check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
