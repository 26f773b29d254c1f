"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tickloom.catalog import load_all

from .oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
CATALOG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, con, name):
    q = CATALOG[name]
    assert q.sql, "every registered query has an SQL oracle"
    assert compare(q.run(spark, SF_DIR), con, q.sql) is None


def test_contract(spark):
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert CATALOG.keys() <= contract.oracle_sql().keys()
    assert contract.entry(spark).count() > 0
