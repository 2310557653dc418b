"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    verdict = compare(name, queries()[name](spark, SF), duck, ORACLES[name])
    assert verdict in ("", "both empty")
