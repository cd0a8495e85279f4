"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as driver
from compare import connect, difference
from rankfold.plans.table_queries import all_oracles, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) == ""


def test_entry(spark):
    ranks = [r["rank"] for r in driver.entry(spark).collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and ranks
