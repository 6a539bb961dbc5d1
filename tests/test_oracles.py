"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
