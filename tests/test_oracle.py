"""Every query with a checking SQL, on the smallest driver data; the others must give rows."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, engine

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data absent")


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
