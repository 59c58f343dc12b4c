"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQLS = entry.queries(), entry.oracle_sql()
OWN = [name for name in QUERIES if name not in entry.EXTRA]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    status, detail, _ = compare(spark, con, name, QUERIES[name], SQLS.get(name), SF)
    assert status in ("ok", "rows-only", "EMPTY"), detail


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "dpd" in df.columns
