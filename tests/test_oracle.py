"""Every registered query against its SQL, over the whole tables of a small scale."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(queries()))
def test_query(spark, sf, con, key):
    compare(spark, con, sf, key, queries()[key], oracle_sql().get(key))


def test_entry(spark):
    out = entry(spark)
    assert out.columns and out.count() == 1


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
