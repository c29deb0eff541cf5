"""Every query with an SQL twin gives the same rows in DuckDB."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.harness import compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, SQL[name]) is None


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 10
