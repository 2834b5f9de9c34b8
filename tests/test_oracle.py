"""Every query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import pytest
from oracle_check import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


def test_every_statement_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.split for r in rows} == {"train", "validation", "test"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, name, queries()[name], SQL[name]) is None
