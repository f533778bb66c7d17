"""Queries against DuckDB, and the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__
from spanloom.queries import ALL
from tests.duck import assert_same


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    query, sql = ALL[name]
    assert_same(query, sql, spark)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500 * 3 * 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
