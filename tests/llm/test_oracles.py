"""Queries that SQL expresses, on test tables and on odd ones; every query on odd and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from spanloom.llm import queries
from tests.duck import assert_same

ROWS = {"op1_substring_dedup": None, "op3_url_filters": 5, "op6_benchmark_decontamination": None, "pipeline": None}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("tables", ["sf0.001", "odd"])
def test_same_as_sql(spark, odd_dir, name, tables):
    where = odd_dir["odd"] if tables == "odd" else "/root/testdata/sf0.001"
    if tables == "odd" and name == "op7_line_dedup":
        pytest.skip("null and repeated doc_ids; see test_line_dedup")
    assert_same(queries.queries()[name], queries.oracle_sql()[name], spark, where)


@pytest.mark.parametrize("name", [*sorted(queries.queries()), "pipeline"])
def test_odd_and_empty_tables(spark, odd_dir, name):
    query = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
    expected = ROWS.get(name, 16)
    n = query(spark, odd_dir["odd"]).count()
    assert expected is None or n == expected
    out = query(spark, odd_dir["empty"])
    assert out.count() == 0 and out.columns
