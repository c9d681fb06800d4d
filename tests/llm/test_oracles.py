"""Queries with SQL agree with it, on the smallest tables and on odd rows."""

import pytest

from kinweave.llm import queries as q
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
@pytest.mark.parametrize("where", ["small", "odd"])
def test_oracle(spark, sample_dir, name, where):
    sf_dir = sample_dir if where == "odd" else "/root/testdata/sf0.001"
    columns, rows = spark_rows(q.queries()[name](spark, sf_dir))
    want_columns, want = sql_rows(sf_dir, q.oracle_sql()[name])
    assert columns == want_columns and len(rows) == len(want)
    assert [(a, b) for a, b in zip(rows, want) if a != b][:5] == []
