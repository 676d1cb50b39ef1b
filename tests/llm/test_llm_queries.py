"""Every query of the subpackage runs; those with SQL give the same rows as DuckDB."""

import pytest

from tests.compare import rows_of, sql_rows
from waymark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    got_names, got = rows_of(queries.QUERIES[name](spark, data))
    want_names, want = sql_rows(queries.ORACLES[name], data)
    assert got_names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
