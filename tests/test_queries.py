"""Every registered core query runs; those with SQL give the same rows as DuckDB."""

import pytest

from tests.compare import rows_of, sql_rows
from waymark import catalog

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    got_names, got = rows_of(catalog.QUERIES[name](spark, data))
    want_names, want = sql_rows(catalog.ORACLES[name], data)
    assert got_names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_zeros_have_the_sign_of_the_sql(spark, tmp_path):
    """Compared bit by bit: `rows_of` takes both zeros for one."""
    import duckdb

    poses = [(1, [-0.0, 1.0] * 8), (2, [0.0, -2.5] * 8), (3, [-0.0] * 12), (4, [float("nan"), -0.0] * 8)]
    spark.createDataFrame(poses, "record_id bigint, pose array<double>").coalesce(1).write.parquet(f"{tmp_path}/sensor_records.parquet")
    con = duckdb.connect()
    con.sql(f"create view sensor_records as select * from '{tmp_path}/sensor_records.parquet/*.parquet'")
    want = {r[0]: r[1] and list(r[1]) for r in con.sql(catalog.ORACLES["matrix_texts"]).fetchall()}
    got = {r.record_id: r.m for r in catalog.QUERIES["matrix_texts"](spark, str(tmp_path)).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
