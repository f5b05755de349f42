"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from arbora import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = _sorted(queries.QUERIES[name](spark, DATA).toPandas()), _sorted(con.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


def test_scans_are_pruned_and_filters_pushed(spark):
    from pyspark.sql import functions as F

    from arbora.operators import volume

    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("z"), F.col("l_quantity").alias("v"))
    plan = volume.crop(rows, (10, 1, 1), (5, 3, 100))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_order" in plan  # the plan's text is shortened


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
