"""The queries that SQL expresses, against DuckDB over the whole smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

llm = pytest.importorskip("arbora.llm.queries")
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = llm.queries()[name](spark, DATA).toPandas(), con.sql(llm.oracle_sql()[name]).df()
    key = want.columns[0]
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
