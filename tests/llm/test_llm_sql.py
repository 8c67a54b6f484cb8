"""Queries of this subpackage with SQL give the rows of their SQL over the whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomrecall.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, spark, tables):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, tables).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple("~" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
