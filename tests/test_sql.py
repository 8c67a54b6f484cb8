"""Every query with SQL gives the rows of its SQL over the whole tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from loomrecall.plans import catalog


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        return repr(float(x) + 0.0) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(name, spark, con, tables):
    got, want = catalog.QUERIES[name](spark, tables).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, tables):
    assert catalog.QUERIES[name](spark, tables).count() > 0
