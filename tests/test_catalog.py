"""Each query against the SQL that gives the same rows, by DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from weft.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        name = f.split(".")[0]
        con.execute(f"create view {name} as select * from '{D}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else round(x, 4) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False, name=None)), key=lambda r: [(x is None, str(x) if isinstance(x, str) else x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_same_rows(spark, duck, name):
    got, want = catalog.queries()[name](spark, D).toPandas(), duck.sql(catalog.sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, (int, float)) for v in x) else x == y
