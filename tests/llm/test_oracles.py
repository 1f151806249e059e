"""Queries of the training-data operators against the SQL that gives the same rows, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weft.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (sorted(([None if pd.isna(x) else x for x in r] for r in f[sorted(f.columns)].itertuples(index=False, name=None)), key=str) for f in (got, want))
    assert len(a) == len(b) and all(x == pytest.approx(y) if all(isinstance(v, (int, float)) for v in x) else x == y for x, y in zip(a, b))
