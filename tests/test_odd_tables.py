"""Queries on small made tables that the given ones don't resemble, against their SQL by DuckDB."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weft.operators import density, halos
from weft.plans import catalog


def both(spark, tmp_path, name: str, **tables: pd.DataFrame) -> tuple[list, list]:
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register("rows", pa.table({c: pa.array(rows[c].to_numpy(), from_pandas=False) for c in rows}))
        con.execute(f"copy rows to '{tmp_path}/{table}.parquet' (format parquet)")
        con.unregister("rows")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    want = con.sql(catalog.sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    told = lambda rows: sorted((tuple(repr(x) for x in r) for r in rows))
    return told(got), told(want.fetchall())


def orders(rows: list[tuple]) -> pd.DataFrame:
    """Orders of (key, customer, date, price)."""
    out = pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    out["o_orderdate"] = out["o_orderdate"].astype("datetime64[us]")
    return out


def test_trees_of_one_mass(spark, tmp_path):
    """Ties in mass go by tree, although the roots' ids run the other way."""
    day = datetime.datetime(1995, 5, 5)
    rows = [(k, 40 - k, day, 250000.0) for k in range(40)] + [(100 + k, 140 - k, day, 300000.0 + k // 4) for k in range(40)]
    got, want = both(spark, tmp_path, "o03_trees_by_mass", orders=orders(rows))
    assert len(want) == 80 and got == want


def test_shapes_of_one_bin(spark, tmp_path):
    """Every overdensity lies in one bin: the correlation is NaN, not null."""
    n = 24**3
    events = pd.DataFrame({"event_id": range(n), "user_id": 512, "value": [5.12 + k % 5 / 100 for k in range(n)]})
    got, want = both(spark, tmp_path, "x06_pdf_shapes", events=events)
    assert want == [("nan", "True")] and got == want


@pytest.fixture
def small_arrays(monkeypatch):
    """Blocks, neighbourhoods and pieces of a few rows, in the driver and in the workers that get the function by value."""
    cloudpickle.register_pickle_by_value(halos)
    for name, value in (("BLOCK", 40), ("FEW", 5), ("PAIRS", 64)):
        monkeypatch.setattr(halos, name, value)
    yield
    cloudpickle.unregister_pickle_by_value(halos)


def crowd(n: int = 600) -> pd.DataFrame:
    """Orders of two neighbouring quarters: copies of a place and mass, a crowded corner, and others all over the box."""
    day = [datetime.datetime(1998, 5, 5), datetime.datetime(1998, 8, 5)]
    copies = [(k * 100000 + 7, 1, day[k % 2], 1000.0 + k % 3) for k in range(n // 3)]
    near = [(k, 2, day[k % 2], 2000.0 + 40.0 * (k % 7)) for k in range(10, n // 3) if k != 7]
    return orders(copies + near + [(300000000 + 977 * k, 3, day[k % 2], 100.0 * (1 + k % 90)) for k in range(n // 3)])


@pytest.mark.parametrize("name", ["j08_best_match", "g08_track"])
def test_matches_in_small_blocks(spark, tmp_path, small_arrays, name):
    rows = crowd()
    if name == "g08_track":  # snapshots 34 to 27
        quarter = [33 - k % 8 for k in range(len(rows))]
        rows["o_orderdate"] = pd.Series([datetime.datetime(1990 + q // 4, q % 4 * 3 + 2, 3) for q in quarter]).astype("datetime64[us]")
    got, want = both(spark, tmp_path, name, orders=rows)
    assert len(want) > 100 and got == want


def test_odd_masses(spark, tmp_path):
    """A mass that is no number is heavier than all."""
    day = [datetime.datetime(1998, 5, 5), datetime.datetime(1998, 8, 5)]
    nan = float("nan")
    rows = orders([(1, 1, day[1], 1000.0), (100001, 1, day[0], nan), (2, 1, day[1], nan), (100002, 1, day[0], 5.0), (3, 1, day[1], 10.0), (100003, 1, day[0], nan), (200003, 1, day[0], 0.6)])
    got, want = both(spark, tmp_path, "j08_best_match", orders=rows)
    assert len(want) >= 2 and got == want


def test_best_match_is_not_broadcast(spark):
    """Neither side of the match goes to the driver, however small Spark takes it for."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(catalog.queries()["j08_best_match"](spark, "/root/testdata/sf0.001"))
    t = spark.range(50).selectExpr("id AS hid", "1 AS snap", "id + 0.5D AS x", "2.0D AS y", "3.0D AS z", "1.0D AS m")
    out = halos.best_match(t.withColumnRenamed("hid", "tid"), t, 100.0)
    assert "Broadcast" not in plan(out)
    assert {r.tid: r.hid for r in out.collect()} == {k: k for k in range(50)}


def test_crowds_are_not_compared_with_all(monkeypatch):
    """Where halos are dense a target meets a few hundred of the nearest, not the thousands within reach, and finds the same match."""
    rng = np.random.default_rng(5)
    t, c = ([*(rng.normal(50, 4, (3, n)) % 100), rng.uniform(1, 50, n)] for n in (3000, 20000))
    ids, pairs, compare = rng.permutation(20000), [], halos._Search.compare
    monkeypatch.setattr(halos._Search, "compare", lambda self, rows, first, count, order: (pairs.append(count.sum()), compare(self, rows, first, count, order)))
    found = halos._Search(t, c, ids, 100.0, 12.0, 0.05, 0.3)
    found.search(np.arange(3000), 12.0)
    assert sum(pairs) < 1000 * 3000
    for k in range(0, 3000, 50):
        d = np.sqrt(sum((a[k] - b) ** 2 for a, b in zip(t[:3], c[:3])))
        score = np.where((d < 12) & (c[3] > 0.05 * t[3][k]), d + 0.3 * np.abs(np.log10(c[3] / t[3][k])), np.inf)
        assert found.best[k] == (score.argmin() if score.min() < np.inf else -1)


def test_sampling_shuffles_no_particles(spark, monkeypatch):
    """A small grid goes to the particles; by the join for larger ones the densities are the same."""
    t = spark.range(4000).selectExpr("id AS pid", *[f"(id * {k} % 4096) / 64D AS {a}" for a, k in zip("xyz", (1237, 911, 3001))])
    grid = density.cic(t.where("x < 40"), 64.0, 8, F.lit(1.0))
    out = density.sample(t, grid, 64.0, 8, 0.5)
    assert "Exchange hashpartitioning(pid" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.pid: r.density for r in out.collect()}
    monkeypatch.setattr(density, "FIELD", 0)
    want = {r.pid: r.density for r in density.sample(t, grid, 64.0, 8, 0.5).collect()}
    assert len(got) == 4000 and got == pytest.approx(want, abs=1e-12)
