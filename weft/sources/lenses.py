"""The driver's tables seen as particles, halos and merger trees, by arithmetic that SQL shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.geometry import wrap

BOX = 64.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files make fewer splits than there are cores is dealt out to them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles without ids: positions in [0, BOX), a mass and a velocity. Positions are whole 256ths, so that sums of products are exact in any order."""
    t = spread(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_orderkey", "l_discount"))
    place = lambda c: ((c % 8192).cast("double") + 0.5) / 128.0
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    quantity = F.col("l_quantity").cast("long")
    return t.select(
        place(cents).alias("x"),
        place(F.col("l_partkey") * 37 + quantity * 101).alias("y"),
        place(F.col("l_suppkey") * 53 + F.col("l_orderkey") * 17).alias("z"),
        F.col("l_quantity").alias("mass"),
        (F.round(F.col("l_discount") * 100) - 5).alias("v"),
    )


PARTICLES = """particles AS (SELECT
  (CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 8192 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 128 AS x,
  (CAST((l_partkey * 37 + CAST(l_quantity AS BIGINT) * 101) % 8192 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 128 AS y,
  (CAST((l_suppkey * 53 + l_orderkey * 17) % 8192 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 128 AS z,
  l_quantity AS mass, round(l_discount * 100) - 5 AS v FROM lineitem)"""


def side(n: int) -> int:
    """The largest whole number whose cube is at most n."""
    k = round(n ** (1 / 3)) + 1
    while k**3 > n:
        k -= 1
    return k


def lattice(spark: SparkSession, sf_dir: str, amplitude: float = 2.5) -> tuple[DataFrame, int]:
    """Particles with ids on a cubic lattice of side N, moved by up to half the amplitude and wrapped; and N. Positions are whole 2048ths: exact sums."""
    t = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    n = side(t.count())
    t = spread(t)
    moved = lambda c: ((c % 1024).cast("double") / 1024.0 - 0.5) * amplitude
    pid = F.col("event_id")
    site = [pid % n, F.floor(pid / n) % n, F.floor(pid / (n * n))]
    shift = [moved(F.floor(F.col("value") * 100).cast("long")), moved(F.col("user_id") * 37), moved(pid * 61 + F.col("user_id") * 7)]
    cols = [wrap(s.cast("double") + u, n).alias(a) for s, u, a in zip(site, shift, "xyz", strict=True)]
    return t.where(pid < n**3).select(pid.alias("pid"), *[s.cast("int").alias(f"l{a}") for s, a in zip(site, "xyz", strict=True)], *cols), n


LATTICE = """n AS (SELECT max(i) AS n FROM range(1, 2000) r(i) WHERE i * i * i <= (SELECT count(*) FROM events)),
raw AS (SELECT event_id AS pid, n, CAST(event_id % n AS INT) AS lx, CAST((event_id // n) % n AS INT) AS ly, CAST(event_id // (n * n) AS INT) AS lz,
  (CAST(CAST(floor(value * 100) AS BIGINT) % 1024 AS DOUBLE) / 1024 - 0.5::DOUBLE) * 2.5::DOUBLE AS ux,
  (CAST((user_id * 37) % 1024 AS DOUBLE) / 1024 - 0.5::DOUBLE) * 2.5::DOUBLE AS uy,
  (CAST((event_id * 61 + user_id * 7) % 1024 AS DOUBLE) / 1024 - 0.5::DOUBLE) * 2.5::DOUBLE AS uz
  FROM events, n WHERE event_id < n * n * n),
lattice AS (SELECT pid, n, lx, ly, lz,
  CASE WHEN lx + ux < 0 THEN lx + ux + n WHEN lx + ux >= n THEN lx + ux - n ELSE lx + ux END AS x,
  CASE WHEN ly + uy < 0 THEN ly + uy + n WHEN ly + uy >= n THEN ly + uy - n ELSE ly + uy END AS y,
  CASE WHEN lz + uz < 0 THEN lz + uz + n WHEN lz + uz >= n THEN lz + uz - n ELSE lz + uz END AS z FROM raw)"""


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halo catalogs by snapshot (a year's quarter): id, place, mass, radius."""
    t = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    snap = ((F.year("o_orderdate") - 1990) * 4 + F.quarter("o_orderdate")).cast("int")
    place = lambda c: ((c % 100000).cast("double") + 0.5) / 1000.0
    key = F.col("o_orderkey")
    return t.select(
        key.alias("hid"), F.col("o_custkey").alias("tree"), snap.alias("snap"), place(key * 7919).alias("x"), place(key * 104729).alias("y"), place(key * 1299709).alias("z"),
        F.col("o_totalprice").alias("m"), (F.col("o_totalprice") / 400000.0).alias("r"),
    )


HALO_BOX = 100.0
HALOS = """halos AS (SELECT o_orderkey AS hid, o_custkey AS tree, CAST((year(o_orderdate) - 1990) * 4 + quarter(o_orderdate) AS INT) AS snap,
  (CAST((o_orderkey * 7919) % 100000 AS DOUBLE) + 0.5::DOUBLE) / 1000 AS x, (CAST((o_orderkey * 104729) % 100000 AS DOUBLE) + 0.5::DOUBLE) / 1000 AS y,
  (CAST((o_orderkey * 1299709) % 100000 AS DOUBLE) + 0.5::DOUBLE) / 1000 AS z, o_totalprice AS m, o_totalprice / 400000 AS r FROM orders)"""


def chain() -> Window:
    return Window.partitionBy("tree").orderBy("o_orderdate", "node")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merger-tree nodes: each customer's orders in time are one chain of progenitors."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("tree"), "o_orderdate", F.col("o_totalprice").alias("mass"))
    w = chain()
    at = lambda c: ((c % 10000).cast("double") + 0.5) / 100.0
    return t.select("node", "tree", F.row_number().over(w).cast("int").alias("snap"), "mass", at(F.col("node") * 3571).alias("x"), F.lag("node").over(w).alias("main_prog"), F.lead("node").over(w).alias("descendant"))


TREE_BOX = 100.0
TREE = """nodes AS (SELECT o_orderkey AS node, o_custkey AS tree, CAST(row_number() OVER w AS INT) AS snap, o_totalprice AS mass,
  (CAST((o_orderkey * 3571) % 10000 AS DOUBLE) + 0.5::DOUBLE) / 100 AS x, lag(o_orderkey) OVER w AS main_prog, lead(o_orderkey) OVER w AS descendant
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
