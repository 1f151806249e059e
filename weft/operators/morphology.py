"""Cosmic-web classes from shell crossings along lattice lines and diagonals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Flag bits: the three axes, then both diagonals of the planes across x, y and z.
AXES = {"x": 1, "y": 2, "z": 4}
DIAGONALS = {"x": (8, 16), "y": (32, 64), "z": (128, 256)}
FLAGS = pa.schema([("pid", pa.int64()), ("flags", pa.int32())])


def _reversed(d: np.ndarray, box: float) -> np.ndarray:
    d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
    return d


def _plane(n: int, box: float, across: str, lines: str, diagonals: bool):
    """Flags of one plane of the lattice: of the axes named in ``lines`` and of the plane's diagonals."""
    u, v = (a for a in "xyz" if a != across)

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        at = col[f"l{u}"].astype(np.int64) * n + col[f"l{v}"]
        if len(at) != n * n or len(np.unique(at)) != n * n:
            raise ValueError(f"the plane l{across} = {col[f'l{across}'][0]} has {len(at)} particles on {len(np.unique(at))} of {n * n} sites")
        order = np.argsort(at, kind="stable")
        pos = {a: col[a][order].reshape(n, n) for a in (u, v)}
        flags = np.zeros((n, n), np.int32)

        def mark(bit: int, crossed: np.ndarray, back) -> None:
            np.bitwise_or(flags, np.where(crossed | back(crossed), bit, 0), out=flags)

        for h in range(1, n // 4):
            if u in lines:
                mark(AXES[u], _reversed(np.roll(pos[u], -h, 0) - pos[u], box) < 0, lambda c: np.roll(c, h, 0))
            if v in lines:
                mark(AXES[v], _reversed(np.roll(pos[v], -h, 1) - pos[v], box) < 0, lambda c: np.roll(c, h, 1))
            if diagonals:
                for bit, s in zip(DIAGONALS[across], (1, -1), strict=True):
                    step = lambda x, by, s=s: np.roll(x, (by, s * by), (0, 1))
                    d = [_reversed(step(pos[a], -h) - pos[a], box) for a in (u, v)]
                    mark(bit, d[0] + s * d[1] < 0, lambda c, step=step: step(c, h))
        return pa.Table.from_arrays([pa.array(col["pid"][order]), pa.array(flags.ravel())], schema=FLAGS)

    return run


def crossings(particles: DataFrame, n: int, box: float, cartesian_only: bool = False) -> DataFrame:
    """pid and flags: which axes and diagonals are crossed within a quarter of the lattice.

    A plane across an axis holds both other axes' lines and their diagonals, so a group is n x n particles, there are n of
    them for each of three shuffles (two without diagonals), and a plane is worked on as arrays. Planes with missing or
    repeated sites raise: a gap would shift whole lines. A pair in reversed order marks both of its particles."""
    jobs = [("z", "xy"), ("y", "z")] if cartesian_only else [("z", "xy"), ("y", "z"), ("x", "")]
    per = None
    for across, lines in jobs:
        u, v = (a for a in "xyz" if a != across)
        rows = particles.select("pid", u, v, "lx", "ly", "lz").groupBy(f"l{across}").applyInArrow(_plane(n, box, across, lines, not cartesian_only), "pid long, flags int")
        per = rows if per is None else per.unionByName(rows)
    return per.groupBy("pid").agg(F.bit_or("flags").alias("flags"))


def class_of(flags="flags"):
    """The largest number of crossings in one of the four sets of axes: x, y, z, and an axis with its plane's diagonals."""
    f = F.col(flags)
    sets = [7, *[AXES[a] | DIAGONALS[a][0] | DIAGONALS[a][1] for a in "xyz"]]
    return F.greatest(*[F.bit_count(f.bitwiseAND(F.lit(s))) for s in sets]).cast("int")


def classify(particles: DataFrame, n: int, box: float, cartesian_only: bool = False) -> DataFrame:
    """pid and class (0 void, 1 wall, 2 filament, 3 halo)."""
    return crossings(particles, n, box, cartesian_only).select("pid", class_of().alias("class"))


def fractions(classified: DataFrame, linear_at: float = 0.99) -> DataFrame:
    """Number and mass fraction of each class, and whether voids alone make the field linear."""
    counts = classified.groupBy("class").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0)).alias("void"))  # one row
    share = counts.join(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("total").cast("double"))
    return share.select("class", "n", "fraction", (F.col("void") >= linear_at * F.col("total")).alias("linear"))


def deposit(classified: DataFrame, box: float, n: int) -> DataFrame:
    """All n cubed cells: counts and fractions of each class and the dominant class, ties to the lower one; an empty cell is void."""
    cell = [(F.floor(F.col(a) * n / box) % n).cast("int").alias(f"i{a}") for a in "xyz"]
    met = classified.groupBy(*cell).agg(*[F.count_if(F.col("class") == c).alias(f"n{c}") for c in range(4)])
    k = F.col("id")
    all_cells = classified.sparkSession.range(n**3).select((k % n).cast("int").alias("ix"), (F.floor(k / n) % n).cast("int").alias("iy"), F.floor(k / (n * n)).cast("int").alias("iz"))
    counts = all_cells.join(met, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", *[F.coalesce(f"n{c}", F.lit(0)).alias(f"n{c}") for c in range(4)])
    top = F.greatest(*[F.col(f"n{c}") for c in range(4)])
    first = F.lit(3)
    for c in (2, 1, 0):
        first = F.when(F.col(f"n{c}") == top, c).otherwise(first)
    total = sum(F.col(f"n{c}") for c in range(4))
    shares = [F.coalesce(F.try_divide(F.col(f"n{c}").cast("double"), total), F.lit(0.0)).alias(f"f{c}") for c in range(4)]
    return counts.select("*", first.alias("dominant"), *shares)


def volume_fractions(cells: DataFrame) -> DataFrame:
    """The share of all cells that each class dominates."""
    per = cells.groupBy(F.col("dominant").alias("class")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total").cast("double")).alias("fraction"))
