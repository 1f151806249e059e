"""Particle ids and lattice sites: validation, order of ids, indexing; and the classification run from particles to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import geometry as geo
from weft.operators import density, morphology, stats


def validated(ids: DataFrame, n: int, offset: int = 1) -> DataFrame:
    """One row: whether the ids (pid) are n cubed, unique, and in [offset, offset + n cubed)."""
    t = ids.agg(F.count("pid").alias("count"), F.min("pid").alias("low"), F.max("pid").alias("high"), F.count_distinct("pid").alias("different"))
    return t.select("count", "low", "high", (F.col("count") == n**3).alias("is_full"), (F.col("low") >= offset) & (F.col("high") < offset + n**3), (F.col("different") == F.col("count")).alias("is_unique")).toDF("count", "low", "high", "is_full", "in_range", "is_unique")


def check(ids: DataFrame, n: int, offset: int = 1) -> None:
    row = validated(ids, n, offset).first()
    wrong = [name for name in ("is_full", "in_range", "is_unique") if not row[name]]
    if wrong:
        raise ValueError(f"ids {row['low']} to {row['high']}, {row['count']} of them, fail {', '.join(wrong)} for a lattice of side {n}")


def ordering_scores(particles: DataFrame, n: int, box: float) -> DataFrame:
    """One row: how far neighbours in id are from neighbours along x and along z (x_major, z_major: less is nearer), and the pairs met.

    Some ids and those one and n further are looked up, fifteen rows at most, by a filter that reaches the scan."""
    probes = [k for k in (1, n // 4, n // 2, 10 * n, 100 * n)]
    base = particles.where(F.col("pid").isin(probes)).select(F.col("pid").alias("id"), *[F.col(a).alias(f"{a}0") for a in "xyz"])
    near = particles.where(F.col("pid").isin([p + d for p in probes for d in (1, n)])).select("pid", "x", "y", "z")
    times = F.lit(0)  # a probe may be named twice
    for p in probes:
        times = times + (F.col("id") == p).cast("int")
    pairs = base.where(F.col("id") >= 1).join(near, (F.col("pid") == F.col("id") + 1) | (F.col("pid") == F.col("id") + n))
    d = {a: geo.min_image(F.col(a) - F.col(f"{a}0"), box) for a in "xyz"}
    step = box / n
    off = lambda a: F.sqrt(sum((d[b] - (step if a == b else 0.0)) * (d[b] - (step if a == b else 0.0)) for b in "xyz"))
    next_id = F.col("pid") == F.col("id") + 1
    x = F.when(next_id, off("x")).otherwise(F.abs(d["z"])) * times
    z = F.when(next_id, off("z")).otherwise(F.abs(d["x"])) * times
    return pairs.agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("x_major"), F.coalesce(F.sum(z), F.lit(0.0)).alias("z_major"), F.coalesce(F.sum(F.when(next_id, times)), F.lit(0)).alias("n_pairs"))


def ordering(particles: DataFrame, n: int, box: float) -> str:
    """'x' or 'z': which index of the lattice runs fastest in the ids; 'z' if no pair is there."""
    row = ordering_scores(particles, n, box).first()
    return "x" if row["n_pairs"] and row["x_major"] < row["z_major"] else "z"


def on_lattice(particles: DataFrame, n: int, box: float, order: str | None = None, offset: int | None = None) -> DataFrame:
    """Particles (pid, x, y, z) with their sites lx, ly, lz; order and offset are found from the data unless given. A projection, not a sort; ids outside the lattice go."""
    order = order or ordering(particles, n, box)
    if offset is None:
        offset = particles.agg(F.min("pid")).first()[0] or 0
    k = F.col("pid") - offset
    fast, slow = (k % n).cast("int"), F.floor(k / (n * n)).cast("int")
    lx, lz = (fast, slow) if order == "x" else (slow, fast)
    return particles.where((k >= 0) & (k < n**3)).select("pid", "x", "y", "z", lx.alias("lx"), (F.floor(k / n) % n).cast("int").alias("ly"), lz.alias("lz"))


def classified_run(particles: DataFrame, n: int, box: float, cells: int, cartesian_only: bool = False, low: float = 1e-2, high: float = 1e2, bins: int = 40) -> dict[str, DataFrame]:
    """From particles with ids to four tables.

    particles: pid, x, y, z, class, od (the overdensity at the particle); cells: the dense grid with overdensity and classes;
    bins: PDFs of all particles, of each class, and of the cells; summary: a row for each class, its shares of mass and volume and its mean overdensity.
    The classified particles are used three times: keep them (``cache``) if they fit."""
    sites = on_lattice(particles, n, box)
    classes = morphology.classify(sites, n, box, cartesian_only)
    grid = density.cic(sites, box, cells, F.lit(1.0))
    rho = density.sample(sites, grid, box, cells, 0.5)
    mean = rho.agg(F.avg("density").alias("mean"))  # one row
    od = rho.join(F.broadcast(mean)).select("pid", (F.col("density") / F.col("mean")).alias("od"))
    told = sites.select("pid", "x", "y", "z").join(classes, "pid").join(od, "pid")
    field = density.dense(grid, cells, "density").withColumn("od", F.col("density") * (box**3 / n**3))
    morph = morphology.deposit(told, box, cells)
    named = lambda name: F.lit(name).alias("of")
    of_all = told.select("od", F.explode(F.array(F.lit("all"), *[F.when(F.col("class") == c, F.lit(x)) for c, x in enumerate(geo.CLASSES)])).alias("of")).where("of is not null")
    pdf = stats.weighted_pdf(of_all, "od", F.lit(1.0), low, high, bins, "of").unionByName(stats.weighted_pdf(field.select("od", named("cells")), "od", F.lit(1.0), low, high, bins, "of"))
    mass = morphology.fractions(classes).select("class", "n", F.col("fraction").alias("mass_fraction"), "linear")
    volume = morphology.volume_fractions(morph).select("class", F.col("fraction").alias("volume_fraction"))
    means = told.groupBy("class").agg(F.avg("od").alias("mean_od"))
    summary = mass.join(volume, "class", "left").join(means, "class", "left").withColumn("volume_fraction", F.coalesce("volume_fraction", F.lit(0.0)))
    return {"particles": told, "cells": field.join(morph, ["ix", "iy", "iz"]), "bins": pdf, "summary": summary}
