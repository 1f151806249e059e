"""Numbers on the driver, readers and sinks, and the whole run against plain Python."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import geometry as geo
from weft.functions import numeric
from weft.operators import density, fourier, halos, morphology, particles, series, stats, trees
from weft.sources import lenses, simulation

D = "/root/testdata/sf0.001"


def test_grids_and_methods():
    assert geo.infer_grid_size(4096) == 16
    with pytest.raises(ValueError):
        geo.infer_grid_size(4097)
    assert geo.physical_grid_size(256.0, 0.5, 1.0) == (128, 1.0) and geo.physical_grid_size(1.0, 1.0, 1.0)[0] == 8
    got = geo.recommended_grid(1024**3, 512.0, 0.005)
    assert (got["n_grid"], got["particles_per_cell"], got["binding"], got["warnings"]) == (256, 64.0, "particles", [])
    assert geo.recommended_grid(1000, 10.0)["warnings"] and geo.recommended_grid(64**3, 100.0, 1.0)["binding"] == "softening"
    assert [geo.recommended_method(a) for a in (1, 5, 10)] == ["tessellation", "smoothed", "sph"]
    assert geo.mean_density(1000, 2.0, 10.0) == 2.0 and geo.mean_surface_density(1000, 2.0, 10.0, 3.0) == 6.0
    assert geo.smoothing_length(1000, 10.0) == pytest.approx((32 / (4 / 3 * math.pi)) ** (1 / 3))
    assert geo.QUANTITIES["velocity_curl"] == (True, False, True)


def test_generators():
    x = numeric.Generator("xorshift", 42)
    state, mask = 42, 2**64 - 1
    for _ in range(5):
        state ^= (state << 13) & mask
        state ^= state >> 7
        state ^= (state << 17) & mask
        assert x.next() == state / mask
    for kind in numeric.Generator.KINDS:
        g = numeric.Generator(kind, 7)
        values = [g.uniform(2.0, 3.0) for _ in range(4000)]
        assert all(2 <= v <= 3 for v in values) and abs(np.mean(values) - 2.5) < 0.02 and abs(np.var(values) - 1 / 12) < 0.01
        normal = [g.gaussian() for _ in range(4000)]
        assert abs(np.mean(normal)) < 0.06 and abs(np.std(normal) - 1) < 0.05 and {g.uniform_int(0, 3) for _ in range(100)} == {0, 1, 2}
    with pytest.raises(ValueError):
        numeric.Generator("other")


def test_factors():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        a, b = rng.normal(size=(n, n)), rng.normal(size=n)
        f = numeric.Factors(a)
        assert np.allclose(a @ f.solve(b), b) and np.allclose(f.inverse(), np.linalg.inv(a)) and f.determinant() == pytest.approx(np.linalg.det(a))
    with pytest.raises(ValueError):
        numeric.Factors([[1.0, 2.0], [2.0, 4.0]])


def test_spline_and_sequence(spark):
    xs, ys = [0.0, 1.0, 2.5, 4.0, 8.0], [1.0, 3.0, 2.0, 5.0, -1.0]
    y2 = series.second_derivatives(xs, ys)
    h = np.diff(xs)
    for k in range(1, 4):
        assert h[k - 1] * y2[k - 1] + 2 * (h[k - 1] + h[k]) * y2[k] + h[k] * y2[k + 1] == pytest.approx(6 * ((ys[k + 1] - ys[k]) / h[k] - (ys[k] - ys[k - 1]) / h[k - 1]))
    assert y2[0] == y2[-1] == 0
    u = spark.range(1, 1024).select(*[series.sobol(F.col("id"), k).alias(f"u{k}") for k in range(6)], series.uniform(F.col("id")).alias("r"), series.gaussian(F.col("id")).alias("g")).toPandas()
    for k in range(6):  # every interval of 1/16 holds as many points as any other, but for the ends of the sequence
        assert set(np.bincount((u[f"u{k}"] * 16).astype(int), minlength=16)) <= {63, 64, 65}
    assert abs(u["r"].mean() - 0.5) < 0.03 and abs(u["g"].std() - 1) < 0.1
    assert list(u["u0"][:3]) == [0.75, 0.25, 0.875]


def test_bilinear(spark):
    grid = spark.createDataFrame([(i, j, float(3 * i + 5 * j + 1)) for i in range(4) for j in range(5)], "i int, j int, value double")
    points = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.4, 1.99), (3, 2.0, 2.5), (4, -0.5, 0.0)], "pid int, x double, y double")
    got = {r.pid: r.value for r in series.bilinear(points, grid, 0.5).collect()}
    for p, x, y in ((1, 0.25, 0.5), (2, 1.4, 1.99), (3, 2.0, 2.5), (4, -0.5, 0.0)):
        assert got[p] == pytest.approx(3 * x / 0.5 + 5 * y / 0.5 + 1)


def test_kernels_are_normalised(spark):
    for name, (f, support) in geo.KERNELS.items():
        r = (F.col("id") + 0.5) * (support * 0.7 / 4000)
        total = spark.range(4000).select((f(r / 0.7, 0.7) * 4 * math.pi * r * r * (support * 0.7 / 4000)).alias("v")).agg(F.sum("v")).first()[0]
        plane = spark.range(400).select((geo.projected(name, (F.col("id") + 0.5) * (support / 400), 0.7) * 2 * math.pi * (F.col("id") + 0.5) * (support * 0.7 / 400) ** 2).alias("v")).agg(F.sum("v")).first()[0]
        assert total == pytest.approx(1, abs=1e-4) and plane == pytest.approx(1, abs=2e-3)


def test_power_spectrum_options(spark):
    """Deconvolution, shot noise, the top-hat window and a sparse grid against numpy's transforms."""
    rng, n, box = np.random.default_rng(9), 8, 20.0
    grid = rng.random((n, n, n))
    grid[rng.random((n, n, n)) < 0.3] = 0
    rows = [(int(i), int(j), int(k), float(grid[i, j, k])) for i, j, k in zip(*np.nonzero(grid))]
    t = spark.createDataFrame(rows, "ix int, iy int, iz int, od double")
    f = np.fft.fftn(grid)
    m = np.fft.fftfreq(n) * n
    mx, my, mz = np.meshgrid(m, m, m, indexing="ij")
    k = np.sqrt(mx**2 + my**2 + mz**2)
    w = np.ones_like(k)
    for a in (mx, my, mz):
        w *= np.sinc(a / n) ** 2
    p = np.abs(f) ** 2 * box**3 / n**6
    p = np.where(w > 0.01, p / w**2, 0)
    got = {r.bin: r for r in fourier.power_spectrum(t, n, box, deconvolve=True, shot_noise=1.5).collect()}
    for b in range(n // 2):
        inside = (k >= b) & (k < b + 1)
        assert got[b].n_modes == inside.sum() and got[b].power == pytest.approx(p[inside].mean() - 1.5) and got[b].k == pytest.approx(k[inside].mean() * 2 * math.pi / box)
    x = np.where(k == 0, 1, k * 2 * math.pi / box * 3.0)
    want = np.fft.ifftn(f * np.where(k == 0, 1, 3 * (np.sin(x) - x * np.cos(x)) / x**3)).real
    back = fourier.smooth(t, n, box, 3.0, "tophat", "od").collect()
    assert len(back) == n**3 and all(r.od == pytest.approx(want[r.ix, r.iy, r.iz]) for r in back)


def plain_flags(pos, n, box):
    def shift(d):
        return d - box if d > box / 2 else d + box if d < -box / 2 else d

    ways = [(1, {0: 1}), (2, {1: 1}), (4, {2: 1}), (8, {1: 1, 2: 1}), (16, {1: 1, 2: -1}), (32, {0: 1, 2: 1}), (64, {0: 1, 2: -1}), (128, {0: 1, 1: 1}), (256, {0: 1, 1: -1})]
    out = {}
    for site in pos:
        f = 0
        for bit, way in ways:
            for h in [s * k for k in range(1, n // 4) for s in (1, -1)]:
                other = tuple((c + h * way.get(a, 0)) % n for a, c in enumerate(site))
                if sum(sign * shift(pos[other][a] - pos[site][a]) for a, sign in way.items()) * h < 0:
                    f |= bit
                    break
        out[site] = f
    return out


def test_morphology_against_loops(spark):
    """Flags of every particle, a shear that only diagonals see, and a lattice with a gap."""
    rng, n = np.random.default_rng(3), 9
    pos = {(a, b, c): [float((v + d) % n) for v, d in zip((a, b, c), rng.normal(0, 0.6, 3))] for a in range(n) for b in range(n) for c in range(n)}
    rows = [(a + n * (b + n * c), a, b, c, *p) for (a, b, c), p in pos.items()]
    schema = "pid long, lx int, ly int, lz int, x double, y double, z double"
    got = {r.pid: r.flags for r in morphology.crossings(spark.createDataFrame(rows, schema), n, float(n)).collect()}
    want = plain_flags(pos, n, float(n))
    assert all(got[a + n * (b + n * c)] == f for (a, b, c), f in want.items()) and len(set(got.values())) > 50
    with pytest.raises(Exception, match="sites"):
        morphology.crossings(spark.createDataFrame(rows[:-1], schema), n, float(n)).collect()
    shear = [(a + n * (b + n * c), a, b, c, (a + 3.5 * math.sin(2 * math.pi * b / n)) % n, float(b), float(c)) for a in range(n) for b in range(n) for c in range(n)]
    t = spark.createDataFrame(shear, schema)
    axes, full = (morphology.classify(t, n, float(n), only).where("class > 0").count() for only in (True, False))
    assert axes == 0 and full > 0


def test_tiles(spark, monkeypatch):
    """Tiles of few rows give the same volumes and samples as whole layers; means and fractions add up."""
    t, n = lenses.lattice(spark, D)
    whole = {r.pid: (r.n_tetra, r.volume, r.density) for r in density.tetra_vertex(t, n, float(n)).collect()}
    cells = sorted(map(tuple, density.tetra_density(t, n, float(n), 5, 3).collect()))
    monkeypatch.setattr(density, "TILE", 3 * n)
    parts = {r.pid: (r.n_tetra, r.volume, r.density) for r in density.tetra_vertex(t, n, float(n)).collect()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)
    assert cells == sorted(map(tuple, density.tetra_density(t, n, float(n), 5, 3).collect()))
    assert np.mean([x[2] for x in whole.values()]) == pytest.approx(1) and all(x[0] == 24 for x in whole.values())


def test_run(spark):
    t, n = lenses.lattice(spark, D)
    run = particles.classified_run(t.select((F.col("pid") + 5).alias("pid"), "x", "y", "z"), n, float(n), 8)
    assert run["particles"].count() == n**3 and run["cells"].count() == 512
    rows = run["summary"].collect()
    assert sum(r.mass_fraction for r in rows) == pytest.approx(1) and sum(r.n * r.mean_od for r in rows) / n**3 == pytest.approx(1)
    assert {r.of for r in run["bins"].select("of").distinct().collect()} >= {"all", "cells"}
    flipped = t.select((F.col("lz") + n * (F.col("ly") + n * F.col("lx"))).cast("long").alias("pid"), "x", "y", "z")
    assert particles.ordering(flipped.withColumn("pid", F.col("pid") + 1), n, float(n)) == "z"
    assert sorted(map(tuple, particles.on_lattice(flipped, n, float(n), "z", 0).select("lx", "ly", "lz", "x").collect())) == sorted(map(tuple, t.select("lx", "ly", "lz", "x").collect()))
    particles.check(t, n, 0)
    with pytest.raises(ValueError):
        particles.check(t, n, 1)


def test_neighbours_of_neighbours(spark):
    rng = np.random.default_rng(5)
    at = rng.random((300, 3)) * 10
    at[:40] = at[0] + rng.normal(0, 0.01, (40, 3))
    t = spark.createDataFrame([(i, *map(float, p % 10)) for i, p in enumerate(at)], "pid long, x double, y double, z double")
    got = {r.pid: r.h for r in density.knn(t, 10.0, 6).collect()}
    d = np.abs((at % 10)[:, None] - (at % 10)[None])
    want = np.sort(np.sqrt((np.minimum(d, 10 - d) ** 2).sum(-1)), axis=1)[:, 6]
    assert len(got) == 300 and all(got[i] == pytest.approx(w) for i, w in enumerate(want))
    assert density.knn(t.limit(4), 10.0, 6).count() == 0


def test_readers(spark, tmp_path):
    names = ["s_7.10.hdf5", "a/s_007.2.hdf5", "s_007.hdf5", "s_17.0.hdf5", "g_7.1.hdf5"]
    assert simulation.shards(names, "s", 7) == ["s_007.hdf5", "a/s_007.2.hdf5", "s_7.10.hdf5"]
    table = np.arange(62 * 5, dtype=float).reshape(5, 62) + 1
    (tmp_path / "h.txt").write_text("# scale id ...\n" + "\n".join(" ".join(map(str, r)) for r in table))
    with open(tmp_path / "h.bin", "wb") as f:
        f.write(struct.pack("<q", 5) + table.T.astype("<f8").tobytes())
    text = simulation.read_halo_values(spark, str(tmp_path / "h.txt"), ["mvir", "rs", "rad_200c"]).collect()
    binary = simulation.read_halo_values(spark, str(tmp_path / "h.bin"), ["mvir", "rs", "rad_200c"], binary=True).collect()
    assert sorted(text) == sorted(binary) and [r.mvir for r in sorted(text)] == list(table[:, 10]) and text[0].rs == table[0, 12] / 1000
    assert sorted(map(tuple, simulation.read_binary_table(spark, str(tmp_path / "h.bin"), {"a": 3}, 2).collect())) == [(x,) for x in table[:, 3]]
    radii = [r.r for r in simulation.read_halos(spark, str(tmp_path / "h.txt")).collect()]
    assert radii == sorted(radii, reverse=True) and radii[0] == pytest.approx((table[4, 37] / (4 / 3 * math.pi * 200 * 3 * 4900 / (8 * math.pi * geo.GRAVITY))) ** (1 / 3))
    simulation.convert_halos(spark, str(tmp_path / "h.txt"), str(tmp_path / "top"), 2)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "top")).collect()} == {int(table[3, 1]), int(table[4, 1])}


def test_power_spectra(spark, tmp_path):
    rng = np.random.default_rng(2)
    for snap in (3, 12):
        lines = []
        for s in range(3):
            k = 0.01 * 16**s * np.arange(1, 121)
            lines += ["1.0", "120", "100.0", "64", "0.9"] + [f"{a} {1 + b} 2.0 {c} 0.25" for a, b, c in zip(k, rng.random(120), rng.integers(0, 20, 120))]
        (tmp_path / f"powerspec_{snap:03d}.txt").write_text("\n".join([*lines, "1.0", "100", "100"]) + "\n")
    t = simulation.read_power_spectra(spark, str(tmp_path))
    assert t.count() == 720 and {r.snap for r in t.select("snap").distinct().collect()} == {3, 12}
    for subtract in (False, True):
        got = sorted((r.k, r.delta_squared) for r in simulation.stitched(t, subtract, bins=20).where("snap = 3").collect())
        want, ny = [], math.pi * 64 / 100 / 4
        for s, (low, high) in enumerate(((0, ny), (ny, 16 * ny), (16 * ny, math.inf))):
            rows = [r for r in t.where(f"snap = 3 and section = {s}").orderBy("k").collect() if low <= r.k <= high]
            d2 = [r.delta_squared - (r.shot if subtract else 0) for r in rows]
            if len(rows) <= 20:
                want += [(r.k, x) for r, x in zip(rows, d2)]
                continue
            edges = np.linspace(math.log10(rows[0].k), math.log10(rows[-1].k), 21)
            kept = 0
            for i in range(20):
                inside = [j for j, r in enumerate(rows) if edges[i] <= math.log10(r.k) and (math.log10(r.k) < edges[i + 1] or i == 19)]
                modes = sum(rows[j].mode_count for j in inside)
                if inside and (modes >= 8 or not kept):
                    kept += 1
                    w = [rows[j].mode_count / modes if modes else 1 / len(inside) for j in inside]
                    want.append((sum(x * rows[j].k for x, j in zip(w, inside)), sum(x * d2[j] for x, j in zip(w, inside))))
        assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, sorted(want)))
    (tmp_path / "c.txt").write_text("-1 2\n0 1\n")
    assert sorted((r.k, r.power) for r in simulation.read_log_spectrum(spark, str(tmp_path / "c.txt")).collect()) == [(0.1, 100.0), (1.0, 10.0)]


def test_sinks(spark, tmp_path):
    t = lenses.tree(spark, D)
    rows, index = trees.extract(t, 100000.0)
    simulation.write_branch_catalog(rows, index, spark.range(3), str(tmp_path / "b"), box=100.0)
    first = index.orderBy("place").first()
    branch = simulation.read_branch(spark, str(tmp_path / "b"), first.place).collect()
    assert [r.step for r in branch] == list(range(first.length)) and branch[0].node == first.root
    grid = density.cic(lenses.particles(spark, D), lenses.BOX, 4, F.col("mass"))
    simulation.write_density(grid, str(tmp_path / "d"), cells=4)
    back, header = simulation.read_density(spark, str(tmp_path / "d"))
    assert header == {"cells": 4} and sorted(back.collect()) == sorted(grid.collect())
    for snap in (2, 9):
        spark.range(3).select(F.col("id").alias("hid")).write.parquet(str(tmp_path / f"c/snapdir_{snap:03d}"))
    assert simulation.snapshots_there(spark, str(tmp_path / "c")) == [2, 9]
    assert {tuple(r) for r in simulation.catalogs(spark, str(tmp_path / "c"), "hid", "snap", "r").collect()} == {(i, s, 0.0) for i in range(3) for s in (2, 9)}


def test_overlaps_of_any_cell(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.random(3) * 20), float(rng.random() ** 4 * 3)) for i in range(200)]
    t = spark.createDataFrame(rows, "hid long, x double, y double, z double, r double")
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and math.dist(a[1:4], b[1:4]) <= a[4] + b[4]}
    for cell in (0.7, 5.0, 50.0):
        assert {tuple(sorted((r.i, r.j))) for r in halos.overlaps(t, 1.0, cell).collect()} == want


def test_leave_one_out(spark):
    rng = np.random.default_rng(8)
    rows = [(float(v), int(b)) for v, b in zip(rng.random(500) * 12 - 1, rng.integers(0, 8, 500))]
    got = {r.bin: (r.pdf, r.error) for r in stats.leave_one_out_pdf(spark.createDataFrame(rows, "v double, b int"), stats.linear_bin(F.col("v"), 0.0, 10.0, 5), F.col("b"), 5, 8, 2.0).collect()}
    for k in range(5):
        x = [sum(2 * k <= v < 2 * k + 2 for v, b in rows if b != out) / (sum(b != out for _, b in rows) * 2) for out in range(8)]
        assert got[k] == pytest.approx((np.mean(x), math.sqrt(7 / 8 * sum((v - np.mean(x)) ** 2 for v in x))))
