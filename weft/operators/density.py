"""Density fields: cloud-in-cell, tetrahedral, kernel-smoothed; fields on grids.

A particle's contributions are an array of its cells, exploded and summed: one shuffle with partial sums."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.geometry import KERNELS, cubic_kernel_2d, projected
from weft.operators.halos import neighbours
from weft.sources.steps import folder, written

CORNERS = tuple(itertools.product((0, 1), repeat=3))
#: Six tetrahedra fill a cell: paths from corner (0,0,0) to (1,1,1) along the axes in each order.
PATHS = tuple(itertools.permutations(range(3)))
WALKS = tuple(tuple(CORNERS.index(tuple(int(path.index(a) < step) for a in range(3))) for step in range(4)) for path in PATHS)


def cic(df: DataFrame, box: float, n: int, mass: Column, axes: str = "xyz", edges: str = "wrap") -> DataFrame:
    """Cells that get mass: their indices and density; weights are registered at cell corners.

    Beyond the last cell indices wrap, or the part is dropped ("drop"), or it stays in the last cell ("clip"). A part is a corner's number,
    a cell's number as one long, and a weight, so the sums hash one key."""
    w = box / n
    d = len(axes)
    rows = df.select(mass.cast("double").alias("mass"), *[(F.col(a) / w).alias(a) for a in axes])
    rows = rows.select("mass", *[F.floor(a).alias(f"f{a}") for a in axes], *[(F.col(a) - F.floor(a)).alias(f"p{a}") for a in axes], F.explode(F.array(*map(F.lit, range(2**d)))).alias("k"))
    weight, cell, inside = F.col("mass"), F.lit(0).cast("long"), F.lit(True)
    for j, a in enumerate(axes):
        up = F.col("k").bitwiseAND(1 << j) > 0
        weight = weight * F.when(up, F.col(f"p{a}")).otherwise(1.0 - F.col(f"p{a}"))
        i = F.col(f"f{a}") + up.cast("int")
        inside = inside & i.between(0, n - 1)
        i = F.pmod(i, F.lit(n)) if edges == "wrap" else F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)) if edges == "clip" else i
        cell = cell + i * (n**j)
    parts = rows.where(inside) if edges == "drop" else rows
    sums = parts.groupBy(cell.alias("cell")).agg((F.sum(weight) / w**d).alias("density"))
    return sums.select(*[(F.floor(F.col("cell") / n**j) % n).cast("int").alias(f"i{a}") for j, a in enumerate(axes)], "density")


def dense(grid: DataFrame, n: int, *values: str) -> DataFrame:
    """All n cubed cells: those that the sparse grid lacks have zeros."""
    k = F.col("id")
    cells = grid.sparkSession.range(n**3).select((k % n).cast("int").alias("ix"), (F.floor(k / n) % n).cast("int").alias("iy"), F.floor(k / (n * n)).cast("int").alias("iz"))
    return cells.join(grid, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def ngp(df: DataFrame, box: float, n: int, *aggs: Column) -> DataFrame:
    """Aggregates of the particles in each cell."""
    return df.groupBy(*[(F.floor(F.col(a) * n / box) % n).cast("int").alias(f"i{a}") for a in "xyz"]).agg(*aggs)


def project(grid: DataFrame, keep: tuple[str, str], width: float, low: int | None = None, high: int | None = None, axis: str = "iz") -> DataFrame:
    """Surface density of the cells with low <= axis < high (all without bounds)."""
    if low is not None:
        grid = grid.where((F.col(axis) >= low) & (F.col(axis) < high))
    return grid.groupBy(*keep).agg((F.sum("density") * width).alias("surface"))


#: Lattice sites of a tile, at most (one row of sites at least).
TILE = 1 << 20


def _tiles(particles: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Particles sent to the tiles that need them, and the rows of a tile.

    A tile is the cells of one layer in some rows: it needs the sites of two layers, and of one row more. So a particle goes to
    two tiles, or four at a tile's first row, where a gather of every cell's eight corners would send it to eight cells."""
    rows = max(1, min(n, TILE // n))
    blocks = -(-n // rows)
    block, row = F.floor(F.col("ly") / rows).cast("int"), (F.col("ly") % rows).cast("int")
    before = F.pmod(block - 1, F.lit(blocks)).cast("int")
    size = F.when(before == blocks - 1, n - (blocks - 1) * rows).otherwise(rows).cast("int")
    to = [F.struct(F.pmod(F.col("lz") - up, F.lit(n)).cast("int").alias("layer"), b.alias("block"), F.lit(up).alias("up"), r.alias("row")) for up in (0, 1) for b, r in ((block, row), (F.when(row == 0, before), size))]
    sent = F.filter(F.array(*to), lambda t: t["block"].isNotNull())
    return particles.select("pid", "lx", "x", "y", "z", F.explode(sent).alias("t")).select("pid", "lx", "x", "y", "z", "t.*"), rows


def _corners(table: pa.Table, n: int, box: float):
    """pids and places of a tile's sites as arrays (2, rows + 1, n), and the six tetrahedra of its cells: four corners' indices and edges from the first."""
    col = {c: table.column(c).to_numpy() for c in table.column_names}
    high = int(col["row"].max())
    at = (col["up"].astype(np.int64) * (high + 1) + col["row"]) * n + col["lx"]
    if len(np.unique(at)) != 2 * (high + 1) * n:
        raise ValueError(f"layer {col['layer'][0]} of the lattice lacks sites")
    place = np.empty((3, 2, high + 1, n))
    for k, a in enumerate("xyz"):
        place[k].reshape(-1)[at] = col[a]
    pid = np.empty(2 * (high + 1) * n, np.int64)
    pid[at] = col["pid"]
    corner = [np.roll(place[:, c[2], c[1] : high + c[1]], -c[0], 2) for c in CORNERS]
    index = np.arange(2 * (high + 1) * n).reshape(2, high + 1, n)
    sites = [np.roll(index[c[2], c[1] : high + c[1]], -c[0], 1) for c in CORNERS]
    tetras = []
    for walk in WALKS:
        d = [corner[k] - corner[walk[0]] for k in walk[1:]]
        tetras.append((walk, [np.where(x > box / 2, x - box, np.where(x < -box / 2, x + box, x)) for x in d]))
    return pid, corner, sites, tetras


def _volumes(n: int, box: float):
    def run(table: pa.Table) -> pa.Table:
        pid, _, sites, tetras = _corners(table, n, box)
        count, volume = np.zeros(len(pid), np.int64), np.zeros(len(pid))
        for walk, (u, v, w) in tetras:
            six = np.abs(u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0]))
            for k in walk:  # the sites of one corner are all different
                count[sites[k]] += 1
                volume[sites[k]] += six
        met = count > 0
        return pa.table({"pid": pid[met], "n_tetra": count[met], "six": volume[met]})

    return run


def tetra_vertex(particles: DataFrame, n: int, box: float) -> DataFrame:
    """pid, n_tetra, volume and density at lattice particles: 24 mass parts over a quarter of each of their tetrahedra's volumes.

    Tiles of the lattice are worked on as arrays and send partial sums for their particles. Densities are scaled so that
    their mean is that of the box, one particle a cell."""
    tiles, _ = _tiles(particles, n)
    parts = tiles.groupBy("layer", "block").applyInArrow(_volumes(n, box), "pid long, n_tetra long, six double")
    per = parts.groupBy("pid").agg(F.sum("n_tetra").alias("n_tetra"), (F.sum("six") / 24.0).alias("volume"))
    raw = F.when(F.col("volume") > 0, F.col("n_tetra") / 24.0 / F.col("volume")).otherwise(0.0)
    per = per.withColumn("raw", raw)
    mean = per.agg(F.avg("raw").alias("mean"))  # one row
    return per.join(F.broadcast(mean)).select("pid", "n_tetra", "volume", (F.col("raw") * (n**3 / box**3) / F.col("mean")).alias("density"))


def volume_stats(vertices: DataFrame) -> DataFrame:
    """One row: least (zeros as a tiny share of the least positive one), greatest, geometric mean, and deviations of the volumes and of their logarithms."""
    floor = vertices.agg((F.min(F.when(F.col("volume") > 0, F.col("volume"))) / 1e20).alias("_floor"))  # one row
    v = F.greatest("volume", "_floor")
    return vertices.join(F.broadcast(floor)).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.exp(F.avg(F.log(v))).alias("geometric_mean"), F.stddev_pop(v).alias("deviation"), F.stddev_pop(F.log(v)).alias("log_deviation"))


def sph_2d(df: DataFrame, box: float, n: int, h: float, kernel: str | None = None) -> DataFrame:
    """Kernel-smoothed surface density on n x n pixels: particles are scattered to the pixels within the kernel's support.

    Without a name the kernel is the cubic spline of the plane; with one, the projection of that kernel of space."""
    support = KERNELS[kernel][1] if kernel else 2.0
    w = box / n
    reach = int(support * h / w) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = df.select("x", "y", "mass").withColumn("i", F.explode(F.transform(steps, lambda d: F.floor(F.col("x") / w) + d))).withColumn("j", F.explode(F.transform(steps, lambda d: F.floor(F.col("y") / w) + d)))
    dx, dy = (F.col("i") + 0.5) * w - F.col("x"), (F.col("j") + 0.5) * w - F.col("y")
    rows = rows.withColumn("q", F.sqrt(dx * dx + dy * dy) / h).where(F.col("q") < support)
    weight = projected(kernel, F.col("q"), h) if kernel else cubic_kernel_2d(F.col("q"), h)
    return rows.groupBy(F.pmod("i", F.lit(n)).cast("int").alias("ix"), F.pmod("j", F.lit(n)).cast("int").alias("iy")).agg(F.sum(F.col("mass") * weight).alias("surface"))


def around(grid: DataFrame, n: int, reach: int, *values: str) -> DataFrame:
    """Cells with their own values and those of the cells up to ``reach`` away along each axis, as columns such as density_x_p1 and density_y_m2.

    The grid is periodic; cells without a row are zeros. A cell sends its values to its neighbours, and each is picked out by its
    direction, so what is made of them adds up in one order wherever it runs."""
    steps = [(a, d) for a in "xyz" for d in range(-reach, reach + 1) if d]
    sent = [F.struct(F.lit(0).alias("k"), *[F.col(f"i{a}").alias(f"t{a}") for a in "xyz"])]
    for k, (axis, d) in enumerate(steps, 1):  # the cell at +d receives what it sees at -d
        sent.append(F.struct(F.lit(k).alias("k"), *[F.pmod(F.col(f"i{a}") - (d if a == axis else 0), F.lit(n)).cast("int").alias(f"t{a}") for a in "xyz"]))
    rows = grid.select(*values, F.explode(F.array(*sent)).alias("s")).select(*values, "s.*")
    pick = lambda v, k, name: F.coalesce(F.max(F.when(F.col("k") == k, F.col(v))), F.lit(0.0)).alias(name)
    cols = [pick(v, 0, v) for v in values] + [pick(v, k, f"{v}_{a}_{'p' if d > 0 else 'm'}{abs(d)}") for v in values for k, (a, d) in enumerate(steps, 1)]
    return rows.groupBy(*[F.col(f"t{a}").alias(f"i{a}") for a in "xyz"]).agg(*cols)


def slope(value: str, axis: str, width: float, order: int = 2) -> Column:
    """The central difference of a column of ``around`` along an axis, of second or fourth order."""
    at = lambda d: F.col(f"{value}_{axis}_{'p' if d > 0 else 'm'}{abs(d)}")
    if order == 2:
        return (at(1) - at(-1)) / (2 * width)
    return (8.0 * (at(1) - at(-1)) - (at(2) - at(-2))) / (12 * width)


def gradient(grid: DataFrame, n: int, width: float, value: str = "density", order: int = 2) -> DataFrame:
    """Periodic gradient of a sparse grid, of second or fourth order."""
    return around(grid, n, order // 2, value).select("ix", "iy", "iz", *[slope(value, a, width, order).alias(f"g{a}") for a in "xyz"])


def divergence(grid: DataFrame, n: int, width: float, order: int = 2) -> DataFrame:
    """Periodic divergence of the sparse vector grid (vx, vy, vz)."""
    near = around(grid, n, order // 2, "vx", "vy", "vz")
    return near.select("ix", "iy", "iz", (slope("vx", "x", width, order) + slope("vy", "y", width, order) + slope("vz", "z", width, order)).alias("divergence"))


def curl(grid: DataFrame, n: int, width: float, order: int = 2) -> DataFrame:
    near = around(grid, n, order // 2, "vx", "vy", "vz")
    d = lambda v, a: slope(v, a, width, order)
    return near.select("ix", "iy", "iz", (d("vz", "y") - d("vy", "z")).alias("cx"), (d("vx", "z") - d("vz", "x")).alias("cy"), (d("vy", "x") - d("vx", "y")).alias("cz"))


def edged_slope(grid: DataFrame, n: int, width: float, axis: str = "x", value: str = "density") -> DataFrame:
    """Second-order differences along an axis of a grid that doesn't wrap: the first and last cells look inwards. Needs n >= 3."""
    others = [f"i{a}" for a in "xyz" if a != axis]
    w = Window.partitionBy(*others).orderBy(f"i{axis}")  # a line of n cells
    at = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
    i = F.col(f"i{axis}")
    d = F.when(i == 0, -3.0 * at(0) + 4.0 * at(1) - at(2)).when(i == n - 1, 3.0 * at(0) - 4.0 * at(-1) + at(-2)).otherwise(at(1) - at(-1))
    return dense(grid, n, value).select("ix", "iy", "iz", (d / (2 * width)).alias("slope"))


def samples(count: int) -> list[tuple[float, ...]]:
    """Weights of the four corners at ``count`` even points of a tetrahedron, in steps of 1/1024.

    An additive recurrence fills the cube; points outside the tetrahedron at the origin fold into it."""
    base, out = 1.2207440846057596, []
    for k in range(count):
        s, t, u = (round((0.5 + (k + 1) * base**-i) % 1 * 1024) / 1024 for i in (1, 2, 3))
        if s + t > 1:
            s, t = 1 - s, 1 - t
        if s + t + u > 1:
            s, t, u = (s, 1 - u, 1 - s - t) if t + u > 1 else (1 - t - u, t, s + t + u - 1)
        out.append((1 - s - t - u, s, t, u))
    return out


def _scatter(n: int, box: float, cells: int, pool: list[tuple[float, ...]], axis: str | None, low: float, high: float):
    def run(table: pa.Table) -> pa.Table:
        _, corner, _, tetras = _corners(table, n, box)
        keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for walk, (u, v, w) in tetras:
            o = corner[walk[0]]
            found = []
            for _w0, s, t, r in pool:
                p = [o[k] + s * u[k] + t * v[k] + r * w[k] for k in range(3)]
                i = [np.floor(x * cells / box).astype(np.int64) % cells for x in p]
                cell = (i[0] + cells * (i[1] + cells * i[2])).ravel()
                if axis is not None:
                    along = p["xyz".index(axis)] % box
                    cell = cell[((along >= low) & (along < high)).ravel()]
                found.append(cell)
            # Cells and counts so far stay sorted sums: a tile meets few cells more than it has sites.
            some = np.unique(np.concatenate(found), return_counts=True)
            ids, inv = np.unique(np.concatenate((keys[0], some[0])), return_inverse=True)
            keys = ids, np.bincount(inv, np.concatenate((keys[1], some[1])), len(ids)).astype(np.int64)
        return pa.table({"cell": keys[0], "n": keys[1]})

    return run


def tetra_density(particles: DataFrame, n: int, box: float, cells: int, count: int, mass: float = 1.0, axis: str | None = None, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Cells met by sample points of the lattice's tetrahedra: their number of points and density; each tetrahedron spreads a sixth of a mass.

    With an axis only points at low <= place < high along it count: a slice without the whole grid. Tiles send a count for each cell."""
    tiles, _ = _tiles(particles, n)
    parts = tiles.groupBy("layer", "block").applyInArrow(_scatter(n, box, cells, samples(count), axis, low, high), "cell long, n long")
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    at = [(F.floor(F.col("cell") / cells**j) % cells).cast("int").alias(f"i{a}") for j, a in enumerate("xyz")]
    return sums.select(*at, "n", (F.col("n") * (mass / (6 * count) / (box / cells) ** 3)).alias("density"))


def direct_slice(particles: DataFrame, n: int, box: float, cells: int, count: int, axis: str = "z", low: float = 0.0, high: float = -1.0, mass: float = 1.0) -> DataFrame:
    """Surface density of the sample points in a slice (a tenth of the box where ``high`` is negative)."""
    high = low + 0.1 * box if high < 0 else high
    keep = [f"i{a}" for a in "xyz" if a != axis]
    return tetra_density(particles, n, box, cells, count, mass, axis, low, high).groupBy(*keep).agg((F.sum("density") * (box / cells)).alias("surface"))


#: Cells of a grid that goes to every task as one array, at most (2 MB).
FIELD = 1 << 18


def sample(particles: DataFrame, grid: DataFrame, box: float, n: int, shift: float = 0.0) -> DataFrame:
    """pid and the trilinear density at each particle; nodes lie at (index + shift) x width, missing cells are zeros.

    A small grid is sent to the particles as one array, so these are not shuffled; for a larger one each particle's corners meet their cells by a join."""
    w = box / n
    at = {a: F.col(a) / w - shift for a in "xyz"}
    corners = []
    for corner in CORNERS:
        weight = F.lit(1.0)
        for a, c in zip("xyz", corner, strict=True):
            part = at[a] - F.floor(at[a])
            weight = weight * (part if c else 1.0 - part)
        corners.append(([F.pmod(F.floor(at[a]) + c, F.lit(n)).cast("int").alias(f"i{a}") for a, c in zip("xyz", corner, strict=True)], weight))
    if n**3 <= FIELD:
        number = lambda i: i[0] + n * (i[1] + n * i[2])
        cells = F.array_sort(F.collect_list(F.struct(number([F.col(f"i{a}") for a in "xyz"]).alias("cell"), "density")))
        field = dense(grid, n, "density").agg(cells["density"].alias("_field"))  # one row
        total = sum(weight * F.col("_field")[number(i)] for i, weight in corners)
        return particles.join(F.broadcast(field)).select("pid", total.alias("density"))
    rows = particles.select("pid", F.explode(F.array(*[F.struct(*i, weight.alias("w")) for i, weight in corners])).alias("c")).select("pid", "c.*")
    joined = rows.join(grid.select("ix", "iy", "iz", "density"), ["ix", "iy", "iz"], "left")
    return joined.groupBy("pid").agg(F.sum(F.col("w") * F.coalesce("density", F.lit(0.0))).alias("density"))


def sph_3d(df: DataFrame, box: float, n: int, h: float, kernel: str = "cubic") -> DataFrame:
    """Kernel-smoothed density on n cubed cells, scattered as in sph_2d."""
    value, support = KERNELS[kernel]
    w = box / n
    reach = int(support * h / w) + 1
    rows = df.select("x", "y", "z", "mass")
    d2 = F.lit(0.0)
    for a in "xyz":
        first = F.floor(F.col(a) / w)
        rows = rows.withColumn(f"i{a}", F.explode(F.sequence(first - reach, first + reach)))
        off = (F.col(f"i{a}") + 0.5) * w - F.col(a)
        rows = rows.where(F.abs(off) < support * h)  # before the next axis multiplies rows
        d2 = d2 + off * off
    rows = rows.withColumn("q", F.sqrt(d2) / h).where(F.col("q") < support)
    return rows.groupBy(*[F.pmod(f"i{a}", F.lit(n)).cast("int").alias(f"i{a}") for a in "xyz"]).agg(F.sum(F.col("mass") * value(F.col("q"), h)).alias("density"))


def knn(particles: DataFrame, box: float, k: int, start: float | None = None) -> DataFrame:
    """pid, h (distance of the k-th nearest other particle, periodic) and the number of rounds' radius that found it.

    A sphere of the usual size is searched first; particles with fewer than k others in it are searched again with twice the
    radius, so few particles see many candidates. Ends when all have k, or the sphere holds the box."""
    total = particles.count()
    radius = start or 1.3 * box * ((k + 1) / max(1, total) / (4.0 / 3.0 * np.pi)) ** (1 / 3)
    todo, out = particles.select(F.col("pid").alias("cid"), "x", "y", "z"), None
    path, turn = folder(particles.sparkSession), 0
    while True:
        near = neighbours(particles, todo, radius, box).where("cid <> pid")
        rank = F.row_number().over(Window.partitionBy("cid").orderBy("distance", "pid"))
        met = near.withColumn("at", rank).where(F.col("at") == k).select(F.col("cid").alias("pid"), F.col("distance").alias("h"))
        met = written(met, f"{path}/met{turn}")
        out = met if out is None else out.unionByName(met)
        todo = written(todo.join(met.select(F.col("pid").alias("cid")), "cid", "left_anti"), f"{path}/todo{turn}")
        if todo.isEmpty() or radius > box:
            return out
        radius, turn = 2 * radius, turn + 1


def local_density(particles: DataFrame, box: float, k: int = 32, mass: float = 1.0) -> DataFrame:
    """pid, h and the density of k masses in the sphere that reaches the k-th neighbour."""
    return knn(particles, box, k).select("pid", "h", F.try_divide(F.lit(k * mass), F.lit(4.0 / 3.0 * np.pi) * F.pow("h", F.lit(3.0))).alias("density"))


def sph_adaptive(particles: DataFrame, box: float, n: int, k: int = 32, mass: float = 1.0) -> DataFrame:
    """Density on n cubed cells with each particle's own h: half the distance of its k-th neighbour, at least half a cell's diagonal."""
    w = box / n
    least = 3**0.5 / 2 * w / 2 * 1.0000001  # the kernel reaches 2 h: some cell's middle lies within it
    rows = particles.join(knn(particles, box, k), "pid").select("x", "y", "z", F.greatest(F.col("h") / 2, F.lit(least)).alias("h"))
    d2 = F.lit(0.0)
    for a in "xyz":
        span = F.sequence(F.floor((F.col(a) - 2 * F.col("h")) / w), F.floor((F.col(a) + 2 * F.col("h")) / w))
        rows = rows.withColumn(f"i{a}", F.explode(span))
        off = (F.col(f"i{a}") + 0.5) * w - F.col(a)
        rows = rows.where(F.abs(off) < 2 * F.col("h"))
        d2 = d2 + off * off
    q = F.sqrt(d2) / F.col("h")
    two, one = F.greatest(2.0 - q, F.lit(0.0)), F.greatest(1.0 - q, F.lit(0.0))
    weight = (0.25 * two * two * two - one * one * one) / (np.pi * F.col("h") * F.col("h") * F.col("h"))
    return rows.groupBy(*[F.pmod(f"i{a}", F.lit(n)).cast("int").alias(f"i{a}") for a in "xyz"]).agg(F.sum(weight * mass).alias("density")).where("density > 0")
