"""Periodic geometry, cells, and scalar physics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gravitational constant in Mpc (km/s)^2 / Msun; virial overdensity of a flat universe.
GRAVITY = 4.30091e-9
RADIUS_TYPES = {"vir": (177.653, "crit"), "200c": (200.0, "crit"), "200m": (200.0, "mean"), "500c": (500.0, "crit"), "2500c": (2500.0, "crit")}
CLASSES = ("void", "wall", "filament", "halo")


def wrap(x: Column, box: float) -> Column:
    """x in [0, box)."""
    return F.pmod(x, F.lit(float(box)))


def min_image(d: Column, box: float) -> Column:
    """The nearest periodic image of a difference; both comparisons are strict."""
    half = box / 2.0
    return F.when(d > half, d - box).when(d < -half, d + box).otherwise(d)


def periodic_distance(a: list[Column], b: list[Column], box: float) -> Column:
    return F.sqrt(sum(min_image(p - q, box) * min_image(p - q, box) for p, q in zip(a, b, strict=True)))


def cell(x: Column, box: float, n: int) -> Column:
    """Index of the cell of x, clamped to the grid."""
    return F.least(F.greatest(F.floor(x * n / box), F.lit(0)), F.lit(n - 1)).cast("int")


def tetra_volume(a, b, c, d) -> Column:
    """Volume of the tetrahedron of four corners, each a list of three columns."""
    u, v, w = ([p[i] - a[i] for i in range(3)] for p in (b, c, d))
    det = u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])
    return F.abs(det) / 6.0


def contains_open(x: Column, low: Column, span: float, box: float) -> Column:
    """x lies strictly inside (low, low + span) on a circle of length box."""
    return ((x > low) & (x < low + span)) | ((x < low) & (x < low + span - box))


def hubble_frac(z: Column, omega_m: float, omega_l: float) -> Column:
    return F.sqrt(omega_m * F.pow(1 + z, F.lit(3.0)) + omega_l)


def rho_critical(z: Column, h0: float, omega_m: float, omega_l: float) -> Column:
    h = hubble_frac(z, omega_m, omega_l) * h0
    return 3.0 * h * h / (8.0 * math.pi * GRAVITY)


def rho_mean(z: Column, h0: float, omega_m: float) -> Column:
    return F.lit(3.0 * h0 * h0 / (8.0 * math.pi * GRAVITY) * omega_m) * F.pow(1 + z, F.lit(3.0))


def reference_density(kind: str, z: Column, h0: float, omega_m: float, omega_l: float) -> Column:
    times, of = RADIUS_TYPES[kind]
    return times * (rho_critical(z, h0, omega_m, omega_l) if of == "crit" else rho_mean(z, h0, omega_m))


def mass_to_radius(mass: Column, rho: Column, a: Column) -> Column:
    return F.cbrt(mass / (4.0 / 3.0 * math.pi * rho)) / a


def radius_to_mass(radius: Column, rho: Column, a: Column) -> Column:
    return F.pow(radius * a, F.lit(3.0)) * (4.0 / 3.0 * math.pi) * rho


def gaussian_window(k: Column, r: float) -> Column:
    return F.exp(-(k * k) * (r * r / 2.0))


def tophat_window(k: Column, r: float) -> Column:
    x = k * r
    return F.when(x <= 1e-10, 1.0).otherwise(3.0 * (F.sin(x) - x * F.cos(x)) / (x * x * x))


def cubic_kernel_3d(q: Column, h: float) -> Column:
    """Cubic spline of support 2h, normalised to one; q is the distance over h."""
    two = F.greatest(2.0 - q, F.lit(0.0))
    one = F.greatest(1.0 - q, F.lit(0.0))
    return (0.25 * two * two * two - one * one * one) / (math.pi * h**3)


def cubic_kernel_2d(q: Column, h: float) -> Column:
    two = F.greatest(2.0 - q, F.lit(0.0))
    one = F.greatest(1.0 - q, F.lit(0.0))
    return (0.25 * two * two * two - one * one * one) * (10.0 / (7.0 * math.pi * h * h))


def zmajor_to_xmajor(pid: Column, n: int) -> Column:
    x, y, z = F.floor(pid / (n * n)), F.floor(pid / n) % n, pid % n
    return (x + y * n + z * n * n).cast("long")


def snapshot_number(name: Column) -> Column:
    """The snapshot in names such as snapshot_034.1.hdf5 or snapdir_034/..., -1 without one."""
    found = F.regexp_extract(name, r"snap(?:shot|dir)_([0-9]+)", 1)
    return F.when(found == "", -1).otherwise(found.cast("int"))


def grid_size(count: Column) -> Column:
    """The side of a cubic lattice of so many sites; null if they are no cube."""
    side_ = F.round(F.cbrt(count.cast("double"))).cast("long")
    return F.when(side_ * side_ * side_ == count, side_)


def infer_grid_size(count: int) -> int:
    side_ = round(count ** (1 / 3))
    if side_**3 != count:
        raise ValueError(f"{count} particles don't fill a cubic lattice")
    return side_


# Vectors are lists of three columns.


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


# Blocks of cells are an origin and a width along each axis.


def blocks_meet(origin_a, width_a, origin_b, width_b, cells: int) -> Column:
    """Whether two blocks of a periodic grid meet: along every axis the narrower one (of equal ones the second) begins inside the
    other or ends there, the cell after its last one counted as its end."""
    out = F.lit(True)
    for oa, wa, ob, wb in zip(origin_a, width_a, origin_b, width_b, strict=True):
        first = wa < wb
        o, w = F.when(first, oa).otherwise(ob), F.when(first, wa).otherwise(wb)
        o_big, w_big = F.when(first, ob).otherwise(oa), F.when(first, wb).otherwise(wa)
        out = out & ((F.pmod(o + w - o_big, F.lit(cells)) < w_big) | (F.pmod(o - o_big, F.lit(cells)) < w_big))
    return out


def blocks_meet_unbounded(origin_a, width_a, origin_b, width_b) -> Column:
    out = F.lit(True)
    for oa, wa, ob, wb in zip(origin_a, width_a, origin_b, width_b, strict=True):
        out = out & (oa < ob + wb) & (ob < oa + wa)
    return out


def in_cells(x: Column, origin: Column, cells: int, box: float) -> Column:
    """A coordinate in cell units from a block's origin on, wrapped once."""
    v = x * (cells / box) - origin
    return F.when(v < 0, v + cells).otherwise(v)


def linear_index(ix: Column, iy: Column, iz: Column, n: int) -> Column:
    return ix + n * (iy + n * iz)


def coordinates(index: Column, n: int) -> list[Column]:
    return [(index % n).cast("int"), (F.floor(index / n) % n).cast("int"), F.floor(index / (n * n)).cast("int")]


def barycentre(points) -> list[Column]:
    return [(points[0][i] + points[1][i] + points[2][i] + points[3][i]) / 4.0 for i in range(3)]


def cell_bounds(points, width: float) -> tuple[list[Column], list[Column]]:
    """First cells and numbers of cells of the smallest block that holds the points."""
    low = [F.floor(F.least(*[p[i] for p in points]) / width) for i in range(3)]
    high = [F.floor(F.greatest(*[p[i] for p in points]) / width) for i in range(3)]
    return low, [b - a + 1 for a, b in zip(low, high, strict=True)]


def in_tetra(p, a, b, c, d, eps: float = 1e-9) -> Column:
    """Whether the volumes that a point spans with the four faces add up to the tetrahedron's."""
    whole = tetra_volume(a, b, c, d)
    parts = tetra_volume(p, b, c, d) + tetra_volume(a, p, c, d) + tetra_volume(a, b, p, d) + tetra_volume(a, b, c, p)
    return F.abs(parts - whole) <= eps * whole


def intervals_meet(a: Column, span_a, b: Column, span_b, box: float) -> Column:
    """Whether open intervals on a circle overlap."""
    return contains_open(a, b, span_b, box) | contains_open(b, a, span_a, box) | (a == b)


# Sizes and methods that a run chooses before it begins.


def mean_density(count: int, mass: float, box: float) -> float:
    return count * mass / box**3


def mean_surface_density(count: int, mass: float, box: float, thickness: float | None = None) -> float:
    return mean_density(count, mass, box) * (box if thickness is None else thickness)


def physical_grid_size(box: float, a: float, cell: float, least: int = 8, most: int = 4096) -> tuple[int, float]:
    """Cells a side for a physical cell size, and the size that they get."""
    n = max(least, min(most, round(a * box / cell)))
    return n, a * box / n


def recommended_grid(count: int, box: float, softening: float | None = None, per_cell: int = 20, power_of_two: bool = True) -> dict:
    """The largest grid that leaves enough particles in a cell and cells of eight softening lengths."""
    side_ = round(count ** (1 / 3))
    by_count = math.floor((count / per_cell) ** (1 / 3) + 1e-9)
    by_force = math.floor(box / (8 * softening) + 1e-9) if softening else side_
    most = min(by_count, by_force, side_)
    n = max(most, 1) if not power_of_two or most < 16 else 1 << (most.bit_length() - 1)
    one = (n / side_) ** 3
    told = [] if most >= 16 else [f"the grid is small ({most})"]
    told += [f"{count / n**3:.1f} particles a cell"] if count / n**3 < 10 else []
    told += ["cells of less than eight softening lengths"] if softening and box / n < 8 * softening else []
    return {"n_grid": n, "cell_width": box / n, "particles_per_cell": count / n**3, "rho_one": one, "rho_reliable_min": per_cell * one, "n_grid_max": most, "binding": "particles" if by_count <= by_force else "softening", "warnings": told}


def recommended_method(a: float, smooth_from: float = 5.0, sph_from: float = 10.0) -> str:
    return "tessellation" if a < smooth_from else "smoothed" if a < sph_from else "sph"


def smoothing_length(count: int, box: float, neighbours: int = 32) -> float:
    """The radius of a sphere that holds so many particles at the mean density."""
    return box / count ** (1 / 3) * (neighbours / (4.0 / 3.0 * math.pi)) ** (1 / 3)


def box_params(x: Column, mode: str, width: float, r200: Column, a: Column, box: float) -> tuple[Column, Column]:
    """Width of a halo's box by mode (comoving, r200, physical) and its wrapped lower corner along an axis."""
    w = {"comoving": F.lit(float(width)), "r200": r200 * width, "physical": F.lit(float(width)) / a}[mode]
    return w, wrap(x - w / 2, box)


# What a quantity of a cell is: (needs velocities, can be projected, is a vector).
QUANTITIES = {"density": (False, True, False), "density_gradient": (False, False, True), "velocity": (True, True, True), "velocity_divergence": (True, False, False), "velocity_curl": (True, False, True)}


def overdensity_physical(od: Column, a: float, h: float = 0.7, omega_m: float = 0.3) -> Column:
    """Overdensity to physical density (solar masses per cubic Mpc) at scale factor a."""
    rho = 3.0 * (100.0 * h) ** 2 / (8.0 * math.pi * GRAVITY) * omega_m
    return od * rho / a**3


# Kernels of compact support: q is the distance over h; support is 2 h (quintic: 3 h), normalised to one in space.


def _power(x: Column, k: int) -> Column:
    out = x
    for _ in range(k - 1):
        out = out * x
    return out


def wendland_c2_3d(q: Column, h: float) -> Column:
    u = F.greatest(1.0 - q / 2.0, F.lit(0.0))
    return _power(u, 4) * (1.0 + 2.0 * q) * (21.0 / (16.0 * math.pi * h**3))


def wendland_c4_3d(q: Column, h: float) -> Column:
    u = F.greatest(1.0 - q / 2.0, F.lit(0.0))
    return _power(u, 6) * (1.0 + 3.0 * q + 35.0 / 12.0 * q * q) * (495.0 / (256.0 * math.pi * h**3))


def quintic_3d(q: Column, h: float) -> Column:
    part = lambda k: _power(F.greatest(k - q, F.lit(0.0)), 5)
    return (part(3.0) - 6.0 * part(2.0) + 15.0 * part(1.0)) * (1.0 / (120.0 * math.pi * h**3))


KERNELS = {"cubic": (cubic_kernel_3d, 2.0), "wendland_c2": (wendland_c2_3d, 2.0), "wendland_c4": (wendland_c4_3d, 2.0), "quintic": (quintic_3d, 3.0)}


def projected(kernel: str, q: Column, h: float, steps: int = 64) -> Column:
    """A kernel summed along the line of sight by midpoints; q is the distance from the line over h."""
    f, support = KERNELS[kernel]
    dz = 2.0 * support / steps
    total = F.lit(0.0)
    for k in range(steps // 2):  # both halves are alike
        z = (k + 0.5) * dz
        total = total + 2.0 * f(F.sqrt(q * q + z * z), h)
    return total * (dz * h)
