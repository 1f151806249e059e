"""Ordered series: derivatives, interpolation, splines, images of time, quasi-random sequences."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deriv(df: DataFrame, by: str, x: str, y: str, order: int = 2) -> DataFrame:
    """Adds ``slope``: dy/dx of each ordered series, by central differences of second or fourth order; its ends look inwards.

    A series is a branch or a profile: its rows meet in one window. Series of less than order + 1 rows have null slopes."""
    w = Window.partitionBy(by).orderBy(x)
    n, i = F.count("*").over(Window.partitionBy(by)), F.row_number().over(w) - 1
    ahead = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k < 0 else F.col(c)
    dy = lambda terms: sum(c * ahead(y, k) for k, c in terms.items())
    if order == 0:
        return df.withColumn("slope", F.col(y))
    if order == 2:
        out = F.when(i == 0, dy({0: -3.0, 1: 4.0, 2: -1.0}) / (ahead(x, 2) - ahead(x, 0)))
        out = out.when(i == n - 1, dy({0: 3.0, -1: -4.0, -2: 1.0}) / (ahead(x, 0) - ahead(x, -2)))
        out = out.otherwise(dy({1: 1.0, -1: -1.0}) / (ahead(x, 1) - ahead(x, -1)))
        return df.withColumn("slope", F.when(n >= 3, out))
    first, second = {0: -25.0, 1: 48.0, 2: -36.0, 3: 16.0, 4: -3.0}, {-1: -3.0, 0: -10.0, 1: 18.0, 2: -6.0, 3: 1.0}
    back = lambda terms: {-k: c for k, c in terms.items()}
    out = F.when(i == 0, dy(first) / (3.0 * (ahead(x, 4) - ahead(x, 0)))).when(i == 1, dy(second) / (3.0 * (ahead(x, 3) - ahead(x, -1))))
    out = out.when(i == n - 1, dy(back(first)) / (3.0 * (ahead(x, -4) - ahead(x, 0)))).when(i == n - 2, dy(back(second)) / (3.0 * (ahead(x, -3) - ahead(x, 1))))
    out = out.otherwise(dy({2: -1.0, 1: 8.0, -1: -8.0, -2: 1.0}) / (3.0 * (ahead(x, 2) - ahead(x, -2))))
    return df.withColumn("slope", F.when(n >= 5, out))


def even_gradient(df: DataFrame, by: str, x: str, y: str, dx: float) -> DataFrame:
    """Adds ``gradient`` of evenly spaced series; the ends take one-sided differences."""
    w = Window.partitionBy(by).orderBy(x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    both = (F.coalesce(after, F.col(y)) - F.coalesce(before, F.col(y))) / (F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0) * dx)
    return df.withColumn("gradient", F.when(before.isNull() & after.isNull(), None).otherwise(both))


def second_derivatives(xs: list[float], ys: list[float]) -> list[float]:
    """Of the natural cubic spline through the points: a tridiagonal system, eliminated forwards and solved backwards."""
    n = len(xs)
    if n < 3:
        raise ValueError("a spline needs three points")
    diagonal, right = [0.0] * n, [0.0] * n
    for k in range(1, n - 1):
        a, b = xs[k] - xs[k - 1], xs[k + 1] - xs[k]
        rhs = 6.0 * ((ys[k + 1] - ys[k]) / b - (ys[k] - ys[k - 1]) / a)
        diagonal[k] = 2.0 * (a + b) - (a * a / diagonal[k - 1] if k > 1 else 0.0)
        right[k] = rhs - (a / diagonal[k - 1] * right[k - 1] if k > 1 else 0.0)
    out = [0.0] * n
    for k in range(n - 2, 0, -1):
        out[k] = (right[k] - (xs[k + 1] - xs[k]) * out[k + 1]) / diagonal[k]
    return out


def interpolated(x: Column, xs: list[float], ys: list[float], spline: bool = False) -> Column:
    """A table's value at ``x``, linear or by the natural cubic spline; beyond its ends the last pieces go on.

    For tables that are parameters (a power spectrum, a growth function): their numbers stand in the expression."""
    if len(xs) < 2 or len(xs) != len(ys):
        raise ValueError("two points or more, with as many values")
    y2 = second_derivatives(xs, ys) if spline else [0.0] * len(xs)
    table = F.array(*[F.array(*map(F.lit, (float(a), float(b), float(ya), float(yb), sa, sb))) for a, b, ya, yb, sa, sb in zip(xs, xs[1:], ys, ys[1:], y2, y2[1:])])
    place = sum((x >= float(v)).cast("int") for v in xs[1:-1]) if len(xs) > 2 else F.lit(0)
    p = F.get(table, place)
    h = p[1] - p[0]
    a, b = (p[1] - x) / h, (x - p[0]) / h
    return a * p[2] + b * p[3] + ((a * a * a - a) * p[4] + (b * b * b - b) * p[5]) * (h * h) / 6.0


def bilinear(points: DataFrame, grid: DataFrame, width: float) -> DataFrame:
    """pid and value of a map (i, j, value) with nodes at index x width, at points (pid, x, y); the last cells go on beyond the ends."""
    n = grid.agg(F.max("i").alias("mi"), F.max("j").alias("mj"))  # one row
    at = points.join(F.broadcast(n))
    for a, c, m in (("x", "i", "mi"), ("y", "j", "mj")):
        at = at.withColumn(f"{c}0", F.least(F.greatest(F.floor(F.col(a) / width), F.lit(0)), F.col(m) - 1).cast("int")).withColumn(f"t{a}", F.col(a) / width - F.col(f"{c}0"))
    corners = [F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), ((F.col("tx") if a else 1.0 - F.col("tx")) * (F.col("ty") if b else 1.0 - F.col("ty"))).alias("w")) for a in (0, 1) for b in (0, 1)]
    rows = at.select("pid", F.explode(F.array(*corners)).alias("c")).select("pid", "c.*")
    return rows.join(grid, ["i", "j"]).groupBy("pid").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def time_image(maps: DataFrame, times: list[tuple[int, float]], width: int, log_time: bool = False, physical: bool = False, eps: float = 1e-10) -> DataFrame:
    """column, pixel, value: maps (snap, pixel, value) of several times side by side, each column between the two times around it, by logarithms.

    times: (snapshot, scale factor) of the outputs, ascending. With ``physical`` values are divided by the cube of the scale factor."""
    a = [t for _, t in times]
    rows = []
    for k in range(width):
        part = k / max(1, width - 1)
        at = math.exp(math.log(a[0]) + part * (math.log(a[-1]) - math.log(a[0]))) if log_time else a[0] + part * (a[-1] - a[0])
        j = min(max(bisect_right(a, at) - 1, 0), len(a) - 2)
        t = min(max((at - a[j]) / (a[j + 1] - a[j]), 0.0), 1.0)
        rows += [(k, times[j][0], 1.0 - t, at), (k, times[j + 1][0], t, at)]
    wanted = maps.sparkSession.createDataFrame(rows, "column int, snap int, w double, a double")  # two rows for each column of the image
    parts = maps.select("snap", "pixel", F.log(F.greatest("value", F.lit(eps))).alias("v")).join(F.broadcast(wanted), "snap")
    value = F.exp(F.sum(F.col("v") * F.col("w")))
    return parts.groupBy("column", "pixel").agg((value / F.pow(F.first("a"), F.lit(3.0)) if physical else value).alias("value"))


def relative(maps: DataFrame, reference: int | None = None) -> DataFrame:
    """Maps (snap, pixel, value) over the mean of their own snapshot, or of the reference one: a row for each snapshot is joined back."""
    means = maps.groupBy("snap").agg(F.avg("value").alias("mean"))
    if reference is None:
        both = maps.join(means, "snap")
    else:
        both = maps.join(F.broadcast(means.where(F.col("snap") == reference).select("mean")))  # one row
    return both.select("snap", "pixel", (F.col("value") / F.col("mean")).alias("value"))


# Degrees, primitive polynomials and first direction numbers of the quasi-random sequence, by dimension.
DEGREES = (1, 2, 3, 3, 4, 4)
POLYNOMIALS = (0, 1, 1, 2, 1, 4)
FIRST = ((1,), (1, 1), (1, 3, 7), (1, 3, 3), (1, 1, 3, 13), (1, 1, 5, 9))
BITS = 30


def directions(dim: int) -> list[int]:
    """The direction numbers of a dimension, one for each bit."""
    deg, poly = DEGREES[dim], POLYNOMIALS[dim]
    out = [m << (BITS - k - 1) for k, m in enumerate(FIRST[dim])]
    for k in range(deg, BITS):
        v = out[k - deg] ^ (out[k - deg] >> deg)
        for j in range(1, deg):
            if poly >> (deg - 1 - j) & 1:
                v ^= out[k - j]
        out.append(v)
    return out


def sobol(index: Column, dim: int) -> Column:
    """The coordinate of point ``index`` (from 1) in a dimension below six: direction numbers of the bits of a Gray code, added without carry.

    The first point is the sequence's third, moved by the first direction. Any point is computed from its index alone, so a
    sequence needs no order and no state."""
    k = index.cast("long") + 1
    gray = k.bitwiseXOR(F.shiftright(k, 1)).bitwiseXOR(F.lit(1).cast("long"))
    total = F.lit(0).cast("long")
    for bit, v in enumerate(directions(dim)):
        total = total.bitwiseXOR(F.when(F.shiftright(gray, bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")))
    return total / float(1 << BITS)


def uniform(key: Column, seed: int = 0) -> Column:
    """A random number in [0, 1) that depends on a key and a seed alone: the same whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)


def gaussian(key: Column, seed: int = 0) -> Column:
    u = F.greatest(uniform(key, 2 * seed), F.lit(2.0**-53))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * uniform(key, 2 * seed + 1))
