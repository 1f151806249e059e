"""Fourier transforms of grids, plane by plane, and filters of fields."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.geometry import gaussian_window, tophat_window

SCHEMA = "ix int, iy int, iz int, re double, im double"


def _pencils(axes: tuple[str, ...], across: str, n: int, inverse: bool):
    """Transforms along ``axes`` of the plane of an index of ``across``."""

    def run(table: pa.Table) -> pa.Table:
        u, v = (a for a in ("ix", "iy", "iz") if a != across)
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        plane = np.zeros((n, n), complex)
        plane[col[u], col[v]] = col["re"] + 1j * col["im"]
        f = np.fft.ifft if inverse else np.fft.fft
        for a in axes:
            plane = f(plane, axis=0 if a == u else 1)
        i, j = (x.ravel().astype(np.int32) for x in np.indices((n, n)))
        out = {u: i, v: j, across: np.full(n * n, col[across][0], np.int32), "re": plane.real.ravel(), "im": plane.imag.ravel()}
        return pa.table({c: out[c] for c in ("ix", "iy", "iz", "re", "im")})

    return run


def transform(field: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The transform of a sparse field (ix, iy, iz, re, im); cells without a row are zeros.

    Planes across z take both of their axes, then planes across x the third: two shuffles, and groups of n x n cells (a plane
    without any cell has no group in the first pass, and is zeros in the second)."""
    field = field.groupBy("iz").applyInArrow(_pencils(("ix", "iy"), "iz", n, inverse), SCHEMA)
    return field.groupBy("ix").applyInArrow(_pencils(("iz",), "ix", n, inverse), SCHEMA)


def as_field(grid: DataFrame, value: str = "density") -> DataFrame:
    return grid.select("ix", "iy", "iz", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))


def mode(i: Column, n: int) -> Column:
    """Signed wave number of an index."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n)


def mode2(n: int) -> Column:
    return sum(mode(F.col(f"i{a}"), n) * mode(F.col(f"i{a}"), n) for a in "xyz")


def _cic_window(n: int) -> Column:
    out = F.lit(1.0)
    for a in "xyz":
        x = mode(F.col(f"i{a}"), n) * (math.pi / n)
        s = F.when(x == 0, 1.0).otherwise(F.sin(x) / x)
        out = out * s * s
    return out


def power_spectrum(overdensity: DataFrame, n: int, box: float, bins: int | None = None, deconvolve: bool = False, shot_noise: float = 0.0) -> DataFrame:
    """bin, n_modes, k and power in linear shells of [0, Nyquist); modes whose window is small count with power 0."""
    bins = bins or n // 2
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * (box**3 / float(n) ** 6)
    if deconvolve:
        w = _cic_window(n)
        p = F.when(w > 0.01, p / (w * w)).otherwise(0.0)
    k = F.sqrt(mode2(n).cast("double"))
    modes = transform(as_field(overdensity, "od"), n).select(F.floor(k * (2.0 * bins / n)).cast("int").alias("bin"), k.alias("m"), p.alias("p")).where(F.col("bin") < bins)
    out = modes.groupBy("bin").agg(F.count("*").alias("n_modes"), (F.avg("m") * (2 * math.pi / box)).alias("k"), (F.avg("p") - shot_noise).alias("power"))
    return out.withColumn("delta_squared", F.pow("k", F.lit(3.0)) * F.col("power") / (2 * math.pi**2))


def smooth(grid: DataFrame, n: int, box: float, radius: float, window: str = "gaussian", value: str = "density") -> DataFrame:
    """The field convolved with a window of the radius, on all n cubed cells."""
    k = F.sqrt(mode2(n).cast("double")) * (2 * math.pi / box)
    w = (gaussian_window if window == "gaussian" else tophat_window)(k, radius)
    modes = transform(as_field(grid, value), n).select("ix", "iy", "iz", (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))
    return transform(modes, n, True).select("ix", "iy", "iz", F.col("re").alias(value))


def weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def blur(grid: DataFrame, n: int, sigma: float, value: str = "density") -> DataFrame:
    """Separable Gaussian filter with mirrored edges; a cell and its two mirror images send to the cells in reach (reach < n)."""
    ws = weights(sigma)
    reach = len(ws) // 2
    for axis in ("ix", "iy", "iz"):
        others = [a for a in ("ix", "iy", "iz") if a != axis]
        i = F.col(axis)
        sent = [F.struct((image + d).cast("int").alias("to"), F.lit(ws[d + reach]).alias("w")) for image in (i, -i - 1, 2 * n - 1 - i) for d in range(-reach, reach + 1)]
        rows = grid.select(*others, value, F.explode(F.array(*sent)).alias("s")).where(F.col("s.to").between(0, n - 1))
        grid = rows.groupBy(*others, F.col("s.to").alias(axis)).agg(F.sum(F.col(value) * F.col("s.w")).alias(value))
    return grid.select("ix", "iy", "iz", value)


def repaired(grid: DataFrame, n: int, value: str = "density", count: str = "n", threshold: int = 2) -> DataFrame:
    """A dense grid in which cells with few particles get the mean of the 27 cells around them (mirrored at the edges); ``count`` stays."""
    mean = grid
    for axis in ("ix", "iy", "iz"):
        others = [a for a in ("ix", "iy", "iz") if a != axis]
        i = F.col(axis)
        sent = [F.struct(F.least(F.greatest(i + d, F.lit(0)), F.lit(n - 1)).cast("int").alias("to"), ((i + d) >= 0).alias("low"), ((i + d) < n).alias("high")) for d in (-1, 0, 1)]
        # A cell beyond the edge mirrors to the edge cell itself, which so counts twice there.
        rows = mean.select(*others, value, i.alias("i"), F.explode(F.array(*sent)).alias("s"))
        inside = F.when(F.col("s.low") & F.col("s.high"), F.col(value)).otherwise(0.0)
        edge = F.when(~(F.col("s.low") & F.col("s.high")), F.col(value)).otherwise(0.0)
        mean = rows.groupBy(*others, F.col("s.to").alias(axis)).agg(((F.sum(inside) + F.sum(edge)) / 3.0).alias(value))
    both = grid.join(mean.withColumnRenamed(value, "_mean"), ["ix", "iy", "iz"])
    return both.select("ix", "iy", "iz", F.when(F.col(count) < threshold, F.col("_mean")).otherwise(F.col(value)).alias(value), count)


def same_mass(after: DataFrame, before: DataFrame, value: str = "density") -> DataFrame:
    """``after`` scaled to the sum of ``before``, if that is above 0."""
    ratio = before.agg(F.sum(value).alias("_a")).join(after.agg(F.sum(value).alias("_b")))  # one row
    scale = F.when((F.col("_a") > 0) & (F.col("_b") != 0), F.col("_a") / F.col("_b")).otherwise(1.0)
    return after.join(F.broadcast(ratio)).select("ix", "iy", "iz", (F.col(value) * scale).alias(value))


def smoothed(grid: DataFrame, n: int, sigma: float, value: str = "density", count: str | None = None, threshold: int = 2) -> DataFrame:
    """Gaussian smoothing of a dense grid: cells of few particles repaired first (with ``count``), the mass kept."""
    start = repaired(grid, n, value, count, threshold) if count else grid
    return same_mass(blur(start, n, sigma, value), grid, value)


def adaptively_smoothed(grid: DataFrame, n: int, low: float = 0.5, high: float = 3.0, scales: int = 5, threshold: int = 2, saturation: int = 100, value: str = "density", count: str = "n") -> DataFrame:
    """A dense grid blended between ``scales`` Gaussian filters: cells with few particles get the widest, those with many the narrowest, by the logarithm of the count; the mass kept."""
    sigmas = [low + (high - low) * k / (scales - 1) for k in range(scales)]
    base, span = math.log(threshold + 1), math.log(saturation + 1) - math.log(threshold + 1)
    t = (F.log(F.least(F.greatest(F.col(count), F.lit(threshold)), F.lit(saturation)) + F.lit(1.0)) - base) / span
    at = (1.0 - F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))) * (scales - 1)
    # Every cell is sent to its neighbours once for each scale, under the scale's number, so the scales share their shuffles.
    out = grid.select("ix", "iy", "iz", count, at.alias("_at"))
    wide = None
    for k, s in enumerate(sigmas):
        one = blur(grid, n, s, value).select("ix", "iy", "iz", F.lit(k).alias("_k"), value)
        wide = one if wide is None else wide.unionByName(one)
    near = wide.join(out, ["ix", "iy", "iz"]).withColumn("_w", F.greatest(1.0 - F.abs(F.col("_at") - F.col("_k")), F.lit(0.0)))
    blend = near.groupBy("ix", "iy", "iz").agg(F.sum(F.col(value) * F.col("_w")).alias(value))
    return same_mass(blend, grid, value)


def bilateral(grid: DataFrame, sigma: float, sigma_value: float, reach: int, value: str = "surface") -> DataFrame:
    """The bilateral filter of a map (ix, iy): neighbours within ``reach`` weigh by distance and by how alike their values are; cells beyond the map have no part."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    sent = F.array(*[F.struct((F.col("ix") + a).alias("tx"), (F.col("iy") + b).alias("ty"), F.lit(math.exp(-(a * a + b * b) / (2 * sigma * sigma))).alias("w")) for a, b in steps])
    rows = grid.select(F.col(value).alias("v"), F.explode(sent).alias("s")).select("v", "s.*")
    both = rows.join(grid.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.col(value).alias("own")), ["tx", "ty"])
    d = F.col("v") - F.col("own")
    w = F.col("w") * F.exp(-(d * d) / (2 * sigma_value * sigma_value))
    return both.groupBy(F.col("tx").alias("ix"), F.col("ty").alias("iy")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias(value))


def quality(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: correlation, mass ratio, root mean square difference, mean relative change where before > 0, and the correlation in the densest tenth (if more than ten cells)."""
    top = pairs.agg(F.percentile(before, F.lit(0.9)).alias("_top"))  # one row
    a, b = F.col(before), F.col(after)
    dense = a > F.col("_top")
    out = pairs.join(F.broadcast(top)).agg(
        F.corr(a, b).alias("correlation"), F.try_divide(F.sum(b), F.sum(a)).alias("mass_ratio"), F.sqrt(F.avg((b - a) * (b - a))).alias("rmse"),
        F.avg(F.when(a > 0, F.abs(b - a) / a)).alias("relative_change"),
        F.corr(F.when(dense, a), F.when(dense, b)).alias("_high"), F.count_if(dense).alias("_n"),
    )
    return out.withColumn("high_correlation", F.when(F.col("_n") > 10, F.col("_high")).otherwise(F.col("correlation"))).drop("_high", "_n")
