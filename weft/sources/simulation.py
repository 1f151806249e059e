"""Readers and sinks of simulation files: shards, halo tables, power spectra, density grids."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.geometry import GRAVITY, RADIUS_TYPES, mass_to_radius, reference_density, snapshot_number  # noqa: F401
from weft.sources.text import read_table

# Columns of halo tables by name; the text format has them in this order.
COLUMNS = {
    name: k
    for k, name in enumerate(
        "scale id desc_scale desc_id num_prog pid upid desc_pid phantom sam_mvir mvir rvir rs vrms mmp scale_of_last_mmp vmax x y z vx vy vz jx jy jz spin breadth_first_id depth_first_id tree_root_id orig_halo_id snap_num next_coprogenitor_depth_first_id last_progenitor_depth_first_id rs_klypin mvir_all m200b m200c m500c m2500c xoff voff spin_bullock b_to_a c_to_a ax ay az b_to_a_500c c_to_a_500c ax_500c ay_500c az_500c tu macc mpeak vacc vpeak halfmass_scale acc_rate_inst acc_rate_100myr acc_rate_tdyn".split()
    )
}
#: Derived radii: the mass that each is made of, and the definition.
RADII = {"rad_vir": ("mvir", "vir"), "rad_200b": ("m200b", "200m"), "rad_200c": ("m200c", "200c"), "rad_500c": ("m500c", "500c"), "rad_2500c": ("m2500c", "2500c")}
KPC = ("rs", "rvir", "rs_klypin")


def shards(names: list[str], prefix: str, snap: int) -> list[str]:
    """The files of a snapshot among ``names``, prefix_NNN or prefix_NNN.K with any ending, in the order of K as a number."""
    found = []
    for name in names:
        m = re.search(rf"(?:^|/){re.escape(prefix)}_0*{snap}(?:\.(\d+))?\.[a-z0-9]+$", name)
        if m:
            found.append((int(m[1] or 0), name))
    return [name for _, name in sorted(found)]


def value_of(name: str, z: float, h0: float, omega_m: float, omega_l: float) -> tuple[str, Column]:
    """The stored column that a value comes from, and how: radii from masses, kpc to Mpc."""
    if name in RADII:
        mass, kind = RADII[name]
        return mass, mass_to_radius(F.col(mass), reference_density(kind, F.lit(z), h0, omega_m, omega_l), F.lit(1 / (1 + z)))
    return name, F.col(name) / 1000.0 if name in KPC else F.col(name)


def read_halo_values(spark: SparkSession, path: str, names: list[str], z: float = 0.0, h0: float = 70.0, omega_m: float = 0.3, omega_l: float = 0.7, binary: bool = False) -> DataFrame:
    """id and the values named, stored or derived, of a halo table in text or binary form."""
    made = {n: value_of(n, z, h0, omega_m, omega_l) for n in names}
    wanted = {c: COLUMNS[c] for c in dict.fromkeys(["id", *[c for c, _ in made.values()]])}
    t = (read_binary_table if binary else read_table)(spark, path, wanted)
    return t.select(F.col("id").cast("long").alias("id"), *[c.alias(n) for n, (_, c) in made.items() if n != "id"])


def read_halos(spark: SparkSession, path: str, kind: str = "200c", z: float = 0.0, h0: float = 70.0, omega_m: float = 0.3, omega_l: float = 0.7) -> DataFrame:
    """id, x, y, z, m, r by a definition of the radius, the largest first."""
    radius = next(r for r, (_, k) in RADII.items() if k == kind)
    t = read_halo_values(spark, path, ["x", "y", "z", RADII[radius][0], radius], z, h0, omega_m, omega_l)
    return t.select("id", "x", "y", "z", F.col(RADII[radius][0]).alias("m"), F.col(radius).alias("r")).orderBy(F.desc("r"), "id")


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(where)


def read_binary_table(spark: SparkSession, path: str, columns: dict[str, int], rows_per_task: int = 1 << 20) -> DataFrame:
    """Columns of a table that begins with its number of rows (64 bits) and then holds one column of doubles after another.

    The driver reads the number; a task seeks to its rows of each column wanted. ``path`` must be readable by all executors."""
    with _open(path) as f:
        n = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
    schema = pa.schema([(c, pa.float64()) for c in columns])

    def run(batches):
        with _open(path) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    size = min(rows_per_task, n - first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(f.read_at(8 * size, 8 + 8 * (k * n + first)), "<f8")) for k in columns.values()], schema=schema)

    tasks = max(1, -(-n // rows_per_task))
    return spark.range(0, n, rows_per_task, tasks).mapInArrow(run, ", ".join(f"{c} double" for c in columns))


def convert_halos(spark: SparkSession, path: str, out: str, most: int | None = None) -> None:
    """A halo table in text as Parquet; only the ``most`` heaviest by m200b, if given (ties: lesser id)."""
    t = read_table(spark, path, COLUMNS).withColumn("id", F.col("id").cast("long"))
    (t if most is None else t.orderBy(F.desc("m200b"), "id").limit(most)).write.mode("overwrite").parquet(out)


SPECTRA = "snap int, section int, scale_factor double, box_size double, pmgrid int, growth_factor double, k double, delta_squared double, mode_count long, shot double"


def _spectra(sections: int):
    def run(frames):
        for frame in frames:
            out = []
            for snap, text in zip(frame["snap"], frame["value"], strict=True):
                lines, at = text.split("\n"), 0
                for s in range(sections):
                    a, n, box, pm, growth = (float(x) for x in lines[at : at + 5])
                    at += 5
                    for line in lines[at : at + int(n)]:
                        k, d2, _power, count, shot = map(float, line.split()[:5])
                        out.append((snap, s, a, box, int(pm), growth, k, d2, int(count), shot))
                    at += int(n)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPECTRA.split(", ")])

    return run


def read_power_spectra(spark: SparkSession, path: str, sections: int = 3) -> DataFrame:
    """Rows of the files powerspec_NNN.txt of a folder, section by section (each of one fold), with their snapshot; a file is some hundred kB."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="powerspec_*.txt").select(F.regexp_extract(F.col("_metadata.file_path"), r"powerspec_(\d+)\.txt$", 1).alias("n"), "value")
    return files.where("n <> ''").select(F.col("n").cast("int").alias("snap"), "value").mapInPandas(_spectra(sections), SPECTRA)


def stitched(spectra: DataFrame, subtract_shot: bool = False, bins: int = 50, least_modes: int = 8, sections: int = 3, fold: float = 16.0) -> DataFrame:
    """snap, k, delta_squared, power: each section in the range that its fold resolves, joined in even bins of log k by mode counts.

    Sections of up to ``bins`` rows stay as they are. A bin of few modes is left out unless it is its section's first."""
    edge = F.lit(np.pi) * F.col("pmgrid") / F.col("box_size") / 4.0
    s = F.col("section")
    low = F.when(s > 0, edge * F.pow(F.lit(fold), (s - 1).cast("double"))).otherwise(0.0)
    high = F.when(s < sections - 1, edge * F.pow(F.lit(fold), s.cast("double"))).otherwise(float("inf"))
    value = F.col("delta_squared") - F.col("shot") if subtract_shot else F.col("delta_squared")
    rows = spectra.withColumn("d2", value).where((F.col("k") >= low) & (F.col("k") <= high))
    of = ["snap", "section"]
    per = rows.groupBy(*of).agg(F.count("*").alias("n"), F.log10(F.min("k")).alias("a"), F.log10(F.max("k")).alias("b"))
    rows = rows.join(per, of)
    few = rows.where(F.col("n") <= bins).select("snap", "k", F.col("d2").alias("delta_squared"))
    at = F.least(F.greatest(F.floor((F.log10("k") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(0)), F.lit(bins - 1))
    mean = lambda c: F.when(F.sum("mode_count") > 0, F.try_divide(F.sum(F.col(c) * F.col("mode_count")), F.sum("mode_count"))).otherwise(F.avg(c))
    merged = rows.where(F.col("n") > bins).groupBy(*of, at.alias("bin")).agg(F.sum("mode_count").alias("modes"), mean("k").alias("k"), mean("d2").alias("delta_squared"))
    first = merged.groupBy(*of).agg(F.min("bin").alias("first"))
    merged = merged.join(first, of).where((F.col("modes") >= least_modes) | (F.col("bin") == F.col("first"))).select("snap", "k", "delta_squared")
    return few.unionByName(merged).withColumn("power", F.col("delta_squared") * (2 * np.pi**2) / F.pow("k", F.lit(3.0)))


def read_log_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """k and power of a table of their logarithms to base ten."""
    t = read_table(spark, path, {"log_k": 0, "log_power": 1})
    return t.select(F.pow(F.lit(10.0), "log_k").alias("k"), F.pow(F.lit(10.0), "log_power").alias("power"), "log_k", "log_power")


def write_density(grid: DataFrame, path: str, **header) -> None:
    """Cells as Parquet, with the header (box, cells, time, ...) as one row beside them."""
    grid.write.mode("overwrite").parquet(f"{path}/cells")
    grid.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "header string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_density(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/cells"), json.loads(spark.read.parquet(f"{path}/header").first()["header"])


def write_branch_catalog(rows: DataFrame, index: DataFrame, times: DataFrame, path: str, **header) -> None:
    """The tables of a branch catalog: rows by place (ranges of places, so a branch lies in one file), index, times, header."""
    rows.repartitionByRange("place").sortWithinPartitions("place", "step").write.mode("overwrite").parquet(f"{path}/rows")
    for name, t in (("index", index), ("times", times)):
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    rows.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "header string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_branch(spark: SparkSession, path: str, place: int) -> DataFrame:
    """One branch, latest node first; the filter reaches the scan."""
    return spark.read.parquet(f"{path}/rows").where(F.col("place") == place).orderBy("step")


def catalogs(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Halo catalogs of a folder of Parquet snapshots with their number; a missing r is 0, files that can't be read are left out."""
    t = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").parquet(path).withColumn("snap", snapshot_number(F.col("_metadata.file_path")))
    t = t if "r" in t.columns else t.withColumn("r", F.lit(0.0))
    return t.withColumn("r", F.coalesce("r", F.lit(0.0))).select(*(columns or t.columns))


def snapshots_there(spark: SparkSession, path: str) -> list[int]:
    """The snapshot numbers of a folder, ascending: one for each output of a simulation."""
    t = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return sorted(r[0] for r in t.select(snapshot_number(F.col("_metadata.file_path")).alias("snap")).distinct().collect())
