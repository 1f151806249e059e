"""Text tables and time-stamped files of simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.geometry import snapshot_number


def read_table(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Columns of a table in text, by index: white space separates, # begins a comment, lines with fewer columns go.

    Words that aren't numbers are null."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"\s+", " "))
    parts = spark.read.text(path).select(F.split(line, " ").alias("p")).where(F.size("p") > max(columns.values()))
    return parts.where(F.col("p")[0] != "").select(*[F.col("p")[i].try_cast("double").alias(name) for name, i in columns.items()])


def read_snapshots(spark: SparkSession, path: str, *columns: str, types: list[int] | None = None) -> DataFrame:
    """Particles of Parquet snapshots in a folder with their snapshot's number from the file name; columns and particle types reach the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if types is not None:
        df = df.where(F.col("ptype").isin(types))
    return df.select(*(columns or df.columns), snapshot_number(F.col("_metadata.file_path")).alias("snap_num"))


def write_branches(branches: DataFrame, path: str) -> None:
    """The sink of branch catalogs: Parquet, partitioned by snapshot so that readers prune."""
    branches.repartition("snap").write.mode("overwrite").partitionBy("snap").parquet(path)
