"""Fields and histograms of files that arrive: sums commute, so late files only add to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import density, stats


def snapshots(spark: SparkSession, folder: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def histogram(stream: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """Running counts by bin; the state is a row for each bin."""
    return stats.counts(stream, stats.linear_bin(F.col(value), low, high, n))


def cic(stream: DataFrame, box: float, n: int, mass: Column) -> DataFrame:
    """The running density; the state is a row for each cell met."""
    return density.cic(stream, box, n, mass)


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums and counts by tumbling windows; rows later than ``late`` behind the newest are left out, their state is dropped."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
