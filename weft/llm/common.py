"""What the operators share: the folder all executors see, written steps, whole-text readers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset (tests) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/weft-shared"
    return f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table in ``folder``: cuts the lineage, and a lost executor loses nothing."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that no later plan reads, and lets Spark clean up the shuffles of plans that are gone (it does when the driver collects garbage)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)
    gc.collect()
    jvm.System.gc()


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with the columns named; other columns, whatever their names, stay out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_hash() -> Column:
    """64 bits of the text (null: empty), to tell apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batches, column: str, limit: int = 8_000_000):
    """Slices of Arrow batches with about ``limit`` bytes of ``column`` each (one row at least), so that
    a worker's memory follows this limit and the longest text, not the number of rows in a batch."""
    for batch in batches:
        rows, at, n = batch.num_rows, 0, 0
        size = batch.column(column).nbytes
        if size <= limit or rows <= 1:
            if rows:
                yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, x in enumerate(lengths):
            n += x
            if n >= limit:
                yield batch.slice(at, i + 1 - at)
                at, n = i + 1, 0
        if at < rows:
            yield batch.slice(at)
    trim()


def trim() -> None:
    """Hands freed memory back at the end of a task: Python workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
