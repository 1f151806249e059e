"""Text tables, snapshot files and streams against the same work in batch."""

from pyspark.sql import functions as F

from weft.operators import density, stats
from weft.sources import lenses, text
from weft.streaming import incremental

D = "/root/testdata/sf0.001"


def test_read_table(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# id x y\n1 2.5 3\n\n  2\t4.5   5 # end\n3 1\n4 x 6\n")
    got = text.read_table(spark, str(tmp_path / "t.txt"), {"y": 2, "x": 1})
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(3.0, 2.5), (5.0, 4.5), (6.0, None)]


def test_read_snapshots(spark, tmp_path):
    for k in (3, 14):
        spark.range(4).select("id", (F.col("id") % 2).cast("int").alias("ptype")).coalesce(1).write.parquet(f"{tmp_path}/snapdir_{k:03d}")
    got = text.read_snapshots(spark, str(tmp_path), "id", types=[1])
    assert sorted(map(tuple, got.collect())) == [(1, 3), (1, 14), (3, 3), (3, 14)]


def run(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_histogram_and_density_of_a_stream(spark, tmp_path):
    whole = lenses.particles(spark, D)
    whole.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: incremental.snapshots(spark, f"{tmp_path}/in", "x double, y double, z double, mass double, v double", 1)
    want = stats.counts(whole, stats.linear_bin(F.col("mass"), 0.5, 50.5, 10))
    assert run(incremental.histogram(stream(), "mass", 0.5, 50.5, 10), spark, "h", "complete") == sorted(map(tuple, want.collect()))
    got = run(incremental.cic(stream(), lenses.BOX, 4, F.col("mass")), spark, "c", "complete")
    for a, b in zip(got, sorted(map(tuple, density.cic(whole, lenses.BOX, 4, F.col("mass")).collect())), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9


def test_windowed_sums_of_a_stream(spark, tmp_path):
    """Late rows within the watermark count; older ones are left out; closed windows are given once."""
    for k, rows in enumerate([[("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "b", 2.0)], [("2024-01-05 01:00:00", "a", 4.0), ("2024-01-04 03:00:00", "a", 8.0)], [("2024-01-05 02:00:00", "b", 1.0)], [("2024-01-01 05:00:00", "a", 16.0), ("2024-01-09 00:00:00", "a", 32.0)], [("2024-01-09 01:00:00", "a", 64.0)]]):
        spark.createDataFrame(rows, "t string, by string, v double").select(F.to_timestamp("t").alias("t"), "by", "v").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("t timestamp, by string, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(str(r[0])[:10], r[1]): (r[2], r[3]) for r in run(incremental.windowed(stream, "t", "by", "v"), spark, "w", "append")}
    assert got == {("2024-01-01", "a"): (1, 1.0), ("2024-01-01", "b"): (1, 2.0), ("2024-01-04", "a"): (1, 8.0), ("2024-01-05", "a"): (1, 4.0), ("2024-01-05", "b"): (1, 1.0)}


def test_samples_lie_inside():
    for w in density.samples(64):
        assert min(w) >= 0 and sum(w) == 1
