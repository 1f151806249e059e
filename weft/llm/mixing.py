"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Keys are cut into ranges by their leading hex digits, so a source,
however large, is sorted and summed in many (source, range) groups: sums by range, prefix sums over the
ranges of a source, then a running sum inside each range. There are as many digits as leave some ``RANGE`` documents of
all sources in a range; they change the plan only, not the result. The cut lies
where the prefix sum of sizes meets the source's budget; a target above the source's size takes
whole epochs first, and the rest by the cut. One shuffle of (id, source, size, key) rows; texts stay in the scan.

Defined results: a null text has size 0 and is never counted; documents whose middle lies within the budget are taken
whole, so a source is off by half a document at most; keys tie only for equal doc_id and then order by
size and the text's hash; a null source is a source of its own, last in order; a null doc_id is hashed as an empty one;
an empty table, or one without words, gives targets of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, table, texts, unused, written

SEED, RANGE, MOST = "mix-1", 4096, 3
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and t, the hash of the text."""
    return texts(docs, "source").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("t"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: grp (its non-null key), source_size, target.

    Sources fill up in the order of cap over weight. With the first i of them at their caps, the others
    stand at (total - caps) / weights left; that level rises while caps bind and falls after, so the
    level to share at is its maximum. The windows run over one row for each source."""
    per = sizes.groupBy(grp_of("source").alias("grp"), "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    per = per.withColumn("level", left.cast("double") / share.cast("double")).withColumn("level", F.max("level").over(whole))
    return per.select("grp", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def grp_of(source: str):
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def digits_for(rows: int) -> int:
    """Hex digits such that a range holds ``RANGE`` of so many rows or fewer; one at least."""
    digits = 1
    while rows > RANGE * 16**digits:
        digits += 1
    return digits


def mix(docs: DataFrame, seed: str = SEED, digits: int | None = None) -> DataFrame:
    """doc_id, source, size, t (the text's hash), source_size, target, copies (times the document is in the mix), taken (its words there)."""
    spark = docs.sparkSession
    sizes = written(sized(docs), f"{shared_dir(spark)}/sized")
    digits = digits or digits_for(sizes.count())
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sizes.withColumn("grp", grp_of("source")).withColumn("key", key).withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("grp", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("range_before", before).join(targets(sizes), "grp").drop("range_size")
    inside = Window.partitionBy("grp", "range").orderBy("key", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, ["grp", "range"])
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("middle", F.col("range_before") + F.col("inside") + F.col("size") / F.lit(2.0))
        .withColumn("copies", F.col("epochs") + F.when((F.col("middle") <= F.col("rest")) & (F.col("epochs") < MOST), 1).otherwise(0))
        .select("doc_id", "source", "size", "t", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, whatever their names, each as many times as the mix takes it.

    Rows are told apart by doc_id, source and text: other texts under one doc_id are other documents. Rows equal in all
    three are taken alike, as often as the one of them that is taken most."""
    names = docs.columns
    d, t, grp, copies, copy = unused(docs, "_d", "_t", "_grp", "_copies", "_copy")
    taken = mix(docs).groupBy(F.col("doc_id").alias(d), F.col("t").alias(t), grp_of("source").alias(grp)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(grp, grp_of("source"))
    both = rows.join(taken.withColumnsRenamed({t: f"{t}2", grp: f"{grp}2"}), rows["doc_id"].eqNullSafe(F.col(d)) & (F.col(t) == F.col(f"{t}2")) & (F.col(grp) == F.col(f"{grp}2")))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[docs[c] for c in names])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER u, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS DOUBLE) AS lev
  FROM w WINDOW u AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(lev) OVER ()) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN middle <= target - epochs * source_size AND epochs < 3 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
