"""Connected components over edge tables: in one task where the edges are few, else by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Up to so many edges (16 MB) are joined in one task; more are never brought together.
ONE_TASK = 1 << 20
_LABELS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v). Minima combine before the shuffle; a node with many edges is a skewed
    probe side of the join only."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = both.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _joined(batches):
    """Labels of all nodes of a bounded number of edges: every root hooks to the least root that it meets, then paths are halved."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*parts, strict=True) for x in pair]), return_inverse=True)
    u, v = np.split(at, 2)
    lead = np.arange(len(nodes))
    while (lead[u] != lead[v]).any():
        a, b = lead[u], lead[v]
        np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
        while (lead[lead] != lead).any():
            lead = lead[lead]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[lead])], schema=_LABELS)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of all nodes that have edges; a component is named by its least node. Edges: (u, v) of longs.

    Edges are counted first. Beyond ``ONE_TASK`` a round is one large and one small step, written to ``folder``; rounds
    grow with the logarithm of the largest component, and a round's table goes when the next is written. The driver
    sees a count and a checksum of each round only."""
    edges = written(edges.where("u <> v").distinct(), f"{folder}/edges")
    if edges.count() <= ONE_TASK:
        return written(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), f"{folder}/labels")
    mark, k = None, 0
    while True:
        edges = written(_star(_star(edges, large=True), large=False), f"{folder}/star{k}")
        dropped(edges.sparkSession, f"{folder}/star{k - 1}")
        # The edges of a round are distinct: equal counts and checksums mean that nothing moved.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, k = now, k + 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
