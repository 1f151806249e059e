"""Merger trees: links, branches by pointer doubling, unwrapped paths, branch catalogs, tracking across snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.geometry import min_image
from weft.operators import halos
from weft.sources.steps import dropped, folder, written


def _chains(starts: DataFrame, links: DataFrame, what: str) -> DataFrame:
    """(root, node, ``what``) of all that is reached from the starts by links (at, to), the starts included.

    Links double: after k rounds a link spans 2**k steps, and what is found so far doubles in depth, so the rounds grow
    with the logarithm of the depth, whatever it is. A round is written before the next one reads it twice, and the rounds
    end when one adds nothing."""
    spark, path, span, k = starts.sparkSession, folder(starts.sparkSession), 1, 0
    found = written(starts.select(F.col("node").alias("root"), "node", F.lit(0).alias(what)), f"{path}/found0")
    jump = written(links, f"{path}/jump0")
    while True:
        more = found.join(jump, F.col("node") == F.col("at")).select("root", F.col("to").alias("node"), (F.col(what) + span).alias(what))
        more = written(more, f"{path}/more{k}")
        if more.isEmpty():
            return found
        found = written(found.unionByName(more), f"{path}/found{k + 1}")
        further = jump.select(F.col("at").alias("a"), F.col("to").alias("b"))
        jump = written(further.join(jump, F.col("b") == F.col("at")).select(F.col("a").alias("at"), "to"), f"{path}/jump{k + 1}")
        for name in ("found", "more", "jump"):
            dropped(spark, f"{path}/{name}{k}")
        span, k = span * 2, k + 1


def branches(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, step) of each root's chain of main progenitors, the root included. Progenitors that are not among the nodes end the chain."""
    links = nodes.where("main_prog is not null").select(F.col("node").alias("at"), F.col("main_prog").alias("to"))
    return _chains(roots, links.join(nodes.select(F.col("node").alias("to")), "to", "left_semi").select("at", "to"), "step")


def trace(nodes: DataFrame, starts: DataFrame, backward: bool = True, forward: bool = True, snap_min: int | None = None, snap_max: int | None = None) -> DataFrame:
    """(root, node, step) along main progenitors (steps below 0) and descendants (above 0) of each start.

    A chain stops at the first node before ``snap_min`` or after ``snap_max``; as snapshots run one way along a chain, these are cut off first.
    A start is returned even if it lies outside; one that is not among the nodes has no rows."""
    starts = starts.join(nodes.select("node"), "node", "left_semi")
    out = starts.select(F.col("node").alias("root"), "node", F.lit(0).alias("step"))
    if backward:
        into = (nodes if snap_min is None else nodes.where(F.col("snap") >= snap_min)).select(F.col("node").alias("to"))
        links = nodes.where("main_prog is not null").select(F.col("node").alias("at"), F.col("main_prog").alias("to")).join(into, "to", "left_semi").select("at", "to")
        out = out.unionByName(_chains(starts, links, "step").where("step > 0").withColumn("step", -F.col("step")))
    if forward:
        into = (nodes if snap_max is None else nodes.where(F.col("snap") <= snap_max)).select(F.col("node").alias("to"))
        links = nodes.where("descendant is not null").select(F.col("node").alias("at"), F.col("descendant").alias("to")).join(into, "to", "left_semi").select("at", "to")
        out = out.unionByName(_chains(starts, links, "step").where("step > 0"))
    return out


def progenitors(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of everything that merges into a root; rows missing from ``nodes`` prune what lies above them."""
    parents = nodes.select(F.col("node").alias("descendant"))
    up = nodes.where("descendant is not null").join(parents, "descendant", "left_semi").select(F.col("descendant").alias("at"), F.col("node").alias("to"))
    return _chains(roots, up, "depth")


def tops(nodes: DataFrame) -> DataFrame:
    """The nodes that merge into nothing: their descendant is null or not among the nodes."""
    return nodes.join(nodes.select(F.col("node").alias("_top")), F.col("descendant") == F.col("_top"), "left_anti")


def ranked(roots: DataFrame, ties: str = "root", before: dict[str, str] | None = None) -> DataFrame:
    """Adds ``place``, from 0, in order of mass, the greatest first (ties: the lesser ``ties``, which tells all of them apart), and for each
    column named in ``before`` a new column with its sum over the rows before.

    Prefix sums over one row for each root, in ranges of mass first, so no task sorts all roots."""
    sums = {"_one": "place"} | (before or {})
    per = roots.withColumn("_one", F.lit(1)).withColumn("_part", F.floor(F.log2(F.greatest("mass", F.lit(1e-300))) * -64).cast("long"))
    order = Window.partitionBy("_part").orderBy(F.desc("mass"), ties).rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("_part").agg(*[F.sum(c).alias(f"_{a}") for c, a in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 64th of a power of two in mass
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{a}").over(earlier), F.lit(0)).alias(f"_{a}") for a in sums.values()])
    inside = per.select("*", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(a) for c, a in sums.items()])
    return inside.join(parts, "_part").select(*roots.columns, *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in sums.values()])


def extract(nodes: DataFrame, mass_min: float = 0.0, snap_min: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The catalog of main branches: (rows, index).

    Branches of all tree roots of at least ``mass_min``, in order of the root's mass (ties: lesser root), latest node
    first. Rows: root, place (of the branch), step, node. Index: root, place, start_offset, length, snap_min, snap_max."""
    kept = nodes if snap_min is None else nodes.where((F.col("snap") >= snap_min) | F.col("descendant").isNull())
    roots = nodes.where(F.col("descendant").isNull() & (F.col("mass") >= mass_min)).select("node")
    found = branches(kept, roots).join(nodes.select("node", "snap"), "node")
    per = found.groupBy("root").agg(F.count("*").alias("length"), F.min("snap").alias("snap_min"), F.max("snap").alias("snap_max")).join(nodes.select(F.col("node").alias("root"), "mass"), "root")
    index = ranked(per, before={"length": "start_offset"}).select("root", "place", "start_offset", "length", "snap_min", "snap_max")
    return found.join(index.select("root", "place"), "root").select("root", "place", "step", "node"), index


def of_task(index: DataFrame, task: int, tasks: int) -> DataFrame:
    """The branches of one of several tasks: places split evenly, the first ones get one more."""
    n = index.agg(F.count("*").alias("n_branches"))  # one row
    size, rest = F.floor(F.col("n_branches") / tasks), F.col("n_branches") % tasks
    first = size * task + F.least(F.lit(task), rest)
    return index.join(F.broadcast(n)).where((F.col("place") >= first) & (F.col("place") < first + size + F.when(F.lit(task) < rest, 1).otherwise(0))).drop("n_branches")


def in_mass_range(index: DataFrame, nodes: DataFrame, low: float, high: float) -> DataFrame:
    """Branches whose root has a mass in [low, high], both ends included."""
    return index.join(nodes.select(F.col("node").alias("root"), "mass").where(F.col("mass").between(low, high)), "root")


def absolute(relative: Column, start: Column) -> Column:
    """The index of a halo in all trees from that in its own; what is below 0 stays -1."""
    return F.when(relative >= 0, start + relative).otherwise(-1)


def find(nodes: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The wanted keys with the first node that has them, or null."""
    first = nodes.groupBy(*keys).agg(F.min("node").alias("node"))
    return wanted.join(first, list(keys), "left")


def halo_info(indices: DataFrame, nodes: DataFrame, times: DataFrame) -> DataFrame:
    """Indices with their node's columns and the time of its snapshot; a missing mass is 0. Times have a row for each snapshot."""
    return indices.join(nodes, "node").join(times, "snap", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def unwrapped(df: DataFrame, box: float, by: str, order: str, value: str = "x") -> DataFrame:
    """Adds ``path``: the value with every jump of more than half a box undone from there on."""
    w = Window.partitionBy(by).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    shift = F.when(d > box / 2, -1).when(d < -box / 2, 1).otherwise(0)
    return df.withColumn("_shift", shift).withColumn("path", F.col(value) + box * F.sum("_shift").over(w)).drop("_shift")


def unwrapped_once(df: DataFrame, box: float, by: str, order: str, node: str = "node", value: str = "x") -> DataFrame:
    """(by, node, path): each value against its predecessor's path, moved by one box at most.

    A recurrence, so a group's rows (a branch, bounded by the number of snapshots) are folded as an array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(node).alias("node"), F.col(value).alias("x"))))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<node:bigint,path:double>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        d = r["x"] - s["last"]
        path = F.when(d > box / 2, r["x"] - box).when(d < -box / 2, r["x"] + box).otherwise(r["x"])
        return F.struct(path.alias("last"), F.array_append(s["out"], F.struct(r["node"].cast("long").alias("node"), path.alias("path"))).alias("out"))

    return df.groupBy(by).agg(F.aggregate(rows, zero, step, lambda s: s["out"]).alias("out")).select(by, F.inline("out"))


def branch_index(df: DataFrame) -> DataFrame:
    """Length, first and last snapshot and greatest mass of each tree's branch."""
    return df.groupBy("tree").agg(F.count("*").alias("length"), F.min("snap").alias("snap_min"), F.max("snap").alias("snap_max"), F.max("mass").alias("mass_max"), F.max_by("node", "snap").alias("root"))


def jumps(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Steps at which a branch's mass changes by more than the ratio."""
    w = Window.partitionBy("tree").orderBy("snap")
    return df.withColumn("before", F.lag("mass").over(w)).where(F.abs(F.col("mass") - F.col("before")) > ratio * F.col("before")).select("tree", "node", "snap", "mass", "before")


def position_jumps(df: DataFrame, box: float, most: float = 5.0, value: str = "x") -> DataFrame:
    """Steps at which a branch moves by more than ``most``, the short way around the box."""
    w = Window.partitionBy("tree").orderBy("snap")
    return df.withColumn("moved", F.abs(min_image(F.col(value) - F.lag(value).over(w), box))).where(F.col("moved") > most).select("tree", "node", "snap", "moved")


def nearest(df: DataFrame, snap: int, within: int | None = None) -> DataFrame:
    """Each tree's node nearest to a snapshot, the earlier of two; null if that is further off than ``within``."""
    best = F.min(F.struct(F.abs(F.col("snap") - snap).alias("off"), "snap", "node")).alias("b")
    out = df.groupBy("tree").agg(best).select("tree", "b.*")
    near = F.lit(True) if within is None else F.col("off") <= within
    return out.select("tree", F.when(near, F.col("node")).alias("node"), F.when(near, F.col("snap")).alias("snap"))


def nearest_time(a: Column, times: list[tuple[int, float]]) -> Column:
    """The snapshot whose scale factor is nearest to ``a``, the first of two; times: (snapshot, scale factor) of each output."""
    return F.array_min(F.array(*[F.struct(F.abs(a - t).alias("off"), F.lit(k).alias("place"), F.lit(snap).alias("snap")) for k, (snap, t) in enumerate(times)]))["snap"]


def track(catalogs: DataFrame, starts: DataFrame, box: float, snaps: list[int], forward: bool = False, **how) -> DataFrame:
    """(start, snap, hid, score, distance) of halos followed by position and mass from their first snapshot on.

    ``starts``: start, snap, x, y, z, m. Snapshot by snapshot (a list as long as the simulation has outputs) all
    branches that have begun are matched at once with that snapshot's halos; a branch without a match keeps its last place and mass
    and goes on, so gaps don't end it. The snapshots' halos are written once; the state, one row for each branch, is written at each step."""
    spark, path = starts.sparkSession, folder(starts.sparkSession)
    state = written(starts.select("start", F.col("snap").alias("begins"), "x", "y", "z", "m"), f"{path}/state0")
    out = state.select("start", F.col("begins").alias("snap"), F.col("start").alias("hid"), F.lit(0.0).alias("score"), F.lit(0.0).alias("distance"))
    held = written(catalogs.where(F.col("snap").isin(snaps)).select(F.col("snap").cast("int").alias("snap"), "hid", "x", "y", "z", "m"), f"{path}/halos")
    most = held.groupBy("snap").count().agg(F.max("count")).first()[0] or 0
    cut = halos.splits(most, box, how.get("reach", halos.REACH))
    for k, snap in enumerate(sorted(snaps, reverse=not forward)):
        begun = F.col("begins") < snap if forward else F.col("begins") > snap
        targets = state.where(begun).select(F.col("start").alias("tid"), F.lit(snap).cast("int").alias("snap"), "x", "y", "z", "m")
        met = written(halos.best_match(targets, held.where(F.col("snap") == snap), box, cut=cut, **how), f"{path}/met{k}")
        out = out.unionByName(met.select(F.col("tid").alias("start"), "snap", "hid", "score", "distance"))
        at = met.select(F.col("tid").alias("start"), *[F.col(c).alias(f"n{c}") for c in "xyzm"])
        after = written(state.join(at, "start", "left").select("start", "begins", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyzm"]), f"{path}/state{k + 1}")
        if k:  # the first one holds the starts
            dropped(spark, f"{path}/state{k}")
        state = after
    dropped(spark, f"{path}/halos")
    return out


def compare(tree: DataFrame, tracked: DataFrame) -> DataFrame:
    """Full outer comparison of two branch tables (start, snap, hid): what both have, agree on, or one alone has."""
    a, b = tree.select("start", "snap", F.col("hid").alias("tree_hid")), tracked.select("start", "snap", F.col("hid").alias("track_hid"))
    state = F.when(F.col("tree_hid").isNull(), "track only").when(F.col("track_hid").isNull(), "tree only").when(F.col("tree_hid") == F.col("track_hid"), "same").otherwise("other")
    return a.join(b, ["start", "snap"], "full").withColumn("state", state)
