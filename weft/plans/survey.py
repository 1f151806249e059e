"""More of the library's queries: statistics of particles by class, joins, sets, trees, tracking, geometry, kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import geometry as geo
from weft.operators import density, fourier, halos, morphology, particles, series, stats, trees
from weft.plans import catalog
from weft.plans.catalog import CELLS, CIC, CLASSES, N, W, grid, query, r6
from weft.sources import lenses
from weft.sources.lenses import BOX, HALO_BOX, TREE_BOX

# Lattice particles with the overdensity of their place: cells of 1/8 of the box, sampled at the particle, over the particles' mean.

_CORNER = {"x": "a", "y": "b", "z": "d"}
_G = {a: f"({a} * 8 / n - 0.5::DOUBLE)" for a in "xyz"}
_PARTS = ", ".join(f"CAST((floor({_G[a]}) + c.{c} + 8) % 8 AS INT) AS i{a}" for a, c in _CORNER.items())
_WEIGHT = " * ".join(f"(CASE c.{c} WHEN 1 THEN {_G[a]} - floor({_G[a]}) ELSE 1 - {_G[a]} + floor({_G[a]}) END)" for a, c in _CORNER.items())
OD = f"""{catalog._LCIC}, parts AS (SELECT pid, {_PARTS}, {_WEIGHT} AS w FROM lattice, (VALUES {catalog._CORNERS}) c(a, b, d)),
sam AS (SELECT pid, sum(w * coalesce(density, 0)) AS rho FROM parts LEFT JOIN lcic USING (ix, iy, iz) GROUP BY pid), ods AS (SELECT pid, rho / (SELECT avg(rho) FROM sam) AS od FROM sam)"""
OF_CLASS = f"{lenses.LATTICE}, {OD}, {CLASSES}, both_ AS (SELECT pid, od, class, x, y, z, n FROM ods JOIN classes USING (pid))"


def overdensities(spark: SparkSession, d: str) -> DataFrame:
    t, n = lenses.lattice(spark, d)
    rho = density.sample(t, density.cic(t, float(n), 8, F.lit(1.0)), float(n), 8, 0.5)
    mean = rho.agg(F.avg("density").alias("mean"))  # one row
    return rho.join(F.broadcast(mean)).select("pid", (F.col("density") / F.col("mean")).alias("od"))


def by_class(spark: SparkSession, d: str) -> DataFrame:
    return overdensities(spark, d).join(catalog.classes(spark, d), "pid")


def _bin(v: str, low: float, high: float, n: int) -> str:
    return f"CAST({catalog._LOG.format(v=v, lo=f'{low}::DOUBLE', hi=f'{high}::DOUBLE', n=n)} AS INT)"


def _edges(low: float, high: float, n: int) -> tuple[str, str]:
    at = lambda k: f"({low}::DOUBLE * pow({high / low!r}::DOUBLE, {k} / {n}.0::DOUBLE))"
    return at("bin"), at("(bin + 1)")


_LOW, _HIGH, _BINS = 0.0213, 37.9, 20
_A, _B = _edges(_LOW, _HIGH, _BINS)
_IN = f"bin BETWEEN 0 AND {_BINS - 1}"


@query(
    "a09_mass_pdf",
    f"WITH {lenses.LATTICE}, {OD}, h AS (SELECT {_bin('od', _LOW, _HIGH, _BINS)} AS bin, count(*) AS count FROM ods GROUP BY 1) SELECT bin, count, round(count / ((SELECT sum(count) FROM h WHERE {_IN}) * ({_B} - {_A})), 6) AS pdf FROM h WHERE {_IN}",
)
def _(spark, d):
    return stats.weighted_pdf(overdensities(spark, d), "od", F.lit(1.0), _LOW, _HIGH, _BINS).select("bin", "count", r6(F.col("pdf"), "pdf"))


@query(
    "a09_class_pdf",
    f"WITH {OF_CLASS}, r AS (SELECT unnest(['all', CAST(class AS VARCHAR)]) AS cls, od FROM both_), h AS (SELECT cls, {_bin('od', _LOW, _HIGH, _BINS)} AS bin, count(*) AS count FROM r GROUP BY 1, 2) SELECT cls, bin, count, round(count / (sum(count) OVER (PARTITION BY cls) * ({_B} - {_A})), 6) AS pdf FROM h WHERE {_IN}",
)
def _(spark, d):
    rows = by_class(spark, d).select("od", F.explode(F.array(F.lit("all"), F.col("class").cast("string"))).alias("cls"))
    return stats.weighted_pdf(rows, "od", F.lit(1.0), _LOW, _HIGH, _BINS, "cls").select("cls", "bin", "count", r6(F.col("pdf"), "pdf"))


_Q = ", ".join(f"round(quantile_cont(od, {q}), 5) AS p{round(q * 100)}" for q in catalog._SHARES)


@query("a08_overdensity_by_class", f"WITH {OF_CLASS} SELECT coalesce(CAST(class AS VARCHAR), 'all') AS class, count(*) AS n, round(avg(od), 5) AS mean, round(stddev_pop(od), 5) AS std, {_Q} FROM both_ GROUP BY ROLLUP (class)")
def _(spark, d):
    out = stats.percentiles(by_class(spark, d).select("class", "od"), "od", "class", catalog._SHARES)
    return out.select("class", "n", *[r6(F.col(c), c, 5) for c in ("mean", "std", *[f"p{round(q * 100)}" for q in catalog._SHARES])])


@query(
    "a07_jackknife_by_class",
    f"""WITH {OF_CLASS}, r AS (SELECT unnest(['all', CAST(class AS VARCHAR)]) AS cls, {_bin('od', _LOW, _HIGH, _BINS)} AS bin, floor(x * 2 / n) + 2 * floor(y * 2 / n) + 4 * floor(z * 2 / n) AS box FROM both_),
    c AS (SELECT cls, bin, box, count(*) AS c FROM r WHERE {_IN} GROUP BY ALL) SELECT cls, bin, round(sum(c) / 8.0::DOUBLE, 6) AS mean, round(sqrt((sum(c * c) - CAST(sum(c) AS DOUBLE) * sum(c) / 8) / 7 / 8), 6) AS error FROM c GROUP BY cls, bin""",
)
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    rows = by_class(spark, d).join(t, "pid").select("od", "x", "y", "z", F.explode(F.array(F.lit("all"), F.col("class").cast("string"))).alias("cls"))
    box = F.floor(F.col("x") * 2 / n) + 2 * F.floor(F.col("y") * 2 / n) + 4 * F.floor(F.col("z") * 2 / n)
    out = stats.jackknife(rows, stats.log_bin(F.col("od"), _LOW, _HIGH, _BINS), box, _BINS, 8, "cls")
    return out.select("cls", "bin", r6(F.col("mean"), "mean"), r6(F.col("error"), "error"))


@query(
    "a11_inverse_weighted_pdf",
    f"WITH {lenses.LATTICE}, {OD}, h AS (SELECT {_bin('od', _LOW, _HIGH, _BINS)} AS bin, count(*) AS count, sum(1 / od) AS w FROM ods WHERE od > 0 GROUP BY 1) SELECT bin, count, round(w / (sum(w) OVER () * ({_B} - {_A})), 6) AS pdf FROM h WHERE {_IN}",
)
def _(spark, d):
    return stats.weighted_pdf(overdensities(spark, d).where("od > 0"), "od", 1.0 / F.col("od"), _LOW, _HIGH, _BINS).select("bin", "count", r6(F.col("pdf"), "pdf"))


@query(
    "a12_pooled_range",
    f"WITH {lenses.LATTICE}, {OD}, g AS (SELECT density / (SELECT sum(density) / 512 FROM lcic) AS od FROM lcic), u AS (SELECT od FROM ods WHERE od > 0 UNION ALL SELECT od FROM g WHERE od > 0) SELECT count(*) AS n, round(quantile_cont(od, 0.00005), 6) AS low, round(quantile_cont(od, 0.99995), 6) AS high FROM u",
)
def _(spark, d):
    """The common range of particles' and cells' overdensities."""
    t, n = lenses.lattice(spark, d)
    cells = density.cic(t, float(n), 8, F.lit(1.0))
    mean = cells.agg((F.sum("density") / 512).alias("mean"))  # one row
    pooled = overdensities(spark, d).select("od").unionByName(cells.join(F.broadcast(mean)).select((F.col("density") / F.col("mean")).alias("od"))).where("od > 0")
    return pooled.agg(F.count("*").alias("n"), r6(F.percentile("od", F.lit(0.00005)), "low"), r6(F.percentile("od", F.lit(0.99995)), "high"))


@query(
    "a13_leave_one_out",
    f"""WITH {lenses.PARTICLES}, r AS (SELECT CAST(CASE WHEN mass < 4.5 THEN -1 WHEN mass >= 44.5 THEN 10 ELSE floor((mass - 4.5::DOUBLE) * 10 / 40) END AS INT) AS bin, floor(x / 32) + 2 * floor(y / 32) + 4 * floor(z / 32) AS box FROM particles),
    b AS (SELECT box, count(*) AS in_box FROM r GROUP BY 1), t AS (SELECT bin, count(*) AS in_bin FROM r WHERE bin BETWEEN 0 AND 9 GROUP BY 1), c AS (SELECT box, bin, count(*) AS c FROM r GROUP BY ALL),
    x AS (SELECT t.bin, (in_bin - coalesce(c.c, 0)) / (((SELECT count(*) FROM r) - in_box) * 4.0::DOUBLE) AS x FROM t CROSS JOIN b LEFT JOIN c ON c.box = b.box AND c.bin = t.bin)
    SELECT bin, round(avg(x), 8) AS pdf, round(sqrt(var_pop(x) * 7), 8) AS error FROM x GROUP BY bin""",
)
def _(spark, d):
    box = F.floor(F.col("x") / 32) + 2 * F.floor(F.col("y") / 32) + 4 * F.floor(F.col("z") / 32)
    out = stats.leave_one_out_pdf(lenses.particles(spark, d), stats.linear_bin(F.col("mass"), 4.5, 44.5, 10), box, 10, 8, 4.0)
    return out.select("bin", r6(F.col("pdf"), "pdf", 8), r6(F.col("error"), "error", 8))


@query("a05_bin_centres", f"SELECT CAST(i AS INT) AS bin, round(sqrt({_A.replace('bin', 'i')} * {_B.replace('bin', 'i')}), 6) AS log_centre, round(({_LOW}::DOUBLE + {_HIGH - _LOW!r}::DOUBLE * (i + 0.5::DOUBLE) / {_BINS}), 10) AS centre FROM range({_BINS}) r(i)")
def _(spark, d):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(stats.centres(_LOW, _HIGH, _BINS, True), stats.centres(_LOW, _HIGH, _BINS), strict=True))]
    return spark.createDataFrame(rows, "bin int, log_centre double, centre double").select("bin", r6(F.col("log_centre"), "log_centre"), r6(F.col("centre"), "centre", 10))


@query("a20_ranges", "SELECT min(l_discount) AS low, max(l_discount) AS high, min(l_discount) FILTER (l_discount > 0) AS low_positive FROM lineitem")
def _(spark, d):
    return stats.value_range(lenses.table(spark, d, "lineitem").select("l_discount"), "l_discount")


@query("a01_auto_histogram", "WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * 1e-10::DOUBLE AS b FROM orders), h AS (SELECT CAST(least(floor((o_totalprice - a) * 25 / (b - a)), 24) AS INT) AS bin FROM orders, m) SELECT bin, count(*) AS count FROM h GROUP BY bin")
def _(spark, d):
    t = lenses.table(spark, d, "orders").select("o_totalprice")
    return stats.counts(t, stats.linear_bin(F.col("o_totalprice"), *stats.auto_range(t, "o_totalprice"), 25))


_COUNTS = "k AS (SELECT CAST(floor(x / 2) AS INT) AS ix, CAST(floor(y / 2) AS INT) AS iy, CAST(floor(z / 2) AS INT) AS iz, count(*) AS n FROM particles GROUP BY 1, 2, 3)"


@query("a21_count_quality", f"WITH {lenses.PARTICLES}, {_COUNTS} SELECT 32768 - count(*) AS n_zero, 32768 - count(*) + count(*) FILTER (n < 2) AS n_low, round(sum(n) / 32768.0::DOUBLE, 8) AS mean_count FROM k")
def _(spark, d):
    cells = density.ngp(lenses.particles(spark, d), BOX, 32, F.count("*").alias("n"))
    return stats.count_quality(cells, 32**3).select("n_zero", "n_low", r6(F.col("mean_count"), "mean_count", 8))


_COUNTED = f"{CIC}, m AS (SELECT CAST(floor(x / {W}) AS INT) AS ix, CAST(floor(y / {W}) AS INT) AS iy, CAST(floor(z / {W}) AS INT) AS iz, count(*) AS n FROM particles GROUP BY 1, 2, 3), cc AS (SELECT ix, iy, iz, density, coalesce(n, 0) AS n FROM cic LEFT JOIN m USING (ix, iy, iz))"


def counted(spark: SparkSession, d: str) -> DataFrame:
    t = lenses.particles(spark, d)
    met = density.ngp(t, BOX, N, F.count("*").alias("n"))
    return grid(spark, d).join(met, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", "density", F.coalesce("n", F.lit(0)).alias("n"))


@query("x07_void_mask", f"WITH {lenses.PARTICLES}, {_COUNTED} SELECT ix, iy, iz, round(CASE WHEN n < 2 THEN coalesce((SELECT quantile_cont(density, 0.05) FROM cc WHERE n >= 2), 0) ELSE density END, 6) AS masked FROM cc")
def _(spark, d):
    return stats.void_masked(counted(spark, d), "density", "n").select("ix", "iy", "iz", r6(F.col("masked"), "masked"))


@query("p38_log_ready", f"WITH {lenses.PARTICLES}, {CIC}, {CELLS} SELECT ix, iy, iz, round(greatest(density, (SELECT min(density) FILTER (density > 0) FROM cells) * 0.1::DOUBLE), 6) AS floored FROM cells")
def _(spark, d):
    return stats.log_ready(density.dense(grid(spark, d), N, "density"), "density").select("ix", "iy", "iz", r6(F.col("floored"), "floored"))


@query(
    "a19_agreement",
    f"WITH {lenses.PARTICLES}, {CIC}, {catalog._BLURS}, p AS (SELECT cic.density / avg(cic.density) OVER () AS x, s3.density / avg(s3.density) OVER () AS y FROM cic JOIN s3 USING (ix, iy, iz)) SELECT round(corr(x, y), 6) AS correlation, round(avg(abs(y - x) / x) FILTER (x > 0), 5) AS mean_difference, round(max(abs(y - x) / x) FILTER (x > 0), 4) AS most_difference, corr(x, y) > 0.999 AS passes FROM p",
)
def _(spark, d):
    before = grid(spark, d)
    pairs = before.join(fourier.blur(before, N, catalog._SIGMA).withColumnRenamed("density", "after"), ["ix", "iy", "iz"])
    return stats.agreement(pairs, "density", "after").select(r6(F.col("correlation"), "correlation"), r6(F.col("mean_difference"), "mean_difference", 5), r6(F.col("most_difference"), "most_difference", 4), "passes")


@query("a19_match_rate", f"WITH {lenses.LATTICE}, {CLASSES}, c AS (SELECT class = CAST(bit_count(f & 7) AS INT) AS same FROM classes) SELECT round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_rate FROM c")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    flags = morphology.crossings(t, n, float(n)).select(morphology.class_of().alias("a"), F.bit_count(F.col("flags").bitwiseAND(F.lit(7))).alias("b"))
    return stats.match_rate(flags, "a", "b").select(r6(F.col("match_rate"), "match_rate"))


@query("x03_physical_density", "SELECT n_nationkey, round((n_nationkey + 1) * (3.0::DOUBLE * 4900 / (8 * pi() * 4.30091e-9::DOUBLE) * 0.3::DOUBLE) / pow(0.5::DOUBLE, 3), 0) AS rho FROM nation")
def _(spark, d):
    return lenses.table(spark, d, "nation").select("n_nationkey", r6(geo.overdensity_physical(F.col("n_nationkey") + 1, 0.5), "rho", 0))


_K = "k AS (SELECT (i + 1) / 10.0::DOUBLE AS k, 1000.0::DOUBLE / (1 + pow((i + 1) / 10.0::DOUBLE, 2)) AS power FROM range(100) r(i))"
_SINC = "(sin(k * 0.25::DOUBLE) / (k * 0.25::DOUBLE))"


@query(
    "f05_sigma_squared",
    f"""WITH {_K}, w AS (SELECT k, k * k * power / (2 * pi() * pi()) AS p, exp(-(k * k) * 2) AS g, 3 * (sin(k * 2) - k * 2 * cos(k * 2)) / pow(k * 2, 3) AS t, {_SINC} AS s FROM k),
    f AS (SELECT k, p * g * g AS a, p * t * t AS b, p * g * g * pow(s, 6) AS c FROM w), d AS (SELECT lead(k) OVER o - k AS dk, lead(a) OVER o + a AS a, lead(b) OVER o + b AS b, lead(c) OVER o + c AS c FROM f WINDOW o AS (ORDER BY k))
    SELECT round(sum(dk * a / 2), 6) AS gaussian, round(sum(dk * b / 2), 6) AS tophat, round(sum(dk * c / 2), 6) AS gaussian_cells FROM d""",
)
def _(spark, d):
    k = (F.col("id") + 1) / F.lit(10.0)
    power = spark.range(100).select(k.alias("k"), (1000.0 / (1 + k * k)).alias("power"))
    one = lambda name, *how: stats.sigma_squared(power, 2.0, *how).select(r6(F.col("sigma_squared"), name))
    return one("gaussian", geo.gaussian_window).join(one("tophat", geo.tophat_window)).join(one("gaussian_cells", geo.gaussian_window, 0.5))  # one row each


# Joins, sets and trees.

_TREES = f"WITH {lenses.TREE}"


@query("j05_find_halo", f"{_TREES}, q AS (SELECT n_nationkey AS tree, CAST(n_nationkey % 7 + 1 AS INT) AS snap FROM nation) SELECT tree, snap, min(node) AS node FROM q LEFT JOIN nodes USING (tree, snap) GROUP BY tree, snap")
def _(spark, d):
    q = lenses.table(spark, d, "nation").select(F.col("n_nationkey").alias("tree"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("snap"))
    return trees.find(lenses.tree(spark, d), q, "tree", "snap")


@query("j07_halo_info", f"{_TREES} SELECT node, nodes.snap, mass, CASE WHEN snap < 30 THEN 1 / (1.0::DOUBLE + 30 - snap) END AS a FROM nodes WHERE node % 3 = 0")
def _(spark, d):
    t = lenses.tree(spark, d)
    times = spark.range(30).select(F.col("id").cast("int").alias("snap"), (1.0 / (1.0 + 30 - F.col("id"))).alias("a"))
    return trees.halo_info(t.where("node % 3 = 0").select("node"), t.select("node", "snap", "mass"), times).select("node", "snap", "mass", "a")


@query(
    "j11_compare_branches",
    f"{_TREES}, a AS (SELECT tree AS start, snap, node AS tree_hid FROM nodes WHERE snap <= 6), b AS (SELECT tree AS start, snap, CASE WHEN node % 5 = 0 THEN node + 1 ELSE node END AS track_hid FROM nodes WHERE snap >= 3) SELECT start, snap, tree_hid, track_hid, CASE WHEN tree_hid IS NULL THEN 'track only' WHEN track_hid IS NULL THEN 'tree only' WHEN tree_hid = track_hid THEN 'same' ELSE 'other' END AS state FROM a FULL JOIN b USING (start, snap)",
)
def _(spark, d):
    t = lenses.tree(spark, d).select(F.col("tree").alias("start"), "snap", F.col("node").alias("hid"))
    return trees.compare(t.where("snap <= 6"), t.where("snap >= 3").withColumn("hid", F.when(F.col("hid") % 5 == 0, F.col("hid") + 1).otherwise(F.col("hid"))))


@query("j12_anti_semi", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_halos FROM customer")
def _(spark, d):
    c, o = lenses.table(spark, d, "customer").select("c_custkey"), lenses.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_halos", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_halos", F.lit(False)))


@query("u02_snapshot_keys", f"{_TREES} SELECT snap FROM nodes WHERE tree % 2 = 0 UNION SELECT snap + 2 FROM nodes WHERE tree % 2 = 1")
def _(spark, d):
    t = lenses.tree(spark, d)
    return t.where("tree % 2 = 0").select("snap").union(t.where("tree % 2 = 1").select((F.col("snap") + 2).alias("snap"))).distinct()


@query("u05_intersect_except", "SELECT 'both' AS kind, x FROM (SELECT n_nationkey AS x FROM nation INTERSECT SELECT r_regionkey * 6 FROM region) UNION ALL SELECT 'left' AS kind, x FROM (SELECT n_nationkey AS x FROM nation EXCEPT SELECT r_regionkey * 6 FROM region)")
def _(spark, d):
    a, b = lenses.table(spark, d, "nation").select(F.col("n_nationkey").alias("x")), lenses.table(spark, d, "region").select((F.col("r_regionkey") * 6).alias("x"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "x").unionByName(a.subtract(b).select(F.lit("left").alias("kind"), "x"))


@query("o03_trees_by_mass", f"{_TREES} SELECT row_number() OVER (ORDER BY mass DESC, tree) - 1 AS place, tree, mass FROM nodes WHERE descendant IS NULL AND mass >= 200000")
def _(spark, d):
    roots = lenses.tree(spark, d).where("descendant is null and mass >= 200000").select("tree", "mass")
    return trees.ranked(roots, "tree").select("place", "tree", "mass")


_EXTRACTED = f"RECURSIVE {lenses.TREE}, b AS (SELECT node AS root, node, main_prog, 0 AS step FROM nodes WHERE descendant IS NULL AND mass >= 150000 UNION ALL SELECT b.root, n.node, n.main_prog, step + 1 FROM b JOIN nodes n ON n.node = b.main_prog WHERE n.snap >= 3)"


@query(
    "g06_branch_catalog",
    f"WITH {_EXTRACTED}, l AS (SELECT root, count(*) AS length, min(snap) AS snap_min, max(snap) AS snap_max, any_value(r.mass) AS mass FROM b JOIN nodes n USING (node) JOIN (SELECT node AS root, mass FROM nodes) r USING (root) GROUP BY root) SELECT root, row_number() OVER o - 1 AS place, CAST(coalesce(sum(length) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, length, snap_min, snap_max FROM l WINDOW o AS (ORDER BY mass DESC, root)",
)
def _(spark, d):
    return trees.extract(lenses.tree(spark, d), 150000.0, 3)[1]


@query("g03_trace", f"WITH RECURSIVE {lenses.TREE}, s AS (SELECT node FROM nodes WHERE snap = 4 AND node % 3 = 0), up AS (SELECT s.node AS root, n.node, n.main_prog, 0 AS step FROM s JOIN nodes n USING (node) UNION ALL SELECT up.root, n.node, n.main_prog, step - 1 FROM up JOIN nodes n ON n.node = up.main_prog WHERE n.snap >= 2), down AS (SELECT s.node AS root, n.node, n.descendant, 0 AS step FROM s JOIN nodes n USING (node) UNION ALL SELECT down.root, n.node, n.descendant, step + 1 FROM down JOIN nodes n ON n.node = down.descendant WHERE n.snap <= 8) SELECT root, node, step FROM up UNION ALL SELECT root, node, step FROM down WHERE step > 0")
def _(spark, d):
    t = lenses.tree(spark, d)
    return trees.trace(t, t.where("snap = 4 and node % 3 = 0").select("node"), snap_min=2, snap_max=8)


@query("g01_absolute_index", "SELECT event_id, CASE WHEN event_id % 11 - 1 >= 0 THEN event_id // 10 * 10 + event_id % 11 - 1 ELSE -1 END AS idx FROM events")
def _(spark, d):
    e = F.col("event_id")
    return lenses.table(spark, d, "events").select("event_id", trees.absolute(e % 11 - 1, F.floor(e / 10) * 10).alias("idx"))


@query("g02_tree_entry", f"{_TREES} SELECT tree, count(*) AS n_halos, min(node) AS first_node, arg_max(node, snap) AS root FROM nodes GROUP BY tree")
def _(spark, d):
    return lenses.tree(spark, d).groupBy("tree").agg(F.count("*").alias("n_halos"), F.min("node").alias("first_node"), F.max_by("node", "snap").alias("root"))


@query("g11_near_snapshot", f"{_TREES}, b AS (SELECT tree, arg_min(node, (abs(snap - 9), snap)) AS node, arg_min(snap, (abs(snap - 9), snap)) AS snap FROM nodes GROUP BY tree) SELECT tree, CASE WHEN abs(snap - 9) <= 1 THEN node END AS node, CASE WHEN abs(snap - 9) <= 1 THEN snap END AS snap FROM b")
def _(spark, d):
    return trees.nearest(lenses.tree(spark, d), 9, 1)


@query("w05_position_jumps", f"{_TREES}, b AS (SELECT tree, node, snap, x - lag(x) OVER (PARTITION BY tree ORDER BY snap) AS d FROM nodes), m AS (SELECT tree, node, snap, abs(CASE WHEN d > {TREE_BOX / 2} THEN d - {TREE_BOX} WHEN d < -{TREE_BOX / 2} THEN d + {TREE_BOX} ELSE d END) AS moved FROM b) SELECT tree, node, snap, round(moved, 6) AS moved FROM m WHERE moved > 5")
def _(spark, d):
    return trees.position_jumps(lenses.tree(spark, d), TREE_BOX).select("tree", "node", "snap", r6(F.col("moved"), "moved"))


@query(
    "w01_unwrap_once",
    f"WITH RECURSIVE {lenses.TREE}, u AS (SELECT tree, snap, node, x AS path FROM nodes WHERE snap = 1 UNION ALL SELECT n.tree, n.snap, n.node, CASE WHEN n.x - u.path > {TREE_BOX / 2} THEN n.x - {TREE_BOX} WHEN n.x - u.path < -{TREE_BOX / 2} THEN n.x + {TREE_BOX} ELSE n.x END FROM u JOIN nodes n ON n.tree = u.tree AND n.snap = u.snap + 1) SELECT tree, node, round(path, 6) AS path FROM u",
)
def _(spark, d):
    return trees.unwrapped_once(lenses.tree(spark, d), TREE_BOX, "tree", "snap").select("tree", "node", r6(F.col("path"), "path"))


@query("s32_branches_of_task", f"WITH {lenses.TREE}, i AS (SELECT node AS root, row_number() OVER (ORDER BY mass DESC, node) - 1 AS place, ntile(7) OVER (ORDER BY mass DESC, node) AS task FROM nodes WHERE descendant IS NULL) SELECT root, place FROM i WHERE task = 3")
def _(spark, d):
    return trees.of_task(trees.extract(lenses.tree(spark, d))[1], 2, 7).select("root", "place")


@query("s31_branches_in_mass_range", f"{_TREES} SELECT node AS root, mass FROM nodes WHERE descendant IS NULL AND mass BETWEEN 100000 AND 200000")
def _(spark, d):
    return trees.in_mass_range(trees.extract(lenses.tree(spark, d))[1], lenses.tree(spark, d), 100000.0, 200000.0).select("root", "mass")


_SUBS = "subs AS (SELECT event_id AS hid, user_id AS grp, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS INT) AS rank FROM events)"


def subhalos(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return lenses.table(spark, d, "events").select(F.col("event_id").alias("hid"), F.col("user_id").alias("grp"), (F.row_number().over(w) - 1).cast("int").alias("rank"))


@query("o04_catalog_order", f"WITH {_SUBS}, o AS (SELECT hid, grp, rank, row_number() OVER (ORDER BY grp, rank, hid) - 1 AS idx FROM subs) SELECT hid, grp, rank, idx, min(idx) OVER (PARTITION BY grp) AS first_sub FROM o")
def _(spark, d):
    return halos.catalog_order(subhalos(spark, d))


@query("s09_subhalos_of_group", f"WITH {_SUBS} SELECT hid, rank FROM subs WHERE grp = 3")
def _(spark, d):
    return halos.of_group(subhalos(spark, d), 3).select("hid", "rank")


@query("s07_shifted_groups", "WITH g AS (SELECT o_custkey AS grp, CAST(o_custkey % 4 AS INT) AS shard, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_custkey END AS first_sub FROM orders GROUP BY 1, 2, 3), s AS (SELECT shard, count(*) * 10 AS n_subs FROM g GROUP BY 1), b AS (SELECT shard, coalesce(sum(n_subs) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT grp, shard, CAST(CASE WHEN first_sub >= 0 THEN first_sub + before ELSE -1 END AS BIGINT) AS first_sub FROM g JOIN b USING (shard)")
def _(spark, d):
    k = F.col("o_custkey")
    g = lenses.table(spark, d, "orders").select(k.alias("grp"), (k % 4).cast("int").alias("shard"), F.when(k % 5 == 0, -1).otherwise(k).alias("first_sub")).distinct()
    return halos.shifted(g, g.groupBy("shard").agg((F.count("*") * 10).alias("n_subs"))).select("grp", "shard", "first_sub")


@query("o05_by_radius", f"WITH {lenses.HALOS} SELECT hid, round(cbrt(m * 1e9::DOUBLE / (4.0::DOUBLE / 3 * pi() * 200 * (3.0::DOUBLE * 4900 / (8 * pi() * 4.30091e-9::DOUBLE) * 0.3::DOUBLE * pow(1.5::DOUBLE, 3)))) * 1.5::DOUBLE, 6) AS r FROM halos")
def _(spark, d):
    t = lenses.halos(spark, d).withColumn("m", F.col("m") * 1e9)
    return halos.by_radius(t, "200m", 0.5, 70.0, 0.3, 0.7).select("hid", r6(F.col("r"), "r"))


@query("j04_adjacency", f"WITH p AS ({catalog.S['j03_overlaps']}), b AS (SELECT i AS hid, NULL::BIGINT AS host, j AS sub FROM p UNION ALL SELECT j, i, NULL FROM p) SELECT hid, coalesce(string_agg(CAST(host AS VARCHAR), ',' ORDER BY host), '') AS hosts, coalesce(string_agg(CAST(sub AS VARCHAR), ',' ORDER BY sub), '') AS subs FROM b GROUP BY hid")
def _(spark, d):
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return halos.adjacency(catalog.Q["j03_overlaps"](spark, d)).select("hid", told("hosts"), told("subs"))


@query("p33_nearest_snapshot", "WITH t AS (SELECT i AS snap, (i + 1) / 11.0::DOUBLE AS a FROM range(11) r(i)), q AS (SELECT n_nationkey, n_nationkey / 24.0::DOUBLE AS target FROM nation) SELECT n_nationkey, CAST(arg_min(snap, (abs(a - target), snap)) AS INT) AS snap FROM q, t GROUP BY n_nationkey")
def _(spark, d):
    times = [(i, (i + 1) / 11.0) for i in range(11)]
    return lenses.table(spark, d, "nation").select("n_nationkey", trees.nearest_time(F.col("n_nationkey") / 24.0, times).alias("snap"))


def _follow(snaps: list[int]) -> str:
    out, before = [], "s0"
    for k, snap in enumerate(snaps, 1):
        image = {a: f"(CASE WHEN t.{a} - c.{a} > 50 THEN t.{a} - c.{a} - 100 WHEN t.{a} - c.{a} < -50 THEN t.{a} - c.{a} + 100 ELSE t.{a} - c.{a} END)" for a in "xyz"}
        dist = "sqrt(" + " + ".join(f"{image[a]} * {image[a]}" for a in "xyz") + ")"
        out.append(f"m{k} AS (SELECT t.start, arg_min(c.hid, ({dist} + 0.3::DOUBLE * abs(log10(c.m / t.m)), c.hid)) AS hid, min({dist} + 0.3::DOUBLE * abs(log10(c.m / t.m))) AS score FROM {before} t JOIN halos c ON c.snap = {snap} WHERE t.begins > {snap} AND {dist} < 12 AND c.m > t.m * 0.05::DOUBLE GROUP BY t.start)")
        out.append(f"s{k} AS (SELECT t.start, t.begins, coalesce(c.x, t.x) AS x, coalesce(c.y, t.y) AS y, coalesce(c.z, t.z) AS z, coalesce(c.m, t.m) AS m FROM {before} t LEFT JOIN m{k} USING (start) LEFT JOIN halos c ON c.hid = m{k}.hid)")
        before = f"s{k}"
    return ", ".join(out)


_SNAPS = list(range(33, 26, -1))


@query(
    "g08_track",
    f"WITH {lenses.HALOS}, s0 AS (SELECT hid AS start, snap AS begins, x, y, z, m FROM halos WHERE snap = 34 OR snap = 31 AND hid % 2 = 0), {_follow(_SNAPS)} SELECT start, begins AS snap, start AS hid, 0.0::DOUBLE AS score FROM s0 "
    + " ".join(f"UNION ALL SELECT start, {snap}, hid, round(score, 6) FROM m{k}" for k, snap in enumerate(_SNAPS, 1)),
)
def _(spark, d):
    t = lenses.halos(spark, d)
    starts = t.where("snap = 34 or snap = 31 and hid % 2 = 0").select(F.col("hid").alias("start"), "snap", "x", "y", "z", "m")
    return trees.track(t, starts, HALO_BOX, _SNAPS, reach=12.0).select("start", "snap", "hid", r6(F.col("score"), "score"))


# Geometry and physics over small tables.

@query("p07_grid_size", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS side FROM nation")
def _(spark, d):
    k = F.col("n_nationkey")
    return lenses.table(spark, d, "nation").select("n_nationkey", geo.grid_size(k * k * k + F.when(k % 2 == 0, 0).otherwise(2)).alias("side"))


def _vectors_of(t: DataFrame):
    k = F.col("s_suppkey")
    return [(k % 7).cast("double"), (k % 5).cast("double"), (k % 3).cast("double")], [F.col("s_nationkey").cast("double"), (k % 11).cast("double"), F.lit(2.0)]


_VEC = "v AS (SELECT s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) AS ax, CAST(s_suppkey % 5 AS DOUBLE) AS ay, CAST(s_suppkey % 3 AS DOUBLE) AS az, CAST(s_nationkey AS DOUBLE) AS bx, CAST(s_suppkey % 11 AS DOUBLE) AS by_, 2.0::DOUBLE AS bz FROM supplier)"


@query("p08_vectors", f"WITH {_VEC} SELECT s_suppkey, ax * bx + ay * by_ + az * bz AS dot, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz, round(sqrt(ax * ax + ay * ay + az * az), 8) AS norm FROM v")
def _(spark, d):
    t = lenses.table(spark, d, "supplier")
    a, b = _vectors_of(t)
    c = geo.cross(a, b)
    return t.select("s_suppkey", geo.dot(a, b).alias("dot"), *[x.alias(f"c{n}") for x, n in zip(c, "xyz", strict=True)], r6(geo.norm(a), "norm", 8))


_BLOCKS = {a: (f"(s_suppkey * {p} % 16)", f"(s_suppkey % {q} + 1)", f"(s_nationkey * {p} % 16)", f"(s_nationkey % {q} + 2)") for a, p, q in (("x", 3, 4), ("y", 5, 6), ("z", 7, 9))}


def _meets() -> str:
    out = []
    for oa, wa, ob, wb in _BLOCKS.values():
        o, w, big, wide = (f"(CASE WHEN {wa} < {wb} THEN {p} ELSE {q} END)" for p, q in ((oa, ob), (wa, wb), (ob, oa), (wb, wa)))
        out.append(f"(({o} + {w} - {big} + 32) % 16 < {wide} OR ({o} - {big} + 32) % 16 < {wide})")
    return " AND ".join(out)


_PLAIN = " AND ".join(f"{oa} < {ob} + {wb} AND {ob} < {oa} + {wa}" for oa, wa, ob, wb in _BLOCKS.values())


@query("p09_blocks_meet", f"SELECT s_suppkey, {_meets()} AS meet, {_PLAIN} AS meet_unbounded FROM supplier")
def _(spark, d):
    sides = [[F.expr(b[k]) for b in _BLOCKS.values()] for k in range(4)]
    return lenses.table(spark, d, "supplier").select("s_suppkey", geo.blocks_meet(*sides, 16).alias("meet"), geo.blocks_meet_unbounded(*sides).alias("meet_unbounded"))


@query("p10_in_cells", f"WITH {lenses.LATTICE} SELECT pid, round(CASE WHEN x * 8 / n - 3 < 0 THEN x * 8 / n - 3 + 8 ELSE x * 8 / n - 3 END, 9) AS cx FROM lattice")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return t.select("pid", r6(geo.in_cells(F.col("x"), F.lit(3), 8, float(n)), "cx", 9))


@query("p11_linear_index", "SELECT event_id, event_id % 21 + 21 * (event_id // 21 % 21 + 21 * (event_id // 441)) AS idx, CAST(event_id % 21 AS INT) AS ix, CAST(event_id // 21 % 21 AS INT) AS iy, CAST(event_id // 441 AS INT) AS iz FROM events")
def _(spark, d):
    e = F.col("event_id")
    c = geo.coordinates(e, 21)
    return lenses.table(spark, d, "events").select("event_id", geo.linear_index(c[0], c[1], c[2].cast("long"), 21).alias("idx"), *[x.alias(f"i{a}") for x, a in zip(c, "xyz", strict=True)])


_UNIT = [[0.0, 0.0, 0.0], [4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]


@query("p14_in_tetra", f"WITH {lenses.PARTICLES} SELECT count(*) AS n, count(*) FILTER (x % 8 + y % 8 + z % 8 <= 4) AS inside FROM particles")
def _(spark, d):
    corners = [[F.lit(v) for v in c] for c in _UNIT]
    t = lenses.particles(spark, d).select(*[(F.col(a) % 8).alias(a) for a in "xyz"])
    return t.agg(F.count("*").alias("n"), F.count_if(geo.in_tetra([F.col(a) for a in "xyz"], *corners)).alias("inside"))


@query("p15_tetra_bounds", f"WITH {_VEC} SELECT s_suppkey, (ax + bx + 1 + 3) / 4 AS gx, CAST(floor(least(ax, bx, 1, 3) / 2) AS BIGINT) AS low, CAST(floor(greatest(ax, bx, 1, 3) / 2) - floor(least(ax, bx, 1, 3) / 2) + 1 AS BIGINT) AS width FROM v")
def _(spark, d):
    t = lenses.table(spark, d, "supplier")
    a, b = _vectors_of(t)
    points = [a, b, [F.lit(1.0)] * 3, [F.lit(3.0)] * 3]
    low, width = geo.cell_bounds(points, 2.0)
    return t.select("s_suppkey", geo.barycentre(points)[0].alias("gx"), low[0].alias("low"), width[0].alias("width"))


@query("p22_open_interval", "WITH v AS (SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS x, CAST(event_id * 7 % 100 AS DOUBLE) AS low FROM events) SELECT event_id, x > low AND x < low + 30 OR x < low AND x < low - 70 AS inside FROM v")
def _(spark, d):
    e = F.col("event_id")
    return lenses.table(spark, d, "events").select("event_id", geo.contains_open((e % 100).cast("double"), (e * 7 % 100).cast("double"), 30.0, 100.0).alias("inside"))


_RHO0 = "(3.0::DOUBLE * 4900 / (8 * pi() * 4.30091e-9::DOUBLE))"
_CRIT, _MEAN = f"({_RHO0} * (0.3::DOUBLE * pow(1 + z, 3) + 0.7::DOUBLE))", f"({_RHO0} * 0.3::DOUBLE * pow(1 + z, 3))"


@query(
    "p26_reference_densities",
    "WITH t AS (SELECT n_nationkey, n_nationkey / 10.0::DOUBLE AS z FROM nation) SELECT n_nationkey, "
    + ", ".join(f"round({times}::DOUBLE * {_CRIT if of == 'crit' else _MEAN} / 1e9, 4) AS rho_{k}" for k, (times, of) in geo.RADIUS_TYPES.items())
    + f", round(pow(2.5::DOUBLE / (1 + z), 3) * (4.0::DOUBLE / 3 * pi()) * 500 * {_CRIT} / 1e12, 6) AS mass FROM t",
)
def _(spark, d):
    t = lenses.table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 10.0).alias("z"))
    rho = lambda k: geo.reference_density(k, F.col("z"), 70.0, 0.3, 0.7)
    return t.select("n_nationkey", *[r6(rho(k) / 1e9, f"rho_{k}", 4) for k in geo.RADIUS_TYPES], r6(geo.radius_to_mass(F.lit(2.5), rho("500c"), 1 / (1 + F.col("z"))) / 1e12, "mass"))


@query("p01_zmajor", "SELECT event_id, event_id // 100 + 10 * (event_id // 10 % 10) + 100 * (event_id % 10) AS xmajor FROM events WHERE event_id < 1000")
def _(spark, d):
    return lenses.table(spark, d, "events").where("event_id < 1000").select("event_id", geo.zmajor_to_xmajor(F.col("event_id"), 10).alias("xmajor"))


@query("p34_box_params", f"WITH {lenses.HALOS} SELECT hid, round(r * 5, 10) AS w, round((x - r * 5 / 2 + 100) % 100, 10) AS low, 4.0::DOUBLE / 0.5 AS physical FROM halos")
def _(spark, d):
    w, low = geo.box_params(F.col("x"), "r200", 5.0, F.col("r"), F.lit(1.0), HALO_BOX)
    return lenses.halos(spark, d).select("hid", r6(w, "w", 10), r6(low, "low", 10), geo.box_params(F.col("x"), "physical", 4.0, F.col("r"), F.lit(0.5), HALO_BOX)[0].alias("physical"))


# Densities.

_SLICED = f"slab AS (SELECT CAST((floor((x + w1 * d1x + w2 * d2x + w3 * d3x) * 4 / n) + 4) % 4 AS INT) AS ix, CAST((floor((y + w1 * d1y + w2 * d2y + w3 * d3y) * 4 / n) + 4) % 4 AS INT) AS iy, ((z + w1 * d1z + w2 * d2z + w3 * d3z) + n) % n AS za, n FROM sides, (VALUES {catalog._POOL}) pool(w1, w2, w3))"


@query("d05_direct_slice", f"WITH {lenses.LATTICE}, sides AS ({catalog._SIDES}), {_SLICED} SELECT ix, iy, round(count(*) * ({1 / (6 * catalog._K)}::DOUBLE / pow(any_value(n) / 4.0::DOUBLE, 2)), 6) AS surface FROM slab WHERE za >= 1.3::DOUBLE AND za < 3.7::DOUBLE GROUP BY ix, iy")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return density.direct_slice(t, n, float(n), 4, catalog._K, "z", 1.3, 3.7).select("ix", "iy", r6(F.col("surface"), "surface"))


_F2 = "SELECT floor(x / 4) + c.a AS i, floor(y / 4) + c.b AS j, mass * (CASE c.a WHEN 1 THEN x / 4 - floor(x / 4) ELSE 1 - x / 4 + floor(x / 4) END) * (CASE c.b WHEN 1 THEN y / 4 - floor(y / 4) ELSE 1 - y / 4 + floor(y / 4) END) AS w FROM particles, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)"


@query("d09_cic_2d_clipped", f"WITH {lenses.PARTICLES}, p AS ({_F2}) SELECT CAST(least(i, 15) AS INT) AS ix, CAST(least(j, 15) AS INT) AS iy, round(sum(w) / 16, 6) AS density FROM p GROUP BY 1, 2")
def _(spark, d):
    return density.cic(lenses.particles(spark, d), BOX, N, F.col("mass"), "xy", "clip").select("ix", "iy", r6(F.col("density"), "density"))


@query("d08_cic_2d_dropped", f"WITH {lenses.PARTICLES}, p AS ({_F2}) SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, round(sum(w) / 16, 6) AS density FROM p WHERE i <= 15 AND j <= 15 GROUP BY 1, 2")
def _(spark, d):
    return density.cic(lenses.particles(spark, d), BOX, N, F.col("mass"), "xy", "drop").select("ix", "iy", r6(F.col("density"), "density"))


_U = "greatest(1 - q / 2, 0)"


@query(
    "d12_kernels",
    f"""WITH t AS (SELECT i, i / 25.0::DOUBLE AS q FROM range(80) r(i)) SELECT i,
      round((0.25::DOUBLE * pow(greatest(2 - q, 0), 3) - pow(greatest(1 - q, 0), 3)) / (pi() * 0.125::DOUBLE), 8) AS cubic,
      round(pow({_U}, 4) * (1 + 2 * q) * 21 / (16 * pi() * 0.125::DOUBLE), 8) AS wendland_c2,
      round(pow({_U}, 6) * (1 + 3 * q + 35.0::DOUBLE / 12 * q * q) * 495 / (256 * pi() * 0.125::DOUBLE), 8) AS wendland_c4,
      round((pow(greatest(3 - q, 0), 5) - 6 * pow(greatest(2 - q, 0), 5) + 15 * pow(greatest(1 - q, 0), 5)) / (120 * pi() * 0.125::DOUBLE), 8) AS quintic FROM t""",
)
def _(spark, d):
    q = F.col("id") / F.lit(25.0)
    return spark.range(80).select(F.col("id").alias("i"), *[r6(f(q, 0.5), name, 8) for name, (f, _) in geo.KERNELS.items()])


_MIN = {a: f"(CASE WHEN p.{a} - c.{a} > 50 THEN p.{a} - c.{a} - 100 WHEN p.{a} - c.{a} < -50 THEN p.{a} - c.{a} + 100 ELSE p.{a} - c.{a} END)" for a in "xyz"}
_DIST = "sqrt(" + " + ".join(f"{_MIN[a]} * {_MIN[a]}" for a in "xyz") + ")"
_POINTS = f"{lenses.HALOS}, pts AS (SELECT hid AS pid, x, y, z FROM halos WHERE snap <= 26)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return lenses.halos(spark, d).where("snap <= 26").select(F.col("hid").alias("pid"), "x", "y", "z")


@query("d14_neighbours", f"WITH {_POINTS} SELECT c.pid AS cid, p.pid, round({_DIST}, 6) AS distance FROM pts c JOIN pts p ON c.pid % 20 = 0 WHERE {_DIST} < 7")
def _(spark, d):
    t = points(spark, d)
    return halos.neighbours(t, t.where("pid % 20 = 0").withColumnRenamed("pid", "cid"), 7.0, HALO_BOX).select("cid", "pid", r6(F.col("distance"), "distance"))


_NEAREST = f"dist AS (SELECT c.pid, {_DIST} AS dist FROM pts c JOIN pts p ON c.pid <> p.pid), h AS (SELECT pid, list_sort(list(dist))[8] AS h FROM dist GROUP BY pid)"


@query("x01_local_density", f"WITH {_POINTS}, {_NEAREST} SELECT pid, round(h, 6) AS h, round(8 / (4.0::DOUBLE / 3 * pi() * pow(h, 3)), 8) AS density FROM h")
def _(spark, d):
    return density.local_density(points(spark, d), HALO_BOX, 8).select("pid", r6(F.col("h"), "h"), r6(F.col("density"), "density", 8))


def _within(src: str, a: str, before: str) -> str:
    cells = f"unnest(range(CAST(floor(({a} - 2 * h) / 12.5::DOUBLE) AS BIGINT), CAST(floor(({a} + 2 * h) / 12.5::DOUBLE) AS BIGINT) + 1))"
    return f"SELECT * FROM (SELECT {before}x, y, z, h, {cells} AS i{a} FROM {src}) WHERE abs((i{a} + 0.5::DOUBLE) * 12.5::DOUBLE - {a}) < 2 * h"


_Q8 = " + ".join(f"pow((i{a} + 0.5::DOUBLE) * 12.5::DOUBLE - {a}, 2)" for a in "xyz")


@query(
    "d16_sph_adaptive",
    f"""WITH {_POINTS}, {_NEAREST}, p AS (SELECT x, y, z, greatest(h / 2, {3**0.5 / 2 * 12.5 / 2 * 1.0000001!r}::DOUBLE) AS h FROM pts JOIN h USING (pid)),
    sx AS ({_within('p', 'x', '')}), sy AS ({_within('sx', 'y', 'ix, ')}), s AS ({_within('sy', 'z', 'ix, iy, ')}),
    k AS (SELECT ix, iy, iz, h, sqrt({_Q8}) / h AS q FROM s)
    SELECT CAST((ix + 16) % 8 AS INT) AS ix, CAST((iy + 16) % 8 AS INT) AS iy, CAST((iz + 16) % 8 AS INT) AS iz, round(sum((0.25::DOUBLE * pow(greatest(2 - q, 0), 3) - pow(greatest(1 - q, 0), 3)) / (pi() * pow(h, 3))), 7) AS density FROM k GROUP BY 1, 2, 3 HAVING sum((0.25::DOUBLE * pow(greatest(2 - q, 0), 3) - pow(greatest(1 - q, 0), 3)) / (pi() * pow(h, 3))) > 0""",
)
def _(spark, d):
    return density.sph_adaptive(points(spark, d), HALO_BOX, 8, 8).select("ix", "iy", "iz", r6(F.col("density"), "density", 7))


def _edged() -> str:
    w = "OVER (PARTITION BY iy, iz ORDER BY ix)"
    lead, lag = (lambda k: f"lead(density, {k}) {w}"), (lambda k: f"lag(density, {k}) {w}")
    return f"CASE WHEN ix = 0 THEN -3.0::DOUBLE * density + 4.0::DOUBLE * {lead(1)} - {lead(2)} WHEN ix = {N - 1} THEN 3.0::DOUBLE * density - 4.0::DOUBLE * {lag(1)} + {lag(2)} ELSE {lead(1)} - {lag(1)} END"


@query("d20_edged_slope", f"WITH {lenses.PARTICLES}, {CIC}, {CELLS} SELECT ix, iy, iz, round(({_edged()}) / {2 * W}, 5) + 0 AS slope FROM cells")
def _(spark, d):
    return density.edged_slope(grid(spark, d), N, W).select("ix", "iy", "iz", (F.round("slope", 5) + 0).alias("slope"))


_FEW = f"{catalog.CIC}, {CELLS}, m AS (SELECT CAST(floor(x / {W}) AS INT) AS ix, CAST(floor(y / {W}) AS INT) AS iy, CAST(floor(z / {W}) AS INT) AS iz, count(*) AS n FROM particles GROUP BY 1, 2, 3), cn AS (SELECT ix, iy, iz, density, coalesce(n, 0) AS n FROM cells LEFT JOIN m USING (ix, iy, iz))"


def counted_cells(spark: SparkSession, d: str) -> DataFrame:
    met = density.ngp(lenses.particles(spark, d), BOX, N, F.count("*").alias("n"))
    return density.dense(grid(spark, d), N, "density").join(met, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", "density", F.coalesce("n", F.lit(0)).alias("n"))


def _means(src: str, dst: str, axis: str) -> str:
    others = ", ".join(f"i{a}" for a in "xyz" if a != axis)
    return f"{dst} AS (SELECT {others}, CAST(least(greatest(i{axis} + d.d, 0), {N - 1}) AS INT) AS i{axis}, sum(density) / 3 AS density FROM {src}, (VALUES (-1), (0), (1)) d(d) GROUP BY ALL)"


# A mirrored neighbour of an edge cell is the cell itself: it receives its own value where its neighbour would lie.
_REPAIRED = f"{_means('cn', 'r1', 'x')}, {_means('r1', 'r2', 'y')}, {_means('r2', 'r3', 'z')}, rep AS (SELECT ix, iy, iz, CASE WHEN cn.n < 20 THEN r3.density ELSE cn.density END AS density FROM cn JOIN r3 USING (ix, iy, iz))"
_B3 = f"{catalog._blur('rep', 'b1', 'x')}, {catalog._blur('b1', 'b2', 'y')}, {catalog._blur('b2', 'b3', 'z')}"


@query("f06_smooth_repaired", f"WITH {lenses.PARTICLES}, {_FEW}, {_REPAIRED}, {_B3} SELECT ix, iy, iz, round(density * ((SELECT sum(density) FROM cn) / (SELECT sum(density) FROM b3)), 5) AS density FROM b3")
def _(spark, d):
    return fourier.smoothed(counted_cells(spark, d), N, catalog._SIGMA, count="n", threshold=20).select("ix", "iy", "iz", r6(F.col("density"), "density", 5))


def _blurred(src: str, dst: str, sigma: float) -> str:
    ws = fourier.weights(sigma)
    table = ", ".join(f"({j - len(ws) // 2}, {w!r}::DOUBLE)" for j, w in enumerate(ws))
    out, now = [], src
    for k, axis in enumerate("xyz"):
        others = ", ".join(f"i{a}" for a in "xyz" if a != axis)
        images = f"(SELECT {others}, density, unnest([i{axis}, -i{axis} - 1, {2 * N - 1} - i{axis}]) AS image FROM {now})"
        out.append(f"{dst}{k} AS (SELECT {others}, CAST(image + w.d AS INT) AS i{axis}, sum(density * w.w) AS density FROM {images}, (VALUES {table}) w(d, w) WHERE image + w.d BETWEEN 0 AND {N - 1} GROUP BY ALL)")
        now = f"{dst}{k}"
    return ", ".join(out)


_SCALES = [0.5 + 1.0 * k / 4 for k in range(5)]
_AT_SCALE = "4 * (1 - (ln(least(greatest(n, 2), 100) + 1) - ln(3.0::DOUBLE)) / (ln(101.0::DOUBLE) - ln(3.0::DOUBLE)))"


@query(
    "f07_smooth_adaptive",
    f"WITH {lenses.PARTICLES}, {_FEW}, {', '.join(_blurred('cn', f'g{k}_', s) for k, s in enumerate(_SCALES))}, w AS ({' UNION ALL '.join(f'SELECT *, {k} AS k FROM (SELECT ix, iy, iz, density FROM g{k}_2)' for k in range(5))}), a AS (SELECT ix, iy, iz, {_AT_SCALE} AS at_ FROM cn), b AS (SELECT ix, iy, iz, sum(density * greatest(1 - abs(at_ - k), 0)) AS density FROM w JOIN a USING (ix, iy, iz) GROUP BY ALL) SELECT ix, iy, iz, round(density * ((SELECT sum(density) FROM cn) / (SELECT sum(density) FROM b)), 5) AS density FROM b",
)
def _(spark, d):
    return fourier.adaptively_smoothed(counted_cells(spark, d), N, 0.5, 1.5).select("ix", "iy", "iz", r6(F.col("density"), "density", 5))


@query(
    "f08_bilateral",
    f"WITH {lenses.PARTICLES}, {CIC}, s AS (SELECT ix, iy, sum(density) * {W} AS v FROM cic GROUP BY ix, iy), p AS (SELECT a.ix, a.iy, b.v, exp(-(pow(b.ix - a.ix, 2) + pow(b.iy - a.iy, 2)) / 2) * exp(-pow(b.v - a.v, 2) / (2 * 2500.0::DOUBLE)) AS w FROM s a JOIN s b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2) SELECT ix, iy, round(sum(w * v) / sum(w), 5) AS surface FROM p GROUP BY ix, iy",
)
def _(spark, d):
    return fourier.bilateral(density.project(grid(spark, d), ("ix", "iy"), W), 1.0, 50.0, 2).select("ix", "iy", r6(F.col("surface"), "surface", 5))


# Ordered series, sequences, ids, and the whole run.

_WALK = "SELECT tree, snap, node, mass, snap * snap / 4.0::DOUBLE AS t FROM nodes"


def _terms(terms: dict[int, float]) -> str:
    return " + ".join(f"({c}::DOUBLE) * {f'lead(mass, {k}) OVER w' if k > 0 else f'lag(mass, {-k}) OVER w' if k < 0 else 'mass'}" for k, c in terms.items())


def _span(a: int, b: int) -> str:
    at = lambda k: f"lead(t, {k}) OVER w" if k > 0 else f"lag(t, {-k}) OVER w" if k < 0 else "t"
    return f"({at(a)} - {at(b)})"


_D2 = f"CASE WHEN n < 3 THEN NULL WHEN i = 0 THEN ({_terms({0: -3, 1: 4, 2: -1})}) / {_span(2, 0)} WHEN i = n - 1 THEN ({_terms({0: 3, -1: -4, -2: 1})}) / {_span(0, -2)} ELSE ({_terms({1: 1, -1: -1})}) / {_span(1, -1)} END"
_F0, _F1 = {0: -25, 1: 48, 2: -36, 3: 16, 4: -3}, {-1: -3, 0: -10, 1: 18, 2: -6, 3: 1}
_R0, _R1 = ({-k: c for k, c in f.items()} for f in (_F0, _F1))
_D4 = f"CASE WHEN n < 5 THEN NULL WHEN i = 0 THEN ({_terms(_F0)}) / (3 * {_span(4, 0)}) WHEN i = 1 THEN ({_terms(_F1)}) / (3 * {_span(3, -1)}) WHEN i = n - 1 THEN ({_terms(_R0)}) / (3 * {_span(-4, 0)}) WHEN i = n - 2 THEN ({_terms(_R1)}) / (3 * {_span(-3, 1)}) ELSE ({_terms({2: -1, 1: 8, -1: -8, -2: 1})}) / (3 * {_span(2, -2)}) END"


@query("w06_derivatives", f"WITH {lenses.TREE}, s AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (PARTITION BY tree ORDER BY t) - 1 AS i FROM ({_WALK})) SELECT node, round({_D2}, 7) AS second, round({_D4}, 7) AS fourth FROM s WINDOW w AS (PARTITION BY tree ORDER BY t)")
def _(spark, d):
    s = lenses.tree(spark, d).select("tree", "node", "mass", (F.col("snap") * F.col("snap") / F.lit(4.0)).alias("t"))
    two = series.deriv(s, "tree", "t", "mass", 2).withColumnRenamed("slope", "second")
    return series.deriv(two, "tree", "t", "mass", 4).select("node", r6(F.col("second"), "second", 7), r6(F.col("slope"), "fourth", 7))


@query("w06_even_gradient", f"WITH {lenses.TREE}, g AS (SELECT node, mass, lag(mass) OVER w AS a, lead(mass) OVER w AS b FROM nodes WINDOW w AS (PARTITION BY tree ORDER BY snap)) SELECT node, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(b, mass) - coalesce(a, mass)) / (CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 2 END * 0.5::DOUBLE) END, 4) AS gradient FROM g")
def _(spark, d):
    return series.even_gradient(lenses.tree(spark, d), "tree", "snap", "mass", 0.5).select("node", r6(F.col("gradient"), "gradient", 4))


_XS, _YS = [0.0, 1.0, 2.5, 4.0, 8.0], [1.0, 3.0, 2.0, 5.0, -1.0]
_Y2 = series.second_derivatives(_XS, _YS)
_PIECES = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {ya}::DOUBLE, {yb}::DOUBLE, {sa!r}::DOUBLE, {sb!r}::DOUBLE)" for k, (a, b, ya, yb, sa, sb) in enumerate(zip(_XS, _XS[1:], _YS, _YS[1:], _Y2, _Y2[1:])))


@query(
    "w07_interpolation",
    f"WITH p AS (SELECT * FROM (VALUES {_PIECES}) p(k, a, b, ya, yb, sa, sb)), x AS (SELECT i, i / 10.0::DOUBLE - 1 AS x FROM range(110) r(i)), c AS (SELECT i, x, CASE WHEN x >= 4 THEN 3 WHEN x >= 2.5 THEN 2 WHEN x >= 1 THEN 1 ELSE 0 END AS k FROM x), t AS (SELECT i, b - a AS h, (b - x) / (b - a) AS u, (x - a) / (b - a) AS v, ya, yb, sa, sb FROM c JOIN p USING (k)) SELECT i, round(u * ya + v * yb, 8) AS linear, round(u * ya + v * yb + ((u * u * u - u) * sa + (v * v * v - v) * sb) * h * h / 6, 8) AS spline FROM t",
)
def _(spark, d):
    x = F.col("id") / F.lit(10.0) - 1.0
    return spark.range(110).select(F.col("id").alias("i"), r6(series.interpolated(x, _XS, _YS), "linear", 8), r6(series.interpolated(x, _XS, _YS, True), "spline", 8))


def _sobol(dim: int) -> str:
    terms = [f"(CASE WHEN (xor(i + 1, (i + 1) >> 1) >> {k}) & 1 = {int(k > 0)} THEN {v} ELSE 0 END)" for k, v in enumerate(series.directions(dim))]
    out = terms[0]
    for t in terms[1:14]:  # points below 2 ** 14
        out = f"xor({out}, {t})"
    return f"{out} / {float(1 << series.BITS)}::DOUBLE"


@query("r02_sobol", f"SELECT i, {', '.join(f'{_sobol(k)} AS u{k}' for k in range(6))} FROM range(1, 4096) r(i)")
def _(spark, d):
    return spark.range(1, 4096).select(F.col("id").alias("i"), *[series.sobol(F.col("id"), k).alias(f"u{k}") for k in range(6)])


_IMAGE = [(s, 0.1 * (k + 1)) for k, s in enumerate(range(20, 30))]
_MAPS = f"{lenses.HALOS}, maps AS (SELECT snap, CAST(floor(x / 50) AS INT) AS pixel, sum(m) AS value FROM halos WHERE snap BETWEEN 20 AND 29 GROUP BY 1, 2)"


def maps(spark: SparkSession, d: str) -> DataFrame:
    return lenses.halos(spark, d).where("snap between 20 and 29").groupBy("snap", F.floor(F.col("x") / 50).cast("int").alias("pixel")).agg(F.sum("m").alias("value"))


@query(
    "w08_time_image",
    f"""WITH {_MAPS}, t AS (SELECT i + 20 AS snap, 0.1::DOUBLE * (i + 1) AS a FROM range(10) r(i)), c AS (SELECT i, 0.1::DOUBLE + (i / 16.0::DOUBLE) * 0.9::DOUBLE AS a FROM range(17) r(i)),
    b AS (SELECT i, c.a, least((SELECT max(k) FROM range(10) q(k) WHERE 0.1::DOUBLE * (k + 1) <= c.a + 1e-12::DOUBLE), 8) AS j FROM c), w AS (SELECT i, j + 20 AS snap, 1 - (a - 0.1::DOUBLE * (j + 1)) / 0.1::DOUBLE AS w FROM b UNION ALL SELECT i, j + 21, (a - 0.1::DOUBLE * (j + 1)) / 0.1::DOUBLE FROM b)
    SELECT CAST(i AS INT) AS column, pixel, round(exp(sum(w * ln(value))), 2) AS value FROM w JOIN maps USING (snap) GROUP BY i, pixel""",
)
def _(spark, d):
    return series.time_image(maps(spark, d), _IMAGE, 17).select("column", "pixel", r6(F.col("value"), "value", 2))


@query("s33_relative_series", f"WITH {_MAPS}, a AS (SELECT snap, pixel, value, avg(value) OVER (PARTITION BY snap) AS own, (SELECT avg(value) FROM maps WHERE snap = 29) AS last FROM maps) SELECT snap, pixel, round(value / own, 6) AS own, round(value / last, 6) AS last FROM a")
def _(spark, d):
    m = maps(spark, d)
    own, last = series.relative(m).withColumnRenamed("value", "own"), series.relative(m, 29).withColumnRenamed("value", "last")
    return own.join(last, ["snap", "pixel"]).select("snap", "pixel", r6(F.col("own"), "own"), r6(F.col("last"), "last"))


def _unordered(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    t, n = lenses.lattice(spark, d)
    return t.select((F.col("pid") + 1).alias("pid"), "x", "y", "z"), n


_PROBE = "(VALUES (1), (2), (3), (4), (5)) w(w)"
_IDS = "p AS (SELECT CASE w WHEN 1 THEN 1 WHEN 2 THEN n // 4 WHEN 3 THEN n // 2 WHEN 4 THEN 10 * n ELSE 100 * n END AS id, n FROM (SELECT any_value(n) AS n FROM lattice), " + _PROBE + ")"


def _near(a: str) -> str:
    diff = f"(q.{a} - o.{a})"
    return f"(CASE WHEN {diff} > o.n / 2.0 THEN {diff} - o.n WHEN {diff} < -o.n / 2.0 THEN {diff} + o.n ELSE {diff} END)"


@query(
    "p05_id_ordering",
    f"""WITH {lenses.LATTICE}, {_IDS}, d AS (SELECT q.pid = o.pid + 1 AS next, {', '.join(f'{_near(a)} AS d{a}' for a in 'xyz')} FROM p JOIN lattice o ON o.pid + 1 = p.id JOIN lattice q ON q.pid IN (o.pid + 1, o.pid + o.n) WHERE p.id >= 1)
    SELECT round(coalesce(sum(CASE WHEN next THEN sqrt(pow(dx - 1, 2) + dy * dy + dz * dz) ELSE abs(dz) END), 0), 6) AS x_major, round(coalesce(sum(CASE WHEN next THEN sqrt(dx * dx + dy * dy + pow(dz - 1, 2)) ELSE abs(dx) END), 0), 6) AS z_major, CAST(count(*) FILTER (next) AS BIGINT) AS n_pairs FROM d""",
)
def _(spark, d):
    t, n = _unordered(spark, d)
    return particles.ordering_scores(t, n, float(n)).select(r6(F.col("x_major"), "x_major"), r6(F.col("z_major"), "z_major"), F.col("n_pairs").cast("long").alias("n_pairs"))


@query("p03_sites", f"WITH {lenses.LATTICE} SELECT pid + 1 AS pid, lx, ly, lz FROM lattice")
def _(spark, d):
    t, n = _unordered(spark, d)
    return particles.on_lattice(t, n, float(n), "x", 1).select("pid", "lx", "ly", "lz")


@query("p06_verdict", f"WITH {lenses.LATTICE} SELECT count(*) AS count, min(pid) AS low, max(pid) AS high, count(*) = any_value(n) * any_value(n) * any_value(n) AS is_full, min(pid) >= 0 AND max(pid) < any_value(n) * any_value(n) * any_value(n) AS in_range, count(DISTINCT pid) = count(*) AS is_unique FROM lattice")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return particles.validated(t, n, 0)


@query(
    "m07_run_summary",
    f"""WITH {OF_CLASS}, {catalog._GRID_OF_CLASSES}, v AS (SELECT dominant AS class, count(*) / 512.0::DOUBLE AS volume_fraction FROM b GROUP BY 1)
    SELECT class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM both_) AS DOUBLE), 6) AS mass_fraction, round(coalesce(any_value(volume_fraction), 0), 6) AS volume_fraction, round(avg(od), 5) AS mean_od FROM both_ LEFT JOIN v USING (class) GROUP BY class""",
)
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    run = particles.classified_run(t.select("pid", "x", "y", "z"), n, float(n), 8)
    return run["summary"].select("class", "n", r6(F.col("mass_fraction"), "mass_fraction"), r6(F.col("volume_fraction"), "volume_fraction"), r6(F.col("mean_od"), "mean_od", 5))


@query(
    "x06_pdf_shapes",
    f"WITH {OF_CLASS}, h AS (SELECT {_bin('od', _LOW, _HIGH, _BINS)} AS bin, count(*) FILTER (class = 0) / CAST(sum(count(*) FILTER (class = 0)) OVER () AS DOUBLE) AS a, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS b FROM both_ GROUP BY 1) SELECT round(corr(a, b), 6) AS correlation, corr(a, b) >= 0.95 AS alike FROM h WHERE {_IN}",
)
def _(spark, d):
    h = by_class(spark, d).withColumn("bin", stats.log_bin(F.col("od"), _LOW, _HIGH, _BINS)).where(F.col("bin").between(0, _BINS - 1))
    per = h.groupBy("bin").agg(F.count_if(F.col("class") == 0).cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    return per.agg(stats.correlation("a", "b").alias("c")).select(r6(F.col("c"), "correlation"), (F.col("c") >= 0.95).alias("alike"))
