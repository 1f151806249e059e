"""The library's queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import geometry as geo
from weft.operators import density, fourier, halos, morphology, stats, trees
from weft.sources import lenses
from weft.sources.lenses import BOX, HALO_BOX, TREE_BOX

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


N = 16
W = BOX / N
_CORNERS = ", ".join(f"({a},{b},{c})" for a, b, c in density.CORNERS)
CIC = f"""cic AS (SELECT CAST((fx + c.a) % {N} AS INT) AS ix, CAST((fy + c.b) % {N} AS INT) AS iy, CAST((fz + c.d) % {N} AS INT) AS iz,
  sum(mass * (CASE c.a WHEN 1 THEN px ELSE 1 - px END) * (CASE c.b WHEN 1 THEN py ELSE 1 - py END) * (CASE c.d WHEN 1 THEN pz ELSE 1 - pz END)) / {W**3} AS density
  FROM (SELECT *, CAST(floor(x / {W}) AS BIGINT) AS fx, CAST(floor(y / {W}) AS BIGINT) AS fy, CAST(floor(z / {W}) AS BIGINT) AS fz,
    x / {W} - floor(x / {W}) AS px, y / {W} - floor(y / {W}) AS py, z / {W} - floor(z / {W}) AS pz FROM particles),
  (VALUES {_CORNERS}) c(a, b, d) GROUP BY ALL)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    return density.cic(lenses.particles(spark, d), BOX, N, F.col("mass"))


@query("d08_cic_density", f"WITH {lenses.PARTICLES}, {CIC} SELECT ix, iy, iz, round(density, 6) AS density FROM cic")
def _(spark, d):
    return grid(spark, d).select("ix", "iy", "iz", r6(F.col("density"), "density"))


_OD = f"od AS (SELECT density / ((SELECT sum(mass) FROM particles) / {BOX**3}) AS od FROM cic)"
_LOG = "CASE WHEN {v} <= 0 OR {v} < {lo} THEN -1 WHEN {v} >= {hi} THEN {n} ELSE least(greatest(floor((log10({v}) - log10({lo})) / ((log10({hi}) - log10({lo})) / {n})), 0), {n} - 1) END"


CELLS = f"cells AS (SELECT CAST(i % {N} AS INT) AS ix, CAST(i // {N} % {N} AS INT) AS iy, CAST(i // {N * N} AS INT) AS iz, coalesce(density, 0) AS density FROM range({N**3}) r(i) LEFT JOIN cic ON ix = i % {N} AND iy = i // {N} % {N} AND iz = i // {N * N})"


@query(
    "a10_volume_pdf",
    f"""WITH {lenses.PARTICLES}, {CIC}, {CELLS}, {_OD.replace("FROM cic", "FROM cells")}, h AS (SELECT CAST({_LOG.format(v="od", lo="0.0137::DOUBLE", hi="41.7::DOUBLE", n=24)} AS INT) AS bin, count(*) AS count FROM od GROUP BY 1)
    SELECT bin, count, round(count / ((SELECT sum(count) FROM h WHERE bin BETWEEN 0 AND 23) * 0.0137::DOUBLE * (pow(41.7::DOUBLE / 0.0137, (bin + 1) / 24.0::DOUBLE) - pow(41.7::DOUBLE / 0.0137, bin / 24.0::DOUBLE))), 6) AS pdf
    FROM h WHERE bin BETWEEN 0 AND 23""",
)
def pdf_of_box(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: particles to cells to overdensities to their density of probability; an empty cell lies below the range."""
    cells = density.dense(grid(spark, d), N, "density")
    mean = lenses.particles(spark, d).agg((F.sum("mass") / BOX**3).alias("mean"))
    od = cells.join(F.broadcast(mean)).select((F.col("density") / F.col("mean")).alias("od"))  # one row
    hist = stats.counts(od, stats.log_bin(F.col("od"), 0.0137, 41.7, 24))
    b, step = F.col("bin"), 41.7 / 0.0137
    width = 0.0137 * (F.pow(F.lit(step), (b + 1) / 24.0) - F.pow(F.lit(step), b / 24.0))
    return stats.pdf(hist, width, 24).select("bin", "count", r6(F.col("pdf"), "pdf"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_of_box(spark, sf_dir)


@query("d03_projection", f"WITH {lenses.PARTICLES}, {CIC} SELECT ix, iy, round(sum(density) * {W}, 5) AS surface FROM cic GROUP BY ALL")
def _(spark, d):
    return density.project(grid(spark, d), ("ix", "iy"), W).select("ix", "iy", r6(F.col("surface"), "surface", 5))


@query("f09_slice", f"WITH {lenses.PARTICLES}, {CIC} SELECT ix, iy, round(sum(density) * {W}, 5) AS surface FROM cic WHERE iz >= 2 AND iz < 6 GROUP BY ALL")
def _(spark, d):
    return density.project(grid(spark, d), ("ix", "iy"), W, 2, 6).select("ix", "iy", r6(F.col("surface"), "surface", 5))


@query("d19_cell_velocity", f"WITH {lenses.PARTICLES} SELECT CAST(floor(x * {N} / {BOX}) AS INT) AS ix, CAST(floor(y * {N} / {BOX}) AS INT) AS iy, CAST(floor(z * {N} / {BOX}) AS INT) AS iz, count(*) AS n, round(avg(v), 6) AS v FROM particles GROUP BY 1, 2, 3")
def _(spark, d):
    return density.ngp(lenses.particles(spark, d), BOX, N, F.count("*").alias("n"), r6(F.avg("v"), "v"))


def _seen(src: str, values: tuple[str, ...], reach: int) -> str:
    """FROM clause: every cell that is, or has a neighbour, in ``src``, with the values around it as in density.around."""
    steps = [(a, d) for a in "xyz" for d in range(-reach, reach + 1) if d]
    place = lambda axis, d: ", ".join(f"CAST((i{a} - ({d if a == axis else 0}) + {N}) % {N} AS INT) AS i{a}" for a in "xyz")
    keys = " UNION ".join(f"SELECT {place(a, d)} FROM {src}" for a, d in [("x", 0), *steps])
    joins = " ".join(
        f"LEFT JOIN {src} {a}_{'p' if d > 0 else 'm'}{abs(d)} ON " + " AND ".join(f"{a}_{'p' if d > 0 else 'm'}{abs(d)}.i{b} = (k.i{b} + ({d if a == b else 0}) + {N}) % {N}" for b in "xyz") for a, d in steps
    )
    cols = ", ".join(f"coalesce({a}_{'p' if d > 0 else 'm'}{abs(d)}.{v}, 0) AS {v}_{a}_{'p' if d > 0 else 'm'}{abs(d)}" for v in values for a, d in steps)
    return f"(SELECT k.ix, k.iy, k.iz, {cols} FROM ({keys}) k {joins})"


def _slope(v: str, a: str, order: int = 2) -> str:
    if order == 2:
        return f"(({v}_{a}_p1 - {v}_{a}_m1) / {2 * W})"
    return f"((8.0::DOUBLE * ({v}_{a}_p1 - {v}_{a}_m1) - ({v}_{a}_p2 - {v}_{a}_m2)) / {12 * W})"


@query("d20_gradient", f"WITH {lenses.PARTICLES}, {CIC} SELECT ix, iy, iz, {', '.join(f'round({_slope("density", a)}, 5) + 0 AS g{a}' for a in 'xyz')} FROM {_seen('cic', ('density',), 1)}")
def _(spark, d):
    return density.gradient(grid(spark, d), N, W).select("ix", "iy", "iz", *[(F.round(f"g{a}", 5) + 0).alias(f"g{a}") for a in "xyz"])


@query("d20_gradient_4", f"WITH {lenses.PARTICLES}, {CIC} SELECT ix, iy, iz, {', '.join(f'round({_slope("density", a, 4)}, 5) + 0 AS g{a}' for a in 'xyz')} FROM {_seen('cic', ('density',), 2)}")
def _(spark, d):
    return density.gradient(grid(spark, d), N, W, order=4).select("ix", "iy", "iz", *[(F.round(f"g{a}", 5) + 0).alias(f"g{a}") for a in "xyz"])


@query("a17_grid_variance", f"WITH {lenses.PARTICLES}, {CIC}, {CELLS} SELECT round(var_pop(density), 6) AS variance, round(min(density), 6) AS low, round(max(density), 6) AS high FROM cells")
def _(spark, d):
    return density.dense(grid(spark, d), N, "density").agg(r6(F.var_pop("density"), "variance"), r6(F.min("density"), "low"), r6(F.max("density"), "high"))


_H = 3.0
_R = int(2 * _H / W) + 1


@query(
    "d10_sph_2d",
    f"""WITH {lenses.PARTICLES}, s AS (SELECT mass, floor(x / {W}) + a.d AS i, floor(y / {W}) + b.d AS j,
      sqrt(pow((floor(x / {W}) + a.d + 0.5::DOUBLE) * {W} - x, 2) + pow((floor(y / {W}) + b.d + 0.5::DOUBLE) * {W} - y, 2)) / {_H} AS q
      FROM particles, range(-{_R}, {_R + 1}) a(d), range(-{_R}, {_R + 1}) b(d))
    SELECT CAST((i + {N}) % {N} AS INT) AS ix, CAST((j + {N}) % {N} AS INT) AS iy,
      round(sum(mass * (0.25 * pow(greatest(2 - q, 0), 3) - pow(greatest(1 - q, 0), 3)) * (10.0::DOUBLE / (7 * pi() * {_H * _H}))), 4) AS surface FROM s WHERE q < 2 GROUP BY 1, 2""",
)
def _(spark, d):
    return density.sph_2d(lenses.particles(spark, d), BOX, N, _H).select("ix", "iy", r6(F.col("surface"), "surface", 4))


@query("a01_histogram", "WITH h AS (SELECT CAST(CASE WHEN l_quantity < 5.5 THEN -1 WHEN l_quantity >= 45.5 THEN 20 ELSE least(floor((l_quantity - 5.5::DOUBLE) * 20 / 40), 19) END AS INT) AS bin FROM lineitem) SELECT bin, count(*) AS count FROM h GROUP BY bin")
def _(spark, d):
    return stats.counts(lenses.table(spark, d, "lineitem").select("l_quantity"), stats.linear_bin(F.col("l_quantity"), 5.5, 45.5, 20))


_L = _LOG.format(v="o_totalprice", lo="1234.5::DOUBLE", hi="456789.1::DOUBLE", n=30)


@query("a02_histogram_log", f"SELECT CAST({_L} AS INT) AS bin, count(*) AS count FROM orders GROUP BY 1")
def _(spark, d):
    return stats.counts(lenses.table(spark, d, "orders").select("o_totalprice"), stats.log_bin(F.col("o_totalprice"), 1234.5, 456789.1, 30))


@query("a03_weighted_histogram", f"SELECT CAST({_L} AS INT) AS bin, round(sum(o_totalprice), 2) AS weight FROM orders GROUP BY 1")
def _(spark, d):
    t = lenses.table(spark, d, "orders").select("o_totalprice")
    return stats.counts(t, stats.log_bin(F.col("o_totalprice"), 1234.5, 456789.1, 30), F.col("o_totalprice")).select("bin", F.round("weight", 2).alias("weight"))


@query(
    "a06_jackknife",
    f"""WITH {lenses.PARTICLES}, c AS (SELECT CAST(floor((mass - 0.5::DOUBLE) * 25 / 50) AS INT) AS bin, floor(x / 32) + 2 * floor(y / 32) + 4 * floor(z / 32) AS box, count(*) AS c FROM particles WHERE mass >= 0.5 AND mass < 50.5 GROUP BY ALL)
    SELECT bin, round(sum(c) / 8.0::DOUBLE, 6) AS mean, round(sqrt((sum(c * c) - CAST(sum(c) AS DOUBLE) * sum(c) / 8) / 7 / 8), 6) AS error FROM c GROUP BY bin""",
)
def _(spark, d):
    box = F.floor(F.col("x") / 32) + 2 * F.floor(F.col("y") / 32) + 4 * F.floor(F.col("z") / 32)
    return stats.jackknife(lenses.particles(spark, d), stats.linear_bin(F.col("mass"), 0.5, 50.5, 25), box, 25, 8).select("bin", r6(F.col("mean"), "mean"), r6(F.col("error"), "error"))


_SHARES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_P = ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS p{round(q * 100)}" for q in _SHARES)


@query("a08_class_statistics", f"SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, {_P} FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(spark, d):
    out = stats.percentiles(lenses.table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), "o_totalprice", "o_orderstatus", _SHARES)
    return out.select("o_orderstatus", "n", *[r6(F.col(c), c, 4) for c in ("mean", "std", *[f"p{round(q * 100)}" for q in _SHARES])])


@query("a16_suffix_max", f"WITH {lenses.TREE} SELECT node, max(mass) OVER (PARTITION BY tree ORDER BY snap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_max FROM nodes")
def _(spark, d):
    return stats.suffix_max(lenses.tree(spark, d), "mass", "tree", "snap").select("node", "suffix_max")


_EDGE = "(1234.5::DOUBLE * pow(456789.1::DOUBLE / 1234.5::DOUBLE, {k} / 30.0::DOUBLE))"
_MIDDLE = f"sqrt({_EDGE.format(k='bin')} * {_EDGE.format(k='(bin + 1)')})"


@query(
    "a22_power_law",
    f"WITH h AS (SELECT CAST({_L} AS INT) AS bin, count(*) AS count FROM orders GROUP BY 1), p AS (SELECT {_MIDDLE} AS m, count / ((SELECT sum(count) FROM h WHERE bin BETWEEN 0 AND 29) * ({_EDGE.format(k='(bin + 1)')} - {_EDGE.format(k='bin')})) AS pdf FROM h WHERE bin BETWEEN 0 AND 29) SELECT round(regr_slope(log10(pdf), log10(m)), 6) AS slope, round(regr_intercept(log10(pdf), log10(m)), 6) AS intercept FROM p WHERE m BETWEEN 20000 AND 400000",
)
def _(spark, d):
    h = stats.weighted_pdf(lenses.table(spark, d, "orders").select("o_totalprice"), "o_totalprice", F.lit(1.0), 1234.5, 456789.1, 30)
    return stats.power_law(h, 1234.5, 456789.1, 30, 20000.0, 400000.0).select(r6(F.col("slope"), "slope"), r6(F.col("intercept"), "intercept"))


@query("p02_lagrangian", f"WITH {lenses.LATTICE} SELECT pid, lx, ly, lz, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM lattice")
def _(spark, d):
    t, _n = lenses.lattice(spark, d)
    return t.select("pid", "lx", "ly", "lz", *[r6(F.col(a), a) for a in "xyz"])


@query("p06_validate_ids", "SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high, count(DISTINCT event_id) = count(*) AS is_unique FROM events")
def _(spark, d):
    return lenses.table(spark, d, "events").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"), (F.count_distinct("event_id") == F.count("*")).alias("is_unique"))


_RHO = "3.0::DOUBLE * 70 * 70 * (0.3::DOUBLE * pow(1 + z, 3) + 0.7::DOUBLE) / (8 * pi() * 4.30091e-9::DOUBLE)"


@query(
    "p27_mass_radius",
    f"WITH t AS (SELECT n_nationkey, n_nationkey / 10.0::DOUBLE AS z, 1e12::DOUBLE * (n_nationkey + 1) AS m FROM nation) SELECT n_nationkey, round(sqrt(0.3::DOUBLE * pow(1 + z, 3) + 0.7::DOUBLE), 6) AS hubble, round(cbrt(m / (4.0::DOUBLE / 3 * pi() * 200 * {_RHO})) * (1 + z), 6) AS r200c FROM t",
)
def _(spark, d):
    t = lenses.table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 10.0).alias("z"), (1e12 * (F.col("n_nationkey") + 1)).alias("m"))
    z = F.col("z")
    return t.select("n_nationkey", r6(geo.hubble_frac(z, 0.3, 0.7), "hubble"), r6(geo.mass_to_radius(F.col("m"), geo.reference_density("200c", z, 70.0, 0.3, 0.7), 1 / (1 + z)), "r200c"))


_TETRA = []
for _path in density.PATHS:
    _c, _walk = [0, 0, 0], ["000"]
    for _axis in _path:
        _c[_axis] = 1
        _walk.append("".join(map(str, _c)))
    _TETRA.append(_walk)
_JOINS = " ".join(f"JOIN lattice p{a}{b}{c} ON p{a}{b}{c}.lx = (o.lx + {a}) % o.n AND p{a}{b}{c}.ly = (o.ly + {b}) % o.n AND p{a}{b}{c}.lz = (o.lz + {c}) % o.n" for a, b, c in density.CORNERS)


def _edge(k: str, a: str) -> str:
    diff = f"(p{k}.{a} - p000.{a})"
    return f"(CASE WHEN {diff} > o.n / 2.0 THEN {diff} - o.n WHEN {diff} < -o.n / 2.0 THEN {diff} + o.n ELSE {diff} END)"


def _volume(walk: list[str]) -> str:
    u, v, w = ([_edge(k, a) for a in "xyz"] for k in walk[1:])
    return f"abs({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) - {u[1]} * ({v[0]} * {w[2]} - {v[2]} * {w[0]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]})) "


_PARTS = " UNION ALL ".join(f"SELECT unnest([{', '.join(f'p{k}.pid' for k in walk)}]) AS pid, {_volume(walk)} AS v FROM lattice o {_JOINS}" for walk in _TETRA)


VERTICES = f"t AS ({_PARTS}), vols AS (SELECT pid, count(*) AS n_tetra, sum(v) / 24.0::DOUBLE AS volume, CASE WHEN sum(v) > 0 THEN count(*) / 24.0::DOUBLE / (sum(v) / 24.0::DOUBLE) ELSE 0 END AS raw FROM t GROUP BY pid)"


@query("d07_tetra_vertex_density", f"WITH {lenses.LATTICE}, {VERTICES} SELECT pid, n_tetra, round(volume, 5) AS volume, round(raw / (SELECT avg(raw) FROM vols), 5) AS density FROM vols")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return density.tetra_vertex(t, n, float(n)).select("pid", "n_tetra", r6(F.col("volume"), "volume", 5), r6(F.col("density"), "density", 5))


@query(
    "d07_volume_stats",
    f"WITH {lenses.LATTICE}, {VERTICES}, f AS (SELECT greatest(volume, (SELECT min(volume) FILTER (volume > 0) / 1e20 FROM vols)) AS v FROM vols) SELECT round(min(v), 6) AS low, round(max(v), 6) AS high, round(exp(avg(ln(v))), 6) AS geometric_mean, round(stddev_pop(v), 6) AS deviation, round(stddev_pop(ln(v)), 6) AS log_deviation FROM f",
)
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return density.volume_stats(density.tetra_vertex(t, n, float(n))).select(*[r6(F.col(c), c) for c in ("low", "high", "geometric_mean", "deviation", "log_deviation")])


def _moved(a: str) -> str:
    diff = f"(p.{a} - o.{a})"
    return f"(CASE WHEN {diff} > o.n / 2.0 THEN {diff} - o.n WHEN {diff} < -o.n / 2.0 THEN {diff} + o.n ELSE {diff} END)"


def _crossing(bit: int, way: dict[str, int]) -> str:
    """Pairs of sites along a direction of the lattice that stand in reversed order."""
    met = " AND ".join(f"p.l{a} = (o.l{a} + h.h * ({way.get(a, 0)}) + o.n) % o.n" for a in "xyz")
    order = " + ".join(f"{sign} * {_moved(a)}" for a, sign in way.items())
    return f"SELECT DISTINCT unnest([o.pid, p.pid]) AS pid, {bit} AS bit FROM lattice o JOIN range(1, 100) h(h) ON h.h < o.n // 4 JOIN lattice p ON {met} WHERE {order} < 0"


_AXES = [_crossing(morphology.AXES[a], {a: 1}) for a in "xyz"]
_DIAGONAL = [_crossing(bit, {u: 1, v: sign}) for across in "xyz" for u, v in [[a for a in "xyz" if a != across]] for bit, sign in zip(morphology.DIAGONALS[across], (1, -1), strict=True)]


def _classes(ways: list[str]) -> str:
    sets = ", ".join(f"bit_count(f & {m})" for m in (7, 25, 98, 388))
    return f"crossings AS ({' UNION ALL '.join(ways)}), flags AS (SELECT l.pid, any_value(l.x) AS x, any_value(l.y) AS y, any_value(l.z) AS z, any_value(l.n) AS n, CAST(coalesce(bit_or(c.bit), 0) AS INTEGER) AS f FROM lattice l LEFT JOIN crossings c USING (pid) GROUP BY l.pid), classes AS (SELECT *, CAST(greatest({sets}) AS INT) AS class FROM flags)"


CLASSES = _classes(_AXES + _DIAGONAL)


def classes(spark: SparkSession, d: str) -> DataFrame:
    t, n = lenses.lattice(spark, d)
    return morphology.classify(t, n, float(n))


@query("m01_morphology", f"WITH {lenses.LATTICE}, {CLASSES} SELECT pid, f AS flags, class FROM classes")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return morphology.crossings(t, n, float(n)).select("pid", "flags", morphology.class_of().alias("class"))


@query("m01_cartesian", f"WITH {lenses.LATTICE}, {_classes(_AXES)} SELECT pid, class FROM classes")
def _(spark, d):
    t, n = lenses.lattice(spark, d)
    return morphology.classify(t, n, float(n), cartesian_only=True)


_SHARES_SQL = "SELECT class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM classes) AS DOUBLE), 6) AS fraction, (SELECT count(*) FILTER (class = 0) FROM classes) >= 0.99::DOUBLE * (SELECT count(*) FROM classes) AS linear FROM classes GROUP BY class"


@query("m03_fractions", f"WITH {lenses.LATTICE}, {CLASSES} {_SHARES_SQL}")
def _(spark, d):
    return morphology.fractions(classes(spark, d)).select("class", "n", r6(F.col("fraction"), "fraction"), "linear")


_GRID_OF_CLASSES = """g AS (SELECT CAST(floor(x * 8 / n) % 8 AS INT) AS ix, CAST(floor(y * 8 / n) % 8 AS INT) AS iy, CAST(floor(z * 8 / n) % 8 AS INT) AS iz, count(*) FILTER (class = 0) AS n0, count(*) FILTER (class = 1) AS n1, count(*) FILTER (class = 2) AS n2, count(*) FILTER (class = 3) AS n3 FROM classes GROUP BY 1, 2, 3),
    a AS (SELECT CAST(i % 8 AS INT) AS ix, CAST(i // 8 % 8 AS INT) AS iy, CAST(i // 64 AS INT) AS iz, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3 FROM range(512) r(i) LEFT JOIN g ON ix = i % 8 AND iy = i // 8 % 8 AND iz = i // 64),
    b AS (SELECT *, CASE greatest(n0, n1, n2, n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS dominant FROM a)"""


def classes_on_grid(spark: SparkSession, d: str) -> DataFrame:
    t, n = lenses.lattice(spark, d)
    return morphology.deposit(morphology.classify(t, n, float(n)).join(t, "pid"), float(n), 8)


@query("m05_morphology_grid", f"WITH {lenses.LATTICE}, {CLASSES}, {_GRID_OF_CLASSES} SELECT *, {', '.join(f'round(coalesce(n{c} / nullif(CAST(n0 + n1 + n2 + n3 AS DOUBLE), 0), 0), 6) AS f{c}' for c in range(4))} FROM b")
def _(spark, d):
    return classes_on_grid(spark, d).select("ix", "iy", "iz", "n0", "n1", "n2", "n3", "dominant", *[r6(F.col(f"f{c}"), f"f{c}") for c in range(4)])


@query("m05_volume_fractions", f"WITH {lenses.LATTICE}, {CLASSES}, {_GRID_OF_CLASSES} SELECT dominant AS class, count(*) AS n, round(count(*) / 512.0::DOUBLE, 6) AS fraction FROM b GROUP BY 1")
def _(spark, d):
    return morphology.volume_fractions(classes_on_grid(spark, d)).select("class", "n", r6(F.col("fraction"), "fraction"))


@query("j03_overlaps", f"WITH {lenses.HALOS} SELECT a.hid AS i, b.hid AS j FROM halos a JOIN halos b ON a.snap = b.snap AND (a.r > b.r OR a.r = b.r AND a.hid < b.hid) WHERE pow((a.r + b.r) * 3, 2) >= pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)")
def _(spark, d):
    return halos.overlaps(lenses.halos(spark, d), 3.0, 16.0, "snap").select("i", "j")


@query("j04_host_counts", f"WITH p AS ({S['j03_overlaps']}), b AS (SELECT i AS hid, 0 AS h, 1 AS s FROM p UNION ALL SELECT j, 1, 0 FROM p) SELECT hid, CAST(sum(h) AS BIGINT) AS n_hosts, CAST(sum(s) AS BIGINT) AS n_subs FROM b GROUP BY hid")
def _(spark, d):
    return halos.hosts(Q["j03_overlaps"](spark, d))


def _image(a: str) -> str:
    return f"(CASE WHEN t.{a} - c.{a} > 50 THEN t.{a} - c.{a} - 100 WHEN t.{a} - c.{a} < -50 THEN t.{a} - c.{a} + 100 ELSE t.{a} - c.{a} END)"


_D = "sqrt(" + " + ".join(f"{_image(a)} * {_image(a)}" for a in "xyz") + ")"


@query(
    "j08_best_match",
    f"""WITH {lenses.HALOS}, m AS (SELECT t.hid AS tid, c.hid, {_D} AS distance, {_D} + 0.3::DOUBLE * abs(log10(c.m / t.m)) AS score FROM halos t JOIN halos c ON c.snap = t.snap - 1 WHERE {_D} < 5 AND c.m > t.m * 0.05::DOUBLE)
    SELECT tid, arg_min(hid, (score, hid)) AS hid, round(min(score), 6) AS score FROM m GROUP BY tid""",
)
def _(spark, d):
    return halos.best_before(lenses.halos(spark, d), HALO_BOX).select("tid", "hid", r6(F.col("score"), "score"))


@query("s07_first_sub", "SELECT o_custkey AS grp, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY o_custkey) - count(*) AS BIGINT) AS first_sub FROM orders GROUP BY o_custkey")
def _(spark, d):
    return halos.first_sub(lenses.table(spark, d, "orders").select(F.col("o_custkey").alias("grp")))


@query("s20_top_halos", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return lenses.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("g06_main_branches", f"WITH RECURSIVE {lenses.TREE}, b AS (SELECT node AS root, node, main_prog, 0 AS step FROM nodes WHERE descendant IS NULL AND mass >= 150000 UNION ALL SELECT b.root, n.node, n.main_prog, step + 1 FROM b JOIN nodes n ON n.node = b.main_prog) SELECT root, node, step FROM b")
def _(spark, d):
    t = lenses.tree(spark, d)
    return trees.branches(t, t.where("descendant is null and mass >= 150000").select("node"))


_WALK = "SELECT *, x - lag(x) OVER (PARTITION BY tree ORDER BY snap) AS d FROM nodes"


@query("w02_unwrap", f"WITH {lenses.TREE} SELECT node, round(x + {TREE_BOX} * sum(CASE WHEN d > {TREE_BOX / 2} THEN -1 WHEN d < -{TREE_BOX / 2} THEN 1 ELSE 0 END) OVER (PARTITION BY tree ORDER BY snap), 6) AS path FROM ({_WALK})")
def _(spark, d):
    return trees.unwrapped(lenses.tree(spark, d), TREE_BOX, "tree", "snap").select("node", r6(F.col("path"), "path"))


@query("w04_branch_index", f"WITH {lenses.TREE} SELECT tree, count(*) AS length, min(snap) AS snap_min, max(snap) AS snap_max, max(mass) AS mass_max, arg_max(node, snap) AS root FROM nodes GROUP BY tree")
def _(spark, d):
    return trees.branch_index(lenses.tree(spark, d))


@query("w05_mass_jumps", f"WITH {lenses.TREE}, b AS (SELECT *, lag(mass) OVER (PARTITION BY tree ORDER BY snap) AS before FROM nodes) SELECT tree, node, snap, mass, before FROM b WHERE abs(mass - before) > 0.5::DOUBLE * before")
def _(spark, d):
    return trees.jumps(lenses.tree(spark, d))


_K = 4
_POOL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for _w, a, b, c in density.samples(_K))
_SIDES = " UNION ALL ".join(
    "SELECT o.n, p000.x, p000.y, p000.z, " + ", ".join(f"{_edge(k, a)} AS d{j}{a}" for j, k in enumerate(walk[1:], 1) for a in "xyz") + f" FROM lattice o {_JOINS}" for walk in _TETRA
)
_AT = ", ".join(f"CAST((floor(({a} + w1 * d1{a} + w2 * d2{a} + w3 * d3{a}) * 4 / n) + 4) % 4 AS INT) AS i{a}" for a in "xyz")


def sheet(spark: SparkSession, d: str) -> DataFrame:
    t, n = lenses.lattice(spark, d)
    return density.tetra_density(t, n, float(n), 4, _K)


SHEET = f"sides AS ({_SIDES}), sheet AS (SELECT {_AT}, count(*) AS n, count(*) * ({1 / (6 * _K)}::DOUBLE / pow(any_value(n) / 4.0::DOUBLE, 3)) AS density FROM sides, (VALUES {_POOL}) pool(w1, w2, w3) GROUP BY 1, 2, 3)"


@query("d01_tetra_density", f"WITH {lenses.LATTICE}, {SHEET} SELECT ix, iy, iz, n, round(density, 6) AS density FROM sheet")
def _(spark, d):
    return sheet(spark, d).select("ix", "iy", "iz", "n", r6(F.col("density"), "density"))


@query("d04_tetra_slice", f"WITH {lenses.LATTICE}, {SHEET} SELECT ix, iy, round(sum(density) * (SELECT any_value(n) / 4.0::DOUBLE FROM lattice), 5) AS surface FROM sheet WHERE iz >= 1 AND iz < 3 GROUP BY ix, iy")
def _(spark, d):
    width = lenses.lattice(spark, d)[1] / 4.0
    return density.project(sheet(spark, d), ("ix", "iy"), width, 1, 3).select("ix", "iy", r6(F.col("surface"), "surface", 5))


_LCIC = f"""lcic AS (SELECT CAST((floor(x * 8 / n) + c.a) % 8 AS INT) AS ix, CAST((floor(y * 8 / n) + c.b) % 8 AS INT) AS iy, CAST((floor(z * 8 / n) + c.d) % 8 AS INT) AS iz,
  sum((CASE c.a WHEN 1 THEN x * 8 / n - floor(x * 8 / n) ELSE 1 - x * 8 / n + floor(x * 8 / n) END) * (CASE c.b WHEN 1 THEN y * 8 / n - floor(y * 8 / n) ELSE 1 - y * 8 / n + floor(y * 8 / n) END)
    * (CASE c.d WHEN 1 THEN z * 8 / n - floor(z * 8 / n) ELSE 1 - z * 8 / n + floor(z * 8 / n) END)) / pow(any_value(n) / 8.0::DOUBLE, 3) AS density
  FROM lattice, (VALUES {_CORNERS}) c(a, b, d) GROUP BY 1, 2, 3)"""


def _sampled(shift: str) -> str:
    g = {a: f"({a} * 8 / n - {shift})" for a in "xyz"}
    i = {a: f"CAST((floor({g[a]}) + c.{c} + 8) % 8 AS INT)" for a, c in zip("xyz", "abd", strict=True)}
    weight = " * ".join(f"(CASE c.{c} WHEN 1 THEN {g[a]} - floor({g[a]}) ELSE 1 - {g[a]} + floor({g[a]}) END)" for a, c in zip("xyz", "abd", strict=True))
    return f"WITH {lenses.LATTICE}, {_LCIC}, parts AS (SELECT pid, {', '.join(f'{i[a]} AS i{a}' for a in 'xyz')}, {weight} AS w FROM lattice, (VALUES {_CORNERS}) c(a, b, d)) SELECT pid, round(sum(w * coalesce(density, 0)), 6) AS density FROM parts LEFT JOIN lcic USING (ix, iy, iz) GROUP BY pid"


def sampled(spark: SparkSession, d: str, shift: float) -> DataFrame:
    t, n = lenses.lattice(spark, d)
    cells = density.cic(t, float(n), 8, F.lit(1.0))
    return density.sample(t, cells, float(n), 8, shift).select("pid", r6(F.col("density"), "density"))


@query("m04_sample_corner", _sampled("0"))
def _(spark, d):
    return sampled(spark, d, 0.0)


@query("d08_sample_centre", _sampled("0.5::DOUBLE"))
def _(spark, d):
    return sampled(spark, d, 0.5)


_Q3 = " + ".join(f"pow((floor({a} / {W}) + {a}s.d + 0.5::DOUBLE) * {W} - {a}, 2)" for a in "xyz")


@query(
    "d11_sph_3d",
    f"""WITH {lenses.PARTICLES}, s AS (SELECT mass, floor(x / {W}) + xs.d AS i, floor(y / {W}) + ys.d AS j, floor(z / {W}) + zs.d AS k, sqrt({_Q3}) / {_H} AS q
      FROM particles, range(-{_R}, {_R + 1}) xs(d), range(-{_R}, {_R + 1}) ys(d), range(-{_R}, {_R + 1}) zs(d))
    SELECT CAST((i + {N}) % {N} AS INT) AS ix, CAST((j + {N}) % {N} AS INT) AS iy, CAST((k + {N}) % {N} AS INT) AS iz,
      round(sum(mass * (0.25::DOUBLE * pow(greatest(2 - q, 0), 3) - pow(greatest(1 - q, 0), 3)) / (pi() * {_H**3})), 5) AS density FROM s WHERE q < 2 GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return density.sph_3d(lenses.particles(spark, d), BOX, N, _H).select("ix", "iy", "iz", r6(F.col("density"), "density", 5))


_VECTORS = f"g AS (SELECT CAST(floor(x * {N} / {BOX}) AS INT) AS ix, CAST(floor(y * {N} / {BOX}) AS INT) AS iy, CAST(floor(z * {N} / {BOX}) AS INT) AS iz, avg(v) AS vx, avg(mass) AS vy, avg(x) AS vz FROM particles GROUP BY 1, 2, 3)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return density.ngp(lenses.particles(spark, d), BOX, N, F.avg("v").alias("vx"), F.avg("mass").alias("vy"), F.avg("x").alias("vz"))


@query("d20_divergence", f"WITH {lenses.PARTICLES}, {_VECTORS} SELECT ix, iy, iz, round({_slope('vx', 'x')} + {_slope('vy', 'y')} + {_slope('vz', 'z')}, 9) + 0 AS divergence FROM {_seen('g', ('vx', 'vy', 'vz'), 1)}")
def _(spark, d):
    return density.divergence(vectors(spark, d), N, W).select("ix", "iy", "iz", (F.round("divergence", 9) + 0).alias("divergence"))


@query(
    "d20_curl",
    f"WITH {lenses.PARTICLES}, {_VECTORS} SELECT ix, iy, iz, round({_slope('vz', 'y')} - {_slope('vy', 'z')}, 9) + 0 AS cx, round({_slope('vx', 'z')} - {_slope('vz', 'x')}, 9) + 0 AS cy, round({_slope('vy', 'x')} - {_slope('vx', 'y')}, 9) + 0 AS cz FROM {_seen('g', ('vx', 'vy', 'vz'), 1)}",
)
def _(spark, d):
    return density.curl(vectors(spark, d), N, W).select("ix", "iy", "iz", *[(F.round(f"c{a}", 9) + 0).alias(f"c{a}") for a in "xyz"])


def _dft(src: str, dst: str, axis: str, sign: int) -> str:
    others = ", ".join(f"i{a}" for a in "xyz" if a != axis)
    return f"""{dst} AS (SELECT {others}, i{axis}, sum(re * cos(t) - im * sin(t)) AS re, sum(re * sin(t) + im * cos(t)) AS im
  FROM (SELECT {others}, k.k AS i{axis}, re, im, {sign * 2}::DOUBLE * pi() * ((s.i{axis} * k.k) % {N}) / {N} AS t FROM {src} s, range({N}) k(k)) GROUP BY ALL)"""


_MODE2 = " + ".join(f"pow(CASE WHEN i{a} < {N // 2} THEN i{a} ELSE i{a} - {N} END, 2)" for a in "xyz")
_FORTH = f"f0 AS (SELECT ix, iy, iz, density AS re, 0::DOUBLE AS im FROM cic), {_dft('f0', 'f1', 'x', -1)}, {_dft('f1', 'f2', 'y', -1)}, {_dft('f2', 'f3', 'z', -1)}"


@query(
    "f04_power_spectrum",
    f"""WITH {lenses.PARTICLES}, {CIC}, {_FORTH}, m AS (SELECT sqrt({_MODE2}) AS m, (re * re + im * im) / pow((SELECT sum(mass) / {BOX**3} FROM particles), 2) * {BOX**3} / {float(N) ** 6} AS p FROM f3 WHERE ix + iy + iz > 0)
    SELECT CAST(floor(m) AS INT) AS bin, count(*) AS n_modes, round(avg(m) * 2 * pi() / {BOX}, 6) AS k, round(avg(p), 4) AS power FROM m WHERE m < {N // 2} GROUP BY 1""",
)
def _(spark, d):
    mean = lenses.particles(spark, d).agg((F.sum("mass") / BOX**3).alias("mean"))
    od = grid(spark, d).join(F.broadcast(mean)).select("ix", "iy", "iz", (F.col("density") / F.col("mean")).alias("od"))  # one row
    spectrum = fourier.power_spectrum(od, N, BOX)  # a constant shift changes only the mode at zero, alone in bin 0
    return spectrum.where("bin > 0").select("bin", "n_modes", r6(F.col("k"), "k"), r6(F.col("power"), "power", 4))


_RADIUS = 6.0


@query(
    "f03_smooth_fourier",
    f"WITH {lenses.PARTICLES}, {CIC}, {_FORTH}, w AS (SELECT ix, iy, iz, re * g AS re, im * g AS im FROM (SELECT *, exp(-({_MODE2}) * pow(2 * pi() / {BOX}, 2) * {_RADIUS**2 / 2}) AS g FROM f3)), {_dft('w', 'b1', 'x', 1)}, {_dft('b1', 'b2', 'y', 1)}, {_dft('b2', 'b3', 'z', 1)} SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, round(re / {N**3}, 5) AS density FROM b3",
)
def _(spark, d):
    return fourier.smooth(grid(spark, d), N, BOX, _RADIUS).select("ix", "iy", "iz", r6(F.col("density"), "density", 5))


_SIGMA = 0.8
_WS = fourier.weights(_SIGMA)
_WROWS = ", ".join(f"({j - len(_WS) // 2}, {w!r}::DOUBLE)" for j, w in enumerate(_WS))


def _blur(src: str, dst: str, axis: str) -> str:
    others = ", ".join(f"i{a}" for a in "xyz" if a != axis)
    images = f"(SELECT {others}, density, unnest([i{axis}, -i{axis} - 1, {2 * N - 1} - i{axis}]) AS image FROM {src})"
    return f"{dst} AS (SELECT {others}, CAST(image + w.d AS INT) AS i{axis}, sum(density * w.w) AS density FROM {images}, (VALUES {_WROWS}) w(d, w) WHERE image + w.d BETWEEN 0 AND {N - 1} GROUP BY ALL)"


_BLURS = f"{_blur('cic', 's1', 'x')}, {_blur('s1', 's2', 'y')}, {_blur('s2', 's3', 'z')}"


@query("f06_gaussian_smooth", f"WITH {lenses.PARTICLES}, {CIC}, {_BLURS} SELECT ix, iy, iz, round(density, 5) AS density FROM s3")
def _(spark, d):
    return fourier.blur(grid(spark, d), N, _SIGMA).select("ix", "iy", "iz", r6(F.col("density"), "density", 5))


@query(
    "a18_smoothing_quality",
    f"WITH {lenses.PARTICLES}, {CIC}, {_BLURS}, p AS (SELECT cic.density AS a, s3.density AS b FROM cic JOIN s3 USING (ix, iy, iz)) SELECT round(corr(a, b), 6) AS correlation, round(sum(b) / sum(a), 6) AS mass_ratio, round(sqrt(avg(pow(b - a, 2))), 6) AS rmse, round(avg(abs(b - a) / a) FILTER (a > 0), 4) AS relative_change, round(corr(a, b) FILTER (a > (SELECT quantile_cont(a, 0.9) FROM p)), 6) AS high_correlation FROM p",
)
def _(spark, d):
    before = grid(spark, d)
    pairs = before.join(fourier.blur(before, N, _SIGMA, "density").withColumnRenamed("density", "after"), ["ix", "iy", "iz"])
    return fourier.quality(pairs, "density", "after").select(*[r6(F.col(c), c) for c in ("correlation", "mass_ratio", "rmse", "high_correlation")], r6(F.col("relative_change"), "relative_change", 4))


@query("p37_box_selection", f"WITH {lenses.PARTICLES} SELECT round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, mass FROM particles WHERE {' AND '.join(f'(abs({a} - 3) <= 8 OR abs({a} - 3) >= {BOX - 8})' for a in 'xyz')}")
def _(spark, d):
    t = lenses.particles(spark, d)
    near = [F.abs(geo.min_image(F.col(a) - 3.0, BOX)) <= 8.0 for a in "xyz"]
    return t.where(near[0] & near[1] & near[2]).select(*[r6(F.col(a), a, 3) for a in "xyz"], "mass")


@query("x02_histogram_2d", f"WITH {lenses.PARTICLES} SELECT CAST(least(floor(x * 20 / {BOX}), 19) AS INT) AS i, CAST(least(floor(y * 20 / {BOX}), 19) AS INT) AS j, count(*) AS count FROM particles WHERE z >= 16 AND z < 48 GROUP BY 1, 2")
def _(spark, d):
    t = lenses.particles(spark, d).where("z >= 16 and z < 48")
    return t.groupBy(geo.cell(F.col("x"), BOX, 20).alias("i"), geo.cell(F.col("y"), BOX, 20).alias("j")).agg(F.count("*").alias("count"))


@query("j06_floor_lookup", f"WITH s AS ({S['s07_first_sub']}) SELECT e.event_id * 2 AS idx, s.grp, s.first_sub AS start FROM events e LEFT JOIN s ON e.event_id * 2 >= s.first_sub AND e.event_id * 2 < s.first_sub + s.n")
def _(spark, d):
    starts = Q["s07_first_sub"](spark, d)
    return halos.floor_lookup(lenses.table(spark, d, "events").select((F.col("event_id") * 2).alias("idx")), starts.select("grp", F.col("first_sub").alias("start"), F.col("n").alias("length")))


_FAMILY = "SELECT event_id AS node, CASE WHEN event_id > 0 THEN (event_id - 1) // 3 END AS descendant FROM events WHERE value >= 5"


@query("g05_progenitors", f"WITH RECURSIVE n AS ({_FAMILY}), p AS (SELECT node AS root, node, 0 AS depth FROM n WHERE descendant IS NULL OR descendant NOT IN (SELECT node FROM n) UNION ALL SELECT p.root, n.node, p.depth + 1 FROM p JOIN n ON n.descendant = p.node) SELECT root, node, depth FROM p")
def _(spark, d):
    e = lenses.table(spark, d, "events")
    nodes = e.where("value >= 5").select(F.col("event_id").alias("node"), F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 3)).alias("descendant"))
    return trees.progenitors(nodes, trees.tops(nodes).select("node"))


@query("g11_halo_at_snapshot", f"WITH {lenses.TREE} SELECT tree, arg_min(node, (abs(snap - 4), snap)) AS node, arg_min(snap, (abs(snap - 4), snap)) AS snap FROM nodes GROUP BY tree")
def _(spark, d):
    return trees.nearest(lenses.tree(spark, d), 4)


_BOXES = 8


@query(
    "a07_conditional_jackknife",
    f"""WITH r AS (SELECT unnest(['all', o_orderstatus]) AS cls, CAST(floor((o_totalprice - 1000::DOUBLE) * 20 / 400000) AS INT) AS bin, o_orderkey % {_BOXES} AS box FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 401000),
    c AS (SELECT cls, bin, box, count(*) AS c FROM r GROUP BY ALL) SELECT cls, bin, round(sum(c) / 8.0::DOUBLE, 6) AS mean, round(sqrt((sum(c * c) - CAST(sum(c) AS DOUBLE) * sum(c) / 8) / 7 / 8), 6) AS error FROM c GROUP BY cls, bin""",
)
def _(spark, d):
    t = lenses.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(F.lit("all"), F.col("o_orderstatus"))).alias("cls"))
    out = stats.jackknife(t, stats.linear_bin(F.col("o_totalprice"), 1000.0, 401000.0, 20), F.col("o_orderkey") % _BOXES, 20, _BOXES, "cls")
    return out.select("cls", "bin", r6(F.col("mean"), "mean"), r6(F.col("error"), "error"))


@query("r03_matmul", "WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.v::DOUBLE * b.v), 4) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def _(spark, d):
    return stats.gram(lenses.table(spark, d, "embeddings").select("embedding"), "embedding", 64).select("i", "j", r6(F.col("v"), "v", 4))


@query("s25_snapshot_number", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN -1 ELSE n_nationkey END AS snap FROM nation")
def _(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.format_string("snapshot_%03d.hdf5", k)).when(k % 3 == 1, F.format_string("snapdir_%03d/snapshot_%03d.1.hdf5", k, k)).otherwise("ics.hdf5")
    return lenses.table(spark, d, "nation").select("n_nationkey", geo.snapshot_number(name).alias("snap"))


def queries() -> dict:
    from weft.plans import survey  # noqa: F401  adds its own

    return dict(Q)


def sql() -> dict:
    from weft.plans import survey  # noqa: F401

    return dict(S)
