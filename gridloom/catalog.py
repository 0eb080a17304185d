"""Registered queries and the SQL that gives the same rows.

Images are rasters of lineitem: x is quantity - 1, y the month since 1995-01 and z the tax in hundredths; f counts
returned rows (flag R is m). Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grid as G
from .functions.grid import AXES, Shape
from .operators import image as I
from .operators import landmarks as L
from .operators import mapgrid as M
from .operators import metrics as Q
from .operators import normal as N
from .operators import solve as V
from .plans import register as R
from .streaming.frames import event_frames

R2, R3, SPACING = Shape(50, 83), Shape(50, 83, 9), 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


#: Added before rounding where sums of short decimals may end in a five exactly, which the two engines' last bits would decide.
NUDGE = 1.3e-8


def month() -> Column:
    return (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1


def pair(spark: SparkSession, sf_dir: str, shape: Shape = R2) -> DataFrame:
    """(x, y, z, f, m) of lineitem's raster."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    z = F.round(F.col("l_tax") * 100) if shape.nz > 1 else F.lit(0)
    flag = lambda c: F.count(F.when(F.col("l_returnflag") == c, 1))
    return I.rasterise(rows, F.col("l_quantity") - 1, month(), z, shape, {"f": flag("A"), "m": flag("R")})


def scaled(spark: SparkSession, sf_dir: str, shape: Shape = R2) -> DataFrame:
    """The raster divided by its greatest values; lineitem is read once, however often the image is."""
    return I.normalise(V.settle(pair(spark, sf_dir, shape)), "f", "m")


def formula_map(spark: SparkSession, shape: Shape = R2, spacing: int = SPACING) -> DataFrame:
    """A map by a formula: dof 0 is 0, the others are from -1.4 to 1.4."""
    zero = M.zero_map(spark, shape, spacing)
    return zero.withColumn("value", F.when(F.col("dof") == 0, 0.0).otherwise(((F.col("node") * 7 + F.col("dof") * 3) % 5 - 2) * F.lit(0.7)))


def raster_sql(shape: Shape = R2, name: str = "q") -> str:
    z = "CAST(round(l_tax * 100) AS INT)" if shape.nz > 1 else "0"
    return f"""{name} AS (
  SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z,
         CAST(coalesce(t.f, 0) AS DOUBLE) AS f, CAST(coalesce(t.m, 0) AS DOUBLE) AS m
  FROM range({shape.nx}) a CROSS JOIN range({shape.ny}) b CROSS JOIN range({shape.nz}) c LEFT JOIN (
    SELECT CAST(l_quantity - 1 AS INT) AS x, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS y, {z} AS z,
           count(*) FILTER (WHERE l_returnflag = 'A') AS f, count(*) FILTER (WHERE l_returnflag = 'R') AS m
    FROM lineitem GROUP BY 1, 2, 3) t ON t.x = a.range AND t.y = b.range AND t.z = c.range)"""


def scaled_sql(shape: Shape = R2) -> str:
    return f"{raster_sql(shape, 'raw')},\nq AS (SELECT x, y, z, f / (SELECT max(f) FROM raw) AS f, m / (SELECT max(m) FROM raw) AS m FROM raw)"


def axes_sql(shape: Shape = R2, s: int = SPACING, prefix: str = "", cover: bool = False) -> str:
    n = f"CAST(ceil(e / {s}e0) AS INT) + 1" if cover else f"greatest(3, CAST(ceil((e + 1) / {s}e0) AS INT))"
    ext = ", ".join(f"({d}, {e})" for d, e in enumerate(shape.extents))
    return f"""{prefix}axis AS (
  SELECT dim, e, CAST(i AS INT) AS idx, CASE WHEN e = 1 THEN 0e0 ELSE -((n - 1) * {s} - e) / 2e0 - 0.5e0 + i * {s} END AS loc
  FROM (SELECT dim, e, n, unnest(range(n)) AS i FROM (
    SELECT dim, e, CASE WHEN e = 1 THEN 1 ELSE {n} END AS n FROM (VALUES {ext}) v(dim, e)))),
{prefix}nb AS (
  SELECT *, CASE WHEN e = 1 THEN 0 ELSE greatest(0, CAST(ceil(loc - {s}) AS INT)) END AS lo_pix,
         CASE WHEN e = 1 THEN 1 ELSE least(e, CAST(floor(loc + {s}) AS INT)) END AS hi_pix FROM {prefix}axis),
{prefix}axp AS (
  SELECT dim, idx, CAST(p AS INT) AS p, CASE WHEN e = 1 THEN 1e0 ELSE 1e0 - abs(p - loc) / {s}e0 END AS w
  FROM (SELECT *, unnest(range(lo_pix, hi_pix)) AS p FROM {prefix}nb))"""


def nodes_of(shape: Shape = R2, s: int = SPACING, cover: bool = False) -> Shape:
    return M.map_shape(shape, s, cover)


def formula_sql(shape: Shape = R2, s: int = SPACING) -> str:
    n = nodes_of(shape, s).size
    return f"map AS (SELECT CAST(a.range AS INT) AS node, CAST(d.range AS INT) AS dof, CASE WHEN d.range = 0 THEN 0e0 ELSE ((a.range * 7 + d.range * 3) % 5 - 2) * 0.7e0 END AS value FROM range({n}) a, range({shape.ndim + 1}) d)"


def inside_sql(shape: Shape = R2, s: int = SPACING, cover: bool = False, name: str = "k", source: str = "g") -> str:
    """k: one row per pixel of g and node."""
    n = nodes_of(shape, s, cover)
    return f"""{name} AS (
  SELECT (az.idx * {n.ny} + ay.idx) * {n.nx} + ax.idx AS n, (g.z * {shape.ny} + g.y) * {shape.nx} + g.x AS pos, ax.w * ay.w * az.w AS phi, g.*
  FROM {source} g JOIN axp ax ON ax.dim = 0 AND ax.p = g.x JOIN axp ay ON ay.dim = 1 AND ay.p = g.y JOIN axp az ON az.dim = 2 AND az.p = g.z)"""


def gradient_sql(c: str, axis: str) -> str:
    others = ", ".join(a for a in AXES if a != axis)
    w = f"OVER (PARTITION BY {others} ORDER BY {axis})"
    return f"0.5e0 * (coalesce(lead({c}) {w}, 0) - coalesce(lag({c}) {w}, 0))"


def gradients_sql(shape: Shape = R2) -> str:
    gs = ", ".join(f"{gradient_sql('g0', a)} AS g{k}" for k, a in enumerate(AXES[: shape.ndim], 1))
    return f"{scaled_sql(shape)},\nh AS (SELECT x, y, z, f - m AS d, 1e0 - 0.5e0 * (f + m) AS g0 FROM q),\ng AS (SELECT *, {gs} FROM h)"


def normal_sql(shape: Shape = R2, compat: bool = True) -> str:
    dofs = " UNION ALL ".join(f"SELECT {d} AS dof, n, pos, phi, d, g{d} AS g FROM k" for d in range(shape.ndim + 1))
    return f"""{gradients_sql(shape)},
{axes_sql(shape)},
{inside_sql(shape)},
kd AS ({dofs}),
mat AS (SELECT a.dof, a.n AS r, b.n AS c, sum(a.g * a.phi * b.g * b.phi) AS v, sum(0.5e0 * a.g * a.d * a.phi) AS u
        FROM kd a JOIN kd b ON a.pos = b.pos AND a.dof = b.dof GROUP BY 1, 2, 3)"""


# Rasters and images


@query(f"WITH {raster_sql()} SELECT x, y, z, f, m FROM q")
def raster_2d(spark, sf_dir):
    return pair(spark, sf_dir)


@query(f"WITH {raster_sql(R3)} SELECT x, y, z, f, m FROM q")
def raster_3d(spark, sf_dir):
    return pair(spark, sf_dir, R3)


@query("SELECT CAST(user_id AS BIGINT) AS x, CAST(day(ts) AS INT) AS y, round(sum(value), 6) AS v FROM events GROUP BY 1, 2")
def raster_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("x"), F.dayofmonth("ts").alias("y")).agg(r6(F.sum("value")).alias("v"))


@query("SELECT CAST(i - 1 AS INT) AS x, vec_id AS y, round(CAST(embedding[i] AS DOUBLE), 6) + 0e0 AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def raster_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e")).select("x", "y", r6(F.col("e").cast("double")).alias("v"))


@query(f"WITH {raster_sql()} SELECT min(f) AS f_min, max(f) AS f_max, min(m) AS m_min, max(m) AS m_max FROM q")
def image_minmax(spark, sf_dir):
    p = pair(spark, sf_dir)
    return p.agg(F.min("f").alias("f_min"), F.max("f").alias("f_max"), F.min("m").alias("m_min"), F.max("m").alias("m_max"))


@query(f"WITH {scaled_sql()} SELECT x, y, z, round(f, 6) + 0e0 AS f, round(m, 6) + 0e0 AS m FROM q")
def image_normalize(spark, sf_dir):
    return scaled(spark, sf_dir).select(*AXES, r6("f").alias("f"), r6("m").alias("m"))


@query(f"WITH {scaled_sql()} SELECT x, y, z, round(f - m, 6) + 0e0 AS d FROM q")
def image_difference(spark, sf_dir):
    return I.difference(scaled(spark, sf_dir)).select(*AXES, r6("d").alias("d"))


@query(f"WITH {raster_sql()} SELECT x, y, z, CAST(1 AS DOUBLE) AS v FROM q")
def filled_mask(spark, sf_dir):
    return I.filled_mask(pair(spark, sf_dir))


@query(f"WITH {raster_sql()} SELECT x, y, z, CASE WHEN x < 25 THEN f ELSE 0 END AS f FROM q")
def masked_image(spark, sf_dir):
    p = pair(spark, sf_dir)
    mask = G.grid(spark, R2).withColumn("v", F.when(F.col("x") < 25, 1.0).otherwise(0.0))
    return I.apply_mask(p.select(*AXES, "f"), mask, "f")


@query(f"WITH {raster_sql(R3)} SELECT x, y, z, CAST((z * 83 + y) * 50 + x AS INT) AS pos, x AS ux, y AS uy, z AS uz FROM q")
def ravel_unravel(spark, sf_dir):
    at = pair(spark, sf_dir, R3).select(*AXES, G.ravel(F.col("x"), F.col("y"), F.col("z"), R3).alias("pos"))
    return at.select("*", *(c.alias(f"u{a}") for a, c in zip(AXES, G.unravel(F.col("pos"), R3), strict=True)))


@query("SELECT p_partkey, least(greatest(p_size, 10), 40) AS clamped, greatest(p_size, 20) AS lo, least(p_size + 15, 50) AS hi, greatest(0, least(p_size + 15, 50) - greatest(p_size, 20)) AS n FROM part")
def clamp_overlap(spark, sf_dir):
    lo, hi = G.overlap(F.col("p_size"), F.col("p_size") + 15, F.lit(20), F.lit(50))
    return table(spark, sf_dir, "part").select("p_partkey", G.clamp(F.col("p_size"), F.lit(10), F.lit(40)).alias("clamped"), lo.alias("lo"), hi.alias("hi"), F.greatest(F.lit(0), hi - lo).alias("n"))


@query("SELECT p_partkey, round((1e0 - abs(p_size - 25.5e0) / 10e0) * (1e0 - abs(p_partkey % 50 - 20e0) / 10e0), 6) + 0e0 AS phi, round((1e0 - abs(p_size % 2 - 0.5e0)), 6) + 0e0 AS unscaled FROM part")
def basis_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r6(G.basis([F.col("p_size"), F.col("p_partkey") % 50], [F.lit(25.5), F.lit(20.0)], 10)).alias("phi"), r6(G.basis([F.col("p_size") % 2], [F.lit(0.5)])).alias("unscaled"))


def _gradient(axis: str):
    def f(spark, sf_dir):
        return pair(spark, sf_dir, R3).select(*AXES, I.gradient("f", axis).alias("g"))

    f.__name__ = f"gradient_{axis}"
    query(f"WITH {raster_sql(R3)} SELECT x, y, z, {gradient_sql('f', axis)} AS g FROM q")(f)


for _axis in AXES:
    _gradient(_axis)


@query(f"WITH {gradients_sql(R3)} SELECT x, y, z, round(g0, 6) + 0e0 AS g0, round(g1, 6) + 0e0 AS g1, round(g2, 6) + 0e0 AS g2, round(g3, 6) + 0e0 AS g3, round(d, 6) + 0e0 AS d FROM g")
def tmatrix_gradients(spark, sf_dir):
    g = I.registration_gradients(scaled(spark, sf_dir, R3), R3)
    return g.select(*AXES, *(r6(c).alias(c) for c in ("g0", "g1", "g2", "g3", "d")))


@query("SELECT CAST(unnest([-50, -1, 0, 1, 50]) AS INT) AS o")
def von_neumann_offsets(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in G.von_neumann(R2)], "o int")


@query("SELECT CAST(c.range * 4150 + b.range * 50 + a.range AS INT) AS o FROM range(-1, 2) a, range(-1, 2) b, range(-1, 2) c")
def moore_offsets(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in G.moore(R3)], "o int")


# Similarity

HIST = "t AS (SELECT greatest(max(f), max(m)) AS mx FROM q),\nj AS (SELECT CAST(floor(f / mx * 49e0 + 0.5e0) AS INT) AS bx, CAST(floor(m / mx * 49e0 + 0.5e0) AS INT) AS by_, count(*) AS c FROM q, t GROUP BY 1, 2)"
EQUAL = "j AS (SELECT CAST(least(48, floor(f * 49e0)) AS INT) AS bx, CAST(least(48, floor(m * 49e0)) AS INT) AS by_, count(*) AS c FROM q WHERE f BETWEEN 0 AND 1 AND m BETWEEN 0 AND 1 GROUP BY 1, 2)"
ENTROPIES = """n AS (SELECT sum(c) * 1e0 AS n FROM j),
h1 AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(c) / any_value(n) AS p FROM j, n GROUP BY bx)),
h2 AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(c) / any_value(n) AS p FROM j, n GROUP BY by_)),
h12 AS (SELECT -sum(c / n * log2(c / n)) AS h FROM j, n)"""
MI = "SELECT round(sum(c / n * ln(c * n / (cx * 1e0 * cy))), 6) + 0e0 AS mi FROM (SELECT c * 1e0 AS c, sum(c) OVER () * 1e0 AS n, sum(c) OVER (PARTITION BY bx) AS cx, sum(c) OVER (PARTITION BY by_) AS cy FROM j)"


@query(f"WITH {raster_sql()}, {HIST} SELECT bx, by_, c FROM j")
def joint_histogram(spark, sf_dir):
    return Q.joint_histogram(pair(spark, sf_dir))


@query(f"WITH {raster_sql()}, {HIST} {MI}")
def mutual_information(spark, sf_dir):
    return Q.mutual_information(Q.joint_histogram(pair(spark, sf_dir))).select(r6("mi").alias("mi"))


@query(f"WITH {scaled_sql()}, {EQUAL}, {ENTROPIES} SELECT round(h1.h, 6) AS h1, round(h2.h, 6) AS h2, round(h12.h, 6) AS h12 FROM h1, h2, h12")
def entropy(spark, sf_dir):
    h = Q.equal_histogram(scaled(spark, sf_dir))
    sides = [Q.entropy(h, c).select(r6("h").alias(n)) for c, n in (("bx", "h1"), ("by_", "h2"), (None, "h12"))]
    return sides[0].crossJoin(F.broadcast(sides[1])).crossJoin(F.broadcast(sides[2]))


@query(f"WITH {scaled_sql()}, {EQUAL}, {ENTROPIES} SELECT round(h1.h + h2.h - h12.h, 6) AS mi_bits FROM h1, h2, h12")
def mi_bits(spark, sf_dir):
    return Q.compare_images(scaled(spark, sf_dir)).select(r6("mi_bits").alias("mi_bits"))


@query(f"WITH {scaled_sql()}, {EQUAL}, {ENTROPIES} SELECT round((h1.h + h2.h - h12.h) / least(h1.h, h2.h), 6) AS proficiency FROM h1, h2, h12")
def proficiency(spark, sf_dir):
    return Q.compare_images(scaled(spark, sf_dir)).select(r6("proficiency").alias("proficiency"))


_FOUR = [("fixed/moved", "f", "m"), ("accepted/fixed", "(f + m) / 2e0", "f"), ("result/fixed", "0.9e0 * f + 0.1e0 * m", "f"), ("accepted/result", "(f + m) / 2e0", "0.9e0 * f + 0.1e0 * m")]


@query(
    f"WITH {scaled_sql()}, s AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS pair_id, {a} AS f, {b} AS m FROM q" for k, a, b in _FOUR)
    + """), j AS (SELECT pair_id, least(48, floor(f * 49e0)) AS bx, least(48, floor(m * 49e0)) AS by_, count(*) * 1e0 AS c FROM s GROUP BY 1, 2, 3),
n AS (SELECT pair_id, sum(c) AS n FROM j GROUP BY 1),
h1 AS (SELECT pair_id, -sum(p * log2(p)) AS h FROM (SELECT pair_id, sum(c) / any_value(n) AS p FROM j JOIN n USING (pair_id) GROUP BY pair_id, bx) GROUP BY 1),
h2 AS (SELECT pair_id, -sum(p * log2(p)) AS h FROM (SELECT pair_id, sum(c) / any_value(n) AS p FROM j JOIN n USING (pair_id) GROUP BY pair_id, by_) GROUP BY 1),
h12 AS (SELECT pair_id, -sum(c / n * log2(c / n)) AS h FROM j JOIN n USING (pair_id) GROUP BY 1)
SELECT pair_id, round(h1.h + h2.h - h12.h, 6) AS mi_bits, round((h1.h + h2.h - h12.h) / least(h1.h, h2.h), 6) AS proficiency
FROM h1 JOIN h2 USING (pair_id) JOIN h12 USING (pair_id)"""
)
def image_compare_4way(spark, sf_dir):
    f, m = F.col("f"), F.col("m")
    images = scaled(spark, sf_dir).select(*AXES, f.alias("fixed"), m.alias("moved"), ((f + m) / 2).alias("accepted"), (F.lit(0.9) * f + F.lit(0.1) * m).alias("result"))
    return Q.compare_registration(images).select("pair_id", r6("mi_bits").alias("mi_bits"), r6("proficiency").alias("proficiency"))


@query(f"WITH {formula_sql()} SELECT dof, round(regr_r2(value * 0.5e0 + node % 3, value), 6) AS r2 FROM map WHERE dof > 0 GROUP BY dof")
def map_r2(spark, sf_dir):
    both = formula_map(spark).filter("dof > 0").select("dof", F.col("value").alias("a"), (F.col("value") * 0.5 + F.col("node") % 3).alias("b"))
    return Q.map_r2(both).select("dof", r6("r2").alias("r2"))


@query(
    f"""WITH {raster_sql(R3)}, t AS (SELECT z, greatest(max(f), max(m)) AS mx FROM q GROUP BY z),
j AS (SELECT z, floor(f / mx * 49e0 + 0.5e0) AS bx, floor(m / mx * 49e0 + 0.5e0) AS by_, count(*) AS c FROM q JOIN t USING (z) GROUP BY 1, 2, 3),
s AS (SELECT z, c * 1e0 AS c, sum(c) OVER (PARTITION BY z) * 1e0 AS n, sum(c) OVER (PARTITION BY z, bx) AS cx, sum(c) OVER (PARTITION BY z, by_) AS cy FROM j),
mi AS (SELECT z, sum(c / n * ln(c * n / (cx * 1e0 * cy))) AS mi FROM s GROUP BY z)
SELECT z, round(mi, 6) AS mi, round(regr_slope(mi, z) OVER (ORDER BY z ROWS 4 PRECEDING), 6) AS slope FROM mi"""
)
def mi_trend(spark, sf_dir):
    mi = Q.mutual_information(Q.joint_histogram(pair(spark, sf_dir, R3), ("z",)), ("z",)).withColumn("run", F.lit(0))
    return mi.withColumn("slope", Q.trend("z", "mi", ("run",))).select("z", r6("mi").alias("mi"), r6("slope").alias("slope"))


# Maps


@query(f"WITH {axes_sql(R3)} SELECT dim, idx, loc, lo_pix, hi_pix FROM nb")
def node_locations(spark, sf_dir):
    return M.map_axis(spark, R3, SPACING)


@query("WITH RECURSIVE l AS (SELECT 10 AS spacing UNION ALL SELECT spacing * 2 FROM l WHERE 50 > 2 * spacing + 1 OR 83 > 2 * spacing + 1 OR 9 > 2 * spacing + 1) SELECT CAST(row_number() OVER (ORDER BY spacing DESC) - 1 AS INT) AS level, CAST(spacing AS INT) AS spacing FROM l")
def spacing_schedule(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(M.levels(R3, SPACING))), "level int, spacing int")


@query(f"WITH {axes_sql(R3)} SELECT dim, idx, p, round(w, 6) + 0e0 AS w FROM axp")
def pixel_neighbourhood(spark, sf_dir):
    return M.axis_pixel(spark, R3, SPACING).select("dim", "idx", "p", r6("w").alias("w"))


@query(f"WITH {raster_sql()}, {axes_sql()} SELECT x, y, (SELECT least(max(idx), 4) FROM axis WHERE dim = 0 AND (loc <= x OR idx = 0)) AS cx, (SELECT least(max(idx), 7) FROM axis WHERE dim = 1 AND (loc <= y OR idx = 0)) AS cy FROM q")
def cell_corner(spark, sf_dir):
    return pair(spark, sf_dir).select("x", "y", M.cell_corner(F.col("x"), 50, SPACING).alias("cx"), M.cell_corner(F.col("y"), 83, SPACING).alias("cy"))


@query(f"WITH {raster_sql(R3)}, g AS (SELECT x, y, z FROM q), {axes_sql(R3)}, {inside_sql(R3)} SELECT n, pos, round(phi, 6) + 0e0 AS phi FROM k")
def basis_incidence(spark, sf_dir):
    k = N.incidence(pair(spark, sf_dir, R3).select(*AXES), R3, SPACING)
    return k.select("n", G.ravel(F.col("x"), F.col("y"), F.col("z"), R3).alias("pos"), r6("phi").alias("phi"))


def corners_sql(shape: Shape, s: int, points: str, key: str, out: str, cover: bool = False, source: str = "map") -> str:
    """out(key, d0, ..): the map at points(key, lx, ly, lz)."""
    n, dims = nodes_of(shape, s, cover), range(shape.ndim)
    lo = [M.node_locations(e, s, cover)[0] for e in shape.extents]
    base = ", ".join(f"CAST(greatest(least(floor((l{AXES[d]} - ({lo[d]}e0)) / {s}e0), {n.extents[d] - 2}), 0) AS INT) AS b{d}" for d in dims)
    ks = ", ".join(f"range(2) k{d}" for d in dims)
    node = " + ".join(f"(b{d} + k{d}.range) * {(1, n.nx, n.nx * n.ny)[d]}" for d in dims)
    phi = " * ".join(f"(1e0 - abs(l{AXES[d]} - ({lo[d]}e0 + (b{d} + k{d}.range) * {s})) / {s}e0)" for d in dims)
    sums = ", ".join(f"sum(CASE WHEN dof = {k} THEN phi * value END) AS d{k}" for k in range(shape.ndim + 1))
    return f"""{out}_c AS (SELECT *, {base} FROM {points}),
{out}_e AS (SELECT {key}, {node} AS node, {phi} AS phi FROM {out}_c, {ks}),
{out} AS MATERIALIZED (SELECT {key}, {sums} FROM {out}_e JOIN {source} AS map USING (node) GROUP BY {key})"""


def source_sql(shape: Shape) -> str:
    cols = [f"greatest(least({a} - d{k}, {e - 1}e0), 0e0) AS s{a}" if k <= shape.ndim else f"CAST({a} AS DOUBLE) AS s{a}" for k, (a, e) in enumerate(zip(AXES, shape.extents, strict=True), 1)]
    return ", ".join(cols)


def coordinates_sql(shape: Shape = R2, s: int = SPACING) -> str:
    return f"p AS (SELECT x, y, z, CAST(x AS DOUBLE) AS lx, CAST(y AS DOUBLE) AS ly, CAST(z AS DOUBLE) AS lz FROM q),\n{corners_sql(shape, s, 'p', 'x, y, z', 'found')},\nsrc AS (SELECT x, y, z, {source_sql(shape)} FROM found)"


def warp_sql(shape: Shape, value: str = "f") -> str:
    dims = range(shape.ndim)
    ks = ", ".join(f"range(2) k{d}" for d in dims)
    at = ", ".join(f"CAST(floor(s{AXES[d]}) AS INT) + {f'k{d}.range' if d in dims else '0'} AS c{AXES[d]}" for d in range(3))
    c = " * ".join(f"(1e0 - abs(s{AXES[d]} - (floor(s{AXES[d]}) + k{d}.range)))" for d in dims)
    return f"""e AS (SELECT x, y, z, {at}, {c} AS c FROM src, {ks})
SELECT e.x, e.y, e.z, round(sum(c * q.{value}) + {NUDGE}, 6) + 0e0 AS v FROM e JOIN q ON q.x = cx AND q.y = cy AND q.z = cz WHERE c > 0 GROUP BY 1, 2, 3"""


@query(f"WITH {raster_sql()}, {formula_sql()}, {coordinates_sql()} SELECT x, y, z, round(sx, 6) + 0e0 AS sx, round(sy, 6) + 0e0 AS sy, sz FROM src")
def map_coordinates(spark, sf_dir):
    at = M.map_coordinates(pair(spark, sf_dir).select(*AXES), formula_map(spark), R2, SPACING)
    return at.select(*AXES, r6("sx").alias("sx"), r6("sy").alias("sy"), "sz")


def _warped(spark, sf_dir, values: DataFrame, shape: Shape) -> DataFrame:
    image = pair(spark, sf_dir, shape).select(*AXES, F.col("f").alias("v"))
    return M.warp(image, values, shape, SPACING).select(*AXES, r6(F.col("v") + NUDGE).alias("v"))


def _map_sql(value: str, shape: Shape) -> str:
    return formula_sql(shape).replace("((a.range * 7 + d.range * 3) % 5 - 2) * 0.7e0", value)


@query(f"WITH {raster_sql()}, {_map_sql('3e0', R2)}, {coordinates_sql()}, {warp_sql(R2)}")
def warp_uniform(spark, sf_dir):
    return _warped(spark, sf_dir, formula_map(spark).withColumn("value", F.when(F.col("dof") == 0, 0.0).otherwise(3.0)), R2)


@query(f"WITH {raster_sql()}, {_map_sql('(a.range % 6) * 0.5e0', R2)}, {coordinates_sql()}, {warp_sql(R2)}")
def warp_shear(spark, sf_dir):
    return _warped(spark, sf_dir, formula_map(spark).withColumn("value", F.when(F.col("dof") == 0, 0.0).otherwise((F.col("node") % 6) * F.lit(0.5))), R2)


@query(f"WITH {raster_sql(R3)}, {formula_sql(R3)}, {coordinates_sql(R3)}, {warp_sql(R3)}")
def warp_3d(spark, sf_dir):
    return _warped(spark, sf_dir, formula_map(spark, R3), R3)


def nodes_sql(shape: Shape, s: int, name: str = "nd") -> str:
    n = nodes_of(shape, s)
    return f"{name} AS (SELECT CAST((c.idx * {n.ny} + b.idx) * {n.nx} + a.idx AS INT) AS point, a.loc AS lx, b.loc AS ly, c.loc AS lz FROM finer_axis a, finer_axis b, finer_axis c WHERE a.dim = 0 AND b.dim = 1 AND c.dim = 2)"


@query(
    f"WITH {formula_sql(R2, 20)}, {axes_sql(R2, SPACING, 'finer_')}, {nodes_sql(R2, SPACING)}, {corners_sql(R2, 20, 'nd', 'point', 'found')} "
    + " UNION ALL ".join(f"SELECT point AS node, {k} AS dof, round(d{k}, 6) + 0e0 AS value FROM found" for k in range(3))
)
def map_refine(spark, sf_dir):
    return M.refine(formula_map(spark, R2, 20), R2, 20, SPACING).select("node", "dof", r6("value").alias("value"))


@query(f"WITH {formula_sql()} SELECT node, dof, round(value + value * value, 6) + 0e0 AS value FROM map")
def map_update(spark, sf_dir):
    a = formula_map(spark)
    return M.update(a, a.withColumn("value", F.col("value") * F.col("value"))).select("node", "dof", r6("value").alias("value"))


@query(f"WITH {formula_sql()} SELECT round(sum(CASE WHEN dof > 0 THEN abs(value) END) / count(*), 6) AS avg_delta, round(max(CASE WHEN dof > 0 THEN abs(value) END), 6) AS max_delta FROM map")
def delta_stats(spark, sf_dir):
    return Q.delta_stats(formula_map(spark)).select(r6("avg_delta").alias("avg_delta"), r6("max_delta").alias("max_delta"))


# Normal equations and their algebra

NODES = nodes_of()


@query(f"WITH {normal_sql(R3)} SELECT dof, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(v + {NUDGE}, 6) + 0e0 AS v FROM mat")
def tmat2(spark, sf_dir):
    matrix, _ = N.normal_equations(I.registration_gradients(scaled(spark, sf_dir, R3), R3), R3, SPACING, compat=True)
    return matrix.select("dof", "r", "c", r6(F.col("v") + NUDGE).alias("v"))


@query(f"WITH {normal_sql(R3)} SELECT dof, CAST(r AS INT) AS r, round(sum(u) + {NUDGE}, 6) + 0e0 AS v FROM mat GROUP BY 1, 2")
def tmatfm(spark, sf_dir):
    _, right = N.normal_equations(I.registration_gradients(scaled(spark, sf_dir, R3), R3), R3, SPACING, compat=True)
    return right.select("dof", "r", r6(F.col("v") + NUDGE).alias("v"))


def _matrix(spark, sf_dir) -> DataFrame:
    return N.normal_equations(I.registration_gradients(scaled(spark, sf_dir), R2), R2, SPACING)[0]


@query(f"WITH {normal_sql()}, f AS (SELECT avg(v) FILTER (WHERE dof > 0) / avg(v) FILTER (WHERE dof = 0) AS k FROM mat WHERE r = c) SELECT dof, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(CASE WHEN dof = 0 THEN v * k ELSE v END + {NUDGE}, 6) + 0e0 AS v FROM mat, f")
def precondition(spark, sf_dir):
    return N.precondition(_matrix(spark, sf_dir)).select("dof", "r", "c", r6(F.col("v") + NUDGE).alias("v"))


@query(f"WITH {normal_sql()} SELECT round(sum(v), 6) AS trace FROM mat WHERE r = c")
def diagonal_sum(spark, sf_dir):
    return N.diagonal_sum(_matrix(spark, sf_dir)).select(r6("trace").alias("trace"))


def lap_sql(compat: bool = False, nodes: Shape = NODES) -> str:
    n, nx = nodes.size, nodes.nx
    inside = "" if compat else f" AND (abs(o) <> 1 OR r // {nx} = (r + o) // {nx})"
    return f"""le AS (SELECT CAST(r AS INT) AS r, CAST(r + o AS INT) AS c, 1e0 AS v FROM (SELECT a.range AS r, unnest([-{nx}, -1, 1, {nx}]) AS o FROM range({n}) a) WHERE r + o BETWEEN 0 AND {n - 1}{inside}),
lap AS (SELECT r, c, v FROM le UNION ALL SELECT r, r, -sum(v) FROM le GROUP BY r),
lap2 AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM lap a JOIN lap b USING (r) GROUP BY 1, 2)"""


@query(f"WITH {lap_sql()} SELECT r, c, v FROM lap")
def laplacian(spark, sf_dir):
    return N.laplacian(spark, NODES)


@query(f"WITH {lap_sql(True)} SELECT r, c, v FROM lap")
def laplacian_wrapped(spark, sf_dir):
    return N.laplacian(spark, NODES, compat=True)


@query(f"WITH {lap_sql()} SELECT r, c, v FROM lap2")
def laplacian2(spark, sf_dir):
    return N.laplacian_squared(spark, NODES)


@query(f"WITH {normal_sql()}, {lap_sql()} SELECT round((SELECT sum(v) FROM mat WHERE r = c) / (3 * (SELECT sum(v) FROM lap2 WHERE r = c)), 6) AS chi")
def lapl_premult(spark, sf_dir):
    smoother = N.laplacian_squared(spark, NODES).filter("r = c").agg((F.sum("v") * 3).alias("t"))
    return N.diagonal_sum(_matrix(spark, sf_dir)).crossJoin(F.broadcast(smoother)).select(r6(F.col("trace") / F.col("t")).alias("chi"))


@query(f"WITH {normal_sql()}, {lap_sql()} SELECT dof, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(sum(v) + {NUDGE}, 6) + 0e0 AS v FROM (SELECT dof, r, c, v FROM mat UNION ALL SELECT d.range, r, c, 0.25e0 * v FROM lap2, range(3) d) GROUP BY 1, 2, 3")
def sparse_axpy(spark, sf_dir):
    lap = N.laplacian_squared(spark, NODES).select(F.explode(F.array(*map(F.lit, range(3)))).alias("dof"), "r", "c", "v")
    return N.add_scaled(_matrix(spark, sf_dir), lap, 0.25).select("dof", "r", "c", r6(F.col("v") + NUDGE).alias("v"))


@query(f"WITH {normal_sql()}, {formula_sql()} SELECT mat.dof, CAST(r AS INT) AS r, round(sum(v * value) + {NUDGE}, 6) + 0e0 AS v FROM mat JOIN map ON map.dof = mat.dof AND map.node = mat.c GROUP BY 1, 2")
def matvec(spark, sf_dir):
    return N.matvec(_matrix(spark, sf_dir), formula_map(spark).select("dof", F.col("node").alias("r"), F.col("value").alias("v"))).select("dof", "r", r6(F.col("v") + NUDGE).alias("v"))


def power_sql(steps: int) -> str:
    parts = ["x0 AS (SELECT DISTINCT dof, r, 1e0 AS v FROM mat)"]
    for k in range(steps):
        parts.append(f"y{k} AS (SELECT mat.dof, mat.r, sum(mat.v * x{k}.v) AS v FROM mat JOIN x{k} ON x{k}.dof = mat.dof AND x{k}.r = mat.c GROUP BY 1, 2)")
        parts.append(f"x{k + 1} AS (SELECT dof, r, v / sqrt(sum(v * v) OVER (PARTITION BY dof)) AS v FROM y{k})")
    parts.append(f"y AS (SELECT mat.dof, mat.r, sum(mat.v * x{steps}.v) AS v FROM mat JOIN x{steps} ON x{steps}.dof = mat.dof AND x{steps}.r = mat.c GROUP BY 1, 2)")
    return ", ".join(parts) + f" SELECT dof, round(sum(x{steps}.v * y.v) / sum(x{steps}.v * x{steps}.v), 6) AS eigenvalue FROM x{steps} JOIN y USING (dof, r) GROUP BY dof"


@query(f"WITH {normal_sql()}, {power_sql(4)}")
def power_iteration(spark, sf_dir):
    return V.power_iteration(V.settle(_matrix(spark, sf_dir)), 4).select("dof", r6("eigenvalue").alias("eigenvalue"))


_Y = [f"0.01e0 * (p_retailprice - {k})" for k in (900, 950, 1100)]


@query(
    f"WITH t AS (SELECT p_partkey, {_Y[0]} * {_Y[0]} AS y1, {_Y[1]} AS y2, {_Y[2]} * {_Y[2]} + 3 AS y3 FROM part), "
    "q AS (SELECT p_partkey, y1 / 3e0 - y2 / 2e0 + y3 / 6e0 AS a, y2 * 2.5e0 - y1 * 2e0 - y3 / 2e0 AS b FROM t) "
    "SELECT p_partkey, round(a + 1.3e-8, 6) + 0e0 AS a, round(b + 1.3e-8, 6) + 0e0 AS b, round(-b / (2e0 * a) + 1.3e-8, 6) + 0e0 AS top FROM q"
)
def quadratic_vertex(spark, sf_dir):
    p = F.col("p_retailprice")
    y = [F.lit(0.01) * (p - k) for k in (900, 950, 1100)]
    a, b, _ = G.parabola(F.lit(1.0), y[0] * y[0], F.lit(2.0), y[1], F.lit(4.0), y[2] * y[2] + 3)
    # Points 1, 2, 4: weights 1/3, -1/2, 1/6.
    return table(spark, sf_dir, "part").select("p_partkey", *(r6(c + NUDGE).alias(n) for c, n in ((a, "a"), (b, "b"), (G.vertex(a, b), "top"))))


# Landmarks


@query(f"WITH {formula_sql()}, p AS (SELECT p_partkey AS lm_id, CAST(p_size - 1 AS DOUBLE) AS lx, CAST(p_partkey % 83 AS DOUBLE) AS ly, 0e0 AS lz FROM part), {corners_sql(R2, SPACING, 'p', 'lm_id', 'found')} SELECT lm_id, round(d1, 6) + 0e0 AS dx, round(d2, 6) + 0e0 AS dy FROM found")
def landmark_map(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lm_id"), (F.col("p_size") - 1).alias("x"), (F.col("p_partkey") % 83).alias("y"), F.lit(0).alias("z"))
    return L.displacement_at(points, formula_map(spark), R2, SPACING).select("lm_id", r6("d1").alias("dx"), r6("d2").alias("dy"))


@query("SELECT p_partkey AS lm_id, CAST(floor(p_size * 16 / 16e0) AS INT) AS x, CAST(floor((p_partkey % 400) / 4e0) AS INT) AS y FROM part")
def landmark_rescale(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lm_id"), (F.col("p_size") * 16).alias("x"), (F.col("p_partkey") % 400).alias("y"))
    return L.rescale(points, (800, 400), (50, 100))


def inverse_sql(rounds: int) -> str:
    """Rounds of R'(x) = -R(x + R'(x)) at the nodes, from 0."""
    parts = ["r0 AS (SELECT point, 0e0 AS d1, 0e0 AS d2 FROM nd)"]
    for k in range(rounds):
        sign = "-" if k else ""
        parts.append(f"p{k} AS (SELECT nd.point, lx + ({sign}r{k}.d1) AS lx, ly + ({sign}r{k}.d2) AS ly, lz FROM nd JOIN r{k} USING (point))")
        parts.append(corners_sql(R2, SPACING, f"p{k}", "point", f"r{k + 1}"))
    ends = " UNION ALL ".join(f"SELECT point AS node, {k} AS dof, {'0e0' if not k else f'round(-d{k}, 6) + 0e0'} AS value FROM r{rounds}" for k in range(3))
    return f"WITH {formula_sql()}, {axes_sql(R2, SPACING, 'finer_')}, {nodes_sql(R2, SPACING)}, {', '.join(parts)} {ends}"


@query(inverse_sql(40))
def inverse_map(spark, sf_dir):
    return L.inverse_map(formula_map(spark), R2, SPACING, tolerance=1e-9).select("node", "dof", r6("value").alias("value"))


# Registration: iterations that SQL can't express


def blobs(spark: SparkSession, shape: Shape, shifts: dict[str, tuple[float, ...]]) -> tuple[DataFrame, DataFrame]:
    """Pairs of smooth blobs that differ by a shift."""

    def blob(pair_id: str, shift: tuple[float, ...]) -> DataFrame:
        square = F.lit(0.0)
        for a, e, s in zip(AXES, shape.extents, (*shift, 0.0), strict=False):
            square = square + F.pow((F.col(a) - (e - 1) / 2 - s) / F.lit(max(1.0, e / 6)), F.lit(2.0))
        return G.grid(spark, shape).select(F.lit(pair_id).alias("pair_id"), *AXES, F.exp(-square).alias("v"))

    union = lambda shifted: reduce(DataFrame.unionByName, [blob(p, s if shifted else (0.0,) * len(s)) for p, s in shifts.items()])
    return union(False), union(True)


def round_sql(k: int, shape: Shape, s: int, lam: float) -> str:
    """One round: from images fixed and reg{k} (x, y, z, v) and map{k} to delta{k} and map{k + 1}. A system is solved by Gauss-Jordan steps on lists."""
    edge = lambda axis: f"0.5e0 * (coalesce(lead(g0) OVER w{axis}, g0) - coalesce(lag(g0) OVER w{axis}, g0))"
    axes = AXES[: shape.ndim]
    windows = ", ".join(f"w{a} AS (PARTITION BY {', '.join(b for b in AXES if b != a)} ORDER BY {a})" for a in axes)
    dofs = " UNION ALL ".join(f"SELECT {d} AS dof, n, pos, phi, d, g{d} AS g FROM k{k}" for d in range(shape.ndim + 1))
    n = nodes_of(shape, s, True).size
    return f"""h{k} AS (SELECT a.x, a.y, a.z, a.v - b.v AS d, 1e0 - 0.5e0 * (a.v + b.v) AS g0 FROM fixed a JOIN reg{k} b USING (x, y, z)),
g{k} AS (SELECT *, {', '.join(f'{edge(a)} AS g{i}' for i, a in enumerate(axes, 1))} FROM h{k} WINDOW {windows}),
{inside_sql(shape, s, True, f'k{k}', f'g{k}')},
kd{k} AS ({dofs}),
mat{k} AS MATERIALIZED (SELECT a.dof, a.n AS r, b.n AS c, sum(a.g * a.phi * b.g * b.phi) AS v FROM kd{k} a JOIN kd{k} b ON a.pos = b.pos AND a.dof = b.dof GROUP BY 1, 2, 3),
pre{k} AS MATERIALIZED (SELECT dof, r, c, CASE WHEN dof = 0 THEN v * (SELECT avg(v) FILTER (WHERE dof > 0) / avg(v) FILTER (WHERE dof = 0) FROM mat{k} WHERE r = c) ELSE v END AS v FROM mat{k}),
sm{k} AS MATERIALIZED (SELECT d.range AS dof, r, c, {lam}e0 * v * (SELECT sum(v) FROM pre{k} WHERE r = c) / ({shape.ndim + 1} * (SELECT sum(v) FROM lap2 WHERE r = c)) AS v FROM lap2, range({shape.ndim + 1}) d),
full{k} AS (SELECT dof, r, c, sum(v) AS v FROM (SELECT * FROM pre{k} UNION ALL SELECT * FROM sm{k}) GROUP BY 1, 2, 3),
side{k} AS (SELECT dof, r, sum(v) AS v FROM (SELECT dof, n AS r, g * d * phi AS v FROM kd{k} UNION ALL SELECT m.dof, r, -m.v * value FROM sm{k} m JOIN map{k} p ON p.dof = m.dof AND p.node = m.c) GROUP BY 1, 2),
dense{k} AS (SELECT b.dof, b.r, list(coalesce(f.v, 0e0) ORDER BY b.c) AS row FROM (SELECT d.range AS dof, a.range AS r, c.range AS c FROM range({shape.ndim + 1}) d, range({n}) a, range({n}) c) b LEFT JOIN full{k} f USING (dof, r, c) GROUP BY 1, 2),
e{k} AS (
  SELECT dof, 0 AS i, list(list_append(row, coalesce(v, 0e0)) ORDER BY r) AS m FROM dense{k} LEFT JOIN side{k} USING (dof, r) GROUP BY dof
  UNION ALL
  SELECT dof, i + 1, list_transform(m, lambda row, j: CASE WHEN j = i + 1 THEN list_transform(row, lambda x: x / row[i + 1]) ELSE list_transform(row, lambda x, c: x - row[i + 1] / m[i + 1][i + 1] * m[i + 1][c]) END) FROM e{k} WHERE i < {n}),
delta{k} AS MATERIALIZED (SELECT CAST(a.range AS INT) AS node, CAST(dof AS INT) AS dof, m[a.range + 1][{n + 1}] AS value FROM e{k}, range({n}) a WHERE i = {n}),
map{k + 1} AS MATERIALIZED (SELECT node, dof, a.value + b.value AS value FROM map{k} a JOIN delta{k} b USING (node, dof))"""


def begin_sql(shape: Shape, s: int) -> str:
    """Images, axes, Laplacian and zero map of a covering map."""
    nodes = nodes_of(shape, s, True)
    return f"""WITH RECURSIVE {scaled_sql(shape)},
fixed AS (SELECT x, y, z, f AS v FROM q), moved AS (SELECT x, y, z, m AS v FROM q), reg0 AS (SELECT * FROM moved),
{axes_sql(shape, s, '', True)},
{lap_sql(False, nodes)},
map0 AS (SELECT CAST(a.range AS INT) AS node, CAST(d.range AS INT) AS dof, 0e0 AS value FROM range({nodes.size}) a, range({shape.ndim + 1}) d)"""


def moved_sql(k: int, shape: Shape, s: int) -> str:
    """reg{k}: the moved image read through map{k}, divided by its largest value."""
    dims = range(shape.ndim)
    at = ", ".join(f"CAST(floor(s{AXES[d]}) AS INT) + {f'k{d}.range' if d in dims else '0'} AS c{AXES[d]}" for d in range(3))
    c = " * ".join(f"(1e0 - abs(s{AXES[d]} - (floor(s{AXES[d]}) + k{d}.range)))" for d in dims)
    return f"""pt{k} AS (SELECT x, y, z, CAST(x AS DOUBLE) AS lx, CAST(y AS DOUBLE) AS ly, CAST(z AS DOUBLE) AS lz FROM fixed),
{corners_sql(shape, s, f'pt{k}', 'x, y, z', f'at{k}', True, f'map{k}')},
src{k} AS (SELECT x, y, z, {source_sql(shape)} FROM at{k}),
ends{k} AS (SELECT x, y, z, {at}, {c} AS c FROM src{k}, {', '.join(f'range(2) k{d}' for d in dims)}),
raw{k} AS MATERIALIZED (SELECT e.x, e.y, e.z, sum(c * moved.v) AS v FROM ends{k} e JOIN moved ON moved.x = cx AND moved.y = cy AND moved.z = cz WHERE c > 0 GROUP BY 1, 2, 3),
reg{k} AS MATERIALIZED (SELECT x, y, z, v / (SELECT max(v) FROM raw{k}) AS v FROM raw{k})"""


@query(f"{begin_sql(R2, SPACING)}, {round_sql(0, R2, SPACING, 10.0)} SELECT 'lineitem' AS pair_id, node, dof, round(value, 6) + 0e0 AS value FROM delta0")
def solve_step(spark, sf_dir):
    fixed, moved = _lineitem(spark, sf_dir, R2)
    values = M.zero_map(spark, R2, SPACING, True).withColumn("pair_id", F.lit("lineitem"))
    return R.step(fixed, moved, values, R2, SPACING, {"lineitem": 10.0}, R.Options())[0].select("pair_id", "node", "dof", r6("value").alias("value"))


@query(ORACLE_SQL["solve_step"])
def solve_step_joined(spark, sf_dir):
    """The same by the conjugate gradients of large maps, joins and sums with multigrid cycles."""
    fixed, moved = _lineitem(spark, sf_dir, R2)
    values = M.zero_map(spark, R2, SPACING, True).withColumn("pair_id", F.lit("lineitem"))
    return R.step(fixed, moved, values, R2, SPACING, {"lineitem": 10.0}, R.Options(block_nodes=30))[0].select("pair_id", "node", "dof", r6("value").alias("value"))


#: A spacing at which the raster has one level.
WIDE = 41


def _level(spark, sf_dir) -> R.Result:
    fixed, moved = _lineitem(spark, sf_dir, R2)
    return R.register(fixed, moved, R2, WIDE, R.Options(lam=4.0, max_iterations=2, least_delta=0.0))


_LEVEL = f"{begin_sql(R2, WIDE)}, {round_sql(0, R2, WIDE, 4.0)}, {moved_sql(1, R2, WIDE)}, {round_sql(1, R2, WIDE, 4.0)}, {moved_sql(2, R2, WIDE)}"


@query(f"{_LEVEL} SELECT 'lineitem' AS pair_id, x, y, z, round(v, 6) + 0e0 AS v FROM reg2")
def register_level(spark, sf_dir):
    """Two rounds of a level, the second with the memory term."""
    return _level(spark, sf_dir).registered.select("pair_id", *AXES, r6("v").alias("v"))


@query(f"{_LEVEL} SELECT 'lineitem' AS pair_id, node, dof, round(CASE WHEN dof > 0 THEN -value ELSE value END, 6) + 0e0 AS value FROM map2")
def register_level_map(spark, sf_dir):
    return _level(spark, sf_dir).displacement().select("pair_id", "node", "dof", r6("value").alias("value"))


def condition_sql(squarings: int = 26) -> str:
    """Ends of each block's spectrum: powers of A and of greatest * I - A by repeated squaring tend to one eigenvector's product with itself."""

    def powers(name: str, start: str) -> str:
        parts = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(squarings):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT f, dof, r, c, v / sum(CASE WHEN r = c THEN v END) OVER (PARTITION BY f, dof) AS v FROM (SELECT a.f, a.dof, a.r, b.c, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.f = b.f AND a.dof = b.dof AND a.c = b.r GROUP BY 1, 2, 3, 4))")
        return ", ".join(parts)

    quotient = lambda name: f"SELECT a.f, a.dof, sum(a.v * b.v) AS e FROM a JOIN {name}{squarings} b ON a.f = b.f AND a.dof = b.dof AND a.c = b.r AND a.r = b.c GROUP BY 1, 2"
    return f"""WITH {normal_sql()}, {lap_sql()},
a AS MATERIALIZED (SELECT f, dof, r, c, sum(v) AS v FROM (SELECT f, dof, r, c, v FROM mat, (VALUES (1e0), (10e0), (20e0)) t(f) UNION ALL SELECT f, d.range, r, c, f * v FROM lap2, range(3) d, (VALUES (1e0), (10e0), (20e0)) t(f)) GROUP BY 1, 2, 3, 4),
{powers("up", "SELECT * FROM a")},
high AS MATERIALIZED ({quotient("up")}),
every AS (SELECT f, dof, i.range AS r, j.range AS c FROM high, range({NODES.size}) i, range({NODES.size}) j),
{powers("down", "SELECT y.f, y.dof, y.r, y.c, CASE WHEN y.r = y.c THEN e ELSE 0e0 END - coalesce(a.v, 0e0) AS v FROM every y JOIN high USING (f, dof) LEFT JOIN a ON a.f = y.f AND a.dof = y.dof AND a.r = y.r AND a.c = y.c")},
low AS ({quotient("down")})
SELECT high.f AS factor, round(ln(max(high.e) / min(low.e)), 4) AS log_condition FROM high JOIN low USING (f, dof) GROUP BY 1"""


@query(condition_sql())
def condition_numbers(spark, sf_dir):
    found = V.condition_numbers(V.settle(_matrix(spark, sf_dir)), V.settle(N.laplacian_squared(spark, NODES)), [1.0, 10.0, 20.0], NODES.size)
    return found.select("factor", F.round(F.log("condition"), 4).alias("log_condition"))


@query(ORACLE_SQL["condition_numbers"])
def condition_numbers_joined(spark, sf_dir):
    """The same by the spectra of large maps, without a task that holds a block."""
    found = V.condition_numbers(V.settle(_matrix(spark, sf_dir)), V.settle(N.laplacian_squared(spark, NODES)), [1.0, 10.0, 20.0], NODES.size, grid=NODES, most=30)
    return found.select("factor", F.round(F.log("condition"), 4).alias("log_condition"))


@query()
def lambda_search(spark, sf_dir):
    matrix = V.settle(_matrix(spark, sf_dir))
    smoother = V.settle(N.laplacian_squared(spark, NODES))
    lam = V.search_smoothing(lambda fs: [r.condition for r in sorted(V.condition_numbers(matrix, smoother, fs, NODES.size).collect(), key=lambda r: fs.index(r.factor))])
    return spark.createDataFrame([(float(lam),)], "lam double")


def _lineitem(spark, sf_dir, shape: Shape) -> tuple[DataFrame, DataFrame]:
    both = scaled(spark, sf_dir, shape)
    return tuple(both.select(F.lit("lineitem").alias("pair_id"), *AXES, F.col(c).alias("v")) for c in "fm")


@query()
def register_2d(spark, sf_dir):
    """The raster of lineitem, all levels to convergence, with the smoothing factor searched for."""
    return R.register(*_lineitem(spark, sf_dir, R2), R2, SPACING).metrics_table(spark)


@query()
def register_3d(spark, sf_dir):
    result = R.register(*_lineitem(spark, sf_dir, R3), R3, 2 * SPACING)
    return result.registered.select("pair_id", *AXES, r6("v").alias("v"))


@query()
def register_pairs(spark, sf_dir):
    """Two pairs of generated blobs side by side, with a factor of their own."""
    shape = Shape(40, 40)
    return R.register(*blobs(spark, shape, {"a": (0.0, 3.0), "b": (2.0, -1.0)}), shape, 10, R.Options(lam=5.0)).metrics_table(spark)


@query(
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS frame_start, CAST(user_id % 24 AS INT) AS x, CAST(hour(ts) AS INT) AS y, round(sum(value), 6) + 0e0 AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3"
)
def event_frame_rasters(spark, sf_dir):
    return event_frames(table(spark, sf_dir, "events")).select("frame_start", "x", "y", r6("v").alias("v"))
