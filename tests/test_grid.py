"""Analytic cases of grids, stencils, maps, warps, matrices and metrics."""

import math
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.functions import grid as G
from gridloom.functions.grid import AXES, GridError, Shape
from gridloom.operators import image as I
from gridloom.operators import landmarks as L
from gridloom.operators import mapgrid as M
from gridloom.operators import metrics as Q
from gridloom.operators import normal as N
from gridloom.operators import solve as V
from gridloom.plans import register as R


def image(spark, shape, v):
    return G.grid(spark, shape).withColumn("v", v.cast("double"))


@pytest.mark.parametrize("axis,scale", [("x", 1.0), ("y", 1.0), ("z", 3.0)])
def test_gradient_of_ramps(spark, axis, scale):
    found = image(spark, Shape(3, 3, 3), F.col(axis) * scale).withColumn("g", I.gradient("v", axis)).filter(f"{axis} = 1").select("g").distinct().collect()
    assert [r.g for r in found] == [scale]


def test_gradient_beyond_borders(spark):
    found = image(spark, Shape(3, 1), F.lit(2.0)).withColumn("zero", I.gradient("v", "x")).withColumn("edge", I.gradient("v", "x", border="edge")).orderBy("x").collect()
    assert [r.zero for r in found] == [1.0, 0.0, -1.0] and {r.edge for r in found} == {0.0}


def test_ravel_and_back(spark):
    shape = Shape(3, 4, 5)
    at = G.grid(spark, shape).select(*AXES, G.ravel(F.col("x"), F.col("y"), F.col("z"), shape).alias("pos"))
    back = at.select(F.struct(*AXES).alias("a"), F.struct(*G.unravel(F.col("pos"), shape)).alias("b"), "pos")
    assert back.filter("a <> b").count() == 0 and sorted(r.pos for r in back.collect()) == list(range(60))


def test_offsets():
    assert G.von_neumann(Shape(5, 7)) == [-5, -1, 0, 1, 5] and len(G.von_neumann(Shape(5, 7, 3))) == 7
    assert G.moore(Shape(5, 7)) == [-6, -5, -4, -1, 0, 1, 4, 5, 6] and len(G.moore(Shape(5, 7, 3), 2)) == 27


@given(st.integers(1, 400), st.integers(1, 60))
def test_node_axes(extent, spacing):
    for cover in (False, True):
        at = M.node_locations(extent, spacing, cover)
        if extent > 1:
            assert math.isclose(at[0] + at[-1], extent - 1) and all(math.isclose(b - a, spacing) for a, b in zip(at, at[1:], strict=False))
            assert not cover or (at[0] <= 0 and at[-1] >= extent - 1)
        for loc in at:
            lo, hi = M.neighbourhood(loc, extent, spacing)
            assert 0 <= lo and hi <= extent


def test_levels():
    assert M.levels(Shape(40, 40), 5) == [20, 10, 5] and M.levels(Shape(3, 3), 5) == [5]
    with pytest.raises(GridError):
        M.levels(Shape(3, 3), 0)
    with pytest.raises(GridError):
        Shape(0, 3)


def test_normalise(spark):
    df = image(spark, Shape(4, 1), F.col("x")).withColumn("k", F.lit("a")).unionByName(image(spark, Shape(2, 1), F.lit(0.0)).withColumn("k", F.lit("b")))
    found = I.normalise(df, "v", by=("k",)).groupBy("k").agg(F.max("v").alias("m")).collect()
    assert {r.k: r.m for r in found} == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("dof", [0, 1, 2, 3])
def test_block_moves_with_its_map(spark, dof):
    shape, spacing = Shape(20, 18, 16), 10
    inside = lambda d: F.col("x").between(*((5, 9) if d != 1 else (8, 12))) & F.col("y").between(*((5, 9) if d != 2 else (8, 12))) & F.col("z").between(*((5, 9) if d != 3 else (8, 12)))
    block = image(spark, shape, F.when(inside(0), 1.0).otherwise(0.0))
    values = M.zero_map(spark, shape, spacing, True).withColumn("value", F.when(F.col("dof") == dof, 3.0).otherwise(0.0))
    found = M.warp(block, values, shape, spacing, cover=True)
    assert found.count() == shape.size
    assert found.filter(F.abs(F.col("v") - F.when(inside(dof), 1.0).otherwise(0.0)) > 1e-10).count() == 0


@pytest.mark.parametrize("shape", [Shape(23, 17), Shape(11, 9, 7)])
def test_tiled_warp_by_brute_force(spark, monkeypatch, shape):
    """Two pairs, one image with holes, moves far over tiles and borders, tiles of four pixels and three nodes, against numpy."""
    monkeypatch.setitem(M.TILE, shape.ndim, 4)
    monkeypatch.setitem(M.MAP_TILE, shape.ndim, 3)
    draw, spacing, axes = np.random.default_rng(3), 3, range(shape.ndim)
    nodes = M.map_shape(shape, spacing)
    starts = [M.node_locations(e, spacing)[0] for e in shape.extents]
    pixels, maps, expected = [], [], {}
    for name, reach in (("a", 2.0), ("b", 30.0)):
        v, d = draw.random(shape.extents), draw.uniform(-reach, reach, (*nodes.extents, shape.ndim + 1))
        there = np.ones(shape.extents, bool) if name == "a" else draw.random(shape.extents) < 0.5
        pixels += [(name, *map(int, at), float(v[at])) for at in np.ndindex(shape.extents) if there[at]]
        maps += [(name, (z * nodes.ny + y) * nodes.nx + x, k, float(d[x, y, z, k])) for x, y, z in np.ndindex(nodes.extents) for k in range(shape.ndim + 1)]
        for at in np.ndindex(shape.extents):
            move = np.zeros(shape.ndim + 1)
            base = [min(max(math.floor((at[i] - starts[i]) / spacing), 0), nodes.extents[i] - 2) for i in axes]
            for up in np.ndindex((2,) * shape.ndim):
                w = math.prod(1 - abs(at[i] - starts[i] - (base[i] + up[i]) * spacing) / spacing for i in axes)
                move += w * d[(*(b + u for b, u in zip(base, up, strict=True)), *((0,) if shape.ndim == 2 else ()))]
            place = [min(max(at[i] - move[i + 1], 0.0), shape.extents[i] - 1.0) for i in axes]
            found = []
            for up in np.ndindex((2,) * shape.ndim):
                c = [math.floor(p) + u for p, u in zip(place, up, strict=True)]
                w = math.prod(1 - abs(p - k) for p, k in zip(place, c, strict=True))
                c = (*c, *((0,) if shape.ndim == 2 else ()))
                if w > 0 and there[c]:
                    found.append(w * v[c])
            if found and there[at]:
                expected[name, *at] = sum(found)
    image = spark.createDataFrame(pixels, "pair_id string, x int, y int, z int, v double")
    values = spark.createDataFrame(maps, "pair_id string, node int, dof int, value double")
    for warped in (M.warp(image, values, shape, spacing, ("pair_id",)), M.warp(M.lattice_tiles(image, shape, ("v",), ("pair_id",)), values, shape, spacing, ("pair_id",), pixels=image.drop("v"))):
        found = {(r.pair_id, r.x, r.y, r.z): r.v for r in warped.collect()}
        assert found.keys() == expected.keys()
        assert max(abs(found[k] - expected[k]) for k in found) < 1e-9


def test_tiled_warp_deals_pixels_twice_and_makes_no_corner_rows(spark):
    shape = Shape(40, 30)
    image_of = image(spark, shape, F.col("x") * 1.0).withColumn("pair_id", F.lit("a"))
    tiles = spark.createDataFrame(M.lattice_tiles(image_of, shape, ("v",), ("pair_id",)).collect(), "pair_id string, _tx int, _ty int, _tz int, v array<double>")
    nodes = M.lattice_tiles(M.map_pivot(M.zero_map(spark, shape, 10).withColumn("pair_id", F.lit("a")), shape, ("pair_id",)), M.map_shape(shape, 10), ("d0", "d1", "d2"), ("pair_id",), M.MAP_TILE)
    assert nodes.count() == 1
    places = spark.createDataFrame(image_of.withColumns({f"s{a}": F.col(a).cast("double") for a in AXES}).drop("v").collect())
    plan = M.interpolate_image(places, tiles, shape, ("pair_id",))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_shear_by_closed_form(spark):
    shape = Shape(30, 12)
    values = M.map_nodes(spark, shape, 10, True).select("node", F.explode(F.array(*map(F.lit, range(3)))).alias("dof"), "lx").withColumn("value", F.when(F.col("dof") == 2, 0.1 * F.col("lx")).otherwise(0.0))
    found = M.map_coordinates(G.grid(spark, shape), values, shape, 10, cover=True)
    expected = G.clamp(F.col("y") - 0.1 * F.col("x"), F.lit(0.0), F.lit(11.0))
    assert found.filter((F.abs(F.col("sy") - expected) > 1e-9) | (F.abs(F.col("sx") - F.col("x")) > 1e-9)).count() == 0


def test_refinement_of_constants(spark):
    shape = Shape(50, 40)
    values = M.zero_map(spark, shape, 20, True).withColumn("value", F.col("dof") * 2.0)
    found = M.refine(values, shape, 20, 10, cover=True).join(M.map_nodes(spark, shape, 10, True), "node").filter("lx between 0 and 49 and ly between 0 and 39")
    assert found.count() > 0 and found.filter(F.abs(F.col("value") - 2.0 * F.col("dof")) > 1e-9).count() == 0
    with pytest.raises(GridError):
        M.refine(values, shape, 10, 20)


def test_weights_sum_to_one_in_the_hull(spark):
    k = N.incidence(G.grid(spark, Shape(23, 17, 5)), Shape(23, 17, 5), 4, True)
    assert k.groupBy(*AXES).agg(F.sum("phi").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9).filter("x between 1 and 21 and y between 1 and 15 and z between 1 and 3").count() == 0


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.r, r.c] += r.v
    return out


@pytest.mark.parametrize("nodes", [Shape(4, 3), Shape(3, 4, 3)])
def test_laplacian(spark, nodes):
    lap = dense(N.laplacian(spark, nodes), nodes.size)
    assert np.allclose(lap.sum(1), 0) and np.allclose(lap, lap.T)
    for i in range(nodes.size):
        p = np.array([i % nodes.nx, i // nodes.nx % nodes.ny, i // (nodes.nx * nodes.ny)])
        for j in range(nodes.size):
            q = np.array([j % nodes.nx, j // nodes.nx % nodes.ny, j // (nodes.nx * nodes.ny)])
            if i != j:
                assert lap[i, j] == (abs(p - q).sum() == 1)
    assert np.allclose(dense(N.laplacian_squared(spark, nodes), nodes.size), lap.T @ lap)


def test_normal_equations_against_dense(spark):
    shape, s = Shape(9, 7), 4
    pair = spark.createDataFrame([(x, y, 0, ((x * 7 + y * 3) % 11) / 11, ((x * 5 + y) % 13) / 13) for x in range(9) for y in range(7)], "x int, y int, z int, f double, m double")
    g = I.registration_gradients(pair, shape)
    n = M.map_shape(shape, s)
    pixels = {(r.x, r.y): r for r in g.collect()}
    axes = [[(M.neighbourhood(c, e, s), c) for c in M.node_locations(e, s)] for e in (9, 7)]
    t = np.zeros((3, 63, n.size))
    d = np.zeros(63)
    for (x, y), r in pixels.items():
        d[y * 9 + x] = r.d
        for j, ((ylo, yhi), cy) in enumerate(axes[1]):
            for i, ((xlo, xhi), cx) in enumerate(axes[0]):
                if xlo <= x < xhi and ylo <= y < yhi:
                    phi = (1 - abs(x - cx) / s) * (1 - abs(y - cy) / s)
                    for k in range(3):
                        t[k, y * 9 + x, j * n.nx + i] = r[f"g{k}"] * phi
    matrix, right = N.normal_equations(g, shape, s)
    for k in range(3):
        assert np.allclose(dense(matrix.filter(F.col("dof") == k), n.size), t[k].T @ t[k])
        assert np.allclose([v for _, v in sorted((r.r, r.v) for r in right.filter(F.col("dof") == k).collect())], t[k].T @ d)


def block_matrix(spark, n=12, blocks=2):
    draw = np.random.default_rng(0)
    out, dense_ = [], []
    for dof in range(blocks):
        a = draw.standard_normal((n, n))
        a = a @ a.T + n * np.eye(n)
        dense_.append(a)
        out += [(dof, i, j, float(a[i, j])) for i in range(n) for j in range(n)]
    b = draw.standard_normal((blocks, n))
    return spark.createDataFrame(out, "dof int, r int, c int, v double"), spark.createDataFrame([(d, i, float(b[d, i])) for d in range(blocks) for i in range(n)], "dof int, r int, v double"), dense_, b


@pytest.mark.parametrize("limit", [200_000, 1])
def test_solvers(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "BLOCK_NODES", limit)
    matrix, right, a, b = block_matrix(spark)
    found = {(r.dof, r.node): r.value for r in V.solve(matrix, right, 12).collect()}
    for dof in range(2):
        assert np.allclose([found[dof, i] for i in range(12)], np.linalg.solve(a[dof], b[dof]), atol=1e-6)


def test_a_dim_block_beside_a_bright_one(spark):
    n = 8
    hard = np.diag(np.geomspace(1, 1e3, n)) + 0.5 * (np.eye(n, k=1) + np.eye(n, k=-1))
    cells = [(0, i, i, 1.0) for i in range(n)] + [(1, int(i), int(j), float(hard[i, j])) for i, j in zip(*np.nonzero(hard), strict=True)]
    matrix = spark.createDataFrame(cells, "dof int, r int, c int, v double")
    right = spark.createDataFrame([(0, i, 1e9) for i in range(n)] + [(1, i, 1.0) for i in range(n)], "dof int, r int, v double")
    found = {(r.dof, r.node): r.value for r in V.solve_distributed(matrix, right).collect()}
    assert np.allclose([found[1, i] for i in range(n)], np.linalg.solve(hard, np.ones(n)), rtol=1e-8)
    with pytest.raises(RuntimeError):
        V.solve_distributed(matrix, right, rounds=2)
    with pytest.raises(RuntimeError):
        V.conjugate_gradient(lambda x: hard @ x, np.ones(n), np.ones(n), rounds=2)


def test_eigenvalues(spark):
    matrix, _, a, _ = block_matrix(spark)
    tops = {r.dof: r.eigenvalue for r in V.power_iteration(V.settle(matrix), 12).collect()}
    assert all(abs(tops[d] - np.linalg.eigvalsh(a[d])[-1]) < 0.5 for d in range(2))
    found = V.condition_numbers(matrix, spark.createDataFrame([(i, i, 1.0) for i in range(12)], "r int, c int, v double"), [0.0, 100.0], 12).collect()
    ends = np.concatenate([np.linalg.eigvalsh(x) for x in a])
    assert {r.factor: round(r.condition, 6) for r in found} == {f: round((ends.max() + f) / (ends.min() + f), 6) for f in (0.0, 100.0)}
    big = np.diag(np.linspace(1, 900, 900))
    one = spark.createDataFrame([(0, i, i, 1.0 + i) for i in range(12)], "dof int, r int, c int, v double")
    unit = spark.createDataFrame([(i, i, 1.0) for i in range(12)], "r int, c int, v double")
    older = {r.factor: r.condition for r in V.condition_numbers(one, unit, [0.0, 3.0], 12, compat=True).collect()}
    assert older == {0.0: pytest.approx(12**2 - 1), 3.0: pytest.approx(15**2 - 1)}
    low, high = V.extreme_eigenvalues(lambda x: big @ x, 900)
    assert abs(high - 900) < 1 and low < 12


def smoothed_map(spark, side, factor):
    """Gradients in the middle third of a side x side map, and the squared Laplacian: (r, c, v) of both, and their sum."""
    smoother = N.laplacian_squared(spark, Shape(side, side)).toPandas()
    n = side * side
    s = np.zeros((n, n))
    np.add.at(s, (smoother["r"].to_numpy(), smoother["c"].to_numpy()), smoother["v"].to_numpy())
    y, x = np.divmod(np.arange(n), side)
    inside = (side // 3 <= x) & (x < 2 * side // 3) & (side // 3 <= y) & (y < 2 * side // 3)
    d = np.where(inside, 1.0, 0.0)
    return d, s * (factor * d.sum() / np.trace(s))


@pytest.mark.parametrize("factor", [1.0, 20.0])
def test_least_eigenvalue_of_a_large_map(spark, factor):
    d, s = smoothed_map(spark, 45, factor)
    whole = np.diag(d) + s
    exact = np.linalg.eigvalsh(whole)
    r, c = np.nonzero(whole)
    w = whole[r, c]
    low, high = V.extreme_eigenvalues(lambda x: np.bincount(r, w * x[c], len(d)), len(d), np.diag(whole))
    assert low == pytest.approx(exact[0], rel=1e-4) and high == pytest.approx(exact[-1], rel=1e-4)


def test_smoothing_search():
    assert abs(V.search_smoothing(lambda fs: [(f - 14) ** 2 + 3 for f in fs]) - 14) < 1e-6
    assert V.search_smoothing(lambda fs: list(fs)) == 1.0
    assert V.search_smoothing(lambda fs: [-((f - 5) ** 2) for f in fs]) == 1.0
    assert V.search_smoothing(lambda fs: [(f - 60) ** 2 for f in fs]) == pytest.approx(60)


def test_mutual_information(spark):
    pair = G.grid(spark, Shape(20, 20)).select(*AXES, (F.col("x") % 5).cast("double").alias("f"), (F.col("x") % 5).cast("double").alias("m"))
    assert Q.mutual_information(Q.joint_histogram(pair)).first().mi == pytest.approx(math.log(5))
    zero = pair.withColumn("f", F.lit(0.0)).withColumn("m", F.lit(0.0))
    assert Q.mutual_information(Q.joint_histogram(zero)).first().mi == pytest.approx(0)
    unit = pair.select(*AXES, (F.col("f") / 4).alias("f"), (F.col("m") / 4).alias("m"))
    r = Q.compare_images(unit).first()
    assert r.mi_bits == pytest.approx(math.log2(5)) and r.proficiency == pytest.approx(1) and r.h1 == pytest.approx(r.h2)
    assert Q.compare_images(zero).first().proficiency == 0


def test_landmarks(spark):
    points = spark.createDataFrame([(1, 99, 50), (2, 10, 7)], "lm_id int, x int, y int")
    assert sorted(map(tuple, L.rescale(points, (200, 100), (100, 50)).collect())) == [(1, 49, 25), (2, 5, 3)]
    shape = Shape(50, 40)
    values = M.zero_map(spark, shape, 10, True).withColumn("value", F.when(F.col("dof") == 1, 4.0).when(F.col("dof") == 2, -2.0).otherwise(0.0))
    found = L.displacement_at(points.filter("lm_id = 2").withColumn("z", F.lit(0)), values, shape, 10, cover=True).first()
    assert (found.d1, found.d2) == (pytest.approx(4), pytest.approx(-2))
    inverse = L.inverse_map(values, shape, 10, cover=True).filter("dof = 1 and node between 20 and 22")
    assert [r.value for r in inverse.collect()] == [pytest.approx(-4)] * 3
    # Not settled in so few rounds, and not without an end where a map folds.
    with pytest.raises(RuntimeError, match="settle"):
        L.inverse_map(values, shape, 10, rounds=1, cover=True)


def test_registration_finds_a_shift(spark):
    shape = Shape(32, 32)

    def blob(pair, dx, dy):
        return G.grid(spark, shape).select(F.lit(pair).alias("pair_id"), *AXES, F.exp(-((F.col("x") - 16 - dx) ** 2 + (F.col("y") - 16 - dy) ** 2) / 40.0).alias("v"))

    fixed = blob("a", 0, 0).unionByName(blob("b", 0, 0))
    moved = blob("a", 3, 0).unionByName(blob("b", 0, -2))
    result = R.register(fixed, moved, shape, 10, R.Options(lam=1.0, max_iterations=12))
    before = {r.pair_id: r.e for r in fixed.join(moved.withColumnRenamed("v", "w"), ["pair_id", *AXES]).groupBy("pair_id").agg(F.sum((F.col("v") - F.col("w")) ** 2).alias("e")).collect()}
    after = {r.pair_id: r.e for r in fixed.join(result.registered.withColumnRenamed("v", "w"), ["pair_id", *AXES]).groupBy("pair_id").agg(F.sum((F.col("v") - F.col("w")) ** 2).alias("e")).collect()}
    assert all(after[p] < 0.2 * before[p] for p in ("a", "b")), (before, after, result.metrics[-4:])
    at = M.interpolate_map(spark.createDataFrame([("a", 16, 16, 0), ("b", 16, 16, 0)], "pair_id string, x int, y int, z int"), result.displacement(), shape, result.spacing, ("pair_id",), True).collect()
    found = {r.pair_id: (r.d1, r.d2) for r in at}
    assert found["a"][0] == pytest.approx(3, abs=1) and found["b"][1] == pytest.approx(-2, abs=1)
    assert result.metrics_table(spark).count() == len(result.metrics)


def test_compat_and_mask_run(spark):
    shape = Shape(24, 24)
    fixed = G.grid(spark, shape).select(F.lit("a").alias("pair_id"), *AXES, F.exp(-((F.col("x") - 12) ** 2 + (F.col("y") - 12) ** 2) / 30.0).alias("v"))
    moved = fixed.withColumn("v", F.exp(-((F.col("x") - 14) ** 2 + (F.col("y") - 12) ** 2) / 30.0))
    older = R.register(fixed, moved, shape, 8, R.Options(compat=True, max_iterations=2))
    assert all(m["lam"] >= 1 for m in older.metrics) and {m["spacing"] for m in older.metrics} == {8, 16}
    mask = G.grid(spark, shape).withColumn("v", F.lit(0.0))
    result = R.register(fixed, moved, shape, 16, R.Options(lam=1.0, max_iterations=1), mask=mask)
    assert result.values.filter("dof > 0 and abs(value) > 1e-9").count() == 0


def test_slope():
    assert R.slope([1, 2, 3, 4, 5]) == 1 and R.slope([1.0, 9, 1, 9, 0.5]) == pytest.approx((0.5 - 1) / 5)


def test_smoothing_of_many_pairs_side_by_side(spark):
    goals, calls = {"a": 14.0, "b": 60.0, "c": -5.0}, []

    def conditions(asked):
        calls.append(sorted(asked))
        return {k: [(f - goals[k]) ** 2 for f in fs] for k, fs in asked.items()}

    found = V.search_smoothings(conditions, dict.fromkeys(goals))
    assert found == {k: V.search_smoothing(lambda fs, g=g: [(f - g) ** 2 for f in fs]) for k, g in goals.items()}
    assert len(calls) <= 5 and calls[0] == ["a", "b", "c"] and all(set(b) <= set(a) for a, b in pairwise(calls))

    shape = Shape(16, 16)
    fixed, moved = catalog.blobs(spark, shape, {"p": (0.0, 2.0), "q": (1.0, 0.0)})
    zero = M.zero_map(spark, shape, 8, True)
    maps = lambda *ids: spark.createDataFrame([(i,) for i in ids], "pair_id string").crossJoin(zero)
    both, lam = R.step(fixed, moved, maps("p", "q"), shape, 8, None, R.Options())
    assert set(lam) == {"p", "q"} and min(lam.values()) >= 1
    for one in ("p", "q"):
        own = F.col("pair_id") == one
        delta, alone = R.step(fixed.filter(own), moved.filter(own), maps(one), shape, 8, None, R.Options())
        assert alone[one] == pytest.approx(lam[one], rel=1e-6)
        side = lambda df: {(r.node, r.dof): r.value for r in df.collect()}
        expected, got = side(both.filter(own)), side(delta)
        assert expected.keys() == got.keys() and all(abs(expected[k] - got[k]) < 1e-6 for k in got)


@pytest.mark.parametrize("shape", [Shape(11, 7), Shape(9, 5, 6)])
@pytest.mark.parametrize("border", ["zero", "edge"])
def test_gradients_by_tiles_in_one_shuffle(spark, shape, border):
    """Tiles of any size give what lines over the whole image give, from one exchange."""
    both = G.grid(spark, shape).select(F.lit("a").alias("pair_id"), *AXES, F.sin(F.col("x") * 3 + F.col("y") * 5 + F.col("z") * 7).alias("f"), F.cos("x").alias("m"))
    pair = both.unionByName(both.withColumn("pair_id", F.lit("b")).withColumn("f", F.col("f") * 2))
    want = I.difference(pair).withColumn("g0", F.lit(1.0) - F.lit(0.5) * (F.col("f") + F.col("m")))
    for k, axis in enumerate(AXES[: shape.ndim], 1):
        want = want.withColumn(f"g{k}", I.gradient("g0", axis, ("pair_id",), border))
    want = sorted(map(tuple, want.collect()))
    for edge in (1, 4, None):
        found = I.registration_gradients(pair, shape, ("pair_id",), border, edge)
        assert sorted(map(tuple, found.collect())) == want
    given = spark.createDataFrame([("a", 0, 0, 0, 0.0, 0.0)], pair.schema)
    plan = I.registration_gradients(given, shape, ("pair_id",), border)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Window ") >= shape.ndim
