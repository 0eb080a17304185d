"""Registration: blocks that move apart, with and without a mask, and large maps against small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Shape, grid
from gridloom.operators import mapgrid as M
from gridloom.operators import multigrid as MG
from gridloom.operators import normal as N
from gridloom.operators import solve as V
from gridloom.plans import register as R
from gridloom.session import settle


def blocks(spark, shape, left, right):
    """Two blocks side by side, at these y."""
    inside = lambda x, y: F.col("x").between(x, x + 7) & F.col("y").between(y, y + 7) & F.col("z").between(2, 7)
    return grid(spark, shape).withColumn("v", F.when(inside(2, left) | inside(16, right), 1.0).otherwise(0.0))


def test_mask_3d(spark):
    """Both blocks are moved, one up and one down; a mask over the left half registers the left one alone."""
    shape = Shape(26, 20, 10)
    pairs = lambda d: d.withColumn("pair_id", F.explode(F.array(F.lit("half"), F.lit("whole"))))
    fixed, moved = pairs(blocks(spark, shape, 5, 8)), pairs(blocks(spark, shape, 8, 5))
    mask = pairs(grid(spark, shape)).withColumn("v", F.when((F.col("pair_id") == "whole") | (F.col("x") < 13), 1.0).otherwise(0.0))
    result = R.register(fixed, moved, shape, 5, R.Options(lam=2.0, max_iterations=5), mask)
    side = F.when(F.col("x") < 13, "left").otherwise("right").alias("side")
    apart = lambda image: {(r.pair_id, r.side): r.d for r in image.withColumnRenamed("v", "w").join(fixed, ["pair_id", "x", "y", "z"]).groupBy("pair_id", side).agg(F.sum(F.abs(F.col("w") - F.col("v"))).alias("d")).collect()}
    before, after = apart(moved), apart(result.registered)
    share = {key: after[key] / before[key] for key in before}
    assert share["whole", "left"] < 0.4 and share["whole", "right"] < 0.4 and share["half", "left"] < 0.4
    assert share["half", "right"] > 0.9


def dense(matrix, n):
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r.r, r.c] += r.v
    return out


def test_coarser_grids(spark):
    """Values go down with the weights with which they come up, and a coarse matrix is the product of both with the fine one."""
    fine = Shape(5, 4)
    coarse = MG.coarser(fine)
    assert coarse == Shape(3, 3) and MG.coarser(Shape(2, 1)) == Shape(2, 1)
    rows = spark.range(fine.size).select(F.col("id").cast("int").alias("r"), F.inline(MG.parents(F.col("id").cast("int"), fine)))
    p = np.zeros((fine.size, coarse.size))
    for r in rows.collect():
        p[r.r, r.i] = r.w
    assert p.sum(axis=1) == pytest.approx(np.ones(fine.size)) and p[0, 0] == 1 and p[1, 0] == p[1, 1] == 0.5
    matrix = N.laplacian_squared(spark, fine).withColumn("dof", F.lit(0))
    assert dense(MG.coarse_matrix(matrix, fine, ["dof"]), coarse.size) == pytest.approx(p.T @ dense(matrix, fine.size) @ p)
    vector = spark.range(fine.size).select(F.lit(0).alias("dof"), F.col("id").cast("int").alias("r"), F.sin("id").alias("v"))
    down = {r.r: r.v for r in MG.restrict(vector, fine, ["dof"]).collect()}
    assert [down[i] for i in range(coarse.size)] == pytest.approx(list(p.T @ np.sin(np.arange(fine.size))))


def bumpy(spark, grid):
    """A smoother beside a mass that is nearly nothing at most nodes."""
    mass = spark.range(grid.size).select(F.lit(0).alias("dof"), F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"), F.when(F.col("id") % 7 < 2, 1.0).otherwise(0.001).alias("v"))
    return V.settle(mass), V.settle(N.laplacian_squared(spark, grid))


def test_multigrid_solves_large_blocks_in_few_rounds(spark, monkeypatch):
    grid = Shape(11, 11)
    mass, smoother = bumpy(spark, grid)
    matrix = V.settle(N.add_scaled(mass, smoother.withColumn("dof", F.lit(0)), 5.0))
    right = spark.range(grid.size).select(F.lit(0).alias("dof"), F.col("id").cast("int").alias("r"), F.sin("id").alias("v"))
    # At most 30 rounds; without the cycles this does not come near after half of them.
    found = {r.node: r.value for r in V.solve_distributed(matrix, right, rounds=30, grid=grid, most=60).collect()}
    assert [found[i] for i in range(grid.size)] == pytest.approx(list(np.linalg.solve(dense(matrix, grid.size), np.sin(np.arange(grid.size)))), abs=1e-8)
    with pytest.raises(RuntimeError, match="unsolved"):
        V.solve_distributed(matrix, right, rounds=15)


def test_spectra_of_large_maps(spark):
    """Two pairs with factors of their own: by joins and sums as by tasks."""
    grid = Shape(7, 6)
    mass, smoother = bumpy(spark, grid)
    pairs = mass.withColumn("pair_id", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("v", F.when(F.col("pair_id") == "a", F.col("v")).otherwise(F.col("v") * 3))
    factors = {("a",): [1.0, 4.0], ("b",): [2.0]}
    told = lambda **more: {(r.pair_id, r.factor): r.condition for r in V.condition_numbers(pairs, smoother, factors, grid.size, ("pair_id",), **more).collect()}
    one = told()
    assert told(grid=grid, most=20) == pytest.approx(one, rel=1e-4) and len(one) == 3
    with pytest.raises(ValueError, match="grid"):
        told(most=20)


def test_spectra_of_large_maps_take_few_jobs(spark):
    """On few rows a round's time is that of its jobs: both ends share them, and three vectors an end need fewer rounds."""
    grid = Shape(7, 6)
    mass, smoother = bumpy(spark, grid)
    one = V.condition_numbers(mass, smoother, [1.0], grid.size).first().condition
    context = spark.sparkContext
    context.setJobGroup("spectra", "spectra of large maps")
    try:
        found = V.condition_numbers(mass, smoother, [1.0], grid.size, grid=grid, most=20).first().condition
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found == pytest.approx(one, rel=1e-4)
    assert len(context.statusTracker().getJobIdsForGroup("spectra")) < 300


def test_loops_do_not_carry_estimates(spark):
    """The plan's estimate of a settled table is the same however often it was joined before."""
    df = spark.range(5)
    size = lambda d: len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    for _ in range(4):
        df = settle(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert size(df) <= 20 and df.count() == 5


def test_refining_and_smoothing_without_products_of_tables(spark, monkeypatch):
    shape = Shape(12, 10)
    nodes = M.map_shape(shape, 4)
    smoother = N.laplacian_squared(spark, nodes)
    blocks_ = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "pair_id string, dof int")
    values = M.zero_map(spark, shape, 8).withColumn("value", F.col("node") * 1.5 + F.col("dof")).withColumn("pair_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    narrow = sorted(map(tuple, M.refine(values, shape, 8, 4, ("pair_id",)).withColumn("value", F.round("value", 9)).collect()))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(M, "CHUNK", 4)
    wide = M.refine(values, shape, 8, 4, ("pair_id",))
    assert sorted(map(tuple, wide.withColumn("value", F.round("value", 9)).collect())) == narrow
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    rows = lambda: sorted(map(tuple, N.per_block(blocks_, smoother, nodes.size).select("pair_id", "dof", "r", "c", "v").collect()))
    joined = rows()
    monkeypatch.setattr(N, "BROADCAST_ROWS", 200_000)
    assert joined == rows() and len(joined) == 4 * smoother.count()


@pytest.mark.parametrize("compat", [False, True])
def test_search_in_one_job_as_round_by_round(spark, monkeypatch, compat):
    """The factors of two pairs, found in one task each and by jobs over blocks."""
    shape = Shape(12, 10)
    image = lambda dx: grid(spark, shape).withColumn("v", F.exp(-F.pow((F.col("x") - 5 - dx) / 3, 2) - F.pow((F.col("y") - 4) / 3, 2)))
    named = lambda name, df: df.withColumn("pair_id", F.lit(name))
    fixed = named("a", image(0)).unionByName(named("b", image(0)))
    moved = named("a", image(1)).unionByName(named("b", image(-2)))
    values = M.zero_map(spark, shape, 4, not compat).withColumn("pair_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    found = lambda: R.step(fixed, moved, values, shape, 4, None, R.Options(compat=compat))[1]
    one = found()
    monkeypatch.setattr(R, "SEARCH_NODES", 0)
    assert found() == pytest.approx(one, rel=1e-6) and set(one) == {"a", "b"}
