"""Geometric multigrid on node grids, as a preconditioner made of joins and sums.

A coarser grid has every other node along each axis. Values go between grids with weights 1 and 1/2, which are expressions
of the node's number, so no table of them is joined; matrices of coarser grids are sums of the finer ones' entries with
those weights. A cycle takes a damped step of the diagonal before and after it adds the coarser grid's answer; the
coarsest grid, of at most ``most`` nodes, is solved in a task for each block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Shape, ravel
from ..session import settle
from .normal import few, products

#: Damping for which steps of the diagonal shrink every error: that of a squared Laplacian is under 3.5 times its diagonal.
DAMPING = 0.5


def coarser(grid: Shape) -> Shape:
    return Shape(*(1 if n == 1 else n // 2 + 1 for n in (grid.nx, grid.ny, grid.nz)))


def parents(node: Column, grid: Shape) -> Column:
    """Array of (i, w): the coarser grid's nodes that a node's value comes from."""
    coarse = coarser(grid)
    index = [node % grid.nx, F.floor(node / grid.nx) % grid.ny, F.floor(node / (grid.nx * grid.ny))]
    axes = []
    for n, i in zip((grid.nx, grid.ny, grid.nz), index, strict=True):
        low = F.floor(i / 2).cast("int")
        here = F.array(F.struct(low.alias("i"), F.lit(1.0).alias("w")))
        both = F.array(*(F.struct((low + k).alias("i"), F.lit(0.5).alias("w")) for k in (0, 1)))
        axes.append(F.array(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("w"))) if n == 1 else F.when(i % 2 == 0, here).otherwise(both))
    x, y, z = axes
    one = lambda a, b, c: F.struct(ravel(a["i"], b["i"], c["i"], coarse).cast("int").alias("i"), (a["w"] * b["w"] * c["w"]).alias("w"))
    return F.flatten(F.transform(z, lambda c: F.flatten(F.transform(y, lambda b: F.transform(x, lambda a: one(a, b, c))))))


def coarse_matrix(matrix: DataFrame, grid: Shape, keys: list[str]) -> DataFrame:
    """(keys, r, c, v) of the coarser grid: the sum of the entries, weighted at both ends."""
    rows = matrix.select(*keys, "c", "v", F.inline(parents(F.col("r"), grid))).select(*keys, "c", F.col("i").alias("r"), (F.col("v") * F.col("w")).alias("v"))
    both = rows.select(*keys, "r", "v", F.inline(parents(F.col("c"), grid))).select(*keys, "r", F.col("i").alias("c"), (F.col("v") * F.col("w")).alias("v"))
    return both.groupBy(*keys, "r", "c").agg(F.sum("v").alias("v"))


def restrict(vector: DataFrame, grid: Shape, keys: list[str]) -> DataFrame:
    """(keys, r, v) on the coarser grid."""
    dealt = vector.select(*keys, "v", F.inline(parents(F.col("r"), grid)))
    return dealt.groupBy(*keys, F.col("i").alias("r")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


@dataclass
class Level:
    """A grid and its matrix; of all grids but the coarsest also ``steps`` (keys, r, c, v), the two damped steps alone, and ``transfer`` (keys, r, c, v) from the coarser grid's nodes c, the step after it included. Entries of ``steps`` are to be summed."""

    grid: Shape
    matrix: DataFrame
    steps: DataFrame | None = None
    transfer: DataFrame | None = None


def diagonal_of(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, d): a node without a positive entry on the diagonal has 1."""
    own = matrix.groupBy(*keys, "r").agg(F.sum(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(0.0)).alias("d"))
    return own.withColumn("d", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0))


def smoothed(matrix: DataFrame, grid: Shape, keys: list[str], rows: int | None) -> tuple[DataFrame, DataFrame]:
    """With damping w and diagonal D: 2 w / D - w^2 / D matrix / D, and (1 - w / D matrix) times the interpolation from the coarser grid."""
    diagonal = settle(diagonal_of(matrix, keys))
    scaled = matrix.join(few(diagonal, rows), [*keys, "r"]).withColumn("v", -DAMPING * F.col("v") / F.col("d")).drop("d")
    across = scaled.join(few(diagonal.withColumnRenamed("r", "c"), rows), [*keys, "c"]).select(*keys, "r", "c", (DAMPING * F.col("v") / F.col("d")).alias("v"))
    steps = across.unionByName(diagonal.select(*keys, "r", F.col("r").alias("c"), (2 * DAMPING / F.col("d")).alias("v")))
    whole = scaled.unionByName(diagonal.select(*keys, "r", F.col("r").alias("c"), F.lit(1.0).alias("v")))
    dealt = whole.select(*keys, "r", "v", F.inline(parents(F.col("c"), grid)))
    transfer = dealt.groupBy(*keys, "r", F.col("i").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return settle(steps), settle(transfer)


def hierarchy(matrix: DataFrame, grid: Shape, keys: list[str], most: int, rows: int | None = None) -> list[Level]:
    """Grids from fine to one of at most ``most`` nodes, at least two. rows: how many a vector has, where they are few."""
    levels = []
    while (not levels or grid.size > max(most, 8)) and coarser(grid) != grid:
        levels.append(Level(grid, matrix, *smoothed(matrix, grid, keys, rows)))
        matrix, grid = settle(coarse_matrix(matrix, grid, keys)), coarser(grid)
    return [*levels, Level(grid, matrix)]


def solve_small(level: Level, right: DataFrame, keys: list[str], solve_block: Callable, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, r, names): the coarsest grid's answers, a task for each block."""
    n = level.grid.size
    sides = right.select(*keys, "r", F.lit(-1).alias("c"), *(F.col(k).alias(f"_{k}") for k in names))
    both = level.matrix.select(*keys, "r", "c", "v").unionByName(sides, allowMissingColumns=True)
    schema = ", ".join([*(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys), "r int", *(f"{k} double" for k in names)])

    def one(block: pd.DataFrame) -> pd.DataFrame:
        side = block["c"].to_numpy() < 0
        r, c, v = (block[k].to_numpy() for k in ("r", "c", "v"))
        out = {**{k: block[k].iloc[0] for k in keys}, "r": np.arange(n, dtype=np.int32)}
        for k in names:
            b = np.bincount(r[side], block[f"_{k}"].to_numpy()[side], n)
            # Nodes that the matrix lacks have no equation.
            b[np.bincount(r[~side], minlength=n) == 0] = 0.0
            out[k] = solve_block(r[~side], c[~side], v[~side], b) if b.any() else np.zeros(n)
        return pd.DataFrame(out)

    return both.groupBy(*keys).applyInPandas(one, schema)


def cycle(levels: list[Level], residual: DataFrame, keys: list[str], solve_block: Callable, rows: int | None = None, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, r, names): one V-cycle from zero for each of the right sides ``residual`` (keys, r, names); symmetric, so conjugate gradients may use it.

    rows: how many a vector has, where they are few: vectors are broadcast then, and the matrices stay where they are.
    """
    top = levels[0]
    if len(levels) == 1:
        return solve_small(top, residual, keys, solve_block, names)
    summed = lambda terms: terms.groupBy(*keys, "r").agg(*(F.sum(k).alias(k) for k in names))
    down = top.transfer.select(*keys, F.col("c").alias("r"), F.col("r").alias("c"), "v")
    below = summed(products(down, residual, keys, rows, names))
    # Each grid reads its right side twice: without a checkpoint the plan would double with every grid.
    answer = cycle(levels[1:], settle(below) if len(levels) > 2 else below, keys, solve_block, rows, names)
    return summed(products(top.steps, residual, keys, rows, names).unionByName(products(top.transfer, answer, keys, rows, names)))
