"""Points on images: rescaling, displacement at points, and inverse maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Shape
from ..session import checkpoint
from .mapgrid import interpolate_map, map_nodes


def rescale(points: DataFrame, full: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """x and y of points on an image of another size, cut to whole pixels."""
    sizes = zip(("x", "y"), full, target, strict=True)
    return points.select(*(c for c in points.columns if c not in "xy"), *((F.col(c) / F.lit(f / t)).cast("int").alias(c) for c, f, t in sizes))


def displacement_at(points: DataFrame, values: DataFrame, shape: Shape, spacing: int, key: tuple[str, ...] = ("lm_id",), by: tuple[str, ...] = (), cover: bool = False) -> DataFrame:
    """(by, key, d0, d1, ...): the map at points (key, x, y, z)."""
    return interpolate_map(points, values, shape, spacing, by, cover, key=key)


def inverse_map(values: DataFrame, shape: Shape, spacing: int, rounds: int = 200, cover: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """(node, dof, value): the map that undoes another, by the fixed point R'(x) = -R(x + R'(x)) at the nodes.

    Rounds go on until no value changes by more than the tolerance; a map that folds has no such point and is an error.
    Scattered cubic interpolation is another way; both agree where the map is smooth against its spacing.
    """
    spark = values.sparkSession
    nodes = checkpoint(map_nodes(spark, shape, spacing, cover))
    axes = ("x", "y", "z")[: shape.ndim]
    moves = [f"r{k}" for k in range(1, shape.ndim + 1)]
    state = nodes.select(F.col("node").alias("point"), *(F.lit(0.0).alias(r) for r in moves))
    for _ in range(rounds):
        moved = nodes.join(state, F.col("node") == F.col("point")).select("point", *moves, *((F.col(f"l{a}") + F.col(r)).alias(f"p{a}") for a, r in zip(axes, moves, strict=True)), *([F.lit(0.0).alias("pz")] if shape.ndim == 2 else []))
        at = interpolate_map(moved, values, shape, spacing, cover=cover, key=("point", *moves), place=("px", "py", "pz"))
        state = checkpoint(at.select("point", *((-F.col(f"d{k}")).alias(r) for k, r in enumerate(moves, 1)), F.greatest(*(F.abs(F.col(f"d{k}") + F.col(r)) for k, r in enumerate(moves, 1)), F.lit(0.0)).alias("change")))
        if state.agg(F.max("change")).first()[0] <= tolerance:
            break
        state = state.drop("change")
    else:
        raise RuntimeError(f"the inverse did not settle in {rounds} rounds")
    parts = F.array(*(F.struct(F.lit(k).alias("dof"), (F.col(f"r{k}") if k else F.lit(0.0)).alias("value")) for k in range(shape.ndim + 1)))
    return state.select(F.col("point").cast("int").alias("node"), F.inline(parts))
