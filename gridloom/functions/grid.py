"""Coordinates: positions, clamps, boxes, basis weights, parabolas and neighbour offsets.

Pixels are rows keyed by (x, y, z); a flat position counts x fastest. Two-dimensional grids have one z.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


class GridError(Exception):
    """Grids that do not fit together, or operations on them that make no sense."""


@dataclass(frozen=True)
class Shape:
    nx: int
    ny: int
    nz: int = 1

    def __post_init__(self):
        if min(self.extents) < 1:
            raise GridError(f"extents must be at least 1: {self.extents}")

    @property
    def extents(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def ndim(self) -> int:
        return 2 if self.nz < 2 else 3

    @property
    def size(self) -> int:
        return self.nx * self.ny * self.nz


def ravel(x, y, z, shape: Shape) -> Column:
    return (z * F.lit(shape.ny) + y) * F.lit(shape.nx) + x


def unravel(pos: Column, shape: Shape) -> list[Column]:
    line = F.floor(pos / F.lit(shape.nx)).cast("int")
    return [(pos % shape.nx).cast("int").alias("x"), (line % shape.ny).cast("int").alias("y"), F.floor(line / F.lit(shape.ny)).cast("int").alias("z")]


def clamp(value, low, high) -> Column:
    return F.greatest(F.least(value, high), low)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """[from, to) common to two ranges of one axis; empty if to <= from."""
    return F.greatest(lo1, lo2), F.least(hi1, hi2)


def basis(ps: list[Column], centres: list[Column], spacing: float = 1.0) -> Column:
    """Product over the axes of 1 - |p - c| / spacing; negative beyond a node's reach."""
    out = F.lit(1.0)
    for p, c in zip(ps, centres, strict=True):
        out = out * (F.lit(1.0) - F.abs(p - c) / F.lit(float(spacing)))
    return out


def parabola(x1, y1, x2, y2, x3, y3) -> tuple[Column, Column, Column]:
    """a, b, c of the parabola through three points."""
    d1, d2, d3 = y1 / ((x1 - x2) * (x1 - x3)), y2 / ((x2 - x1) * (x2 - x3)), y3 / ((x3 - x1) * (x3 - x2))
    return d1 + d2 + d3, -(d1 * (x2 + x3) + d2 * (x1 + x3) + d3 * (x1 + x2)), d1 * x2 * x3 + d2 * x1 * x3 + d3 * x1 * x2


def vertex(a: Column, b: Column) -> Column:
    return -b / (F.lit(2.0) * a)


def von_neumann(shape: Shape, ndof: int = 1) -> list[int]:
    """Flat offsets of a cell and its neighbours along the axes, ascending."""
    steps = [1, shape.nx, shape.nx * shape.ny][: shape.ndim]
    return sorted({0, *(s * sign * ndof for s in steps for sign in (-1, 1))})


def moore(shape: Shape, ndof: int = 1) -> list[int]:
    """Flat offsets of a cell and all that touch it, ascending."""
    steps = [1, shape.nx, shape.nx * shape.ny][: shape.ndim]
    return sorted(ndof * sum(s * k for s, k in zip(steps, signs, strict=True)) for signs in product((-1, 0, 1), repeat=shape.ndim))


def grid(spark: SparkSession, shape: Shape):
    """All coordinates of a shape as ints."""
    return spark.range(shape.size).select(*unravel(F.col("id"), shape))
