"""Images as tables: rasters of any table, extremes, scaling, differences, masks and stencils.

``by`` names the columns that tell images (or pairs) apart; every operator works on many at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridError, Shape, grid


def rasterise(df: DataFrame, x: Column, y: Column, z: Column, shape: Shape, measures: dict[str, Column]) -> DataFrame:
    """Aggregate a table into a dense image; cells without rows are 0, rows outside are left out.

    Aggregation is partial before the shuffle, so at most one row a cell and task moves.
    """
    cells = df.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), "*").groupBy("x", "y", "z").agg(*(m.alias(k) for k, m in measures.items()))
    dense = grid(df.sparkSession, shape).join(cells, [*AXES], "left")
    return dense.select(*AXES, *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in measures))


def minmax(df: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def normalise(df: DataFrame, *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Divide by the largest value of each image; an image whose largest value is 0 stays as it is."""
    top = df.groupBy(*by).agg(*(F.max(v).alias(f"_max_{v}") for v in values))
    joined = df.join(top, [*by]) if by else df.crossJoin(F.broadcast(top))  # one row without by
    return joined.select(*(c if c not in values else (F.col(c) / F.when(F.col(f"_max_{c}") == 0, 1.0).otherwise(F.col(f"_max_{c}"))).alias(c) for c in df.columns))


def same_shape(a: DataFrame, b: DataFrame) -> None:
    size = lambda d: tuple(d.agg(*(F.max(c) for c in AXES)).first())
    if size(a) != size(b):
        raise GridError(f"images differ in shape: {size(a)} and {size(b)}")


def pair_up(fixed: DataFrame, moved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, z, f, m) from two images of one shape."""
    keys = [*by, *AXES]
    return fixed.select(*keys, F.col("v").alias("f")).join(moved.select(*keys, F.col("v").alias("m")), keys)


def difference(pair: DataFrame) -> DataFrame:
    return pair.withColumn("d", F.col("f") - F.col("m"))


def filled_mask(df: DataFrame) -> DataFrame:
    return df.select(*AXES, F.lit(1.0).alias("v"))


def apply_mask(df: DataFrame, mask: DataFrame, *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Zero outside the mask; cells that the mask lacks are outside."""
    keys = [*by, *AXES] if set(by) <= set(mask.columns) else [*AXES]
    inside = df.join(mask.select(*keys, F.col("v").alias("_in")), keys, "left")
    return inside.select(*(c if c not in values else F.when(F.coalesce("_in", F.lit(0.0)) > 0, F.col(c)).otherwise(0.0).alias(c) for c in df.columns))


def gradient(value: str, axis: str, by: tuple[str, ...] = (), border: str = "zero") -> Column:
    """Central difference along an axis. Beyond the border: 0, or with ``border='edge'`` the border's own value."""
    line = Window.partitionBy(*by, *(c for c in AXES if c != axis)).orderBy(axis)
    beyond = F.lit(0.0) if border == "zero" else F.col(value)
    return F.lit(0.5) * (F.coalesce(F.lead(value).over(line), beyond) - F.coalesce(F.lag(value).over(line), beyond))


#: Edges of a tile in two and three dimensions: some ten thousand pixels, beside which the rim is small.
TILE = {2: 128, 3: 32}
TILES = ("_tx", "_ty", "_tz")


def with_rims(pixels: DataFrame, shape: Shape, by: tuple[str, ...] = (), edge: int | None = None) -> DataFrame:
    """pixels (by, x, y, z, ...) with their tile, dealt by (by, tile) in one shuffle.

    A pixel at a face of its tile stands in the tile beyond the face too, so that every pixel's neighbours along the axes
    are in its own tile: stencils along any axis need no other shuffle. ``own_pixels`` leaves each pixel once again.
    """
    edge = edge or TILE[shape.ndim]
    tile = lambda moved=None, o=0: F.struct(*(F.floor((F.col(a) + (o if a == moved else 0)) / edge).cast("int").alias(t) for a, t in zip(AXES, TILES, strict=True)))
    inside = lambda a, e, o: F.when((F.col(a) + o).between(0, e - 1), tile(a, o))
    faces = [inside(a, e, o) for a, e in zip(AXES, shape.extents, strict=True) if e > 1 for o in (-1, 1)]
    tiles = F.array_distinct(F.array_compact(F.array(tile(), *faces)))
    dealt = pixels.select("*", F.explode(tiles).alias("_tile")).select(*pixels.columns, *(F.col("_tile")[t].alias(t) for t in TILES))
    return dealt.repartition(*by, *TILES)


def own_pixels(rimmed: DataFrame, shape: Shape, edge: int | None = None) -> DataFrame:
    edge = edge or TILE[shape.ndim]
    for a, t in zip(AXES, TILES, strict=True):
        rimmed = rimmed.filter(F.floor(F.col(a) / edge) == F.col(t))
    return rimmed.drop(*TILES)


def registration_gradients(pair: DataFrame, shape: Shape, by: tuple[str, ...] = (), border: str = "zero", edge: int | None = None) -> DataFrame:
    """pair with d = f - m, and g0 = 1 - (f + m) / 2 with its gradients g1, g2 (, g3) along the axes, in one shuffle of tiles."""
    out = with_rims(difference(pair).withColumn("g0", F.lit(1.0) - F.lit(0.5) * (F.col("f") + F.col("m"))), shape, by, edge)
    for k, axis in enumerate(AXES[: shape.ndim], 1):
        out = out.withColumn(f"g{k}", gradient("g0", axis, (*by, *TILES), border))
    return own_pixels(out, shape, edge)
