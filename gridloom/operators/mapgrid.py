"""Maps: node axes, levels of spacing, cells, weights of pixels, displacement, warping and refinement.

A map is (by, node, dof, value): dof 0 is intensity, 1.. the displacement along x, y (, z). Axis tables are made on
the driver from extents and spacing; they have some rows per pixel of one axis, never per pixel of the image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridError, Shape, clamp, ravel
from .image import TILE, TILES

#: Rows up to which axis tables and maps are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Edges of a map's tiles, in nodes.
MAP_TILE = {2: 64, 3: 16}


def node_count(extent: int, spacing: int, cover: bool = False) -> int:
    """Nodes on an axis; with ``cover`` so many that no pixel is outside their hull."""
    if extent == 1:
        return 1
    return math.ceil(extent / spacing) + 1 if cover else max(3, math.ceil((extent + 1) / spacing))


def node_locations(extent: int, spacing: int, cover: bool = False) -> list[float]:
    n = node_count(extent, spacing, cover)
    if extent == 1:
        return [0.0]
    low = -((n - 1) * spacing - extent) / 2 - 0.5
    return [low + i * spacing for i in range(n)]


def neighbourhood(location: float, extent: int, spacing: int) -> tuple[int, int]:
    """Pixels [from, to) that a node reaches."""
    if extent == 1:
        return 0, 1
    return max(0, math.ceil(location - spacing)), min(extent, math.floor(location + spacing))


def levels(shape: Shape, spacing: int) -> list[int]:
    """Spacings from coarse to fine, doubled while an extent is over twice the spacing and one."""
    if spacing < 1:
        raise GridError(f"spacing must be at least 1: {spacing}")
    out = [spacing]
    while any(e > 2 * out[-1] + 1 for e in shape.extents):
        out.append(out[-1] * 2)
    return out[::-1]


def map_shape(shape: Shape, spacing: int, cover: bool = False) -> Shape:
    return Shape(*(node_count(e, spacing, cover) for e in shape.extents))


def map_axis(spark: SparkSession, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """(dim, idx, loc, lo_pix, hi_pix)"""
    rows = [(d, i, loc, *neighbourhood(loc, e, spacing)) for d, e in enumerate(shape.extents) for i, loc in enumerate(node_locations(e, spacing, cover))]
    return spark.createDataFrame(rows, "dim int, idx int, loc double, lo_pix int, hi_pix int")


def axis_pixel(spark: SparkSession, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """(dim, idx, p, w): the weight of each node of an axis at each pixel that it reaches."""
    axis = map_axis(spark, shape, spacing, cover).filter("hi_pix > lo_pix")
    pixels = axis.select("dim", "idx", "loc", F.explode(F.sequence("lo_pix", F.col("hi_pix") - 1)).alias("p"))
    flat = F.lit(False)
    for d, e in enumerate(shape.extents):
        if e == 1:
            flat = flat | (F.col("dim") == d)
    return pixels.select("dim", "idx", "p", F.when(flat, 1.0).otherwise(F.lit(1.0) - F.abs(F.col("p") - F.col("loc")) / F.lit(float(spacing))).alias("w"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the number of rows, known beforehand, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_nodes(pixels: DataFrame, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """pixels with ``nodes``: array of (n, phi) of the nodes that reach each pixel. Pixels that none reaches go.

    Three joins to small axis tables and no shuffle of the pixels.
    """
    spark = pixels.sparkSession
    out = pixels
    nodes = map_shape(shape, spacing, cover)
    for d, axis in enumerate(AXES):
        one = axis_pixel(spark, shape, spacing, cover).filter(F.col("dim") == d).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias(f"_{axis}")).withColumnRenamed("p", axis)
        out = out.join(small(one, shape.extents[d]), axis)
    product = F.flatten(F.transform("_z", lambda z: F.flatten(F.transform("_y", lambda y: F.transform("_x", lambda x: F.struct(ravel(x["idx"], y["idx"], z["idx"], nodes).alias("n"), (x["w"] * y["w"] * z["w"]).alias("phi")))))))
    return out.select(*pixels.columns, product.alias("nodes"))


def cell_corner(p: Column, extent: int, spacing: int, cover: bool = False) -> Column:
    """Index of the last node at or before a place on an axis, within [0, n - 2]."""
    locations = node_locations(extent, spacing, cover)
    if len(locations) < 2:
        return F.lit(0)
    return clamp(F.floor((p - F.lit(locations[0])) / F.lit(float(spacing))).cast("int"), F.lit(0), F.lit(len(locations) - 2))


def map_pivot(values: DataFrame, shape: Shape, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, d0, d1, ...) from (by, node, dof, value)."""
    return values.groupBy(*by, "node").agg(*(F.max(F.when(F.col("dof") == k, F.col("value"))).alias(f"d{k}") for k in range(shape.ndim + 1)))


def interpolate_map(points: DataFrame, values: DataFrame, shape: Shape, spacing: int, by: tuple[str, ...] = (), cover: bool = False, key: tuple[str, ...] = AXES, place: tuple[str, ...] = AXES) -> DataFrame:
    """(by, key, d0, d1, ...): the map at points whose places are in the columns ``place``, from the corners of the enclosing cell."""
    nodes = map_shape(shape, spacing, cover)
    wide = map_pivot(values, shape, by)
    if not by and nodes.size <= BROADCAST_ROWS:
        return beside_map(points, wide, shape, spacing, cover, key, place)
    at = [cell_corner(F.col(place[d]), shape.extents[d], spacing, cover) for d in range(shape.ndim)]
    low = [node_locations(shape.extents[d], spacing, cover)[0] for d in range(shape.ndim)]
    upper = [(F.col(place[d]) - (F.lit(low[d]) + at[d] * F.lit(float(spacing)))) / F.lit(float(spacing)) for d in range(shape.ndim)]
    names = tuple(f"d{k}" for k in range(shape.ndim + 1))
    return from_tiles(points.select(*by, *dict.fromkeys((*key, *place))), lattice_tiles(wide, nodes, names, by, MAP_TILE), nodes, at, upper, names, by, key, MAP_TILE, holes=False)


def beside_map(points: DataFrame, wide: DataFrame, shape: Shape, spacing: int, cover: bool, key: tuple[str, ...], place: tuple[str, ...]) -> DataFrame:
    """interpolate_map from one small map: it is one row of arrays beside each point, and nothing is shuffled."""
    nodes = map_shape(shape, spacing, cover)
    corners = []
    for d in range(shape.ndim):
        lo = node_locations(shape.extents[d], spacing, cover)[0]
        base = cell_corner(F.col(place[d]), shape.extents[d], spacing, cover)
        corners.append([F.struct((base + k).alias("i"), (F.lit(1.0) - F.abs(F.col(place[d]) - (F.lit(lo) + (base + k) * F.lit(float(spacing)))) / F.lit(float(spacing))).alias("w")) for k in (0, 1)])
    if shape.ndim == 2:
        corners.append([F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("w"))])
    each = [(ravel(x["i"], y["i"], z["i"], nodes), x["w"] * y["w"] * z["w"]) for z in corners[2] for y in corners[1] for x in corners[0]]
    dofs = range(shape.ndim + 1)
    whole = wide.agg(F.sort_array(F.collect_list(F.struct("node", *(f"d{k}" for k in dofs)))).alias("_m"))
    whole = whole.select(*(F.col("_m")[f"d{k}"].alias(f"_d{k}") for k in dofs))
    beside = points.crossJoin(F.broadcast(whole)).select(*key, *(n.alias(f"_n{i}") for i, (n, _) in enumerate(each)), *(w.alias(f"_w{i}") for i, (_, w) in enumerate(each)), *(f"_d{k}" for k in dofs))
    return beside.select(*key, *(sum((F.col(f"_w{i}") * F.get(f"_d{k}", F.col(f"_n{i}")) for i in range(len(each))), F.lit(0.0)).alias(f"d{k}") for k in dofs))


def map_coordinates(pixels: DataFrame, values: DataFrame, shape: Shape, spacing: int, by: tuple[str, ...] = (), cover: bool = False) -> DataFrame:
    """(by, x, y, z, sx, sy, sz): where each pixel is read from, clamped to the image."""
    moved = interpolate_map(pixels, values, shape, spacing, by, cover)
    source = [clamp(F.col(a) - F.coalesce(f"d{k}", F.lit(0.0)), F.lit(0.0), F.lit(float(e - 1))) if k <= shape.ndim else F.col(a).cast("double") for k, (a, e) in enumerate(zip(AXES, shape.extents, strict=True), 1)]
    return moved.select(*by, *AXES, *(s.alias(f"s{a}") for a, s in zip(AXES, source, strict=True)))


def unravelled(pos: Column, size: Shape) -> list[Column]:
    """x, y, z of a number that ravel gives."""
    return [(pos % size.nx).cast("int"), (F.floor(pos / size.nx) % size.ny).cast("int"), F.floor(pos / (size.nx * size.ny)).cast("int")]


def tile_place(at: list[Column], tile: list[Column], size: Shape, edge: int) -> Column:
    """The position of (x, y, z) among the values of a tile with its rim."""
    x, y, z = (a - t * edge for a, t in zip(at, tile, strict=True))
    wide, high = (F.least(F.lit(edge + 1), F.lit(e) - t * edge) for e, t in zip(size.extents[:2], tile[:2], strict=True))
    return ((z * high + y) * wide + x).cast("int")


def lattice_tiles(points: DataFrame, size: Shape, values: tuple[str, ...], by: tuple[str, ...] = (), edges: dict[int, int] = TILE) -> DataFrame:
    """(by, _tx, _ty, _tz, an array for each of values): a row a tile, from (by, x, y, z or node, values).

    A tile holds the points at its upper faces, edges and corners that are the next tiles' first ones, too: all corners of
    a cell that begins in a tile are in its row. A row has some ten thousand values, whatever the image's size; points
    that are missing are null.
    """
    edge = edges[size.ndim]
    at = unravelled(F.col("node"), size) if "node" in points.columns else [F.col(a) for a in AXES]
    own = [F.when((a % edge == 0) & (a > 0), F.array(F.floor(a / edge).cast("int"), (F.floor(a / edge) - 1).cast("int"))).otherwise(F.array(F.floor(a / edge).cast("int"))) for a in at]
    dealt = points.select(*by, *(a.alias(f"_{c}") for a, c in zip(at, AXES, strict=True)), *values, *(o.alias(f"{t}s") for o, t in zip(own, TILES, strict=True)))
    for t in TILES:
        dealt = dealt.withColumn(t, F.explode(f"{t}s")).drop(f"{t}s")
    tile = [F.col(t) for t in TILES]
    place = tile_place([F.col(f"_{c}") for c in AXES], tile, size, edge)
    rows = dealt.select(*by, *TILES, F.struct(place.alias("_p"), *values).alias("_v")).groupBy(*by, *TILES).agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    full = F.lit(1)
    for t, e in zip(tile, size.extents, strict=True):
        full = full * F.least(F.lit(edge + 1), F.lit(e) - t * edge)
    whole = (F.size("_v") == full) & (F.element_at("_v", -1)["_p"] == full - 1)


    def spread(name: str) -> Column:
        gap = lambda v, i: v["_p"] - F.coalesce(F.get("_v", i - 1)["_p"], F.lit(-1)) - 1
        return F.flatten(F.transform("_v", lambda v, i: F.concat(F.array_repeat(F.lit(None).cast("double"), gap(v, i)), F.array(v[name].cast("double")))))

    return rows.select(*by, *TILES, *(F.when(whole, F.col("_v")[v].cast("array<double>")).otherwise(spread(v)).alias(v) for v in values))


def from_tiles(points: DataFrame, tiles: DataFrame, size: Shape, at: list[Column], upper: list[Column], values: tuple[str, ...], by: tuple[str, ...], keep: tuple[str, ...], edges: dict[int, int] = TILE, holes: bool = True) -> DataFrame:
    """(by, keep, values): multilinear sums over the corners of the cell that begins at ``at``, ``upper`` of a cell before the place.

    Each point is dealt once, to the tile of its cell, and reads the corners from the tile's arrays: no row a corner, and no
    sum to shuffle. A tile that many points read is a skewed key of a plain join, which adaptive execution splits. All
    that hangs on the point alone is found before the join, which keeps the code that reads the arrays short. With ``holes`` points none of whose corners with weight
    is there go.
    """
    edge = edges[size.ndim]
    cell = [*(a.cast("int") for a in at), *[F.lit(0)] * (3 - len(at))]
    here = points.select(*by, *keep, *(a.alias(f"_{c}") for a, c in zip(cell, AXES, strict=True)), *(u.cast("double").alias(f"_u{c}") for u, c in zip(upper, AXES, strict=False)))
    here = here.select("*", *(F.floor(F.col(f"_{c}") / edge).cast("int").alias(t) for t, c in zip(TILES, AXES, strict=True)))
    tile, weights, places = [F.col(t) for t in TILES], [], []
    wide, high = (F.least(F.lit(edge + 1), F.lit(e) - t * edge) for e, t in zip(size.extents[:2], tile[:2], strict=True))
    ends = [(F.lit(1.0) - F.abs(F.col(f"_u{c}") - up)).alias(f"_e{c}{up}") for c in AXES[: len(at)] for up in (0, 1)]
    here = here.select(*by, *keep, *TILES, *ends, tile_place([F.col(f"_{c}") for c in AXES], tile, size, edge).alias("_p"), wide.alias("_py"), (wide * high).alias("_pz"))
    steps = (F.lit(1), F.col("_py"), F.col("_pz"))
    for k in range(1 << len(at)):
        weight, place = F.lit(1.0), F.col("_p")
        for d, c in enumerate(AXES[: len(at)]):
            weight = weight * F.col(f"_e{c}{k >> d & 1}")
            place = place + steps[d] if k >> d & 1 else place
        weights.append(F.nullif(weight, F.lit(0.0)).alias(f"_w{k}"))
        places.append(place.cast("int").alias(f"_p{k}"))
    here = here.select(*by, *keep, *TILES, *weights, *places)
    held = tiles.select(*by, *TILES, *(F.col(v).alias(f"_a{v}") for v in values))
    read = lambda v: [F.col(f"_w{k}") * F.get(f"_a{v}", F.col(f"_p{k}")) for k in range(len(weights))]
    sums = [sum((F.coalesce(r, F.lit(0.0)) for r in read(v)), F.lit(0.0)).alias(v) for v in values]
    joined = here.join(held, [*by, *TILES])
    if not holes:
        return joined.select(*by, *keep, *sums)
    return joined.select(*by, *keep, *sums, F.coalesce(*read(values[0])).isNotNull().alias("_there")).filter("_there").drop("_there")


def interpolate_image(places: DataFrame, image: DataFrame, shape: Shape, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, z, v): linear interpolation of image (by, x, y, z, v), or of its lattice_tiles, at (sx, sy, sz) within the image."""
    tiles = image if TILES[0] in image.columns else lattice_tiles(image, shape, ("v",), by)
    axes = AXES[: shape.ndim]
    at = [F.floor(f"s{a}").cast("int") for a in axes]
    upper = [F.col(f"s{a}") - F.floor(f"s{a}") for a in axes]
    return from_tiles(places, tiles, shape, at, upper, ("v",), by, AXES)


def warp(image: DataFrame, values: DataFrame, shape: Shape, spacing: int, by: tuple[str, ...] = (), cover: bool = False, pixels: DataFrame | None = None) -> DataFrame:
    """Pull an image (by, x, y, z, v) through a map: each pixel takes the value at its place less its displacement.

    ``image`` may be the image's ``lattice_tiles``, made once for many warps; ``pixels`` (by, x, y, z) are then those to find.
    """
    places = map_coordinates(image if pixels is None else pixels, values, shape, spacing, by, cover)
    return interpolate_image(places, image, shape, by)


def map_nodes(spark: SparkSession, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """(node, ix, iy, iz, lx, ly, lz) of all nodes of a map."""
    return node_table(spark.range(map_shape(shape, spacing, cover).size), shape, spacing, cover)


def node_table(ids: DataFrame, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """ids (.., id) with the index and place of each node."""
    nodes = map_shape(shape, spacing, cover)
    out = ids.select(*(c for c in ids.columns if c != "id"), F.col("id").cast("int").alias("node"), *(c.alias(f"i{a}") for a, c in zip(AXES, unravelled(F.col("id"), nodes), strict=True)))
    for a, e in zip(AXES, shape.extents, strict=True):
        lo = node_locations(e, spacing, cover)[0]
        out = out.withColumn(f"l{a}", F.lit(lo) + F.col(f"i{a}") * F.lit(float(spacing) if e > 1 else 0.0))
    return out


#: Nodes of one inner list of every_node.
CHUNK = 1 << 16


def every_node(blocks: DataFrame, nodes: int, name: str) -> DataFrame:
    """blocks with each node 0, 1, ...: lists in two steps, no product of tables."""
    parts = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((nodes - 1) // CHUNK))))
    low = F.col("_part") * CHUNK
    return parts.withColumn(name, F.explode(F.sequence(low, F.least(low + (CHUNK - 1), F.lit(nodes - 1))))).drop("_part")


def zero_map(spark: SparkSession, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    n = map_shape(shape, spacing, cover).size
    return spark.range(n * (shape.ndim + 1)).select((F.col("id") % n).cast("int").alias("node"), F.floor(F.col("id") / n).cast("int").alias("dof"), F.lit(0.0).alias("value"))


def refine(values: DataFrame, shape: Shape, spacing: int, finer: int, by: tuple[str, ...] = (), cover: bool = False) -> DataFrame:
    """The map on nodes of a finer spacing, all dofs."""
    if finer > spacing:
        raise GridError(f"a map can't be made coarser: {spacing} to {finer}")
    n = map_shape(shape, finer, cover).size
    if by:
        points = node_table(every_node(values.select(*by).distinct(), n, "id"), shape, finer, cover)
    else:
        points = map_nodes(values.sparkSession, shape, finer, cover)
    points = points.withColumnsRenamed({"lx": "px", "ly": "py", "lz": "pz", "node": "point"})
    wide = interpolate_map(points, values, shape, spacing, by, cover, key=("point",), place=("px", "py", "pz"))
    dofs = F.array(*(F.struct(F.lit(k).alias("dof"), F.col(f"d{k}").alias("value")) for k in range(shape.ndim + 1)))
    return wide.select(*by, F.col("point").cast("int").alias("node"), F.inline(dofs))


def update(values: DataFrame, delta: DataFrame, by: tuple[str, ...] = (), sums: tuple[str, ...] = ("value",)) -> DataFrame:
    """values + delta, node by node; nodes that delta lacks stay."""
    keys = [*by, "node", "dof"]
    return values.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
