"""Sparse normal equations as coordinate tables (by, dof, r, c, v), and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Shape, von_neumann
from .mapgrid import BROADCAST_ROWS, every_node, small, with_nodes


def incidence(pixels: DataFrame, shape: Shape, spacing: int, cover: bool = False) -> DataFrame:
    """One row per pixel and node that reaches it: pixels' columns, n, phi."""
    found = with_nodes(pixels, shape, spacing, cover)
    return found.select(*pixels.columns, F.inline("nodes"))


def normal_equations(gradients: DataFrame, shape: Shape, spacing: int, by: tuple[str, ...] = (), compat: bool = False, cover: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matrix (by, dof, r, c, v) and right side (by, dof, r, v) from g0.. and d, never making the tall matrix.

    Pixels of one cell are reached by the same nodes, at most 2^d. So products are summed by (cell, dof) first, one column
    for each pair of nodes and half of them by symmetry: no row is made for a pair of nodes and a pixel, and what is
    shuffled is some rows a cell and task. compat: the right side counts each pixel half for every node that reaches it.
    """
    return assemble(cell_sums(gradients, shape, spacing, by, compat, cover), shape, by)


def assemble(sums: DataFrame, shape: Shape, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Matrix and right side from the sums of cells."""
    most = 2**shape.ndim
    ends = [(i, j, f"m{min(i, j)}_{max(i, j)}") for i in range(most) for j in range(most)]
    entries = F.array(*(F.struct(F.col(f"n{i}").alias("r"), F.col(f"n{j}").alias("c"), F.col(m).alias("v")) for i, j, m in ends))
    matrix = sums.select(*by, "dof", F.inline(entries)).filter("r is not null and c is not null").groupBy(*by, "dof", "r", "c").agg(F.sum("v").alias("v"))
    sides = F.array(*(F.struct(F.col(f"n{i}").alias("r"), F.col(f"u{i}").alias("v")) for i in range(most)))
    right = sums.select(*by, "dof", F.inline(sides)).filter("r is not null").groupBy(*by, "dof", "r").agg(F.sum("v").alias("v"))
    return matrix, right


def cell_sums(gradients: DataFrame, shape: Shape, spacing: int, by: tuple[str, ...] = (), compat: bool = False, cover: bool = False) -> DataFrame:
    """(by, dof, first, last, n0.., m0_0.., u0..): per cell its nodes, and sums of g g phi phi and of g d phi. A cell is told by its first and last node."""
    most = 2**shape.ndim
    dofs = F.array(*(F.struct(F.lit(k).alias("dof"), F.col(f"g{k}").alias("g")) for k in range(shape.ndim + 1)))
    weight = F.lit(0.5) * F.size("nodes") if compat else F.lit(1.0)
    phis = [F.get("nodes", F.lit(i)) for i in range(most)]
    each = with_nodes(gradients, shape, spacing, cover).filter(F.size("nodes") > 0).select(*by, (F.col("d") * weight).alias("d"), *(q["n"].alias(f"n{i}") for i, q in enumerate(phis)), *(q["phi"].alias(f"p{i}") for i, q in enumerate(phis)), F.element_at("nodes", -1)["n"].alias("last"), F.inline(dofs))
    g, products = F.col("g"), [(i, j) for i in range(most) for j in range(i, most)]
    return each.groupBy(*by, "dof", F.col("n0").alias("first"), "last").agg(
        *(F.max(f"n{i}").alias(f"n{i}") for i in range(most)),
        *(F.sum(g * F.col(f"p{i}") * g * F.col(f"p{j}")).alias(f"m{i}_{j}") for i, j in products),
        *(F.sum(g * F.col("d") * F.col(f"p{i}")).alias(f"u{i}") for i in range(most)),
    )


def diagonal_sum(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return matrix.filter("r = c").groupBy(*by).agg(F.sum("v").alias("trace"))


def precondition(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of dof 0 times the ratio of the mean diagonals of displacement and intensity; 1 where that is not defined."""
    means = matrix.filter("r = c").groupBy(*by).agg(F.avg(F.when(F.col("dof") > 0, F.col("v"))).alias("_move"), F.avg(F.when(F.col("dof") == 0, F.col("v"))).alias("_level"))
    factor = F.coalesce(F.when(F.col("_level") != 0, F.col("_move") / F.col("_level")), F.lit(1.0))
    joined = matrix.join(means, [*by]) if by else matrix.crossJoin(F.broadcast(means))  # one row without by
    return joined.select(*matrix.columns[:-1], F.when(F.col("dof") == 0, F.col("v") * factor).otherwise(F.col("v")).alias("v"))


def laplacian(spark: SparkSession, nodes: Shape, compat: bool = False) -> DataFrame:
    """(r, c, v): 1 for neighbours along the axes, minus their number on the diagonal. compat: flat offsets wrap round ends of rows."""
    n = nodes.size
    rows = spark.range(n).select(F.col("id").cast("int").alias("r"))
    ends = rows.select("r", F.explode(F.array(*map(F.lit, [o for o in von_neumann(nodes) if o]))).alias("o")).select("r", (F.col("r") + F.col("o")).alias("c"), "o").filter(F.col("c").between(0, n - 1))
    if not compat:
        line, plane = F.floor(F.col("r") / nodes.nx), F.floor(F.col("r") / (nodes.nx * nodes.ny))
        to_line, to_plane = F.floor(F.col("c") / nodes.nx), F.floor(F.col("c") / (nodes.nx * nodes.ny))
        along_x, along_y = F.abs("o") == 1, F.abs("o") == nodes.nx
        ends = ends.filter(F.when(along_x, line == to_line).when(along_y, plane == to_plane).otherwise(True))
    ends = ends.select("r", "c", F.lit(1.0).alias("v"))
    return ends.unionByName(ends.groupBy("r").agg((-F.sum("v")).alias("v")).select("r", F.col("r").alias("c"), "v"))


def laplacian_squared(spark: SparkSession, nodes: Shape, compat: bool = False) -> DataFrame:
    one = laplacian(spark, nodes, compat)
    return one.select("r", F.col("c").alias("i"), F.col("v").alias("a")).join(one.select("r", F.col("c").alias("j"), F.col("v").alias("b")), "r").groupBy(F.col("i").alias("r"), F.col("j").alias("c")).agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def add_scaled(a: DataFrame, b: DataFrame, factor=1.0, keys: tuple[str, ...] = ("dof", "r", "c")) -> DataFrame:
    """a + factor * b, over any patterns."""
    return a.select(*keys, "v").unionByName(b.select(*keys, (F.col("v") * factor).alias("v"))).groupBy(*keys).agg(F.sum("v").alias("v"))


def matvec(a: DataFrame, x: DataFrame, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """(by, dof, r, v) = a x with x (by, dof, r, v); rows: how many x has, where they are known to be few enough to be broadcast."""
    return a.join(few(x.select(*by, "dof", F.col("r").alias("c"), F.col("v").alias("_x")), rows), [*by, "dof", "c"]).groupBy(*by, "dof", "r").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def products(a: DataFrame, x: DataFrame, keys: list[str], rows: int | None = None, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Terms of a times each of the columns ``names`` of x (keys, r, names), to be summed by row; x may have more keys than a, and they stay."""
    own = [k for k in x.columns if k != "r" and k not in names]
    far = x.select(*own, F.col("r").alias("c"), *(F.col(n).alias(f"_{n}") for n in names))
    return a.join(few(far, rows), [*keys, "c"]).select(*own, "r", *((F.col("v") * F.col(f"_{n}")).alias(n) for n in names))


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """Marked for a broadcast where its rows are known and small."""
    return df if rows is None else small(df, rows)


def per_block(blocks: DataFrame, smoother: DataFrame, nodes: int) -> DataFrame:
    """smoother (r, c, v) once for each row of blocks: broadcast where it is small, else by an equal join on the node."""
    if nodes <= BROADCAST_ROWS // 25:  # a node has at most 25 neighbours in the squared Laplacian
        return blocks.crossJoin(F.broadcast(smoother))
    return every_node(blocks, nodes, "r").join(smoother, "r")
