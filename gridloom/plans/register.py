"""Elastic registration of many pairs at once, coarse to fine.

The driver holds the loop and a few numbers a pair; images, maps and matrices stay tables keyed by pair. Pairs that
have converged on a level leave its later rounds. Each round is checkpointed, so its lineage is one round long.

Displacements are those that pixels are read from, with the sign of f(x) = m(x + R(x)); with ``compat`` the stored
sign is the opposite one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, Shape
from ..operators.image import apply_mask, normalise, pair_up, registration_gradients
from ..operators.mapgrid import lattice_tiles, levels, map_shape, refine, small, update, warp, zero_map
from ..operators.metrics import delta_stats, joint_histogram, mutual_information
from ..operators.normal import assemble, cell_sums, diagonal_sum, laplacian_squared, matvec, per_block, precondition
from ..operators.solve import BLOCK_NODES, SEARCH_NODES, condition_numbers, search_in_tasks, search_smoothings, solve
from ..session import checkpoint


@dataclass(frozen=True)
class Options:
    """What a registration may be told.

    lam: smoothing factor, or None to search for it on the first round of each level. lam_mult multiplies it.
    with_memory: smooth the whole map, not only its change. max_iterations: rounds a level.
    compat: border gradients, right side, Laplacian, map extent, memory, probes of the smoothing factor and the trend (over
    the similarity of the unmoved pair and of the registered one in turn) as the older program has them.
    block_nodes: nodes of a map up to which one task solves a block and finds its spectrum; above, joins and sums do.
    """

    lam: float | None = None
    lam_mult: float = 1.0
    with_memory: bool = True
    max_iterations: int = 50
    compat: bool = False
    least_delta: float = 0.1
    trend_over: int = 5
    block_nodes: int | None = None


@dataclass
class Result:
    registered: DataFrame
    values: DataFrame
    spacing: int
    shape: Shape
    metrics: list[dict] = field(default_factory=list)

    def displacement(self, compat: bool = False) -> DataFrame:
        sign = 1.0 if compat else -1.0
        return self.values.withColumn("value", F.when(F.col("dof") > 0, F.col("value") * sign).otherwise(F.col("value")))

    def metrics_table(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(m.values()) for m in self.metrics], "pair_id string, level int, iteration int, spacing int, mi double, avg_delta double, max_delta double, lam double")


PAIR = ("pair_id",)


def mi_of(pair: DataFrame) -> DataFrame:
    return mutual_information(joint_histogram(pair, PAIR), PAIR)


def smoothing_of(spark: SparkSession, shape: Shape, nodes: Shape, options: Options) -> tuple[DataFrame, float]:
    """The squared Laplacian of a map's nodes, checkpointed, and its trace over all dofs."""
    smoother = checkpoint(laplacian_squared(spark, nodes, options.compat))
    return smoother, (smoother.filter("r = c").agg(F.sum("v")).first()[0] or 1.0) * (shape.ndim + 1)


def step(fixed: DataFrame, registered: DataFrame, values: DataFrame, shape: Shape, spacing: int, lam: dict[str, float] | None, options: Options, mask: DataFrame | None = None, smoothing: tuple[DataFrame, float] | None = None, guesses: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Changes of the maps (pair_id, node, dof, value) of one round, and the smoothing factor of each pair.

    ``smoothing``: what ``smoothing_of`` gives, which is the same in all rounds of a level. Where ``lam`` is None and the
    factors are to be searched for, ``guesses`` are where the searches begin; all pairs are searched for side by side.
    """
    spark = fixed.sparkSession
    nodes = map_shape(shape, spacing, not options.compat)
    gradients = registration_gradients(pair_up(fixed, registered, PAIR), shape, PAIR, "zero" if options.compat else "edge")
    if mask is not None and not options.compat:
        gradients = apply_mask(gradients, mask, "d", *(f"g{k}" for k in range(shape.ndim + 1)), by=PAIR)
    # The sums of cells are small beside the image, and both sides come from them.
    matrix, right = assemble(checkpoint(cell_sums(gradients, shape, spacing, PAIR, options.compat, not options.compat)), shape, PAIR)
    matrix = checkpoint(precondition(matrix, PAIR))
    smoother, trace = smoothing or smoothing_of(spark, shape, nodes, options)
    chi = {r["pair_id"]: r["trace"] / trace for r in diagonal_sum(matrix, PAIR).collect()}
    if lam is None and options.lam is not None:
        lam = dict.fromkeys(chi, options.lam)
    elif lam is None and nodes.size <= min(SEARCH_NODES, BLOCK_NODES if options.block_nodes is None else options.block_nodes):
        lam = search_in_tasks(matrix, smoother, chi, guesses or {}, nodes.size, options.compat)
    elif lam is None:

        def conditions(asked: dict[str, list[float]]) -> dict[str, list[float]]:
            # The older program adds each probe to what the one before left in the matrix.
            own = {(p,): [f * chi[p] for f in (accumulate(fs) if options.compat else fs)] for p, fs in asked.items()}
            rows = condition_numbers(matrix.filter(F.col("pair_id").isin(list(asked))), smoother, own, nodes.size, PAIR, options.compat, nodes, options.block_nodes).collect()
            told = {(r["pair_id"], r["factor"]): r["condition"] for r in rows}
            return {p: [told[p, f] for f in own[p,]] for p in asked}

        lam = search_smoothings(conditions, {p: (guesses or {}).get(p) for p in chi})
    weights = spark.createDataFrame([(p, float(lam[p] * options.lam_mult * chi[p])) for p in chi], "pair_id string, weight double")
    blocks = matrix.select("pair_id", "dof").distinct().join(small(weights, len(chi)), "pair_id")
    smooth = per_block(blocks, smoother, nodes.size).select("pair_id", "dof", "r", "c", (F.col("v") * F.col("weight")).alias("v"))
    whole = matrix.unionByName(smooth).groupBy("pair_id", "dof", "r", "c").agg(F.sum("v").alias("v"))
    if options.with_memory and not options.compat:
        pull = matvec(smooth, values.select("pair_id", "dof", F.col("node").alias("r"), F.col("value").alias("v")), PAIR)
        right = right.unionByName(pull.withColumn("v", -F.col("v"))).groupBy("pair_id", "dof", "r").agg(F.sum("v").alias("v"))
    return solve(whole, right, nodes.size, PAIR, nodes, options.block_nodes), lam


def register(fixed: DataFrame, moved: DataFrame, shape: Shape, spacing: int, options: Options = Options(), mask: DataFrame | None = None, start: tuple[DataFrame, int] | None = None, watch: Callable[[int, int, Result], None] | None = None) -> Result:
    """Register images (pair_id, x, y, z, v); mask (x, y, z, v), alike for all pairs or by pair_id; start: (map, its spacing).

    ``watch`` is called with level, iteration and the state so far: as iteration 0 before each level, and after each round.
    """
    spark = fixed.sparkSession
    cover = not options.compat
    fixed = checkpoint(normalise(fixed.select(*PAIR, *AXES, "v"), "v", by=PAIR))
    moved = checkpoint(normalise(moved.select(*PAIR, *AXES, "v"), "v", by=PAIR))
    pairs = fixed.select(*PAIR).distinct()
    schedule = levels(shape, spacing)
    if start is None:
        values, at = pairs.crossJoin(small(zero_map(spark, shape, schedule[0], cover), map_shape(shape, schedule[0], cover).size * (shape.ndim + 1))), schedule[0]
    else:
        values, at = start
        schedule = [s for s in schedule if s <= at] or [spacing]
    values = checkpoint(values.select(*PAIR, "node", "dof", "value"))
    # All rounds read the moved images by tile; they are dealt once.
    tiles = checkpoint(lattice_tiles(moved, shape, ("v",), PAIR))
    registered = checkpoint(normalise(warp(tiles, values, shape, at, PAIR, cover, moved), "v", by=PAIR))
    result = Result(registered, values, at, shape)
    history: dict[str, list[float]] = {}
    guesses: dict[str, float] = {}
    first = {r["pair_id"]: r["mi"] for r in mi_of(pair_up(moved, fixed, PAIR)).collect()} if options.compat else {}
    for level, s in enumerate(schedule):
        if s != at:
            values, at = checkpoint(refine(values, shape, at, s, PAIR, cover)), s
        smoothing = smoothing_of(spark, shape, map_shape(shape, s, cover), options)
        active = {r["pair_id"] for r in pairs.collect()}
        lam: dict[str, float] | None = None
        result.registered, result.values, result.spacing = registered, values, at
        if watch is not None:
            watch(level, 0, result)
        for iteration in range(1, options.max_iterations + 1):
            on = F.col("pair_id").isin(sorted(active))
            delta, lam = step(fixed.filter(on), registered.filter(on), values.filter(on), shape, s, lam, options, mask, smoothing, guesses)
            guesses |= lam
            # The new map and the change that led to it, in one table.
            state = checkpoint(update(values.withColumn("change", F.lit(0.0)), delta.withColumn("change", F.col("value")), PAIR, ("value", "change")))
            values, delta = state.drop("change"), state.filter(on).select(*PAIR, "node", "dof", F.col("change").alias("value"))
            fresh = normalise(warp(tiles.filter(on), values.filter(on), shape, s, PAIR, cover, moved.filter(on)), "v", by=PAIR)
            registered = checkpoint(registered.filter(~on).unionByName(fresh))
            change = {r["pair_id"]: r for r in delta_stats(delta, PAIR).collect()}
            for r in mi_of(pair_up(registered.filter(on), fixed.filter(on), PAIR)).collect():
                pair, own = r["pair_id"], change[r["pair_id"]]
                seen = history.setdefault(pair, [])
                seen.extend([first[pair], r["mi"]] if options.compat else [r["mi"]])
                result.metrics.append({"pair_id": pair, "level": level, "iteration": iteration, "spacing": s, "mi": r["mi"], "avg_delta": own["avg_delta"], "max_delta": own["max_delta"], "lam": lam[pair]})
                if own["avg_delta"] < options.least_delta or (len(seen) >= options.trend_over and slope(seen[-options.trend_over :]) < 0):
                    active.discard(pair)
            result.registered, result.values = registered, values
            if watch is not None:
                watch(level, iteration, result)
            if not active:
                break
    return result


def slope(values: list[float]) -> float:
    """Slope of the least squares line through values at 1, 2, ..."""
    n = len(values)
    middle, mean = (n + 1) / 2, math.fsum(values) / n
    return math.fsum((i - middle) * (v - mean) for i, v in enumerate(values, 1)) / math.fsum((i - middle) ** 2 for i in range(1, n + 1))
