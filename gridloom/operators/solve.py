"""Solvers of the block-diagonal normal equations, eigenvalue estimates and the search for the smoothing factor.

One block is one (by, dof): its size is the number of map nodes, not of pixels. Blocks go to tasks of their own up to
``BLOCK_NODES`` nodes; larger maps are solved by conjugate gradients made of joins and sums, checkpointed each round, with
a multigrid cycle as preconditioner where the grid of nodes is given.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Shape
from ..session import settle
from .multigrid import cycle, hierarchy
from .mapgrid import BROADCAST_ROWS
from .normal import few, matvec, per_block
from .spectrum import ends

BLOCK_NODES = 200_000


def conjugate_gradient(multiply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, scale: np.ndarray, tolerance: float = 1e-10, rounds: int | None = None) -> np.ndarray:
    """Solve A x = b for symmetric positive A, preconditioned by its diagonal; an error where it does not converge."""
    x = np.zeros_like(b)
    r = b.copy()
    z = r / scale
    p = z.copy()
    rz = r @ z
    stop = tolerance * max(np.linalg.norm(b), 1e-300)
    rounds = max(10_000, 20 * len(b)) if rounds is None else rounds
    for _ in range(rounds):
        if np.linalg.norm(r) <= stop:
            return x
        ap = multiply(p)
        curve = p @ ap
        if curve <= 0:
            break
        step = rz / curve
        x += step * p
        r -= step * ap
        z = r / scale
        rz, before = r @ z, rz
        p = z + rz / before * p
    if np.linalg.norm(r) <= stop:
        return x
    raise RuntimeError(f"conjugate gradients stopped at a residual of {np.linalg.norm(r):.3g}, not {stop:.3g}: singular matrix, or over {rounds} rounds")


def solve_block(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(b)
    diagonal = np.bincount(rows[rows == cols], values[rows == cols], n)
    scale = np.where(diagonal > 0, diagonal, 1.0)
    return conjugate_gradient(lambda p: np.bincount(rows, values * p[cols], n), b, scale)


def solve(matrix: DataFrame, right: DataFrame, nodes: int, by: tuple[str, ...] = (), grid: Shape | None = None, most: int | None = None) -> DataFrame:
    """(by, node, dof, value) with matrix x = right in each block; grid: the nodes of a map, in their order; most: nodes of a block that a task solves."""
    most = BLOCK_NODES if most is None else most
    if nodes > most:
        return solve_distributed(matrix, right, by, grid=grid, most=most)
    keys = [*by, "dof"]
    both = matrix.select(*keys, "r", "c", "v").unionByName(right.select(*keys, "r", F.lit(-1).alias("c"), "v"))
    schema = ", ".join([*(f"{k} {both.schema[k].dataType.simpleString()}" for k in by), "node int", "dof int", "value double"])

    def one(block: pd.DataFrame) -> pd.DataFrame:
        isb = block["c"].to_numpy() < 0
        r, c, v = (block[k].to_numpy() for k in ("r", "c", "v"))
        x = solve_block(r[~isb], c[~isb], v[~isb], np.bincount(r[isb], v[isb], nodes))
        return pd.DataFrame({**{k: block[k].iloc[0] for k in by}, "node": np.arange(nodes), "dof": int(block["dof"].iloc[0]), "value": x})

    return both.groupBy(*keys).applyInPandas(one, schema)


def solve_distributed(matrix: DataFrame, right: DataFrame, by: tuple[str, ...] = (), tolerance: float = 1e-10, rounds: int = 10_000, grid: Shape | None = None, most: int | None = None) -> DataFrame:
    """Conjugate gradients over all blocks at once; each block has its own steps and stop.

    The preconditioner is a multigrid cycle on the grid of nodes, else the diagonal. Nothing but the number of unsolved
    blocks reaches the driver. Blocks that do not converge are an error.
    """
    keys = [*by, "dof"]
    total = lambda c, d: F.sum(F.col(c) * F.col(d))
    matrix = settle(matrix)
    # Every node of the matrix has a row, whether the right side names it or not.
    sides = right.select(*keys, "r", "v", F.lit(0.0).alias("d")).unionByName(matrix.select(*keys, "r", F.lit(0.0).alias("v"), F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(0.0).alias("d")))
    begun = sides.groupBy(*keys, "r").agg(F.sum("v").alias("res"), F.sum("d").alias("d")).withColumn("d", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0))
    goals = begun.groupBy(*keys).agg((F.lit(tolerance**2) * total("res", "res")).alias("goal"))
    rows = vector_rows(matrix, keys, grid)
    levels = hierarchy(matrix, grid, keys, BLOCK_NODES if most is None else most, rows) if grid is not None else None

    def improved(state: DataFrame) -> DataFrame:
        """state with z, the preconditioned residual."""
        if levels is None:
            return state.withColumn("z", F.col("res") / F.col("d"))
        z = cycle(levels, state.select(*keys, "r", F.col("res").alias("v")), keys, solve_block, rows).withColumnRenamed("v", "z")
        return state.join(few(z, rows), [*keys, "r"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))

    state = improved(settle(begun.join(few(goals, rows), keys).select(*keys, "r", "d", "goal", F.lit(0.0).alias("x"), "res")))
    state = settle(state.withColumn("p", F.col("z")).withColumn("pap", F.lit(1.0)))
    for k in range(rounds + 1):
        unsolved = state.groupBy(*keys).agg(total("res", "res").alias("rr"), F.max("goal").alias("goal"), F.max("pap").alias("pap")).filter("not rr <= goal")
        left, flat = unsolved.agg(F.count("*"), F.count(F.when(~(F.col("pap") > 0), 1))).first()
        if not left:
            break
        if flat or k == rounds:
            raise RuntimeError(f"{left} blocks unsolved after {k} rounds of conjugate gradients, {flat} of them with a singular matrix")
        ap = matvec(matrix, state.select(*keys, "r", F.col("p").alias("v")), by, rows).withColumnRenamed("v", "ap")
        joined = state.drop("pap").join(few(ap, rows), [*keys, "r"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
        sums = joined.groupBy(*keys).agg(total("res", "res").alias("rr"), total("res", "z").alias("rz"), total("p", "ap").alias("pap"))
        # Solved blocks rest.
        step = F.when((F.col("rr") > F.col("goal")) & (F.col("pap") > 0), F.col("rz") / F.col("pap")).otherwise(0.0)
        moved = joined.join(few(sums, rows), keys).select(*keys, "r", "d", "goal", "p", "rz", "pap", (F.col("x") + step * F.col("p")).alias("x"), (F.col("res") - step * F.col("ap")).alias("res"))
        moved = improved(settle(moved) if levels else moved)
        after = moved.groupBy(*keys).agg(total("res", "z").alias("now"))
        turn = F.when(F.col("rz") > 0, F.col("now") / F.col("rz")).otherwise(0.0)
        state = settle(moved.join(few(after, rows), keys).select(*keys, "r", "d", "goal", "x", "res", "z", (F.col("z") + turn * F.col("p")).alias("p"), "pap"))
    return state.select(*by, F.col("r").alias("node"), "dof", F.col("x").alias("value"))


def vector_rows(matrix: DataFrame, keys: list[str], grid: Shape | None) -> int | None:
    """Rows of a vector over all blocks where these are few enough to be broadcast, else None."""
    rows = grid.size * matrix.select(*keys).distinct().count() if grid is not None else None
    return rows if rows is not None and rows <= BROADCAST_ROWS else None


def power_iteration(matrix: DataFrame, steps: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, dof, eigenvalue): Rayleigh quotient after some steps from a vector of ones, by joins and sums."""
    keys = [*by, "dof"]
    x = matrix.select(*keys, "r").distinct().withColumn("v", F.lit(1.0))
    for _ in range(steps):
        y = matvec(matrix, x, by)
        top = y.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
        # Each step reads the one before twice: without a checkpoint the plan would double with every step.
        x = settle(y.join(top, keys).select(*keys, "r", (F.col("v") / F.col("_n")).alias("v")))
    y = matvec(matrix, x, by).withColumnRenamed("v", "_y")
    return x.join(y, [*keys, "r"]).groupBy(*keys).agg((F.sum(F.col("v") * F.col("_y")) / F.sum(F.col("v") * F.col("v"))).alias("eigenvalue"))


def condition_numbers(matrix: DataFrame, smoother: DataFrame, factors: list[float] | dict[tuple, list[float]], nodes: int, by: tuple[str, ...] = (), compat: bool = False, grid: Shape | None = None, most: int | None = None) -> DataFrame:
    """(by, factor, condition) of matrix + factor * smoother over all blocks: largest over smallest eigenvalue.

    matrix (by, dof, r, c, v), smoother (r, c, v); factors are alike for all of ``by``, or listed by its values. One task
    handles one block by Lanczos steps; blocks of over ``most`` nodes, whose ``grid`` must be given, are handled by joins and
    sums, all of them and all factors side by side. ``compat`` gives the older program's number in place of the
    ratio: with t = |largest² - 1|, the larger of t and 1 / t.
    """
    most = BLOCK_NODES if most is None else most
    if nodes > most:
        if grid is None:
            raise ValueError("the grid of a large map's nodes is needed")
        return _conditions(spectrum_ends(matrix, smoother, factors, nodes, by, grid, most), by, compat)
    # One copy of the smoother for each block; both are bounded by the map's nodes.
    lap = per_block(matrix.select(*by, "dof").distinct(), smoother, nodes).select(*by, "dof", "r", "c", F.lit(0.0).alias("v"), F.col("v").alias("s"))
    both = matrix.select(*by, "dof", "r", "c", "v", F.lit(0.0).alias("s")).unionByName(lap).groupBy(*by, "dof", "r", "c").agg(F.sum("v").alias("v"), F.sum("s").alias("s"))
    schema = ", ".join([*(f"{k} {both.schema[k].dataType.simpleString()}" for k in by), "dof int", "factor double", "low double", "high double"])

    def one(block: pd.DataFrame) -> pd.DataFrame:
        r, c, v, s = (block[k].to_numpy() for k in ("r", "c", "v", "s"))
        own = factors[tuple(block[k].iloc[0] for k in by)] if isinstance(factors, dict) else factors
        on = r == c
        out = [(f, *extreme_eigenvalues(lambda x, w=v + f * s: np.bincount(r, w * x[c], nodes), nodes, np.bincount(r[on], (v + f * s)[on], nodes))) for f in own]
        frame = pd.DataFrame(out, columns=["factor", "low", "high"])
        return frame.assign(**{k: block[k].iloc[0] for k in by}, dof=int(block["dof"].iloc[0]))[[*by, "dof", "factor", "low", "high"]]

    return _conditions(both.groupBy(*by, "dof").applyInPandas(one, schema), by, compat)


def spectrum_ends(matrix: DataFrame, smoother: DataFrame, factors: list[float] | dict[tuple, list[float]], nodes: int, by: tuple[str, ...], grid: Shape, most: int) -> DataFrame:
    """(by, dof, factor, low, high) of large blocks."""
    blocks = matrix.select(*by, "dof").distinct()
    if isinstance(factors, dict):
        kinds = ", ".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}" for k in by)
        asked = matrix.sparkSession.createDataFrame([(*key, f) for key, own in factors.items() for f in own], f"{kinds}, factor double")
        blocks, with_factors = blocks.join(asked, [*by]), matrix.join(asked, [*by])
    else:
        every = F.explode(F.array(*(F.lit(float(f)) for f in factors))).alias("factor")
        blocks, with_factors = blocks.select("*", every), matrix.select("*", every)
    keys = [*by, "factor", "dof"]
    smooth = per_block(blocks, smoother, nodes).select(*keys, "r", "c", (F.col("v") * F.col("factor")).alias("v"))
    whole = settle(with_factors.select(*keys, "r", "c", "v").unionByName(smooth).groupBy(*keys, "r", "c").agg(F.sum("v").alias("v")))
    rows = vector_rows(whole, keys, grid)
    levels = hierarchy(whole, grid, keys, most, rows)
    return ends(whole, (*by, "factor"), lambda residuals, names: cycle(levels, residuals, keys, solve_block, rows, names), rows=rows).select(*by, "dof", "factor", "low", "high")


def _conditions(ends: DataFrame, by: tuple[str, ...], compat: bool) -> DataFrame:
    """(by, factor, condition) from the ends of the spectrum of each block (by, dof, factor, low, high)."""
    ratio = F.max("high") / F.greatest(F.min("low"), F.lit(1e-12))
    if compat:
        t = F.greatest(F.abs(F.max("high") * F.max("high") - 1), F.lit(1e-12))
        ratio = F.greatest(t, F.lit(1.0) / t)
    return ends.groupBy(*by, "factor").agg(ratio.alias("condition"))


def lanczos_largest(multiply: Callable[[np.ndarray], np.ndarray], n: int, tolerance: float = 1e-6) -> float:
    """Greatest eigenvalue of a symmetric matrix by Lanczos steps with full orthogonalisation, until its Ritz residual is below the tolerance."""
    q = np.random.default_rng(1).standard_normal(n)
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for k in range(n):
        w = multiply(basis[-1])
        alpha.append(float(w @ basis[-1]))
        for b in basis:
            w = w - (w @ b) * b
        size = float(np.linalg.norm(w))
        if k % 5 == 4 or size < 1e-12 * abs(alpha[0]) or k == n - 1:
            values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
            if size * abs(vectors[-1, -1]) <= tolerance * abs(values[-1]) or k == n - 1:
                break
        beta.append(size)
        basis.append(w / size)
    return float(values[-1])


def extreme_eigenvalues(multiply: Callable[[np.ndarray], np.ndarray], n: int, diagonal: np.ndarray | None = None) -> tuple[float, float]:
    """Least and greatest eigenvalue of a positive semidefinite matrix: exact for small ones, else by Lanczos steps.

    The least one is found on the inverse, whose products are conjugate gradients preconditioned by the diagonal. A shift
    of 1e-12 of the greatest one keeps the inverse of a singular matrix finite.
    """
    if n <= 400:
        eye = np.eye(n)
        values = np.linalg.eigvalsh(np.stack([multiply(e) for e in eye]))
        return float(values[0]), float(values[-1])
    high = lanczos_largest(multiply, n)
    if high <= 0:
        return 0.0, high
    shift = 1e-12 * high
    scale = np.ones(n) if diagonal is None else np.where(diagonal > 0, diagonal, 0.0) + shift
    inverse = lanczos_largest(lambda b: conjugate_gradient(lambda x: multiply(x) + shift * x, b, scale), n)
    return max(0.0, 1 / inverse - shift), high


@dataclass(frozen=True)
class SmoothingSearch:
    """Fixed values of the search: first guess, half width, rounds and least factor."""

    start: float = 10.0
    width: float = 10.0
    rounds: int = 5
    least: float = 1.0


def smoothing_search(guess: float | None = None, search: SmoothingSearch = SmoothingSearch()) -> Generator[list[float], list[float], float]:
    """Factor of least condition number: three points are moved until the middle one is lowest, then the parabola's vertex.

    Gives three factors, takes their condition numbers, and so on; at last it returns the factor found. While the values
    fall, the upper two points are doubled; while they rise, all are halved down to the least factor. A parabola that
    opens downwards, or whose vertex is below the least factor, gives the least factor.
    """
    guess = search.start if guess is None else guess
    low = max(search.least, guess - search.width)
    middle = guess if guess > low else low + search.width / 2
    high = guess + search.width if guess + search.width > middle else middle + search.width
    for last in range(search.rounds):
        at_low, at_middle, at_high = yield [low, middle, high]
        if last == search.rounds - 1 or at_low >= at_middle <= at_high:
            break
        if at_low >= at_middle:
            middle, high = 2 * middle, 2 * high
        elif low <= search.least:
            break
        else:
            low = max(search.least, low / 2)
            middle = middle / 2 if middle / 2 > low else low + 1
            high = high / 2 if high / 2 > middle else middle + 1
    a, b, _ = np.polyfit([low, middle, high], [at_low, at_middle, at_high], 2)
    return search.least if a <= 0 else max(search.least, float(-b / (2 * a)))


def search_smoothings(conditions: Callable[[dict], dict], guesses: dict, search: SmoothingSearch = SmoothingSearch()) -> dict:
    """The searches of many keys side by side: ``conditions`` is called once a round, from {key: factors} to {key: condition numbers}.

    So the number of calls is bounded by the rounds, not by the keys.
    """
    searches = {key: smoothing_search(guess, search) for key, guess in guesses.items()}
    asked, found = {key: next(one) for key, one in searches.items()}, {}
    while asked:
        told, asked = conditions(asked), {}
        for key, values in told.items():
            try:
                asked[key] = searches[key].send(values)
            except StopIteration as end:
                found[key] = end.value
    return found


def search_smoothing(condition: Callable[[list[float]], list[float]], guess: float | None = None, search: SmoothingSearch = SmoothingSearch()) -> float:
    """The search of one key."""
    return search_smoothings(lambda asked: {k: condition(fs) for k, fs in asked.items()}, {0: guess}, search)[0]


#: Nodes up to which the whole search of a key is one task over all its blocks; larger maps take a job a round, a task a block.
SEARCH_NODES = 20_000


def search_in_tasks(matrix: DataFrame, smoother: DataFrame, scales: dict, guesses: dict, nodes: int, compat: bool = False) -> dict:
    """The searches of ``search_smoothings`` for pairs of small maps, in one job: {pair: factor}. A probe's factor is multiplied by the pair's scale."""
    lap = per_block(matrix.select("pair_id", "dof").distinct(), smoother, nodes).select("pair_id", "dof", "r", "c", F.lit(0.0).alias("v"), F.col("v").alias("s"))
    both = matrix.select("pair_id", "dof", "r", "c", "v", F.lit(0.0).alias("s")).unionByName(lap).groupBy("pair_id", "dof", "r", "c").agg(F.sum("v").alias("v"), F.sum("s").alias("s"))

    def one(pair: pd.DataFrame) -> pd.DataFrame:
        name = pair["pair_id"].iloc[0]
        blocks = [tuple(b[k].to_numpy() for k in ("r", "c", "v", "s")) for _, b in pair.groupby("dof")]

        def condition(factor: float) -> float:
            ends = []
            for r, c, v, s in blocks:
                w, on = v + factor * scales[name] * s, r == c
                ends.append(extreme_eigenvalues(lambda x, w=w, r=r, c=c: np.bincount(r, w * x[c], nodes), nodes, np.bincount(r[on], w[on], nodes)))
            low, high = min(e[0] for e in ends), max(e[1] for e in ends)
            if not compat:
                return high / max(low, 1e-12)
            t = max(abs(high * high - 1), 1e-12)
            return max(t, 1 / t)

        factor = search_smoothing(lambda fs: [condition(f) for f in (accumulate(fs) if compat else fs)], guesses.get(name))
        return pd.DataFrame({"pair_id": [name], "lam": [factor]})

    return {r.pair_id: r.lam for r in both.groupBy("pair_id").applyInPandas(one, "pair_id string, lam double").collect()}
