"""Ends of the spectra of large blocks by locally optimal conjugate gradients, as joins and sums.

A block keeps a few vectors for each end, the changes that led to them, and their products with the matrix. A round
multiplies one more vector for each, its residual (for least eigenvalues after a multigrid cycle), and takes the best
combinations of them all: their weights come from a small eigenproblem of sums, solved where the sums are. Both ends and
all vectors share a round's joins and sums, since the time of a round on few rows is that of its jobs. So memory does not
grow with the rounds, and nothing but whether blocks are unfinished reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .normal import few, products

#: Vectors for each end: one converges by the gap to the second eigenvalue, three by that to the fourth.
VECTORS = 3
NAMES = {kind: tuple(f"{kind}{j}" for j in range(VECTORS)) for kind in ("t", "x", "ax", "p", "ap", "w", "aw")}
BASIS = NAMES["x"] + NAMES["w"] + NAMES["p"]
PAIRS = [(a, b) for i, a in enumerate(BASIS) for b in BASIS[i:]]
ROW, COLUMN = np.triu_indices(len(BASIS))
#: What a node has in a round: the diagonal's size, each vector's quotient, the vectors and their products.
COLUMNS = ["d", *(name for names in NAMES.values() for name in names)]


def best_combinations(gram: np.ndarray, product: np.ndarray, largest: bool, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of weights for each of the ``count`` most extreme Ritz vectors, orthonormal, and their quotients; directions that add nothing are left out, and vectors beyond the span are 0."""
    scale = 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g, h = gram * np.outer(scale, scale), product * np.outer(scale, scale)
    values, vectors = np.linalg.eigh(g)
    span = vectors[:, values > 1e-10] / np.sqrt(values[values > 1e-10])
    quotients, inner = np.linalg.eigh(span.T @ h @ span)
    at = np.argsort(quotients)[:: -1 if largest else 1][:count]
    weights, told = np.zeros((len(gram), count)), np.zeros(count)
    weights[:, : len(at)], told[: len(at)] = scale[:, None] * (span @ inner[:, at]), quotients[at]
    return weights, told


def ends(matrix: DataFrame, by: tuple[str, ...], precondition: Callable[[DataFrame, tuple[str, ...]], DataFrame], tolerance: float = 1e-4, rounds: int = 1_000, rows: int | None = None) -> DataFrame:
    """(by, dof, low, high): the least and the greatest eigenvalue of each symmetric block of matrix (by, dof, r, c, v).

    Rounds go on until the residual of each is below the tolerance times it; the eigenvalue's own error is of the residual's
    square. ``precondition`` takes (by, dof, r, names) to approximate solutions of the block for each of the named columns.
    A residual below 1e-12 of the block's trace is enough where the eigenvalue is 0. rows: how many a vector has, where they
    are few enough to be broadcast.
    """
    keys = [*by, "dof"]
    own, both = [*keys, "largest"], None if rows is None else 2 * rows
    renamed = lambda df, old, new: df.withColumnsRenamed(dict(zip(NAMES[old], NAMES[new], strict=True)))
    kinds = ", ".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}" for k in keys)

    def combine(batches):
        for batch in batches:
            told = []
            for gram, product, largest in zip(batch["gram"], batch["product"], batch["largest"], strict=True):
                g, h = np.zeros((2, len(BASIS), len(BASIS)))
                g[ROW, COLUMN] = g[COLUMN, ROW] = gram
                h[ROW, COLUMN] = h[COLUMN, ROW] = product
                weights, quotients = best_combinations(g, h, largest, VECTORS)
                told.append((weights.ravel(), quotients))
            yield batch[[*own, "open"]].assign(weights=[w for w, _ in told], quotients=[q for _, q in told])

    # Written once as SQL: made anew in each round, these expressions take longer than its jobs.
    added = [F.expr(f"coalesce(sum({c}), 0e0) AS {c}") for c in COLUMNS]
    square = "(ax0 - t0 * x0) * (ax0 - t0 * x0)"
    still = F.expr(f"sqrt(sum({square})) > greatest({tolerance!r}D * max(abs(t0)), 1e-12 * sum(d)) AS open")
    gram = F.expr(f"array({', '.join(f'sum({a} * {b})' for a, b in PAIRS)}) AS gram")
    product = F.expr(f"array({', '.join(f'sum({a} * a{b})' for a, b in PAIRS)}) AS product")
    mixed = lambda names, j, mark: " + ".join(f"weights[{BASIS.index(a) * VECTORS + j}] * {mark}{a}" for a in names)
    mixes = [F.expr(f"{mixed(names, j, mark)} AS {mark}{to}{j}") for mark in ("", "a") for to, names in (("x", BASIS), ("p", BASIS[VECTORS:])) for j in range(VECTORS)]
    quotients = [F.expr(f"quotients[{j}] AS {t}") for j, t in enumerate(NAMES["t"])]
    residuals = [F.expr(f"ax{j} - t{j} * x{j} AS {w}") for j, w in enumerate(NAMES["w"])]

    def improved(parts: DataFrame) -> DataFrame:
        """The next state from rows that are summed by node."""
        wide = settle(parts.groupBy(*own, "r").agg(*added))
        told = wide.groupBy(*own).agg(still, gram, product).mapInPandas(combine, f"{kinds}, largest boolean, open boolean, weights array<double>, quotients array<double>")
        return settle(wide.join(few(told, both), own).select(*own, "r", "open", "d", *quotients, *mixes))

    # Fixed pseudorandom starts: the first of one sign for the smooth least vector, the others of both.
    part = lambda j: F.pmod(F.xxhash64("r", F.lit(j)), F.lit(1 << 20)) / F.lit(float(1 << 20)) + 0.5
    sign = lambda j: F.when((F.lit(j) == 0) & ~F.col("largest"), 1.0).when(F.pmod(F.xxhash64("r", F.lit(VECTORS + j)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    nodes = matrix.groupBy(*keys, "r").agg(F.sum(F.when(F.col("r") == F.col("c"), F.abs("v")).otherwise(0.0)).alias("d"))
    begun = nodes.withColumn("largest", F.explode(F.array(F.lit(False), F.lit(True))))
    begun = settle(begun.select(*own, "r", "d", *((part(j) * sign(j)).alias(x) for j, x in enumerate(NAMES["x"])), *(F.lit(0.0).alias(c) for kind in ("t", "p", "ap", "w", "aw") for c in NAMES[kind])))
    multiplied = lambda x, kind: renamed(products(matrix, x.select(*own, "r", *NAMES[kind]), keys, both, NAMES[kind]), kind, f"a{kind}")
    state = improved(begun.unionByName(multiplied(begun, "x"), allowMissingColumns=True))
    for k in range(rounds + 1):
        # The residuals tested are those before the round that made the state.
        if state.filter("open").isEmpty():
            return state.groupBy(*keys).agg(F.max(F.when(~F.col("largest"), F.col("t0"))).alias("low"), F.max(F.when(F.col("largest"), F.col("t0"))).alias("high"))
        if k == rounds:
            raise RuntimeError(f"{state.filter('open').select(*own).distinct().count()} eigenvalues did not settle in {rounds} rounds")
        rest = state.select(*own, "r", *residuals)
        low = precondition(rest.filter("not largest").drop("largest"), NAMES["w"]).withColumn("largest", F.lit(False))
        w = settle(rest.filter("largest").unionByName(low))
        state = improved(state.drop("open").unionByName(w, allowMissingColumns=True).unionByName(multiplied(w, "w"), allowMissingColumns=True))
    raise AssertionError
