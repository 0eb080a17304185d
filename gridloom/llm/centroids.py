"""Operator 13: centroid clustering by kd-tree filtering.

Vectors are made integers once and laid into kd-trees of at most ``BLOCK`` vectors, one or more for each partition. A node
holds its count, the sums of its components and of its squares, and its box. In a round every tree is walked with all
centroids; at a node those are pruned that are farther than the one nearest to the box's middle from every point of the
box. Where one is left the whole node is its own, by its sums; leaves compute all distances to what is left, and the smaller
number wins a tie. A round's sums are added by Spark: at most one row for each (centroid, component, limb) and task.

All sums, distances and comparisons are of integers: 64-bit ones where components are at most ``SAFE``, else Python's own.
Sums leave a task in limbs of 40 bits, so no total overflows.

Kept are vectors with exactly ``components`` components, none null, NaN or infinite; others, null vectors too, give no row.
Repeated rows are kept as they are. The first centroids are the vectors with the smallest hashes of their ids; of rows that
share an id the first by its components comes first, rows without an id last. With fewer vectors than centroids each is one;
without any the result is empty. A distance or a sum of distances that does not fit a long is null. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

#: Vectors of a tree, and of a leaf whose points differ.
BLOCK, LEAF = 4096, 64
#: Largest component for which distances and the sums of a tree fit 64 bits, for up to 4,096 components.
SAFE = 1 << 18
LIMB = 40
#: Places of a centroid's count and of its summed distances among the rows of components.
COUNT, INERTIA = -1, -2


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact for each finite x."""
    scaled = np.floor(values * scale) if np.abs(values).max(initial=0) < 2.0**900 else None
    if scaled is not None and np.abs(scaled).max(initial=0) <= SAFE:
        return scaled.astype(np.int64)
    # A double of 2**53 or more is an integer itself.
    whole = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


@dataclass
class KdTree:
    """Points in the order of the leaves, and nodes in preorder: the left child of a node is the next one, ``right`` is 0 at a leaf."""

    order: np.ndarray
    points: np.ndarray
    first: list[int]
    last: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    squares: list[int]


def build(points: np.ndarray, leaf: int = LEAF) -> KdTree:
    order = np.arange(len(points))
    first, last, right, low, high, total, squares = [], [], [], [], [], [], []

    def grow(a: int, b: int) -> None:
        node, own = len(first), points[order[a:b]]
        box = own.min(axis=0), own.max(axis=0)
        for column, value in zip((first, last, right, low, high, total, squares), (a, b, 0, *box, own.sum(axis=0), int((own * own).sum())), strict=True):
            column.append(value)
        spread = box[1] - box[0]
        widest = int(spread.argmax())
        if b - a <= leaf or not spread[widest]:
            return
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
        grow(a, a + half)
        right[node] = len(first)
        grow(a + half, b)

    grow(0, len(points))
    return KdTree(order, points[order], first, last, right, np.array(low), np.array(high), np.array(total), squares)


def not_dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of the centroids alive those to which some point of the box is as near as to the one nearest to its middle."""
    some = centroids[alive]
    from_middle = 2 * some - (low + high)
    best = some[(from_middle * from_middle).sum(axis=1).argmin()]
    apart = some - best
    corner = np.where(apart > 0, high, low)
    nearest = (some * some).sum(axis=1) - (best * best).sum() - 2 * (corner * apart).sum(axis=1)
    return alive[nearest <= 0]


def walk(tree: KdTree, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None, np.ndarray | None]]:
    """(node, first, last, labels, distances): a single label for a node assigned whole, without distances; else one for each point of a leaf."""
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, alive = todo.pop()
        alive = not_dominated(tree.low[node], tree.high[node], centroids, alive)
        a, b = tree.first[node], tree.last[node]
        if len(alive) == 1:
            yield node, a, b, alive, None
        elif tree.right[node]:
            todo += [(tree.right[node], alive), (node + 1, alive)]
        else:
            apart = tree.points[a:b, None, :] - centroids[alive][None]
            distances = (apart * apart).sum(axis=2)
            nearest = distances.argmin(axis=1)
            yield node, a, b, alive[nearest], distances[np.arange(b - a), nearest]


def fits(tree: KdTree, centroids: np.ndarray) -> np.ndarray:
    """The centroids in the kind of integers in which the tree's arithmetic is exact."""
    wide = tree.points.dtype == object or np.abs(centroids).max() > SAFE
    return centroids.astype(object if wide else np.int64)


def add_up(tree: KdTree, centroids: np.ndarray, sums: list[dict[int, int]]) -> None:
    """Add the tree's counts, component sums and distances to ``sums``, by centroid."""
    centroids = fits(tree, centroids)
    counts = np.zeros(len(centroids), object)
    inertia = np.zeros(len(centroids), object)
    totals = np.zeros(centroids.shape, object)
    for node, a, b, labels, distances in walk(tree, centroids):
        if distances is None:
            c = labels[0]
            own = centroids[c].astype(object)
            counts[c] += b - a
            totals[c] += tree.total[node]
            inertia[c] += tree.squares[node] - 2 * int((own * tree.total[node]).sum()) + (b - a) * int((own * own).sum())
        else:
            for c in np.unique(labels):
                mine = labels == c
                counts[c] += int(mine.sum())
                totals[c] += tree.points[a:b][mine].sum(axis=0)
                inertia[c] += int(distances[mine].sum())
    for c, own in enumerate(sums):
        if counts[c]:
            for key, value in [(COUNT, counts[c]), (INERTIA, inertia[c]), *enumerate(totals[c])]:
                own[key] = own.get(key, 0) + int(value)


def limbs(value: int) -> list[int]:
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def plant(df: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """(tree): the kd-trees of all vectors, pickled with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def tree() -> pa.RecordBatch:
            grown = build(quantised(np.concatenate(parts), scale))
            raw = pickle.dumps((grown, [ids[i] for i in grown.order.tolist()]), protocol=5)
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["tree"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            values, names = flat.reshape(batch.num_rows, components), batch.column(0).to_pylist()
            at = 0
            while at < len(names):
                take = BLOCK - len(ids)
                ids += names[at : at + take]
                parts.append(values[at : at + take])
                at += take
                if len(ids) == BLOCK:
                    yield tree()
        if ids:
            yield tree()

    return df.select(f"`{key}`", f"`{vector}`").mapInArrow(run, T.StructType([T.StructField("tree", T.BinaryType())]))


def sums_of(trees: DataFrame, centroids: np.ndarray) -> list[dict[int, int]]:
    """Per centroid its count, component sums and summed distances, over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[int, int]] = [{} for _ in centroids]
        for batch in batches:
            for raw in batch.column(0):
                add_up(pickle.loads(raw.as_py())[0], centroids, sums)
        rows = [(c, k, at, x) for c, own in enumerate(sums) for k, v in own.items() for at, x in enumerate(limbs(v))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["c", "k", "at", "x"])

    added = trees.mapInArrow(run, "c bigint, k bigint, at bigint, x bigint").groupBy("c", "k", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: list[dict[int, int]] = [{} for _ in centroids]
    for r in added.collect():
        out[r.c][r.k] = out[r.c].get(r.k, 0) + (int(r.x) << LIMB * r["at"])
    return out


def as_long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


def assigned(trees: DataFrame, centroids: np.ndarray, key: T.StructField) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    schema = T.StructType([T.StructField("id", key.dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                tree, ids = pickle.loads(raw.as_py())
                own = fits(tree, centroids)
                labels, found = np.zeros(len(ids), np.int32), np.zeros(len(ids), object)
                for _, a, b, label, distances in walk(tree, own):
                    if distances is None:
                        apart = tree.points[a:b] - own[label[0]]
                        distances = (apart * apart).sum(axis=1)
                    labels[a:b], found[a:b] = label, distances
                rows = [{"id": i, "cluster": c, "distance": as_long(int(d))} for i, c, d in zip(ids, labels.tolist(), found.tolist(), strict=True)]
                yield from pa.Table.from_pylist(rows, schema=to_arrow(schema)).to_batches()

    return trees.mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def moved(centroids: np.ndarray, sums: list[dict[int, int]]) -> np.ndarray:
    """Exact floors of the means; a centroid without vectors stays."""
    rows = [[own.get(k, 0) // own[COUNT] for k in range(len(c))] if own.get(COUNT) else c.tolist() for c, own in zip(centroids, sums, strict=True)]
    return np.array(rows, object)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    v = F.col("v")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter((F.size(v) == components) & whole)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return kept.select(F.col(f"`{key}`"), *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    centroids = np.array([quantised(np.array(r.v), scale).tolist() for r in first], object)
    trees = checkpoint(plant(kept, key, "v", components, scale))
    for _ in range(rounds):
        centroids = moved(centroids, sums_of(trees, centroids))
    inertia = [own.get(INERTIA, 0) for own in sums_of(trees, centroids)]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)
    found = assigned(trees, centroids, df.schema[key])
    return found.select(
        F.col("id").alias(key), "cluster", "distance", of(map(as_long, inertia), "bigint").alias("cluster_inertia"), F.lit(as_long(sum(inertia))).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256")
    )
