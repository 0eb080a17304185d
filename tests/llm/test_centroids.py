"""Kd-tree filtering against plain rounds over all vectors, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridloom.llm import centroids as C


def plainly(rows, k, rounds, n, scale=64, seed="1"):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2.0**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centers, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, j, d in found if j == c) for c in range(len(centers))]
    fit = lambda x: x if x < 2**63 else None
    return sorted([(i, j, fit(d), fit(sums[j]), fit(sum(sums)), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found], key=repr)


def found(spark, rows, k=4, rounds=3, n=3, kind="float"):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, id string, cluster int").repartition(3)
    return sorted(map(tuple, C.cluster(df, k, rounds, n).collect()), key=repr)


def vectors(seed, count, n, near=0.1):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(n)] for _ in range(5)]
    return [(i, [float(np.float32(m + draw.gauss(0, near))) for m in draw.choice(middles)]) for i in range(count)]


@pytest.mark.parametrize("n", [2, 64])
def test_random_vectors(spark, monkeypatch, n):
    monkeypatch.setattr(C, "BLOCK", 100)
    rows = vectors(n, 700, n)
    assert found(spark, rows, 6, 3, n) == plainly(rows, 6, 3, n)


def test_ties_and_copies(spark):
    """Many vectors half way between centroids, whole blocks of one vector, centroids that are equal or lose all vectors."""
    rows = [(i, [float(i % 3), float(i // 3 % 3), 0.0]) for i in range(300)] + [(900 + i, [1.0, 1.0, 0.0]) for i in range(500)]
    assert found(spark, rows) == plainly(rows, 4, 3, 3)
    same = [(i, [0.5, 0.5, 0.5]) for i in range(40)]
    assert found(spark, same) == plainly(same, 4, 3, 3) and {r[1] for r in found(spark, same)} == {0}


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [-0.01, 0.0, 1e-30]), (7, [-0.01, 0.0, 1e-30]), (None, [9.0, 9.0, 9.0]), (8, [1.0, 1.0, 1.0])]
    assert found(spark, rows, 2) == plainly(rows, 2, 3, 3)
    assert found(spark, rows[:6]) == [] and len(found(spark, rows[7:8])) == 1


def test_huge_components(spark):
    rows = [(1, [1e30, 0.0, 0.0]), (2, [-1e30, 5e8, 0.0]), (3, [3e9, 1.0, 2.0]), (4, [0.5, 1.0, 2.0]), (5, [1e300, -1e300, 1.0]), (6, [2.0**40, 3.0, 4.0])]
    assert found(spark, rows, 3, kind="double") == plainly(rows, 3, 3, 3)


def test_pruning_is_strict_and_works():
    points = np.array([[x, y] for x in range(10) for y in range(10)], np.int64)
    low, high = points.min(axis=0), points.max(axis=0)
    alive = C.not_dominated(low, high, np.array([[5, 5], [100, 5], [5, 100], [-9, 5]]), np.arange(4))
    assert alive.tolist() == [0]
    # Both are as near to the point (5, 5): neither is dominated.
    assert C.not_dominated(np.array([5, 5]), np.array([9, 9]), np.array([[8, 5], [2, 5]]), np.arange(2)).tolist() == [0, 1]
    tree = C.build(np.concatenate([points, points + 1000]), leaf=8)
    nodes = list(C.walk(tree, np.array([[5, 5], [1005, 1005]])))
    assert len(nodes) == 2 and all(d is None for *_, d in nodes)


def test_limbs():
    for v in (0, -1, 5, -(1 << 40), 1 << 40, 10**60, -(10**60)):
        parts = C.limbs(v)
        assert sum(x << (C.LIMB * i) for i, x in enumerate(parts)) == v and all(-(1 << 63) <= x < 1 << 63 for x in parts)
