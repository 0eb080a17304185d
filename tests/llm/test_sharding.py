"""Sharding against all contiguous partitions, and rows that are all alike."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import pandas as pd

from gridloom.llm import sharding as S

from .test_operators import words_of


def parts_of(sizes, cuts):
    ends = [0, *cuts, len(sizes)]
    return [sizes[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def cost(sizes, cuts):
    """Largest sum of a shard of several atoms; a shard of one atom is never too large."""
    return max((sum(p) for p in parts_of(sizes, cuts) if len(p) > 1), default=0)


def test_plan_against_all_partitions():
    draw = random.Random(6)
    for _ in range(300):
        sizes = [draw.choice([draw.randint(1, 9), draw.randint(1, 9), 60]) for _ in range(draw.randint(1, 9))]
        shards = draw.randint(1, 5)
        cuts = S.plan(sizes, shards)
        assert len(cuts) == shards - 1 and cuts == sorted(cuts) and all(0 <= c <= len(sizes) for c in cuts)
        n = min(shards, len(sizes))
        best = min(cost(sizes, c) for k in range(n) for c in combinations(range(1, len(sizes)), k))
        assert cost(sizes, cuts) == best


def test_whole_query_against_plain_python(spark):
    """Hot groups and ties: shards follow the plan over the hash ranges, whole groups, slots without gaps."""
    from pyspark.sql import functions as F

    data = [(k, " ".join(words_of(k % 700, 3 + k % 30))) for k in range(1500)] + [(None, "hot " * 400)] * 200 + [(5, "hot " * 400)] * 300 + [(6, None), (6, ""), (None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(7)
    units = {r.text: r.u for r in df.select("text", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(S.UNITS)).cast("int").alias("u")).distinct().collect()}
    size = lambda t: len((t or "").encode()) + 1
    sums = defaultdict(int)
    for _, t in data:
        sums[units[t]] += size(t)
    order = sorted(sums)
    cuts = S.plan([sums[u] for u in order], 16)
    where = {u: sum(c <= k for c in cuts) for k, u in enumerate(order)}
    found = S.shard(df).collect()
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode()), where[units[t]]) for i, t in data)
    assert want == sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard) for r in found)
    for _, own in pd.DataFrame([(r.shard, r.slot) for r in found], columns=["shard", "slot"]).groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    bytes_ = pd.DataFrame([(r.shard, r["size"], r.text_crc32) for r in found], columns=["shard", "size", "crc"])
    sums = bytes_.groupby("shard")["size"].sum()
    hot = bytes_.groupby("crc")["size"].sum().idxmax()
    rest = sums.drop(bytes_[bytes_.crc == hot].shard.iloc[0])
    assert len(sums) == 16 and rest.max() / rest.mean() < 1.25


def test_rows_that_are_all_alike(spark):
    """The copies of one row are numbered where they stand: no group of the window is larger than a partition."""
    df = spark.range(4000).selectExpr("cast(null as bigint) doc_id", "'same' text").repartition(8)
    found = S.shard(df).collect()
    assert sorted(r.slot for r in found) == list(range(4000)) and {r.shard for r in found} == {0}
    plan = S.shard(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "part" in plan
