"""Operator 6: sharding by minimax contiguous partition [native].

Equal texts are one group and stay in one shard. Groups are ordered by a hash of their text; the bounded number of
``UNITS`` hash ranges are the atomic sizes: a range holds one group or more, so the capacity is the smallest over ranges,
which is above that over groups by a range at most. The order is cut into shards that are either of one atom or within a capacity;
the smallest capacity for which a greedy pass needs no more than the shards is found by binary search. So an atom over
an even share takes a shard to itself where it stands, and the stretches between such atoms get the shards that the
greedy pass gave them. Within a stretch the cuts are placed at its own smallest capacity, each as near to an even share
as that capacity allows.

Sizes are computed in one pass over the texts and checkpointed; only the sums of the ranges reach the driver. Slots are
numbered within partitions of the checkpoint, whose counts by shard are summed before them, so no task gets a shard, a
group or the copies of one row as a whole.

Null texts have no bytes: they have size 1, text_crc32 0 and are one group with empty texts. Repeated rows and null ids
are kept, each in a slot of its own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

UNITS = 1 << 15


def cuts_needed(sizes: list[int], capacity: int) -> int:
    """Shards that a greedy pass needs."""
    shards, room = 1, capacity
    for s in sizes:
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if cuts_needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def contiguous_cuts(sizes: list[int], shards: int) -> list[int]:
    """Positions at which shards 1, 2, ... begin: no shard is over the smallest capacity, and each cut is near its even share."""
    if not sizes:
        return [0] * (shards - 1)
    capacity = smallest_capacity(sizes, shards)
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    # Least position of each cut: greedy from the end.
    least, at = [0] * shards, len(sizes)
    for k in range(shards - 1, 0, -1):
        while at > 0 and before[-1 if k == shards - 1 else least[k + 1]] - before[at - 1] <= capacity:
            at -= 1
        least[k] = at
    cuts, start = [], 0
    for k in range(1, shards):
        most = start
        while most < len(sizes) and before[most + 1] - before[start] <= capacity:
            most += 1
        even = before[-1] * k / shards
        start = min(range(max(least[k], start), most + 1), key=lambda i: (abs(before[i] - even), i))
        cuts.append(start)
    return cuts


def stretches(sizes: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(from, to, shards) of a greedy pass: atoms over the capacity on their own, what stands between them by as many shards as it needs."""
    out, at = [], 0
    for k, s in enumerate([*sizes, None]):
        if s is None or s > capacity:
            if at < k:
                out.append((at, k, cuts_needed(sizes[at:k], capacity)))
            if s is not None:
                out.append((k, k + 1, 1))
            at = k + 1
    return out


def plan(sizes: list[int], shards: int) -> list[int]:
    """Positions at which shards 1, 2, ... begin; shards left over are empty at the end."""
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if sum(n for *_, n in stretches(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    cuts = []
    for a, b, n in stretches(sizes, low):
        cuts += [a, *(a + c for c in contiguous_cuts(sizes[a:b], n))]
    return [*cuts[1:], *[len(sizes)] * (shards - max(1, len(cuts)))]


def shard(df: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``bytes``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = checkpoint(
        df.select(
            F.col(f"`{key}`").alias("id"),
            (F.octet_length(whole) + 1).cast("bigint").alias("size"),
            F.crc32(whole).alias("crc"),
            F.pmod(F.xxhash64(whole), F.lit(UNITS)).cast("int").alias("unit"),
        )
    )
    # Partial sums leave at most one row a unit and task before the shuffle, however large a group is.
    sums = sorted((r.unit, r.bytes) for r in rows.groupBy("unit").agg(F.sum("size").alias("bytes")).collect())
    begin = [sums[c][0] if c < len(sums) else UNITS for c in plan([b for _, b in sums], shards)]
    passed = sum((F.when(F.col("unit") >= F.lit(b), 1).otherwise(0) for b in begin), F.lit(0)).cast("int")
    dealt = rows.select("id", "size", "crc", "unit", passed.alias("shard"), F.spark_partition_id().alias("part"))
    counted = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "part").orderBy("unit", "id", "size", "crc")
    slotted = dealt.withColumn("at", F.row_number().over(within)).join(offsets, ["shard", "part"])
    return slotted.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("at") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
