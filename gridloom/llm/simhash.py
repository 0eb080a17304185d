"""Operator 7: near-duplicate groups by SimHash and pigeonhole blocks.

1. Each text gets a fingerprint: bit i is 1 if it is set in over half of its shingles' hashes.
2. Equal fingerprints are one node, so copies never meet as pairs.
3. Each node is dealt to the values of its blocks. Two fingerprints that differ in at most d bits agree on
   ``choose`` whole groups of bits out of d + ``choose``, so they meet in one block at least.
4. Within a block, Hamming distances are verified by a search that starts from one member after another and
   looks only at members not reached yet; it gives a spanning tree of the block's links, not all pairs.
   Blocks of over ``TILE`` members are cut into tiles, and each pair of tiles is searched on its own.
5. Components of the trees by rounds of large star and small star, each round checkpointed. Nodes are fingerprints,
   with or without an id; a component is named by its smallest id at the end.

Null and empty texts have fingerprint zero, linked like any other. Rows with a null id are kept and link others: they
get their group's smallest id, or null if no row of the group has one. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, map_text

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Members of one block that one search takes; larger blocks are tiled.
TILE = 4096
#: Shingles counted at once, so that memory does not grow with a text.
SLICE = 1 << 15


def shingles(text: str | None, width: int) -> list[str]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return []
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def fingerprint(text: str | None, width: int, lanes: int = 1) -> bytes:
    """``lanes`` x 64 bits, most significant first; lane k hashes with XXH64 of seed 42 + k."""
    parts = [s.encode() for s in shingles(text, width)]
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(parts), SLICE):
        some = parts[at : at + SLICE]
        for lane in range(lanes):
            digest, seed = xxhash.xxh64_digest, 42 + lane
            bits = np.unpackbits(np.frombuffer(b"".join([digest(s, seed) for s in some]), np.uint8).reshape(len(some), 8), axis=1)
            for k in range(0, len(some), 255):
                ones[64 * lane : 64 * lane + 64] += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(parts)).tobytes()


def fingerprints(docs: DataFrame, width: int, lanes: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp binary) of every row."""

    def make():
        return lambda texts: [[fingerprint(t, width, lanes) for t in texts]]

    return map_text(docs, text, make, {"fp": "binary"}, [key])


def pigeonhole_blocks(bits: int, distance: int, choose: int) -> list[list[int]]:
    """Blocks of bit positions such that fingerprints within ``distance`` agree on one at least."""
    groups = np.array_split(np.arange(bits), distance + choose)
    return [np.concatenate(c).tolist() for c in combinations(groups, choose)]


def block_links(fps: np.ndarray, others: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges (i, j) that span the links among rows of fps, or between fps and others (j counts on from len(fps))."""
    both = fps if others is None else np.vstack([fps, others])
    side = np.zeros(len(both), bool) if others is None else np.arange(len(both)) >= len(fps)
    rest = np.arange(len(both))
    edges = []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = np.bitwise_count(both[rest] ^ both[i]).sum(1) <= distance
            if others is not None:
                near &= side[rest] != side[i]
            found = rest[near]
            edges += [(i, int(j)) for j in found]
            front += found.tolist()
            rest = rest[~near]
    return edges


def _runs(batches: Iterator[pa.RecordBatch]):
    """Tables of all rows of one block value after another; rows come sorted, so a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        lengths = np.diff(cuts)
        for n in range(len(lengths)):
            first, end = n == 0, n == len(lengths) - 1
            if first:
                if last is not None and (keys[0] != last).any():
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(0, lengths[0]))
            elif end or lengths[n] > 1:
                if held:
                    yield pa.Table.from_batches(held)
                held = [batch.slice(cuts[n], lengths[n])]
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def links(nodes: DataFrame, blocks: list[list[int]], distance: int) -> DataFrame:
    """(a, b): a spanning set of the links among nodes (id bigint, fp binary); all fingerprints differ."""
    spark = nodes.sparkSession

    def deal(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(fps, axis=1)
            n = batch.num_rows
            tile = pa.array([xxhash.xxh32_intdigest(f) for f in batch.column(1).to_pylist()], pa.int64())
            for k, block in enumerate(blocks):
                packed = np.packbits(bits[:, block], axis=1)
                value = np.zeros((n, 8), np.uint8)
                value[:, : packed.shape[1]] = packed
                value = value.view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(value), tile, *batch.columns], names=["block", "value", "mix", "id", "fp"])

    def search(batches):
        for run in _runs(batches):
            if run.num_rows < 2:
                continue
            ids = run.column("id").to_numpy()
            fps = np.frombuffer(b"".join(run.column("fp").to_pylist()), np.uint8).reshape(run.num_rows, -1)
            i, j, mine = run.column("i")[0].as_py(), run.column("j")[0].as_py(), run.column("tile").to_numpy()
            if i == j:
                edges = block_links(fps, None, distance)
            else:
                first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
                ids = ids[np.concatenate([first, second])]
                edges = block_links(fps[first], fps[second], distance)
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].min(1)), pa.array(ids[at].max(1))], names=["a", "b"])

    dealt = nodes.select("id", "fp").mapInArrow(deal, "block int, value bigint, mix bigint, id bigint, fp binary")
    large = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    if large.isEmpty():
        paired = dealt.select("block", "value", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tile"), "id", "fp")
    else:
        tiles = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(TILE / 2)).cast("int")
        # A member of tile t of a tiled block goes to the pairs (i, j) with i = t or j = t.
        sized = dealt.join(large, ["block", "value"], "left").withColumn("tiles", F.when(F.col("n").isNull(), 1).otherwise(tiles)).withColumn("tile", F.pmod("mix", "tiles").cast("int"))
        paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
            "block", "value", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "fp"
        )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = paired.repartition(n, "block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")
    return ranked.mapInArrow(search, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): smallest reachable id for every id in edges (a, b) that is not itself the smallest. Large star and small star in turn."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each a hands its least neighbour (or itself) to its larger neighbours; small: to its smaller ones and itself.
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.join(least, "a")
        if large:
            out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = digest(edges)
    for _ in range(rounds):
        edges = checkpoint(star(star(edges, True), False))
        now = digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")


def named_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n, component_id) of nodes (node, id, n): the smallest id reachable; null only where no node reachable has one."""
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    linked = nodes.join(found.select(F.col("id").alias("node"), "component").unionByName(roots), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    ends = linked.join(least, "component").select("node", "least")
    return nodes.join(ends, "node", "left").select("node", "n", F.coalesce("least", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, lanes: int = 1, distance: int = 3, blocks: list[list[int]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp binary, component_id) for every row: the smallest key reachable over fingerprints within ``distance`` bits."""
    if blocks is None:
        blocks = pigeonhole_blocks(64 * lanes, distance, 2)
    rows = checkpoint(fingerprints(docs, width, lanes, text, key).select(F.col(key).cast("bigint").alias("id"), "fp", node_of("fp", lanes).alias("node")))
    nodes = checkpoint(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.count("*").alias("n")))
    found = components(links(nodes.select(F.col("node").alias("id"), "fp"), blocks, distance))
    named = checkpoint(named_components(nodes, found))
    return join_hot(rows, named, "node").select(F.col("id").alias(key), "fp", "component_id")


def node_of(fp: str, lanes: int):
    """One lane's fingerprint is its node, as a signed number; more lanes are hashed to one."""
    if lanes > 1:
        return F.xxhash64(fp)
    return F.conv(F.hex(fp), 16, -10).cast("bigint")
