"""Near-duplicate groups by exact Jaccard similarity of shingle sets: operator 7 for the pipeline's stage.

A SimHash of all shingles cannot decide a similarity of 0.8: such a pair differs in about 15 % of the bits, so no block
long enough to tell texts apart is shared for sure, and 72 blocks of 20 bits miss 6 % of the pairs. So the lanes that are
cut into blocks hold least hashes here, and candidates are verified on the shingles; the chain of operator 7 (nodes,
blocks, verification, spanning links, components) is the same.

1. Each text becomes the set of its distinct shingles, hashed to 64 bits; equal sets are one node.
2. Candidates meet in blocks: ``BANDS`` blocks of ``ROWS`` least hashes each. A pair of similarity s shares a block but
   for a chance of (1 - s^ROWS)^BANDS: 6e-5 at 0.8, 1e-6 at 0.83. Blocks of equal members count once.
3. Each member of a block is compared with the block's pivot, whose set is held while the members stream by; a pivot of
   many members is sent to several tasks. Groups of near copies join up by that alone.
4. Blocks that still have members of several components are searched whole, across components only. Blocks of over
   ``TILE`` members or ``WEIGHT`` shingles are cut into tiles, and each pair of tiles is searched on its own.
5. Components of the links, each of which has a similarity of at least the threshold.

With ``prints`` (width, distance) the method of operator 7 runs whole on the same rows first: fingerprints, pigeonhole blocks,
Hamming distances and components. Rows that it links are linked here too, whatever their similarity, and the least hashes
add the pairs of at least the threshold whose fingerprints differ more.

Texts without a word, null ones too, are one node. Rows with a null id link like others. Repeated rows stay repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, map_text, row_marks
from .simhash import _runs, components, fingerprint, links, named_components, node_of as print_of, pigeonhole_blocks, shingles

BANDS, ROWS = 32, 6
#: Members and shingles of one block that one search takes; larger blocks are tiled.
TILE, WEIGHT = 1024, 1_000_000
#: Shingles hashed at once, so that memory does not grow with a text.
SLICE = 2048

_draw = np.random.default_rng(1)
FLIPS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes."""
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s.encode()) for s in set(shingles(text, width))]), np.uint64))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def band_values(found: np.ndarray) -> np.ndarray:
    """One 64-bit value a band, of its least hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        np.minimum(least, ((found[at : at + SLICE] ^ FLIPS) * FACTORS).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


def set_links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Edges (i, j) that, with the groups, span the links among non-empty sets; with ``side`` only those between two sides."""
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    codes = np.split(dense, np.cumsum(size)[:-1])
    mark = np.zeros(int(dense.max()) + 1, np.uint8)
    rest = np.argsort(size, kind="stable")
    edges = []

    def flat():
        return np.concatenate([codes[k] for k in rest]), np.concatenate([[0], np.cumsum(size[rest])])

    while len(rest):
        own = group[rest] == group[rest[0]]
        front, rest = rest[own].tolist(), rest[~own]
        if not len(rest):
            break
        tokens, starts = flat()
        while front and len(rest):
            i = front.pop()
            lo, hi = np.searchsorted(size[rest], [threshold * size[i] - 1e-9, size[i] / threshold + 1e-9], "left")
            if lo == hi:
                continue
            mark[codes[i]] = 1
            common = np.add.reduceat(mark[tokens[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            mark[codes[i]] = 0
            some = rest[lo:hi]
            near = common >= threshold * (size[some] + size[i] - common) - 1e-9
            if side is not None:
                near &= side[some] != side[i]
            if near.any():
                edges += [(i, int(j)) for j in some[near]]
                reached = np.isin(group[rest], group[some[near]])
                front += rest[reached].tolist()
                rest = rest[~reached]
                if len(rest):
                    tokens, starts = flat()
    return edges


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def pivot_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of blocks and their pivots that are similar."""

    def verify(batches):
        own, held = None, None
        for batch in batches:
            a, b = [], []
            for pivot, node, found in zip(*(batch.column(c).to_pylist() for c in ("pivot", "node", "members")), strict=True):
                if node == pivot:  # comes before its members
                    own, held = pivot, np.frombuffer(found, np.uint64)
                elif own == pivot and similar(held, np.frombuffer(found, np.uint64), threshold):
                    a.append(node)
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = members.filter("node <> pivot").select("node", "pivot").distinct()
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", F.lit(1).alias("kind"))
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"), F.lit(0).alias("kind"))
    both = dealt.unionByName(heads).join(sets, "node")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = both.repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", "kind").select("pivot", "node", "members")
    return ranked.mapInArrow(verify, "a bigint, b bigint")


def block_search(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links across the components of members (block, n, total, node, component) of one block."""

    def search(batches):
        for run in _runs(batches):
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            group, ids = run.column("component").to_numpy(), run.column("node").to_numpy()
            if len(np.unique(group)) < 2:
                continue
            side = None if i == j else run.column("tile").to_numpy() == i
            edges = set_links(_sets(run.column("members")), group, side, threshold)
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    tiles = F.when((F.col("n") <= TILE) & (F.col("total") <= WEIGHT), 1).otherwise(F.ceil(F.greatest(2 * F.col("n") / TILE, 2 * F.col("total") / WEIGHT))).cast("int")
    # A member of tile t goes to the pairs (i, j) with i = t or j = t.
    sized = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", "n", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "component", "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = paired.join(sets, "node").select("block", "n", "i", "j", "tile", "component", "node", "members").repartition(parts, "block", "i", "j").sortWithinPartitions("block", "n", "i", "j")
    return ranked.mapInArrow(search, "a bigint, b bigint").distinct()


def print_links(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): nodes of rows (node, fp) that operator 7's components bring together, each linked to the smallest of its component."""
    met = checkpoint(rows.groupBy("node", "fp").agg(F.count("*").alias("_n")).select("node", "fp", print_of("fp", 1).alias("id")))
    prints = checkpoint(met.groupBy("id").agg(F.first("fp").alias("fp")))
    found = components(links(prints, pigeonhole_blocks(64, distance, 2), distance))
    own = checkpoint(met.join(found, "id", "left").select("node", F.coalesce("component", "id").alias("group")))
    least = own.groupBy("group").agg(F.min("node").alias("b"), F.max("node").alias("most"), F.count("*").alias("n")).filter("b < most").drop("most")
    return checkpoint(join_hot(own, least, "group").filter("node <> b").select(F.col("node").alias("a"), "b"))


def near_copies(docs: DataFrame, width: int = 5, threshold: float = 0.8, text: str = "text", key: str = "doc_id", prints: tuple[int, int] | None = None) -> DataFrame:
    """(id, mark, mark2, component, component_id) for every row: its marks over all columns, its group, and the smallest key reachable over links of Jaccard similarity >= threshold, and with ``prints`` over links of operator 7."""

    def sketch():
        def apply(texts):
            found = [shingle_set(t, width) for t in texts]
            made = [[node_of(s) for s in found], [len(s) for s in found], [band_values(s) for s in found]]
            return made if prints is None else [*made, [fingerprint(t, prints[0]) for t in texts]]

        return apply

    def whole():
        def apply(texts):
            return [[shingle_set(t, width).tobytes() for t in texts]]

        return apply

    one, two = row_marks(docs)
    named = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("words"), one.alias("mark"), two.alias("mark2"))
    fields = {"node": "bigint", "size": "bigint", "bands": "array<bigint>"} | ({} if prints is None else {"fp": "binary"})
    rows = checkpoint(map_text(named, "words", sketch, fields, ["id", "mark", "mark2"]))
    nodes = checkpoint(rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("size").alias("size"), F.min(F.struct("mark", "mark2")).alias("row"), F.first("bands").alias("bands")))
    dealt = nodes.select("node", "size", F.explode("bands").alias("block"))
    blocks = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("pivot"), F.bit_xor("node").alias("mix")).filter("n > 1")
    once = blocks.groupBy("n", "total", "pivot", "mix").agg(F.min("block").alias("block"))
    members = checkpoint(dealt.join(once, "block").select("block", "n", "total", "node", "pivot"))

    # One text of each node that meets another.
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "row.mark", "row.mark2")
    texts = named.select("words", "mark", "mark2").join(wanted, ["mark", "mark2"])
    sets = checkpoint(map_text(texts, "words", whole, {"members": "binary"}, ["node"]).dropDuplicates(["node"]))

    linked = checkpoint(pivot_links(members, sets, threshold))
    if prints is not None:
        linked = checkpoint(linked.union(print_links(rows, prints[1])))
    found = components(linked)
    more = members.filter("n > 2").join(found.withColumnRenamed("id", "node"), "node", "left").select("block", "n", "total", "node", F.coalesce("component", "node").alias("component"))
    mixed = more.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("block")
    rest = checkpoint(more.join(mixed, "block", "left_semi"))
    if not rest.isEmpty():
        found = checkpoint(components(linked.union(block_search(rest, sets, threshold))))
    groups = found.select(F.col("id").alias("node"), "component")
    ends = checkpoint(named_components(nodes.select("node", "id", "n"), found).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return join_hot(rows.select("id", "mark", "mark2", "node"), ends, "node").select(F.col("id").alias(key), "mark", "mark2", "component", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: float = 0.8, text: str = "text", key: str = "doc_id", prints: tuple[int, int] | None = None) -> DataFrame:
    """One row of each group stays: that of the smallest key (nulls last), of several such rows the one of the smallest mark, once.

    Rows are told apart by marks over all their columns, not by their keys, so rows that share a key are decided on their
    own. Repeated rows are one group and leave one row.
    """
    found = checkpoint(near_copies(docs, width, threshold, text, key, prints))
    kinds = found.groupBy("component", "mark", "mark2").agg(F.min(key).alias("id"), F.count("*").alias("n"))
    best = kinds.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark", "mark2")).alias("best")).select("component", "best.mark", "best.mark2")
    told = checkpoint(kinds.join(best.withColumn("stays", F.lit(True)), ["component", "mark", "mark2"], "left"))
    lost = told.filter("stays is null").select("mark", "mark2")
    again = told.filter("stays and n > 1").select("mark", "mark2")
    own = [f"c{k}" for k in range(len(docs.columns))]
    marked = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)), *(m.alias(name) for m, name in zip(row_marks(docs), ("mark", "mark2"), strict=True)))
    kept = marked.join(lost, ["mark", "mark2"], "left_anti")
    if not again.isEmpty():
        once = kept.join(again, ["mark", "mark2"], "left_semi").dropDuplicates(["mark", "mark2"])
        kept = kept.join(again, ["mark", "mark2"], "left_anti").unionByName(once)
    return kept.select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)))
