"""Operator 9: benchmark decontamination by one Aho-Corasick automaton.

Benchmark items become windows of consecutive words; all windows of all items are patterns of one automaton.
Each text is scanned once in normalised form; where a window ends, its words are marked, and word numbers lead
back to offsets in the original text.

The windows are broadcast; that is safe up to ``MAX_PATTERN_BYTES``, which is checked first. The windows of a larger
benchmark are dealt to parts by a hash, an automaton each, and all of them to one filter of bits, whose size is bounded:
one scan of the texts finds, by the filter, which texts may hold a window of which parts, and only those texts meet those
parts' automata, one after the other. A second scan joins the marks to the rows by a digest of the text. So texts are read
twice however large the benchmark is. A filter that is too full for it sends more texts to automata and loses none.

Null and empty texts have no words and no hits. Items without words, and null items, match nothing. Items with a
null id can mark words but are not named. Repeated items and rows count like any others.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, HOT_SHARE, remove, shared_folder

#: Bytes of windows in one automaton, which takes some 90 bytes of memory for each; words of one piece of an item.
MAX_PATTERN_BYTES, PIECE = 2 << 20, 4096
#: Bits of the filter as a power of two, least and most; bits for each window; slices of the candidates of one part.
FILTER_BITS, BITS_PER_WINDOW, SLICES = (16, 29), 16, 16
#: Odd factors of hashes: of a word's place in a window, and of the bits that a window sets.
STEP, PROBES = np.uint64(0x9E3779B97F4A7C15), [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Bytes of marks up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Words of a text that has not been lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: On UTF-8 bytes: A-Z to a-z; other ASCII that is no digit or letter to a space; bytes from 0x80 on stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def owners_of(items: list[tuple[int | None, str | None]], size: int) -> dict[bytes, set]:
    """Windows, and the items that have them."""
    owners: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        for w in windows(normal_words(text), size):
            owners[w].add(item)
    return owners


def window_hashes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """Hashes of all windows of these sizes."""
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out = [np.zeros(0, np.uint64)]
    for n in sizes:
        sums = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            sums = sums * STEP + each[k : k + len(sums)]
        out.append(sums ^ sums >> np.uint64(31))
    return np.concatenate(out)


def filter_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [hashes * f >> np.uint64(64 - bits) for f in PROBES]


class Scanner:
    """An automaton over windows: of items, or of (window, items)."""

    def __init__(self, items: list[tuple], size: int | None):
        import ahocorasick

        owners = owners_of(items, size) if size else {w: who for w, who in items}
        self.find = ahocorasick.Automaton()
        for w, who in owners.items():
            self.find.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(x for x in who if x is not None)))
        if owners:
            self.find.make_automaton()
        self.any = bool(owners)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], set[int]]:
        """Number of words, marks, items."""
        words = normal_words(text)
        if not words or not self.any:
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, items = [], set()
        for end, (n, who) in self.find.iter(line):
            ends.append((end, n))
            items.update(who)
        if not ends:
            return len(words), [], items
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        ranges: list[tuple[int, int]] = []
        for stop, n in sorted((int(np.searchsorted(spaces, end)), n) for end, n in ends):
            start = stop - n
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, stop))
        return len(words), [(*r, *s) for r, s in zip(ranges, spans_of(text, ranges), strict=True)], items


def merged(marks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Marks (from word, to word, from character, to character) of which none touches another."""
    out: list[tuple[int, int, int, int]] = []
    for w0, w1, c0, c1 in sorted(marks):
        if out and out[-1][1] >= w0:
            out[-1] = (out[-1][0], max(w1, out[-1][1]), out[-1][2], max(c1, out[-1][3]))
        else:
            out.append((w0, w1, c0, c1))
    return out


def spans_of(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Marked word ranges as character offsets [from, to) in the original text."""
    words = [m.span() for m in WORD.finditer(text or "")] if ranges else []
    return [(words[a][0], words[b - 1][1]) for a, b in ranges]


def pieces(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text): normal words of the items, in pieces that together have the items' windows."""

    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(t)
                for at in range(0, max(1, len(words) - size + 1) if words else 0, PIECE):
                    ids.append(i)
                    out.append(b" ".join(words[at : at + PIECE + size - 1]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["item_id", "text"])

    return benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, "item_id bigint, text string")


FIELDS = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean", "spans": "string"}
ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def summary(n_words: int, marks: list[tuple[int, int, int, int]], items: set[int]) -> tuple:
    """The values of ``FIELDS``; spans are character offsets in the original text, like ``10-75,90-120``."""
    hit = sum(w1 - w0 for w0, w1, _, _ in marks)
    return n_words, hit, len(items), sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), hit > 0, ",".join(f"{c0}-{c1}" for _, _, c0, c1 in marks)


def map_rows(frame: DataFrame, n: int, make, fields: dict[str, str]) -> DataFrame:
    """The first n columns (k0, ...) and what a function, made once a task, makes of the others row by row; None leaves a row out."""
    kept = frame.schema[:n]

    def run(batches):
        f = make()
        for batch in batches:
            made = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)]
            some = pa.array([m is not None for m in made])
            values = list(zip(*(m for m in made if m is not None), strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*(c.filter(some) for c in batch.columns[:n]), *(pa.array(v, ARROW[t]) for v, t in zip(values, fields.values(), strict=True))], names=[*(f.name for f in kept), *fields])

    return frame.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{k} {t}" for k, t in fields.items())]))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, spans. A kept column with the name of a result is left out."""
    spark = docs.sparkSession
    parts = pieces(benchmark, size)
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total * size // MAX_PATTERN_BYTES))
    keep = tuple(c for c in keep if c not in FIELDS)
    n = len(keep)
    frame = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("value"))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    if passes == 1:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in parts.distinct().collect()], size))

        def whole():
            scan = scanner_of(*shared.value).scan
            return lambda value: summary(*scan(value))

        out = map_rows(frame, n, whole, FIELDS)
    else:
        out = in_parts(frame, n, parts, size, passes, total)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *FIELDS)


def window_rows(parts: DataFrame, size: int, passes: int) -> DataFrame:
    """(part, n, hash, window, item_id): the windows of all items, dealt by their hashes."""

    def cut(batches):
        for batch in batches:
            for item, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = piece.encode("utf-8", "surrogatepass").split()
                n = min(size, len(words))
                hashes = window_hashes(words, [n])
                k = len(hashes)
                columns = [pa.array((hashes % np.uint64(passes)).astype(np.int32)), pa.array(np.full(k, n, np.int32)), pa.array(hashes.view(np.int64)), pa.array([b" ".join(words[i : i + n]) for i in range(k)], pa.binary()), pa.array([item] * k, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "hash", "window", "item_id"])

    return parts.mapInArrow(cut, "part int, n int, hash bigint, window binary, item_id bigint")


def window_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set for (hash), as bytes on the driver: at most 2 ** ``FILTER_BITS`` [1] bits. Each block of them is made by a task."""
    block = min(bits, 16)

    def place(batches):
        for batch in batches:
            where = np.concatenate(filter_places(batch.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(where))], names=["place"])

    def fill(group: pa.Table) -> pa.Table:
        where = group.column("place").to_numpy()
        marks = np.zeros(1 << block, np.uint8)
        marks[where & ((1 << block) - 1)] = 1
        return pa.table({"block": pa.array([int(where[0]) >> block]), "marks": pa.array([np.packbits(marks).tobytes()])})

    places = hashes.mapInArrow(place, "place bigint").distinct()
    out = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << block - 3
    for r in places.groupBy(F.shiftright("place", block).alias("block")).applyInArrow(fill, "block bigint, marks binary").toLocalIterator():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.marks, np.uint8)
    return out


def in_parts(frame: DataFrame, n: int, parts: DataFrame, size: int, passes: int, total: int) -> DataFrame:
    """What ``contamination`` gives, for benchmarks of more windows than one automaton may have."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/decontamination-{uuid.uuid4().hex}"
    rows = window_rows(parts, size, passes)
    rows.groupBy("part", "n", "hash", "window").agg(F.collect_set("item_id").alias("items")).repartition("part").write.partitionBy("part").parquet(f"{folder}/windows")
    made = spark.read.parquet(f"{folder}/windows")
    known = made.agg(F.count("*").alias("n"), F.collect_set("n").alias("sizes")).first()
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], (known.n * BITS_PER_WINDOW).bit_length()))
    filter_ = spark.sparkContext.broadcast((window_filter(made.select("hash"), bits), sorted(known.sizes)))

    def suspects():
        """The words of a text, and the parts of which it may hold windows."""
        marks, sizes = filter_.value

        def one(value):
            words = normal_words(value)
            hashes = window_hashes(words, sizes)
            there = np.ones(len(hashes), bool)
            for where in filter_places(hashes, bits):
                there &= (marks[where >> np.uint64(3)] << (where & np.uint64(7)).astype(np.uint8) & 128).astype(bool)
            return len(words), np.unique(hashes[there] % np.uint64(passes))

        return one

    def candidates():
        look = suspects()

        def one(value):
            _, some = look(value)
            return (digest(value), some.astype(np.int64).tolist(), value) if len(some) else None

        return one

    found = map_rows(frame.select("value"), 0, candidates, {"key": "binary", "parts": "array<bigint>", "text": "string"})
    found = found.select("key", F.explode(F.col("parts").cast("array<int>")).alias("part"), "text")
    found.repartition("part", F.pmod(F.xxhash64("key"), F.lit(SLICES))).write.partitionBy("part").parquet(f"{folder}/texts")
    texts = spark.read.schema("key binary, text string, part int").parquet(f"{folder}/texts")
    some = sorted(r.part for r in texts.select("part").distinct().collect())
    for k in some:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(bytes(r.window), set(r["items"])) for r in made.filter(F.col("part") == k).select("window", "items").collect()], None))

        def hits(shared=shared):
            scan = scanner_of(*shared.value).scan

            def one(value):
                _, marks, items = scan(value)
                return (digest(value), np.array(marks, np.int64).tobytes(), np.array(sorted(items), np.int64).tobytes()) if marks else None

            return one

        map_rows(texts.filter(F.col("part") == k).select("text"), 0, hits, {"key": "binary", "marks": "binary", "items": "binary"}).write.parquet(f"{folder}/marks/part={k}")
        shared.destroy()
    marks = spark.createDataFrame([], "key binary, marks binary, items binary, part int")
    if some:
        marks = spark.read.schema("key binary, marks binary, items binary, part int").parquet(f"{folder}/marks")
    each = marks.groupBy("part", "key").agg(F.count("*").alias("n"), F.first("marks").alias("marks"), F.first("items").alias("items"))
    each.groupBy("key").agg(F.max("n").alias("n"), F.collect_list("marks").alias("marks"), F.collect_list("items").alias("items")).write.parquet(f"{folder}/found")
    remove(spark, f"{folder}/texts")
    answers = spark.read.parquet(f"{folder}/found")
    sums = answers.agg(F.sum("n").alias("n"), F.sum(F.lit(64) + F.aggregate(F.concat("marks", "items"), F.lit(0), lambda a, x: a + F.octet_length(x))).alias("bytes")).first()

    def keys():
        """A row without a suspected window gets a key of its own: no equal texts meet in one task."""
        from pyspark import TaskContext

        look, task, count = suspects(), TaskContext.get().partitionId(), 0

        def one(value):
            nonlocal count
            words, some = look(value)
            count += 1
            own = task.to_bytes(5, "little") + count.to_bytes(7, "little")
            return words, digest(value) if len(some) else own, own

        return one

    rows = map_rows(frame, n, keys, {"words": "bigint", "key": "binary", "own": "binary"})
    kept = [*rows.columns[:n], "words"]
    if (sums.bytes or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(answers.drop("n")), "key", "left")
    else:
        # Fewer than 1 / HOT_SHARE texts are hot; their rows get their marks by broadcast and keys of their own.
        hot = answers.filter(F.col("n") > sums.n * HOT_SHARE).select("key", F.col("marks").alias("marks_"), F.col("items").alias("items_"))
        first = rows.join(F.broadcast(hot), "key", "left").withColumn("key", F.when(F.col("marks_").isNull(), F.col("key")).otherwise(F.col("own")))
        joined = first.join(answers.drop("n"), "key", "left").select(*kept, F.coalesce("marks_", "marks").alias("marks"), F.coalesce("items_", "items").alias("items"))

    def join():
        def one(words, marks, items):
            quads = [tuple(m) for raw in marks or [] for m in np.frombuffer(raw, np.int64).reshape(-1, 4).tolist()]
            return summary(words, merged(quads), {i for raw in items or [] for i in np.frombuffer(raw, np.int64).tolist()})

        return one

    return map_rows(joined.select(*kept, "marks", "items"), n, join, FIELDS)


def digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


#: The scanner of this process and its name: tasks that run in one process after another share it.
SCANNERS: dict[str, Scanner] = {}


def scanner_of(name: str, items: list, size: int | None) -> Scanner:
    if name not in SCANNERS:
        SCANNERS.clear()
        SCANNERS[name] = Scanner(items, size)
    return SCANNERS[name]
