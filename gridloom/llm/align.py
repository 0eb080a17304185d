"""Operator 12: cross-tokenizer alignment by segment deduplication.

Texts are split before runs of white space. There neither vocabulary can merge: the words of the byte-level vocabulary's
pattern never reach from another character into white space, and of the pieces of the other vocabulary those that hold
such a border are read from the file; where one has a border's two characters, no cut is made (``safe_cut``). So a text's
encoding is its segments' encodings in a row, and no group of aligned tokens reaches over a cut.

1. Documents are put in packs of about ``PACK`` characters: the distinct segments, and each document as their numbers.
2. The segments of all packs are brought together and sorted, so that each distinct one is encoded by both vocabularies and
   aligned once, and its alignment goes back to every pack that has it. A pack has a segment once, however often it stands
   there, so the most frequent segment has as many rows as there are packs.
3. Packs compose their documents' digests and count in how many of them each id pair is linked.
4. Counts are summed over packs, the highest of each A id is found, both are joined back to the packs' pairs, and packs
   sum them over each document's links.

Packs are written to the shared folder, from which everything after them can be made again, and removed when the result
is there.

A is a byte-level BPE file of the tokenizers library, read with its special tokens as plain text; B is a BPE model of the
sentencepiece library with byte fallback that puts a space before each text. Both encode a space and the text. Two tokens
end together where their bytes do; such offsets cut the tokens into groups, and each A token of a group is linked with
each of its B tokens. Links are counted by distinct ids of a group, so a long group costs no product of its tokens.

Null and empty texts, and those which A's or B's tokens do not spell byte by byte, have no tokens: zeros and an empty
digest. Null ids and repeated rows are kept, each a document. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import byte_characters
from .common import checkpoint, remove, shared_folder

#: Characters of a pack's texts, beyond which the next document begins another.
PACK = 1 << 23
#: White space as regular expressions of Unicode have it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
IS_SPACE = re.compile(f"[{SPACE}]")
#: A fixed value: B's sign for a space.
BLANK = "\u2581"
#: Where a text is not just words between single spaces and one or two line breaks.
ODD_RUNS = ("  ", " \n", "\n ", "\n\n\n")
ODD_SPACE = [c for c in map(chr, range(128)) if IS_SPACE.match(c) and c not in " \n"]
FAR_SPACE = re.compile(f"[{SPACE[4:]}]")
#: A character after which B's pieces hold no white space; stands before segments that do not begin with B's own space.
STAY = "x"


def pieces_with_borders(model) -> set[tuple[str, str]]:
    """Pairs of a character and white space after it that stand side by side in a piece of B."""
    pieces = (model.id_to_piece(i).replace(BLANK, " ") for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if IS_SPACE.match(b) and not IS_SPACE.match(a)}


#: Rows of segments whose alignments a task sends together.
GATHER = 1 << 16
#: Of compression; what is compressed is shuffled, so it pays to compress well.
LEVEL = 6
#: Segments of more characters are encoded on their own, and so are those with a group of more links.
LONG, LARGE = 10_000, 1_000
#: Cells of the table in which documents mark their pairs.
MARKS = 1 << 22
#: What an alignment's integers begin with.
HEAD = ("good", "n_a", "n_b", "n_groups", "n_links", "n_pairs")


@dataclass
class Aligned:
    """Alignments of segments: HEAD by row, their id pairs and how often each is linked one after the other, and the groups' texts."""

    head: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    groups: list[str]

    @staticmethod
    def of(rows: list[dict]) -> Aligned:
        links = [sorted(x["links"].items()) for x in rows]
        head = [[x["good"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], len(x["links"])] for x in rows]
        flat = np.array([p for own in links for p in own], np.int64).reshape(-1, 2)
        return Aligned(np.array(head, np.int64).reshape(-1, len(HEAD)), flat[:, 0], flat[:, 1], [x["groups"] for x in rows])

    def take(self, rows: np.ndarray) -> Aligned:
        size = self.head[:, -1]
        at = stretches((np.cumsum(size) - size)[rows], size[rows])
        return Aligned(self.head[rows], self.pair[at], self.times[at], [self.groups[i] for i in rows.tolist()])

    def then(self, other: Aligned) -> Aligned:
        return Aligned.joined([self, other])

    @staticmethod
    def joined(parts: list[Aligned]) -> Aligned:
        head, pair, times = (np.concatenate([getattr(p, c) for p in parts]) for c in ("head", "pair", "times"))
        return Aligned(head, pair, times, [t for p in parts for t in p.groups])

    def numbers(self) -> bytes:
        return small(np.concatenate([self.head.T.ravel(), self.pair, self.times]))

    @staticmethod
    def read(numbers: bytes, groups: list[str]) -> Aligned:
        flat, n = large(numbers), len(HEAD) * len(groups)
        pair, times = np.split(flat[n:], 2)
        return Aligned(flat[:n].reshape(len(HEAD), -1).T, pair, times, groups)


EMPTY = Aligned.of([])


class Pair:
    """Both vocabularies, and what they make of segments."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        spec = json.load(open(a_path, encoding="utf-8"))
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError(f"not a byte-level BPE vocabulary that splits by its pattern: {a_path}")
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        self.borders = pieces_with_borders(self.b)
        probe = "a\tb\xa0c  d\u2003e\u3000f\u2028 \ufb01\n"
        if self.b.normalize(probe) != (" " + probe).replace(" ", BLANK) or any(a == STAY for a, _ in self.borders):
            raise ValueError(f"not a model that leaves texts as they are but for a space before them: {b_path}")
        if any(b in " \n" for _, b in self.borders):
            raise ValueError(f"pieces reach over spaces or lines: {b_path}")
        self.bordered = re.compile("[" + "".join(re.escape(b) for _, b in sorted(self.borders)) + "]" if self.borders else "(?!)")
        self.stay = self.b.encode(STAY)
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {t["id"] for t in spec["added_tokens"]}
        self.a_bytes = {i: t.encode() if i in special else bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])

    def safe_cut(self, before: str, after: str) -> bool:
        return (before[-1], after[0]) not in self.borders

    def segments(self, text: str) -> list[str]:
        """Of a space and the text; joined they are both again."""
        found = SEGMENT.findall(" " + text)
        if not self.bordered.search(text):
            return found
        out = found[:1]
        for s in found[1:]:
            if self.safe_cut(out[-1], s):
                out.append(s)
            else:
                out[-1] += s
        return out

    def keys(self, text: str) -> list[str]:
        """Segments, those of one space and what follows without the space.

        In a text without other white space than single spaces and one or two line breaks, cutting before each is splitting at
        spaces after one has been put before each line break.
        """
        odd = IS_SPACE.match(text[0]) or IS_SPACE.match(text[-1]) or any(c in text for c in ODD_SPACE) or any(c in text for c in ODD_RUNS)
        if odd or not text.isascii() and FAR_SPACE.search(text):
            return [s[1:] if s[0] == " " and not IS_SPACE.match(s, 1) and len(s) > 1 else s for s in self.segments(text)]
        return text.replace("\n", " \n").replace("\n \n", "\n\n").split(" ")

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments that stand inside a text: those that begin with a space as if B had put it there."""
        found = self.b.encode([s[1:] if s[0] == " " else STAY + s for s in segments], num_threads=1)
        # B gives an empty text no space of its own.
        alone = self.b.piece_to_id(BLANK)
        return [([alone] if s == " " else ids) if s[0] == " " else ids[len(self.stay) :] for s, ids in zip(segments, found, strict=True)]

    def align_one(self, segment: str) -> dict:
        a, b = self.a.encode(segment, add_special_tokens=False).ids, self.encode_b([segment])[0]
        return alignment(segment, a, b, [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b], len(self.b_bytes))

    def align(self, segments: list[str]) -> Aligned:
        """Of distinct segments, encoded as one text where they can be joined."""
        alone = [IS_SPACE.match(s[-1]) is not None or len(s) > LONG or BLANK in s or self.bordered.match(s) is not None for s in segments]
        few = [i for i, x in enumerate(alone) if not x]
        made = self.align_joined([segments[i] for i in few]) if few else None
        if made is None:
            few, made, alone = [], Aligned.of([]), [True] * len(segments)
        others = [i for i, x in enumerate(alone) if x]
        # What has a group of many links counts them one by one.
        again = [few[i] for i in np.flatnonzero(made.head[:, 0] < 0)]
        both = made.take(np.flatnonzero(made.head[:, 0] >= 0)).then(Aligned.of([self.align_one(segments[i]) for i in others + again]))
        places = [i for i, x in zip(few, made.head[:, 0], strict=True) if x >= 0] + others + again
        return both.take(np.argsort(np.array(places, np.int64)))

    def align_joined(self, segments: list[str]) -> Aligned | None:
        """None if the whole is not spelt or not cut at the segments; -1 stands for good where a group has too many links."""
        whole = "".join(segments)
        raw = whole.encode("utf-8", "surrogatepass")
        a = np.array(self.a.encode(whole, add_special_tokens=False).ids, np.int64)
        b = np.array(self.encode_b([whole])[0], np.int64)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return None
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in segments])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_cut = np.searchsorted(ends, cuts)
        n_groups = np.bincount(of_cut, minlength=len(segments))
        if not np.array_equal(cuts[np.cumsum(n_groups) - 1], ends):
            return None
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        a_many, b_many = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        sums = lambda v: np.bincount(of_cut, v, len(segments)).astype(np.int64)
        n_a, n_b, n_links = sums(a_many), sums(b_many), sums(a_many * b_many)
        # Links of all but large groups, by segment and id pair.
        times = np.where(a_many * b_many > LARGE, 0, b_many)[a_group]
        first = np.cumsum(b_many) - b_many
        pair = np.repeat(a, times) * len(self.b_bytes) + b[stretches(first[a_group], times)]
        space = len(self.a_sizes) * len(self.b_bytes)
        links, n = np.unique(np.repeat(of_cut[a_group], times) * space + pair, return_counts=True)
        owner, pair = np.divmod(links, space)
        n_pairs = np.bincount(owner, minlength=len(segments))
        good = np.ones_like(n_a)
        good[of_cut[a_many * b_many > LARGE]] = -1
        # Tokens by group, A's before B's, each with what stands after it.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        after = np.full(len(order), ",", object)
        after[np.cumsum(a_many + b_many) - b_many - 1] = "|"
        after[np.cumsum(a_many + b_many) - 1] = ";"
        said = [None] * (2 * len(order))
        said[::2] = map(str, np.concatenate([a, b])[order].tolist())
        said[1::2] = after.tolist()
        to = 2 * np.cumsum(n_a + n_b)
        groups = ["".join(said[f : t - 1]) for f, t in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
        return Aligned(np.stack([good, n_a, n_b, n_groups, n_links, n_pairs], axis=1), pair, n, groups)


def alignment(text: str, a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes], n_ids: int) -> dict:
    """Of one segment: whether both spell it, counts, the groups' text, and its links by id pair (A's id times ``n_ids`` and B's)."""
    raw = text.encode("utf-8", "surrogatepass")
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return {"good": False, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "links": {}}
    a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    b_at = {e: i + 1 for i, e in enumerate(b_ends)}
    groups, links, i, j, n_links = [], Counter(), 0, 0, 0
    for k, e in enumerate(a_ends, 1):
        if (m := b_at.get(e)) is None:
            continue
        own_a, own_b = a[i:k], b[j:m]
        groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
        n_links += len(own_a) * len(own_b)
        many_b = Counter(own_b).items()
        for x, n in Counter(own_a).items():
            for y, o in many_b:
                links[x * n_ids + y] += n * o
        i, j = k, m
    return {"good": True, "n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": n_links, "groups": ";".join(groups), "links": links}


def dense(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def small(values: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed."""
    raw = np.ascontiguousarray(values.astype("<i8").view("u1").reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + dense(raw.tobytes())


def large(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True), "u1").reshape(8, n) if n else np.zeros((8, 0), "u1")
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table, written to the shared folder, and its place."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def packs(documents: DataFrame, text: str, key: str, pair: Callable[[], Pair], size: int) -> DataFrame:
    """(pack, ids, ends, numbers, segments): document i has the segments of the numbers from ends[i - 1] to ends[i]."""
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("ends", T.BinaryType()), T.StructField("numbers", T.BinaryType()), T.StructField("segments", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, arrow = pair(), to_arrow_schema(schema)
        ids: list = []
        ends: list[int] = []
        numbers: list[np.ndarray] = []
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        total = at = 0

        def full() -> pa.RecordBatch:
            nonlocal total, at
            segments = [k if IS_SPACE.match(k) else f" {k}" for k in index]
            row = {"ids": list(ids), "ends": small(np.array(ends)), "numbers": small(np.concatenate(numbers)), "segments": segments}
            for x in (ids, ends, numbers, index):
                x.clear()
            total = at = 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                own = both.keys(t) if t else []
                numbers.append(np.fromiter(map(index.__getitem__, own), np.int32, len(own)))
                at += len(own)
                ids.append(i)
                ends.append(at)
                total += len(t or "") + 16
                if total >= size:
                    yield full()
        if ids:
            yield full()

    made = documents.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)
    return made.select(F.monotonically_increasing_id().alias("pack"), "*")


def aligned(packed: DataFrame, pair: Callable[[], Pair]) -> DataFrame:
    """(pack, ks, numbers, groups): alignments of a pack's segments ks, each made once for all packs that have it.

    A task sends what some of its rows have for one pack as one row.
    """

    def sent(rows: list[tuple], made: list[Aligned]) -> Iterator[pa.RecordBatch]:
        pack, k, row = (np.concatenate(x) for x in zip(*rows, strict=True))
        whole = Aligned.joined(made)
        order = np.argsort(pack, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(pack[order])) + 1):
            own = whole.take(row[some])
            columns = ([pack[some[0]]], [small(k[some])], [own.numbers()], [dense("\n".join(own.groups).encode())], [sum(map(len, own.groups)) + len(some) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["pack", "ks", "aligned", "groups", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair()
        rows, made, n, at = [], [], 0, 0
        last, before = None, EMPTY
        for batch in batches:
            if not batch.num_rows:
                continue
            index = batch.column(2).dictionary_encode()
            segments = index.dictionary.to_pylist()
            # Equal segments stand together, so only a batch's first can be the one before.
            own = before.then(both.align(segments[1:])) if segments[0] == last else both.align(segments)
            last, before = segments[-1], own.take(np.array([len(segments) - 1]))
            pack, k, row = (x.to_numpy(zero_copy_only=False) for x in (batch.column(0), batch.column(1), index.indices))
            rows.append((pack, k, row + at))
            made.append(own)
            n, at = n + len(pack), at + len(segments)
            if n >= GATHER:
                yield from sent(rows, made)
                rows, made, n, at = [], [], 0, 0
        if n:
            yield from sent(rows, made)

    at = packed.select("pack", F.posexplode("segments").alias("k", "segment"))
    return at.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "pack bigint, ks binary, aligned binary, groups binary, length bigint")


def spread(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches of values, which may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of stretches of these sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


NAMES = ("n_a", "n_b", "n_groups", "n_links")


@dataclass
class Pack:
    """A pack read again: its documents' segments by number, their alignments, and its distinct id pairs in order."""

    numbers: np.ndarray
    ends: np.ndarray
    found: Aligned

    def __post_init__(self):
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.head = dict(zip(HEAD, self.found.head.T, strict=True))
        self.size = self.head["n_pairs"]
        self.pairs, self.where = np.unique(self.found.pair, return_inverse=True)
        #: Documents that a segment does not spell.
        self.bad = spread(1 - self.head["good"][self.numbers], self.ends) > 0

    @staticmethod
    def read(numbers: bytes, ends: bytes, rows: list[dict]) -> Pack:
        parts = [Aligned.read(x["aligned"], pa.decompress(x["groups"], x["length"], codec="zstd", asbytes=True).decode().split("\n")) for x in rows]
        found = Aligned.joined([EMPTY, *parts])
        return Pack(large(numbers), large(ends), found.take(np.argsort(np.concatenate([large(x["ks"]) for x in rows] or [EMPTY.pair]))))

    def holding(self) -> np.ndarray:
        """In how many documents each pair is linked."""
        out = np.zeros(len(self.pairs), np.int64)
        first = np.cumsum(self.size) - self.size
        lengths = self.ends - self.starts
        good = np.flatnonzero(~self.bad & (lengths > 0))
        # Some documents at a time, as a table of documents and pairs of bounded size.
        step = max(1, MARKS // max(1, len(self.pairs)))
        for at in range(0, len(good), step):
            some = good[at : at + step]
            segment = self.numbers[stretches(self.starts[some], lengths[some])]
            row = np.repeat(np.repeat(np.arange(len(some)), lengths[some]), self.size[segment])
            marks = np.zeros((len(some), len(self.pairs)), bool)
            marks[row, self.where[stretches(first[segment], self.size[segment])]] = True
            out += marks.sum(axis=0)
        return out

    def sums(self, of_segment: np.ndarray) -> np.ndarray:
        return np.where(self.bad, 0, spread(of_segment[self.numbers], self.ends))

    def summed(self, of_pair: np.ndarray) -> np.ndarray:
        """By document, over all its links."""
        return self.sums(spread(of_pair[self.where] * self.found.times, np.cumsum(self.size)))

    def digests(self) -> list[str]:
        text = self.found.groups.__getitem__
        said = (";".join(map(text, self.numbers[a:b].tolist())) if b > a and not x else "" for a, b, x in zip(self.starts.tolist(), self.ends.tolist(), self.bad.tolist(), strict=True))
        return [sha256(t.encode()).hexdigest() if t else "" for t in said]


def read_packs(batch: pa.RecordBatch) -> Iterator[tuple[dict, Pack]]:
    for i in range(batch.num_rows):
        raw = {c: batch.column(c)[i] for c in batch.schema.names}
        yield raw, Pack.read(raw["numbers"].as_py(), raw["ends"].as_py(), raw["found"].as_py())


def held(whole: DataFrame) -> DataFrame:
    """x = (pair, pack, documents): in how many documents of a pack two ids are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, own in read_packs(batch):
                flat = np.stack([own.pairs, np.full(len(own.pairs), raw["pack"].as_py(), np.int64), own.holding()], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 3, dtype=np.int32), pa.array(flat))], names=["x"])

    return whole.mapInArrow(run, "x array<bigint>")


def scored(whole: DataFrame, counted: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """The documents of packs; counted has (pack, pair, count, best)."""
    found = counted.groupBy("pack").agg(F.collect_list(F.struct("pair", "count", "best")).alias("counted"))
    both = whole.join(found, "pack", "left").select("ids", "ends", "numbers", "found", "counted")
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in (*NAMES, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, own in read_packs(batch):
                counts = raw["counted"].values
                column = lambda c: counts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) if counts is not None else EMPTY.pair  # noqa: B023, E731
                order = np.argsort(column("pair"))
                sums = [*(own.sums(own.head[c]) for c in NAMES), *(own.summed(column(c)[order]) for c in ("best", "count"))]
                yield pa.RecordBatch.from_arrays([raw["ids"].values, *(pa.array(v, pa.int64()) for v in sums), pa.array(own.digests(), pa.string())], names=schema.names)

    return both.mapInArrow(run, schema).withColumnRenamed("id", key)


def together(packed: DataFrame, alignments: DataFrame) -> DataFrame:
    """(pack, ids, ends, numbers, found): packs with all their segments' alignments."""
    kept = ("ids", "ends", "numbers")
    rows = alignments.select("pack", F.struct("ks", "aligned", "groups", "length").alias("found")).unionByName(packed.select("pack", *kept), allowMissingColumns=True)
    return rows.groupBy("pack").agg(*(F.first(c, ignorenulls=True).alias(c) for c in kept), F.collect_list("found").alias("found"))


def link_counts(links: DataFrame, n_ids: int) -> DataFrame:
    """(pair, count, best): in how many documents two ids are linked; best is 1 if no partner of the A id has more."""
    counts = links.groupBy(F.col("x")[0].alias("pair")).agg(F.sum(F.col("x")[2]).alias("count"))
    # An A id has at most as many rows as B has ids.
    top = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / n_ids)))
    return counts.select("pair", "count", (F.col("count") == top).cast("bigint").alias("best"))


def align(documents: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", size: int = PACK) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    pair = lambda: Pair(a_path, b_path)
    n_ids = len(pair().b_bytes)
    packed, path = written(packs(documents, text, key, pair, size))
    whole = together(packed, aligned(packed, pair))
    # Both are read twice by the one plan that follows, which shuffles them once.
    # Without the filters the joins would bring their own, and a second shuffle.
    links = held(whole).filter(F.col("x")[0].isNotNull() & F.col("x")[1].isNotNull()).repartition(F.col("x")[0])
    counts = link_counts(links, n_ids)
    counted = links.join(counts, F.col("x")[0] == F.col("pair")).select(F.col("x")[1].alias("pack"), "pair", "count", "best")
    out = checkpoint(scored(whole, counted, key, documents.schema[key].dataType))
    remove(documents.sparkSession, path)
    return out
