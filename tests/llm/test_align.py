"""Alignments by segments against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from gridloom.llm import align as A
from gridloom.llm import queries

SPECIAL = "￾"


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def encoded(paths, texts):
    """(A's ids and bytes, B's ids and bytes) of whole texts, by the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte = {chr(c): c for c in visible} | {chr(256 + n): c for n, c in enumerate(sorted(set(range(256)) - visible))}
    of_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    for t in texts:
        own = a.encode(" " + t, add_special_tokens=False)
        ids = b.encode(t)
        yield own.ids, [bytes(byte[c] for c in x) for x in own.tokens], ids, [of_b(b.id_to_piece(i)) for i in ids]


def plainly(paths, texts):
    """The contract, read literally: all pairs of tokens of a group."""
    docs = []
    for t, (a, a_bytes, b, b_bytes) in zip(texts, encoded(paths, [t or "" for t in texts]), strict=True):
        raw = (" " + t).encode() if t else b""
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            docs.append(None)
            continue
        ends = lambda xs: {sum(map(len, xs[: i + 1])): i + 1 for i in range(len(xs))}
        ea, eb = ends(a_bytes), ends(b_bytes)
        cuts = [(0, 0), *((ea[e], eb[e]) for e in sorted(ea.keys() & eb.keys()))]
        docs.append((len(a), len(b), [(a[i:k], b[j:m]) for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False)]))
    count = Counter(p for d in docs if d for p in {(x, y) for g in d[2] for x in g[0] for y in g[1]})
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in d[2] for x in g[0] for y in g[1]]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "\n", "  ", "a", " a", "a b", "a  b ", "a\n\nb\n", "x;\r\n y);\r\n", "a\tb\x0bc\x0c d e　f g\x85h\x1ci​j﻿k", "<|endoftext|> <s> </s> <unk> <0x41>", "one▁two", "▁", "\x00 \x00",
    "naïve café 日本語 テスト 😀😀 \U0001f468‍\U0001f469", "x" * 5000, "don't we'll  it's  \t 12345 67,890.12", "ab" * 3000 + " " + "ab" * 3000, "word " * 2000, "same words", "same words", "a   b  c", "}\r}\r\r {\r",
]


def run(spark, paths, texts, **more):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, segment string, pack int").repartition(3)
    return sorted(tuple(r) for r in A.align(df, *paths, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_whole_query_against_libraries(spark, paths):
    draw = random.Random(3)
    letters = ["a", "e", "the", "ing", ".", ",", " ", "  ", "\n", "\r", "\t", "é", "日", "'s", "1", ";", "}", " (", " ", " ", "ﬁ", "\x1f", "😀"]
    texts = [*ODD, *("".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(400))]
    packed = A.packs(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("doc_id", A.F.lit(1)), "text", "doc_id", lambda: A.Pair(*paths), 700)
    assert packed.count() > 8
    assert run(spark, paths, texts, size=700) == [(i, *x) for i, x in enumerate(plainly(paths, texts))]


def test_segments_join_to_the_text(paths):
    pair = A.Pair(*paths)
    assert (";", "\r") in pair.borders and not any(b == " " for _, b in pair.borders)
    for t in (t for t in ODD if t):
        assert "".join(pair.segments(t)) == " " + t
    assert pair.segments("a;\r b") == [" a;\r b"] or pair.segments("a;\r b")[0].startswith(" a;\r")


def test_vocabularies_of_another_kind_are_refused(paths):
    with pytest.raises(ValueError, match="byte-level"):
        A.Pair(queries.tokenizer_path("word_bpe_49k.json"), paths[1])


def test_odd_rows(spark, paths):
    schema = "doc_id bigint, text string, lang string"
    df = spark.createDataFrame([(None, "same text", None), (None, "same text", None), (3, None, "x")], schema)
    found = sorted(map(repr, A.align(df, *paths).collect()))
    assert len(found) == 3 and found[1] == found[2] if found[0].startswith("Row(doc_id=3") else found[0] == found[1]
    assert A.align(df.limit(0), *paths).count() == 0
    assert A.align(df.filter("doc_id = 3"), *paths).first()[1:] == (0, 0, 0, 0, 0, 0, "")


def test_each_segment_is_aligned_once_and_joined(spark, paths):
    df = spark.createDataFrame([(i, "the same few words") for i in range(50)], "doc_id bigint, text string").repartition(5)
    pair = lambda: A.Pair(*paths)
    packed = A.packs(df, "text", "doc_id", pair, A.PACK)
    assert packed.select(A.F.explode("segments")).count() <= 20
    made = A.aligned(packed, pair).collect()
    assert sum(len(A.large(r.ks)) for r in made) == packed.select(A.F.explode("segments")).count()


def test_segments_joined_and_alone_are_aligned_alike(paths):
    pair = A.Pair(*paths)
    draw = random.Random(8)
    segments = sorted({draw.choice([" ", "  ", "\n", "\n\n", "\t", " \r"]) + "".join(draw.choice(["a", "the", "é", "日", ".", "'s", "12", "\u2581", "x" * 30]) for _ in range(draw.randint(1, 9))) for _ in range(500)} | {" ", "\n ", " " + "ab" * 8000})
    found, one = pair.align(segments), A.Aligned.of([pair.align_one(s) for s in segments])
    again = A.Aligned.read(found.numbers(), found.groups)
    for c in ("head", "pair", "times"):
        assert getattr(found, c).tolist() == getattr(one, c).tolist() == getattr(again, c).tolist()
    assert found.groups == one.groups and one.head[:, 0].min() == 0 and one.times.max() > 1000


def test_keys_are_segments(paths):
    pair = A.Pair(*paths)
    draw = random.Random(9)
    for t in [*filter(None, ODD), *("".join(draw.choice(["a", "b ", " ", "\n", "c\n", "d", "\xa0", "\r"]) for _ in range(draw.randint(1, 12))) for _ in range(3000))]:
        assert [k if A.IS_SPACE.match(k) else f" {k}" for k in pair.keys(t)] == pair.segments(t), repr(t)


def test_integers_come_back():
    for v in ([], [0], [5, -3, 1 << 40, -(1 << 62)]):
        assert A.large(A.small(A.np.array(v, "i8"))).tolist() == v
