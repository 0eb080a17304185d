"""Language prediction against a parse by plain string search."""

import math
import random

import pytest

from gridloom.llm import langid as L


def text_of(draw, letters, words):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(words))


def slow_phrases(text: bytes, learned: list[bytes]) -> int:
    """Longest prefixes found anywhere in the learned texts, one after another; by segments."""
    n = 0
    for at in range(0, len(text), L.SEGMENT):
        rest = text[at : at + L.SEGMENT]
        while rest:
            size = 1
            while size < len(rest) and any(rest[: size + 1] in t for t in learned):
                size += 1
            rest, n = rest[size:], n + 1
    return n


@pytest.mark.parametrize("segment", [1024, 40])
def test_prediction_by_brute_force(monkeypatch, segment):
    monkeypatch.setattr(L, "SEGMENT", segment)
    draw = random.Random(1)
    sample = {"x": [text_of(draw, "abcdé", 40) for _ in range(4)], "y": [text_of(draw, "bcdeñ", 40) for _ in range(4)], "z": [text_of(draw, "acdñ日本", 40) for _ in range(4)]}
    parser = L.CrossParser(L.fit(sample))
    learned = [[L.normal(t) for t in sample[lang]] for lang in parser.languages]
    for _ in range(12):
        texts = [text_of(draw, draw.choice(["abcdeéñ", "日本abñ", "xyz-1"]), draw.randint(1, 90)) for _ in range(draw.randint(1, 9))]
        found = parser.predict(texts)
        for t, (lang, score) in zip(texts, found, strict=True):
            counts = [slow_phrases(L.normal(t), own) for own in learned]
            assert lang == parser.languages[counts.index(min(counts))]
            assert score == pytest.approx(1 / sum(math.exp(-L.SHARP * (c - min(counts)) / len(L.normal(t))) for c in counts))


def test_phrases_cross_words():
    parser = L.CrossParser(L.fit({"x": ["the cat sat on the mat"], "y": ["the mat the cat on sat"]}))
    assert parser.phrases([b"the cat sat on the mat", b"on the"]).tolist() == [[1, 4], [1, 2]]


def test_no_letter_is_no_language():
    parser = L.CrossParser(L.fit({"x": ["some words"]}))
    assert [p[0] for p in parser.predict(["½", "²", "Ⅷ", "12 !?", "", None, "½ x", "ª", "日"])] == ["und"] * 6 + ["x"] * 3


def test_wide_alphabets_learn_less(monkeypatch):
    draw = random.Random(2)
    sample = {f"l{k}": [text_of(draw, [chr(0x400 + 16 * k + i) for i in range(16)], 200)] for k in range(12)}
    monkeypatch.setattr(L, "TABLE_CELLS", 1 << 18)
    parser = L.CrossParser(L.fit(sample))
    assert len(parser.table) <= 1 << 18
    assert all(parser.predict([t[0]])[0][0] == lang for lang, t in sample.items())


def test_sample_is_bounded(spark, monkeypatch):
    """One key of many rows, repeated rows, long texts and languages past the bound."""
    rows = [(7, f"word{chr(97 + k % 26)} {'x' * (k // 26)} text", "en") for k in range(500)] + [(8, "le même", "fr")] * 300 + [(9, "sehr lang " * 9000, "de"), (11, "½", "nn"), (12, None, "nn")]
    rows += [(100 + k, "un seul", f"q{k:02}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(L, "MAX_LANGUAGES", 5)
    found = L.sample_texts(docs, mod=5, held=99)
    assert set(found) >= {"en", "fr", "de"} or len(found) == 5
    assert len(found) == 5 and len(found["en"]) == L.SAMPLE_ROWS and found["fr"] == ["le même"] and "nn" not in found
    assert all(len(t) <= L.SAMPLE_CHARS for own in found.values() for t in own)
