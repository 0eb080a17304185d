"""Decontamination in passes: the same rows, one automaton at a time."""

import numpy as np
import pytest

from gridloom.llm import decontam as D

from .test_operators import slow_contamination, words_of


@pytest.mark.parametrize("piece", [4096, 15])
def test_passes_give_the_same_rows(spark, monkeypatch, piece):
    """A giant item cut into pieces over several passes, hit texts repeated, joined by broadcast and by shuffle."""
    items = [(k, " ".join(words_of(k, 40, 500))) for k in range(30)] + [(99, " ".join(words_of(99, 2000, 500)))]
    texts = [" ".join([*words_of(1000 + k, 20, 500), *items[k % 31][1].split()[k : k + 25], *words_of(2000 + k, 9, 500)]) for k in range(40)] + [items[30][1], None, ""]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit int, spans string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "MAX_PATTERN_BYTES", 60_000)
    assert one == sorted(map(tuple, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert one == sorted(map(tuple, D.contamination(docs, bench).collect()))
    assert len(one) == len(rows) and all(r[1:6] == slow_contamination(texts[r[0]], items) for r in one)
    monkeypatch.setattr(D, "HOT_SHARE", 1e-9)
    monkeypatch.setattr(D, "FILTER_BITS", (9, 9))
    assert one == sorted(map(tuple, D.contamination(docs, bench).collect()))
    assert D.contamination(docs.limit(0), bench).count() == 0 and {r.n_hit for r in D.contamination(docs.filter("text = ''"), bench).collect()} == {0}


def test_short_items_nulls_and_names(spark, monkeypatch):
    """Items of fewer words than a window, of no words, without an id, twice; kept columns with names of results."""
    items = [(k, " ".join(words_of(k, 1 + k % 14, 500))) for k in range(60)] + [(None, "p q r s"), (7, None), (8, ""), (3, " ".join(words_of(3, 4, 500)))]
    texts = [" ".join([*words_of(900 + k, 12, 500), *(items[k % 61][1] or "").split(), *words_of(800 + k, 5, 500)]) for k in range(80)] + ["p q r s", None, "", "\u00e9 p Q, r s", "..."]
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, n_words int, spans string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    keep = ("doc_id", "n_words", "spans")
    one = D.contamination(docs, bench, keep=keep)
    assert one.columns == ["doc_id", *D.FIELDS]
    rows = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(D, "MAX_PATTERN_BYTES", 1_000)
    assert rows == sorted(map(tuple, D.contamination(docs, bench, keep=keep).collect()))
    assert [r[5] for r in rows[-5:]] == [True, False, False, True, False] and rows[80][3] == 0


def test_texts_are_read_twice_at_any_size(spark, monkeypatch, tmp_path):
    """Many parts: scans of the documents don't grow with them, and only suspected texts meet an automaton."""
    items = [(k, " ".join(words_of(k, 60, 5000))) for k in range(60)]
    texts = [" ".join(words_of(5000 + k, 80, 5000)) for k in range(400)] + [items[5][1]] * 3
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.read.parquet(f"{tmp_path}/d").mapInArrow(counted, "doc_id bigint, text string")
    monkeypatch.setattr(D, "MAX_PATTERN_BYTES", 20_000)
    out = D.contamination(docs, bench).collect()
    assert sorted(r.doc_id for r in out if r.contaminated) == [400, 401, 402] and read.value == 2 * len(texts)
    marks = np.zeros(1 << 13, np.uint8)
    hashes = D.window_hashes(D.normal_words(items[0][1]), [10])
    rows = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash bigint")
    for where in D.filter_places(hashes, 16):
        for w in where.tolist():
            marks[w >> 3] |= 128 >> (w & 7)
    assert (D.window_filter(rows, 16) == marks).all()


def test_memory_of_an_automaton_is_bounded():
    """Bytes a pass may hold, measured: the largest automaton of windows takes under 300 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from gridloom.llm import decontam as D
draw = random.Random(1)
words, size = [], D.MAX_PATTERN_BYTES // 10
while sum(map(len, words)) + len(words) < size:
    words.append("".join(draw.choice("abcdefghij") for _ in range(6)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
D.Scanner([(1, " ".join(words))], 10)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert used < 300
    # A benchmark of 200 MB takes so many passes, each of which has one such automaton at a time.
    assert -(-200_000_000 * 10 // D.MAX_PATTERN_BYTES) < 1000
