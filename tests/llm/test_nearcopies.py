"""Near copies by exact Jaccard similarity, against brute force."""

import numpy as np

from gridloom.llm import nearcopies as N

from .test_operators import words_of


def altered(words: list[str], similarity: float, width: int = 5) -> list[str]:
    """A copy whose last words are others, so that the shingle sets have about this similarity."""
    n = len(words) - width + 1
    gone = round(n * (1 - similarity) / (1 + similarity))
    return words[: len(words) - gone] + [f"other{k}" for k in range(gone)]


def groups(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}


def test_every_pair_at_the_threshold(spark):
    """Pairs just over 0.8 that no third text joins are all linked."""
    texts = []
    for k in range(400):
        words = words_of(k, 204, 10**7)
        texts += [" ".join(words), " ".join(altered(words, 0.805))]
    assert all(0.8 <= jaccard(texts[2 * k], texts[2 * k + 1]) < 0.82 for k in range(400))
    found = groups(spark, texts)
    assert sum(found[2 * k + 1] == 2 * k for k in range(400)) == 400


def jaccard(a, b):
    x, y = (set(N.shingles(t, 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_no_pair_below_the_threshold(spark):
    texts = []
    for k in range(200):
        words = words_of(k, 204, 10**7)
        texts += [" ".join(words), " ".join(altered(words, 0.78))]
    assert all(0.77 <= jaccard(texts[2 * k], texts[2 * k + 1]) < 0.8 for k in range(200))
    assert all(i == c for i, c in groups(spark, texts).items())


def test_repeated_shingles_count_once(spark):
    line = " ".join(words_of(1, 12, 10**7))
    texts = [" ".join([*words_of(k, 150, 10**7), *[line] * 300]) for k in (2, 3)]
    own = " ".join(words_of(4, 200, 10**7))
    texts += [own, " ".join([own, *[" ".join(own.split()[:12])] * 300])]
    assert groups(spark, texts) == {0: 0, 1: 1, 2: 2, 3: 2}


def test_groups_equal_brute_force(spark, monkeypatch):
    """Chains, groups and near misses, in whole blocks and in tiles."""
    texts = [None, "", "one two", "one two", "Two one"]
    for k in range(12):
        words = words_of(1000 + k, 104, 10**7)
        for m in range(12):
            texts.append(" ".join([*words[m * (k % 4) :], *(f"x{m}y{n}" for n in range(k))]))
    sets = [N.shingle_set(t, 5) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        before = list(least)
        for i, a in enumerate(sets):
            for j in range(i):
                if (not len(a) and not len(sets[j])) or (len(a) and len(sets[j]) and len(np.intersect1d(a, sets[j])) >= 0.8 * len(np.union1d(a, sets[j])) - 1e-9):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert groups(spark, texts) == dict(enumerate(least))
    monkeypatch.setattr(N, "TILE", 4)
    assert groups(spark, texts) == dict(enumerate(least))


def test_one_row_of_a_group_stays(spark):
    """Ids that clash, ids that are null, and repeated rows: each text keeps one row and no other text goes with it."""
    text = lambda k: " ".join(words_of(k, 60, 10**7))
    rows = [(7, text(1)), (7, text(2)), (8, text(3)), (9, text(3)), (8, text(4)), (8, text(4)), (None, text(5)), (None, text(5)), (None, text(1)), (10, None), (11, ""), (12, text(6))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, mark string").repartition(3)
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text)
    assert found == sorted([("7", text(1)), ("7", text(2)), ("8", text(3)), ("8", text(4)), ("None", text(5)), ("12", text(6))])
    assert [r.doc_id for r in kept.collect() if not r.text] == [10]
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def test_marks_tell_moved_values_apart(spark):
    from gridloom.llm.common import row_marks

    rows = [("a", None), (None, "a"), ("a", "a"), (None, None), ("", None)]
    one, two = row_marks(spark.createDataFrame(rows, "a string, b string"))
    assert spark.createDataFrame(rows, "a string, b string").select(one.alias("x"), two.alias("y")).distinct().count() == 5
