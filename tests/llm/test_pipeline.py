"""The corpus pipeline on planted cases and on the smallest tables."""

import pytest

import corpus_pipeline as P
from gridloom.llm import queries

from .test_operators import words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a toxic text, copies, a near copy, a leak, texts without words, and odd rows."""
    top = tmp_path_factory.mktemp("tables")
    base = [(i, " ".join(words_of(i, 80, 5000)), "en") for i in range(60)]
    toxic = [(100 + i, " ".join([*words_of(300 + i, 30, 5000), "grubber", *words_of(400 + i, 9, 5000), "grubber"]), "en") for i in range(20)]
    near = base[3][1].split()
    near[40] = "changed"
    planted = [(200, base[1][1], "en"), (201, " ".join(near), "en"), (202, "start " + " ".join(words_of(900, 12, 5000)) + " end", "en"), (203, "12 34", "en"), (204, None, None), (205, "", "en"), (None, " ".join(words_of(901, 50, 5000)), "en"), (206, " ".join(words_of(902, 50, 5000)), None)]
    again = [base[5]]
    rows = [(i, t, lang, "s", len(t or ""), "clash", 1.5) for i, t, lang in base + toxic + planted + again]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string, score double").write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in base] + [(i, 1, 1) for i, *_ in toxic]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words_of(900, 12, 5000))), (2, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_planted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        seen.append(sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None))
    base = list(range(60))
    assert seen[0] == sorted([*base, 5, *range(200, 207)])
    assert seen[1] == sorted([*base, 5, 200, 201, 202, 206])
    assert seen[2] == sorted([*base, 202, 206])
    assert seen[3] == sorted([*base, 206])
    assert kept.filter("doc_id is null").count() == 1
    assert kept.filter("predicted = 'clash' and score = 1.5").count() == kept.count()
    assert P.run(spark, folder).count() == 62


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_equals_stages_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in P.run(spark, folder).collect()}
    every = {r.doc_id: tuple(r)[1:] for r in queries.op1_bpe(spark, folder).collect()}
    assert found and all(every[i] == v for i, v in found.items())
    toxic = {r.doc_id for r in queries.op5_toxicity(spark, folder).filter("predicted = 1").collect()}
    leaks = {r.doc_id for r in queries.op9_decontam(spark, folder).filter("contaminated").collect()}
    assert not found.keys() & (toxic | leaks)


def test_near_duplicates_by_fingerprints(spark):
    """What operator 7 links is one group, sets of few common shingles too; the least hashes add pairs that its three bits part."""
    from gridloom.llm import nearcopies, simhash

    line = " ".join(words_of(1, 11, 10**7))
    texts = [" ".join([*words_of(k, 60, 10**7), *[line] * 400]) for k in (2, 3)]
    words = words_of(4, 160, 10**7)
    texts += [" ".join(words), " ".join("changed" if k in (40, 80, 120) else w for k, w in enumerate(words)), " ".join(words_of(5, 80, 10**7))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seventh = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=3, lanes=1, distance=3).collect()}
    assert seventh == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
    assert sorted(r.doc_id for r in P.STAGES[2][1](spark, docs, "").collect()) == [0, 2, 4]


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "tokens"] and P.ORACLE_SQL is None
