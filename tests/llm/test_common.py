"""Training samples of dirty tables."""

from gridloom.llm import common as C


def test_samples_are_bounded(spark, monkeypatch):
    """An id of many rows, ids that are strings, long texts, null texts and labels."""
    rows = [("7", f"text number {k}") for k in range(500)] + [(f"x{k}", f"other {k}") for k in range(80)] + [("x1", "other 1")] * 50 + [("long", "w " * 900), ("none", None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([("7", 1), ("long", 1), ("none", 1), (None, 1), ("x0", None)] + [(f"x{k}", k % 2) for k in range(1, 80)], "doc_id string, toxic int")
    found = C.labelled_texts(docs, labels, "toxic", 5, 99, 100, 1000)
    assert len(found) == 100 and len(set(found)) == 100
    assert all(len(t) <= 1000 for t, _ in found) and not any(t == "other 0" for t, _ in found)
    monkeypatch.setattr(C, "SAMPLE_CHARS", 200)
    few = C.labelled_texts(docs, labels, "toxic", 5, 99, 100, 1000)
    assert few and sum(len(t) for t, _ in few) <= 200 and set(few) <= set(found)
    assert C.labelled_texts(docs, labels.limit(0), "toxic", 5, 99, 100, 1000) == []
