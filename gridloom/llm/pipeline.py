"""A corpus pipeline of five operators: toxicity, language, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' own columns,
whatever their names. What stages fit, they fit on docs and the tables in sf_dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, nearcopies, queries, toxicity
from .common import remove, shared_folder, table

#: Near duplicates: texts that operator 7 links, by SimHash of three-word shingles within three bits, and texts whose sets of
#: five-word shingles have at least this Jaccard similarity.
PRINTS, WIDTH, SIMILARITY = (3, 3), 5, 0.8


def _with_row(docs: DataFrame) -> DataFrame:
    """text, and the whole row as one column: no name of a result can clash with docs' own."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar predicts to be toxic go. Null and empty texts stay; repeated rows fare alike."""
    grammar = queries.toxicity_grammar(spark, docs, sf_dir)
    return toxicity.toxicity(_with_row(docs), grammar, keep=("row",)).filter("predicted = 0").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null texts and texts without a letter. Repeated rows fare alike.

    Where no row has a language to learn from, nothing can be told and all rows stay.
    """
    sample = langid.sample_texts(docs)
    if not sample:
        return docs
    return langid.identify(_with_row(docs), sample, keep=("row",)).filter("lang_pred <> 'und'").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the smallest id, nulls last. Repeated rows leave one row."""
    return nearcopies.drop_near_copies(docs, WIDTH, SIMILARITY, prints=PRINTS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go. Null and empty texts stay; repeated rows fare alike."""
    found = decontam.contamination(_with_row(docs), table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number of tokens and digests of ids and decoded text. Null texts are empty; repeated rows stay repeated."""
    return bpe.bpe_digest(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("tokens", tokens),
]

#: Learned scores, suffix automata, fingerprints and merges cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between stages the rows are written to the shared folder and read again.

    A stage's table is removed once the next one is written. The last one stays, since the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                remove(spark, before)
            before = f"{folder}/{name}"
    return docs
