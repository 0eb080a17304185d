"""Helpers shared by the operators: sessions, Arrow maps over texts, checkpoints and bounded training samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, shared_folder

#: Rows of text handed to Python at once; texts of a few kB make batches of a few MB.
BATCH_ROWS = 1024

#: Spark type -> Arrow type and Spark's own object.
TYPES = {
    "string": (pa.string(), T.StringType()),
    "bigint": (pa.int64(), T.LongType()),
    "int": (pa.int32(), T.IntegerType()),
    "double": (pa.float64(), T.DoubleType()),
    "binary": (pa.binary(), T.BinaryType()),
    "array<bigint>": (pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    "array<double>": (pa.list_(pa.float64()), T.ArrayType(T.DoubleType())),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], fields: dict[str, str], keep: list[str]) -> DataFrame:
    """Apply a Python function to one column, batch by batch, beside columns that pass through.

    ``make()`` runs once in each task and returns a function from the list of values (null: None)
    to one list per entry of ``fields`` (name -> Spark type). Columns named in ``keep`` are copied;
    other columns are not read. A kept column with the name of a result is left out.
    Null values reach the function, so each operator says what they mean.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    keep = [c for c in keep if c not in fields]
    types = [TYPES[t][0] for t in fields.values()]
    names = [*(f"k{i}" for i in range(len(keep))), *fields]
    n = len(keep)
    at = keep.index(column) if column in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            made = apply(batch.column(at).to_pylist())
            arrays = [*batch.columns[:n], *(pa.array(v, t) for v, t in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    value = [] if at < n else [F.col(f"`{column}`").alias("value")]
    narrow = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *value)
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)])
    for name, kind in fields.items():
        schema = schema.add(name, TYPES[kind][1])
    out = narrow.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *fields)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with over this share of the rows is hot; fewer than its inverse can be.
HOT_SHARE = 1 / 1024


def join_hot(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """rows with the columns of answers (key, n, ...), which has every key once and the number of its rows.

    The at most 1,024 keys of many rows are broadcast, the others joined by shuffle: no task gets all rows of a hot key.
    """
    total = answers.agg(F.sum("n")).first()[0] or 0
    hot = answers.filter(F.col("n") > F.lit(max(1, math.ceil(total * HOT_SHARE)))).drop("n")
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(answers.drop("n"), key)
    return few.unionByName(rest)


def row_marks(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns, nulls told apart from values that move between columns."""
    values = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    gaps = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns))
    return [F.xxhash64(F.lit(k), gaps, *values) for k in (1, 2)]


def crc_mod(column, mod: int):
    """crc32 of an id written as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(mod)


#: Characters of all texts of a training sample.
SAMPLE_CHARS = 48 << 20


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled training texts of at most ``SAMPLE_CHARS`` characters together on the driver, each once.

    Rows whose crc32(doc_id as text) mod ``mod`` equals ``held`` are held out. Ids are chosen by a hash, whatever their type,
    and of their texts the first by another hash, however many rows an id has. Texts over ``max_chars`` are not trained on.
    """
    known = labels.filter(crc_mod("doc_id", mod) != held).filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_rows)
    texts = documents.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(few), "doc_id").select("text", "y").distinct()
    out, total = [], 0
    for r in texts.orderBy(F.xxhash64("text"), "text", "y").limit(max_rows).toLocalIterator():
        total += len(r.text)
        if total > SAMPLE_CHARS:
            break
        out.append((r.text, r.y))
    return sorted(out)
