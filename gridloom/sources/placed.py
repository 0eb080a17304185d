"""Values written by many tasks at their places in one file, as a Python data source of (at, v).

Rows are dealt by stretches of the file and sorted, so a task writes runs; it holds one batch. A task that runs twice, or
on another executor after the first was lost, writes the same bytes again. The rows must fill the given ranges, each
place once: no task sees a place of another's stretch, so ascending places and the number of all rows prove it.
The file must exist already, in a folder that driver and executors share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.grid import AXES, Shape
from .errors import WriterError

#: Bytes of the file in one stretch, as a power of two.
STRETCH = 23


@dataclass
class Written(WriterCommitMessage):
    rows: int


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, ranges: list[list[int]]):
        self.path, self.kind, self.ranges = path, np.dtype(kind), ranges

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        starts, ends = np.array(sorted(self.ranges), np.int64).T
        rows, last = 0, -1
        with open(self.path, "r+b") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if batch.column(0).null_count:
                    raise WriterError("values outside the extents")
                at = batch.column(0).to_numpy()
                steps = np.diff(at, prepend=last)
                if steps.min() <= 0:
                    raise WriterError("two values for one place")
                range_ = np.searchsorted(starts, at, "right") - 1
                if range_.min() < 0 or (at >= ends[range_]).any():
                    raise WriterError("values outside the extents")
                data = batch.column(1).to_numpy(zero_copy_only=False).astype(self.kind)
                cuts = [0, *(np.flatnonzero(steps[1:] != self.kind.itemsize) + 1), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    f.seek(at[a])
                    f.write(data[a:b].tobytes())
                rows, last = rows + len(at), at[-1]
            f.flush()
            os.fsync(f.fileno())
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        rows, places = sum(m.rows for m in messages if m), sum(b - a for a, b in self.ranges) // self.kind.itemsize
        if rows != places:
            raise WriterError(f"{rows} values do not fill {places} places")

    def abort(self, messages: list[Written | None]) -> None:
        """Whoever made the file takes it away."""


class PlacedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_values"

    def schema(self) -> str:
        return "at bigint, v double"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"], self.options["kind"], json.loads(self.options["ranges"]))


def position(shape: Shape) -> Column:
    """Number of a pixel, x fastest; null outside the extents."""
    inside = [(F.col(a) >= 0) & (F.col(a) < e) for a, e in zip(AXES, shape.extents, strict=True)]
    return F.when(inside[0] & inside[1] & inside[2], F.col("x") + shape.nx * (F.col("y") + F.col("z").cast("bigint") * shape.ny))


def write_placed(rows: DataFrame, path: str, kind: str, ranges: list[tuple[int, int]]) -> None:
    """Write (at, v) as numbers of a kind; ``ranges`` of bytes [from, to) must be filled."""
    rows.sparkSession.dataSource.register(PlacedSink)
    dealt = rows.select(F.col("at").cast("bigint").alias("at"), F.col("v").cast("double").alias("v"))
    dealt = dealt.repartition(F.shiftright("at", STRETCH)).sortWithinPartitions("at")
    try:
        dealt.write.format("placed_values").mode("append").option("kind", kind).option("ranges", json.dumps(ranges)).save(os.path.abspath(path))
    except PySparkException as e:
        raise WriterError(f"{path} could not be written: {e}") from e
