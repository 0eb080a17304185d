"""Raw volumes as a Python data source: ``.image`` (int32 nx, ny, nz, channels = 1; float32) and ``.mask`` (int32 nx, ny, nz; int16).

``spark.read.format("raw_volume").option("kind", "image").load(path)`` gives (x, y, z, v). Each partition reads a
range of planes with a seek, and only those that filters on z and y leave; headers and sizes are checked on the driver only.

``kind`` hdf5 with an option ``dataset`` reads a dataset of two or three axes, slowest first, of an HDF5 file alike: a
contiguous one by lines, a chunked one by chunks, of which a partition gets as many as hold its number of values.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.grid import Shape
from . import hdf5
from .errors import LoaderError
from .placed import position, write_placed

SCHEMA = "x int, y int, z int, v double"
KINDS = {"image": (4, np.dtype("<f4")), "mask": (3, np.dtype("<i2"))}
#: Values that one partition reads, about.
PARTITION_VALUES = 4 << 20


def header(path: str, kind: str) -> tuple[int, int, int]:
    """Extents, after the size of the file has been checked against them."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    ints, dtype = KINDS[kind]
    with open(path, "rb") as f:
        raw = f.read(4 * ints)
    if len(raw) < 4 * ints:
        raise LoaderError(f"{path} is too short for a {kind}")
    numbers = struct.unpack(f"<{ints}i", raw)
    n = numbers[0] * numbers[1] * numbers[2]
    if min(numbers) < 1 or (ints == 4 and numbers[3] != 1) or os.path.getsize(path) != 4 * ints + dtype.itemsize * n:
        raise LoaderError(f"{path} is no {kind} of one channel")
    return numbers[:3]


@dataclass
class Slab(InputPartition):
    """Rows [first, last) of x, counted over y and z."""

    first: int
    last: int


def pixels(x: np.ndarray, y: np.ndarray, z: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in (x, y, z)), pa.array(v.astype(np.float64))], names=["x", "y", "z", "v"])


class VolumeReader(DataSourceReader):
    """Reads runs of lines along x, of numbers that lie from a place in the file on; bounds on z and y that Spark pushes down choose the lines."""

    def __init__(self, path: str, extents: tuple[int, int, int], place: int, dtype: np.dtype, values: int):
        self.path, self.extents, self.place, self.dtype, self.values = path, extents, place, dtype, values
        self.y, self.z = (0, self.extents[1] - 1), (0, self.extents[2] - 1)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in ("y", "z"):
                low, high = getattr(self, f.attribute[0])
                # Extents are of whole numbers; a bound of another kind narrows nothing.
                value = getattr(f, "value", None)
                if isinstance(f, In) and f.value and all(type(v) is int for v in f.value):
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                elif type(value) is int:
                    low = max(low, value + isinstance(f, GreaterThan)) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else low
                    high = min(high, value - isinstance(f, LessThan)) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else high
                setattr(self, f.attribute[0], (low, high))
            # Spark applies each filter again: lines within a run may still be outside.
            yield f

    def partitions(self):
        nx, ny, _ = self.extents
        if self.y[0] > self.y[1] or self.z[0] > self.z[1]:
            return [Slab(0, 0)]
        lines = max(1, self.values // nx)
        first, last = self.z[0] * ny + self.y[0], self.z[1] * ny + self.y[1] + 1
        return [Slab(a, min(a + lines, last)) for a in range(first, last, lines)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.extents
        with open(self.path, "rb") as f:
            for z in range(partition.first // ny, -(-partition.last // ny)):
                begin, end = max(partition.first, z * ny + self.y[0]), min(partition.last, z * ny + self.y[1] + 1)
                f.seek(self.place + begin * nx * self.dtype.itemsize)
                for line in range(begin, end, max(1, (1 << 16) // nx)):
                    lines = min(max(1, (1 << 16) // nx), end - line)
                    v = np.frombuffer(f.read(lines * nx * self.dtype.itemsize), self.dtype)
                    pos = np.arange(line * nx, (line + lines) * nx, dtype=np.int64)
                    yield pixels(pos % nx, pos // nx % ny, pos // (nx * ny), v)


@dataclass
class Chunks(InputPartition):
    """(least corner z, y, x, place, stored bytes, mask) of chunks; without a place, of what the file does not hold."""

    parts: list[tuple[int, int, int, int | None, int, int]]


class ChunkReader(VolumeReader):
    """Reads chunks; those outside the bounds on z and y that Spark pushes down are left out."""

    def __init__(self, path: str, extents: tuple[int, int, int], dataset: hdf5.Dataset, values: int):
        super().__init__(path, extents, 0, dataset.kind, values)
        self.dataset = dataset
        self.chunk = (1,) * (3 - len(dataset.chunk)) + tuple(dataset.chunk)

    def partitions(self):
        nx, ny, nz = self.extents
        cz, cy, cx = self.chunk
        held: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        if self.dataset.tree is not None:
            with hdf5.opened(self.path) as file:
                held = {(0,) * (3 - len(corner)) + corner: rest for corner, *rest in file.chunks(self.dataset)}
        parts = []
        for z in range(self.z[0] // cz * cz, min(nz, self.z[1] + 1), cz):
            for y in range(self.y[0] // cy * cy, min(ny, self.y[1] + 1), cy):
                parts += [(z, y, x, *held.get((z, y, x), (None, 0, 0))) for x in range(0, nx, cx)]
        some = max(1, self.values // (cz * cy * cx))
        return [Chunks(parts[k : k + some]) for k in range(0, len(parts), some)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        nx, ny, nz = self.extents
        with open(self.path, "rb") as f:
            for z, y, x, place, size, mask in partition.parts:
                shape = tuple(min(c, e - a) for c, e, a in zip(self.chunk, (nz, ny, nx), (z, y, x), strict=True))
                whole = None
                if place is not None:
                    f.seek(place)
                    whole = self.dataset.values(f.read(size), mask).reshape(self.chunk)[: shape[0], : shape[1], : shape[2]].reshape(-1)
                n = shape[0] * shape[1] * shape[2]
                for at in range(0, n, 1 << 16):
                    pos = np.arange(at, min(n, at + (1 << 16)), dtype=np.int64)
                    v = np.full(len(pos), self.dataset.fill) if whole is None else whole[pos]
                    yield pixels(x + pos % shape[2], y + pos // shape[2] % shape[1], z + pos // (shape[2] * shape[1]), v)


#: Extents of chunks that stand for a dataset of which nothing was written.
NOTHING = (16, 64, 1024)


def reader(path: str, kind: str, dataset: str, values: int) -> VolumeReader:
    if kind != "hdf5":
        return VolumeReader(path, header(path, kind), 4 * KINDS[kind][0], KINDS[kind][1], values)
    with hdf5.opened(path) as file:
        found = file.find(dataset)
    if len(found.shape) not in (2, 3) or not min(found.shape):
        raise LoaderError(f"{dataset} of {path} has not two or three axes")
    extents = (*reversed(found.shape), 1)[:3]
    if found.place is not None and found.place != hdf5.NOWHERE:
        return VolumeReader(path, extents, found.place, found.kind, values)
    if found.place is not None:
        found.chunk = NOTHING[-len(found.shape) :]
    return ChunkReader(path, extents, found, values)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return reader(self.options["path"], self.options.get("kind", "image"), self.options.get("dataset", ""), int(self.options.get("partition_values", PARTITION_VALUES)))


def read_volume(spark: SparkSession, path: str, kind: str = "image", partition_values: int | None = None, dataset: str = "") -> DataFrame:
    """(x, y, z, v) of a raw volume or a dataset, in partitions of some values; filters on z and y choose what is read.

    Sets the session's ``spark.sql.python.filterPushdown.enabled``, without which Spark pushes no filter to a Python source.
    """
    reader(path, kind, dataset, 1)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    return spark.read.format("raw_volume").option("kind", kind).option("dataset", dataset).option("partition_values", partition_values or PARTITION_VALUES).load(os.path.abspath(path))


def write_volume(path: str, values: np.ndarray, kind: str = "image") -> None:
    """values[z, y, x]; for one image that fits the driver."""
    nz, ny, nx = values.shape
    with open(path, "wb") as f:
        f.write(struct.pack("<4i", nx, ny, nz, 1) if kind == "image" else struct.pack("<3i", nx, ny, nz))
        f.write(values.astype(KINDS[kind][1]).tobytes())


def save_volume(image: DataFrame, shape: Shape, path: str, kind: str = "image") -> None:
    """(x, y, z, v) as a raw volume, written by tasks at their places into a file that takes the path once it is whole."""
    ints, dtype = KINDS[kind]
    work, start = f"{path}.{uuid.uuid4().hex}.part", 4 * ints
    try:
        with open(work, "wb") as f:
            f.write(struct.pack(f"<{ints}i", *shape.extents, *[1] * (ints - 3)))
            f.truncate(start + dtype.itemsize * shape.size)
        rows = image.select((F.lit(start) + dtype.itemsize * position(shape)).alias("at"), "v")
        write_placed(rows, work, dtype.str, [(start, start + dtype.itemsize * shape.size)])
        os.replace(work, path)
    finally:
        if os.path.exists(work):
            os.remove(work)
