"""Loading images of any known kind as pixel tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES
from ..operators.image import normalise, same_shape
from . import dicom, hdf5, png, pnm, tiff
from .errors import LoaderError
from .volume import SCHEMA, read_volume

LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_loader(name: str):
    def put(f):
        if name in LOADERS:
            raise LoaderError(f"a loader named {name} exists")
        LOADERS[name] = f
        return f

    return put


def pixels_of(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Decode whole files on the executors, one file a task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                values = decode(data)
                values = values if values.ndim == 3 else values[None]
                _, ny, nx = values.shape
                flat = values.reshape(-1)
                for at in range(0, len(flat), 1 << 16):
                    pos = np.arange(at, min(at + (1 << 16), len(flat)), dtype=np.int64)
                    columns = [(pos % nx).astype(np.int32), (pos // nx % ny).astype(np.int32), (pos // (nx * ny)).astype(np.int32), flat[pos].astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "z", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def _head(path: str, n: int) -> bytes:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        return f.read(n)


@register_loader("dicom")
def load_dicom(spark: SparkSession, path: str) -> DataFrame:
    if _head(path, 132)[128:] != b"DICM":
        raise LoaderError(f"{path} is no DICOM file")
    return pixels_of(spark, path, dicom.decode)


@register_loader("png")
def load_png(spark: SparkSession, path: str) -> DataFrame:
    if _head(path, 8) != png.SIGNATURE:
        raise LoaderError(f"{path} is no PNG file")
    return pixels_of(spark, path, png.decode)


@register_loader("pnm")
def load_pnm(spark: SparkSession, path: str) -> DataFrame:
    if _head(path, 2) not in pnm.HEADS:
        raise LoaderError(f"{path} is no binary greymap or pixmap")
    return pixels_of(spark, path, pnm.decode)


@register_loader("tiff")
def load_tiff(spark: SparkSession, path: str) -> DataFrame:
    if _head(path, 4) not in tiff.HEADS:
        raise LoaderError(f"{path} is no TIFF file")
    return pixels_of(spark, path, tiff.decode)


def hdf5_place(spec: str) -> tuple[str, str]:
    """File and path of a dataset; the values of ``.xdmf`` are in the file beside it."""
    path, _, group = spec.partition(":")
    return (f"{path}.h5" if path.endswith(".xdmf") else path), group


@register_loader("hdf5")
def load_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """``file:/dataset`` of two or three axes, slowest first; without a dataset, /registered."""
    file, group = hdf5_place(path)
    if _head(file, 8) != hdf5.SIGNATURE:
        raise LoaderError(f"{file} is no HDF5 file")
    return read_volume(spark, file, "hdf5", dataset=group or "/registered")


@register_loader("raster")
def load_raster(spark: SparkSession, path: str) -> DataFrame:
    """What Spark's own image source decodes with 8 bits (JPEG, BMP, GIF): red, the last byte of blue, green, red."""
    if not _head(path, 4).startswith((b"\xff\xd8\xff", b"BM", b"GIF8")):
        raise LoaderError(f"{path} is no JPEG, BMP or GIF file")
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                nx, ny, channels = row["width"], row["height"], row["nChannels"]
                values = np.frombuffer(row["data"], np.uint8).reshape(ny, nx, channels)[:, :, min(2, channels - 1)] / 255.0
                for y in range(ny):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(nx, dtype=np.int32)), pa.array(np.full(nx, y, np.int32)), pa.array(np.zeros(nx, np.int32)), pa.array(values[y])], names=["x", "y", "z", "v"])

    return image.select("width", "height", "nChannels", "data").mapInArrow(run, SCHEMA)


@register_loader("volume")
def load_volume(spark: SparkSession, path: str) -> DataFrame:
    return read_volume(spark, path, "image")


@register_loader("volume_mask")
def load_mask(spark: SparkSession, path: str) -> DataFrame:
    return read_volume(spark, path, "mask")


@register_loader("parquet")
def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not path.rstrip("/").endswith(".parquet"):
        raise LoaderError(f"{path} is no Parquet table")
    return spark.read.parquet(path).select("x", "y", "z", "v")


def find_loader(spark: SparkSession, path: str) -> DataFrame:
    """The first loader by name that takes the file."""
    if not os.path.exists(path) and not os.path.exists(hdf5_place(path)[0]):
        raise FileNotFoundError(path)
    for name in sorted(LOADERS):
        try:
            return LOADERS[name](spark, path)
        except (LoaderError, IsADirectoryError, FileNotFoundError):
            continue
    raise LoaderError(f"no loader takes {path}")


def load_image(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """An image (x, y, z, v), divided by its largest value; with ``like``, of the same shape."""
    image = find_loader(spark, path)
    if like is not None:
        same_shape(image, like)
    return normalise(image, "v")


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(values, axes) as written by ``sinks.write_map``; from HDF5 the displacement alone, without intensity."""
    file, group = hdf5_place(path)
    if not file.endswith(".h5"):
        return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/axes")
    group = "/" + (group or "/map").strip("/")
    with hdf5.opened(file) as found:
        names = found.names()
        there = [(k, a) for k, a in enumerate(AXES, 1) if f"{group}/{a}" in names]
        if not there:
            raise LoaderError(f"{file} has no map {group}")
        places = {a: found.read(f"{group}/nodes_{a}") for _, a in there}
        shapes = {a: found.find(f"{group}/{a}").shape for _, a in there}
    values, axes = None, []
    for k, a in there:
        ny, nx = shapes[a][-2:]
        node = (F.col("x") + nx * (F.col("y") + ny * F.col("z"))).cast("int").alias("node")
        part = read_volume(spark, file, "hdf5", dataset=f"{group}/{a}").select(node, F.lit(k).alias("dof"), F.col("v").alias("value"), F.lit(a).alias("component"))
        values = part if values is None else values.unionByName(part)
        axes += [(k - 1, i, float(x)) for i, x in enumerate(places[a])]
    return values, spark.createDataFrame(axes, "dim int, idx int, loc double")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """(lm_id, x, y) from a CSV file with a header line."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("lm_id", "x", "y")])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def rescale_range(df: DataFrame, value: str = "v") -> DataFrame:
    """(v - least) / (largest - least); 0 where all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).select(*(c if c != value else F.coalesce((F.col(c) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias(c) for c in df.columns))
