"""Registered queries that write files and read them back, and the SQL that gives the rows which the files must hold.

The files go to a folder of their own below the shared one, and are removed by nobody: they are small.
"""

from __future__ import annotations

import os
import struct
import uuid
import xml.etree.ElementTree as ET
import zlib
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import NODES, R2, R3, SPACING, axes_sql, formula_map, formula_sql, pair, r6, raster_sql, scaled, scaled_sql, table
from .functions.grid import AXES, Shape
from .operators.image import filled_mask
from .session import shared_folder
from .sources import config, images, sinks, volume
from .sources.errors import ConfigError, LoaderError, WriterError

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see; file formats need one that is mounted, not an object store."""
    top = shared_folder(spark)
    if "://" in top and not top.startswith("file://"):
        raise ValueError(f"files can't be written to {top}")
    made = os.path.join(top.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    os.makedirs(made)
    return made


def image_of(spark: SparkSession, sf_dir: str, shape: Shape = R2) -> DataFrame:
    return scaled(spark, sf_dir, shape).select(*AXES, F.col("f").alias("v"))


def values_of(spark: SparkSession, sf_dir: str, shape: Shape, column: str = "f", whole: bool = False) -> np.ndarray:
    """values[z, y, x] of a raster on the driver, for fixtures."""
    df = pair(spark, sf_dir, shape) if whole else scaled(spark, sf_dir, shape)
    return sinks.dense(df, ["z", "y", "x"], column, tuple(reversed(shape.extents)))


def pixels_sql(value: str, shape: Shape = R2, whole: bool = False) -> str:
    return f"WITH {raster_sql(shape) if whole else scaled_sql(shape)} SELECT x, y, z, {value} AS v FROM q"


def pixels(df: DataFrame) -> DataFrame:
    return df.select(*AXES, r6("v").alias("v"))


def values_sql(names: str, rows: list[tuple]) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


# Raw volumes


@query(pixels_sql("round(CAST(CAST(f AS FLOAT) AS DOUBLE), 6) + 0e0", R3))
def volume_image(spark, sf_dir):
    path = f"{folder(spark)}/a.image"
    sinks.write_image(image_of(spark, sf_dir, R3), R3, path)
    return pixels(volume.read_volume(spark, path))


@query(pixels_sql("CAST(f > 0 AS INT) + 0e0", R3))
def volume_mask(spark, sf_dir):
    path = f"{folder(spark)}/a.mask"
    sinks.write_image(image_of(spark, sf_dir, R3).withColumn("v", (F.col("v") > 0).cast("double")), R3, path)
    return pixels(volume.read_volume(spark, path, "mask"))


@query(pixels_sql("f", R3, whole=True) + " WHERE z BETWEEN 3 AND 5 AND y >= 40")
def volume_slab(spark, sf_dir):
    """Planes of a volume in many partitions, of which only those planes' are read."""
    path = f"{folder(spark)}/a.image"
    sinks.write_image(pair(spark, sf_dir, R3).select(*AXES, F.col("f").alias("v")), R3, path)
    return pixels(volume.read_volume(spark, path, partition_values=50 * 83).filter("z between 3 and 5 and y >= 40"))


def bad_volumes(folder_: str) -> dict[str, str]:
    """Paths of files that a header check must refuse."""
    made = {"short": b"\1\0\0\0", "channels": struct.pack("<4i", 1, 1, 1, 3) + bytes(4), "size": struct.pack("<4i", 2, 2, 2, 1) + bytes(31), "negative": struct.pack("<4i", -1, 1, 1, 1)}
    for name, data in made.items():
        with open(f"{folder_}/{name}", "wb") as f:
            f.write(data)
    return {name: f"{folder_}/{name}" for name in [*made, "absent"]}


@query(values_sql("name, error", [("absent", "FileNotFoundError"), ("channels", "LoaderError"), ("negative", "LoaderError"), ("short", "LoaderError"), ("size", "LoaderError")]))
def volume_headers(spark, sf_dir):
    rows = []
    for name, path in bad_volumes(folder(spark)).items():
        try:
            volume.header(path, "image")
        except (FileNotFoundError, LoaderError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")


# Images of known kinds


def _back(spark, sf_dir, name: str) -> DataFrame:
    path = f"{folder(spark)}/{name}"
    sinks.write_image(image_of(spark, sf_dir), R2, path)
    return pixels(images.find_loader(spark, path))


@query(pixels_sql("round(floor(f * 65535 + 0.5e0) / 65535, 6) + 0e0"))
def png_image(spark, sf_dir):
    return _back(spark, sf_dir, "a.png")


@query(pixels_sql("round(floor(f * 65535 + 0.5e0) / 65535, 6) + 0e0"))
def tiff_image(spark, sf_dir):
    return _back(spark, sf_dir, "a.tiff")


@query(pixels_sql("round(f, 6) + 0e0"))
def hdf5_image(spark, sf_dir):
    return _back(spark, sf_dir, "a.h5:/first/second")


@query(pixels_sql("round(f, 6) + 0e0"))
def xdmf_image(spark, sf_dir):
    return _back(spark, sf_dir, "a.xdmf:/registered")


@query(f"WITH {scaled_sql()} SELECT count(*) AS n, max(x) AS x, max(y) AS y, true AS near FROM q")
def jpeg_image(spark, sf_dir):
    """Written with loss: extents, and whether all values but few are near."""
    path = f"{folder(spark)}/a.jpg"
    image = image_of(spark, sf_dir)
    sinks.write_image(image, R2, path)
    both = images.find_loader(spark, path).withColumnRenamed("v", "w").join(image, [*AXES])
    return both.agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y"), (F.avg(F.abs(F.col("v") - F.col("w"))) < 0.05).alias("near"))


@query(pixels_sql("round(f / (SELECT greatest(max(f), 1) FROM q), 6) + 0e0", whole=True))
def pnm_image(spark, sf_dir):
    path, values = f"{folder(spark)}/a.pgm", values_of(spark, sf_dir, R2, whole=True)
    with open(path, "wb") as f:
        f.write(b"P5\n# counts\n50 83\n%d\n" % max(1, int(values.max())) + values.astype(np.uint8 if values.max() < 256 else ">u2").tobytes())
    return pixels(images.find_loader(spark, path))


@query(pixels_sql("round(floor(f * 65535 + 0.5e0) / 65535, 6) + 0e0"))
def tiff_deflated(spark, sf_dir):
    """A compressed strip of differences along rows."""
    path, tags = f"{folder(spark)}/a.tif", images.tiff
    words = np.floor(values_of(spark, sf_dir, R2)[0] * 65535 + 0.5).astype(np.int64)
    strip = zlib.compress(np.diff(words, axis=1, prepend=0).astype("<u2").tobytes())
    found = {tags.WIDTH: 50, tags.LENGTH: 83, tags.BITS: 16, tags.COMPRESSION: 8, tags.COLOUR: 1, tags.OFFSETS: 8, tags.SAMPLES: 1, tags.ROWS: 83, tags.COUNTS: len(strip), tags.PREDICTOR: 2}
    with open(path, "wb") as f:
        f.write(tags.HEADS[0] + struct.pack("<I", 8 + len(strip)) + strip + struct.pack("<H", len(found)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(found.items())) + bytes(4))
    return pixels(images.find_loader(spark, path))


def dicom_of(values: np.ndarray) -> bytes:
    """Explicit little-endian, 16 bits, rows along x: values[z, y, x]."""
    nz, ny, nx = values.shape
    short = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    frames = str(nz).encode().ljust(2)
    pixels_ = values.transpose(0, 2, 1).astype("<u2").tobytes()
    body = short(0x28, 2, 1) + struct.pack("<HH2sH", 0x28, 8, b"IS", len(frames)) + frames + short(0x28, 0x10, nx) + short(0x28, 0x11, ny) + short(0x28, 0x100, 16) + short(0x28, 0x103, 0)
    return bytes(128) + b"DICM" + body + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, len(pixels_)) + pixels_


@query(pixels_sql("round((f - (SELECT min(f) FROM q)) / (SELECT max(f) - min(f) FROM q), 6) + 0e0", R3, whole=True))
def dicom_image(spark, sf_dir):
    path = f"{folder(spark)}/a.dcm"
    with open(path, "wb") as f:
        f.write(dicom_of(values_of(spark, sf_dir, R3, whole=True)))
    return pixels(images.find_loader(spark, path))


@query(
    f"WITH {raster_sql()}, {scaled_sql().replace('raw AS', 'raw2 AS').replace('FROM raw', 'FROM raw2').replace('q AS (SELECT', 's AS (SELECT')} "
    "SELECT k AS kind, count(*) AS n, CAST(round(sum(CASE WHEN k = 'mask' THEN CAST(q.f > 0 AS INT) WHEN k IN ('png', 'tiff') THEN floor(s.f * 65535 + 0.5e0) / 65535 ELSE s.f END), 2) AS DOUBLE) AS total FROM q JOIN s USING (x, y, z), (VALUES ('png'), ('tiff'), ('hdf5'), ('image'), ('mask'), ('parquet')) v(k) GROUP BY k"
)
def loader_detect(spark, sf_dir):
    """Files without a telling name are known by their first bytes and their size."""
    top, image = folder(spark), image_of(spark, sf_dir)
    sinks.write_image(image, R2, f"{top}/a.png")
    sinks.write_image(image, R2, f"{top}/a.tiff")
    sinks.write_image(image, R2, f"{top}/a.h5")
    volume.save_volume(image, R2, f"{top}/image")
    volume.save_volume(image.withColumn("v", (F.col("v") > 0).cast("double")), R2, f"{top}/mask", "mask")
    image.coalesce(1).write.parquet(f"{top}/a.parquet")
    for name, end in (("png", ".png"), ("tiff", ".tiff"), ("hdf5", ".h5"), ("parquet", ".parquet")):
        if name != "parquet":
            os.rename(f"{top}/a{end}", f"{top}/{name}")
    out = None
    for name in ("png", "tiff", "hdf5", "image", "mask", "a.parquet"):
        one = images.find_loader(spark, f"{top}/{name}").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")).select(F.lit(name.split(".")[-1]).alias("kind"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(pixels_sql("round(CAST(CAST(f / 7 AS FLOAT) AS DOUBLE) / (SELECT max(CAST(CAST(f / 7 AS FLOAT) AS DOUBLE)) FROM q), 6) + 0e0", whole=True))
def load_image(spark, sf_dir):
    """Loaded images are divided by their largest value, and checked against another's shape."""
    path = f"{folder(spark)}/a.image"
    sinks.write_image(pair(spark, sf_dir).select(*AXES, (F.col("f") / 7).alias("v")), R2, path)
    return pixels(images.load_image(spark, path, like=filled_mask(pair(spark, sf_dir))))


@query(pixels_sql("round((f + 3 - (SELECT min(f + 3) FROM q)) / (SELECT max(f) - min(f) FROM q), 6) + 0e0", whole=True))
def norm_convert(spark, sf_dir):
    return pixels(images.rescale_range(pair(spark, sf_dir).select(*AXES, (F.col("f") + 3).alias("v"))))


@query("SELECT CAST(p_partkey AS INT) AS lm_id, CAST(p_size AS INT) AS x, CAST(p_partkey % 83 AS INT) AS y FROM part")
def landmarks_csv(spark, sf_dir):
    path = f"{folder(spark)}/points.csv"
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("# "), F.col("p_size").alias("X"), (F.col("p_partkey") % 83).alias("Y"))
    points.write.csv(path, header=True)
    return images.read_landmarks(spark, path)


# Maps


def _map_file(spark: SparkSession, extension: str) -> str:
    path = f"{folder(spark)}/a{extension}"
    sinks.write_map(formula_map(spark), R2, SPACING, path)
    return path


_MAP = f"WITH {formula_sql()} SELECT node, dof, round(value, 6) + 0e0 AS value, CASE dof WHEN 0 THEN 'intensity' WHEN 1 THEN 'x' ELSE 'y' END AS component FROM map"
_AXES = f"WITH {axes_sql()} SELECT dim, idx, round(loc, 6) + 0e0 AS loc FROM axis"


@query(f"{_MAP} WHERE dof > 0")
def hdf5_map(spark, sf_dir):
    return images.load_map(spark, _map_file(spark, ".h5"))[0].select("node", "dof", r6("value").alias("value"), "component")


@query(f"{_AXES} WHERE dim < 2")
def hdf5_map_nodes(spark, sf_dir):
    return images.load_map(spark, _map_file(spark, ".xdmf"))[1].select("dim", "idx", r6("loc").alias("loc"))


@query(_MAP)
def parquet_map(spark, sf_dir):
    return images.load_map(spark, _map_file(spark, ".parquet"))[0].select("node", "dof", r6("value").alias("value"), "component")


@query(_AXES)
def parquet_map_nodes(spark, sf_dir):
    return images.load_map(spark, _map_file(spark, ".parquet"))[1].select("dim", "idx", r6("loc").alias("loc"))


def _metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for at, e in enumerate(ET.parse(path).getroot().iter()):
        rows += [(at, e.tag, k, v) for k, v in sorted(e.attrib.items())] + ([(at, e.tag, "", e.text)] if e.text else [])
    return spark.createDataFrame(rows, "place int, tag string, name string, value string")


# Fixed values of the format, for a raster of 50 x 83 x 1 and a map of 6 x 9 x 1 nodes.
_IMAGE_XML = [
    (0, "Xdmf", "Version", "2.0"), (2, "Grid", "GridType", "Uniform"), (2, "Grid", "Name", "registered"), (3, "Topology", "Dimensions", "2 84 51"), (3, "Topology", "TopologyType", "3DCoRectMesh"),
    (4, "Geometry", "GeometryType", "ORIGIN_DXDYDZ"), (5, "DataItem", "Dimensions", "3"), (5, "DataItem", "Format", "XML"), (5, "DataItem", "", "0 0 0"), (6, "DataItem", "Dimensions", "3"), (6, "DataItem", "Format", "XML"), (6, "DataItem", "", "1 1 1"),
    (7, "Attribute", "AttributeType", "Scalar"), (7, "Attribute", "Center", "Cell"), (7, "Attribute", "Name", "registered"), (8, "DataItem", "Dimensions", "1 83 50"), (8, "DataItem", "Format", "HDF"), (8, "DataItem", "NumberType", "Float"), (8, "DataItem", "Precision", "8"), (8, "DataItem", "", "a.xdmf.h5:/registered"),
]
_SIZE = " ".join(map(str, reversed(NODES.extents)))
_MAP_XML = [
    (0, "Xdmf", "Version", "2.0"), (2, "Grid", "GridType", "Uniform"), (2, "Grid", "Name", "map"), (3, "Topology", "Dimensions", _SIZE), (3, "Topology", "TopologyType", "3DCoRectMesh"),
    (4, "Geometry", "GeometryType", "ORIGIN_DXDYDZ"), (5, "DataItem", "Dimensions", "3"), (5, "DataItem", "Format", "XML"), (5, "DataItem", "", "0 1 -0.5"), (6, "DataItem", "Dimensions", "3"), (6, "DataItem", "Format", "XML"), (6, "DataItem", "", "10 10 10"),
    (7, "Attribute", "AttributeType", "Vector"), (7, "Attribute", "Center", "Node"), (7, "Attribute", "Name", "map"), (8, "DataItem", "Dimensions", f"{_SIZE} 2"), (8, "DataItem", "Function", "join($0, $1)"), (8, "DataItem", "ItemType", "Function"),
    *((k, "DataItem", n, v) for k, a in ((9, "x"), (10, "y")) for n, v in (("Dimensions", _SIZE), ("Format", "HDF"), ("NumberType", "Float"), ("Precision", "8"), ("", f"a.xdmf.h5:/map/{a}"))),
]


@query(values_sql("place, tag, name, value", _IMAGE_XML))
def xdmf_image_metadata(spark, sf_dir):
    path = f"{folder(spark)}/a.xdmf"
    sinks.write_image(image_of(spark, sf_dir), R2, path)
    return _metadata(spark, path)


@query(values_sql("place, tag, name, value", _MAP_XML))
def xdmf_map_metadata(spark, sf_dir):
    return _metadata(spark, _map_file(spark, ".xdmf"))


# Writers


@query(pixels_sql("'one' AS dataset, round(f, 6) + 0e0") + " UNION ALL SELECT x, y, z, 'two', round(m, 6) + 0e0 FROM q")
def parquet_groups(spark, sf_dir):
    """Groups of one table: writing a group anew leaves the others."""
    path, both = f"{folder(spark)}/a.parquet", scaled(spark, sf_dir)
    sinks.write_image(both.select(*AXES, F.col("m").alias("v")), R2, f"{path}:/one")
    sinks.write_image(both.select(*AXES, F.col("m").alias("v")), R2, f"{path}:/two")
    sinks.write_image(image_of(spark, sf_dir), R2, f"{path}:/one")
    return spark.read.parquet(path).select(*AXES, r6("v").alias("v"), "dataset")


@query(pixels_sql("'/two' AS dataset, round(m, 6) + 0e0") + " UNION ALL SELECT x, y, z, '/one', round(f, 6) + 0e0 FROM q")
def hdf5_truncates_once(spark, sf_dir):
    """A file that stood before is made anew by the first dataset; the next is added to it."""
    path, both = f"{folder(spark)}/a.h5", scaled(spark, sf_dir)
    sinks.hdf5.add(path, {"/old": np.zeros((1, 1, 1))}, fresh=True)
    sinks.write_image(image_of(spark, sf_dir), R2, f"{path}:/one")
    sinks.write_image(both.select(*AXES, F.col("m").alias("v")), R2, f"{path}:/two")
    with sinks.hdf5.opened(path) as found:
        names = found.names()
    out = None
    for name in names:
        one = images.load_hdf5(spark, f"{path}:{name}").select(*AXES, r6("v").alias("v"), F.lit(name).alias("dataset"))
        out = one if out is None else out.unionByName(one)
    return out


@query(values_sql("spec, path, dataset", [("a.h5", "a.h5", ""), ("a.h5:/x", "a.h5", "/x"), ("a.xdmf:b:c", "a.xdmf", "b:c"), (":", "", "")]))
def split_spec(spark, sf_dir):
    return spark.createDataFrame([(s, *sinks.split_spec(s)) for s in ("a.h5", "a.h5:/x", "a.xdmf:b:c", ":")], "spec string, path string, dataset string")


@query(values_sql("side, name", [("writer", e) for e in (".h5", ".image", ".mask", ".xdmf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".parquet")] + [("loader", n) for n in ("dicom", "hdf5", "parquet", "png", "pnm", "raster", "tiff", "volume", "volume_mask")] + [("error", "LoaderError"), ("error", "WriterError"), ("error", "WriterError"), ("error", "WriterError")]))
def registries(spark, sf_dir):
    """Names of loaders and writers; what has a name twice, has none, or is a map as a raster is an error."""
    rows = [("writer", e) for e in sinks.WRITERS] + [("loader", n) for n in images.LOADERS]
    image, map_ = filled_mask(pair(spark, sf_dir)), formula_map(spark)
    for wrong in (
        lambda: images.register_loader("png")(None),
        lambda: sinks.register_writer(".png")(None),
        lambda: sinks.write_image(image, R2, "a.unknown"),
        lambda: sinks.write_map(map_, R2, SPACING, "a.png"),
    ):
        try:
            wrong()
        except (LoaderError, WriterError) as e:
            rows.append(("error", type(e).__name__))
    return spark.createDataFrame(rows, "side string, name string")


@query(values_sql("level, iteration, path", [(0, 0, "out-intermediate-00-000.h5"), (2, 7, "out-intermediate-02-007.h5"), (11, 123, "out-intermediate-11-123.h5")]))
def frame_paths(spark, sf_dir):
    template = config.Settings().intermediate_template
    return spark.createDataFrame([(a, b, sinks.frame_path(template, "out", a, b, ".h5")) for a, b in ((0, 0), (2, 7), (11, 123))], "level int, iteration int, path string")


@query(f"WITH {raster_sql()} SELECT CAST(x AS VARCHAR) AS measure, printf('%.3f', sum(f) / 3) AS value FROM q GROUP BY x")
def report_table(spark, sf_dir):
    """The cells of a report's page."""
    rows = pair(spark, sf_dir).groupBy("x").agg((F.sum("f") / 3).alias("value")).collect()  # one row per column of the raster
    page = ET.fromstring(sinks.report("<&>", [{"measure": str(r.x), "value": r.value} for r in rows]).replace("<!DOCTYPE html>", "<page>") + "</page>")
    cells = [[c.text for c in row] for row in page.iter("tr")]
    return spark.createDataFrame([tuple(c) for c in cells[1:]], "measure string, value string")


# Settings

_INI = "Fixed = a.png\nMOVED=b.png\nnodespacing = 12\nlambda=3.5\nwith_memory = NO\nverbose = True\nnot_known = 1\n"
_ARGUMENTS = ["REGISTER", "Fixed", "a.png", "MOVED", "b.png", "nodespacing", "12", "lambda", "3.5", "verbose"]
# Settings and their defaults.
_DEFAULTS = {
    "fixed": "", "moved": "", "nodespacing": "0", "mask": "", "registered": "registered.xdmf", "map": "map.xdmf", "registered_h5_path": "/registered", "map_h5_path": "/map", "with_lambda": "auto", "lambda_mult": "1.0", "with_memory": "True", "max_iterations": "100",
    "save_intermediate_frames": "False", "intermediate_template": "%name%-intermediate-%s%-%i%%ext%", "intermediate_map_template": "%name%-intermediate-map-%s%-%i%%ext%", "intermediate_directory": "intermediates", "verbose": "False", "memory_report": "True",
}
_GIVEN = _DEFAULTS | {"fixed": "a.png", "moved": "b.png", "nodespacing": "12", "with_lambda": "3.5", "verbose": "True"}


def _settings(spark: SparkSession, settings: config.Settings) -> DataFrame:
    return spark.createDataFrame([(f.name, str(getattr(settings, f.name))) for f in fields(settings)], "name string, value string")


@query(values_sql("name, value", list((_GIVEN | {"with_memory": "False"}).items())))
def settings_file(spark, sf_dir):
    """Keys without regard to case; unknown ones are warnings."""
    path = f"{folder(spark)}/a.conf"
    with open(path, "w", encoding="utf-8") as f:
        f.write(_INI)
    return _settings(spark, config.from_file(path))


@query(values_sql("name, value", list(_GIVEN.items())))
def settings_arguments(spark, sf_dir):
    return _settings(spark, config.from_arguments(_ARGUMENTS))


@query(values_sql("given, error", [("register fixed a", "ConfigError"), ("register fixed a moved b nodespacing 3 odd 1", "ConfigError"), ("fixed a", "ConfigError"), ("register fixed", "ConfigError"), ("register fixed a moved b nodespacing x", "ConfigError"), ("", "ConfigError"), ("register fixed a moved b nodespacing 3", "")]))
def settings_errors(spark, sf_dir):
    """Missing and unknown settings, and values of the wrong kind."""
    rows = []
    for given in ("register fixed a", "register fixed a moved b nodespacing 3 odd 1", "fixed a", "register fixed", "register fixed a moved b nodespacing x", "", "register fixed a moved b nodespacing 3"):
        try:
            config.from_arguments(given.split())
            rows.append((given, ""))
        except ConfigError as e:
            rows.append((given, type(e).__name__))
    return spark.createDataFrame(rows, "given string, error string")
