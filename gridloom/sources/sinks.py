"""Writers: Parquet, HDF5 and XDMF images and maps, raw volumes, PNG, TIFF and JPEG rasters, frames of a registration, reports."""

from __future__ import annotations

import html
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, Shape
from ..operators.mapgrid import map_axis, map_shape, node_locations
from . import hdf5, png, tiff
from .errors import WriterError
from .placed import position, write_placed
from .volume import save_volume

#: Pixels that one raster may have, which the driver encodes.
MAX_RASTER = 1 << 26
Writer = Callable[[DataFrame, Shape, str, str], None]
WRITERS: dict[str, Writer] = {}


def register_writer(*extensions: str):
    def put(f: Writer) -> Writer:
        for e in extensions:
            if e in WRITERS:
                raise WriterError(f"a writer for {e} exists")
            WRITERS[e] = f
        return f

    return put


def split_spec(spec: str) -> tuple[str, str]:
    """File and group, parted by the first colon."""
    path, _, group = spec.partition(":")
    return path, group


def write_image(image: DataFrame, shape: Shape, spec: str, group: str = "/registered") -> None:
    path, own = split_spec(spec)
    extension = os.path.splitext(path)[1].lower()
    if extension not in WRITERS:
        raise WriterError(f"no writer for {extension or path}")
    WRITERS[extension](image, shape, path, own or group)


@register_writer(".parquet")
def write_parquet(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """One folder a group; other groups of the table stay."""
    image.withColumn("dataset", F.lit(group.strip("/"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def plane(image: DataFrame, shape: Shape) -> np.ndarray:
    """The first plane as values[y, x], on the driver."""
    return dense(image.filter("z = 0"), ["y", "x"], "v", (shape.ny, shape.nx))


@register_writer(".png")
def write_png(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """The first plane, 16 bits."""
    _put(path, png.encode(plane(image, shape)))


@register_writer(".tiff", ".tif")
def write_tiff(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """The first plane, 16 bits."""
    _put(path, tiff.encode(plane(image, shape)))


@register_writer(".jpg", ".jpeg")
def write_jpeg(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """The first plane, 8 bits, by the encoder of the driver's Java."""
    java = image.sparkSession.sparkContext._jvm
    values = np.floor(np.clip(plane(image, shape), 0, 1) * 255 + 0.5).astype(np.uint8)
    made = java.java.awt.image.BufferedImage(shape.nx, shape.ny, java.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    made.getRaster().setDataElements(0, 0, shape.nx, shape.ny, bytearray(values.tobytes()))
    out = java.java.io.ByteArrayOutputStream()
    if not java.javax.imageio.ImageIO.write(made, "jpg", out):
        raise WriterError("this Java writes no JPEG")
    _put(path, bytes(out.toByteArray()))


def _put(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def dense(df: DataFrame, order: list[str], value: str, extents: tuple[int, ...]) -> np.ndarray:
    """One image or one component of a map on the driver, slowest axis first; refused above ``MAX_RASTER`` values."""
    n = int(np.prod(extents, dtype=np.int64))
    if n > MAX_RASTER:
        raise WriterError(f"{n} values are too many for one file")
    values = df.orderBy(*order).select(value).toPandas()[value].to_numpy(np.float64)
    if len(values) != n:
        raise WriterError(f"{len(values)} values do not fill {extents}")
    return values.reshape(extents)


#: Files that an application has begun: its first dataset makes a file anew, later ones are added to it.
BEGUN: set[tuple[str, str]] = set()


def add_datasets(path: str, rows: DataFrame, shapes: dict[str, tuple[int, ...]], small: dict[str, np.ndarray] | None = None) -> None:
    """Datasets of rows (dataset, pos, v), written by tasks at their places, and small ones of the driver."""
    small = small or {}
    mark = (rows.sparkSession.sparkContext.applicationId, os.path.abspath(path))
    with hdf5.draft(path, shapes | {n: v.shape for n, v in small.items()}, fresh=mark not in BEGUN or not os.path.exists(path)) as made:
        with open(made.work, "r+b") as f:
            for name, values in small.items():
                f.seek(made.places[name])
                f.write(values.astype("<f8").tobytes())
        start = F.lit(None)
        for name in shapes:
            start = F.when(F.col("dataset") == name, F.lit(made.places[name])).otherwise(start)
        ranges = [(made.places[name], made.places[name] + 8 * prod(shape)) for name, shape in shapes.items()]
        inside = F.lit(False)
        for name, shape in shapes.items():
            inside |= (F.col("dataset") == name) & (F.col("pos") >= 0) & (F.col("pos") < prod(shape))
        write_placed(rows.select(F.when(inside, start + 8 * F.col("pos").cast("bigint")).alias("at"), "v"), made.work, "<f8", ranges)
    BEGUN.add(mark)


@register_writer(".h5")
def write_hdf5(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """One dataset of doubles, slowest axis first."""
    add_datasets(path, image.select(F.lit(group).alias("dataset"), position(shape).alias("pos"), "v"), {group: tuple(reversed(shape.extents))})


@register_writer(".image", ".mask")
def write_raw(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """A raw volume of the kind that the extension names."""
    save_volume(image, shape, path, os.path.splitext(path)[1][1:])


def xdmf(shape: Shape, data: str, name: str) -> bytes:
    """Metadata of a cell-centred scalar on a grid of pixels; axes from slowest to fastest."""
    reversed_ = lambda v: " ".join(map(str, reversed(v)))
    root = ET.Element("Xdmf", Version="2.0")
    grid = ET.SubElement(ET.SubElement(root, "Domain"), "Grid", Name=name, GridType="Uniform")
    ET.SubElement(grid, "Topology", TopologyType="3DCoRectMesh", Dimensions=reversed_([e + 1 for e in shape.extents]))
    geometry = ET.SubElement(grid, "Geometry", GeometryType="ORIGIN_DXDYDZ")
    ET.SubElement(geometry, "DataItem", Dimensions="3", Format="XML").text = "0 0 0"
    ET.SubElement(geometry, "DataItem", Dimensions="3", Format="XML").text = "1 1 1"
    attribute = ET.SubElement(grid, "Attribute", Name=name, AttributeType="Scalar", Center="Cell")
    ET.SubElement(attribute, "DataItem", Dimensions=reversed_(shape.extents), NumberType="Float", Precision="8", Format="HDF").text = data
    return ET.tostring(root, xml_declaration=True, encoding="utf-8")


def xdmf_map(shape: Shape, spacing: int, data: dict[str, str], name: str = "map", cover: bool = False) -> bytes:
    """Metadata of a node-centred vector on the nodes of a map."""
    nodes = map_shape(shape, spacing, cover)
    size = " ".join(map(str, reversed(nodes.extents)))
    root = ET.Element("Xdmf", Version="2.0")
    grid = ET.SubElement(ET.SubElement(root, "Domain"), "Grid", Name=name, GridType="Uniform")
    ET.SubElement(grid, "Topology", TopologyType="3DCoRectMesh", Dimensions=size)
    geometry = ET.SubElement(grid, "Geometry", GeometryType="ORIGIN_DXDYDZ")
    origin = [node_locations(e, spacing, cover)[0] for e in reversed(shape.extents)]
    ET.SubElement(geometry, "DataItem", Dimensions="3", Format="XML").text = " ".join(f"{o:g}" for o in origin)
    ET.SubElement(geometry, "DataItem", Dimensions="3", Format="XML").text = " ".join([str(spacing)] * 3)
    attribute = ET.SubElement(grid, "Attribute", Name=name, AttributeType="Vector", Center="Node")
    axes = [a for a in ("x", "y", "z") if a in data]
    join = ET.SubElement(attribute, "DataItem", ItemType="Function", Function=f"join({', '.join(f'${i}' for i in range(len(axes)))})", Dimensions=f"{size} {len(axes)}")
    for a in axes:
        ET.SubElement(join, "DataItem", Dimensions=size, NumberType="Float", Precision="8", Format="HDF").text = data[a]
    return ET.tostring(root, xml_declaration=True, encoding="utf-8")


@register_writer(".xdmf")
def write_xdmf(image: DataFrame, shape: Shape, path: str, group: str) -> None:
    """Metadata beside an HDF5 file of the values."""
    write_hdf5(image, shape, f"{path}.h5", group)
    _put(path, xdmf(shape, f"{os.path.basename(path)}.h5:/{group.strip('/')}", group.strip("/")))


def write_map(values: DataFrame, shape: Shape, spacing: int, spec: str, cover: bool = False, group: str = "/map") -> None:
    """``.h5`` and ``.xdmf``: components and places of nodes below the group; else Parquet of values (component beside dof) and of axes."""
    path, own = split_spec(spec)
    extension, group = os.path.splitext(path)[1].lower(), own or group
    if extension in (".png", ".jpg", ".jpeg", ".tiff", ".tif"):
        raise WriterError("maps can't be written as rasters")
    if extension in (".h5", ".xdmf"):
        axes, nodes = AXES[: shape.ndim], tuple(reversed(map_shape(shape, spacing, cover).extents))
        names = F.element_at(F.create_map(*(F.lit(x) for k, a in enumerate(axes, 1) for x in (k, f"{group}/{a}"))), F.col("dof"))
        rows = values.filter(F.col("dof").between(1, shape.ndim)).select(names.alias("dataset"), F.col("node").alias("pos"), F.col("value").alias("v"))
        places = {f"{group}/nodes_{a}": np.array(node_locations(shape.extents[k], spacing, cover)) for k, a in enumerate(axes)}
        add_datasets(path if extension == ".h5" else f"{path}.h5", rows, {f"{group}/{a}": nodes for a in axes}, places)
        if extension == ".xdmf":
            _put(path, xdmf_map(shape, spacing, {a: f"{os.path.basename(path)}.h5:/{group.strip('/')}/{a}" for a in "xyz"[: shape.ndim]}, group.strip("/"), cover))
        return
    names = F.element_at(F.create_map(*(x for k, a in enumerate("ixyz") for x in (F.lit(k), F.lit("intensity" if a == "i" else a)))), F.col("dof"))
    values.withColumn("component", names).write.mode("overwrite").parquet(f"{path}/values")
    map_axis(values.sparkSession, shape, spacing, cover).write.mode("overwrite").parquet(f"{path}/axes")


def frame_path(template: str, name: str, level: int, iteration: int, extension: str) -> str:
    """%name%, %ext%, %s% (level, two digits) and %i% (round, three digits) filled in."""
    for token, value in (("%name%", name), ("%ext%", extension), ("%s%", f"{level:02d}"), ("%i%", f"{iteration:03d}")):
        template = template.replace(token, value)
    return template


def frame_folder(folder: str, beside: str) -> str:
    """A relative folder is made beside the output; an absolute one must exist."""
    if os.path.isabs(folder):
        if not os.path.isdir(folder):
            raise WriterError(f"{folder} does not exist")
        return folder
    made = os.path.join(os.path.dirname(os.path.abspath(beside)), folder)
    os.makedirs(made, exist_ok=True)
    return made


def report(title: str, rows: list[dict], figures: tuple[str, ...] = ()) -> str:
    """A page with one table and, below it, figures in HTML."""
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.3f}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{''.join(figures)}"
