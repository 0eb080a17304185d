"""Files that tasks write at places of their own, and datasets that tasks read by lines and by chunks."""

import os
import struct
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import Shape
from gridloom.sources import hdf5, images, placed, sinks, volume
from gridloom.sources.errors import LoaderError, WriterError

SHAPE = Shape(13, 11, 7)


def image_of(spark, shape=SHAPE, scale=1.0):
    n = F.col("id")
    cells = spark.range(0, shape.size, 1, 6).select((n % shape.nx).cast("int").alias("x"), (F.floor(n / shape.nx) % shape.ny).cast("int").alias("y"), F.floor(n / (shape.nx * shape.ny)).cast("int").alias("z"), (n * scale).alias("v"))
    return cells.orderBy(F.xxhash64("v"))


def numbers(shape=SHAPE, scale=1.0):
    return np.arange(shape.size).reshape(tuple(reversed(shape.extents))) * scale


def rows(df):
    return {(r.x, r.y, r.z): r.v for r in df.collect()}


def cells(values):
    return {(x, y, z): float(values[z, y, x]) for z, y, x in np.ndindex(values.shape)}


@pytest.mark.parametrize("name", ["a.image", "a.mask", "a.h5", "a.xdmf"])
def test_images_are_written_by_tasks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(placed, "STRETCH", 8)
    monkeypatch.setattr(sinks, "dense", None)  # nothing comes to the driver
    sinks.write_image(image_of(spark), SHAPE, f"{tmp_path}/{name}")
    assert rows(images.find_loader(spark, f"{tmp_path}/{name}")) == cells(numbers())
    if name == "a.h5":
        assert (hdf5.File((tmp_path / name).read_bytes()).read("/registered") == numbers()).all()
    if name == "a.image":
        volume.write_volume(f"{tmp_path}/b.image", numbers())
        assert (tmp_path / "a.image").read_bytes() == (tmp_path / "b.image").read_bytes()
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


@pytest.mark.parametrize("name", ["a.image", "a.h5"])
@pytest.mark.parametrize("wrong", ["v <> 500", "double", "x = -1", "x = 13", "none"])
def test_rows_that_do_not_fill_an_image(spark, tmp_path, name, wrong):
    """A missing pixel, one that is there twice, one outside in place of another, no pixels: an error, and the file stays as it was."""
    image, path = image_of(spark), f"{tmp_path}/{name}"
    sinks.write_image(image.withColumn("v", F.lit(0.0)), SHAPE, path)
    before = (tmp_path / name).read_bytes()
    if wrong == "double":
        bad = image.unionByName(image.filter("v = 500"))
    elif wrong.startswith("x"):
        bad = image.withColumn("x", F.when(F.col("v") == 500, int(wrong.split()[-1])).otherwise(F.col("x")))
    else:
        bad = image.filter(wrong if wrong != "none" else "false")
    with pytest.raises(WriterError):
        sinks.write_image(bad, SHAPE, path)
    assert (tmp_path / name).read_bytes() == before and os.listdir(tmp_path) == [name]


def test_null_and_odd_values(spark, tmp_path):
    """Null is no number; extra columns are not written."""
    image = image_of(spark).withColumn("v", F.when(F.col("v") == 3, None).when(F.col("v") == 4, float("inf")).otherwise(F.col("v"))).withColumn("at", F.lit(1)).withColumn("pos", F.lit("x"))
    sinks.write_image(image, SHAPE, f"{tmp_path}/a.h5")
    found = hdf5.File((tmp_path / "a.h5").read_bytes()).read("/registered").ravel()
    assert np.isnan(found[3]) and np.isinf(found[4]) and (found[5:] == numbers().ravel()[5:]).all()


def test_datasets_are_added_behind_a_file(spark, tmp_path):
    """What the file holds is not copied; a group that gives way is gone; until the superblock is written the file is the old one."""
    path = f"{tmp_path}/a.h5"
    sinks.write_image(image_of(spark), SHAPE, f"{path}:/one/deep")
    first = os.path.getsize(path)
    held = (tmp_path / "a.h5").read_bytes()[hdf5.SUPERBLOCK : first]
    with pytest.raises(RuntimeError), hdf5.draft(path, {"/bad": (4,)}, fresh=False) as made:
        assert made.work == path and os.path.getsize(path) > first and hdf5.File((tmp_path / "a.h5").read_bytes()).names() == ["/one/deep"]
        raise RuntimeError
    assert os.path.getsize(path) == first
    sinks.write_image(image_of(spark, scale=2.0), SHAPE, f"{path}:/two")
    names = [f"/many/{k:02d}" for k in range(40)]
    hdf5.add(path, {n: np.full(3, k) for k, n in enumerate(names)}, fresh=False)
    assert (tmp_path / "a.h5").read_bytes()[hdf5.SUPERBLOCK : first] == held
    with hdf5.opened(path) as found:
        assert sorted(found.names()) == sorted([*names, "/one/deep", "/two"])
        assert (found.read("/one/deep") == numbers()).all() and (found.read("/two") == 2 * numbers()).all() and found.read(names[17]).tolist() == [17.0] * 3
    sinks.write_image(image_of(spark, scale=3.0), SHAPE, f"{path}:/one")
    assert rows(images.load_hdf5(spark, f"{path}:/one")) == cells(numbers(scale=3.0))
    with hdf5.opened(path) as found:
        assert "/one/deep" not in found.names() and "/two" in found.names()


def chunked(values, chunk, filters, levels=1, skip=(), fill=None, drop_filters=()):
    """A file of one chunked dataset /a, by the bytes that the format prescribes; written apart from the package's own code."""
    out = bytearray(96)

    def put(block):
        out.extend(bytes(-len(out) % 8) + block)
        return len(out) - len(block)

    rank, leaves = values.ndim, []
    for corner in product(*(range(0, e, c) for e, c in zip(values.shape, chunk))):
        if corner in skip:
            continue
        part = np.zeros(chunk, values.dtype)
        inside = values[tuple(slice(a, a + c) for a, c in zip(corner, chunk))]
        part[tuple(slice(e) for e in inside.shape)] = inside
        raw, mask = part.tobytes(), 0
        for k, f in enumerate(filters):
            if corner in drop_filters:
                mask |= 1 << k
            elif f == hdf5.SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, values.itemsize).T.tobytes()
            elif f == hdf5.DEFLATE:
                raw = zlib.compress(raw)
            else:
                raw += b"\1\2\3\4"
        leaves.append((struct.pack(f"<II{rank + 1}Q", len(raw), mask, *corner, 0), put(raw)))

    def node(level, children):
        body = b"".join(key + struct.pack("<Q", child) for key, child in children) + struct.pack(f"<II{rank + 1}Q", 0, 0, *values.shape, 0)
        return put(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(children), hdf5.NOWHERE, hdf5.NOWHERE) + body)

    nodes = [(leaves[k][0], node(0, leaves[k : k + 5])) for k in range(0, len(leaves), 5)] if levels > 1 else []
    tree = node(1, nodes) if levels > 1 else node(0, leaves)
    kind = {"f": struct.pack("<B3BI HHBBBBI", 0x11, 0x20, 63 if values.itemsize == 8 else 31, 0, values.itemsize, 0, 8 * values.itemsize, *((52, 11, 0, 52, 1023) if values.itemsize == 8 else (23, 8, 0, 23, 127))), "i": struct.pack("<B3BIHH", 0x10, 8, 0, 0, values.itemsize, 0, 8 * values.itemsize), "u": struct.pack("<B3BIHH", 0x10, 0, 0, 0, values.itemsize, 0, 8 * values.itemsize)}[values.dtype.kind]
    names = {hdf5.DEFLATE: (b"deflate\0", (6,)), hdf5.SHUFFLE: (b"shuffle\0", (values.itemsize,)), hdf5.CHECKSUM: (b"", ())}
    pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<4H", f, len(names[f][0]), 0, len(names[f][1])) + names[f][0] + struct.pack(f"<{len(names[f][1])}I", *names[f][1]) + bytes(4 * (len(names[f][1]) % 2)) for f in filters)
    fills = struct.pack("<4BI", 2, 3, 2, 1, values.itemsize) + np.array(fill, values.dtype).tobytes() if fill is not None else struct.pack("<4BI", 2, 3, 2, 1, 0)
    messages = [(hdf5.DATASPACE, struct.pack(f"<BBB5x{rank}Q", 1, rank, 0, *values.shape)), (hdf5.DATATYPE, kind), (hdf5.FILL, fills), (hdf5.LAYOUT, struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, tree, *chunk, values.itemsize))]
    messages += [(hdf5.FILTERS, pipeline)] if filters else []
    body = b"".join(struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for k, d in messages)
    dataset = put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)
    heap = put(struct.pack("<4sB3xQQQ", b"HEAP", 0, 16, 1, put(bytes(8) + b"a" + bytes(7))))
    leaf = put(struct.pack("<4sBxH", b"SNOD", 1, 1) + struct.pack("<QQI4x16x", 8, dataset, 0) + bytes(40 * 7))
    top = put(struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE, 0, leaf, 8) + bytes(8 * 62))
    root_body = struct.pack("<HHB3xQQ", hdf5.SYMBOLS, 16, 0, top, heap)
    root = put(struct.pack("<BxHII4x", 1, 1, 1, len(root_body)) + root_body)
    out[:96] = hdf5.SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(out), hdf5.NOWHERE) + struct.pack("<QQI4xQQ", 0, root, 1, top, heap)
    return bytes(out)


@pytest.mark.parametrize("kind, filters, levels", [("<f8", (), 1), ("<f4", (hdf5.SHUFFLE, hdf5.DEFLATE), 2), ("<i2", (hdf5.DEFLATE, hdf5.CHECKSUM), 2), ("<u1", (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.CHECKSUM), 1)])
def test_chunked_datasets(spark, tmp_path, kind, filters, levels):
    """Chunks that reach beyond the extents, that are missing and that skip the filters; whole on the driver and by tasks."""
    values = (np.arange(9 * 10 * 11).reshape(9, 10, 11) % 251).astype(kind)
    skip = [(4, 4, 8), (8, 8, 0)]
    data = chunked(values, (4, 4, 8), filters, levels, skip, fill=7, drop_filters=[(0, 4, 0)])
    for z, y, x in skip:
        values[z : z + 4, y : y + 4, x : x + 8] = 7
    assert (hdf5.File(data).read("/a") == values).all()
    (tmp_path / "a.h5").write_bytes(data)
    assert rows(images.load_hdf5(spark, f"{tmp_path}/a.h5:/a")) == cells(values)
    read = lambda where: volume.read_volume(spark, f"{tmp_path}/a.h5", "hdf5", 2 * 128, "/a").filter(where)
    for where, parts in [("z = 5", 3), ("z between 3 and 4 and y < 2", 2), ("z = 8 and y >= 8", 1), ("x = 10", 9), ("y = 99", 1)]:
        every = spark.createDataFrame([(*k, v) for k, v in cells(values).items()], volume.SCHEMA).filter(where)
        assert rows(read(where)) == rows(every) and read(where).rdd.getNumPartitions() <= parts, where


def test_planes_contiguous_and_unwritten(spark, tmp_path):
    values = np.arange(30.0).reshape(5, 6)
    (tmp_path / "a.h5").write_bytes(chunked(values.astype("<f4"), (2, 4), (hdf5.DEFLATE,)))
    hdf5.add(f"{tmp_path}/b.h5", {"/a": values, "/line": np.ones(3)}, fresh=True)
    for name in "ab":
        assert rows(images.load_hdf5(spark, f"{tmp_path}/{name}.h5:/a")) == cells(values[None])
    assert volume.read_volume(spark, f"{tmp_path}/b.h5", "hdf5", 12, "/a").filter("y = 3").rdd.getNumPartitions() == 1
    (tmp_path / "c.h5").write_bytes(chunked(values, (2, 4), (), skip=list(product(range(0, 5, 2), range(0, 6, 4))), fill=2))
    assert rows(images.load_hdf5(spark, f"{tmp_path}/c.h5:/a")) == cells(np.full((1, 5, 6), 2.0))
    for spec in ("b.h5:/line", "b.h5:/none", "b.h5"):
        with pytest.raises(LoaderError):
            images.load_hdf5(spark, f"{tmp_path}/{spec}")
    bad = bytearray(chunked(values, (2, 4), (hdf5.DEFLATE,)))
    at = bad.index(b"deflate") - 8
    bad[at : at + 2] = struct.pack("<H", 32000)
    with pytest.raises(LoaderError):
        hdf5.File(bytes(bad)).read("/a")
