"""Files of every kind that is read or written, settings and streams."""

import struct
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import GridError, Shape
from gridloom.operators import mapgrid as M
from gridloom.sources import config, dicom, hdf5, images, png, pnm, sinks, tiff, volume
from gridloom.sources.errors import ConfigError, LoaderError, WriterError
from gridloom.streaming import frames


def values_of(df, shape):
    out = np.zeros((shape.nz, shape.ny, shape.nx))
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


def test_volumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(volume, "PARTITION_VALUES", 16)
    shape = Shape(5, 4, 3)
    data = np.arange(60.0).reshape(3, 4, 5)
    volume.write_volume(f"{tmp_path}/a.image", data)
    df = images.load_image(spark, f"{tmp_path}/a.image")
    assert np.allclose(values_of(df, shape), data / 59)
    volume.write_volume(f"{tmp_path}/a.mask", data > 9, "mask")
    assert values_of(images.find_loader(spark, f"{tmp_path}/a.mask"), shape).sum() == 50
    with pytest.raises(FileNotFoundError):
        images.load_image(spark, f"{tmp_path}/none.image")
    (tmp_path / "b.image").write_bytes(struct.pack("<4i", 5, 4, 3, 3) + bytes(240))
    with pytest.raises(LoaderError):
        images.load_image(spark, f"{tmp_path}/b.image")
    with pytest.raises(GridError):
        images.load_image(spark, f"{tmp_path}/a.image", like=df.filter("x < 2"))
    with pytest.raises(LoaderError):
        images.register_loader("png")(None)


def test_png(spark, tmp_path):
    draw = np.random.default_rng(0)
    data = draw.random((7, 9))
    (tmp_path / "a.png").write_bytes(png.encode(data))
    found = values_of(images.find_loader(spark, f"{tmp_path}/a.png"), Shape(9, 7))[0]
    assert np.abs(found - data).max() < 1e-5
    # Each filter, on 8-bit colour.
    pixels = draw.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    lines, above = [], np.zeros(12, int)
    for kind, line in enumerate(pixels.reshape(5, 12).astype(int)):
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        best = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([kind]) + bytes(((line - [0, left, above, (left + above) // 2, best][kind]) % 256).astype(np.uint8)))
        above = line
    import zlib

    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    coded = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.allclose(png.decode(coded), pixels[:, :, 0] / 255)
    with pytest.raises(LoaderError):
        png.decode(b"GIF89a")


def test_dicom(spark, tmp_path):
    short = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    raw = np.arange(12, dtype="<u2")
    body = short(0x28, 2, 1) + short(0x28, 0x10, 3) + short(0x28, 0x11, 4) + short(0x28, 0x100, 16) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 24) + raw.tobytes()
    (tmp_path / "a.dcm").write_bytes(bytes(128) + b"DICM" + body)
    found = values_of(images.find_loader(spark, f"{tmp_path}/a.dcm"), Shape(3, 4))
    assert np.allclose(found[0], (np.arange(12).reshape(3, 4) / 11).T)
    with pytest.raises(LoaderError):
        dicom.decode(b"no")


def test_dicom_implicit_with_sequences():
    """The same pixels with implicit value representation, behind sequences of open length."""
    plain = lambda g, e, v: struct.pack("<HHI", g, e, len(v)) + v
    number = lambda g, e, v: plain(g, e, struct.pack("<H", v))
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + number(0x28, 0x10, 99) + struct.pack("<HHI", 8, 9, 0xFFFFFFFF) + plain(0xFFFE, 0xE000, b"abcd") + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    sequence = struct.pack("<HHI", 8, 7, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    syntax = lambda uid: struct.pack("<HH2sH", 2, 0x10, b"UI", len(uid)) + uid
    pixels = np.arange(12, dtype="<u2").tobytes()
    body = sequence + number(0x28, 0x10, 3) + number(0x28, 0x11, 4) + number(0x28, 0x100, 16) + plain(0x7FE0, 0x10, pixels)
    found = dicom.decode(bytes(128) + b"DICM" + syntax(b"1.2.840.10008.1.2\0") + body)
    assert np.allclose(found[0], (np.arange(12).reshape(3, 4) / 11).T)
    for wrong in (syntax(b"1.2.840.10008.1.2.4.50") + body, syntax(b"1.2.840.10008.1.2\0") + sequence[:-9]):
        with pytest.raises(LoaderError):
            dicom.decode(bytes(128) + b"DICM" + wrong)


def pack_lzw(data: bytes) -> bytes:
    """The format's encoder, for tests."""
    table, bits, n, width = {bytes([k]): k for k in range(256)}, 256, 9, 9
    size, word = 258, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        put(table[word])
        table[word + bytes([c])] = size
        size, word = size + 1, bytes([c])
        width = size.bit_length()
        if size == 4094:
            put(table[word])
            put(256)
            table, size, width, word = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if word:
        put(table[word])
        width = (size + 1).bit_length()
    put(257)
    return (bits << -n % 8).to_bytes(-(-n // 8), "big")


def test_tiff_packings():
    import random

    draw = random.Random(1)
    for n in (0, 1, 5, 300, 30_000):
        data = bytes(draw.choice(b"aaab") for _ in range(n))
        assert tiff.unpack_lzw(pack_lzw(data)) == data
    assert tiff.unpack_bits(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128, 0]) + b"y") == b"abcxxxy"
    with pytest.raises(LoaderError):
        tiff.unpack_lzw(b"\xff" * 9)


def test_pnm():
    assert np.allclose(pnm.decode(b"P6 # c\n2 1 # d\n255\n" + bytes([255, 1, 2, 51, 9, 9])), [[1, 0.2]])
    assert np.allclose(pnm.decode(b"P5 1 2 1000\n" + struct.pack(">2H", 1000, 250)), [[1], [0.25]])
    for wrong in (b"P5 2 2 255\nabc", b"P4 1 1 1\n", b"P5 1 1 0\nx"):
        with pytest.raises(LoaderError):
            pnm.decode(wrong)


def test_sinks(spark, tmp_path):
    shape = Shape(6, 4)
    df = spark.createDataFrame([(x, y, 0, (x + y) / 8) for x in range(6) for y in range(4)], "x int, y int, z int, v double")
    sinks.write_image(df, shape, f"{tmp_path}/a.png")
    assert abs(values_of(images.find_loader(spark, f"{tmp_path}/a.png"), shape) - values_of(df, shape)).max() < 1e-5
    sinks.write_image(df, shape, f"{tmp_path}/a.parquet:/one")
    sinks.write_image(df.withColumn("v", F.lit(0.0)), shape, f"{tmp_path}/a.parquet:/two")
    assert spark.read.parquet(f"{tmp_path}/a.parquet").filter("dataset = 'one'").agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    assert {r.dataset for r in spark.read.parquet(f"{tmp_path}/a.parquet").select("dataset").distinct().collect()} == {"one", "two"}
    sinks.write_image(df, shape, f"{tmp_path}/a.xdmf")
    root = ET.parse(f"{tmp_path}/a.xdmf").getroot()
    assert root.find(".//Topology").get("Dimensions") == "2 5 7" and hdf5.File((tmp_path / "a.xdmf.h5").read_bytes()).read("/registered").ravel()[1] == 1 / 8
    with pytest.raises(WriterError):
        sinks.write_image(df, shape, f"{tmp_path}/a.doc")
    assert sinks.split_spec("a:b:c") == ("a", "b:c") and sinks.split_spec("a") == ("a", "")


def test_map_components(spark, tmp_path):
    shape = Shape(150, 100, 50)
    values = M.zero_map(spark, shape, 30).withColumn("value", F.col("dof").cast("double"))
    assert M.map_shape(shape, 30).extents == (6, 4, 3)
    sinks.write_map(values, shape, 30, f"{tmp_path}/map")
    found, axes = images.load_map(spark, f"{tmp_path}/map")
    assert {(r.component, r.value) for r in found.select("component", "value").distinct().collect()} == {("intensity", 0.0), ("x", 1.0), ("y", 2.0), ("z", 3.0)}
    assert axes.select("dim", "idx", "loc").count() == 13
    sinks.write_map(values, shape, 30, f"{tmp_path}/map.xdmf")
    assert set(hdf5.File((tmp_path / "map.xdmf.h5").read_bytes()).read("/map/y").ravel()) == {2.0} and "join($0, $1, $2)" in (tmp_path / "map.xdmf").read_text()
    with pytest.raises(WriterError):
        sinks.write_map(values, shape, 30, f"{tmp_path}/map.png")


def test_frames_and_reports(tmp_path):
    assert sinks.frame_path("%name%-%s%-%i%%ext%", "out", 1, 23, ".png") == "out-01-023.png"
    assert sinks.frame_folder("f", f"{tmp_path}/out.png") == f"{tmp_path}/f" and (tmp_path / "f").is_dir()
    with pytest.raises(WriterError):
        sinks.frame_folder("/no/such/folder", "x")
    assert "<td>0.500</td>" in sinks.report("t", [{"a": 0.5, "b": "<"}]) and "&lt;" in sinks.report("t", [{"b": "<"}])


def test_landmarks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# ,X,Y\n1,10,20\n2,30,40\n")
    assert [tuple(r) for r in images.read_landmarks(spark, f"{tmp_path}/a.csv").orderBy("lm_id").collect()] == [(1, 10, 20), (2, 30, 40)]
    df = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, 6.0)], "x int, y int, z int, v double")
    assert [r.v for r in images.rescale_range(df).orderBy("x").collect()] == [0.0, 1.0]


def test_config(tmp_path):
    (tmp_path / "a.conf").write_text("Fixed = a.png\nmoved=b.png\nnodespacing = 10\nlambda = 5\nWITH_MEMORY = False\nodd = 1\n")
    with pytest.warns(UserWarning, match="odd"):
        found = config.from_file(f"{tmp_path}/a.conf")
    assert (found.fixed, found.nodespacing, found.with_lambda, found.with_memory) == ("a.png", 10, "5", False)
    made = config.from_arguments("Register FIXED a moved b NodeSpacing 7 verbose".split())
    assert made.nodespacing == 7 and made.verbose and made.moved == "b"
    for bad in ([], ["other"], "register fixed a moved b".split(), "register fixed a moved b nodespacing x".split(), "register fixed a moved b nodespacing 3 odd 1".split(), "register fixed".split()):
        with pytest.raises(ConfigError):
            config.from_arguments(bad)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    events.write.parquet(f"{tmp_path}/events")
    batch = {tuple(r)[:3]: r.v for r in frames.event_frames(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = frames.write_frames(frames.event_frames(stream), "frames_of_events")
    query.awaitTermination(120)
    found = {tuple(r)[:3]: r.v for r in spark.table("frames_of_events").collect()}
    last = max(k[0] for k in batch)
    assert found and all(batch[k] == pytest.approx(v) for k, v in found.items())
    assert {k for k in batch if k[0] < last} == {k for k in found if k[0] < last}


def test_volume_slabs_are_pruned(spark, tmp_path):
    """Bounds on z and y reach the reader: only their lines are read, in only their partitions."""
    values = np.arange(7 * 6 * 5, dtype="f4").reshape(7, 6, 5)
    path = str(tmp_path / "a.image")
    volume.write_volume(path, values)
    read = lambda where: volume.read_volume(spark, path, partition_values=30).filter(where)
    for where, parts in [("z between 3 and 5", 3), ("z = 2 and y > 3", 1), ("z in (1, 2) and x = 4", 2), ("z > 2 and z < 2", 1), ("y >= 4", 7), ("z >= 5 and v > 190", 2), ("y = 9", 1), ("z > 1.5", 7)]:
        found = read(where)
        every = spark.createDataFrame([(x, y, z, float(values[z, y, x])) for z in range(7) for y in range(6) for x in range(5)], volume.SCHEMA).filter(where)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())), where
        assert found.rdd.getNumPartitions() <= parts, where
    reader = volume.reader(path, "image", "", 30)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("z",), 2), GreaterThan(("y",), 3)]))) == 2
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 5
