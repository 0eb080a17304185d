"""Files of HDF5, TIFF and JPEG, and whole registrations from settings to files."""

import base64
import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.__main__ import main
from gridloom.functions.grid import GridError, Shape
from gridloom.operators.mapgrid import map_nodes
from gridloom.plans import program
from gridloom.sources import hdf5, images, plots, png, sinks, tiff
from gridloom.sources.config import Settings, from_file
from gridloom.sources.errors import ConfigError, LoaderError
from gridloom.sources.volume import write_volume


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abcxyz", min_size=1, max_size=9), st.lists(st.integers(0, 4), min_size=1, max_size=3), max_size=40), st.randoms())
def test_hdf5_round_trip(sizes, rng):
    datasets = {f"/{'g/' * (k % 3)}d{name}": np.array([rng.random() for _ in range(int(np.prod(s)))]).reshape(s) for k, (name, s) in enumerate(sizes.items())}
    found = hdf5.File(hdf5.encode(datasets))
    assert sorted(found.names()) == sorted(datasets)
    for name, values in datasets.items():
        assert found.read(name).shape == values.shape and (found.read(name) == values).all()


def test_hdf5_bytes_of_the_format():
    data = hdf5.encode({"/a": np.array([1.0, 2.0])})
    assert data[:8] == b"\x89HDF\r\n\x1a\n" and data[13:15] == b"\x08\x08" and int.from_bytes(data[40:48], "little") == len(data)
    # A little-endian double as the format's library describes it.
    assert bytes.fromhex("11203f000800000000004000340b0034ff030000") in data
    assert data.count(b"TREE") == data.count(b"SNOD") == data.count(b"HEAP") == 1 and np.array([1.0, 2.0]).tobytes() in data
    for bad in (b"", data[:50], b"x" * 200):
        with pytest.raises(LoaderError):
            hdf5.File(bad)
    with pytest.raises(LoaderError):
        hdf5.File(data).read("/b")
    with pytest.raises(LoaderError):
        hdf5.File(data[: len(data) // 2]).read("/a")
    with pytest.raises(ValueError):
        hdf5.encode({"/a": np.ones(1), "/a/b": np.ones(1)})


def test_hdf5_adds_datasets(tmp_path):
    path = f"{tmp_path}/a.h5"
    hdf5.add(path, {"/one": np.ones(2), "/map/x": np.ones(3)}, fresh=True)
    hdf5.add(path, {"/two": np.zeros(2), "/map": np.ones(1)}, fresh=False)
    found = hdf5.File(open(path, "rb").read())
    assert found.names() == ["/map", "/one", "/two"]
    hdf5.add(path, {"/three": np.ones(1)}, fresh=True)
    assert hdf5.File(open(path, "rb").read()).names() == ["/three"]


@given(st.integers(1, 9), st.integers(1, 9))
def test_tiff_round_trip(nx, ny):
    values = np.arange(nx * ny).reshape(ny, nx) / 65535 * 7
    assert np.allclose(tiff.decode(tiff.encode(values)), values, atol=1e-9)
    with pytest.raises(LoaderError):
        tiff.decode(tiff.encode(values)[:-20])


@pytest.mark.parametrize("extension, close", [(".tiff", 1e-4), (".jpg", 0.03), (".h5", 1e-12), (".xdmf", 1e-12), (".png", 1e-4)])
def test_images_come_back(spark, tmp_path, extension, close):
    values = np.add.outer(np.arange(12), np.arange(16)).astype(float)[None]
    write_volume(f"{tmp_path}/a.image", values)
    image = images.load_image(spark, f"{tmp_path}/a.image")
    sinks.write_image(image, Shape(16, 12), f"{tmp_path}/b{extension}")
    found = images.find_loader(spark, f"{tmp_path}/b{extension}").toPandas().sort_values(["z", "y", "x"])["v"].to_numpy()
    assert np.abs(found - values.ravel() / 26).max() < close


def blob(at: float) -> np.ndarray:
    y, x = np.mgrid[0:24, 0:24]
    return np.exp(-((x - at) ** 2 + (y - 11.5) ** 2) / 30)[None]


def test_a_run_from_settings_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    write_volume("f.image", blob(11.5))
    write_volume("m.image", blob(13.0))
    (tmp_path / "run.conf").write_text("fixed = f.image\nmoved = m.image\nnodespacing = 12\nlambda = 5\nmax_iterations = 2\nregistered = out.h5\nmap = out.h5\nsave_intermediate_frames = true\nverbose = true\n")
    said: list[str] = []
    result = program.run(spark, from_file("run.conf"), said.append)
    found = hdf5.File((tmp_path / "out.h5").read_bytes())
    assert set(found.names()) == {"/registered", "/map/x", "/map/y", "/map/nodes_x", "/map/nodes_y"}
    fixed, moved, registered = blob(11.5), blob(13.0), found.read("/registered")
    assert np.abs(registered - fixed).mean() < 0.6 * np.abs(moved - fixed).mean()
    frames = sorted(os.listdir(tmp_path / "intermediates"))
    assert "out-intermediate-00-000.h5" in frames and "out-intermediate-map-00-001.h5" in frames
    assert any(s.startswith("level 0") for s in said) and said[-1].startswith("Elapsed")
    values, axes = images.load_map(spark, "out.h5:/map")
    assert axes.count() == 6 and values.count() == 2 * 9
    written = {(r.node, r.dof): r.value for r in result.displacement().filter("dof > 0").collect()}
    assert {(r.node, r.dof): r.value for r in values.collect()} == written
    # Each against itself: all entropy is shared, all variance explained.
    out, f, m = (f"{tmp_path}/{n}" for n in ("out.h5", "f.image", "m.image"))
    four = {r.pair_id: r.proficiency for r in program.compare_image_files(spark, f, m, f"{out}:/registered", f"{out}:/registered").collect()}
    assert abs(four["accepted/result"] - 1) < 1e-9 and four["result/fixed"] > four["fixed/moved"]
    assert all(abs(r.r2 - 1) < 1e-9 for r in program.compare_map_files(spark, f"{out}:/map", f"{out}:/map").collect())


def test_suites_and_reports(spark, tmp_path):
    write_volume(f"{tmp_path}/f.image", blob(11.5))
    write_volume(f"{tmp_path}/m.image", blob(12.5))
    (tmp_path / "run.conf").write_text("fixed = f.image\nmoved = m.image\nnodespacing = 12\nlambda = 5\nmax_iterations = 1\n")
    (tmp_path / "a.testconf").write_text("type = regression\nname = first\nrun_config = run.conf\naccepted_image = f.image\naccepted_map = map.xdmf\n")
    (tmp_path / "b.testconf").write_text("type = other\n")
    said: list[str] = []
    found = program.run_tests(spark, str(tmp_path), f"{tmp_path}/reports", said.append)
    assert list(found) == ["first"] and abs(found["first"]["proficiency accepted/fixed"] - 1) < 1e-9
    assert 'href="first.html"' in (tmp_path / "reports/report.html").read_text() and "proficiency" in (tmp_path / "reports/first.html").read_text()
    assert any("b.testconf" in s for s in said)
    # Four joint histograms, and one picture for each component of the map, which is compared with itself.
    page = (tmp_path / "reports/first.html").read_text()
    assert page.count("<figure>") == 6 and abs(found["first"]["map r2 x"] - 1) < 1e-9
    last = base64.b64decode(page.split("base64,")[-1].split('"')[0])
    on = png.decode(last)[:: plots.CELL, :: plots.CELL] > 0
    assert on.shape == (50, 50) and on[::-1].sum() == np.diag(on[::-1]).sum() > 1


@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(1, 9), max_size=9))
def test_histogram_images(counts):
    grey = png.decode(plots.histogram_image(counts, 5))[:: plots.CELL, :: plots.CELL]
    for column in range(5):
        for row in range(5):
            assert abs(grey[4 - row, column] - counts.get((column, row), 0) / max([1, *counts.values()])) < 1e-4


def test_overlays(spark, tmp_path, capsys):
    fixed, moved = blob(11.5)[0], blob(13.0)[0]
    fixed[0, 0] = moved[0, 0] = 0
    write_volume(f"{tmp_path}/f.image", fixed[None])
    write_volume(f"{tmp_path}/m.image", moved[None])
    assert main(["overlay", f"{tmp_path}/f.image", f"{tmp_path}/m.image", f"{tmp_path}/o.png", "--flip"]) == 0
    red = png.decode((tmp_path / "o.png").read_bytes())
    assert np.abs(red - (fixed / fixed.max() + moved / moved.max()) / 2).max() < 0.003
    assert main(["overlay", f"{tmp_path}/f.image", f"{tmp_path}/m.image", f"{tmp_path}/p.png"]) == 0
    assert (png.decode((tmp_path / "p.png").read_bytes()) == red[::-1]).all()
    assert main(["overlay", "a"]) == 2 and main(["overlay", f"{tmp_path}/none", f"{tmp_path}/f.image", f"{tmp_path}/q.png"]) == 1


@pytest.mark.parametrize("cover", [False, True])
def test_plots_of_maps(spark, tmp_path, cover):
    nx, ny = 24, 20
    shape = Shape(nx, ny, 1)
    write_volume(f"{tmp_path}/f.image", np.ones((1, ny, nx)) * np.linspace(0.1, 1, nx))
    nodes = [(r.node, r.lx, r.ly) for r in map_nodes(spark, shape, 8, cover).collect()]
    rows = [(n, k, v) for n, x, y in nodes for k, v in ((0, 0.0), (1, 1.0 + x / 16), (2, -0.5))]
    sinks.write_map(spark.createDataFrame(rows, "node int, dof int, value double"), shape, 8, f"{tmp_path}/m{cover}.h5:/map", cover)
    (tmp_path / "l.csv").write_text("id,x,y\n1,10,10\n2,12,11\n")
    program.plot_map(spark, f"{tmp_path}/f.image", f"{tmp_path}/m{cover}.h5:/map", f"{tmp_path}/o.svg", f"{tmp_path}/l.csv")
    svg = ET.parse(tmp_path / "o.svg").getroot()
    lines = [tuple(float(x.get(k)) for k in ("x1", "y1", "x2", "y2")) for x in svg.iter("{http://www.w3.org/2000/svg}line")]
    want = [(x, y, x + 1 + x / 16, y - 0.5) for _, x, y in nodes] + [(x, y, x + 1 + x / 16, y - 0.5) for x, y in ((10, 10), (12, 11))]
    assert np.allclose(sorted(lines), sorted(want), atol=1e-4)
    with pytest.raises(GridError):
        write_volume(f"{tmp_path}/g.image", np.ones((1, ny, nx + 40)))
        program.plot_map(spark, f"{tmp_path}/g.image", f"{tmp_path}/m{cover}.h5:/map", f"{tmp_path}/o.svg")


def test_settings_of_smoothing_and_errors(capsys, tmp_path):
    assert Settings("f", "m", 1).factor is None and Settings("f", "m", 1, with_lambda="2.5").factor == 2.5
    with pytest.raises(ConfigError):
        _ = Settings("f", "m", 1, with_lambda="much").factor
    assert main([]) == 0 and main(["register", "help"]) == 0 and main(["test"]) == 2
    assert main([f"{tmp_path}/none.conf"]) == 1 and main(["register", "fixed", "a"]) == 1
    assert "missing" in capsys.readouterr().err
