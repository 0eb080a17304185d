"""From settings to files: one registration, comparisons of result files, and suites of them with reports."""

from __future__ import annotations

import configparser
import html
import os
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridError, Shape
from ..operators.landmarks import displacement_at, inverse_map
from ..operators.mapgrid import node_locations
from ..operators.metrics import BINS, compare_registration, equal_histogram, map_r2, registration_pairs
from ..session import checkpoint
from ..sources import plots, png, sinks
from ..sources.config import Settings, from_file
from ..sources.errors import ConfigError, LoaderError, WriterError
from ..sources.images import find_loader, load_image, load_map, read_landmarks
from .register import Options, Result, register

#: What a run may fail with for reasons of files and settings.
EXPECTED = (ConfigError, GridError, LoaderError, WriterError, FileNotFoundError)
NAME = "pair"


def shape_of(image: DataFrame) -> Shape:
    return Shape(*(int(e) + 1 for e in image.agg(*(F.max(a) for a in AXES)).first()))


def with_group(spec: str, group: str) -> str:
    """A group that the file's own name gives comes before the one set apart."""
    return spec if ":" in spec else f"{spec}:{group}"


def resolved(settings: Settings, folder: str = ".") -> Settings:
    """All paths absolute, since executors and Java work in folders of their own; relative ones are those of a folder."""
    absolute = {k: os.path.abspath(os.path.join(folder, v)) for k in ("fixed", "moved", "mask", "registered", "map") if (v := getattr(settings, k))}
    return replace(settings, **absolute)


def run(spark: SparkSession, settings: Settings, say: Callable[[str], None] = print, compat: bool = False, folder: str = ".") -> Result:
    """Load, register and save; relative paths are those of a folder.

    With ``compat`` the settings that the older program takes but does not follow have no effect: lambda, lambda_mult,
    with_memory, max_iterations (50 rounds a level) and mask.
    """
    began, settings = time.time(), resolved(settings, folder)
    fixed = checkpoint(load_image(spark, settings.fixed))
    moved = checkpoint(load_image(spark, settings.moved, like=fixed))
    mask = checkpoint(find_loader(spark, settings.mask)) if settings.mask and not compat else None
    shape = shape_of(fixed)
    options = Options(compat=True) if compat else Options(settings.factor, settings.lambda_mult, settings.with_memory, settings.max_iterations)
    stem, extension = os.path.splitext(os.path.basename(sinks.split_spec(settings.registered)[0]))
    map_extension = os.path.splitext(sinks.split_spec(settings.map)[0])[1]
    folder = sinks.frame_folder(settings.intermediate_directory, sinks.split_spec(settings.registered)[0]) if settings.save_intermediate_frames else ""
    told = 0

    def watch(level: int, iteration: int, state: Result) -> None:
        nonlocal told
        for m in state.metrics[told:] if settings.verbose else ():
            say(f"level {m['level']} (spacing {m['spacing']}), round {m['iteration']}: mutual information {m['mi']:.6f}, change {m['avg_delta']:.4f} (at most {m['max_delta']:.4f}), lambda {m['lam']:.4g}")
        told = len(state.metrics)
        if folder:
            frame = sinks.frame_path(settings.intermediate_template, stem, level, iteration, extension)
            sinks.write_image(state.registered, shape, with_group(os.path.join(folder, frame), settings.registered_h5_path))
            frame = sinks.frame_path(settings.intermediate_map_template, stem, level, iteration, map_extension)
            sinks.write_map(state.displacement(compat), shape, state.spacing, with_group(os.path.join(folder, frame), settings.map_h5_path), not compat)

    named = lambda df: df.withColumn("pair_id", F.lit(NAME))
    result = register(named(fixed), named(moved), shape, settings.nodespacing, options, mask, watch=watch)
    sinks.write_image(result.registered, shape, with_group(settings.registered, settings.registered_h5_path))
    say(f"Saved registered image to {with_group(settings.registered, settings.registered_h5_path)}")
    sinks.write_map(result.displacement(compat), shape, result.spacing, with_group(settings.map, settings.map_h5_path), not compat)
    say(f"Saved map to {with_group(settings.map, settings.map_h5_path)}")
    say(f"Elapsed time: {time.time() - began:.1f} s")
    return result


def images_of(spark: SparkSession, fixed: str, moved: str, accepted: str, result: str) -> DataFrame:
    """(x, y, z, fixed, moved, accepted, result) of four image files."""
    images = None
    for name, path in (("fixed", fixed), ("moved", moved), ("accepted", accepted), ("result", result)):
        one = load_image(spark, path).select(*AXES, F.col("v").alias(name))
        images = one if images is None else images.join(one, [*AXES])
    return images


def compare_image_files(spark: SparkSession, fixed: str, moved: str, accepted: str, result: str) -> DataFrame:
    """(pair_id, h1, h2, mi_bits, proficiency): four comparisons of image files."""
    return compare_registration(images_of(spark, fixed, moved, accepted, result))


def maps_of(spark: SparkSession, accepted: str, result: str) -> DataFrame:
    """(node, dof, a, b): displacements of two map files on the same nodes."""
    side = lambda path, name: load_map(spark, path)[0].filter("dof > 0").select("node", "dof", F.col("value").alias(name))
    return side(accepted, "a").join(side(result, "b"), ["node", "dof"])


def compare_map_files(spark: SparkSession, accepted: str, result: str) -> DataFrame:
    """(dof, r2) of the displacements of two map files on the same nodes."""
    return map_r2(maps_of(spark, accepted, result))


def histogram_figures(rows: list, names: dict, bins: int) -> list[str]:
    """A figure for each name, from rows (name's key, column, row, count); their number is bounded by the bins."""
    counts: dict = defaultdict(dict)
    for key, column, row, n in rows:
        counts[key][column, row] = n
    return [plots.figure(caption, plots.histogram_image(counts[key], bins)) for key, caption in names.items()]


def overlay_files(spark: SparkSession, fixed: str, moved: str, output: str, flip: bool = False) -> None:
    """A PNG of the first plane of one image in grey and of another, of its shape, in red."""
    below = load_image(spark, fixed)
    above = load_image(spark, moved, like=below)
    shape = shape_of(below)
    with open(output, "wb") as f:
        f.write(plots.overlay(sinks.plane(below, shape), sinks.plane(above, shape), flip))


def map_grid(axes: DataFrame, shape: Shape) -> tuple[int, bool]:
    """Spacing of a map's nodes, and whether they cover the image."""
    found = [[r.loc for r in axes.filter(F.col("dim") == d).orderBy("idx").collect()] for d in range(shape.ndim)]
    several = [x for x in found if len(x) > 1]
    if not several:
        raise GridError("a map of one node has no spacing")
    spacing = round(several[0][1] - several[0][0])
    for cover in (True, False):
        own = [node_locations(e, spacing, cover) for e in shape.extents[: shape.ndim]]
        if all(len(x) == len(o) and np.allclose(x, o) for x, o in zip(found, own, strict=True)):
            return spacing, cover
    raise GridError("the nodes of the map are not those of the image")


def plot_map(spark: SparkSession, image: str, map_file: str, output: str, landmarks: str = "", invert: bool = False, flip: bool = False) -> None:
    """An SVG of a plane image, the displacements at the map's nodes and, in another colour, at landmarks of a CSV file.

    With ``invert`` the map that undoes the file's is drawn.
    """
    below = load_image(spark, image)
    shape = shape_of(below)
    if shape.ndim != 2:
        raise GridError("maps of volumes can't be drawn")
    values, axes = load_map(spark, map_file)
    spacing, cover = map_grid(axes, shape)
    values = values.select("node", "dof", "value")
    if invert:
        values = inverse_map(values, shape, spacing, cover=cover)
    xs, ys = (np.array(node_locations(e, spacing, cover)) for e in (shape.nx, shape.ny))
    moves = np.stack([sinks.dense(values.filter(F.col("dof") == k), ["node"], "value", (len(ys), len(xs))).ravel() for k in (1, 2)], 1)
    grid = np.stack(np.meshgrid(xs, ys), -1).reshape(-1, 2)
    parts = [plots.arrows(grid, moves, "red")]
    if landmarks:
        points = read_landmarks(spark, landmarks).withColumn("z", F.lit(0))
        found = displacement_at(points, values, shape, spacing, key=("lm_id", "x", "y"), cover=cover)
        # As many as a person marks by hand.
        marks = np.array([(r.x, r.y, r.d1, r.d2) for r in found.collect()], float).reshape(-1, 4)
        parts.append(plots.arrows(marks[:, :2], marks[:, 2:], "blue"))
    with open(output, "w", encoding="utf-8") as f:
        f.write(plots.drawing(png.encode(sinks.plane(below, shape)), (shape.nx, shape.ny), parts, flip))


def read_test(path: str) -> dict[str, str]:
    """A test: type, name, accepted_image and accepted_map, and the settings' file under a key that ends in _config."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    with open(path, encoding="utf-8") as f:
        parser.read_string(f"[all]\n{f.read()}")
    found = {k: v.strip().strip("\"'") for k, v in parser["all"].items()}
    kind = found.get("type", "").lower()
    if kind not in ("regression", "comparison"):
        raise ConfigError(f"{path}: type must be regression or comparison, not {kind!r}")
    if not ({"accepted_image", "accepted_map"} & set(found)):
        raise ConfigError(f"{path} names no accepted result")
    settings = [v for k, v in found.items() if k.endswith("_config")]
    if not settings:
        raise ConfigError(f"{path} names no file of settings")
    beside = lambda p: os.path.join(os.path.dirname(path), p)
    name = found.get("name") or os.path.splitext(os.path.basename(path))[0]
    return {"name": name, "settings": beside(settings[0])} | {k: beside(found[k]) for k in ("accepted_image", "accepted_map") if k in found}


def run_test(spark: SparkSession, test: dict[str, str], folder: str, say: Callable[[str], None] = print) -> dict[str, float]:
    """Run a test's registration in its settings' folder; its measures, also written as a page."""
    at = os.path.dirname(os.path.abspath(test["settings"]))
    settings = resolved(from_file(test["settings"]), at)
    run(spark, settings, say)
    measures: dict[str, float] = {}
    figures: list[str] = []
    if "accepted_image" in test:
        images = checkpoint(images_of(spark, settings.fixed, settings.moved, os.path.abspath(test["accepted_image"]), with_group(settings.registered, settings.registered_h5_path)))
        own = {r.pair_id: r.proficiency for r in compare_registration(images).orderBy("pair_id").collect()}
        measures |= {f"proficiency {k}": v for k, v in own.items()}
        rows = equal_histogram(registration_pairs(images), ("pair_id",)).collect()
        figures += histogram_figures(rows, {k: f"joint histogram {k}, proficiency {v:.3f}" for k, v in own.items()}, BINS - 1)
    if "accepted_map" in test:
        both = checkpoint(maps_of(spark, os.path.abspath(test["accepted_map"]), with_group(settings.map, settings.map_h5_path)))
        found = {r.dof: r.r2 for r in map_r2(both).orderBy("dof").collect()}
        measures |= {f"map r2 {AXES[k - 1]}": v for k, v in found.items()}
        figures += histogram_figures(plots.value_bins(both, BINS).collect(), {k: f"displacements along {AXES[k - 1]}: accepted across, result up" for k in found}, BINS)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{test['name']}.html"), "w", encoding="utf-8") as f:
        f.write(sinks.report(test["name"], [{"measure": k, "value": v} for k, v in measures.items()], tuple(figures)))
    return measures


def run_tests(spark: SparkSession, search: str, folder: str, say: Callable[[str], None] = print) -> dict[str, dict[str, float]]:
    """All ``*.testconf`` files below a folder, and a page that links their reports; tests that can't be read are told and passed over."""
    out: dict[str, dict[str, float]] = {}
    for path in sorted(os.path.join(d, n) for d, _, names in os.walk(search) for n in names if n.endswith(".testconf")):
        try:
            test = read_test(path)
            out[test["name"]] = run_test(spark, test, folder, say)
        except EXPECTED as e:
            say(f"Error in {path}: {e}")
    os.makedirs(folder, exist_ok=True)
    links = "".join(f'<li><a href="{html.escape(n)}.html">{html.escape(n)}</a></li>' for n in out)
    with open(os.path.join(folder, "report.html"), "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><title>Results</title><h1>Results</h1><ul>{links}</ul>")
    return out
