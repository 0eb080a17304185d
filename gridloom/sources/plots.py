"""Pictures of results, without a plotting library: joint histograms and overlays as PNG, maps and landmarks as SVG.

Sizes are those of the pixels; y goes up, as in a diagram, unless a picture is flipped to count rows from the top.
"""

from __future__ import annotations

import base64
import html

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import png

#: Pixels of a picture's side for each bin of a histogram.
CELL = 4


def data_uri(image: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(image).decode()


def figure(caption: str, image: bytes) -> str:
    return f'<figure><img alt="{html.escape(caption)}" src="{data_uri(image)}"><figcaption>{html.escape(caption)}</figcaption></figure>'


def histogram_image(counts: dict[tuple[int, int], int], bins: int) -> bytes:
    """Counts by (column, row) as grey, black where there are none and white at the most; row 0 is at the bottom."""
    grey = np.zeros((bins, bins))
    for (column, row), n in counts.items():
        grey[bins - 1 - row, column] = n
    grey /= max(1.0, grey.max())
    return png.encode(np.repeat(np.repeat(grey, CELL, 0), CELL, 1))


def value_bins(both: DataFrame, bins: int) -> DataFrame:
    """(dof, ba, bb, c) of values a and b: equal bins between the least and the largest of both, all rows counted."""
    ends = both.groupBy("dof").agg(F.least(F.min("a"), F.min("b")).alias("low"), F.greatest(F.max("a"), F.max("b")).alias("high"))
    share = lambda c: F.coalesce((F.col(c) - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    bin_of = lambda c: F.least(F.lit(bins - 1), F.floor(share(c) * bins)).cast("int")
    return both.join(F.broadcast(ends), "dof").groupBy("dof", bin_of("a").alias("ba"), bin_of("b").alias("bb")).agg(F.count("*").alias("c"))  # ends: a row a dof


def overlay(fixed: np.ndarray, moved: np.ndarray, flip: bool = False) -> bytes:
    """One image in grey and another in red over it, half and half; both values[y, x] from 0 to 1."""
    colours = np.stack([(fixed + moved) / 2, fixed / 2, fixed / 2], 2)
    return png.encode_colour(colours if flip else colours[::-1])


def arrows(start: np.ndarray, move: np.ndarray, colour: str) -> str:
    """Lines from points (x, y) along their displacements, with a dot at each point."""
    lines = "".join(f'<line x1="{x:.6g}" y1="{y:.6g}" x2="{x + dx:.6g}" y2="{y + dy:.6g}"/>' for (x, y), (dx, dy) in zip(start.tolist(), move.tolist(), strict=True))
    dots = "".join(f'<circle cx="{x:.6g}" cy="{y:.6g}" r="0.8" fill="{colour}"/>' for x, y in start.tolist())
    return f'<g stroke="{colour}" stroke-width="0.5">{lines}</g><g>{dots}</g>'


def drawing(background: bytes, extents: tuple[int, int], parts: list[str], flip: bool = False) -> str:
    """An SVG of an image whose first row is row 0, with drawings in its coordinates; pixel centres are whole numbers."""
    nx, ny = extents
    turn = "translate(0.5 0.5)" if flip else f"translate(0.5 {ny - 0.5:g}) scale(1 -1)"
    image = f'<image x="-0.5" y="-0.5" width="{nx}" height="{ny}" preserveAspectRatio="none" href="{data_uri(background)}"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{nx}" height="{ny}" viewBox="0 0 {nx} {ny}"><g transform="{turn}">{image}{"".join(parts)}</g></svg>'
