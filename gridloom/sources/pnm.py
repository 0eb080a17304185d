"""Binary greymaps and pixmaps (P5, P6) of 8 and 16 bits; channel 0 counts."""

from __future__ import annotations

import re

import numpy as np

from .errors import LoaderError

HEADS = (b"P5", b"P6")
#: Three numbers, between them blanks or comments; one blank before the pixels.
HEADER = re.compile(rb"P[56](?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """Channel 0 as values[y, x] from 0 to 1."""
    found = HEADER.match(data)
    if not found:
        raise LoaderError("no binary greymap or pixmap")
    nx, ny, most = (int(x) for x in found.groups())
    channels = 3 if data[:2] == b"P6" else 1
    kind = np.dtype(">u2" if most > 255 else "u1")
    if not 0 < most < 65536 or len(data) - found.end() < nx * ny * channels * kind.itemsize:
        raise LoaderError("the map is cut short")
    return np.frombuffer(data, kind, nx * ny * channels, found.end()).reshape(ny, nx, channels)[:, :, 0] / most
