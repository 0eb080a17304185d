"""PNG of 8 and 16 bits with zlib only: greyscale, colour, palette and alpha; channel 0 counts."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .errors import LoaderError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.astype(np.int32)
    up = above.astype(np.int32)
    for i in range(len(out)):
        a = out[i - step] if i >= step else 0
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + up[i]) // 2
        else:
            c = up[i - step] if i >= step else 0
            p = a + up[i] - c
            guess = min((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Channel 0 as values[y, x] from 0 to 1."""
    if data[:8] != SIGNATURE:
        raise LoaderError("no PNG signature")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[6]:
        raise LoaderError("PNG of a bit depth or interlacing that is not read")
    nx, ny, depth, colour = head[:4]
    step = CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(ny, 1 + nx * step)
    above, lines = np.zeros(nx * step, np.uint8), []
    for line in raw:
        above = _unfilter(int(line[0]), line[1:], above, step)
        lines.append(above)
    pixels = np.stack(lines).reshape(ny, nx, step)
    if depth == 16:
        return (pixels[:, :, 0].astype(np.float64) * 256 + pixels[:, :, 1]) / 65535
    if colour == 3:
        return palette[pixels[:, :, 0], 0] / 255
    return pixels[:, :, 0] / 255


def encode(values: np.ndarray) -> bytes:
    """16-bit greyscale from values[y, x] in 0 to 1."""
    ny, nx = values.shape
    words = np.floor(np.clip(values, 0, 1) * 65535 + 0.5).astype(">u2")
    return _file(nx, ny, 16, 0, words)


def encode_colour(values: np.ndarray) -> bytes:
    """8 bits each of red, green and blue from values[y, x, channel] in 0 to 1."""
    ny, nx, _ = values.shape
    return _file(nx, ny, 8, 2, np.floor(np.clip(values, 0, 1) * 255 + 0.5).astype(np.uint8))


def _file(nx: int, ny: int, depth: int, colour: int, lines: np.ndarray) -> bytes:
    raw = b"".join(b"\0" + line.tobytes() for line in lines)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", nx, ny, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
