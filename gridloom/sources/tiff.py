"""TIFF of 8 and 16 bits in strips, plain or compressed (LZW, deflate, PackBits); channel 0 of the first page counts."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .errors import LoaderError

#: Fixed values of the format: tags, and sizes of the kinds of numbers that are read (byte, short, long).
WIDTH, LENGTH, BITS, COMPRESSION, COLOUR, OFFSETS, SAMPLES, ROWS, COUNTS, PLANES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
HEADS = (b"II*\0", b"MM\0*")


def unpack_bits(data: bytes) -> bytes:
    """Runs: n from 0 to 127 is followed by n + 1 bytes as they are, n from 129 on by one byte that stands 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 begins the table anew, 257 ends. Codes grow one entry before the table is full."""
    bits = int.from_bytes(data, "big")
    left, width, out = 8 * len(data), 9, bytearray()
    table: list[bytes] = []
    last = b""
    while left >= width:
        code = bits >> (left - width) & ((1 << width) - 1)
        left -= width
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise LoaderError("LZW code without an entry")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


UNPACK = {1: lambda d: d, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode(data: bytes) -> np.ndarray:
    """Channel 0 as values[y, x] from 0 to 1."""
    if data[:4] not in HEADS:
        raise LoaderError("no TIFF signature")
    end = "<" if data[:2] == b"II" else ">"
    try:
        at = struct.unpack_from(f"{end}I", data, 4)[0]
        found: dict[int, tuple[int, ...]] = {}
        for k in range(struct.unpack_from(f"{end}H", data, at)[0]):
            place = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(f"{end}HHI", data, place)
            if kind in SIZES:
                letter, size = SIZES[kind]
                where = place + 8 if n * size <= 4 else struct.unpack_from(f"{end}I", data, place + 8)[0]
                found[tag] = struct.unpack_from(f"{end}{n}{letter}", data, where)
        nx, ny, bits = found[WIDTH][0], found[LENGTH][0], found.get(BITS, (1,))[0]
        samples, colour = found.get(SAMPLES, (1,))[0], found.get(COLOUR, (1,))[0]
        packing, predictor = found.get(COMPRESSION, (1,))[0], found.get(PREDICTOR, (1,))[0]
        if packing not in UNPACK or predictor not in (1, 2) or bits not in (8, 16) or colour not in (0, 1, 2) or (samples > 1 and found.get(PLANES, (1,))[0] != 1):
            raise LoaderError("TIFF of a compression, depth or layout that is not read")
        raw = b"".join(UNPACK[packing](data[a : a + n]) for a, n in zip(found[OFFSETS], found[COUNTS], strict=True))
        values = np.frombuffer(raw, np.dtype(f"{end}u{bits // 8}"), nx * ny * samples).reshape(ny, nx, samples)[:, :, 0]
        if predictor == 2:  # differences along a row
            values = np.cumsum(values.astype(np.int64), axis=1) % 2**bits
        values = values / (2**bits - 1)
    except (struct.error, KeyError, ValueError, zlib.error) as e:
        raise LoaderError("the TIFF file is cut short or lacks a tag") from e
    return 1 - values if colour == 0 else values


def encode(values: np.ndarray) -> bytes:
    """16-bit greyscale from values[y, x] in 0 to 1, in one strip."""
    ny, nx = values.shape
    pixels = np.floor(np.clip(values, 0, 1) * 65535 + 0.5).astype("<u2").tobytes()
    tags = {WIDTH: nx, LENGTH: ny, BITS: 16, COMPRESSION: 1, COLOUR: 1, OFFSETS: 8, SAMPLES: 1, ROWS: ny, COUNTS: len(pixels)}
    body = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in sorted(tags.items()))
    return HEADS[0] + struct.pack("<I", 8 + len(pixels)) + pixels + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0)
