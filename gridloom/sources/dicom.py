"""DICOM images, little-endian with explicit or implicit value representation: 8 and 16 bits, one sample a pixel, one or more frames."""

from __future__ import annotations

import struct

import numpy as np

from .errors import LoaderError

LONG = {b"OB", b"OW", b"OF", b"SQ", b"UN", b"UT", b"OD", b"OL", b"UC", b"UR"}
ROWS, COLUMNS, FRAMES, BITS, SIGNED, SAMPLES, PIXELS = (0x28, 0x10), (0x28, 0x11), (0x28, 0x08), (0x28, 0x100), (0x28, 0x103), (0x28, 0x02), (0x7FE0, 0x10)


#: The element that names the transfer syntax, the syntaxes that are read, items and ends of sequences.
SYNTAX, IMPLICIT, EXPLICIT = (0x02, 0x10), b"1.2.840.10008.1.2", b"1.2.840.10008.1.2.1"
ITEM, ITEM_END, SEQUENCE_END, OPEN = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF


def element_at(data: bytes, at: int, implicit: bool) -> tuple[tuple[int, int], int, int]:
    """Key, first byte of the value, its length."""
    key = struct.unpack_from("<HH", data, at)
    if implicit and key[0] != 2:
        return key, at + 8, struct.unpack_from("<I", data, at + 4)[0]
    if data[at + 4 : at + 6] in LONG:
        return key, at + 12, struct.unpack_from("<I", data, at + 8)[0]
    return key, at + 8, struct.unpack_from("<H", data, at + 6)[0]


def after_sequence(data: bytes, at: int, implicit: bool) -> int:
    """The place after a sequence of open length, whose items may be open too and hold sequences."""
    while True:
        group, element, n = struct.unpack_from("<HHI", data, at)
        at += 8
        if (group, element) == SEQUENCE_END:
            return at
        if (group, element) != ITEM:
            raise LoaderError("DICOM sequence without items")
        if n != OPEN:
            at += n
            continue
        while struct.unpack_from("<HH", data, at) != ITEM_END:
            _, start, n = element_at(data, at, implicit)
            at = after_sequence(data, start, implicit) if n == OPEN else start + n
        at += 8


def elements(data: bytes) -> dict[tuple[int, int], bytes]:
    if data[128:132] != b"DICM":
        raise LoaderError("no DICOM prefix")
    out, at, implicit = {}, 132, False
    try:
        while at + 8 <= len(data):
            key, start, n = element_at(data, at, implicit)
            if n == OPEN:
                if key == PIXELS:
                    raise LoaderError("DICOM of compressed pixels is not read")
                at = after_sequence(data, start, implicit)
                continue
            out[key] = data[start : start + n]
            at = start + n
            if key == SYNTAX:
                syntax = out[key].strip(b" \0")
                if syntax not in (IMPLICIT, EXPLICIT):
                    raise LoaderError(f"DICOM of syntax {syntax.decode('ascii', 'replace')} is not read")
                implicit = syntax == IMPLICIT
    except struct.error as e:
        raise LoaderError("the DICOM file is cut short") from e
    return out


def decode(data: bytes) -> np.ndarray:
    """values[z, y, x] rescaled from least and largest to 0 and 1; the first axis runs over rows, the second over columns."""
    found = elements(data)
    short = lambda key, default=None: struct.unpack("<H", found[key][:2])[0] if key in found else default
    rows, columns, bits = short(ROWS), short(COLUMNS), short(BITS)
    if not rows or not columns or bits not in (8, 16) or short(SAMPLES, 1) != 1 or PIXELS not in found:
        raise LoaderError("DICOM without pixels of 8 or 16 bits")
    frames = int(found.get(FRAMES, b"1").strip(b" \0") or 1)
    kind = f"{'i' if short(SIGNED, 0) else 'u'}{bits // 8}"
    raw = np.frombuffer(found[PIXELS], f"<{kind}", rows * columns * frames).reshape(frames, rows, columns).astype(np.float64)
    low, high = raw.min(), raw.max()
    return ((raw - low) / (high - low if high > low else 1.0)).transpose(0, 2, 1)
