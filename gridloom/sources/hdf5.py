"""HDF5 files of numbers with the standard library: version 0 superblock, groups as symbol tables, contiguous datasets.

These are what the format's library writes by default, so files go both ways. Read are also chunked datasets below a
tree of version 1, with the filters deflate, shuffle and checksum; compact datasets and other kinds of groups are refused.

Metadata are made and read on the driver. Values of datasets need not be: ``Draft`` lays a file out with room for them,
for tasks to fill, and ``Dataset`` says where tasks find them.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import prod

import numpy as np

from .errors import LoaderError

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Fixed values of the format: message types, sizes of blocks, and half the children of a node of a group's tree.
DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 1, 3, 5, 8, 11, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
SUPERBLOCK, ENTRY, HALF_TREE = 96, 40, 16
#: Little-endian doubles: class and version, sign and padding, size, then places and sizes of exponent and mantissa.
DOUBLE = struct.pack("<B3BI HHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)


def split_name(name: str) -> list[str]:
    return [part for part in name.split("/") if part]


def lay_out(datasets: dict[str, tuple[int, ...] | int], start: int = SUPERBLOCK) -> tuple[list[tuple[int, bytes]], dict[str, int], int]:
    """Metadata as (place, bytes), the superblock last; places of the values of new datasets; the file's size.

    A dataset of doubles is given by its extents, one that the file holds already by the place of its header. Nothing but
    the superblock lies before ``start``.
    """
    tree: dict = {}
    for name, what in datasets.items():
        *folders, last = split_name(name)
        at = tree
        for folder in folders:
            at = at.setdefault(folder, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} lies below a dataset")
        at[last] = (name, what)

    def widest(group: dict) -> int:
        return max([len(group), *(widest(g) for g in group.values() if isinstance(g, dict))])

    half_leaf = max(4, (widest(tree) + 1) // 2)
    pieces: list[tuple[int, bytes]] = []
    places: dict[str, int] = {}
    size = start

    def room(n: int) -> int:
        nonlocal size
        at = size + -size % 8
        size = at + n
        return at

    def put(block: bytes) -> int:
        pieces.append((room(len(block)), block))
        return pieces[-1][0]

    def header(*messages: tuple[int, bytes]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(data) + -len(data) % 8, 0) + data + bytes(-len(data) % 8) for kind, data in messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def put_dataset(name: str, what: tuple[int, ...] | int) -> int:
        if isinstance(what, int):
            return what
        bytes_ = 8 * prod(what)
        at = places[name] = room(bytes_)
        space = struct.pack(f"<BBB5x{len(what)}Q", 1, len(what), 0, *what)
        return header((DATASPACE, space), (DATATYPE, DOUBLE), (FILL, struct.pack("<4BI", 2, 2, 2, 1, 0)), (LAYOUT, struct.pack("<BBQQ", 3, 1, at, bytes_)))

    def put_group(group: dict) -> tuple[int, int, int]:
        """Addresses of the group's header, tree and names."""
        entries, names, last = b"", bytearray(8), 0
        for name in sorted(group, key=str.encode):
            child = group[name]
            last = len(names)
            if isinstance(child, dict):
                entry = struct.pack("<QQI4xQQ", last, *(lambda h, t, n: (h, 1, t, n))(*put_group(child)))
            else:
                entry = struct.pack("<QQI4x16x", last, put_dataset(*child), 0)
            entries += entry
            names += name.encode() + bytes(8 - len(name.encode()) % 8)
        heap = put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, put(bytes(names))))
        leaf = put(struct.pack("<4sBxH", b"SNOD", 1, len(group)) + entries + bytes(ENTRY * (2 * half_leaf - len(group))))
        node = struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1 if group else 0, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, leaf, last)
        top = put(node + bytes(24 + 8 * (4 * HALF_TREE + 1) - len(node)))
        return header((SYMBOLS, struct.pack("<QQ", top, heap))), top, heap

    root, top, heap = put_group(tree)
    begin = SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, half_leaf, HALF_TREE, 0)
    pieces.append((0, begin + struct.pack("<QQQQ", 0, NOWHERE, size, NOWHERE) + struct.pack("<QQI4xQQ", 0, root, 1, top, heap)))
    return pieces, places, size


def encode(datasets: dict[str, np.ndarray]) -> bytes:
    """A file with one dataset of doubles per path, such as /map/x."""
    pieces, places, size = lay_out({name: values.shape for name, values in datasets.items()})
    out = bytearray(size)
    for at, block in [*pieces, *((places[name], np.ascontiguousarray(values, "<f8").tobytes()) for name, values in datasets.items())]:
        out[at : at + len(block)] = block
    return bytes(out)


@dataclass
class Dataset:
    """Extents, kind of number, and where the values lie: from ``place`` on, or in chunks below ``tree``.

    ``filters`` are numbers with their parameters, in the order in which a writer applies them; ``fill`` is the value of
    what no chunk holds.
    """

    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None
    place: int | None = None
    tree: int | None = None
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    fill: float = 0.0

    def values(self, raw: bytes, mask: int) -> np.ndarray:
        """The numbers of one chunk as it is stored; bits of the mask tell filters that were left out."""
        for k, (number, options) in reversed(list(enumerate(self.filters))):
            if mask >> k & 1:
                continue
            if number == DEFLATE:
                raw = zlib.decompress(raw)
            elif number == SHUFFLE:
                width = options[0] if options else self.kind.itemsize
                whole = len(raw) // width * width
                raw = np.frombuffer(raw, np.uint8, whole).reshape(width, -1).T.tobytes() + raw[whole:]
            elif number == CHECKSUM:
                raw = raw[:-4]
            else:
                raise LoaderError(f"HDF5 filter {number} is not known")
        if len(raw) != prod(self.chunk) * self.kind.itemsize:
            raise LoaderError("a chunk of another size than its dataset's")
        return np.frombuffer(raw, self.kind).reshape(self.chunk)


class File:
    """Datasets of a file, in memory or mapped."""

    def __init__(self, data: bytes | mmap.mmap):
        if data[:8] != SIGNATURE or len(data) < SUPERBLOCK or data[8] > 1 or data[13:15] != b"\x08\x08":
            raise LoaderError("no HDF5 file with a superblock of version 0 or 1")
        self.data = data
        self.root = self.unpack("<Q", (64 if data[8] == 0 else 68))[0]

    def unpack(self, layout: str, at: int) -> tuple:
        try:
            return struct.unpack_from(layout, self.data, at)
        except struct.error as e:
            raise LoaderError("the HDF5 file is cut short") from e

    def messages(self, at: int) -> Iterator[tuple[int, int]]:
        """(type, place of its data) of an object's header."""
        version, number, _, size = self.unpack("<BxHII", at)
        if version != 1:
            raise LoaderError("an object header of a later version")
        blocks = [(at + 16, size)]
        while blocks:
            place, left = blocks.pop(0)
            while left >= 8 and number:
                kind, length = self.unpack("<HH", place)
                if kind == CONTINUATION:
                    blocks.append(self.unpack("<QQ", place + 8))
                yield kind, place + 8
                place, left, number = place + 8 + length, left - 8 - length, number - 1

    def children(self, at: int) -> dict[str, int] | None:
        """Names and headers of a group; None for a dataset."""
        for kind, place in self.messages(at):
            if kind == SYMBOLS:
                top, heap = self.unpack("<QQ", place)
                names = self.unpack("<Q", heap + 24)[0]
                return {self.data[names + n : self.data.find(b"\0", names + n)].decode(): h for n, h in self.entries(top)}
        return None

    def entries(self, at: int) -> Iterator[tuple[int, int]]:
        mark, level, used = self.unpack("<4sxBH", at)
        if mark != b"TREE":
            raise LoaderError("a group without a tree")
        for k in range(used):
            child = self.unpack("<Q", at + 32 + 16 * k)[0]
            if level:
                yield from self.entries(child)
                continue
            mark, number = self.unpack("<4sxxH", child)
            if mark != b"SNOD":
                raise LoaderError("a tree without symbols")
            yield from (self.unpack("<QQ", child + 8 + ENTRY * n) for n in range(number))

    def headers(self, at: int | None = None, above: str = "") -> dict[str, int]:
        """Paths of all datasets, and where their headers are."""
        at = self.root if at is None else at
        found = self.children(at)
        return {above: at} if found is None else {p: h for name, child in found.items() for p, h in self.headers(child, f"{above}/{name}").items()}

    def names(self) -> list[str]:
        return list(self.headers())

    def find(self, name: str) -> Dataset:
        at = self.root
        for part in split_name(name):
            inside = self.children(at) or {}
            if part not in inside:
                raise LoaderError(f"the HDF5 file has no {name}")
            at = inside[part]
        found, fill = Dataset(), (0, 0)
        for message, m in self.messages(at):
            if message == DATASPACE:
                version, rank = self.unpack("<BB", m)
                found.shape = self.unpack(f"<{rank}Q", m + (8 if version == 1 else 4))
            elif message == DATATYPE:
                what, bits, size = self.unpack("<BB2xI", m)
                letter = {0: "i" if bits & 8 else "u", 1: "f"}.get(what & 15)
                found.kind = np.dtype(f"{'>' if bits & 1 else '<'}{letter}{size}") if letter else None
            elif message == FILL:
                version, flags = self.unpack("<BB", m)
                if version == 3 and flags & 32:
                    fill = (self.unpack("<I", m + 2)[0], m + 6)
                elif version == 1 or (version == 2 and self.unpack("<B", m + 3)[0]):
                    fill = (self.unpack("<I", m + 4)[0], m + 8)
            elif message == FILTERS:
                found.filters = self.filters(m)
            elif message == LAYOUT:
                version, storage, where = self.unpack("<BBQ", m)
                if (version, storage) == (3, 1):
                    found.place = where
                elif (version, storage) == (3, 2):
                    rank, found.tree = self.unpack("<BQ", m + 2)
                    found.chunk = self.unpack(f"<{rank - 1}I", m + 11)
        if not found.shape or found.kind is None or (found.place is None and len(found.chunk) != len(found.shape)):
            raise LoaderError(f"{name} is no contiguous or chunked dataset of numbers")
        if fill[0] == found.kind.itemsize:
            found.fill = float(np.frombuffer(self.data[fill[1] : fill[1] + fill[0]], found.kind)[0])
        if found.place not in (None, NOWHERE) and found.place + prod(found.shape) * found.kind.itemsize > len(self.data):
            raise LoaderError("the HDF5 file is cut short")
        return found

    def filters(self, m: int) -> list[tuple[int, tuple[int, ...]]]:
        version, number = self.unpack("<BB", m)
        at, out = m + (8 if version == 1 else 2), []
        for _ in range(number):
            named = version == 1 or self.unpack("<H", at)[0] >= 256
            kind, length, _, options = self.unpack("<4H", at) if named else (lambda k, f, n: (k, 0, f, n))(*self.unpack("<3H", at))
            at += (8 if named else 6) + length + (-length % 8 if version == 1 else 0)
            out.append((kind, self.unpack(f"<{options}I", at)))
            at += 4 * (options + (options % 2 if version == 1 else 0))
        return out

    def chunks(self, dataset: Dataset, at: int | None = None) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(least corner, place, stored bytes, mask of filters left out) of each chunk that the file holds."""
        at, rank = dataset.tree if at is None else at, len(dataset.shape)
        if at == NOWHERE:
            return
        mark, kind, level, used = self.unpack("<4sBBH", at)
        if mark != b"TREE" or kind != 1:
            raise LoaderError("chunks without a tree")
        for k in range(used):
            size, mask, *corner, _, child = self.unpack(f"<II{rank + 1}QQ", at + 24 + k * (24 + 8 * rank))
            if level:
                yield from self.chunks(dataset, child)
            else:
                yield tuple(corner), child, size, mask

    def read(self, name: str) -> np.ndarray:
        """A whole dataset as doubles, in memory."""
        found = self.find(name)
        if found.place not in (None, NOWHERE):
            return np.frombuffer(self.data, found.kind, prod(found.shape), found.place).reshape(found.shape).astype(np.float64)
        out = np.full(found.shape, found.fill)
        for corner, place, size, mask in self.chunks(found) if found.place is None else ():
            # What lies beyond the dataset's extents is cut off on both sides.
            part = out[tuple(slice(c, c + e) for c, e in zip(corner, found.chunk, strict=True))]
            part[...] = found.values(self.data[place : place + size], mask)[tuple(slice(e) for e in part.shape)]
        return out


@contextmanager
def opened(path: str) -> Iterator[File]:
    """A file mapped: what is read of it is loaded, no more."""
    with open(path, "rb") as f:
        if not os.path.getsize(path):
            raise LoaderError(f"{path} is empty")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield File(data)


class Draft:
    """Datasets being added to a file, whose values may be written into ``work`` at ``places``; then commit or give up.

    A fresh file is made beside the old one and replaces it. Otherwise new datasets and all metadata are laid out behind
    what is there, and the superblock, written last, makes them count: until then, and after a crash, the file is the old
    one. Groups of the same names give way; their room is not used again.
    """

    def __init__(self, path: str, shapes: dict[str, tuple[int, ...]], fresh: bool):
        held: dict[str, int] = {}
        self.path, self.before = path, None
        if not fresh:
            clash = lambda a, b: split_name(a)[: len(split_name(b))] == split_name(b) or split_name(b)[: len(split_name(a))] == split_name(a)
            with opened(path) as found:
                held = {name: at for name, at in found.headers().items() if not any(clash(name, d) for d in shapes)}
            self.before = os.path.getsize(path)
        self.pieces, self.places, size = lay_out(held | shapes, self.before or SUPERBLOCK)
        self.work = path if self.before else f"{path}.{uuid.uuid4().hex}.part"
        with open(self.work, "r+b" if self.before else "wb") as f:
            f.truncate(size)

    def commit(self) -> None:
        with open(self.work, "r+b") as f:
            for at, block in self.pieces:
                if not at:
                    f.flush()
                    os.fsync(f.fileno())
                f.seek(at)
                f.write(block)
        if self.work != self.path:
            os.replace(self.work, self.path)

    def give_up(self) -> None:
        if self.before:
            os.truncate(self.path, self.before)
        else:
            os.remove(self.work)


@contextmanager
def draft(path: str, shapes: dict[str, tuple[int, ...]], fresh: bool) -> Iterator[Draft]:
    made = Draft(path, shapes, fresh)
    try:
        yield made
    except BaseException:
        made.give_up()
        raise
    made.commit()


def add(path: str, datasets: dict[str, np.ndarray], fresh: bool) -> None:
    """Write datasets of the driver to a file; unless it is to be fresh, others that it holds stay."""
    with draft(path, {name: values.shape for name, values in datasets.items()}, fresh) as made, open(made.work, "r+b") as f:
        for name, values in datasets.items():
            f.seek(made.places[name])
            f.write(np.ascontiguousarray(values, "<f8").tobytes())
