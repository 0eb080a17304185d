"""Operator 4: media columns in Ogg.

``write_ogg`` stores a payload as 8-bit samples in one logical stream beside a stream of marks, multiplexed page
by page; ``read_ogg`` verifies each page's checksum and sequence number, reassembles packets from lacing values,
demultiplexes by serial number and takes timestamps from granule positions. The bytes that come back are what
features are computed from.

Null and empty texts are a payload of 64 zero bytes. Equal texts give equal files. Damaged files raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

BLOCK = 64
RATE = 8000
SAMPLES, MARKS = 0x53414D50, 0x4D41524B
#: First packets of the two streams: what they hold, channels, rate and number of samples; version and bytes of the text.
SAMPLES_HEAD, MARKS_HEAD = struct.Struct("<7sBII"), struct.Struct("<7sBQ")
SAMPLES_NAME, MARKS_NAME = b"\x01pcm8u\0", b"\x01mark\0\0"
#: Samples of a packet, a mark after so many packets.
PACKET, EVERY = 4000, 16
HEAD = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def page_crc(data: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, first bit first, without inversion: zlib's, mirrored."""
    mirrored = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: HEAD.pack(b"OggS", 0, kind, granule, serial, number, crc, len(lacing)) + lacing
    return head(page_crc(head(0) + body)) + body


class _Stream:
    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[bytes], granule: int, kind: int = 0) -> Iterator[bytes]:
        """Packets that end at this granule position; long ones go on in further pages."""
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
        body = b"".join(packets)
        at = 0
        while lacing:
            some, lacing = lacing[:255], lacing[255:]
            size = sum(some)
            ends = any(x < 255 for x in some)
            yield _page(kind, granule if ends else -1, self.serial, self.number, some, body[at : at + size])
            kind = kind & ~FIRST & ~CONTINUED | (CONTINUED if some[-1] == 255 else 0)
            at += size
            self.number += 1


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    samples, marks = _Stream(SAMPLES), _Stream(MARKS)
    out = [*samples.pages([SAMPLES_HEAD.pack(SAMPLES_NAME, 1, RATE, len(payload))], 0, FIRST), *marks.pages([MARKS_HEAD.pack(MARKS_NAME, 1, n_bytes)], 0, FIRST)]
    cuts = range(0, len(payload), PACKET)
    for k, at in enumerate(cuts):
        piece = payload[at : at + PACKET]
        last = k == len(cuts) - 1
        out += samples.pages([piece], at + len(piece), LAST if last else 0)
        if last or k % EVERY == EVERY - 1:
            out += marks.pages([struct.pack("<QI", at + len(piece), zlib.crc32(piece))], at + len(piece), LAST if last else 0)
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream: packets, and for each the granule position of the page on which it ends."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    pages: int = 0

    def seconds(self, rate: int) -> list[float]:
        return [g / rate for g in self.granules]


def read_ogg(data: bytes) -> dict[int, Logical]:
    streams: dict[int, Logical] = {}
    open_packet: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError(f"a page is cut off at byte {at}")
        magic, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        start = at + HEAD.size + n
        end = start + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(data):
            raise ValueError(f"no whole page at byte {at}")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        if (serial not in streams) != bool(kind & FIRST):
            raise ValueError(f"stream {serial:#x} begins wrongly at byte {at}")
        stream = streams.setdefault(serial, Logical())
        if number != stream.pages or stream.ended or bool(kind & CONTINUED) != bool(open_packet.get(serial)):
            raise ValueError(f"pages of stream {serial:#x} are missing at byte {at}")
        stream.pages += 1
        parts = open_packet.setdefault(serial, [])
        body = start
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                parts.append(data[body : body + run])
                body, run = body + run, 0
                stream.packets.append(b"".join(parts))
                stream.granules.append(granule)
                parts.clear()
        if run or (lacing and lacing[-1] == 255):
            parts.append(data[body : body + run])
        stream.ended = bool(kind & LAST)
        at = end
    if any(open_packet.values()) or not all(s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def decode_samples(media: bytes) -> tuple[bytes, int, Logical, int]:
    """Payload, unpadded length, sample stream and rate of a stored file, by what the streams' first packets say; marks are verified."""
    named = {s.packets[0][:7]: s for s in read_ogg(media).values() if s.packets}
    if not {SAMPLES_NAME, MARKS_NAME} <= named.keys():
        raise ValueError("no samples or no marks")
    samples, marks = named[SAMPLES_NAME], named[MARKS_NAME]
    _, channels, rate, length = SAMPLES_HEAD.unpack(samples.packets[0])
    payload = b"".join(samples.packets[1:])
    if channels != 1 or not rate or len(payload) != length or samples.granules[-1] != length:
        raise ValueError("samples are not as their first packet says")
    ends = dict(zip(samples.granules[1:], samples.packets[1:], strict=True))
    for mark in marks.packets[1:]:
        where, crc = struct.unpack("<QI", mark)
        if where not in ends or zlib.crc32(ends[where]) != crc:
            raise ValueError(f"samples before {where} differ from their mark")
    return payload, MARKS_HEAD.unpack(marks.packets[0])[2], samples, rate


def feature_of(payload: bytes, samples: Logical, rate: int) -> str:
    """Duration, packets, mean, root of mean square about 128 and crossings of 128 per sample."""
    wave = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] >= 0) != (wave[:-1] >= 0)))
    n = len(wave)
    return f"s={samples.seconds(rate)[-1]:.6f};packets={len(samples.packets) - 1};mean={int(wave.sum()) / n:.6f};rms={(int((wave * wave).sum()) / n) ** 0.5:.6f};zcr={crossings / n:.6f}"


def media_digest(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """Columns ``keep``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with_media: the file too."""

    def make():
        def apply(texts):
            out = [[] for _ in range(7 + with_media)]
            for t in texts:
                payload, n = payload_of(t)
                media = write_ogg(payload, n)
                back, length, samples, rate = decode_samples(media)
                row = (length, len(back), sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), sha256(media).hexdigest(), feature_of(back, samples, rate))
                for column, x in zip(out, (*row, media), strict=False):
                    column.append(x)
            return out

        return apply

    fields = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    return map_text(df, text, make, fields | ({"media": "binary"} if with_media else {}), list(keep))
