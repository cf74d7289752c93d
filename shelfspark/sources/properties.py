"""Width, height and length of media files, from their headers.

A task opens each path and reads a few short ranges: the fixed header of an image, the segments
of a JPEG up to its frame, the boxes of an MP4 or the chunks of a RIFF file by their sizes.
No file is read whole, and a file's length does not matter.  The content decides the format,
not the name.  A video's frame size comes before an image's; what is absent is 0; a file that
cannot be read, or that is no such file, has zeros too, and is not tried again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import path_key
from shelfspark.session import ship_package
from shelfspark.sources.snapshot import PROPS

MOST = (1 << 31) - 1
#: Segments, boxes or chunks of one file that are looked at; a header beyond them counts as absent.
MOST_STEPS = 4096


class Props(NamedTuple):
    width: int = 0
    height: int = 0
    duration_ms: int = 0


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


class Ranges:
    """Short ranges of an open file."""

    def __init__(self, file):
        self.file, self.size, self.bytes_read = file, file.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        """``n`` bytes; fewer at the end of the file."""
        if offset >= self.size:
            return b""
        self.file.seek(offset)
        out = self.file.read(min(n, self.size - offset))
        self.bytes_read += len(out)
        return out

    def numbers(self, layout: str, offset: int) -> tuple[int, ...]:
        raw = self.at(offset, struct.calcsize(layout))
        return struct.unpack(layout, raw) if len(raw) == struct.calcsize(layout) else (0,) * len(struct.unpack(layout, bytes(struct.calcsize(layout))))


def properties_of(r: Ranges) -> Props:
    """The properties of a file's content."""
    head = r.at(0, 32)
    if head.startswith(b"\x89PNG\r\n\x1a\n") and head[12:16] == b"IHDR":
        return Props(*r.numbers(">II", 16))
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return Props(*r.numbers("<HH", 6))
    if head[:2] == b"BM":
        width, height = r.numbers("<HH", 18) if r.numbers("<I", 14) == (12,) else r.numbers("<ii", 18)
        return Props(abs(width), abs(height))
    if head[:3] == b"\xff\xd8\xff":
        return _jpeg(r)
    if head[:4] == b"RIFF":
        kinds = {b"WEBP": _webp, b"AVI ": _avi, b"WAVE": _wave}
        return kinds[head[8:12]](r) if head[8:12] in kinds else Props()
    if head[:4] == b"fLaC" and len(head) >= 26:
        packed = int.from_bytes(head[18:26], "big")
        return Props(0, 0, _ms(packed & ((1 << 36) - 1), packed >> 44))
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
        return _boxes_of_a_movie(r)
    return Props()


def _ms(ticks: int, per_second: int) -> int:
    return ticks * 1000 // per_second if per_second else 0


def _jpeg(r: Ranges) -> Props:
    at = 2
    for _ in range(MOST_STEPS):
        mark, kind, size = r.numbers(">BBH", at)
        if mark != 0xFF or kind in (0xD9, 0xDA):
            break
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # filling, or a marker that stands alone
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = r.numbers(">HH", at + 5)
            return Props(width, height)
        at += 2 + max(size, 2)
    return Props()


def _webp(r: Ranges) -> Props:
    kind, data = r.at(12, 4), r.at(20, 10)
    if kind == b"VP8X" and len(data) == 10:
        return Props(int.from_bytes(data[4:7], "little") + 1, int.from_bytes(data[7:10], "little") + 1)
    if kind == b"VP8L" and data[:1] == b"\x2f" and len(data) >= 5:
        bits = int.from_bytes(data[1:5], "little")
        return Props((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    if kind == b"VP8 " and data[3:6] == b"\x9d\x01\x2a" and len(data) == 10:
        width, height = struct.unpack("<HH", data[6:10])
        return Props(width & 0x3FFF, height & 0x3FFF)
    return Props()


def _chunks(r: Ranges, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, size, place of the data) of the chunks of a RIFF file from ``at`` on."""
    for _ in range(MOST_STEPS):
        if at + 8 > r.size:
            return
        name, (size,) = r.at(at, 4), r.numbers("<I", at + 4)
        yield name, size, at + 8
        at += 8 + size + size % 2


def _avi(r: Ranges) -> Props:
    for name, _, at in _chunks(r, 12):
        if name == b"LIST" and r.at(at, 4) == b"hdrl":
            for inner, _, data in _chunks(r, at + 4):
                if inner == b"avih":
                    micros, *_, frames = r.numbers("<IIIII", data)
                    return Props(*r.numbers("<II", data + 32), micros * frames // 1000)
            return Props()
    return Props()


def _wave(r: Ranges) -> Props:
    rate = 0
    for name, size, at in _chunks(r, 12):
        if name == b"fmt ":
            (rate,) = r.numbers("<I", at + 8)
        elif name == b"data":
            return Props(0, 0, _ms(size, rate))
    return Props()


def _boxes(r: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the content, its end) of the whole boxes between two places."""
    for _ in range(MOST_STEPS):
        if at + 8 > end:
            return
        (size,), name, head = r.numbers(">I", at), r.at(at + 4, 4), 8
        if size == 1:
            (size,), head = r.numbers(">Q", at + 8), 16
        stop = at + size if size else end
        if not at + head <= stop <= end:
            return  # a box that is cut off says nothing
        yield name, at + head, stop
        at = stop


def _boxes_of_a_movie(r: Ranges) -> Props:
    """The length of the movie and the frame of its largest track."""
    width = height = duration = 0
    for name, at, end in _boxes(r, 0, r.size):
        if name != b"moov":
            continue
        for inner, data, stop in _boxes(r, at, end):
            if inner == b"mvhd":
                wide = r.at(data, 1) == b"\x01"
                per_second, ticks = r.numbers(">IQ", data + 20) if wide else r.numbers(">II", data + 12)
                duration = 0 if ticks == (1 << (64 if wide else 32)) - 1 else _ms(ticks, per_second)  # all ones: unknown
            elif inner == b"trak":
                for part, _, last in _boxes(r, data, stop):
                    if part == b"tkhd":
                        w, h = (x >> 16 for x in r.numbers(">II", last - 8))
                        if w * h > width * height:
                            width, height = w, h
        break
    return Props(width, height, duration)


def properties_at(path: str) -> Props:
    """The properties of the file at a path or URI; zeros if it can't be read."""
    try:
        system, name = located(path)
        with system.open_input_file(name) as file:
            found = properties_of(Ranges(file))
    except (OSError, pa.ArrowException):
        return Props()
    return Props(*(n if 0 <= n <= MOST else 0 for n in found))


def read_media_properties(files: DataFrame, located_at: str = "path") -> DataFrame:
    """Entries of the property store (``PROPS``) for ``files`` (path, size, mtime), read in tasks. ``located_at``: the column where executors find each file."""
    ship_package(files.sparkSession)

    def part(batches):
        for batch in batches:
            found = [properties_at(p) if p is not None else Props() for p in batch["at"].to_pylist()]
            columns = {c: pa.array([getattr(p, c) for p in found], pa.int64() if c == "duration_ms" else pa.int32()) for c in Props._fields}
            yield pa.RecordBatch.from_pydict({"path_key": batch["path_key"], "size": batch["size"], "mtime": batch["mtime"], **columns, "attempted": pa.array([True] * len(found))})

    rows = files.select(path_key(F.col("path")).alias("path_key"), F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), F.col(located_at).alias("at"))
    return rows.mapInArrow(part, PROPS)
