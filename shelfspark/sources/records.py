"""Binary change-journal buffers (version 2 records) decoded into rows, and media files by directory walks.

A buffer is decoded as a whole: one pass over the length fields finds where records begin, every
other field is gathered for all records at once, and names are turned from UTF-16 into UTF-8
together.  Records that cannot be used still give a row with their outcome, so the counters of a
scan are an aggregate of the same rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.media import excluded_path, media_kind
from shelfspark.session import ship_package

DECODED = "source string, at long, outcome string, frn long, parent_frn long, usn long, filetime long, reason long, attrs long, name string"
_KINDS = {"string": pa.string(), "long": pa.int64()}
SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in DECODED.split(", ")])
# Size and places of the fields of a version 2 record, and the directory attribute.
HEAD = 60
MAJOR, FRN, PARENT, USN, TIME, REASON, ATTRS, NAME_SIZE, NAME_AT = 4, 8, 16, 24, 32, 40, 52, 56, 58
DIRECTORY = 0x10
OUTCOMES = pa.array(["ok", "unsupported", "bad_name", "malformed"])
OK, UNSUPPORTED, BAD_NAME, MALFORMED = range(4)
#: Records that one Arrow batch holds.
BATCH = 20_000


def record_starts(buffer: memoryview) -> tuple[np.ndarray, int]:
    """(where the records begin, how many of them are whole): after the first that is not whole nothing is read."""
    length_at, end, at, starts = struct.Struct("<I").unpack_from, len(buffer), 0, []
    while at < end:
        starts.append(at)
        if at + HEAD > end:
            return np.array(starts, np.int64), len(starts) - 1
        length = length_at(buffer, at)[0]
        if length < HEAD or at + length > end:
            return np.array(starts, np.int64), len(starts) - 1
        at += length
    return np.array(starts, np.int64), len(starts)


def field(data: np.ndarray, starts: np.ndarray, at: int, kind: type) -> np.ndarray:
    """A little-endian field of every record."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[starts[:, None] + np.arange(at, at + size)]).view(np.dtype(kind).newbyteorder("<")).ravel()


def utf8_names(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """UTF-16 names as strings; half a surrogate pair becomes U+FFFD."""
    ends = np.cumsum(sizes)
    raw = data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    unit = np.ascontiguousarray(raw).view("<u2").astype(np.uint32)
    last = np.zeros(len(unit) + 1, bool)
    last[ends[sizes > 0] // 2 - 1] = True
    high, low = (unit & 0xFC00) == 0xD800, (unit & 0xFC00) == 0xDC00
    begins = high & np.append(low[1:], False) & ~last[:-1]
    second = np.zeros(len(unit), bool)
    second[1:] = begins[:-1]
    code = np.where((high | low) & ~begins, 0xFFFD, unit)
    at = np.flatnonzero(begins)
    code[at] = 0x10000 + ((unit[at] & 0x3FF) << 10) + (unit[at + 1] & 0x3FF)
    width = np.where(second, 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    place = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros(place[-1], np.uint8)
    for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        mine = np.flatnonzero(width == n)
        for k in range(n):
            bits = code[mine] >> (6 * (n - 1 - k))
            out[place[mine] + k] = (bits | lead if k == 0 else 0x80 | (bits & 0x3F)).astype(np.uint8)
    offsets = place[np.concatenate(([0], ends // 2))]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def batches_of(source: str | None, content: bytes | memoryview) -> Iterator[pa.RecordBatch]:
    """All records of a buffer, each with its outcome."""
    view = memoryview(content)
    data = np.frombuffer(view, np.uint8)
    starts, whole = record_starts(view)
    for lo in range(0, len(starts), BATCH):
        at = starts[lo : lo + BATCH]
        good = np.arange(lo, lo + len(at)) < whole
        outcome = np.full(len(at), MALFORMED, np.int8)
        full = at[good]
        size, name_at = field(data, full, NAME_SIZE, np.uint16).astype(np.int64), field(data, full, NAME_AT, np.uint16).astype(np.int64)
        fits = (name_at >= HEAD) & (name_at + size <= field(data, full, 0, np.uint32)) & (size % 2 == 0)
        outcome[good] = np.where(field(data, full, MAJOR, np.uint16) != 2, UNSUPPORTED, np.where(fits, OK, BAD_NAME))
        ok = np.flatnonzero(outcome == OK)
        row = np.full(len(at), -1)
        row[ok] = np.arange(len(ok))
        used = outcome[good] == OK
        of = full[used]
        take = pa.array(row, mask=row < 0)
        columns = {
            "source": pa.array([source] * len(at), pa.string()), "at": pa.array(at), "outcome": OUTCOMES.take(pa.array(outcome)),
            **{c: pa.array(field(data, of, k, np.int64)).take(take) for c, k in (("frn", FRN), ("parent_frn", PARENT), ("usn", USN), ("filetime", TIME))},
            **{c: pa.array(field(data, of, k, np.uint32).astype(np.int64)).take(take) for c, k in (("reason", REASON), ("attrs", ATTRS))},
            "name": utf8_names(data, of + name_at[used], size[used]).take(take),
        }
        yield pa.RecordBatch.from_pydict(columns, SCHEMA)


def decode(buffers: DataFrame) -> DataFrame:
    """Rows of all records in ``buffers`` (source, content), each with its outcome."""
    ship_package(buffers.sparkSession)

    def part(batches):
        for batch in batches:
            for source, content in zip(batch["source"].to_pylist(), batch["content"], strict=True):
                yield from batches_of(source, content.as_buffer() if content.is_valid else b"")
            batch = content = None  # else they would stay while the next is read

    return buffers.select("source", "content").mapInArrow(part, DECODED)


def read_buffers(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), "content")


def scan_records(decoded: DataFrame) -> DataFrame:
    """(frn, parent_frn, name, is_dir, kind, seq): every directory, and files of a media type, in the order of the scan."""
    is_dir = F.col("attrs").bitwiseAND(F.lit(DIRECTORY)) != 0
    rows = decoded.where("outcome = 'ok'").select("frn", "parent_frn", "name", is_dir.alias("is_dir"), F.when(~is_dir, media_kind(F.col("name"))).alias("kind"), F.struct("source", "at").alias("seq"))
    return rows.where("is_dir or kind is not null")


def scan_counts(decoded: DataFrame) -> DataFrame:
    """One row: what became of the records."""
    is_dir = F.col("attrs").bitwiseAND(F.lit(DIRECTORY)) != 0
    ok = F.col("outcome") == "ok"
    media = media_kind(F.col("name")).isNotNull()
    return decoded.agg(
        F.count_if(ok).alias("seen"), F.count_if(ok & is_dir).alias("dirs"), F.count_if(ok & ~is_dir).alias("files"), F.count_if(ok & ~is_dir & media).alias("kept"),
        F.count_if(F.col("outcome") == "unsupported").alias("unsupported"), F.count_if(F.col("outcome").isin("malformed", "bad_name")).alias("malformed"),
    )


def walk(spark: SparkSession, root: str, skip_dot: bool = True) -> DataFrame:
    """(path, name, kind, size, mtime) of the media files below ``root``, without reading them.

    Folders below ``root`` with an excluded name are left out with all they hold.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace(F.substring("path", F.instr("path", root) + len(root), F.length("path")), "/[^/]*$", "")
    rows = found.select("path", name.alias("name"), media_kind(name).alias("kind"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.concat(F.lit("X:"), F.replace(folder, F.lit("/"), F.lit("\\"))).alias("_folder"))
    return rows.where(F.col("kind").isNotNull() & ~excluded_path(F.col("_folder"), skip_dot)).drop("_folder").dropDuplicates(["path"])


def walk_counts(spark: SparkSession, root: str, skip_dot: bool = True) -> DataFrame:
    """One row: entries (files seen), media, kept (media outside excluded folders), excluded, folders (that hold any file)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    folder = F.regexp_replace(F.substring("path", F.instr("path", root) + len(root), F.length("path")), "/[^/]*$", "")
    media = media_kind(F.substring_index("path", "/", -1)).isNotNull()
    left_out = excluded_path(F.concat(F.lit("X:"), F.replace(folder, F.lit("/"), F.lit("\\"))), skip_dot)
    return found.agg(F.count("*").alias("entries"), F.count_if(media).alias("media"), F.count_if(media & ~left_out).alias("kept"), F.count_if(media & left_out).alias("excluded"), F.count_distinct(folder).alias("folders"))


def scannable(volumes: DataFrame) -> DataFrame:
    """``volumes`` with skip_reason; null for those that can be scanned."""
    reason = F.when(F.col("kind") == "network", "network").when(F.coalesce(F.lower("filesystem"), F.lit("")) != "ntfs", "not ntfs")
    return volumes.withColumn("skip_reason", reason)
