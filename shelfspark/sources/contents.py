"""Fingerprints of files by their paths: only the ends of a file, or the whole, are read, in tasks.

Spark's binaryFile source reads whole files of at most 2 GB.  Here a task opens each path
through ``pyarrow.fs`` (a local or mounted path, or a URI), seeks, and hashes as it reads, so
the size of a file does not matter.  A file that cannot be read, or is shorter than was
recorded, has a null fingerprint.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import EDGE, byte_range
from shelfspark.session import ship_package
from shelfspark.sources.properties import located

PIECE = 4 << 20


def digest_of(path: str, size: int, whole: bool = False, edge: int = EDGE) -> str | None:
    """SHA-256 of a file's content, or of its first and last ``edge`` bytes if it has more than these; None if it can't be read."""
    spans = [(0, size)] if whole or size <= 2 * edge else [(0, edge), (size - edge, edge)]
    sha = hashlib.sha256()
    try:
        system, name = located(path)
        with system.open_input_file(name) as file:
            for start, length in spans:
                file.seek(start)
                while length:
                    piece = file.read(min(length, PIECE))
                    if not piece:
                        return None
                    sha.update(piece)
                    length -= len(piece)
    except (OSError, pa.ArrowException):
        return None
    return sha.hexdigest()


#: The most bytes that one answer holds, and the most that any request may ask for (fixed values).
ANSWER, REQUEST = 8 << 20, 256 << 20


def read_ranges(requests: DataFrame, cap: int = ANSWER) -> DataFrame:
    """``requests`` (path, header) and size, first, last and content of the byte range that each header names.

    A range is clamped to the file and capped to ``cap`` bytes, 256 MiB at most; only it is read.  first, last and content are
    null if the range can't be served, size too if the file can't be read.
    """
    ship_package(requests.sparkSession)
    asked = requests.drop("size", "first", "last", "content")
    longs = {c: F.lit(None).cast("long") for c in ("size", "first", "last")}
    sized = _by_path(asked, asked.withColumn("size", longs["size"]).schema, lambda file, row: {"size": file.size()})
    wanted = byte_range(F.col("header"), F.col("size"), min(cap, REQUEST))
    ranged = sized.withColumn("range", wanted).withColumns({"first": F.col("range.first").cast("long"), "last": F.col("range.last").cast("long")}).drop("range")

    def piece(file, row):
        if row["first"] is None:
            return {"content": None}
        file.seek(row["first"])
        return {"content": file.read(row["last"] - row["first"] + 1)}

    return _by_path(ranged, ranged.withColumn("content", F.lit(None).cast("binary")).schema, piece)


def _by_path(rows: DataFrame, schema, read) -> DataFrame:
    """``rows`` with the columns that ``read(file, row)`` adds for the file at path; null if it can't be read."""
    new = schema.names[-1]

    def part(batches):
        for batch in batches:
            found = []
            for i, row in enumerate(batch.select([c for c in ("path", "first", "last") if c in batch.schema.names]).to_pylist()):
                value = None
                try:
                    system, name = located(row["path"] or "")
                    with system.open_input_file(name) as file:
                        value = read(file, row)[new]
                except (OSError, pa.ArrowException):
                    pass
                found.append(value)
                if new == "content" and value is not None and sum(len(v) for v in found if v) >= ANSWER:
                    yield _with(batch.slice(i + 1 - len(found), len(found)), new, found)
                    found = []
            if found or not batch.num_rows:
                yield _with(batch.slice(batch.num_rows - len(found)), new, found)

    return rows.mapInArrow(part, schema)


def _with(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary() if name == "content" else pa.int64())], names=[*batch.schema.names, name])


def fingerprint_paths(files: DataFrame, whole: bool = False, edge: int = EDGE) -> DataFrame:
    """``files`` (with path and size) and fp, null where the file can't be read."""
    ship_package(files.sparkSession)
    schema = files.drop("fp").withColumn("fp", F.lit(None).cast("string")).schema

    def part(batches):
        for batch in batches:
            prints = [digest_of(p, s, whole, edge) if p is not None and s is not None else None for p, s in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield batch.append_column("fp", pa.array(prints, pa.string()))

    return files.drop("fp").mapInArrow(part, schema)
