"""Walks of directory trees, level by level: one distributed listing for each level.

Folders with an excluded name are pruned before they are listed, with all that they hold; links
are not followed; a path that turns up twice, whatever its case, is listed once; a folder that
cannot be read is a row with that outcome, as is one that lies too deep.  Every counter of a walk
is an aggregate of the same rows.
"""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.media import EXCLUDED, media_kind
from shelfspark.session import ship_package
from shelfspark.sources.properties import located
from shelfspark.sources.snapshot import cut

MAX_DEPTH = 64
ENTRIES = "path string, name string, is_dir boolean, outcome string, size long, mtime long"
#: Folders: listed, unreadable, excluded, link, too_deep; files: file, link. ``open`` is a folder that is yet to be listed.
LISTED, UNREADABLE, EXCLUDED_DIR, LINK, TOO_DEEP, FILE, OPEN = "listed", "unreadable", "excluded", "link", "too_deep", "file", "open"
#: Entries that one Arrow batch holds.
BATCH = 10_000


def entries_of(folder: str):
    """(name, is_dir, is_link, size, mtime) of what a folder holds. Raises OSError if it can't be read."""
    system, path = located(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for e in found:
                try:
                    s = e.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue  # gone since it was listed
                yield e.name, stat.S_ISDIR(s.st_mode), e.is_symlink() or e.is_junction(), s.st_size, int(s.st_mtime)
    else:
        for e in system.get_file_info(fs.FileSelector(path)):
            yield e.base_name, e.type == fs.FileType.Directory, False, e.size or 0, int(e.mtime.timestamp()) if e.mtime else 0


def _level(frontier: DataFrame, skip_dot: bool, excluded: frozenset[str]) -> DataFrame:
    """The folders of a frontier and what they hold."""

    def rows_of(folder: str):
        name, out = folder.rsplit("/", 1)[-1], []
        try:
            for n, is_dir, is_link, size, mtime in entries_of(folder):
                outcome = LINK if is_link else FILE if not is_dir else EXCLUDED_DIR if n.lower() in excluded or skip_dot and n.startswith(".") else OPEN
                out.append((f"{folder}/{n}", n, is_dir, outcome, size, mtime))
                if len(out) >= BATCH:
                    yield out
                    out = []
            out.append((folder, name, True, LISTED, 0, 0))
        except (OSError, pa.ArrowException):
            out.append((folder, name, True, UNREADABLE, 0, 0))
        yield out

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("outcome", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])

    def part(batches):
        for batch in batches:
            for folder in batch["path"].to_pylist():
                for rows in rows_of(folder):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return frontier.select("path").mapInArrow(part, ENTRIES)


def walk_tree(spark: SparkSession, root: str, skip_dot: bool = True, excluded: list[str] = EXCLUDED, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, name, depth, is_dir, outcome, kind, size, mtime) of everything at and below ``root`` that the walk has seen.

    ``root`` has depth 0.  Folders at depth ``max_depth`` are not listed.
    """
    ship_package(spark)
    names = frozenset(n.lower() for n in excluded)
    frontier = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    levels: list[DataFrame] = []
    for depth in range(max_depth + 1):
        if depth == max_depth:
            levels.append(frontier.select("path", F.substring_index("path", "/", -1).alias("name"), F.lit(True).alias("is_dir"), F.lit(TOO_DEEP).alias("outcome"), *(F.lit(0).cast("long").alias(c) for c in ("size", "mtime")), F.lit(depth).alias("depth")))
            break
        seen = cut(_level(frontier.repartition("path") if depth else frontier, skip_dot, names))
        own = F.when(F.col("outcome").isin(LISTED, UNREADABLE), depth).otherwise(depth + 1)
        levels.append(seen.where(F.col("outcome") != OPEN).withColumn("depth", own))
        frontier = seen.where(F.col("outcome") == OPEN).groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path")).select("path")
        if frontier.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    kind = F.when(~F.col("is_dir") & (F.col("outcome") == FILE), media_kind(F.col("name")))
    return out.select("path", "name", F.col("depth").cast("int").alias("depth"), "is_dir", "outcome", kind.alias("kind"), "size", "mtime")


def media_files(walked: DataFrame) -> DataFrame:
    """(path, name, kind, size, mtime) of the media files of a walk."""
    return walked.where("kind is not null").select("path", "name", "kind", "size", "mtime")


def tree_counts(walked: DataFrame) -> DataFrame:
    """One row: directories_seen (tried), orphaned (of these, not readable), excluded, links, too_deep, files_seen, media_files_in, kept."""
    n = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    media = F.count_if(F.col("kind").isNotNull())
    return walked.agg(n(LISTED, UNREADABLE).alias("directories_seen"), n(UNREADABLE).alias("orphaned"), n(EXCLUDED_DIR).alias("excluded"), n(LINK).alias("links"), n(TOO_DEEP).alias("too_deep"), n(FILE).alias("files_seen"), media.alias("media_files_in"), media.alias("kept"))
