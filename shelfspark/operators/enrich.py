"""Media properties from a store keyed by path, size and modification time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import path_key
from shelfspark.sources.snapshot import assign_positions

PRIORITY = ("video", "image", "audio")


def seed_from_store(files: DataFrame, store: DataFrame) -> DataFrame:
    """``files`` (with path) and width, height, duration_ms (0: unknown), cached: an entry of this size and time exists."""
    props = F.max(F.struct("width", "height", "duration_ms")).alias("p")  # one of several entries, always the same
    entry = store.groupBy("path_key", "size", "mtime").agg(props).select("path_key", "size", "mtime", "p.*", F.lit(True).alias("cached"))
    out = files.drop("width", "height", "duration_ms").withColumn("path_key", path_key(F.col("path"))).join(entry, ["path_key", "size", "mtime"], "left").drop("path_key")
    return out.fillna(0, ["width", "height", "duration_ms"]).fillna(False, ["cached"])


def read_queue(seeded: DataFrame, network_volumes: DataFrame) -> DataFrame:
    """Files whose properties were never read and that are not on a network volume; videos first, then images, later positions first."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    queue = seeded.where("not cached").join(network_volumes.select(F.col("letter").alias("volume")), "volume", "left_anti")
    return queue.withColumn("priority", rank).orderBy("priority", F.desc("idx"))


def numbered_queue(seeded: DataFrame, network_volumes: DataFrame) -> DataFrame:
    """The queue of :func:`read_queue` with each file's place in it (``at``, from 0), from a range-partitioned sort."""
    queue = read_queue(seeded, network_volumes).withColumn("later", -F.col("idx"))
    return assign_positions(queue, "at", ["priority", "later"]).drop("later")


def merge_store(store: DataFrame, read: DataFrame) -> DataFrame:
    """The store with newly read entries (path_key, size, mtime, ...), which replace those of the same path."""
    return store.join(read.select("path_key").distinct(), "path_key", "left_anti").unionByName(read.select(*store.columns))


def unmeasured(files: DataFrame) -> DataFrame:
    """Files whose size and time an update could not know: their modification time is 0."""
    return files.where("mtime = 0")


def measured(files: DataFrame, stats: DataFrame) -> DataFrame:
    """``files`` (with path, size, mtime) with the sizes and times of ``stats`` (path, size, mtime) where they have none."""
    known = stats.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("s"))
    rows = files.join(known, "path", "left")
    fresh = (F.col("mtime") == 0) & F.col("s").isNotNull()
    return rows.withColumns({c: F.when(fresh, F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("size", "mtime")}).select(*files.columns)


def status(seeded: DataFrame, network_volumes: DataFrame) -> DataFrame:
    """One row: done (known from the store) and total (files not on network volumes)."""
    local = seeded.join(network_volumes.select(F.col("letter").alias("volume")), "volume", "left_anti")
    return seeded.agg(F.count_if("cached").alias("done")).crossJoin(local.agg(F.count("*").alias("total")))  # one row each
