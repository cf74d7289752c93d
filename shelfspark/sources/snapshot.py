"""Versioned snapshots of the library: one folder for each epoch and a pointer to the newest.

A new epoch is written beside the old ones and published by writing its pointer, so a
reader sees one complete snapshot or the other.  Publishing refuses to replace rows by
nothing, and an update without effect is not written at all.

An epoch is whole, or a layer on the epochs before it down to a whole one: rows that replace those
of the same number, and the numbers of rows that are gone.  A reader takes each row from its newest
layer.  Once there are ``MOST_LAYERS``, or their rows pass a share of the whole, the next epoch is whole again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
FILES = "idx long, name string, folded string, dir_id long, kind string, volume string, frn long, size long, mtime long"
DIRS = "dir_id long, volume string, path string, folded string, frn long"
RECORDS = "frn long, parent_frn long, name string, is_dir boolean, kind string"
CHANGES = "seq long, op string, volume string, frn long, parent_frn long, name string, is_dir boolean"
PROPS = "path_key string, size long, mtime long, width int, height int, duration_ms long, attempted boolean"
VOLUMES = "letter string, serial long, journal_id long, next_usn long, file_count long, filesystem string, label string, kind string, remote string"
#: Spark's setting that a query's shuffle files are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
POINTERS = "epoch long, schema_version int, base long, changed long, rows long"


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir), below one folder for the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/shelfspark-checkpoints"  # one machine: driver and executors share it
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors.

    The shuffle files of the job that writes it are removed when it ends, so the disk that a chain of
    such steps takes is that of its largest step, not of all of them.
    """
    path, conf = shared_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class EmptySnapshot(ValueError):
    """Publishing would replace data by nothing."""


@dataclass
class Snapshot:
    epoch: int
    files: DataFrame
    dirs: DataFrame


class SnapshotStore:
    """Snapshots below one folder that driver and executors share."""

    MOST_LAYERS, MOST_SHARE = 16, 0.2
    TABLES = {"files": (FILES, "idx"), "dirs": (DIRS, "dir_id")}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _published(self) -> dict[int, tuple[int | None, int, int]]:
        """By epoch of this schema version: the epoch it is a layer on (null: it is whole), its changed rows, the rows of the whole one."""
        try:
            pointers = self.spark.read.schema(POINTERS).json(f"{self.root}/published").where(F.col("schema_version") == SCHEMA_VERSION)
            return {r["epoch"]: (r["base"], r["changed"] or 0, r["rows"] or 0) for r in pointers.collect()}  # one row an epoch
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return {}

    def current_epoch(self) -> int | None:
        """The newest published epoch of this schema version; others are ignored."""
        return max(self._published(), default=None)

    def load(self, epoch: int | None = None) -> Snapshot | None:
        published = self._published()
        epoch = max(published, default=None) if epoch is None else epoch
        if epoch is None:
            return None
        layers = [epoch]
        while (base := published.get(layers[-1], (None, 0, 0))[0]) is not None:
            layers.append(base)
        return Snapshot(epoch, *(self._merged(name, layers) for name in self.TABLES))

    def _merged(self, name: str, layers: list[int]) -> DataFrame:
        """A table of the epochs ``layers``, newest first; the last is whole."""
        schema, key = self.TABLES[name]
        read = lambda epoch, table, columns: self.spark.read.schema(columns).parquet(f"{self.root}/epoch={epoch}/{table}")
        whole = read(layers[-1], name, schema)
        own = whole.columns
        if len(layers) == 1:
            return whole
        changed = None
        for epoch in layers[:-1]:
            rows = read(epoch, name, schema).withColumn("gone", F.lit(False)).unionByName(read(epoch, f"{name}_gone", f"{key} long").withColumn("gone", F.lit(True)), allowMissingColumns=True).withColumn("layer", F.lit(epoch))
            changed = rows if changed is None else changed.unionByName(rows)
        rest = [c for c in own if c != key]
        last = changed.groupBy(key).agg(F.max_by(F.struct("gone", *rest), "layer").alias("r")).select(key, "r.*")
        return whole.join(last.select(key), key, "left_anti").select(*own).unionByName(last.where("not gone").select(*own))

    def publish(self, files: DataFrame, dirs: DataFrame, ready: Callable[[], None] = lambda: None) -> int:
        """Write a new epoch and point to it. Raises EmptySnapshot if there are no files; what ``ready`` raises, between the two, stops it too."""
        epoch = (self.current_epoch() or 0) + 1
        for name, table in (("files", files), ("dirs", dirs)):
            table.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/{name}")
        rows = self._merged("files", [epoch]).count()
        if not rows:
            raise EmptySnapshot(f"epoch {epoch} has no files and is not published")
        ready()
        self._point(epoch, None, 0, rows)
        return epoch

    def publish_delta(self, files: DataFrame, files_gone: DataFrame, dirs: DataFrame, dirs_gone: DataFrame) -> int:
        """Write a layer of changed rows on the newest epoch and point to it; raises EmptySnapshot if no file would be left."""
        published = self._published()
        base = max(published)
        epoch = base + 1
        changed = 0
        for name, rows, gone in (("files", files, files_gone), ("dirs", dirs, dirs_gone)):
            key = self.TABLES[name][1]
            rows.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/{name}")
            gone.select(key).write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/{name}_gone")
            changed += sum(self.spark.read.parquet(f"{self.root}/epoch={epoch}/{t}").count() for t in (name, f"{name}_gone"))
        layers, below, rows = [epoch, base], published[base], published[base][2]
        while below[0] is not None:
            layers.append(below[0])
            changed, below = changed + below[1], published[below[0]]
            rows = below[2]
        merged = {name: self._merged(name, layers) for name in self.TABLES}
        if merged["files"].isEmpty():
            raise EmptySnapshot(f"epoch {epoch} would have no files and is not published")
        if len(layers) > self.MOST_LAYERS or changed > self.MOST_SHARE * max(rows, 1):
            whole = {name: cut(table) for name, table in merged.items()}
            return self.publish(whole["files"], whole["dirs"])
        self._point(epoch, base, changed - sum(published[e][1] for e in layers[1:]), rows)
        return epoch

    def _point(self, epoch: int, base: int | None, changed: int, rows: int) -> None:
        columns = {"epoch": F.lit(epoch).cast("long"), "schema_version": F.lit(SCHEMA_VERSION), "base": F.lit(base).cast("long"), "changed": F.lit(changed).cast("long"), "rows": F.lit(rows).cast("long")}
        self.spark.range(1).select(*(c.alias(n) for n, c in columns.items())).write.mode("append").json(f"{self.root}/published")


class PropertyStore:
    """Media properties (``PROPS``) below one folder, in versions like snapshots; those of another schema version are ignored.

    A version may be followed by layers: entries that replace those of the same path.  Appending a
    layer costs what its entries cost; every ``MOST_LAYERS`` layers become one new version.
    """

    MOST_LAYERS = 64
    POINTERS = "epoch long, schema_version int, layer long"

    def __init__(self, spark: SparkSession, root: str, schema_version: int = SCHEMA_VERSION):
        self.spark, self.root, self.schema_version = spark, root.rstrip("/"), schema_version

    def _published(self) -> list[tuple[int, int, int | None]]:
        """(version, schema version, layer) of all that was published: a row for each version and layer."""
        try:
            return [tuple(r) for r in self.spark.read.schema(self.POINTERS).json(f"{self.root}/published").collect()]
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []

    def _newest(self) -> tuple[int, list[int]]:
        """The newest version of this schema (0: none) and its layers, in order."""
        mine = [(v, layer) for v, schema, layer in self._published() if schema == self.schema_version]
        newest = max((v for v, layer in mine if layer is None), default=0)
        return newest, sorted(layer for v, layer in mine if v == newest and layer is not None)

    def _folder(self, version: int, layer: int | None = None) -> str:
        return f"{self.root}/version={version}" + (f".{self.schema_version}.layer={layer}" if layer is not None else "")

    def load(self) -> DataFrame:
        """The newest entries; empty if there are none of this schema version."""
        version, layers = self._newest()
        read = lambda folder: self.spark.read.schema(PROPS).parquet(folder)
        base = read(self._folder(version)) if version else self.spark.createDataFrame([], PROPS)
        if not layers:
            return base
        own = base.columns
        whole = base.withColumn("layer", F.lit(0))
        for k in layers:
            whole = whole.unionByName(read(self._folder(version, k)).withColumn("layer", F.lit(k)))
        last = whole.groupBy("path_key").agg(F.max("layer").alias("layer"))
        return whole.join(last, ["path_key", "layer"]).select(*own)

    def append(self, entries: DataFrame) -> int:
        """Save entries that replace those of the same paths, without touching the others; returns how many."""
        version, layers = self._newest()
        layer = max(layers, default=0) + 1
        entries.select(*(c.split()[0] for c in PROPS.split(", "))).write.mode("overwrite").parquet(self._folder(version, layer))
        self._point(version, layer)
        if len(layers) + 1 >= self.MOST_LAYERS:
            self.compact()
        return self.spark.read.schema(PROPS).parquet(self._folder(version, layer)).count()

    def compact(self) -> int:
        """The newest version, with its layers merged into one."""
        version, layers = self._newest()
        return self.save(self.load()) if layers else version

    def save(self, store: DataFrame) -> int:
        """Write all entries beside the old ones and point to them."""
        version = max((v for v, _, _ in self._published()), default=0) + 1
        store.write.mode("overwrite").parquet(self._folder(version))
        self._point(version)
        return version

    def _point(self, version: int, layer: int | None = None) -> None:
        pointer = self.spark.range(1).select(F.lit(version).cast("long").alias("epoch"), F.lit(self.schema_version).alias("schema_version"), F.lit(layer).cast("long").alias("layer"))
        pointer.write.mode("append").json(f"{self.root}/published")


def assign_positions(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``rows`` with ``name``, the position from 0 in the given order: the same however the rows arrive.

    Positions are counted within parts of the sorted table and offset by the parts' sizes.
    """
    dealt = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    starts = sizes.select("_part", "first", before.alias("start"))
    return parts.join(starts, "_part").withColumn(name, F.col("start") + F.col("_at") - F.col("first")).drop("_part", "_at", "first", "start")


def carry_over(old: DataFrame, new: DataFrame, scanned: DataFrame) -> DataFrame:
    """``new`` and those rows of ``old`` whose volume was not scanned.

    ``scanned`` has the volumes of this scan in one column of the tables; one that was scanned and
    found empty keeps nothing.
    """
    return old.join(scanned.distinct(), scanned.columns, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
