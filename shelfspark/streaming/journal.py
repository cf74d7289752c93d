"""The change journal as a stream: records become changes, changes are merged batch by batch.

Records are final states, so a batch needs no watermark: the last record of an identity
wins, within a batch by its sequence number and across batches by their order.  Change files
are followed here, journals themselves in ``streaming.source``; a journal that was replaced or has lost records raises
JournalRestart, after which the caller rebuilds the library from a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions.fold import fold
from shelfspark.functions.media import media_kind
from shelfspark.operators.changes import delta_of
from shelfspark.sources.snapshot import CHANGES, SnapshotStore, assign_positions, shared_path

# Reasons of a journal record.
CREATED, DELETED, RENAMED_OLD, RENAMED_NEW = 0x100, 0x200, 0x1000, 0x2000
DIRECTORY = 0x10


class JournalRestart(RuntimeError):
    """The stored position is worthless: scan in full."""

    REASONS = OFF, REPLACED, LOST = "the journal is off or being deleted", "the journal was replaced", "records were lost before they were read"


@dataclass(frozen=True)
class Cursor:
    journal_id: int
    next_usn: int


def check_cursor(cursor: Cursor, journal_id: int | None, first_usn: int = 0) -> None:
    """Raise JournalRestart unless reading can go on from the cursor."""
    if journal_id is None:
        raise JournalRestart(JournalRestart.OFF)
    if journal_id != cursor.journal_id:
        raise JournalRestart(JournalRestart.REPLACED)
    if cursor.next_usn < first_usn:
        raise JournalRestart(JournalRestart.LOST)


def change_of(reason: Column) -> Column:
    """gone, present, or null for the old half of a rename."""
    bit = lambda mask: reason.bitwiseAND(F.lit(mask)) != 0
    return F.when(bit(DELETED), "gone").when(bit(RENAMED_OLD) & ~bit(RENAMED_NEW), None).otherwise("present")


def changes_of(records: DataFrame, volume: str | None = None) -> DataFrame:
    """Changes (seq, op, volume, frn, parent_frn, name, is_dir) of decoded journal records of one volume, or of those in their column volume."""
    is_dir = F.col("attrs").bitwiseAND(F.lit(DIRECTORY)) != 0
    rows = records.where("outcome = 'ok'").select(F.col("usn").alias("seq"), change_of(F.col("reason")).alias("op"), (F.lit(volume) if volume is not None else F.col("volume")).alias("volume"), "frn", "parent_frn", "name", is_dir.alias("is_dir"))
    return rows.where("op is not null")


def changes_of_volumes(records: dict[str, DataFrame]) -> DataFrame:
    """One batch of changes from the decoded journal records of several volumes, by letter; nothing of other volumes is touched by it."""
    return reduce(DataFrame.unionByName, (changes_of(rows, letter) for letter, rows in records.items()))


def deletions_of(records: DataFrame, volume: str, media_only: bool = True) -> DataFrame:
    """Deletion records (volume, frn, parent_frn, name, is_dir, filetime); directories always, files of any type on demand."""
    is_dir = F.col("attrs").bitwiseAND(F.lit(DIRECTORY)) != 0
    rows = records.where((F.col("outcome") == "ok") & (F.col("reason").bitwiseAND(F.lit(DELETED)) != 0)).select(F.lit(volume).alias("volume"), "frn", "parent_frn", "name", is_dir.alias("is_dir"), "filetime")
    return rows.where(F.col("is_dir") | media_kind(F.col("name")).isNotNull()) if media_only else rows


def journal_counts(records: DataFrame) -> DataFrame:
    """One row: records, gone, present, skipped."""
    op = change_of(F.col("reason"))
    ok = F.col("outcome") == "ok"
    return records.agg(F.count("*").alias("records"), F.count_if(ok & (op == "gone")).alias("gone"), F.count_if(ok & (op == "present")).alias("present"), F.count_if(~ok | op.isNull()).alias("skipped"))


def library_rows(files: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot tables from a library by paths: positions, folder ids and folded texts are assigned here, once."""
    placed = assign_positions(dirs.select("volume", "path", "frn").distinct(), "dir_id", ["volume", "path"])
    known = placed.select("dir_id", "volume", F.col("path").alias("dir"))
    rows = files.join(known, ["volume", "dir"]).drop("dir")
    numbered = assign_positions(rows, "idx", ["volume", "frn", "dir_id", "name"])
    out_files = numbered.select("idx", "name", fold(F.col("name")).alias("folded"), "dir_id", "kind", "volume", "frn", "size", "mtime")
    return out_files, placed.select("dir_id", "volume", "path", fold(F.col("path")).alias("folded"), "frn")


def merge_batch(store: SnapshotStore, changes: DataFrame, lookup: DataFrame | None = None) -> dict[str, int]:
    """Merge one batch into the newest snapshot; publishes a layer of what changed, if anything did."""
    now = store.load()
    if now is None:
        raise JournalRestart("there is no snapshot to apply changes to")
    delta = delta_of(now.files, now.dirs, changes, lookup)
    if delta.changed:
        store.publish_delta(delta.files, delta.files_gone, delta.dirs, delta.dirs_gone)
    return delta.counts


def follow(spark: SparkSession, changes_folder: str, store: SnapshotStore, checkpoint: str, lookup: DataFrame | None = None, poll: str | None = None) -> StreamingQuery:
    """Merge change files as they arrive in ``changes_folder``: all that are there, or every ``poll`` for ever.

    Replaying a batch after a failure is harmless: its records are final states.
    """
    stream = spark.readStream.schema(CHANGES).parquet(changes_folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: None if batch.isEmpty() else merge_batch(store, batch, lookup) and None)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def stream_last(stream: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last row of each key over all that a stream holds now.

    The state is a stateful aggregate of the stream: a batch updates the keys that it holds, and only these
    are written, as a layer of their own, so a batch that is run again replaces its own output.  A key's row is
    the one of its newest layer.
    """
    spark, folder = stream.sparkSession, shared_path(stream.sparkSession)
    rest = [c for c in stream.columns if c not in keys]
    last = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("last")).select(F.struct(*keys).alias("key"), "last")

    batches: list[int] = []

    def step(rows: DataFrame, number: int) -> None:
        batches.append(number)
        rows.write.mode("overwrite").parquet(f"{folder}/layers/layer={number}")

    last.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    layers = spark.read.schema(last.schema.add("layer", "long")).parquet(f"{folder}/layers")
    return layers.groupBy("key").agg(F.max_by("last", "layer").alias("last")).select("key.*", "last.*").select(*stream.columns)
