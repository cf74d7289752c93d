"""Change journals of volumes as a streaming source: ``spark.readStream.format("journal")``.

Below one folder that driver and executors share, each volume has a folder with ``state.json``
(journal_id, first_usn, next_usn, active) and, for each journal, buffers of version 2 records
named by their first sequence number: ``D/7/00000000000000004096.usn``.

Offsets are (journal, next sequence number) for each volume, kept in the query's checkpoint,
so a stream that stops goes on where it was.  A batch is planned as buffers: a partition for
each ``buffersPerTask`` of a volume, decoded whole (see ``sources.records``) and cut to the
batch's range.  A journal that is off, was replaced, or has dropped records that were not yet read
ends the stream with :class:`~shelfspark.streaming.journal.JournalRestart`.

Options: ``path``; ``from`` (``first``: everything a journal holds, or ``now``: what comes after
the start; a volume that appears later is read from its first record); ``volumes`` (letters with commas
between: no other volume's state or buffers are read); ``buffersPerTask``.  The
source keeps nothing that a commit could release; :func:`positions` reads what a checkpoint has committed.

A record without a sequence number (broken, or of another version) belongs to the batch that
holds its buffer's first one, so it is counted once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from shelfspark.session import ship_package
from shelfspark.sources.properties import located
from shelfspark.sources.records import SCHEMA, batches_of
from shelfspark.sources.snapshot import SnapshotStore
from shelfspark.streaming.journal import Cursor, JournalRestart, changes_of, check_cursor, merge_batch

RECORDS = "volume string, journal_id long, source string, at long, outcome string, frn long, parent_frn long, usn long, filetime long, reason long, attrs long, name string"
_ARROW = pa.schema([("volume", pa.string()), ("journal_id", pa.int64()), *SCHEMA])
BUFFERS_PER_TASK = 16


class State(NamedTuple):
    """Where a volume's journal stands."""

    journal_id: int
    first_usn: int
    next_usn: int
    active: bool


class Buffers(InputPartition):
    """Buffers of one journal, and the range of sequence numbers that is wanted of them."""

    def __init__(self, volume: str, journal_id: int, start: int, end: int, files: list[tuple[int, str]]):
        self.volume, self.journal_id, self.start, self.end, self.files = volume, journal_id, start, end, files


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return RECORDS

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(dict(self.options))


class JournalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.begin = options["path"], options.get("from", "first")
        self.buffers_per_task = int(options.get("bufferspertask", BUFFERS_PER_TASK))
        self.volumes = frozenset(v.strip().upper() for v in options.get("volumes", "").split(",") if v.strip())
        if self.begin not in ("first", "now"):
            raise ValueError(f"from must be first or now, not {self.begin}")

    def initialOffset(self) -> dict:
        return {v: {"journal": s.journal_id, "next": s.first_usn if self.begin == "first" else s.next_usn} for v, s in states(self.path, self.volumes).items() if s.active}

    def latestOffset(self) -> dict:
        return {v: {"journal": s.journal_id, "next": s.next_usn} for v, s in states(self.path, self.volumes).items() if s.active}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        now, out = states(self.path, self.volumes), []
        for volume in sorted({*start, *end}):
            state = now.get(volume)
            upto = end.get(volume)
            if volume in start:
                cursor = Cursor(start[volume]["journal"], start[volume]["next"])
            else:
                cursor = Cursor(upto["journal"], state.first_usn if state else 0)
            if upto is not None and upto["journal"] == cursor.journal_id and upto["next"] <= cursor.next_usn:
                continue  # nothing new
            check_cursor(cursor, state.journal_id if state and state.active and upto is not None else None, state.first_usn if state else 0)
            if upto["journal"] != cursor.journal_id:
                check_cursor(cursor, upto["journal"])
            files = buffers_between(self.path, volume, cursor.journal_id, cursor.next_usn, upto["next"])
            for i in range(0, len(files), self.buffers_per_task):
                out.append(Buffers(volume, cursor.journal_id, cursor.next_usn, upto["next"], files[i : i + self.buffers_per_task]))
        return out

    def read(self, partition: Buffers) -> Iterator[pa.RecordBatch]:
        for first, name in partition.files:
            system, path = located(f"{self.path}/{partition.volume}/{partition.journal_id}/{name}")
            with system.open_input_file(path) as file:
                content = file.read()
            for batch in batches_of(name, content):
                inside = pc.and_(pc.greater_equal(batch["usn"], partition.start), pc.less(batch["usn"], partition.end))
                batch = batch.filter(pc.fill_null(inside, partition.start <= first < partition.end))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([partition.volume] * n, pa.string()), pa.array([partition.journal_id] * n, pa.int64()), *batch.columns], schema=_ARROW)


def states(path: str, volumes: frozenset[str] = frozenset()) -> dict[str, State]:
    """The state of each volume below ``path``, or of those named."""
    system, root = located(path)
    out = {}
    for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if volumes and entry.base_name.upper() not in volumes:
            continue
        name = f"{entry.path}/state.json"
        if entry.type == fs.FileType.Directory and system.get_file_info(name).type == fs.FileType.File:
            with system.open_input_file(name) as file:
                out[entry.base_name] = State(**json.loads(file.read()))
    return out


def buffers_between(path: str, volume: str, journal_id: int, start: int, end: int) -> list[tuple[int, str]]:
    """(first sequence number, file name) of the buffers that may hold records from ``start`` to before ``end``."""
    system, root = located(f"{path}/{volume}/{journal_id}")
    found = sorted((int(e.base_name[:-4]), e.base_name) for e in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if e.base_name.endswith(".usn"))
    after = [first for first, _ in found[1:]] + [end]
    return [(first, name) for (first, name), following in zip(found, after, strict=True) if first < end and following > start] if found else []


def put(path: str, content: str | bytes) -> None:
    """Write a file whole, by renaming."""
    system, name = located(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{name}.tmp") as out:
        out.write(content.encode() if isinstance(content, str) else content)
    system.move(f"{name}.tmp", name)


def write_state(path: str, volume: str, journal_id: int, first_usn: int, next_usn: int, active: bool = True) -> None:
    """Say where a volume's journal stands; readers see its buffers up to ``next_usn``."""
    put(f"{path}/{volume}/state.json", json.dumps(State(journal_id, first_usn, next_usn, active)._asdict()))


def write_buffers(buffers: DataFrame, path: str) -> int:
    """Write buffers (volume, journal_id, first_usn, content) as files, in tasks; returns how many. A repeated task writes the same files again."""
    ship_package(buffers.sparkSession)

    def part(batches):
        for batch in batches:
            *where, contents = batch.columns
            for volume, journal_id, first, content in zip(*(c.to_pylist() for c in where), contents, strict=True):
                system, folder = located(f"{path}/{volume}/{journal_id}")
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{first:020d}.usn") as out:
                    out.write(content.as_buffer())  # not copied
            n = batch.num_rows
            batch = where = contents = content = None  # else they would stay while the next is read
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return buffers.select("volume", "journal_id", "first_usn", "content").mapInArrow(part, "n long").groupBy().sum("n").first()[0] or 0


def journal_stream(spark: SparkSession, path: str, begin: str = "first", **options: str | int) -> DataFrame:
    """The records of all volumes below ``path`` as a stream (``RECORDS``)."""
    ship_package(spark)
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("journal").option("path", path).option("from", begin).options(**options).load()


def follow_journals(spark: SparkSession, path: str, store: SnapshotStore, checkpoint: str, lookup: DataFrame | None = None, begin: str = "first", poll: str | None = None, **options: str | int) -> StreamingQuery:
    """Merge the journals' changes into the library as they come: all that are there, or every ``poll`` for ever."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            merge_batch(store, batch, lookup)

    return started(changes_of(journal_stream(spark, path, begin, **options)), merge, checkpoint, poll)


def positions(checkpoint: str) -> dict[str, Cursor]:
    """Each volume's cursor after the last batch that the stream of this checkpoint has committed."""
    system, root = located(checkpoint)
    done = [int(e.base_name) for e in system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)) if e.base_name.isdigit()]
    if not done:
        return {}
    with system.open_input_file(f"{root}/offsets/{max(done)}") as file:
        offsets = json.loads(file.read().decode().splitlines()[2])  # after the version and the batch's settings
    return {volume: Cursor(at["journal"], at["next"]) for volume, at in offsets.items()}


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def finished(query: StreamingQuery) -> None:
    """Wait for a stream; raises JournalRestart if its position is worthless."""
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        for reason in JournalRestart.REASONS:
            if f"JournalRestart: {reason}" in str(error):
                raise JournalRestart(reason) from error
        raise
