"""Progress of a long job as a control record in a file, for other processes to read.

The record is replaced whole, by renaming, at most every ``EVERY`` seconds; what it counts are tasks of the jobs
that the block has started, from Spark's own status, so no row is counted twice and no plan is changed.  The
record that ends it (``finished``, ``failed``, ``cancelled``) is written last: who reads ``finished`` finds
what the block has published.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event, Thread

import pyarrow as pa
from pyspark.sql import SparkSession

from shelfspark.functions.control import Record, record_of
from shelfspark.sources.properties import located
from shelfspark.streaming.source import put

EVERY = 0.1


class Cancelled(RuntimeError):
    """The job was stopped; nothing was published."""


class ProgressWriter:
    """Writes the newest state of a job, not each one."""

    def __init__(self, path: str, volume: str = "", every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.path, self.volume, self.every, self.clock = path, volume, every, clock
        self.written = -float("inf")

    def tick(self, done: int, total: int) -> bool:
        """Write, if enough time has passed since the last write; returns whether it did."""
        if self.clock() - self.written < self.every:
            return False
        self._write(Record("progress", self.volume, done, total))
        return True

    def end(self, kind: str, done: int, total: int, error: str | None = None) -> None:
        self._write(Record(kind, self.volume, done, total, error))

    def _write(self, record: Record) -> None:
        self.written = self.clock()
        put(self.path, record.text())


def read_progress(path: str) -> Record | None:
    """The newest record; None if there is none that can be used."""
    try:
        system, name = located(path)
        with system.open_input_file(name) as file:
            return record_of(file.read().decode(errors="replace"))
    except (OSError, pa.ArrowException):
        return None


def tagged_tasks(spark: SparkSession, tag: str) -> tuple[int, int]:
    """(done, known) tasks of the jobs of a tag. A stage that several jobs share counts once; one that a finished job skipped does not count."""
    context = spark.sparkContext
    tracker, stages = context.statusTracker(), {}
    for job in context._jsc.sc().statusTracker().getJobIdsForTag(tag):  # not in the Python API
        info = tracker.getJobInfo(job)
        for number in info.stageIds if info else ():
            stage = tracker.getStageInfo(number)
            if stage and (stage.numCompletedTasks or info.status == "RUNNING"):
                stages[number] = stage.numCompletedTasks, stage.numTasks
    return sum(d for d, _ in stages.values()), sum(n for _, n in stages.values())


@contextmanager
def reported(spark: SparkSession, path: str, volume: str = "", every: float = EVERY) -> Iterator[None]:
    """Tell in the file ``path`` how far the Spark jobs of the block are, and how it ended."""
    writer, tag, over = ProgressWriter(path, volume, every), f"progress-{uuid.uuid4().hex}", Event()
    most = 0

    def seen() -> tuple[int, int]:
        nonlocal most
        done, known = tagged_tasks(spark, tag)
        most = max(most, done)  # Spark forgets old jobs
        return most, max(most, known)

    def watch() -> None:
        while not over.wait(every):
            writer.tick(*seen())

    writer.tick(0, 0)
    watcher = Thread(target=watch, daemon=True)
    watcher.start()
    spark.sparkContext.addJobTag(tag)

    def end(kind: str, error: str | None = None) -> None:
        over.set()
        watcher.join()
        done, known = seen()
        writer.end(kind, done, done if kind == "finished" else known, error)  # stages that a job skips are known, but never done

    try:
        yield
    except Cancelled:
        end("cancelled")
        raise
    except BaseException as error:
        end("failed", str(error)[:1000])
        raise
    else:
        end("finished")
    finally:
        spark.sparkContext.removeJobTag(tag)
