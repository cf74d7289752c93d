"""The library's API: build, search, update, duplicates, properties, reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from dataclasses import replace
from threading import Event, Lock, Thread

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import audit, dupes, enrich
from shelfspark.operators.search import LIMIT, SearchOptions, SearchResult, no_hits, parse_kinds, recency_cutoff, search, with_paths
from shelfspark.operators.tree import OUTCOMES, resolve_directories, resolve_files, used_directories
from shelfspark.plans.progress import Cancelled, reported
from shelfspark.sources.contents import fingerprint_paths
from shelfspark.sources.properties import read_media_properties
from shelfspark.sources.snapshot import EmptySnapshot, PropertyStore, Snapshot, SnapshotStore, carry_over, cut
from shelfspark.streaming.journal import library_rows, merge_batch

#: Seconds, about, after which a round of batches of properties is saved.
ROUND_SECONDS = 30.0


class Engine:
    """A library of media files kept as snapshots below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)
        self.snapshot: Snapshot | None = self.store.load()
        self.props: DataFrame | None = None
        self._lock = Lock()
        self._newest: dict[str, int] = {}
        self._stopped: set[str] = set()

    def reload(self) -> int | None:
        """Follow the pointer to the newest snapshot; returns its epoch."""
        epoch = self.store.current_epoch()
        if self.snapshot is None or epoch != self.snapshot.epoch:
            self.snapshot, self.props = self.store.load(epoch), None
        return epoch

    def watch(self, reloaded: Callable[[int], None] = lambda epoch: None, every: float = 5.0) -> Callable[[], None]:
        """Follow the pointer every so many seconds, so that what others publish is found here; returns what ends it.

        ``reloaded`` is told each new epoch.  A look that fails is tried again at the next one.
        """
        over = Event()

        def follow() -> None:
            while not over.wait(every):
                before = self.snapshot.epoch if self.snapshot else None
                try:
                    epoch = self.reload()
                except Exception:
                    continue  # being replaced just now
                if epoch is not None and epoch != before:
                    reloaded(epoch)

        watcher = Thread(target=follow, daemon=True)
        watcher.start()

        def end() -> None:
            over.set()
            watcher.join()

        return end

    def build(self, records: dict[str, DataFrame], stats: DataFrame | None = None, full: bool = False, tag: str | None = None, progress: str | None = None) -> dict[str, dict[str, int]]:
        """Resolve the records of each volume letter and publish a snapshot; returns outcome counts by volume.

        Volumes that are not scanned are carried over unless ``full``.  ``stats`` (path,
        size, mtime) measures the files.  Nothing is published if there would be no files.
        A build whose ``tag`` is cancelled publishes nothing and raises Cancelled.  ``progress`` names
        a file that tells how far it is (see ``plans.progress``); it says ``finished`` once the snapshot is published.
        """
        if tag is not None:
            with self._lock:
                self._stopped.discard(tag)

        def ready() -> None:
            if tag is not None and tag in self._stopped:
                raise Cancelled(tag)
            if tag is not None:
                self.spark.sparkContext.removeJobTag(tag)  # from here on it is published

        with reported(self.spark, progress, ",".join(records)) if progress else nullcontext(), self._tagged(tag):
            try:
                files, dirs, outcomes = self._resolved(records, stats, full)
                self.store.publish(*library_rows(files, dirs), ready)
            except Exception as error:
                if tag is None or tag not in self._stopped or isinstance(error, Cancelled):
                    raise
                raise Cancelled(tag) from error
            self.reload()
        return outcomes

    def _resolved(self, records: dict[str, DataFrame], stats: DataFrame | None, full: bool) -> tuple[DataFrame, DataFrame, dict[str, dict[str, int]]]:
        """Files and directories of the library after a scan, and the outcomes by volume."""
        files, dirs, outcomes = None, None, {}
        for letter, rows in records.items():
            resolved = resolve_directories(rows, letter)
            counts = Observation()  # gathered by the tasks that write the files, each of which counts once
            found = cut(resolve_files(rows, resolved).observe(counts, *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)))
            outcomes[letter] = {outcome: n for outcome, n in counts.get.items() if n}
            used = used_directories(found, resolved).withColumn("volume", F.lit(letter))
            placed = found.where("outcome = 'ok'").select(F.lit(letter).alias("volume"), "frn", "name", "kind", "dir", "path")
            files = placed if files is None else files.unionByName(placed)
            dirs = used if dirs is None else dirs.unionByName(used)
        if files is None:
            raise EmptySnapshot("no volume was read")
        known = stats if stats is not None else self.spark.createDataFrame([], "path string, size long, mtime long")
        known = known.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("s")).select("path", "s.size", "s.mtime")  # a path counts once
        files = files.join(known, "path", "left").drop("path").fillna(0, ["size", "mtime"])
        if self.snapshot is not None and not full:
            old_dirs = self.snapshot.dirs.select("volume", "frn", "path")
            old = self.snapshot.files.join(self.snapshot.dirs.select("dir_id", F.col("path").alias("dir")), "dir_id")
            scanned = self.spark.createDataFrame([(letter,) for letter in records], "volume string")
            files, dirs = carry_over(old.select(*files.columns), files, scanned), carry_over(old_dirs.select(*dirs.columns), dirs, scanned)
        return files, dirs, outcomes

    def apply_changes(self, changes: DataFrame, lookup: DataFrame | None = None) -> dict[str, int]:
        """Merge a batch of journal changes; returns the counters."""
        counts = merge_batch(self.store, changes, lookup)
        self.reload()
        return counts

    def search(self, query: str, kinds: list[str] | None = None, limit: int | None = LIMIT, within_days: int = 0, order: str = "relevance", tag: str | None = None, supersedes: str | None = None, **filters: int) -> SearchResult:
        """Ranked hits. ``filters``: min_height, min_duration_ms, max_duration_ms. ``tag`` names the job for :meth:`cancel`.
        Without a ``limit`` (None) every hit is served.

        Of searches that name the same ``supersedes`` (a search box), a newer one stops the older ones, whose
        hits are then empty; the hits of the newest are computed before it returns.
        """
        now = self._now()
        options = SearchOptions(kinds=parse_kinds(kinds or []), limit=limit, order=order, modified_after=recency_cutoff(within_days, int(time.time())), **filters)
        run = lambda: search(now.files, now.dirs, query, replace(options, limit=None if limit is None else max(1, limit)), self.props)
        if supersedes is None:
            with self._tagged(tag):
                return run()
        with self._lock:
            mine = self._newest[supersedes] = self._newest.get(supersedes, 0) + 1
        if mine > 1:
            self.spark.sparkContext.cancelJobsWithTag(f"{supersedes}-{mine - 1}")
        nothing = SearchResult(with_paths(no_hits(now.files), now.dirs))
        try:
            with self._tagged(f"{supersedes}-{mine}"):
                if self._newest[supersedes] != mine:
                    return nothing
                found = run()
                found.hits = cut(found.hits).orderBy(F.desc("key"), "idx")
        except Exception:
            if self._newest[supersedes] == mine:
                raise
            return nothing
        finally:
            if mine > 1:
                self.spark.sparkContext.cancelJobsWithTag(f"{supersedes}-{mine - 1}")  # once more: its job may have started since
        return found if self._newest[supersedes] == mine else nothing

    def cancel(self, tag: str) -> None:
        """Stop the running jobs of a tag; a run that gives all or nothing then gives nothing."""
        with self._lock:
            self._stopped.add(tag)
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _all_or_nothing(self, tag: str, run: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...] | None:
        """The tables of ``run``, computed in full; None if the tag was cancelled before they were."""
        with self._lock:
            self._stopped.discard(tag)
        try:
            with self._tagged(tag):
                out = tuple(cut(table) for table in run())
        except Exception:
            if tag not in self._stopped:
                raise
            return None
        return None if tag in self._stopped else out

    @contextmanager
    def _tagged(self, tag: str | None):
        """Jobs of this thread carry the tag; any thread may cancel them (a session's own tags are known to their thread alone)."""
        if tag:
            self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            if tag:
                self.spark.sparkContext.removeJobTag(tag)

    def status(self) -> dict[str, int | None]:
        if self.snapshot is None:
            return {"epoch": None, "files": 0, "bytes": 0, "dirs": 0}
        return {"epoch": self.snapshot.epoch, **audit.library_totals(self.snapshot.files, self.snapshot.dirs).first().asDict()}

    def duplicates(self, contents: DataFrame, limit: int = dupes.GROUP_LIMIT, whole: bool = False) -> tuple[DataFrame, DataFrame]:
        """(members of the most wasteful groups with paths, totals over all groups); ``contents`` has path and content."""
        files = self.paths()
        printed = dupes.fingerprinted(dupes.same_size(files).join(contents, "path", "left"), whole)
        groups = dupes.duplicate_groups(printed)
        return dupes.duplicate_members(printed, groups, limit), dupes.totals(groups)

    def duplicates_of_paths(self, limit: int = dupes.GROUP_LIMIT, whole: bool = False, locate: Callable[[Column], Column] = lambda path: path, tag: str | None = None) -> tuple[DataFrame, ...] | None:
        """(members, totals, counters) like :meth:`duplicates`, reading the ends of the files themselves. ``locate``: where executors find a path.

        With a ``tag`` all is computed before it returns; if the tag is cancelled meanwhile there is no answer, not a part of one.
        """
        if tag is not None:
            return self._all_or_nothing(tag, lambda: self.duplicates_of_paths(limit, whole, locate))
        files = self.paths()
        printed = cut(fingerprint_paths(dupes.same_size(files).withColumn("path", locate(F.col("path"))), whole))
        groups = dupes.duplicate_groups(printed)
        return dupes.duplicate_members(printed, groups, limit), dupes.totals(groups), dupes.counters(files, printed, printed)

    def read_properties(self, store: PropertyStore, network_volumes: DataFrame, read: Callable[[DataFrame], DataFrame] = read_media_properties, batch: int = 500, stop: Callable[[], bool] = lambda: False) -> int:
        """Read the properties of queued files by whole batches of ``batch``, saving each round; returns how many were read.

        The queue is ordered and numbered once, and a round is a range of its numbers, so the work is in
        proportion to the queue.  The first round is one batch; rounds double while they take less than half of
        ``ROUND_SECONDS`` and halve beyond it, so a long queue does not take a few jobs for each batch.  ``read`` maps
        the files of a round to entries of the store.  It goes on until the queue is done, ``stop()`` holds, or a newer
        snapshot is published, asked before each round; what was read is kept.
        """
        done, epoch = 0, self._now().epoch
        numbered = enrich.numbered_queue(enrich.seed_from_store(self.paths(), store.load()), network_volumes)
        queue = cut(numbered.repartitionByRange("at").sortWithinPartitions("at"))
        first, size, total = 0, batch, queue.count()
        while first < total:
            if stop() or self.store.current_epoch() != epoch:
                break
            began = time.monotonic()
            done += store.append(read(queue.where(F.col("at").between(first, first + size - 1))))
            took, first = time.monotonic() - began, first + size
            if took < ROUND_SECONDS / 2:
                size *= 2
            elif took > ROUND_SECONDS:
                size = max(size // batch // 2, 1) * batch
        else:
            store.compact()
        self.props = enrich.seed_from_store(self.paths(), store.load())
        return done

    def enrich(self, store: DataFrame) -> DataFrame:
        """Take properties from the store for filters by resolution and length."""
        self.props = enrich.seed_from_store(self.paths(), store)
        return self.props

    def enrich_status(self, network_volumes: DataFrame) -> dict[str, int]:
        seeded = self.props if self.props is not None else self.paths().withColumn("cached", F.lit(False))
        return enrich.status(seeded, network_volumes).first().asDict()

    def paths(self) -> DataFrame:
        """Files with their full paths."""
        now = self._now()
        return now.files.join(now.dirs.select("dir_id", F.col("path").alias("dir")), "dir_id").withColumn("path", F.concat("dir", F.lit("\\"), "name"))

    def _now(self) -> Snapshot:
        if self.snapshot is None:
            raise EmptySnapshot("the library has no snapshot yet")
        return self.snapshot
