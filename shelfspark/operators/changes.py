"""Change-journal batches merged into a snapshot.

The last record of a (volume, frn) is its final state.  Directories are settled first:
created ones (in whatever order they come), then renamed or moved ones with everything
beneath them, then deleted ones with everything beneath them.  Files follow: deleted
files and files of deleted directories go, present media files are added or moved.

A directory's ancestors are exploded into rows, so "everything beneath" is an equality
join and not a comparison of every pair of paths.  Chains of created directories are
resolved by pointer doubling among themselves.

``apply_changes`` gives the merged tables; ``delta_of`` gives only the rows of a numbered
library that a batch replaces, adds or removes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.fold import fold
from shelfspark.functions.media import lookup_frn, media_kind
from shelfspark.sources.snapshot import assign_positions, cut

LOOKUP = "volume string, frn long, answer string, path string"
COUNTERS = ("files_added", "files_removed", "files_moved", "dirs_added", "dirs_removed", "dirs_renamed", "dirs_looked_up", "unresolved", "excluded")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of every identity; frn 0 identifies nothing."""
    last = F.max_by(F.struct("op", "parent_frn", "name", "is_dir", "seq"), "seq").alias("last")
    return changes.where("frn <> 0").groupBy("volume", "frn").agg(last).select("volume", "frn", "last.*")


def _ancestors(path: Column) -> Column:
    """The path and every folder above it."""
    parts = F.split(path, "\\\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "\\"))


def below(dirs: DataFrame, tops: DataFrame) -> DataFrame:
    """(volume, path, top) for every directory at or below a top (volume, top), ignoring case; the deepest such top."""
    up = dirs.select("volume", "path", F.explode(_ancestors(F.col("path"))).alias("a"))
    hit = up.withColumn("k", F.lower("a")).join(tops.select("volume", F.lower("top").alias("k")).distinct(), ["volume", "k"])
    return hit.groupBy("volume", "path").agg(F.max_by("a", F.length("a")).alias("top"))


@dataclass
class Merge:
    """The merged library, by paths, and what happened."""

    files: DataFrame
    dirs: DataFrame
    counts: dict[str, int]

    @property
    def changed(self) -> bool:
        """Whether the result is worth publishing."""
        return any(self.counts[c] for c in ("files_added", "files_removed", "files_moved", "dirs_added", "dirs_removed", "dirs_renamed"))


def _created(known: DataFrame, last: DataFrame, lookup: DataFrame) -> tuple[DataFrame | None, int, int]:
    """(created directories and the ones looked up for them: volume, frn, path; number created, number that found no parent)."""
    mine = known.select("volume", "frn")
    pending = cut(last.where("op = 'present' and is_dir").select("volume", lookup_frn(F.col("frn")).alias("frn"), lookup_frn(F.col("parent_frn")).alias("parent_frn"), "name").join(mine, ["volume", "frn"], "left_anti"))
    if pending.isEmpty():
        return None, 0, 0
    asked = pending.select("volume", F.col("parent_frn").alias("frn")).distinct().join(mine, ["volume", "frn"], "left_anti").join(pending.select("volume", "frn"), ["volume", "frn"], "left_anti")
    found = cut(asked.join(lookup.where("answer = 'path'"), ["volume", "frn"]).select("volume", "frn", "path"))
    bases = known.select("volume", "frn", "path").unionByName(found).select("volume", F.col("frn").alias("parent_frn"), F.col("path").alias("base"))
    state = cut(pending.join(bases, ["volume", "parent_frn"], "left").select("volume", "frn", F.when(F.col("base").isNull(), F.col("parent_frn")).alias("up"), F.col("name").alias("rest"), "base"))
    left = None
    while (open_ := state.where("up is not null").count()) not in (0, left):  # each round settles a directory as long as any chain has an end
        left = open_
        above = state.select("volume", F.col("frn").alias("up"), F.col("up").alias("a_up"), F.col("rest").alias("a_rest"), F.col("base").alias("a_base"))
        step = state.join(above, ["volume", "up"], "left")
        moves = F.col("up").isNotNull() & F.col("a_rest").isNotNull()
        pick = lambda new, old: F.when(moves, new).otherwise(F.col(old)).alias(old)
        state = cut(step.select("volume", "frn", pick(F.col("a_up"), "up"), pick(F.concat("a_rest", F.lit("\\"), "rest"), "rest"), pick(F.col("a_base"), "base")))
    created = state.where("up is null").select("volume", "frn", F.concat("base", F.lit("\\"), "rest").alias("path"))
    return found.unionByName(created), created.count(), open_


def _renamed(dirs: DataFrame, last: DataFrame) -> tuple[DataFrame | None, int]:
    """((volume, path, new) of directories that are renamed, moved, or beneath such; number renamed or moved)."""
    parents = dirs.select("volume", F.col("frn").alias("parent_frn"), F.col("path").alias("p"))
    says = last.where("op = 'present' and is_dir").select("volume", lookup_frn(F.col("frn")).alias("frn"), lookup_frn(F.col("parent_frn")).alias("parent_frn"), "name")
    moves = cut(says.join(dirs, ["volume", "frn"]).join(parents, ["volume", "parent_frn"]).where("path <> concat(p, '\\\\', name)").select("volume", F.col("path").alias("top"), "p", "name"))
    n = moves.count()
    if not n:
        return None, 0
    # A new parent may itself be renamed, or lie below a renamed folder: settle moves whose parent is settled.
    above = below(moves.select("volume", F.col("p").alias("path")).distinct(), moves).withColumnsRenamed({"path": "p", "top": "p_top"})
    open_ = cut(moves.join(above, ["volume", "p"], "left"))
    settled = None
    while True:  # moves into each other's folders are never settled and stay as they were
        if settled is None:
            step = open_.where("p_top is null").select("volume", "top", F.concat("p", F.lit("\\"), "name").alias("to"))
        else:
            known = settled.select("volume", F.lower("top").alias("k"), F.col("to").alias("p_to"))
            ready = open_.withColumn("k", F.lower("p_top")).join(known, ["volume", "k"])
            step = ready.select("volume", "top", F.concat("p_to", F.expr("substring(p, length(p_top) + 1)"), F.lit("\\"), "name").alias("to"))
        step = cut(step)
        settled = step if settled is None else cut(settled.unionByName(step))
        open_ = cut(open_.join(step.select("volume", "top"), ["volume", "top"], "left_anti"))
        if step.isEmpty() or open_.isEmpty():
            break
    moved = below(dirs, settled).withColumn("k", F.lower("top")).join(settled.select("volume", F.lower("top").alias("k"), "to"), ["volume", "k"])
    return cut(moved.select("volume", "path", F.concat("to", F.expr("substring(path, length(top) + 1)")).alias("new"))), n


@dataclass
class _Settled:
    """Directories after a batch: volume, frn, path, was (and what else ``dirs`` had; null for new ones); those that are gone; counters."""

    after: DataFrame
    dead: DataFrame
    counts: dict[str, int]


def _settled(dirs: DataFrame, last: DataFrame, lookup: DataFrame) -> _Settled:
    """What a batch does to directories. Only what it changes is written; ``after`` is a plan over ``dirs``."""
    known = dirs.withColumn("frn", lookup_frn(F.col("frn")))
    new, added, homeless = _created(known, last, lookup)
    whole = known if new is None else known.unionByName(new, allowMissingColumns=True)
    renamed, n_renamed = _renamed(whole.select("volume", "frn", "path"), last)
    after = whole.withColumn("was", F.col("path"))
    if renamed is not None:
        after = whole.join(renamed, ["volume", "path"], "left").withColumn("was", F.col("path")).withColumn("path", F.coalesce("new", "path")).drop("new")
    tops = cut(after.join(last.where("op = 'gone'").select("volume", lookup_frn(F.col("frn")).alias("frn")), ["volume", "frn"], "left_semi").select("volume", F.col("path").alias("top")))
    none = tops.isEmpty()
    dead = tops.select("volume", F.col("top").alias("path")) if none else cut(below(after, tops).select("volume", "path"))
    return _Settled(after, dead, {"dirs_added": added, "dirs_renamed": n_renamed, "dirs_removed": 0 if none else dead.count(), "unresolved": homeless})


def _answers(lookup: DataFrame | None, spark) -> DataFrame:
    """One answer for each directory, a path before others."""
    lookup = (lookup if lookup is not None else spark.createDataFrame([], LOOKUP)).withColumn("frn", lookup_frn(F.col("frn")))
    return lookup.groupBy("volume", "frn").agg(F.min(F.struct(F.expr("answer <> 'path'").alias("no"), "answer", "path")).alias("a")).select("volume", "frn", "a.answer", "a.path")


def _present_files(last: DataFrame) -> DataFrame:
    return last.where("op = 'present' and not is_dir").select("volume", "frn", "name", lookup_frn(F.col("parent_frn")).alias("parent_frn"), media_kind(F.col("name")).alias("kind"))


def _looked_up(present: DataFrame, after: DataFrame, lookup: DataFrame) -> DataFrame:
    """Answers about the parents of files that no directory is."""
    wanted = present.select("volume", F.col("parent_frn").alias("frn")).distinct().join(after.select("volume", "frn"), ["volume", "frn"], "left_anti")
    return cut(wanted.join(lookup, ["volume", "frn"]))


def _declined(found: DataFrame) -> DataFrame:
    return found.where("answer = 'excluded'").select("volume", F.col("frn").alias("parent_frn"), F.lit(True).alias("is_excluded"))


def _tally(media: DataFrame, home: str) -> dict[str, int]:
    return media.agg(
        F.count_if(F.expr(f"{home} is not null and known is null")).alias("files_added"), F.count_if(F.expr(f"{home} is not null and known")).alias("files_moved"),
        F.count_if(F.expr(f"{home} is null and is_excluded")).alias("excluded"), F.count_if(F.expr(f"{home} is null and is_excluded is null")).alias("unresolved"),
    ).first().asDict()


def apply_changes(files: DataFrame, dirs: DataFrame, changes: DataFrame, lookup: DataFrame | None = None) -> Merge:
    """Merge ``changes`` into a library of files (volume, frn, name, kind, dir, size, mtime) and dirs (volume, frn, path).

    ``lookup`` (volume, frn, answer, path) names directories that the library does not
    know: answer is path, excluded or unknown.  A file that a change leaves without a
    media name or a known folder leaves the library and counts as removed.
    """
    lookup = _answers(lookup, files.sparkSession)
    last = cut(latest_changes(changes))
    settled = _settled(dirs.select("volume", "frn", "path"), last, lookup)
    present = _present_files(last)
    found = _looked_up(present, settled.after, lookup)
    alive = settled.after.join(settled.dead, ["volume", "path"], "left_anti").select("volume", "frn", "path", "was")
    alive = cut(alive.unionByName(found.where("answer = 'path'").select("volume", "frn", "path", F.col("path").alias("was"))))

    touched = last.where("not coalesce(is_dir, false)").select("volume", "frn")
    untouched = files.join(touched, ["volume", "frn"], "left_anti")
    homes = alive.select("volume", F.col("was").alias("dir"), F.col("path").alias("now")).distinct()
    carried = untouched.join(homes, ["volume", "dir"]).select("volume", "frn", "name", "kind", F.col("now").alias("dir"), "size", "mtime")

    targets = alive.select("volume", F.col("frn").alias("parent_frn"), F.col("path").alias("dir"))
    before = files.where("frn <> 0").select("volume", "frn", "size", "mtime", F.lit(True).alias("known"))
    media = cut(present.where("kind is not null").join(targets, ["volume", "parent_frn"], "left").join(_declined(found), ["volume", "parent_frn"], "left").join(before, ["volume", "frn"], "left"))
    placed = media.where("dir is not null").select("volume", "frn", "name", "kind", "dir", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "mtime")))
    out = cut(carried.unionByName(placed))

    counts = {**settled.counts, **(tally := _tally(media, "dir")), "dirs_looked_up": found.where("answer = 'path'").count()}
    counts["unresolved"] = settled.counts["unresolved"] + tally["unresolved"]
    counts["files_removed"] = files.count() + counts["files_added"] - out.count()
    return Merge(out, alive.select("volume", "frn", "path").distinct(), {c: counts[c] for c in COUNTERS})


@dataclass
class Delta:
    """The rows of a numbered library that a batch replaces or adds, the numbers of those it removes, and what happened."""

    files: DataFrame
    files_gone: DataFrame
    dirs: DataFrame
    dirs_gone: DataFrame
    counts: dict[str, int]

    @property
    def changed(self) -> bool:
        return any(self.counts[c] for c in ("files_added", "files_removed", "files_moved", "dirs_added", "dirs_removed", "dirs_renamed"))


def delta_of(files: DataFrame, dirs: DataFrame, changes: DataFrame, lookup: DataFrame | None = None) -> Delta:
    """What ``changes`` do to the tables of a snapshot (``snapshot.FILES`` and ``DIRS``): the same merge as :func:`apply_changes`.

    Files and directories keep their numbers, new ones get the next; so a renamed directory is one row, however
    many files it holds.  What is written is in proportion to what the batch changes.
    """
    lookup = _answers(lookup, files.sparkSession)
    last = cut(latest_changes(changes))
    settled = _settled(dirs.select("dir_id", "volume", "frn", "path"), last, lookup)
    present = _present_files(last)
    found = _looked_up(present, settled.after, lookup)
    alive = settled.after.join(settled.dead, ["volume", "path"], "left_anti")
    looked_up = found.where("answer = 'path'").select("volume", "frn", "path")
    next_file, next_dir = (int(t.agg(F.max(c)).first()[0] or 0) + 1 for t, c in ((files, "idx"), (dirs, "dir_id")))
    fresh = cut(alive.where("dir_id is null").select("volume", "frn", "path").unionByName(looked_up).distinct())
    fresh = cut(assign_positions(fresh, "at", ["volume", "path", "frn"]).withColumn("dir_id", F.col("at") + F.lit(next_dir)).drop("at"))
    kept = alive.where("dir_id is not null")

    touched = last.where("not coalesce(is_dir, false)").select("volume", "frn")
    targets = kept.select("volume", "frn", "dir_id").unionByName(fresh.select("volume", "frn", "dir_id")).withColumnRenamed("frn", "parent_frn")
    before = cut(files.where("frn <> 0").join(touched, ["volume", "frn"], "left_semi").select("volume", "frn", "idx", "size", "mtime", F.lit(True).alias("known")))
    media = cut(present.where("kind is not null").join(targets, ["volume", "parent_frn"], "left").join(_declined(found), ["volume", "parent_frn"], "left").join(before, ["volume", "frn"], "left"))
    placed = media.where("dir_id is not null")
    new = assign_positions(placed.where("known is null"), "at", ["volume", "frn", "dir_id", "name"]).withColumn("idx", F.col("at") + F.lit(next_file)).drop("at")
    rows = placed.where("known").unionByName(new.select(*placed.columns))
    upserts = rows.select("idx", "name", fold(F.col("name")).alias("folded"), "dir_id", "kind", "volume", "frn", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "mtime")))

    lost = before.join(placed.where("known").select("idx"), "idx", "left_anti").select("idx")
    dirs_gone = cut(settled.after.where("dir_id is not null").join(settled.dead, ["volume", "path"], "left_semi").select("dir_id").distinct())
    if not dirs_gone.isEmpty():
        lost = lost.unionByName(files.join(dirs_gone, "dir_id", "left_semi").join(touched, ["volume", "frn"], "left_anti").select("idx"))
    files_gone = cut(lost.distinct())
    renamed = kept.where("path <> was").select("dir_id", "volume", "path", "frn").unionByName(fresh.select("dir_id", "volume", "path", "frn"))
    dirs_now = renamed.select("dir_id", "volume", "path", fold(F.col("path")).alias("folded"), "frn")

    counts = {**settled.counts, **(tally := _tally(media, "dir_id")), "dirs_looked_up": looked_up.count(), "files_removed": files_gone.count()}
    counts["unresolved"] = settled.counts["unresolved"] + tally["unresolved"]
    return Delta(upserts, files_gone, dirs_now, dirs_gone, {c: counts[c] for c in COUNTERS})
