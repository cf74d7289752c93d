"""Absolute paths of files from flat (frn, parent_frn, name) records.

Directory chains are resolved by pointer doubling: every directory holds a pointer to
an ancestor and the path in between; each round joins the table with itself and
doubles the distance.  A chain of d directories takes log2(d) rounds instead of d, and
cycles are what is left when a round settles nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import EXCLUDED, ROOT, excluded_component, full_path, lookup_frn, record_number
from shelfspark.sources.snapshot import cut

OUTCOMES = OK, EXCLUDED_DIR, ORPHANED, CYCLE, TOO_DEEP = "ok", "excluded", "orphaned", "cycle", "too_deep"


def resolve_directories(records: DataFrame, letter: str, skip_dot: bool = True, excluded: list[str] = EXCLUDED, max_depth: int = 128) -> DataFrame:
    """(frn, path, outcome, depth) of every directory, the root always among them; path is null unless the outcome is ok.

    The root is the record with number 5 or a directory that is its own parent; depth
    counts from the root.  A chain that does not reach the root is orphaned (a parent is
    missing) or a cycle; only chains that do are tested for excluded names.  Of several
    records of one directory the last by ``seq`` counts, where records have it.
    """
    says = F.struct("parent_frn", "name")
    last = F.max_by(says, "seq") if "seq" in records.columns else F.max(says)
    dirs = records.where("is_dir").groupBy("frn").agg(last.alias("d")).select("frn", "d.*")
    is_root = (record_number(F.col("frn")) == 5) | (F.col("frn") == F.col("parent_frn"))
    roots = cut(dirs.where(is_root).select("frn"))
    under = dirs.where(~is_root)
    up = under.join(roots.select(F.col("frn").alias("parent_frn"), F.lit(True).alias("at_root")), "parent_frn", "left")
    top = F.col("at_root").isNotNull() | (record_number(F.col("parent_frn")) == 5)
    state = cut(up.select("frn", F.when(~top, F.col("parent_frn")).alias("up"), F.col("name").alias("path"), F.lit(1).cast("long").alias("depth"), excluded_component(F.col("name"), skip_dot, excluded).alias("bad"), F.lit(False).alias("lost")))
    reach, left = 1, None
    while True:
        before, left = left, state.where("up is not null and not lost").count()
        if left in (0, before):
            break  # as long as any chain has an end, each round settles some directory: what is left are cycles
        paths = reach <= 2 * max_depth  # longer chains are too deep to need one
        above = state.select(F.col("frn").alias("up"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("depth").alias("a_depth"), F.col("bad").alias("a_bad"), F.col("lost").alias("a_lost"))
        joined = state.join(above, "up", "left")
        moved = F.col("up").isNotNull() & F.col("a_depth").isNotNull()
        state = cut(joined.select(
            "frn",
            F.when(moved, F.col("a_up")).otherwise(F.col("up")).alias("up"),
            F.when(~moved, F.col("path")).otherwise(F.concat("a_path", F.lit("\\"), "path") if paths else F.lit(None)).alias("path"),
            F.when(moved, F.col("depth") + F.col("a_depth")).otherwise(F.col("depth")).alias("depth"),
            F.when(moved, F.col("bad") | F.col("a_bad")).otherwise(F.col("bad")).alias("bad"),
            (F.col("lost") | (F.col("up").isNotNull() & F.col("a_depth").isNull()) | F.coalesce("a_lost", F.lit(False))).alias("lost"),
        ))
        reach *= 2
    outcome = F.when(F.col("lost"), ORPHANED).when(F.col("up").isNotNull(), CYCLE).when(F.col("depth") > max_depth, TOO_DEEP).when(F.col("bad"), EXCLUDED_DIR).otherwise(OK)
    placed = state.select("frn", outcome.alias("outcome"), "path", "depth").withColumn("path", F.when(F.col("outcome") == OK, F.concat(F.lit(f"{letter}:\\"), "path")))
    top = roots.select(lookup_frn(F.col("frn")).alias("frn")).unionByName(records.sparkSession.range(ROOT, ROOT + 1).toDF("frn")).distinct()
    return top.select("frn", F.lit(OK).alias("outcome"), F.lit(f"{letter}:").alias("path"), F.lit(0).cast("long").alias("depth")).unionByName(placed)


def resolve_files(records: DataFrame, directories: DataFrame) -> DataFrame:
    """(frn, name, kind, dir_frn, dir, path, outcome) of every media file; path is null unless ok."""
    media = records.where("not is_dir and kind is not null")
    known = directories.select(F.col("frn").alias("dir_frn"), F.col("outcome").alias("o"), F.col("path").alias("dir"))
    rows = media.withColumn("dir_frn", lookup_frn(F.col("parent_frn"))).join(known, "dir_frn", "left")
    return rows.select("frn", "name", "kind", "dir_frn", "dir", full_path(F.col("dir"), F.col("name")).alias("path"), F.coalesce("o", F.lit(ORPHANED)).alias("outcome"))


def used_directories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(frn, path) of the directories on the way to any resolved file."""
    parts = files.where("outcome = 'ok'").select("dir").distinct().select(F.split("dir", "\\\\").alias("p"))
    on_way = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "\\"))).alias("path")).distinct()
    return directories.where("outcome = 'ok'").join(on_way, "path", "left_semi").groupBy("path").agg(F.max("frn").alias("frn")).select("frn", "path")


def outcome_counts(files: DataFrame) -> DataFrame:
    """(outcome, files)."""
    return files.groupBy("outcome").agg(F.count("*").alias("files"))
