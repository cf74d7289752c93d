"""Reports: deletions by time, type and folder; inventory of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import filetime_hour, report_extension, top_root
from shelfspark.sources.snapshot import cut

TOP_EXTENSIONS, TOP_FOLDERS = 12, 25
MOST_HOPS = 64
_WIDTHS = {"long": 8, "integer": 4, "boolean": 1}


def deletions_by_hour(deletions: DataFrame) -> DataFrame:
    return deletions.groupBy(filetime_hour(F.col("filetime")).alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def deletions_by_extension(deletions: DataFrame, top: int = TOP_EXTENSIONS) -> DataFrame:
    return deletions.where("not is_dir").groupBy(report_extension(F.col("name")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(top)


def deleted_folder_paths(deletions: DataFrame, dirs: DataFrame) -> DataFrame:
    """(volume, frn, path) of folders: those that exist, and deleted ones by their deleted ancestors.

    Deleted chains are followed by pointer doubling, up to MOST_HOPS folders; a chain
    that reaches no existing folder has no path.
    """
    gone = deletions.where("is_dir").groupBy("volume", "frn").agg(F.max_by(F.struct("parent_frn", "name"), "filetime").alias("d")).select("volume", "frn", "d.*")
    gone = gone.join(dirs.select("volume", "frn"), ["volume", "frn"], "left_anti")
    live = dirs.select("volume", F.col("frn").alias("up"), F.col("path").alias("base"))
    state = cut(gone.select("volume", "frn", F.col("parent_frn").alias("up"), F.col("name").alias("rest")).join(live, ["volume", "up"], "left"))
    hops = 1
    while hops < MOST_HOPS:
        above = state.select("volume", F.col("frn").alias("up"), F.col("up").alias("a_up"), F.col("rest").alias("a_rest"), F.col("base").alias("a_base"))
        step = state.join(above, ["volume", "up"], "left")
        open_ = F.col("base").isNull() & F.col("a_rest").isNotNull()
        state = cut(step.select("volume", "frn", F.when(open_, F.col("a_up")).otherwise(F.col("up")).alias("up"), F.when(open_, F.concat("a_rest", F.lit("\\"), "rest")).otherwise(F.col("rest")).alias("rest"), F.coalesce("base", "a_base").alias("base")))
        hops *= 2
    found = state.where("base is not null").select("volume", "frn", F.concat("base", F.lit("\\"), "rest").alias("path"))
    return dirs.select("volume", "frn", "path").unionByName(found)


def deletions_by_folder(deletions: DataFrame, dirs: DataFrame, top: int = TOP_FOLDERS) -> tuple[DataFrame, DataFrame]:
    """((path, n) most first, one row with the number of deletions whose folder is unknown)."""
    paths = deleted_folder_paths(deletions, dirs).select("volume", F.col("frn").alias("parent_frn"), "path")
    rows = deletions.where("not is_dir").join(paths, ["volume", "parent_frn"], "left")
    by_path = rows.where("path is not null").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(top)
    return by_path, rows.agg(F.count_if(F.col("path").isNull()).alias("unknown"))


def deleted_roots(deletions: DataFrame, dirs: DataFrame, top: int = TOP_FOLDERS) -> DataFrame:
    """Deleted folders whose parent still exists, by path."""
    live = dirs.select("volume", F.col("frn").alias("parent_frn"), F.col("path").alias("p"))
    return deletions.where("is_dir").join(live, ["volume", "parent_frn"]).select(F.concat("p", F.lit("\\"), "name").alias("path")).distinct().orderBy("path").limit(top)


def files_by_kind(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def files_by_volume(files: DataFrame) -> DataFrame:
    return files.groupBy("volume").agg(F.count("*").alias("files"), F.count_if(F.col("frn") != 0).alias("with_identity"))


def dirs_by_root(dirs: DataFrame) -> DataFrame:
    return dirs.groupBy(top_root(F.col("path")).alias("root")).agg(F.count("*").alias("dirs"))


def library_totals(files: DataFrame, dirs: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(dirs.agg(F.count("*").alias("dirs")))  # one row each


def deepest_path(dirs: DataFrame) -> DataFrame:
    """The deepest directory; of several, the one of the last position."""
    depth = F.size(F.split("path", "\\\\")) - 1
    return dirs.agg(F.max_by(F.struct("path", depth.alias("depth")), F.struct(depth, "dir_id")).alias("d")).select("d.*")


def systematic_sample(files: DataFrame, rows: int = 20) -> DataFrame:
    """Every so many-th file by position, ``rows`` in all."""
    step = max(files.count() // rows, 1)
    return files.where(F.col("idx") % step == 0).orderBy("idx").limit(rows)


def first_files(files: DataFrame, dirs: DataFrame, rows: int = 20) -> DataFrame:
    """(idx, path) of the first ``rows`` files by position: the files are cut before they meet the folders."""
    first = files.orderBy("idx").limit(rows)
    return first.join(dirs.select("dir_id", F.col("path").alias("dir")), "dir_id").select("idx", F.concat("dir", F.lit("\\"), "name").alias("path")).orderBy("idx")


def footprint(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(table, rows, text_bytes, number_bytes) that the tables of a library hold uncompressed, text in UTF-8, without Spark's own overhead."""

    def of(name: str, table: DataFrame) -> DataFrame:
        texts = [f.name for f in table.schema if f.dataType.typeName() == "string"]
        width = sum(_WIDTHS[f.dataType.typeName()] for f in table.schema if f.name not in texts)
        text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")
        return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("text_bytes")).select(F.lit(name).alias("table"), "rows", "text_bytes", (F.col("rows") * width).alias("number_bytes"))

    return of("files", files).unionByName(of("dirs", dirs))


def differences(kept: DataFrame, scanned: DataFrame) -> DataFrame:
    """What a library that was kept up to date has other than a full scan: (volume, frn, reason, kept_path, scanned_path).

    Both have volume, frn, dir and name.  Reasons: missing (only the scan has the file), extra (only the
    library has it), moved (another folder), renamed (another name; both may have changed, then it is moved).
    Files without a number are compared by their paths.
    """
    path = lambda t: F.concat(f"{t}.dir", F.lit("\\"), f"{t}.name")
    key = lambda df: df.select("volume", "frn", "dir", "name", F.when(F.col("frn") == 0, F.concat("dir", F.lit("\\"), "name")).otherwise("").alias("key"))
    both = key(kept).alias("k").join(key(scanned).alias("s"), ["volume", "frn", "key"], "full_outer")
    reason = F.when(F.col("k.name").isNull(), "missing").when(F.col("s.name").isNull(), "extra").when(F.col("k.dir") != F.col("s.dir"), "moved").when(F.col("k.name") != F.col("s.name"), "renamed")
    return both.select("volume", "frn", reason.alias("reason"), path("k").alias("kept_path"), path("s").alias("scanned_path")).where("reason is not null")


def difference_counts(found: DataFrame) -> DataFrame:
    """(volume, reason, n)."""
    return found.groupBy("volume", "reason").agg(F.count("*").alias("n"))
