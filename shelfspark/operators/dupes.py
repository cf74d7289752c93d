"""Duplicate files: by size, then by a fingerprint of both ends, then by the whole content.

Only files that share a size are read.  A group is a row (size, fingerprint, copies,
wasted, first); its members are rows of their own, so a group of any size is never one
array in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import full_digest, sample_fingerprint

LEAST_SIZE = 64 * 1024
GROUP_LIMIT, MOST_GROUPS = 500, 2000


def same_size(files: DataFrame, least_size: int = LEAST_SIZE) -> DataFrame:
    """Files of at least ``least_size`` bytes that share their size with another."""
    able = files.where(F.col("size") >= least_size)
    return able.join(able.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "size", "left_semi")


def fingerprinted(files: DataFrame, whole: bool = False, edge: int = 65_536) -> DataFrame:
    """``files`` (with content) and fp; files that cannot be read have a null content and drop out."""
    digest = full_digest(F.col("content")) if whole else sample_fingerprint(F.col("content"), F.col("size"), edge)
    return files.where("content is not null").withColumn("fp", digest).drop("content")


def counters(files: DataFrame, candidates: DataFrame, printed: DataFrame) -> DataFrame:
    """One row: files, candidates (those that share a size), hashed (those that could be read) and unreadable."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    read = printed.agg(F.count("fp").alias("hashed"), (F.count("*") - F.count("fp")).alias("unreadable"))
    return count(files, "files").crossJoin(count(candidates, "candidates")).crossJoin(read)  # one row each


def duplicate_groups(printed: DataFrame) -> DataFrame:
    """(size, fp, copies, wasted, first), the most wasteful first. Files without a fingerprint are in none."""
    groups = printed.where("fp is not null").groupBy("size", "fp").agg(F.count("*").alias("copies"), F.min("idx").alias("first")).where("copies > 1")
    return groups.withColumn("wasted", F.col("size") * (F.col("copies") - 1)).orderBy(F.desc("wasted"), "first")


def duplicate_members(printed: DataFrame, groups: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Every file of the ``limit`` most wasteful groups, with keep: the group's first file is kept."""
    shown = groups.orderBy(F.desc("wasted"), "first").limit(max(1, min(limit, MOST_GROUPS)))
    return printed.join(shown.select("size", "fp", "wasted", "first"), ["size", "fp"]).withColumn("keep", F.col("idx") == F.col("first"))


def group_rows(members: DataFrame) -> DataFrame:
    """Groups as one list: (wasted, first, head, n, size, idx), for each group a head row (idx null), then one for each of its members.

    The list is sorted by the group's waste, then its first file.  ``n`` is the group's number of copies.
    """
    heads = members.groupBy("wasted", "first", "size").agg(F.count("*").alias("n"))
    rows = members.select("wasted", "first", "idx", "size").join(heads.select("first", "n"), "first")  # a file is in one group only
    columns = ["wasted", "first", F.col("idx").isNull().alias("head"), "n", "size", "idx"]
    both = heads.withColumn("idx", F.lit(None).cast("long")).unionByName(rows.select(*heads.columns, "idx"))
    return both.select(*columns).orderBy(F.desc("wasted"), "first", F.desc("head"), "idx")


def totals(groups: DataFrame) -> DataFrame:
    """One row: groups and wasted, over all groups."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def find_duplicates(files: DataFrame, least_size: int = LEAST_SIZE, whole: bool = False) -> DataFrame:
    """Groups of ``files`` (idx, size, content)."""
    return duplicate_groups(fingerprinted(same_size(files, least_size), whole))
