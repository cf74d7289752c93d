"""Queries over scan buffers, journals, snapshots and stores, shaped from the test tables, with DuckDB SQL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import control, media
from shelfspark.operators import audit, changes, dupes, enrich, search, tree
from shelfspark.plans.engine import Engine
from shelfspark.plans.progress import read_progress
from shelfspark.queries import _contents, _hits, _PARTS, _read, _score_sql, _seeded, _SEEDED, _TREE, _tree_records, part_library, query
from shelfspark.sources import records, volumes
from shelfspark.sources.snapshot import EmptySnapshot, PropertyStore, SnapshotStore, cut, shared_path
from shelfspark.streaming import journal, source

# ---- binary records ------------------------------------------------------------------------


def _buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as binary journal records: errors delete, views create, clicks are the old halves of renames, others the new ones.

    Users divisible by ten are folders; of fifty events one has another version, one an odd name.
    """

    def part(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"source": pa.array(["events"], pa.string()), "content": pa.array([_packed(batch)], pa.binary())})

    return _events(spark, sf_dir).mapInArrow(part, "source string, content binary")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) * 10 + media.EPOCH_TICKS).alias("ticks")
    return _read(spark, sf_dir, "events").select("event_id", ticks, "user_id", "event_type")


def _packed(events: pa.RecordBatch | pa.Table) -> bytes:
    out = []
    for e, ticks, user, kind in zip(*(events[c].to_pylist() for c in ("event_id", "ticks", "user_id", "event_type")), strict=True):
        name = f"{kind} {e}.{'txt' if e % 3 == 0 else 'mp4'}".encode("utf-16-le")
        reason = {"error": 0x200, "view": 0x100, "click": 0x1000}.get(kind, 0x2000)
        length = -(-(60 + len(name)) // 8) * 8
        out.append(struct.pack("<IHHqqqqIIIIHH", length, 3 if e % 50 == 7 else 2, 0, e + 1000, user, e, ticks, reason, 0, 0, 0x10 if user % 10 == 0 else 0x20, len(name) + (e % 50 == 8), 60) + name + bytes(length - 60 - len(name)))
    return b"".join(out)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.decode(_buffers(spark, sf_dir))


_RECORDS = """WITH r AS (SELECT event_id AS usn, event_id + 1000 AS frn, user_id AS parent_frn, event_type || ' ' || event_id || CASE WHEN event_id % 3 = 0 THEN '.txt' ELSE '.mp4' END AS name,
user_id % 10 = 0 AS is_dir, event_type, ts, event_id % 50 NOT IN (7, 8) AS ok FROM events)"""


@query("journal_decode", _RECORDS + " SELECT usn, frn, parent_frn, name, ts AS at FROM (SELECT * REPLACE (strftime(ts, '%Y-%m-%d %Hh') AS ts) FROM r) WHERE ok")
def journal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).where("outcome = 'ok'").select("usn", "frn", "parent_frn", "name", media.filetime_hour(F.col("filetime")).alias("at"))


@query("scan_records", _RECORDS + " SELECT frn, parent_frn, name, is_dir, CASE WHEN NOT is_dir THEN 'video' END AS kind FROM r WHERE ok AND (is_dir OR usn % 3 <> 0)")
def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.scan_records(_decoded(spark, sf_dir)).drop("seq")


@query("scan_counts", _RECORDS + " SELECT count_if(ok) AS seen, count_if(ok AND is_dir) AS dirs, count_if(ok AND NOT is_dir) AS files, count_if(ok AND NOT is_dir AND usn % 3 <> 0) AS kept, count_if(usn % 50 = 7) AS unsupported, count_if(usn % 50 = 8) AS malformed FROM r")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.scan_counts(_decoded(spark, sf_dir))


@query("journal_changes", _RECORDS + " SELECT usn AS seq, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'present' END AS op, 'D' AS volume, frn, parent_frn, name, is_dir FROM r WHERE ok AND event_type <> 'click'")
def journal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.changes_of(_decoded(spark, sf_dir), "D")


@query("journal_deletions", _RECORDS + " SELECT 'D' AS volume, frn, parent_frn, name, is_dir FROM r WHERE ok AND event_type = 'error' AND (is_dir OR usn % 3 <> 0)")
def journal_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.deletions_of(_decoded(spark, sf_dir), "D").drop("filetime")


@query("journal_counts", _RECORDS + " SELECT count(*) AS records, count_if(ok AND event_type = 'error') AS gone, count_if(ok AND event_type NOT IN ('error', 'click')) AS present, count_if(NOT ok OR event_type = 'click') AS skipped FROM r")
def journal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.journal_counts(_decoded(spark, sf_dir))


@query("tree_last_record", "SELECT CAST(frn AS BIGINT) AS frn, 'C:\\' || arg_max(name, seq) AS path FROM (SELECT user_id + 1000 AS frn, event_type || value AS name, event_id AS seq FROM events) GROUP BY frn")
def tree_last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's last record counts."""
    rows = _read(spark, sf_dir, "events").select((F.col("user_id") + 1000).alias("frn"), F.lit(5).cast("long").alias("parent_frn"), F.concat("event_type", "value").alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("kind"), F.col("event_id").alias("seq"))
    return tree.resolve_directories(rows, "C").where("outcome = 'ok' and frn <> 5").select("frn", "path")


# ---- volumes -------------------------------------------------------------------------------


@query("scannable_volumes", "SELECT n_name AS letter, CASE WHEN n_regionkey = 0 THEN 'network' WHEN n_regionkey IN (1, 2) THEN 'not ntfs' END AS skip_reason FROM nation")
def scannable_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.when(F.col("n_regionkey") == 1, "exfat").when(F.col("n_regionkey") != 2, "NTFS")
    kind = F.when(F.col("n_regionkey") == 0, "network").otherwise("local")
    return records.scannable(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("letter"), kind.alias("kind"), system.alias("filesystem"))).select("letter", "skip_reason")


def _stamps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as volumes: the stamps of most, and what the journals of most say now."""
    key = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select(key, key.cast("string").alias("letter"), (key % 7).alias("serial"), (key % 11).alias("journal_id"), (key * 100).alias("next_usn"))
    stamps = rows.where("c_custkey % 13 <> 0").select("letter", "serial", "journal_id", "next_usn")
    now = rows.where("c_custkey % 17 <> 0").select(
        "letter", (F.col("serial") + F.when(key % 19 == 0, 1).otherwise(0)).alias("serial"),
        F.when(key % 23 == 0, None).when(key % 29 == 0, F.lit(99)).otherwise(F.col("journal_id")).cast("long").alias("journal_id"),
        (F.col("next_usn") + F.when(key % 31 == 0, 1).otherwise(-50)).alias("first_usn"), (F.col("next_usn") + 40).alias("next_usn"),
    )
    return stamps, now


_PLAN = """WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS letter, c_custkey * 100 AS usn, CASE WHEN c_custkey % 17 = 0 THEN 'not attached' WHEN c_custkey % 13 = 0 THEN 'never scanned' WHEN c_custkey % 19 = 0 THEN 'another volume'
WHEN c_custkey % 23 = 0 THEN 'the journal is off or being deleted' WHEN c_custkey % 29 = 0 THEN 'the journal was replaced' WHEN c_custkey % 31 = 0 THEN 'records were lost before they were read' END AS reason
FROM customer WHERE c_custkey % 221 <> 0)"""


@query("update_plan", _PLAN + " SELECT letter, CASE WHEN reason IS NULL THEN 'from_cursor' WHEN reason = 'not attached' THEN 'keep' ELSE 'full' END AS action, reason, CASE WHEN reason IS NULL THEN usn END AS from_usn, CASE WHEN reason IS NULL THEN usn + 40 END AS to_usn FROM p")
def update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.update_plan(*_stamps(spark, sf_dir))


@query("journal_from_cursor", _PLAN + " SELECT letter, o_orderkey AS usn FROM orders JOIN p ON letter = CAST(o_custkey AS VARCHAR) AND reason IS NULL WHERE o_orderkey >= usn AND o_orderkey < usn + 40")
def journal_from_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("letter"), F.col("o_orderkey").alias("usn"))
    return volumes.unread(rows, volumes.update_plan(*_stamps(spark, sf_dir)))


@query("carry_stamps", "SELECT CAST(c_custkey AS VARCHAR) AS letter, c_custkey * 100 + CASE WHEN c_custkey % 3 = 0 AND c_custkey % 17 <> 0 THEN 40 ELSE 0 END AS next_usn FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 17 <> 0 OR c_custkey % 13 <> 0 AND c_custkey % 3 <> 0")
def carry_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps, now = _stamps(spark, sf_dir)
    scanned = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("letter"))
    return volumes.moved_stamps(stamps, now, scanned).select("letter", "next_usn")


# ---- snapshots, stream ---------------------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """Parts as files of a published library."""
    part = _read(spark, sf_dir, "part")
    files = part.select(F.lit("D").alias("volume"), (F.col("p_partkey") + 1000).alias("frn"), F.concat("p_name", F.lit(".mp4")).alias("name"), F.lit("video").alias("kind"), F.concat(F.lit("D:\\"), "p_brand").alias("dir"), F.col("p_size").cast("long").alias("size"), F.lit(3).cast("long").alias("mtime"))
    dirs = part.select("p_brand").distinct().select(F.lit("D").alias("volume"), (F.split("p_brand", "#")[1].cast("long") + 100).alias("frn"), F.concat(F.lit("D:\\"), "p_brand").alias("path"))
    store = SnapshotStore(spark, shared_path(spark))
    store.publish(*journal.library_rows(files, dirs))
    return store


def _paths(store: SnapshotStore) -> DataFrame:
    now = store.load()
    return now.files.join(now.dirs.select("dir_id", "path"), "dir_id").select(F.lit(now.epoch).cast("long").alias("epoch"), "idx", "frn", "name", "folded", "path", "size")


_LIBRARY = r"SELECT p_partkey + 1000 AS frn, p_name || '.mp4' AS name, lower(p_name) || '.mp4' AS folded, 'D:\' || p_brand AS path, CAST(p_size AS BIGINT) AS size FROM part"


@query("snapshot_load", f"SELECT CAST(1 AS BIGINT) AS epoch, row_number() OVER (ORDER BY frn) - 1 AS idx, * FROM ({_LIBRARY})")
def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was published is loaded; an empty library does not replace it."""
    store = _published(spark, sf_dir)
    now = store.load()
    try:
        store.publish(now.files.limit(0), now.dirs)
    except EmptySnapshot:
        return _paths(store)
    raise AssertionError("an empty library was published")


@query("snapshot_unchanged", "SELECT CAST(1 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS files_removed")
def snapshot_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of unknown files without a folder leave the library as it is, in the same epoch."""
    store = _published(spark, sf_dir)
    gone = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("gone").alias("op"), F.lit("D").alias("volume"), (F.col("event_id") + 100_000_000).alias("frn"), F.lit(5).cast("long").alias("parent_frn"), F.lit("x").alias("name"), F.lit(False).alias("is_dir"))
    counts = journal.merge_batch(store, gone)
    return spark.createDataFrame([(store.current_epoch(), counts["files_removed"])], "epoch long, files_removed long")


@query("journal_follow", f"SELECT frn, CASE WHEN frn % 5 = 1 THEN 'later ' || name ELSE name END AS name, path, size FROM ({_LIBRARY}) WHERE frn % 5 <> 0")
def journal_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of changes are followed as a stream: renames, renamed again by the second, and deletions."""
    store, folder = _published(spark, sf_dir), shared_path(spark)
    part = _read(spark, sf_dir, "part")
    key = F.col("p_partkey") + 1000
    rows = part.select(F.col("p_partkey").alias("seq"), F.when(key % 5 == 0, "gone").otherwise("present").alias("op"), F.lit("D").alias("volume"), key.alias("frn"), (F.split("p_brand", "#")[1].cast("long") + 100).alias("parent_frn"), F.concat("p_name", F.lit(".mp4")).alias("name"), F.lit(False).alias("is_dir"))
    first = rows.where("frn % 5 = 1").withColumn("name", F.concat(F.lit("first "), "name"))
    second = rows.where("frn % 5 < 2").withColumn("name", F.when(F.col("op") == "gone", "").otherwise(F.concat(F.lit("later "), "name")))
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(folder)
        journal.follow(spark, folder, store, f"{folder}-offsets").awaitTermination()
    return _paths(store).select("frn", "name", "path", "size")


def _layered(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """Parts as a library to which one batch is merged: every fiftieth file goes, others get a name, one folder moves into a new one."""
    store = _published(spark, sf_dir)
    part = _read(spark, sf_dir, "part")
    key = F.col("p_partkey") + 1000
    rows = part.where("p_partkey % 50 < 2").select(F.col("p_partkey").alias("seq"), F.when(key % 50 == 0, "gone").otherwise("present").alias("op"), F.lit("D").alias("volume"), key.alias("frn"), (F.split("p_brand", "#")[1].cast("long") + 100).alias("parent_frn"), F.concat(F.lit("other "), "p_name", F.lit(".mp4")).alias("name"), F.lit(False).alias("is_dir"))
    new, inner = 1 << 46, (1 << 46) + 1  # beyond the numbers of all files
    folders = [(-3, "present", "D", new, 5, "New", True), (-2, "present", "D", inner, new, "Inner", True), (-1, "present", "D", 111, inner, "Brand#11", True)]
    # The root is no folder of the parts: it is looked up.
    lookup = spark.createDataFrame([("D", 5, "path", "D:")], changes.LOOKUP)
    journal.merge_batch(store, rows.unionByName(spark.createDataFrame(folders, rows.schema)), lookup)
    return store


@query(
    "snapshot_layers",
    f"SELECT CAST(2 AS BIGINT) AS epoch, frn, CASE WHEN frn % 50 = 1 THEN 'other ' || name ELSE name END AS name, CASE WHEN frn % 50 = 1 THEN 'other ' || folded ELSE folded END AS folded, CASE WHEN path = 'D:\\Brand#11' THEN 'D:\\New\\Inner\\Brand#11' ELSE path END AS path, size FROM ({_LIBRARY}) WHERE frn % 50 <> 0",
)
def snapshot_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole snapshot and a layer of changes, read as one."""
    return _paths(_layered(spark, sf_dir)).drop("idx")


@query("snapshot_layer_rows", "SELECT count_if((p_partkey + 1000) % 50 = 1) AS files, count_if((p_partkey + 1000) % 50 = 0) AS files_gone, CAST(4 AS BIGINT) AS dirs, CAST(0 AS BIGINT) AS dirs_gone FROM part")
def snapshot_layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer holds what the batch changed and nothing else: a folder that moves is one row, whatever it holds."""
    store = _layered(spark, sf_dir)
    n = lambda table: spark.read.parquet(f"{store.root}/epoch=2/{table}").agg(F.count("*").alias(table))
    return n("files").crossJoin(n("files_gone")).crossJoin(n("dirs")).crossJoin(n("dirs_gone"))  # one row each


@query("merge_lookup", r"SELECT p_partkey AS frn, CASE p_partkey % 3 WHEN 0 THEN 'D:\found' ELSE 'D:\known' END AS dir FROM part WHERE p_partkey <> 0 AND p_partkey % 3 <> 1")
def merge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_with_lookup(spark, sf_dir).files.select("frn", "dir")


@query("merge_lookup_counts", "SELECT count_if(p_partkey % 3 <> 1) AS files_added, count_if(p_partkey % 3 = 1) AS excluded, CAST(1 AS BIGINT) AS dirs_looked_up, CAST(0 AS BIGINT) AS unresolved FROM part WHERE p_partkey <> 0")
def merge_lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that tell what a lookup answered."""
    counts = _merged_with_lookup(spark, sf_dir).counts
    names = ("files_added", "excluded", "dirs_looked_up", "unresolved")
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


def _merged_with_lookup(spark: SparkSession, sf_dir: str) -> changes.Merge:
    """New files below a folder that a lookup knows, one that it excludes, and one that the library knows."""
    part = _read(spark, sf_dir, "part").where("p_partkey <> 0")
    rows = part.select(F.col("p_partkey").alias("seq"), F.lit("present").alias("op"), F.lit("D").alias("volume"), F.col("p_partkey").alias("frn"), (F.col("p_partkey") % 3 + 1_000_000_000).alias("parent_frn"), F.lit("a.mp4").alias("name"), F.lit(False).alias("is_dir"))
    dirs = spark.createDataFrame([("D", 1_000_000_002, "D:\\known")], "volume string, frn long, path string")
    answers = spark.createDataFrame([("D", 1_000_000_000, "path", "D:\\found"), ("D", 1_000_000_000, "unknown", None), ("D", 1_000_000_001, "excluded", None)], changes.LOOKUP)
    files = spark.createDataFrame([], "volume string, frn long, name string, kind string, dir string, size long, mtime long")
    return changes.apply_changes(files, dirs, rows, answers)


def _journal_buffers(events: DataFrame) -> DataFrame:
    """Buffers of 2,000 sequence numbers of two volumes."""

    def buffer(key, table):
        table = table.sort_by("event_id")
        return pa.table({"volume": pa.array([key[0].as_py()]), "journal_id": pa.array([7], pa.int64()), "first_usn": pa.array([table["event_id"][0].as_py()], pa.int64()), "content": pa.array([_packed(table)], pa.binary())})

    keyed = events.select("*", F.when(F.col("user_id") % 2 == 0, "D").otherwise("E").alias("volume"), F.floor(F.col("event_id") / 2000).alias("part"))
    return keyed.groupBy("volume", "part").applyInArrow(buffer, "volume string, journal_id long, first_usn long, content binary")


@query(
    "journal_stream_resume",
    _RECORDS + " SELECT usn AS seq, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'present' END AS op, CASE WHEN parent_frn % 2 = 0 THEN 'D' ELSE 'E' END AS volume, frn, parent_frn, name, is_dir FROM r WHERE ok AND event_type <> 'click'",
)
def journal_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two volumes' journals as a stream that stops twice and goes on from its checkpoint, the second time in the middle of a buffer."""
    events, folder = _events(spark, sf_dir), shared_path(spark)
    last = events.agg(F.max("event_id")).first()[0]
    source.write_buffers(_journal_buffers(events), f"{folder}/journals")
    for upto in (last // 3, last // 2, last + 1):
        for volume in "DE":
            source.write_state(f"{folder}/journals", volume, 7, 0, upto)
        stream = journal.changes_of(source.journal_stream(spark, f"{folder}/journals", buffersPerTask=4))
        source.finished(source.started(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets"))
    return spark.read.parquet(f"{folder}/out").drop("batch")


# ---- search, names, properties -------------------------------------------------------------


@query("search_recent_kinds", f"WITH {_score_sql(['gear'], _PARTS, 'mtime >= 13600 AND idx % 3 = 0')} SELECT idx, name, matched, score, score AS key FROM m WHERE matched = 1 ORDER BY score DESC, idx LIMIT 50")
def search_recent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by name, of which unknown ones are ignored, and files of the last day before a given moment."""
    files, dirs, _ = part_library(spark, sf_dir)
    kinds = search.parse_kinds([media.KINDS[0], "nonsense"])
    return _hits(search.search(files, dirs, "gear", search.SearchOptions(kinds=kinds, limit=50, modified_after=search.recency_cutoff(1, 100_000))).hits)


@query("search_nothing", f"WITH {_score_sql(['gear'], _PARTS)} SELECT idx, name, matched, score, score AS key FROM m WHERE false")
def search_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without words, and a limit of 0."""
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.search(files, dirs, " .- ").hits.unionByName(search.search(files, dirs, "gear", search.SearchOptions(limit=0)).hits))


@query("search_most", f"WITH {_score_sql(['e'], _PARTS)} SELECT idx, name, matched, score, score AS key FROM m WHERE matched = 1 ORDER BY score DESC, idx LIMIT 20000")
def search_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit beyond the most that is served."""
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.search(files, dirs, "e", search.SearchOptions(limit=1_000_000)).hits)


@query("dupes_least_limit", "SELECT doc_id AS idx, fp, size FROM (SELECT doc_id, length(text) AS size, md5(text) AS fp, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WHERE length(text) >= 64 WINDOW w AS (PARTITION BY length(text), text)) WHERE n > 1 QUALIFY dense_rank() OVER (ORDER BY size * (n - 1) DESC, first) = 1")
def dupes_least_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 0 groups shows one."""
    printed = cut(dupes.same_size(_contents(spark, sf_dir), 64).withColumn("fp", F.md5("content")).drop("content"))
    return dupes.duplicate_members(printed, dupes.duplicate_groups(printed), 0).select("idx", "fp", F.col("size").cast("long").alias("size"))


@query("dupes_counters", "WITH s AS (SELECT doc_id, count(*) OVER (PARTITION BY length(text)) AS n FROM documents WHERE length(text) >= 64), a AS (SELECT * FROM s WHERE n > 1) SELECT (SELECT count(*) FROM documents) AS files, count(*) AS candidates, count_if(doc_id % 10 <> 3) AS hashed, count_if(doc_id % 10 = 3) AS unreadable FROM a")
def dupes_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth file cannot be read."""
    files = _contents(spark, sf_dir)
    able = dupes.same_size(files, 64)
    return dupes.counters(files, able, able.select(F.when(F.col("idx") % 10 != 3, F.md5("content")).alias("fp")))


@query(
    "names_and_sizes",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'D:\x' || o_orderkey ELSE 'E:\y' END AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS epoch, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS index,
CAST(greatest(16, least(512, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 700 END, 192))) AS BIGINT) AS side, o_orderkey % 4 = 0 AS empty FROM orders""",
)
def names_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without their extended prefix, handles of entries, sizes of thumbnails, empty properties."""
    key, zero = F.col("o_orderkey"), F.lit(0)
    raw = F.when(key % 2 == 0, F.concat(F.lit("\\\\?\\D:\\x"), key)).otherwise("E:\\y")
    handle = media.entry_handle(F.when(key % 3 == 0, F.concat("o_custkey", F.lit("_"), key)).otherwise(F.concat("o_custkey", F.lit("x"), key)))
    side = media.thumbnail_size(F.when(key % 5 > 0, key % 700))
    return _read(spark, sf_dir, "orders").select(key, media.strip_extended_prefix(raw).alias("path"), handle["epoch"].alias("epoch"), handle["index"].alias("index"), side.cast("long").alias("side"), media.props_empty(zero, zero, key % 4).alias("empty"))


@query("props_store", _SEEDED + " SELECT idx, CAST(CASE WHEN cached THEN quality * 1920 WHEN idx % 3 <> 0 THEN 7 ELSE 0 END AS INT) AS width, cached OR idx % 3 <> 0 AS cached FROM s")
def props_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read for the queued files are saved and loaded; a store of another schema version counts as empty."""
    seeded = _seeded(spark, sf_dir)
    entries = seeded.where("idx % 3 <> 0").select(media.path_key(F.col("path")).alias("path_key"), "size", "mtime", *(F.when(F.col("cached"), F.col(c)).otherwise(7).cast("int").alias(c) for c in ("width", "height", "duration_ms")), F.lit(True).alias("attempted"))
    store = PropertyStore(spark, shared_path(spark))
    store.save(enrich.merge_store(store.load(), entries))
    if not PropertyStore(spark, store.root, schema_version=99).load().isEmpty():
        raise AssertionError("a store of another version was read")
    return enrich.seed_from_store(seeded.drop("cached"), store.load()).select("idx", "width", "cached")


@query("needs_stat", "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN o_custkey ELSE 0 END AS size FROM orders WHERE o_orderkey % 4 = 0")
def needs_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a time are measured, where their path is there."""
    key = F.col("o_orderkey")
    files = _read(spark, sf_dir, "orders").select(key.alias("idx"), key.cast("string").alias("path"), F.lit(0).cast("long").alias("size"), F.when(key % 4 == 0, 0).otherwise(9).cast("long").alias("mtime"))
    stats = _read(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(key.cast("string").alias("path"), F.col("o_custkey").alias("size"), F.lit(5).cast("long").alias("mtime"))
    return enrich.measured(enrich.unmeasured(files), stats).select("idx", "size")


# ---- self-check, control records -----------------------------------------------------------

_KEPT = r"""WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'E' END AS volume, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey END AS frn, CASE WHEN o_orderkey % 7 = 0 THEN 'D:\old' ELSE 'D:\x' || o_custkey END AS dir, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END || o_orderkey AS name FROM orders WHERE o_orderkey % 13 <> 0),
s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'E' END AS volume, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey END AS frn, 'D:\x' || o_custkey AS dir, 'a' || o_orderkey AS name FROM orders WHERE o_orderkey % 17 <> 0),
j AS (SELECT coalesce(k.volume, s.volume) AS volume, coalesce(k.frn, s.frn) AS frn, CASE WHEN k.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'extra' WHEN k.dir <> s.dir THEN 'moved' WHEN k.name <> s.name THEN 'renamed' END AS reason, k.dir || '\' || k.name AS kept_path, s.dir || '\' || s.name AS scanned_path
FROM k FULL JOIN s ON k.volume = s.volume AND k.frn = s.frn AND (k.frn <> 0 OR k.dir || '\' || k.name = s.dir || '\' || s.name))""".replace("\\\\", "\\")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a library that was kept up to date, and of a scan: some are missing, some too many, some moved, some renamed, some without a number."""
    key = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(key, F.when(key % 2 == 0, "D").otherwise("E").alias("volume"), F.when(key % 11 == 0, 0).otherwise(key).cast("long").alias("frn"), F.concat(F.lit("D:\\x"), "o_custkey").alias("dir"), F.concat(F.lit("a"), key).alias("name"))
    kept = rows.where("o_orderkey % 13 <> 0").withColumns({"dir": F.when(key % 7 == 0, "D:\\old").otherwise(F.col("dir")), "name": F.when(key % 5 == 0, F.concat(F.lit("b"), key)).otherwise(F.col("name"))})
    return audit.differences(kept, rows.where("o_orderkey % 17 <> 0"))


@query("library_differences", _KEPT + " SELECT * FROM j WHERE reason IS NOT NULL")
def library_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a library has other than a scan, with reasons."""
    return _checked(spark, sf_dir)


@query("difference_counts", _KEPT + " SELECT volume, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY volume, reason")
def difference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.difference_counts(_checked(spark, sf_dir))


@query(
    "control_records",
    """SELECT volume, kind, done, total, finished FROM (SELECT CAST(user_id AS VARCHAR) AS volume, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind, event_id AS done, 10 * event_id AS total, event_type IN ('purchase', 'error') AS finished, event_id
FROM events WHERE event_id % 7 > 2) QUALIFY row_number() OVER (PARTITION BY volume ORDER BY finished DESC, event_id DESC) = 1""",
)
def control_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control records of users' scans, of which some are cut off, some of a later version and some of no kind; how each scan stands."""
    key = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise("progress")
    text = control.control_record(kind, F.col("user_id").cast("string"), key, key * 10)
    text = F.when(key % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 5)).when(key % 7 == 1, F.regexp_replace(text, '"version":1', '"version":2')).when(key % 7 == 2, F.regexp_replace(text, '"kind":"[a-z]*",', "")).otherwise(text)
    lines = _read(spark, sf_dir, "events").select(key, text.alias("line"))
    known = lines.select(key, control.parsed_record(F.col("line")).alias("r")).where("r is not null")
    last = known.groupBy("r.volume").agg(control.last_of(F.col("r.volume"), F.col("r"), key).alias("r"))
    return last.select("volume", "r.kind", "r.done", "r.total", "r.finished")


# ---- labels, presets, lists, progress ------------------------------------------------------


@query("count_labels", "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1009), ',', '.') AS label, replace(format('{:,}', -o_orderkey), ',', ' ') AS spaced FROM orders")
def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(key, media.count_label(key * 1009).alias("label"), media.count_label(-key, " ").alias("spaced"))


@query("time_labels", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN '' ELSE strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%H:%M:%S %-d/%-m/%Y') END AS label FROM events")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    unix = F.when(F.col("event_id") % 10 == 3, F.lit(0)).otherwise(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return _read(spark, sf_dir, "events").select("event_id", media.time_label(unix).alias("label"))


_PRESET_SQL = {"720p": "h >= 720", "1080p": "h >= 1080", "4k": "h >= 2160", "short": "d > 0 AND d <= 60000", "medium": "d >= 60000 AND d <= 600000", "long": "d >= 600000", "week": "m >= 8035200", "month": "m >= 6048000", "year": "m >= 0"}


@query("search_presets", "WITH p AS (SELECT p_partkey AS idx, lower(p_name) AS n, p_size * 60 AS h, CAST(floor(p_retailprice * 300) AS BIGINT) AS d, p_partkey * 4000 AS m FROM part) " + " UNION ALL ".join(f"SELECT '{name}' AS preset, idx FROM p WHERE contains(n, 'e') AND {sql}" for name, sql in [*_PRESET_SQL.items(), ("1080p medium month", " AND ".join(_PRESET_SQL[k] for k in ("1080p", "medium", "month")))]))
def search_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of each preset, and of three at once, at a given moment."""
    files, dirs, props = part_library(spark, sf_dir)
    files = files.withColumn("mtime", F.col("idx") * 4000)
    price = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.floor(F.col("p_retailprice") * 300).cast("long").alias("duration_ms"))
    props = props.select("idx", (F.col("width") * 3).alias("width"), (F.col("height") * 2).alias("height")).join(price, "idx")
    dirs = dirs.withColumn("folded", F.lit("d"))
    out = None
    for names in [*((name,) for name in search.PRESETS), ("1080p", "medium", "month")]:
        filters = search.preset_filters(*names)
        days = filters.pop("within_days", 0)
        options = search.SearchOptions(limit=None, modified_after=search.recency_cutoff(days, 8_640_000), **filters)
        hits = search.search(files, dirs, "e", options, props).hits.select(F.lit(" ".join(names)).alias("preset"), "idx")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("first_files", rf"SELECT row_number() OVER (ORDER BY frn) - 1 AS idx, path || '\' || name AS path FROM ({_LIBRARY}) ORDER BY idx LIMIT 30")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _published(spark, sf_dir).load()
    return audit.first_files(now.files, now.dirs, 30)


@query(
    "library_footprint",
    f"""SELECT 'files' AS "table", count(*) AS rows, CAST(sum(strlen(name) + strlen(folded) + 5 + 1) AS BIGINT) AS text_bytes, count(*) * 40 AS number_bytes FROM ({_LIBRARY})
UNION ALL SELECT 'dirs', count(*), CAST(sum(2 * strlen(path) + 1) AS BIGINT), count(*) * 16 FROM (SELECT DISTINCT path FROM ({_LIBRARY}))""",
)
def library_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _published(spark, sf_dir).load()
    return audit.footprint(now.files, now.dirs)


@query(
    "dupes_rows",
    """WITH m AS (SELECT doc_id AS idx, length(text) AS size, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WHERE length(text) >= 64 WINDOW w AS (PARTITION BY length(text), text)),
k AS (SELECT *, size * (n - 1) AS wasted FROM m WHERE n > 1 QUALIFY dense_rank() OVER (ORDER BY size * (n - 1) DESC, first) <= 500)
SELECT DISTINCT wasted, first, true AS head, n, size, CAST(NULL AS BIGINT) AS idx FROM k UNION ALL SELECT wasted, first, false, n, size, idx FROM k""",
)
def dupes_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as one list of head rows and member rows."""
    printed = cut(dupes.fingerprinted(dupes.same_size(_contents(spark, sf_dir), 64), whole=True))
    return dupes.group_rows(dupes.duplicate_members(printed, dupes.duplicate_groups(printed)))


@query("enrich_order", _SEEDED + " SELECT idx, row_number() OVER (ORDER BY CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, idx DESC) - 1 AS at FROM s WHERE NOT cached AND source <> 'src3'")
def enrich_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's place in the queue of files whose properties are to be read."""
    return enrich.numbered_queue(_seeded(spark, sf_dir), spark.createDataFrame([("src3",)], "letter string")).select("idx", "at")


@query("network_drives", r"SELECT n_name AS letter, CASE WHEN n_nationkey % 2 = 0 THEN 'shelf ' || n_nationkey END AS label, CASE WHEN n_nationkey % 3 > 0 THEN '\\server\' || n_name END AS remote FROM nation WHERE n_regionkey = 0")
def network_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind = F.when(F.col("n_regionkey") == 0, "network").otherwise("local")
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("letter"), kind.alias("kind"), F.when(key % 2 == 0, F.concat(F.lit("shelf "), key)).alias("label"), F.when(key % 3 > 0, F.concat(F.lit("\\\\server\\"), "n_name")).alias("remote"))
    return volumes.network_drives(rows)


@query(
    "changes_of_volumes",
    _RECORDS + " SELECT usn AS seq, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'present' END AS op, CASE WHEN parent_frn % 2 = 0 THEN 'D' ELSE 'E' END AS volume, frn, parent_frn, name, is_dir FROM r WHERE ok AND event_type <> 'click'",
)
def changes_of_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch from the journals of two volumes, each decoded on its own."""
    found = _decoded(spark, sf_dir)
    return journal.changes_of_volumes({"D": found.where("parent_frn % 2 = 0"), "E": found.where("parent_frn % 2 <> 0")})


@query(
    "journal_one_volume",
    _RECORDS + " SELECT usn AS seq, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'present' END AS op, 'E' AS volume, frn, parent_frn, name, is_dir FROM r WHERE ok AND event_type <> 'click' AND parent_frn % 2 <> 0",
)
def journal_one_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of two volumes, of which one is streamed: the other's state is never read (it is damaged)."""
    events, folder = _events(spark, sf_dir), shared_path(spark)
    source.write_buffers(_journal_buffers(events), f"{folder}/journals")
    source.put(f"{folder}/journals/D/state.json", "damaged")
    source.write_state(f"{folder}/journals", "E", 7, 0, events.agg(F.max("event_id")).first()[0] + 1)
    stream = journal.changes_of(source.journal_stream(spark, f"{folder}/journals", volumes="e"))
    source.finished(source.started(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets"))
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("build_outcomes", _TREE + " SELECT outcome, count(*) AS files, 'finished' AS ended, 'C' AS volume FROM part JOIN t ON t.frn = p_partkey + 1000 GROUP BY outcome")
def build_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library is built; the outcomes are metrics of the job that writes its files, and the control record says how it ended."""
    folder = shared_path(spark)
    outcomes = Engine(spark, f"{folder}/library").build({"C": _tree_records(spark, sf_dir)}, progress=f"{folder}/progress.json")
    ended = read_progress(f"{folder}/progress.json")
    return spark.createDataFrame([(outcome, n, ended.kind, ended.volume) for outcome, n in outcomes["C"].items()], "outcome string, files long, ended string, volume string")
