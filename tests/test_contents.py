"""Files read by their paths, volumes' positions, stores, and what a walk counts."""

import hashlib
import os

from pyspark.sql import functions as F

from shelfspark.operators import dupes, enrich
from shelfspark.operators.tree import resolve_directories
from shelfspark.plans.engine import Engine
from shelfspark.sources import records as R
from shelfspark.sources import volumes
from shelfspark.sources.contents import digest_of, fingerprint_paths
from shelfspark.sources.snapshot import PropertyStore, SnapshotStore, shared_path


def sparse(path, size, at=None, mark=b"x"):
    with open(path, "wb") as file:
        file.truncate(size)
        if at is not None:
            file.seek(at)
            file.write(mark)


def test_ends_of_large_files(spark, tmp_path):
    """Files above 2 GB, of which only the ends are read: a difference in the middle is seen by the full digest alone."""
    size = (2 << 30) + 12_345
    for name, at in (("a", None), ("middle", size // 2), ("head", 10), ("tail", size - 10)):
        sparse(tmp_path / name, size, at)
    rows = [(i, str(tmp_path / n), size) for i, n in enumerate(["a", "middle", "head", "tail", "missing"])]
    printed = fingerprint_paths(spark.createDataFrame(rows, "idx long, path string, size long"))
    prints = [r["fp"] for r in printed.orderBy("idx").collect()]
    assert prints[0] == prints[1] and len(set(prints[:4])) == 3 and prints[4] is None
    assert prints[0] == hashlib.sha256(bytes(2 * 65_536)).hexdigest()
    groups = dupes.duplicate_groups(printed).collect()
    assert [(r["copies"], r["first"], r["wasted"]) for r in groups] == [(2, 0, size)]
    counted = dupes.counters(printed, printed, printed).first()
    assert (counted["hashed"], counted["unreadable"]) == (4, 1)


def test_digests_of_small_files(tmp_path):
    sparse(tmp_path / "s", 300_000, 150_000)
    whole = digest_of(str(tmp_path / "s"), 300_000, whole=True)
    assert whole == hashlib.sha256((tmp_path / "s").read_bytes()).hexdigest() != digest_of(str(tmp_path / "s"), 300_000)
    assert digest_of(f"file://{tmp_path}/s", 300_000, whole=True) == whole
    assert digest_of(str(tmp_path / "s"), 400_000) is None and digest_of(str(tmp_path), 1) is None
    sparse(tmp_path / "t", 131_072)
    assert digest_of(str(tmp_path / "t"), 131_072) == hashlib.sha256(bytes(131_072)).hexdigest()


def built(spark, root):
    records = spark.createDataFrame([(10, 5, "Films", True, None), (100, 10, "a.mp4", False, "video"), (101, 10, "b.mp4", False, "video"), (102, 10, "c.mp4", False, "video")], "frn long, parent_frn long, name string, is_dir boolean, kind string")
    stats = spark.createDataFrame([(f"D:\\Films\\{n}.mp4", 200_000, 5) for n in "abb"], "path string, size long, mtime long")
    engine = Engine(spark, str(root))
    engine.build({"D": records}, stats)
    return engine


def test_engine_reads_duplicates_by_path(spark, tmp_path):
    engine = built(spark, tmp_path / "library")
    assert engine.status()["files"] == 3  # a path that is measured twice is one file
    os.makedirs(tmp_path / "disk/Films")
    for n in "ab":
        sparse(tmp_path / f"disk/Films/{n}.mp4", 200_000, 3)
    members, totals, counted = engine.duplicates_of_paths(locate=lambda p: F.concat(F.lit(f"{tmp_path}/disk"), F.replace(F.substring(p, 3, 1000), F.lit("\\"), F.lit("/"))))
    assert sorted(r["name"] for r in members.collect()) == ["a.mp4", "b.mp4"] and totals.first()["wasted"] == 200_000
    assert counted.first().asDict() == {"files": 3, "candidates": 2, "hashed": 2, "unreadable": 0}


def test_properties_are_read_in_batches_and_saved(spark, tmp_path):
    engine = built(spark, tmp_path / "library")
    store, asked = PropertyStore(spark, str(tmp_path / "props")), []

    def read(files):
        asked.append(files.count())
        return files.select(F.lower("path").alias("path_key"), "size", "mtime", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(1).alias("duration_ms"), F.lit(True).alias("attempted"))

    none = spark.createDataFrame([], "letter string")
    assert engine.read_properties(store, none, read, batch=2, stop=lambda: len(asked) == 1) == 2 and store.load().count() == 2
    assert engine.read_properties(store, none, read, batch=2) == 1 and asked[1] == 1
    assert store.load().count() == 3 and engine.enrich_status(none) == {"done": 3, "total": 3}
    assert PropertyStore(spark, store.root, schema_version=7).load().count() == 0


def test_rounds_of_batches_grow(spark, tmp_path):
    """A long queue takes few rounds, the first of one batch; every file is read once."""
    folder = spark.createDataFrame([(0, "D", "D:", "d:", 5)], "dir_id long, volume string, path string, folded string, frn long")
    files = spark.range(20).selectExpr("id as idx", "concat('f', id, '.mp4') as name", "concat('f', id, '.mp4') as folded", "0L as dir_id", "'video' as kind", "'D' as volume", "id as frn", "1L as size", "1L as mtime")
    SnapshotStore(spark, str(tmp_path / "library")).publish(files, folder)
    store, asked = PropertyStore(spark, str(tmp_path / "props")), []

    def read(part):
        asked.append(part.count())
        return part.select(F.lower("path").alias("path_key"), "size", "mtime", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(1).alias("duration_ms"), F.lit(True).alias("attempted"))

    assert Engine(spark, str(tmp_path / "library")).read_properties(store, spark.createDataFrame([], "letter string"), read, batch=2) == 20
    assert asked[0] == 2 and len(asked) <= 6 and sum(asked) == 20 and store.load().count() == 20


def test_update_plan(spark):
    stamps = spark.createDataFrame([("C", 1, 7, 100), ("D", 1, 7, 100), ("E", 1, 7, 100), ("F", 1, 7, 100), ("G", 1, 7, 100), ("H", 1, 7, None)], "letter string, serial long, journal_id long, next_usn long")
    now = spark.createDataFrame([("C", 1, 7, 50, 160), ("D", 1, 8, 50, 160), ("E", 1, 7, 101, 160), ("F", 2, 7, 50, 160), ("H", 1, 7, 0, 9), ("I", 1, None, None, None)], volumes.JOURNALS)
    plan = volumes.update_plan(stamps, now)
    got = {r["letter"]: (r["action"], (r["reason"] or "")[-8:]) for r in plan.collect()}
    assert got == {"C": ("from_cursor", ""), "D": ("full", "replaced"), "E": ("full", "ere read"), "F": ("full", "r volume"), "G": ("keep", "attached"), "H": ("full", "ere read"), "I": ("full", " scanned")}
    records = spark.createDataFrame([("C", 99), ("C", 100), ("C", 159), ("C", 160), ("D", 100)], "letter string, usn long")
    assert sorted(r["usn"] for r in volumes.unread(records, plan).collect()) == [100, 159]


def test_the_last_record_of_a_folder_counts(spark):
    rows = [(10, 5, "old", True, None, 1), (10, 5, "new", True, None, 2), (11, 10, "x", True, None, 3)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "frn long, parent_frn long, name string, is_dir boolean, kind string, seq long")
        assert {r["path"] for r in resolve_directories(table, "C").collect()} == {"C:", "C:\\new", "C:\\new\\x"}


def test_walk_counts(spark, tmp_path):
    os.makedirs(tmp_path / "w/Films/AppData")
    for name in ("Films/a.mp4", "Films/b.txt", "Films/AppData/c.mp4", "d.mp3"):
        (tmp_path / "w" / name).write_bytes(b"1")
    got = R.walk_counts(spark, f"{tmp_path}/w").first().asDict()
    assert got == {"entries": 4, "media": 3, "kept": 2, "excluded": 1, "folders": 3}
    assert R.walk(spark, f"{tmp_path}/w").count() == 2


def test_unmeasured_files(spark):
    files = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 4, 9)], "path string, size long, mtime long")
    stats = spark.createDataFrame([("a", 7, 3), ("a", 8, 4), ("c", 1, 1)], "path string, size long, mtime long")
    assert sorted(map(tuple, enrich.measured(files, stats).collect())) == [("a", 8, 4), ("b", 0, 0), ("c", 4, 9)] and enrich.unmeasured(files).count() == 2


def test_shared_path_is_below_the_checkpoint_folder(spark):
    assert shared_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_cut_leaves_no_shuffle_files(spark):
    """The steps of a chain of cuts take disk one after the other, not together."""
    import os

    from shelfspark.sources.snapshot import SHUFFLES_GO, cut

    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    size = lambda: sum(os.path.getsize(os.path.join(top, n)) for d in folders for top, _, names in os.walk(d) for n in names if n.startswith("shuffle_"))
    before = size()
    assert cut(spark.range(200_000).selectExpr("id", "xxhash64(id) as h").repartition(3, "h")).count() == 200_000
    assert size() - before < 100_000  # of more than two million bytes; the count has a shuffle of its own
    assert spark.conf.get(SHUFFLES_GO) == "false"
