from pyspark.sql import functions as F

from shelfspark.functions import control
from shelfspark.operators import audit, dupes, enrich
from shelfspark.sources.snapshot import PROPS


def contents(spark, *rows):
    return spark.createDataFrame([(i, bytes(c), len(c)) for i, c in enumerate(rows)], "idx long, content binary, size long")


def test_duplicates(spark):
    k = 1024
    tail, head = bytearray(b"c" * 200 * k), bytearray(b"c" * 200 * k)
    tail[-1], head[0] = 1, 1
    files = contents(spark, b"a" * k, b"a" * k, b"b" * 300 * k, b"b" * 300 * k, b"b" * 300 * k, b"c" * 200 * k, tail, head, b"d" * 100 * k, b"d" * 100 * k)
    groups = dupes.find_duplicates(files)
    assert [(r["size"], r["copies"], r["wasted"], r["first"]) for r in groups.collect()] == [(300 * k, 3, 600 * k, 2), (100 * k, 2, 100 * k, 8)]
    assert dupes.totals(groups).first().asDict() == {"groups": 2, "wasted": 700 * k}
    printed = dupes.fingerprinted(dupes.same_size(files))
    assert [(r["idx"], r["keep"]) for r in dupes.duplicate_members(printed, groups, 1).orderBy("idx").collect()] == [(2, True), (3, False), (4, False)]


def test_middle_bytes_need_the_whole_content(spark):
    a, b = bytearray(b"x" * 300_000), bytearray(b"x" * 300_000)
    b[150_000] = 1
    assert dupes.find_duplicates(contents(spark, a, b)).count() == 1
    assert dupes.find_duplicates(contents(spark, a, b), whole=True).count() == 0


def test_unreadable_files_drop_out(spark):
    files = contents(spark, b"x" * 70_000, b"x" * 70_000).withColumn("content", F.when(F.col("idx") == 0, F.col("content")))
    assert dupes.find_duplicates(files).count() == 0


def test_enrichment(spark):
    files = spark.createDataFrame([(i, f"D:\\A{i}.mp4", k, "D" if i < 4 else "N", 10, 5) for i, k in enumerate(["audio", "video", "image", "video", "audio"])], "idx long, path string, kind string, volume string, size long, mtime long")
    store = spark.createDataFrame([("d:\\a0.mp4", 10, 5, 1, 2, 3, True), ("d:\\a1.mp4", 11, 5, 1, 2, 3, True)], PROPS)
    seeded = enrich.seed_from_store(files, store)
    assert {r["idx"]: (r["width"], r["cached"]) for r in seeded.collect()} == {0: (1, True), 1: (0, False), 2: (0, False), 3: (0, False), 4: (0, False)}
    network = spark.createDataFrame([("N",)], "letter string")
    assert [r["idx"] for r in enrich.read_queue(seeded, network).collect()] == [3, 1, 2]
    assert enrich.status(seeded, network).first().asDict() == {"done": 1, "total": 4}
    merged = enrich.merge_store(store, store.withColumn("width", F.lit(9)).where("size = 11"))
    assert sorted((r["path_key"], r["width"]) for r in merged.collect()) == [("d:\\a0.mp4", 1), ("d:\\a1.mp4", 9)]


def test_deletions(spark):
    t = 133536384000000000
    rows = [("D", 20, 5, "Top", True, t), ("D", 21, 20, "Sub", True, t), ("D", 22, 99, "Lost", True, t), *[("D", 100 + i, p, f"f{i}.MP4", False, t + i * 36_000_000_000) for i, p in enumerate([21, 21, 10, 22])]]
    gone = spark.createDataFrame(rows, "volume string, frn long, parent_frn long, name string, is_dir boolean, filetime long")
    dirs = spark.createDataFrame([("D", 5, "D:"), ("D", 10, "D:\\Phim")], "volume string, frn long, path string")
    assert [r["hour"] for r in audit.deletions_by_hour(gone.where("not is_dir")).collect()] == ["2024-02-29 00h", "2024-02-29 01h", "2024-02-29 02h", "2024-02-29 03h"]
    assert [tuple(r) for r in audit.deletions_by_extension(gone).collect()] == [("mp4", 4)]
    by_path, unknown = audit.deletions_by_folder(gone, dirs)
    assert [tuple(r) for r in by_path.collect()] == [("D:\\Top\\Sub", 2), ("D:\\Phim", 1)] and unknown.first()[0] == 1
    assert [r["path"] for r in audit.deleted_roots(gone, dirs).collect()] == ["D:\\Top"]


def test_differences_of_a_library_and_a_scan(spark):
    columns = "volume string, frn long, dir string, name string"
    kept = spark.createDataFrame([("D", 1, "D:", "a"), ("D", 2, "D:", "b"), ("D", 3, "D:", "c"), ("D", 4, "D:\\x", "d"), ("D", 0, "D:", "n"), ("D", 0, "D:", "m"), ("E", 1, "E:", "a")], columns)
    scan = spark.createDataFrame([("D", 1, "D:", "a"), ("D", 2, "D:\\y", "z"), ("D", 3, "D:", "C"), ("D", 5, "D:", "e"), ("D", 0, "D:", "n"), ("D", 0, "D:", "o")], columns)
    found = {(r["volume"], r["frn"], r["reason"], r["kept_path"], r["scanned_path"]) for r in audit.differences(kept, scan).collect()}
    assert found == {
        ("D", 2, "moved", "D:\\b", "D:\\y\\z"), ("D", 3, "renamed", "D:\\c", "D:\\C"), ("D", 4, "extra", "D:\\x\\d", None), ("D", 5, "missing", None, "D:\\e"), ("D", 0, "extra", "D:\\m", None), ("D", 0, "missing", None, "D:\\o"), ("E", 1, "extra", "E:\\a", None),
    }
    assert {(r["volume"], r["reason"]): r["n"] for r in audit.difference_counts(audit.differences(kept, scan)).collect()}[("D", "missing")] == 2
    assert audit.differences(kept, kept).count() == 0


def test_control_records_survive_damage(spark):
    rows = [(1, "progress", "D", 5, 10), (2, "finished", "D", 10, 10), (3, "progress", "D", 6, 10), (4, "progress", "E", 1, None)]
    table = spark.createDataFrame(rows, "at int, kind string, volume string, done int, total int")
    lines = table.select("at", control.control_record(F.col("kind"), F.col("volume"), F.col("done"), F.col("total")).alias("line"))
    odd = spark.createDataFrame([(9, None), (9, ""), (9, "{"), (9, "[1]"), (9, '{"version":2,"kind":"finished","volume":"D"}'), (9, '{"version":1,"volume":"D"}'), (9, '{"version":1,"kind":"dance","volume":"D"}'), (9, '{"version":0,"kind":"finished","volume":"D"}'), (5, '{"version":1,"kind":"progress","volume":"E","done":"many","new field":[1]}')], "at int, line string")
    known = lines.unionByName(odd).select("at", control.parsed_record(F.col("line")).alias("r")).where("r is not null")
    assert sorted(r["at"] for r in known.collect()) == [1, 2, 3, 4, 5]
    last = {r["volume"]: r["r"] for r in known.groupBy("r.volume").agg(control.last_of(F.col("r.volume"), F.col("r"), F.col("at")).alias("r")).collect()}
    assert (last["D"]["kind"], last["D"]["finished"], last["D"]["done"]) == ("finished", True, 10) and last["E"]["kind"] == "progress"
