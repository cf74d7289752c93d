import struct

import pytest

from shelfspark.plans.engine import Engine
from shelfspark.sources import records as R
from shelfspark.sources.snapshot import CHANGES, EmptySnapshot, SnapshotStore
from shelfspark.streaming import journal as J

ROOT = 0x0005000000000005


def usn(frn, parent, name, reason=J.CREATED, attrs=0, major=2, at=0, time=0):
    raw = name.encode("utf-16-le")
    length = (60 + len(raw) + 7) // 8 * 8
    return (struct.pack("<IHHqqqqIIIIHH", length, major, 0, frn, parent, at, time, reason, 0, 0, attrs, len(raw), 60) + raw).ljust(length, b"\0")


def decoded(spark, *parts):
    return R.decode(spark.createDataFrame([("b", b"".join(parts))], "source string, content binary"))


def test_scan_records(spark):
    rows = decoded(spark, usn(1, ROOT, "Videos", attrs=0x10), usn(2, 1, "holiday.mp4"), usn(3, 1, "notes.txt"), usn(4, 1, "song.flac"), usn(5, 1, "x.mp4", major=3))
    assert R.scan_counts(rows).first().asDict() == {"seen": 4, "dirs": 1, "files": 3, "kept": 2, "unsupported": 1, "malformed": 0}
    assert sorted(r["name"] for r in R.scan_records(rows).collect()) == ["Videos", "holiday.mp4", "song.flac"]


def test_malformed_buffers(spark):
    bad_name = bytearray(usn(1, 5, "a.mp4"))
    bad_name[56:58] = struct.pack("<H", 999)
    rows = decoded(spark, bytes(bad_name), usn(2, 5, "b.mp4"), b"\1\0\0\0junk")
    assert [r["outcome"] for r in rows.orderBy("at").collect()] == ["bad_name", "ok", "malformed"]
    assert R.decode(spark.createDataFrame([("b", None), ("c", b"")], "source string, content binary")).count() == 0


def test_journal_records(spark):
    rows = decoded(spark, usn(1, 5, "a.mp4", at=1), usn(2, 5, "b.mp4", J.DELETED | J.CREATED, at=2, time=7), usn(3, 5, "old.mp4", J.RENAMED_OLD, at=3), usn(3, 5, "new.mp4", J.RENAMED_NEW, at=4), usn(4, 5, "d", J.DELETED, 0x10, at=5), usn(5, 5, "n.txt", J.DELETED, at=6))
    changes = {(r["frn"], r["op"], r["name"]) for r in J.changes_of(rows, "D").collect()}
    assert changes == {(1, "present", "a.mp4"), (2, "gone", "b.mp4"), (3, "present", "new.mp4"), (4, "gone", "d"), (5, "gone", "n.txt")}
    assert {r["name"] for r in J.deletions_of(rows, "D").collect()} == {"b.mp4", "d"}
    assert J.deletions_of(rows, "D", media_only=False).count() == 3
    assert J.journal_counts(rows).first().asDict() == {"records": 6, "gone": 3, "present": 2, "skipped": 1}


def test_cursor():
    J.check_cursor(J.Cursor(1, 10), 1, 10)
    for journal_id, first in ((None, 0), (2, 0), (1, 11)):
        with pytest.raises(J.JournalRestart):
            J.check_cursor(J.Cursor(1, 10), journal_id, first)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("library")))
    scan = decoded(spark, usn(10, ROOT, "Phim", attrs=0x10), usn(11, ROOT, "Windows", attrs=0x10), usn(100, 10, "Đà Nẵng.mp4"), usn(101, 11, "skip.mp4"), usn(102, 10, "avatar 2009.mkv"))
    stats = spark.createDataFrame([("D:\\Phim\\avatar 2009.mkv", 70_000, 5)], "path string, size long, mtime long")
    assert engine.build({"D": R.scan_records(scan)}, stats) == {"D": {"ok": 2, "excluded": 1}}
    return engine


def test_search_and_status(engine):
    assert [r["path"] for r in engine.search("da nang").hits.collect()] == ["D:\\Phim\\Đà Nẵng.mp4"]
    assert engine.search("phim avatar", tag="q1").hits.count() == 1
    assert engine.status()["files"] == 2 and engine.status()["bytes"] == 70_000


def test_empty_scan_never_replaces_a_library(engine, spark):
    epoch = engine.status()["epoch"]
    with pytest.raises(EmptySnapshot):
        engine.build({"D": R.scan_records(decoded(spark))}, full=True)
    assert engine.store.current_epoch() == epoch and engine.search("avatar").hits.count() == 1


def test_updates_stream_in_and_without_effect_nothing_is_written(engine, spark, tmp_path):
    epoch = engine.status()["epoch"]
    assert not any(engine.apply_changes(spark.createDataFrame([], CHANGES)).values())
    assert engine.store.current_epoch() == epoch
    folder = str(tmp_path / "changes")
    for batch in ([(1, "present", "D", 200, 10, "dune.mp4", False), (2, "present", "D", 10, 5, "Movies", True)], [(3, "gone", "D", 100, 0, "", False)]):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(folder)
    J.follow(spark, folder, engine.store, str(tmp_path / "offsets")).awaitTermination()
    engine.reload()
    assert sorted(r["path"] for r in engine.paths().collect()) == ["D:\\Movies\\avatar 2009.mkv", "D:\\Movies\\dune.mp4"]
    assert engine.status()["epoch"] > epoch


def test_other_volumes_are_carried_over(engine, spark):
    engine.build({"E": R.scan_records(decoded(spark, usn(7, ROOT, "e.mp4")))})
    assert {r["volume"] for r in engine.paths().collect()} == {"D", "E"}
    assert sorted(r["idx"] for r in engine.paths().collect()) == list(range(engine.status()["files"]))
    engine.build({"E": R.scan_records(decoded(spark))})  # scanned and found empty: not carried over
    assert {r["volume"] for r in engine.paths().collect()} == {"D"}


def test_properties_and_duplicates(engine, spark):
    paths = [r["path"] for r in engine.paths().collect()]
    store = spark.createDataFrame([(p.lower(), 0, 0, 1920, 1080, 5000, True) for p in paths], "path_key string, size long, mtime long, width int, height int, duration_ms long, attempted boolean")
    engine.enrich(store)
    assert engine.search("dune", min_height=1080).hits.count() == 1 and engine.search("dune", min_height=2000).hits.count() == 0
    assert engine.enrich_status(spark.createDataFrame([], "letter string"))["total"] == len(paths)
    members, totals = engine.duplicates(spark.createDataFrame([(p, b"x") for p in paths], "path string, content binary"))
    assert members.count() == 0 and totals.first()["groups"] == 0


def test_no_library(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "none"))
    assert store.current_epoch() is None and store.load() is None
    with pytest.raises(J.JournalRestart):
        J.merge_batch(store, spark.createDataFrame([], CHANGES))


def test_walk(spark, tmp_path):
    for name in ("a/x.mp4", "a/.cache/y.mp4", "a/AppData/z.mp4", "a/notes.txt", "b.FLAC"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = R.walk(spark, str(tmp_path))
    assert {(r["name"], r["size"]) for r in found.collect()} == {("x.mp4", 5), ("b.FLAC", 5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_scannable(spark):
    rows = spark.createDataFrame([("C", "NTFS", "local"), ("Z", "NTFS", "network"), ("E", "exFAT", "removable")], "letter string, filesystem string, kind string")
    assert [r["skip_reason"] for r in R.scannable(rows).collect()] == [None, "network", "not ntfs"]
