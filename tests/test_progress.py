"""Progress of builds, cancelled builds, watched snapshots, presets, lists of duplicates, streams by volume."""

import json
import time
from threading import Thread

import pytest
from pyspark.sql import functions as F

from shelfspark.__main__ import main
from shelfspark.functions import control, media
from shelfspark.operators import audit, dupes, search
from shelfspark.plans.engine import Engine
from shelfspark.plans.progress import Cancelled, ProgressWriter, read_progress, reported, tagged_tasks
from shelfspark.sources import volumes
from shelfspark.sources.snapshot import VOLUMES
from shelfspark.streaming import journal
from shelfspark.streaming.source import JournalReader, write_state

RECORDS = "frn long, parent_frn long, name string, is_dir boolean, kind string"


def records(spark, n=4, lost=2):
    return spark.createDataFrame([(10, 5, "Films", True, None), (11, 5, "AppData", True, None), *((100 + i, 10, f"elm {i}.mp4", False, "video") for i in range(n)), *((500 + i, 77, "x.mp4", False, "video") for i in range(lost)), (900, 11, "y.mp4", False, "video")], RECORDS)


def test_writes_are_throttled_and_the_end_is_always_written(tmp_path):
    now = [0.0]
    writer = ProgressWriter(str(tmp_path / "p.json"), "D", every=0.1, clock=lambda: now[0])
    assert writer.tick(1, 9) and not writer.tick(2, 9)
    assert read_progress(writer.path) == control.Record("progress", "D", 1, 9)
    now[0] = 0.05
    writer.end("finished", 9, 9)
    assert read_progress(writer.path) == control.Record("finished", "D", 9, 9)
    assert [p.name for p in tmp_path.iterdir()] == ["p.json"]


def test_records_of_a_file_are_the_records_of_a_table(spark, tmp_path):
    good = control.Record("failed", "E", 3, 4, "disk").text()
    later, odd = json.dumps({**json.loads(good), "version": 99}), json.dumps({**json.loads(good), "kind": "tea"})
    lines = [good, good[:20], "", "[1]", later, odd, "null", json.dumps({"kind": "failed"})]
    table = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i long, line string").select("i", control.parsed_record(F.col("line")).alias("r")).orderBy("i").collect()
    for line, row in zip(lines, table, strict=True):
        found = control.record_of(line)
        assert (found is None) == (row["r"] is None), line
        if found:
            assert found == tuple(row["r"][name] for name in found._fields) and row["r"]["finished"]
        (tmp_path / "p.json").write_text(line)
        assert read_progress(str(tmp_path / "p.json")) == found
    (tmp_path / "p.json").write_bytes(b"\xff\xfe")
    assert read_progress(str(tmp_path / "p.json")) is None and read_progress(str(tmp_path / "none.json")) is None


def test_a_block_reports_its_own_tasks(spark, tmp_path):
    path, seen = str(tmp_path / "p.json"), []

    def watch():
        while not seen or seen[-1].kind == "progress":
            seen.extend([r] if (r := read_progress(path)) else [])
            time.sleep(0.05)

    watcher = Thread(target=watch, daemon=True)
    with reported(spark, path, "D", every=0.05):
        watcher.start()
        spark.range(8).repartition(8).mapInPandas(lambda parts: (time.sleep(0.2) or p for p in parts), "id long").count()
    watcher.join(20)
    done = [r.done for r in seen]
    assert done == sorted(done) and seen[-1].kind == "finished" and seen[-1].done == seen[-1].total >= 8
    assert any(r.kind == "progress" for r in seen) and tagged_tasks(spark, "no such tag") == (0, 0)
    with pytest.raises(ZeroDivisionError), reported(spark, path):
        raise ZeroDivisionError("no")
    assert read_progress(path)[0] == "failed" and read_progress(path).error == "no"


def test_a_build_counts_as_it_writes_and_finishes_last(spark, tmp_path):
    engine, path = Engine(spark, str(tmp_path / "library")), str(tmp_path / "p.json")
    outcomes = engine.build({"D": records(spark), "E": records(spark, 1, 0)}, progress=path)
    assert outcomes == {"D": {"ok": 4, "orphaned": 2, "excluded": 1}, "E": {"ok": 1, "excluded": 1}}
    assert read_progress(path)[:2] == ("finished", "D,E") and engine.status()["files"] == 5
    empty = spark.createDataFrame([], RECORDS)
    with pytest.raises(ValueError):
        engine.build({"D": empty, "E": empty}, progress=path)
    assert read_progress(path).kind == "failed" and Engine(spark, engine.store.root).status()["files"] == 5


def test_a_cancelled_build_publishes_nothing(spark, tmp_path):
    def slowly(batches):
        for batch in batches:
            time.sleep(5)
            yield batch

    engine, path, out = Engine(spark, str(tmp_path / "library")), str(tmp_path / "p.json"), []

    def run():
        try:
            engine.build({"D": records(spark).coalesce(1).mapInArrow(slowly, RECORDS)}, tag="scan", progress=path)
        except Cancelled as stopped:
            out.append(str(stopped))

    thread = Thread(target=run)
    thread.start()
    time.sleep(3)
    engine.cancel("scan")
    thread.join(60)
    assert out == ["scan"] and read_progress(path).kind == "cancelled" and engine.store.current_epoch() is None
    assert engine.build({"D": records(spark)}, tag="scan", progress=path)["D"]["ok"] == 4 and engine.store.current_epoch() == 1


def test_a_watcher_finds_what_others_publish(spark, tmp_path):
    mine, other, told = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path)), []
    end = mine.watch(told.append, every=0.1)
    try:
        for n in (1, 3):
            other.build({"D": records(spark, n)})
            until = time.time() + 30
            while (mine.snapshot is None or mine.snapshot.epoch != other.snapshot.epoch) and time.time() < until:
                time.sleep(0.1)
            assert mine.status()["files"] == n
    finally:
        end()
    other.build({"D": records(spark, 2)})
    time.sleep(0.5)
    assert told == [1, 2] and mine.status()["files"] == 3


def test_presets():
    assert search.preset_filters("4K", "medium", "week") == {"min_height": 2160, "min_duration_ms": 60_000, "max_duration_ms": 600_000, "within_days": 7}
    assert search.preset_filters() == {}
    for names in (("8k",), ("720p", "1080p"), ("short", "long"), ("week", "week")):
        with pytest.raises(ValueError):
            search.preset_filters(*names)


def test_labels(spark):
    row = spark.sql("SELECT 1234567L AS n, 999L AS small, -1000L AS minus, 0L AS none, CAST(NULL AS LONG) AS nothing, 1706796309L AS at").select(
        media.count_label(F.col("n")), media.count_label(F.col("small")), media.count_label(F.col("minus")), media.count_label(F.col("none"), " "), media.count_label(F.col("nothing")),
        media.time_label(F.col("at")), media.time_label(F.col("none")), media.time_label(F.col("nothing")),
    ).first()
    assert tuple(row) == ("1.234.567", "999", "-1.000", "0", None, "14:05:09 1/2/2024", "", "")


def test_groups_as_a_list(spark):
    files = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (3, 99, "b"), (5, 99, "b"), (4, 99, "b"), (6, 7, "c")], "idx long, size long, fp string")
    rows = dupes.group_rows(dupes.duplicate_members(files, dupes.duplicate_groups(files))).collect()
    assert [(r["head"], r["n"], r["idx"]) for r in rows] == [(True, 3, None), (False, 3, 3), (False, 3, 4), (False, 3, 5), (True, 2, None), (False, 2, 1), (False, 2, 2)]
    assert dupes.group_rows(dupes.duplicate_members(files.limit(0), dupes.duplicate_groups(files.limit(0)))).count() == 0


def test_network_drives(spark):
    rows = spark.createDataFrame([("Z", 1, 0, 0, 0, "NTFS", "z", "network", None), ("Z", 1, 0, 0, 0, "NTFS", "z", "network", "//a/b"), ("C", 2, 0, 0, 0, "NTFS", "c", "local", None)], VOLUMES)
    assert [tuple(r) for r in volumes.network_drives(rows).collect()] == [("Z", "z", "//a/b")]


def test_footprint(spark):
    files = spark.createDataFrame([("é", None, 1, True)], "a string, b string, c long, d boolean")
    found = {r["table"]: tuple(r)[1:] for r in audit.footprint(files, files.limit(0)).collect()}
    assert found == {"files": (1, 2, 9), "dirs": (0, 0, 0)}


def test_a_stream_keeps_the_last_row_of_each_key(spark, tmp_path):
    schema = "batch long, k string, v string"  # a column named as the layers could be
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    assert journal.stream_last(stream(), ["k"], "batch").count() == 0
    for i, rows in enumerate([[(5, "a", "new"), (1, "b", "old"), (1, None, "x")], [(3, "a", "late"), (2, "b", "new"), (2, "c", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            time.sleep(1.1)  # files are taken by their time
    last = journal.stream_last(stream(), ["k"], "batch")
    assert last.columns == ["batch", "k", "v"]
    assert {tuple(r) for r in last.collect()} == {(5, "a", "new"), (2, "b", "new"), (2, "c", None), (1, None, "x")}


def test_a_journal_source_may_be_narrowed_to_volumes(tmp_path):
    for letter in "DEF":
        write_state(str(tmp_path), letter, 7, 0, 100)
    offsets = lambda **options: set(JournalReader({"path": str(tmp_path), **options}).latestOffset())
    assert offsets() == {"D", "E", "F"} and offsets(volumes="e, f") == {"E", "F"} and offsets(volumes="x") == set()


def test_command_line(spark, tmp_path, capsys):
    library = str(tmp_path / "library")
    Engine(spark, library).build({"D": records(spark)})
    main(["--library", library, "dump", "--rows", "2"])
    main(["--library", library, "search", "elm", "--preset", "year"])
    assert "D:\\Films\\elm 0.mp4" in (shown := capsys.readouterr().out) and "elm 2.mp4" not in shown and "number_bytes" in shown
    with pytest.raises(SystemExit):
        main(["--library", library, "audit", f"D={tmp_path}", "--volume", "E"])
    with pytest.raises(SystemExit):
        main(["--library", str(tmp_path / "none"), "dump"])
