"""Newer searches stop older ones, and a stopped run gives nothing rather than a part."""

import time
from threading import Thread

import pytest
from pyspark.sql import functions as F

from shelfspark.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("library")))
    records = spark.createDataFrame([(10, 5, "Films", True, None), *((100 + i, 10, f"oak {i}.mp4", False, "video") for i in range(20))], "frn long, parent_frn long, name string, is_dir boolean, kind string")
    engine.build({"D": records}, spark.createDataFrame([(f"D:\\Films\\oak {i}.mp4", 200_000, 1) for i in range(20)], "path string, size long, mtime long"))
    return engine


def slow(files):
    """The same rows, three seconds each."""

    def part(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                time.sleep(3)
                yield batch.slice(i, 1)

    return files.coalesce(1).mapInArrow(part, files.schema)


def test_a_newer_search_stops_the_older(engine):
    files, out = engine.snapshot.files, {}
    engine.snapshot.files = slow(files)
    first = Thread(target=lambda: out.update(first=engine.search("oak", supersedes="box").hits.collect()))
    began = time.time()
    first.start()
    time.sleep(5)
    engine.snapshot.files = files
    second = engine.search("oak 7", supersedes="box").hits.collect()
    first.join(60)
    assert [r["name"] for r in second] == ["oak 7.mp4", "oak 17.mp4"] and out["first"] == [] and time.time() - began < 55
    assert len(engine.search("oak", supersedes="another box").hits.collect()) == 20
    assert engine.search("oak", supersedes="box").hits.first()["path"].startswith("D:\\Films\\oak")


def test_a_stopped_run_of_duplicates_gives_nothing(engine, tmp_path):
    for i in range(20):
        (tmp_path / f"oak {i}.mp4").write_bytes(b"x" * 200_000)
    locate = lambda p: F.concat(F.lit(f"{tmp_path}/"), F.substring_index(p, "\\", -1))
    members, totals, counters = engine.duplicates_of_paths(locate=locate, tag="whole")
    assert members.count() == 20 and totals.first()["groups"] == 1 and counters.first()["hashed"] == 20
    files, out = engine.snapshot.files, {}
    engine.snapshot.files = slow(files)
    try:
        run = Thread(target=lambda: out.update(found=engine.duplicates_of_paths(locate=locate, tag="stop me")))
        run.start()
        time.sleep(8)
        engine.cancel("stop me")
        run.join(60)
        assert out["found"] is None
    finally:
        engine.snapshot.files = files
    assert engine.duplicates_of_paths(locate=locate, tag="stop me")[0].count() == 20
