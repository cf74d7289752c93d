"""Layers of changed rows give the library that a whole rewrite gives."""

import random

import pytest

from shelfspark.operators.changes import LOOKUP, apply_changes, delta_of
from shelfspark.sources.snapshot import CHANGES, EmptySnapshot, SnapshotStore
from shelfspark.streaming.journal import library_rows, merge_batch

FILES = "volume string, frn long, name string, kind string, dir string, size long, mtime long"
DIRS = "volume string, frn long, path string"


def library(rng, n=60):
    """A random tree of folders with files, some without a number."""
    dirs = [(v, 5, f"{v}:") for v in "CD"]
    for i in range(20):
        v, _, path = rng.choice(dirs)
        dirs.append((v, 100 + i, f"{path}\\d{i}"))
    files = []
    for i in range(n):
        v, _, path = rng.choice(dirs)
        files.append((v, 0 if i % 10 == 0 else 1000 + i, f"f{i}.mp4", "video", path, i, i + 1))
    return files, dirs


def batch(rng, first):
    """Random changes of folders and files, known ones and new ones, with parents known and unknown."""
    out = []
    for k in range(25):
        v = rng.choice("CD")
        if rng.random() < 0.4:
            frn, parent = rng.choice([rng.randrange(100, 120), 300 + rng.randrange(8)]), rng.choice([5, rng.randrange(100, 120), 300 + rng.randrange(8), 9999, 8888])
            out.append((first + k, rng.choice(["present", "present", "present", "gone"]), v, frn, parent, f"n{rng.randrange(9)}", True))
        else:
            frn, parent = rng.choice([1000 + rng.randrange(60), 2000 + rng.randrange(20), 0]), rng.choice([5, rng.randrange(100, 120), 300 + rng.randrange(8), 9999, 9998, 7777])
            out.append((first + k, rng.choice(["present", "present", "gone"]), v, frn, parent, rng.choice(["a.mp4", "b.txt", "c.MP3", "Đ.jpg"]), False))
    return out


def by_path(snapshot):
    paths = snapshot.dirs.select("dir_id", "path")
    files = sorted(tuple(r) for r in snapshot.files.join(paths.withColumnRenamed("path", "dir"), "dir_id").select("volume", "frn", "name", "kind", "dir", "size", "mtime").collect())
    return files, sorted(tuple(r) for r in snapshot.dirs.select("volume", "frn", "path").collect())


@pytest.mark.parametrize("seed", range(2))
def test_layers_equal_whole_rewrites(spark, tmp_path, seed):
    rng = random.Random(seed)
    files, dirs = library(rng)
    lookup = spark.createDataFrame([("D", 9999, "path", "D:\\Found"), ("C", 9999, "path", "C:\\Found"), ("D", 9998, "excluded", None), ("D", 7777, "unknown", None)], LOOKUP)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish(*library_rows(spark.createDataFrame(files, FILES), spark.createDataFrame(dirs, DIRS)))
    SnapshotStore.MOST_SHARE, share = 100.0, SnapshotStore.MOST_SHARE
    try:
        for step in range(2):
            rows = spark.createDataFrame(batch(rng, 100 * step), CHANGES)
            now = store.load()
            expected = apply_changes(now.files.join(now.dirs.select("dir_id", now.dirs["path"].alias("dir")), "dir_id").select("volume", "frn", "name", "kind", "dir", "size", "mtime"), now.dirs.select("volume", "frn", "path"), rows, lookup)
            counts = merge_batch(store, rows, lookup)
            assert counts == expected.counts
            got = by_path(store.load())
            assert got[0] == sorted(tuple(r) for r in expected.files.select("volume", "frn", "name", "kind", "dir", "size", "mtime").collect())
            assert sorted(set(got[1])) == sorted(set(tuple(r) for r in expected.dirs.collect()))
            ids = [r["idx"] for r in store.load().files.collect()]
            assert len(set(ids)) == len(ids)
    finally:
        SnapshotStore.MOST_SHARE = share


def test_a_chain_of_new_folders(spark):
    chain = [(i, "present", "D", 500 + i, 500 + i - 1 if i else 5, f"c{i}", True) for i in range(40)]
    lost = [(100 + i, "present", "D", 700 + i, 699 + i, "x", True) for i in range(3)]
    loop = [(200, "present", "D", 801, 802, "x", True), (201, "present", "D", 802, 801, "y", True)]
    files = spark.createDataFrame([("D", 1, "a.mp4", "video", "D:", 1, 1)], FILES)
    out = apply_changes(files, spark.createDataFrame([("D", 5, "D:")], DIRS), spark.createDataFrame([*chain, *lost, *loop], CHANGES))
    assert out.counts["dirs_added"] == 40 and out.counts["unresolved"] == 5
    assert max((r["path"] for r in out.dirs.collect()), key=len) == "D:\\" + "\\".join(f"c{i}" for i in range(40))


def test_a_layer_is_small_and_layers_become_whole(spark, tmp_path, monkeypatch):
    files = [("D", 1000 + i, f"f{i}.mp4", "video", "D:\\a", 1, 1) for i in range(200)]
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish(*library_rows(spark.createDataFrame(files, FILES), spark.createDataFrame([("D", 5, "D:"), ("D", 10, "D:\\a")], DIRS)))
    merge_batch(store, spark.createDataFrame([(1, "present", "D", 10, 5, "b", True), (2, "gone", "D", 1003, 10, "", False), (3, "present", "D", 1004, 10, "g.mp4", False)], CHANGES))
    rows = lambda epoch, table: spark.read.parquet(f"{store.root}/epoch={epoch}/{table}").count()
    assert [rows(2, t) for t in ("files", "files_gone", "dirs", "dirs_gone")] == [1, 1, 1, 0]
    assert store.load().files.count() == 199 and {r["path"] for r in store.load().dirs.collect()} == {"D:", "D:\\b"}
    monkeypatch.setattr(SnapshotStore, "MOST_LAYERS", 2)
    merge_batch(store, spark.createDataFrame([(4, "gone", "D", 1005, 10, "", False)], CHANGES))
    assert rows(3, "files") == 198 and store._published()[3][0] is None and store.load(2).files.count() == 199
    merge_batch(store, spark.createDataFrame([(i, "gone", "D", 1010 + i, 10, "", False) for i in range(60)], CHANGES))  # a fifth of the rows and more
    assert rows(4, "files") == 138 and store.load().files.count() == 138


def test_no_layer_empties_a_library(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish(*library_rows(spark.createDataFrame([("D", 1, "a.mp4", "video", "D:", 1, 1)], FILES), spark.createDataFrame([("D", 5, "D:")], DIRS)))
    with pytest.raises(EmptySnapshot):
        merge_batch(store, spark.createDataFrame([(1, "gone", "D", 1, 5, "", False)], CHANGES))
    assert store.current_epoch() == 1 and store.load().files.count() == 1
    now = store.load()
    assert not delta_of(now.files, now.dirs, spark.createDataFrame([], CHANGES)).changed


@pytest.mark.parametrize("name", ["snapshot_layers", "snapshot_layer_rows"])
def test_new_folders_share_no_number_with_files(spark, tmp_path, name):
    """Parts with keys from 5,900 on, whose files would have the numbers 7,001 and 7,002."""
    duckdb = pytest.importorskip("duckdb")
    from shelfspark.queries import ORACLE, QUERIES

    from .test_queries import DATA, TABLES, compare

    for t in TABLES:
        if t != "part":
            (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + 5900 AS p_partkey) FROM '{DATA}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    compare(spark, QUERIES[name], ORACLE[name], str(tmp_path))
