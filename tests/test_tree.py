from shelfspark.operators.tree import outcome_counts, resolve_directories, resolve_files, used_directories
from shelfspark.sources.snapshot import RECORDS

ROOT = 0x0005000000000005


def records(spark, dirs, files):
    rows = [(f, p, n, True, None) for f, p, n in dirs] + [(f, p, n, False, "video") for f, p, n in files]
    return spark.createDataFrame(rows, RECORDS)


def resolved(spark, dirs, files, letter="C", **options):
    rows = records(spark, dirs, files)
    folders = resolve_directories(rows, letter, **options)
    found = resolve_files(rows, folders)
    return {r["name"]: (r["outcome"], r["path"]) for r in found.collect()}, folders, found


def test_deep_chain_and_shared_prefix(spark):
    dirs = [(10, ROOT, "Users"), (11, 10, "padoma"), (12, 11, "Videos"), (13, 12, "2024"), (14, 13, "Trips"), (15, 11, "Music")]
    got, folders, found = resolved(spark, dirs, [(100, 14, "clip.mp4"), (101, 15, "a.mp3")])
    assert got["clip.mp4"] == ("ok", "C:\\Users\\padoma\\Videos\\2024\\Trips\\clip.mp4")
    used = {r["path"] for r in used_directories(found, folders).collect()}
    assert "C:\\Users\\padoma\\Videos" in used and len(used) == 7


def test_files_in_the_root(spark):
    assert resolved(spark, [], [(100, ROOT, "movie.mp4")], "D")[0]["movie.mp4"] == ("ok", "D:\\movie.mp4")
    r = 0x1234000000009999
    assert resolved(spark, [(r, r, "."), (10, r, "Media")], [(100, 10, "a.mp4")], "E")[0]["a.mp4"] == ("ok", "E:\\Media\\a.mp4")


def test_exclusion_is_by_folder(spark):
    dirs = [(10, ROOT, "Windows"), (11, 10, "Media"), (20, ROOT, "Videos"), (30, ROOT, ".gradle"), (31, 30, "caches"), *[(40 + i, ROOT, n) for i, n in enumerate("build dist target bin obj vendor packages".split())]]
    files = [(100, 11, "x.mp4"), (101, 20, "keep.mp4"), (102, 31, "icon.mp4"), (103, 20, ".dot.mp4"), *[(200 + i, 40 + i, f"k{i}.mp4") for i in range(7)]]
    got, _, found = resolved(spark, dirs, files)
    assert {n for n, (o, _) in got.items() if o == "excluded"} == {"x.mp4", "icon.mp4"}
    assert {r["outcome"]: r["files"] for r in outcome_counts(found).collect()} == {"ok": 9, "excluded": 2}


def test_orphans_cycles_and_depth(spark):
    chain = [(1000 + i, 1000 + i - 1 if i else ROOT, f"d{i}") for i in range(40)]
    dirs = [(10, 11, "a"), (11, 10, "b"), *chain, (50, 77, "lost")]
    files = [(100, 99, "orphan.mp4"), (101, 10, "cycle.mp4"), (102, 1039, "deep.mp4"), (103, 1003, "near.mp4"), (104, 50, "under_lost.mp4")]
    got = resolved(spark, dirs, files, max_depth=8)[0]
    assert {n: o for n, (o, _) in got.items()} == {"orphan.mp4": "orphaned", "cycle.mp4": "cycle", "deep.mp4": "too_deep", "near.mp4": "ok", "under_lost.mp4": "orphaned"}


def test_empty(spark):
    assert resolved(spark, [], [])[0] == {}
