import pytest

from shelfspark.operators.changes import LOOKUP, apply_changes
from shelfspark.sources.snapshot import CHANGES

ROOT = 0x0005000000000005
FILES = "volume string, frn long, name string, kind string, dir string, size long, mtime long"


@pytest.fixture
def merge(spark):
    files = [("D", 99, "root.mp4", "video", "D:", 10, 1), ("D", 100, "avatar.mkv", "video", "D:\\Phim", 20, 2), ("D", 101, "titanic.mkv", "video", "D:\\Phim", 30, 3), ("D", 102, "bài hát.mp3", "audio", "D:\\Nhạc", 40, 4)]
    dirs = [("D", 5, "D:"), ("D", 10, "D:\\Phim"), ("D", 11, "D:\\Nhạc")]

    def run(changes, more_files=(), more_dirs=(), lookup=()):
        rows = [(i, c[0], c[4] if len(c) > 4 else "D", c[1], c[2] if len(c) > 2 else 0, (c[3].rstrip("/") if len(c) > 3 else ""), len(c) > 3 and c[3].endswith("/")) for i, c in enumerate(changes)]
        out = apply_changes(
            spark.createDataFrame([*files, *more_files], FILES), spark.createDataFrame([*dirs, *more_dirs], "volume string, frn long, path string"),
            spark.createDataFrame(rows, CHANGES), spark.createDataFrame(list(lookup), LOOKUP),
        )
        return {(r["volume"], r["frn"]): r for r in out.files.collect()}, {r["path"] for r in out.dirs.collect()}, {k: v for k, v in out.counts.items() if v}

    return run


def path(r):
    return f"{r['dir']}\\{r['name']}"


def test_nothing(merge):
    files, dirs, counts = merge([])
    assert len(files) == 4 and len(dirs) == 3 and counts == {}


def test_gone_renamed_moved_added(merge):
    files, _, counts = merge([("gone", 100), ("present", 101, 11, "TITANIC 1997.mkv"), ("present", 200, 10, "dune.mp4"), ("present", 201, ROOT, "new.mp4"), ("present", 202, 10, "notes.txt")])
    assert ("D", 100) not in files and ("D", 202) not in files
    assert path(files["D", 101]) == "D:\\Nhạc\\TITANIC 1997.mkv" and files["D", 101]["size"] == 30 and files["D", 101]["mtime"] == 3
    assert files["D", 200]["size"] == 0 and path(files["D", 201]) == "D:\\new.mp4"
    assert counts == {"files_removed": 1, "files_moved": 1, "files_added": 2}


@pytest.mark.parametrize("order", [1, -1])
def test_new_folders_in_any_order(merge, order):
    files, dirs, counts = merge([("present", 20, 10, "2024/"), ("present", 21, 20, "Q4/"), ("present", 300, 21, "phim mới.mp4")][::order])
    assert path(files["D", 300]) == "D:\\Phim\\2024\\Q4\\phim mới.mp4" and counts == {"dirs_added": 2, "files_added": 1}


def test_renamed_folder_takes_what_is_beneath(merge):
    more = [("D", 12, "D:\\Phim\\Sub"), ("D", 13, "D:\\Phim2")]
    files, dirs, counts = merge([("present", 10, ROOT, "Movies/")], [("D", 110, "x.mp4", "video", "D:\\Phim\\Sub", 1, 1), ("D", 111, "y.mp4", "video", "D:\\Phim2", 1, 1)], more)
    assert path(files["D", 110]) == "D:\\Movies\\Sub\\x.mp4" and path(files["D", 111]) == "D:\\Phim2\\y.mp4" and path(files["D", 100]) == "D:\\Movies\\avatar.mkv"
    assert counts == {"dirs_renamed": 1} and "D:\\Phim2" in dirs


def test_nested_renames(merge):
    files, _, counts = merge([("present", 12, 10, "New/"), ("present", 10, ROOT, "Movies/")], [("D", 110, "x.mp4", "video", "D:\\Phim\\Sub", 1, 1)], [("D", 12, "D:\\Phim\\Sub")])
    assert path(files["D", 110]) == "D:\\Movies\\New\\x.mp4" and counts == {"dirs_renamed": 2}


def test_deleted_folder_takes_what_is_beneath(merge):
    files, dirs, counts = merge([("gone", 10)], [("D", 110, "x.mp4", "video", "D:\\Phim\\Sub", 1, 1)], [("D", 12, "D:\\Phim\\Sub")])
    assert set(files) == {("D", 99), ("D", 102)} and counts == {"files_removed": 3, "dirs_removed": 2}


def test_identity_is_volume_and_number(merge):
    other = [("C", 100, "avatar.mkv", "video", "C:", 5, 5)]
    files, _, _ = merge([("gone", 100)], other, [("C", 5, "C:")])
    assert ("C", 100) in files and ("D", 100) not in files


def test_last_record_wins_and_zero_is_nobody(merge):
    files, _, counts = merge([("present", 500, 10, "a.mp4"), ("present", 500, 10, "b.mp4"), ("present", 500, 11, "final.mp4"), ("present", 501, 10, "x.mp4"), ("gone", 501), ("gone", 0)], [("D", 0, "net.mp4", "video", "D:", 1, 1)])
    assert path(files["D", 500]) == "D:\\Nhạc\\final.mp4" and ("D", 501) not in files and ("D", 0) in files and counts == {"files_added": 1}


def test_unknown_parents_and_lookup(merge):
    assert merge([("present", 400, 9999, "a.mp4")])[2] == {"unresolved": 1}
    answers = [("D", 9999, "path", "D:\\Khác"), ("D", 9998, "excluded", None), ("D", 9997, "unknown", None)]
    files, dirs, counts = merge([*[("present", 400 + i, 9999, f"a{i}.mp4") for i in range(5)], ("present", 500, 9998, "b.mp4"), ("present", 501, 9997, "c.mp4")], lookup=answers)
    assert path(files["D", 400]) == "D:\\Khác\\a0.mp4" and "D:\\Khác" in dirs
    assert counts == {"files_added": 5, "dirs_looked_up": 1, "excluded": 1, "unresolved": 1}


def test_a_known_file_that_loses_its_media_name_is_removed(merge):
    files, _, counts = merge([("present", 100, 10, "avatar.txt")])
    assert ("D", 100) not in files and counts == {"files_removed": 1}
