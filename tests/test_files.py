"""Headers of media files, byte ranges, walks by level, and the store of properties."""

import io
import os
import struct
import zlib

import pytest

from shelfspark.file_queries import _box, _media_header
from shelfspark.sources.contents import read_ranges
from shelfspark.sources.properties import Props, Ranges, properties_at, properties_of, read_media_properties
from shelfspark.sources.snapshot import PropertyStore
from shelfspark.sources.walk import media_files, tree_counts, walk_tree


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def of(content):
    return properties_of(Ranges(Opened(content)))


@pytest.mark.parametrize("kind", range(8))
def test_headers_of_eight_formats(kind):
    width, height = (0, 0) if kind == 7 else (1921, 1079)
    head = _media_header(kind, width, height, 61_240)
    whole = Props(width, height, 61_240 if kind > 4 else 0)
    assert of(head + bytes(500)) == whole
    for n in range(len(head)):  # of a file that ends early, what it does not hold is 0
        assert all(a in (0, b) for a, b in zip(of(head[:n]), whole, strict=True)), n


def test_other_forms():
    assert of(b"BM" + bytes(12) + struct.pack("<IHH", 12, 640, 480) + bytes(8)) == Props(640, 480)
    lossless = (799 | 599 << 14).to_bytes(4, "little")
    assert of(b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + lossless + bytes(9)) == Props(800, 600)
    assert of(b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(8) + b"\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 200) + bytes(9)) == Props()  # a frame tag of four bytes is none
    assert of(b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(4) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 200) + bytes(9)) == Props(320, 200)
    flac = (44_100 << 44 | 44_100 * 7).to_bytes(8, "big")
    assert of(b"fLaC" + bytes(14) + flac + bytes(20)) == Props(0, 0, 7000)
    wide = _box(b"mvhd", b"\x01" + bytes(19), struct.pack(">IQ", 600, 600 * 90), bytes(80))
    far = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 100) + bytes(100)
    assert of(_box(b"ftyp", b"qt  ") + far + _box(b"moov", wide, _box(b"trak", _box(b"tkhd", bytes(76), struct.pack(">II", 1280 << 16, 720 << 16))))) == Props(1280, 720, 90_000)
    assert of(_box(b"ftyp") + _box(b"moov", _box(b"mvhd", bytes(12), struct.pack(">II", 1000, (1 << 32) - 1), bytes(80)))) == Props()
    for odd in (b"", b"plain text", b"\xff\xd8\xff", b"RIFF", b"BM", b"\x89PNG\r\n\x1a\n", struct.pack(">I", 0) + b"ftyp", _box(b"ftyp") + struct.pack(">I", 3) + b"moov"):
        assert of(odd) == Props()


def test_only_headers_are_read(tmp_path):
    """A movie of 3 GB whose boxes come last."""
    path = str(tmp_path / "big.mp4")
    head = _media_header(5, 3840, 2160, 5000)
    tail = head[head.index(b"moov") - 4 :]
    with open(path, "wb") as file:
        file.write(_box(b"ftyp", b"isom") + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + (3 << 30)))
        file.seek(3 << 30, 1)
        file.write(tail)
    with open(path, "rb") as file:
        size = os.path.getsize(path)
        ranges = Ranges(type("File", (), {"size": lambda _: size, "seek": lambda _, n: file.seek(n), "read": lambda _, n: file.read(n)})())
        assert properties_of(ranges) == Props(3840, 2160, 5000) and ranges.bytes_read < 2000
    assert properties_at(path) == properties_at(f"file://{path}") == Props(3840, 2160, 5000)
    assert properties_at(str(tmp_path / "none")) == properties_at(str(tmp_path)) == Props()


def test_entries_of_files(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"F{i}").write_bytes(_media_header(i, 100 + i, 50, 4000))
    rows = [(str(tmp_path / f"F{i}"), i, 9) for i in range(9)] + [(None, 1, 1)]
    found = {r["size"]: r for r in read_media_properties(spark.createDataFrame(rows, "path string, size long, mtime long")).collect() if r["path_key"]}
    assert [found[i]["width"] for i in range(9)] == [100, 101, 102, 103, 104, 105, 106, 0, 0]
    assert all(r["attempted"] and r["mtime"] == 9 and r["path_key"].endswith(f"/f{i}") for i, r in found.items())


def entries(spark, *rows):
    return spark.createDataFrame([(k, 1, t, w, 0, 0, True) for k, t, w in rows], "path_key string, size long, mtime long, width int, height int, duration_ms long, attempted boolean")


def test_layers_of_properties(spark, tmp_path, monkeypatch):
    store = PropertyStore(spark, str(tmp_path / "props"))
    held = lambda s=store: sorted((r["path_key"], r["mtime"], r["width"]) for r in s.load().collect())
    assert held() == [] and store.compact() == 0
    assert store.append(entries(spark, ("a", 1, 10), ("b", 1, 20))) == 2
    assert store.append(entries(spark, ("a", 2, 11), ("c", 1, 30))) == 2
    assert held() == [("a", 2, 11), ("b", 1, 20), ("c", 1, 30)]
    other = PropertyStore(spark, store.root, schema_version=9)
    assert held(other) == [] and other.append(entries(spark, ("z", 1, 1))) == 1 and held(other) == [("z", 1, 1)]
    assert len(held()) == 3
    version = store.compact()
    assert held() == [("a", 2, 11), ("b", 1, 20), ("c", 1, 30)] and store._newest() == (version, []) and store.compact() == version
    assert store.append(entries(spark, ("b", 5, 21))) == 1 and held()[1] == ("b", 5, 21)
    monkeypatch.setattr(PropertyStore, "MOST_LAYERS", 2)
    assert store.append(entries(spark, ("d", 1, 40))) == 1 and store._newest() == (version + 1, []) and len(held()) == 4
    assert held(other) == [("z", 1, 1)]


def test_byte_ranges_of_files(spark, tmp_path):
    content = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(content)
    path = str(tmp_path / "f")
    rows = [(0, path, "bytes=0-9"), (1, path, "bytes=-7"), (2, path, "bytes=10000-"), (3, path, "bytes=20000-"), (4, str(tmp_path / "none"), "bytes=0-1"), (5, path, None), (6, None, "bytes=0-1"), (7, path, "bytes=100-99999"), (8, path, "bytes=-99999")]
    table = spark.createDataFrame(rows, "k int, path string, header string")
    found = {r["k"]: r for r in read_ranges(table, cap=500).collect()}
    assert bytes(found[0]["content"]) == content[:10] and bytes(found[1]["content"]) == content[-7:] and bytes(found[2]["content"]) == content[10_000:]
    assert bytes(found[7]["content"]) == content[100:600] and (found[7]["first"], found[7]["last"]) == (100, 599)
    assert bytes(found[8]["content"]) == content[:500]
    assert found[3]["content"] is None and found[3]["size"] == len(content) and found[5]["first"] is None
    assert found[4]["size"] is None and found[4]["content"] is None and found[6]["content"] is None


def test_a_walk_by_levels(spark, tmp_path, monkeypatch):
    root = tmp_path / "w"
    for folder in ("Films/Inner", "Films/node_modules/x", ".git", "a/b/c/d"):
        os.makedirs(root / folder)
    for name in ("Films/a.mp4", "Films/notes.txt", "Films/Inner/B.JPG", "Films/node_modules/x/hidden.mp4", ".git/c.png", "a/b/c/d/deep.mp3", "top.mkv"):
        (root / name).write_bytes(b"12345")
    os.symlink(root / "Films", root / "again")
    os.symlink(root / "Films/a.mp4", root / "a.mp4")
    walked = walk_tree(spark, f"{root}/", max_depth=4)
    got = {r["path"].removeprefix(str(root)): (r["outcome"], r["depth"]) for r in walked.collect()}
    assert got == {
        "": ("listed", 0), "/Films": ("listed", 1), "/Films/Inner": ("listed", 2), "/Films/node_modules": ("excluded", 2), "/.git": ("excluded", 1), "/a": ("listed", 1), "/a/b": ("listed", 2), "/a/b/c": ("listed", 3),
        "/a/b/c/d": ("too_deep", 4), "/Films/a.mp4": ("file", 2), "/Films/notes.txt": ("file", 2), "/Films/Inner/B.JPG": ("file", 3), "/top.mkv": ("file", 1), "/again": ("link", 1), "/a.mp4": ("link", 1),
    }
    assert sorted((r["name"], r["kind"], r["size"]) for r in media_files(walked).collect()) == [("B.JPG", "image", 5), ("a.mp4", "video", 5), ("top.mkv", "video", 5)]
    assert tree_counts(walked).first().asDict() == {"directories_seen": 6, "orphaned": 0, "excluded": 2, "links": 2, "too_deep": 1, "files_seen": 4, "media_files_in": 3, "kept": 3}
    assert walk_tree(spark, str(root), skip_dot=False).where("name = 'c.png'").count() == 1
    missing = walk_tree(spark, f"{root}/none")
    assert [(r["outcome"], r["depth"]) for r in missing.collect()] == [("unreadable", 0)] and tree_counts(missing).first()["orphaned"] == 1


def test_paths_that_differ_in_case_are_listed_once(spark, tmp_path):
    for name in ("Same", "SAME", "other"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / f"{zlib.crc32(name.encode())}.mp4").write_bytes(b"1")
    walked = walk_tree(spark, str(tmp_path))
    assert sorted(r["name"] for r in walked.where("is_dir and depth = 1").collect()) == ["SAME", "other"] and media_files(walked).count() == 2
