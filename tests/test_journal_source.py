"""Journals as a streaming source, and the decoder of whole buffers."""

import random
import struct

import pytest

from shelfspark.sources.records import batches_of
from shelfspark.sources.snapshot import SnapshotStore
from shelfspark.streaming import source
from shelfspark.streaming.journal import Cursor, JournalRestart, changes_of, library_rows


def record(usn, name="a.mp4", frn=1000, parent=5, reason=0x100, attrs=0x20, major=2, raw=None, more=0):
    name = raw if raw is not None else name.encode("utf-16-le")
    length = -(-(60 + len(name)) // 8) * 8
    return struct.pack("<IHHqqqqIIIIHH", length, major, 0, frn, parent, usn, 10, reason, 0, 0, attrs, len(name) + more, 60) + name + bytes(length - 60 - len(name))


def rows(content):
    return [r for b in batches_of("x", content) for r in b.to_pylist()]


def test_names_decode_as_utf16():
    rng = random.Random(3)
    names = []
    for _ in range(300):
        units = [rng.choice([rng.randrange(0x20, 0x80), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xD800, 0xE000), rng.randrange(0xE000, 0x10000)]) for _ in range(rng.randrange(6))]
        names.append(struct.pack(f"<{len(units)}H", *units))
    found = rows(b"".join(record(i, raw=n) for i, n in enumerate(names)))
    assert [r["name"] for r in found] == [n.decode("utf-16-le", "replace") for n in names]
    assert [r["usn"] for r in found] == list(range(300))


def test_outcomes_of_records():
    content = record(1) + record(2, major=3) + record(3, more=1) + record(4, more=400) + record(5, frn=-7, attrs=0x10, reason=0x80000200)
    found = rows(content + record(6)[:-1])
    assert [r["outcome"] for r in found] == ["ok", "unsupported", "bad_name", "bad_name", "ok", "malformed"]
    assert (found[4]["frn"], found[4]["attrs"], found[4]["reason"], found[1]["frn"]) == (-7, 0x10, 0x80000200, None)
    assert rows(b"") == [] and [r["outcome"] for r in rows(b"\x01")] == ["malformed"]
    assert [r["outcome"] for r in rows(record(1) + struct.pack("<I", 4) + bytes(80))] == ["ok", "malformed"]
    assert len(rows(b"".join(record(i) for i in range(45_000)))) == 45_000


def volume(spark, folder, letter, usns, journal_id=7, first=0, active=True, upto=None):
    buffers = [(letter, journal_id, part[0], b"".join(record(u, f"f{u}.mp4", 1000 + u) for u in part)) for part in (usns[i : i + 3] for i in range(0, len(usns), 3))]
    if buffers:
        source.write_buffers(spark.createDataFrame(buffers, "volume string, journal_id long, first_usn long, content binary"), folder)
    source.write_state(folder, letter, journal_id, first, upto if upto is not None else max(usns, default=0) + 1, active)


def run(spark, folder, seen, **options):
    stream = changes_of(source.journal_stream(spark, f"{folder}/j", **options))
    source.finished(source.started(stream, lambda batch, n: seen.extend((r["volume"], r["seq"]) for r in batch.collect()), f"{folder}/c"))
    return seen


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, seen = str(tmp_path), []
    volume(spark, f"{folder}/j", "D", list(range(8)), upto=5)
    volume(spark, f"{folder}/j", "E", [10, 20], first=10)
    assert sorted(run(spark, folder, seen)) == [*(("D", i) for i in range(5)), ("E", 10), ("E", 20)]
    source.write_state(f"{folder}/j", "D", 7, 2, 8)
    volume(spark, f"{folder}/j", "F", [3, 4])  # a volume that comes later
    assert sorted(run(spark, folder, seen, buffersPerTask=1))[:10] == [*(("D", i) for i in range(8)), ("E", 10), ("E", 20)]
    assert sorted(seen)[10:] == [("F", 3), ("F", 4)] and len(run(spark, folder, seen)) == 12
    assert source.positions(f"{folder}/c") == {"D": Cursor(7, 8), "E": Cursor(7, 21), "F": Cursor(7, 5)}
    assert source.positions(f"{folder}/none") == {}


def test_a_stream_may_begin_now(spark, tmp_path):
    folder, seen = str(tmp_path), []
    volume(spark, f"{folder}/j", "D", [1, 2, 3])
    assert run(spark, folder, seen, begin="now") == []
    volume(spark, f"{folder}/j", "D", [1, 2, 3, 4, 5])
    assert run(spark, folder, seen, begin="now") == [("D", 4), ("D", 5)]


@pytest.mark.parametrize(("change", "reason"), [({"journal_id": 8}, JournalRestart.REPLACED), ({"first": 9}, JournalRestart.LOST), ({"active": False}, JournalRestart.OFF)])
def test_a_worthless_position_ends_the_stream(spark, tmp_path, change, reason):
    folder = str(tmp_path)
    volume(spark, f"{folder}/j", "D", [1, 2, 3])
    assert len(run(spark, folder, [])) == 3
    volume(spark, f"{folder}/j", "D", [1, 2, 3, 9, 10], **change)
    with pytest.raises(JournalRestart, match=reason):
        run(spark, folder, [])


def test_a_library_follows_its_journals(spark, tmp_path):
    folder = str(tmp_path)
    store = SnapshotStore(spark, f"{folder}/library")
    files = spark.createDataFrame([("D", 1001, "old.mp4", "video", "D:", 1, 2)], "volume string, frn long, name string, kind string, dir string, size long, mtime long")
    store.publish(*library_rows(files, spark.createDataFrame([("D", 5, "D:"), ("E", 5, "E:")], "volume string, frn long, path string")))
    volume(spark, f"{folder}/j", "D", [1, 2])
    volume(spark, f"{folder}/j", "E", [4])
    for _ in range(2):
        source.finished(source.follow_journals(spark, f"{folder}/j", store, f"{folder}/c"))
    assert sorted((r["volume"], r["name"]) for r in store.load().files.collect()) == [("D", "f1.mp4"), ("D", "f2.mp4"), ("E", "f4.mp4")]
    assert store.current_epoch() == 2


class Taken:
    """Stands for a table: keeps the function that its tasks would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, function, schema):
        self.function = function
        return self

    select = groupBy = sum = lambda self, *columns: self
    first = lambda self: [0]


def test_buffers_are_released_before_the_next_are_read(spark, tmp_path):
    """A task holds one batch of buffers at a time, however many it decodes or writes."""
    import weakref

    import pyarrow as pa

    from shelfspark.sources.records import decode

    for run, columns in ((decode, {"source": ["x"]}), (lambda t: source.write_buffers(t, str(tmp_path)), {"volume": ["D"], "journal_id": [7], "first_usn": [3]})):
        taken, made = Taken(spark), []

        def batch(columns=columns, made=made):
            assert all(r() is None for r in made)
            found = pa.RecordBatch.from_pydict({**columns, "content": pa.array([record(1)], pa.binary())})
            made.append(weakref.ref(found))
            return found

        run(taken)
        assert sum(b.num_rows for b in taken.function(batch() for _ in range(3))) == 3
