import pytest
from pyspark.sql import functions as F

from shelfspark.functions import media
from shelfspark.functions.fold import fold, fold_native, fold_text, tokenize, tokenize_text

FOLDS = [
    ("Tiếng Việt Đà Nẵng", "tieng viet da nang"), ("Đường Đi Đẹp", "duong di dep"), ("ơ ư Ơ Ư", "o u o u"),
    ("aăâbcdđeêghiklmnoôơpqrstuưvxy", "aaabcddeeghiklmnooopqrstuuvxy"), ("Phim Tài Liệu - Vịnh Hạ Long (2024).mp4", "phim tai lieu - vinh ha long (2024).mp4"),
    ("日本語.mp4", "日本語.mp4"), ("한국어", "한국어"), ("Straße", "strasse"), ("Bjørn", "bjorn"), ("Łódź", "lodz"), ("", ""), ("\u0301\u0323", ""),
    ("ΣΑΣ", "σασ"), ("が", "が"), ("Þing", "thing"), ("ÀÉÎÕÜ ĄĘŁ Ǆ İ", "aeiou ael ǆ i"),
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(("text", "expected"), FOLDS)
def test_fold_text(text, expected):
    assert fold_text(text) == expected
    assert fold_text(expected) == expected


def test_fold_column_equals_fold_text(spark):
    rows = spark.createDataFrame([(t,) for t, _ in FOLDS] + [(None,)], "t string")
    got = [r[0] for r in rows.select(fold(F.col("t"))).collect()]
    assert got == [e for _, e in FOLDS] + [None]


def test_every_latin_character_folds_natively(spark):
    chars = [chr(c) for c in [*range(1, 0x250), *range(0x1E00, 0x1F00)]]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in chars], "t string").select(fold_native(F.col("t"))).collect()]
    assert got == [fold_text(c) for c in chars]


def test_tokenize_keeps_order_and_repeats(spark):
    text = fold_text("A river: a slow_river of blue-green 日本語 1987!")
    expected = ["a", "river", "a", "slow", "river", "of", "blue", "green", "日本語", "1987"]
    assert tokenize_text(text) == expected
    assert spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    ("name", "kind"),
    [("a.MKV", "video"), ("a.jpeg", "image"), ("a.b.flac", "audio"), ("a.exe", None), ("a.ts", None), ("a", None), ("a.", None), ("mp4", None), ("a.rmvb", "video"), ("a.é", None), ("x.toolong", None), (None, None)],
)
def test_media_kind(spark, name, kind):
    assert spark.createDataFrame([(name,)], "n string").select(media.media_kind(F.col("n"))).first()[0] == kind


@pytest.mark.parametrize(
    ("header", "expected"),
    [("bytes=0-99", (0, 99)), ("bytes=500-", (500, 999)), ("bytes=-100", (900, 999)), ("bytes=0-5000", (0, 999)), ("bytes=1000-", None), ("bytes=-", None), ("bytes=5-4", None), ("chunks=0-1", None), ("bytes=0-1,3-4", None), ("bytes=-0", None), ("bytes=-5000", (0, 999))],
)
def test_byte_range(spark, header, expected):
    got = one(spark, media.byte_range(F.lit(header), F.lit(1000)))
    assert (tuple(got) if got else None) == expected


def test_byte_range_is_capped(spark):
    assert tuple(one(spark, media.byte_range(F.lit("bytes=10-"), F.lit(1 << 40)))) == (10, 10 + (8 << 20) - 1)


@pytest.mark.parametrize(("ticks", "text"), [(125911584000000000, "2000-01-01 00h"), (134320464000000000, "2026-08-24 12h"), (133536384000000000, "2024-02-29 00h"), (0, "?")])
def test_filetime(spark, ticks, text):
    assert one(spark, media.filetime_hour(F.lit(ticks))) == text


def test_filetime_to_unix(spark):
    assert one(spark, media.filetime_to_unix(F.lit(116444736000000000 + 25_000_000))) == 2
    assert one(spark, media.filetime_to_unix(F.lit(5))) == 0


@pytest.mark.parametrize(("n", "label"), [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB"), (5 << 40, "5.00 TB")])
def test_human_bytes(spark, n, label):
    assert one(spark, media.human_bytes(F.lit(n))) == label


@pytest.mark.parametrize(("ms", "label"), [(0, ""), (499, "0:00"), (500, "0:01"), (83_000, "1:23"), (3_723_000, "1:02:03")])
def test_human_duration(spark, ms, label):
    assert one(spark, media.human_duration(F.lit(ms))) == label


@pytest.mark.parametrize(("w", "h", "label"), [(1080, 1920, "1080p"), (3840, 2160, "4K"), (640, 360, "640×360"), (0, 100, ""), (2560, 1440, "1440p")])
def test_resolution(spark, w, h, label):
    assert one(spark, media.resolution_label(F.lit(w), F.lit(h))) == label


def test_paths(spark):
    p = lambda text: F.lit(text)
    assert one(spark, media.excluded_path(p("C:\\Users\\me\\.gradle\\x")))
    assert one(spark, media.excluded_path(p("D:\\$RECYCLE.BIN")))
    assert not one(spark, media.excluded_path(p("D:\\build\\bin")))
    assert one(spark, media.is_under(p("d:\\phim\\a"), p("D:\\Phim")))
    assert not one(spark, media.is_under(p("D:\\Phim2"), p("D:\\Phim")))
    assert one(spark, media.strip_extended_prefix(p("\\\\?\\C:\\a"))) == "C:\\a"
    assert one(spark, media.lookup_frn(F.lit(0x0005000000000005))) == 5
    assert one(spark, media.top_root(p("D:\\a\\b"))) == "D:\\a"
    assert tuple(one(spark, media.entry_handle(p("12_34")))) == (12, 34)
    assert one(spark, media.entry_handle(p("12_x"))) is None
    assert one(spark, media.thumbnail_size(F.lit(9999))) == 512


def test_fingerprints(spark):
    big = bytearray(b"a" * 300_000)
    other = bytearray(big)
    other[150_000] = 98
    rows = spark.createDataFrame([(bytes(big), 300_000), (bytes(other), 300_000)], "content binary, size long")
    sample = {r[0] for r in rows.select(media.sample_fingerprint(F.col("content"), F.col("size"))).collect()}
    whole = {r[0] for r in rows.select(media.full_digest(F.col("content"))).collect()}
    assert len(sample) == 1 and len(whole) == 2
