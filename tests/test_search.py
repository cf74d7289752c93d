import pytest
from pyspark.sql import functions as F

from shelfspark.functions.fold import fold_text
from shelfspark.operators.search import SearchOptions, parse_kinds, query_tokens, ranked, recency_cutoff, search


def library(spark, names, dirs=None, kinds=None, mtimes=None):
    """Files in one directory, or each in its own."""
    paths = sorted(set(dirs or ["D:\\Media"]))
    d = spark.createDataFrame([(i, "D", p, fold_text(p), 0) for i, p in enumerate(paths)], "dir_id long, volume string, path string, folded string, frn long")
    rows = [(i, n, fold_text(n), paths.index(dirs[i]) if dirs else 0, kinds[i] if kinds else "video", "D", i + 1, 0, mtimes[i] if mtimes else 0) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "idx long, name string, folded string, dir_id long, kind string, volume string, frn long, size long, mtime long"), d


def names(result):
    return [r["name"] for r in result.hits.collect()]


@pytest.mark.parametrize(
    ("files", "text", "expected"),
    [
        # The whole stem before a prefix, a prefix before a word, a word before a part of one.
        (["deepharbour.mov", "old harbour.mov", "harbour lights.mov", "harbour.mov"], "harbour", ["harbour.mov", "harbour lights.mov", "old harbour.mov", "deepharbour.mov"]),
        (["unoakenly.flac", "the oak.flac"], "oak", ["the oak.flac", "unoakenly.flac"]),
        # Of equal matches the shorter name.
        (["pine seen from a hill on a long grey morning.png", "pine cone.png"], "pine", ["pine cone.png", "pine seen from a hill on a long grey morning.png"]),
        # Every word must occur.
        (["river 44 north.avi", "river 45.avi", "lake 44.avi"], "river 44", ["river 44 north.avi"]),
        (["river 44.avi"], "river 46", []),
        # Marks do not matter, on either side.
        (["Sông Hồng.mp4", "Lake.mp4"], "SONG hong", ["Sông Hồng.mp4"]),
        (["Đường về.mkv"], "duong ve", ["Đường về.mkv"]),
        (["Crème brûlée.jpg"], "creme BRULEE", ["Crème brûlée.jpg"]),
        (["a.mp4"], " .-", []),
    ],
)
def test_ranking(spark, files, text, expected):
    assert names(search(*library(spark, files), text)) == expected


def test_relaxed_keeps_the_best_partial_matches(spark):
    files = ["an.mp4", "an old lighthouse north.mp4", "an old lighthouse south.mp4", "an old.mp4"]
    result = search(*library(spark, files), "an old lighthouse keeper zzz")
    assert sorted(names(result)) == files[1:3] and result.best_matched == 3
    # Nine words of which one occurs twice; the name holds six of them, between marks of several kinds.
    name = "[Save] River_of-Glass_(of a river)--take.07_final_720p.mp4"
    result = search(*library(spark, [name, "something else.mp4"]), "River of glass: a river, take two of dawn")
    assert names(result) == [name] and len(result.tokens) == 9 and result.best_matched == 7


def test_folders_match_too(spark):
    """A word of any folder on the way counts for all that lies below it."""
    dirs = ["E:\\Ảnh", "E:\\Ảnh\\Mùa hè", "E:\\Ảnh\\Mùa hè\\Núi\\Sáng", "E:\\Nhạc"]
    files, d = library(spark, [f"{i}.png" for i in range(4)], dirs)
    for text, n in [("anh", 3), ("mua he", 2), ("nui sang", 1), ("he nui", 1), ("nhac", 1), ("nhac anh", 0)]:
        assert search(files, d, text).hits.count() == n, text


def test_name_beats_folder_and_split_tokens(spark):
    assert names(search(*library(spark, ["00123.mp4", "holiday.mp4"], ["D:\\holiday videos", "D:\\Misc"]), "holiday")) == ["holiday.mp4", "00123.mp4"]
    result = search(*library(spark, ["avatar.mkv", "avatar.mkv"], ["D:\\Phim\\2024", "D:\\Phim\\2019"]), "avatar 2024")
    assert [r["path"] for r in result.hits.collect()] == ["D:\\Phim\\2024\\avatar.mkv"]


def test_newest_ranks_inside_the_limit(spark):
    """By time the newest come first, also where fewer are wanted than match; ties go by position."""
    lib = library(spark, ["oak.png", "oak two.png", "my oak.png", "an oak tree.png", "elm.png"], mtimes=[100, 400, 300, 400, 900])
    idx = lambda **o: [r["idx"] for r in search(*lib, "oak", SearchOptions(**o)).hits.collect()]
    assert idx()[0] == 0 and sorted(idx()) == [0, 1, 2, 3]
    assert idx(order="newest") == [1, 3, 2, 0] and idx(order="newest", limit=3) == [1, 3, 2]
    assert sorted(idx(modified_after=300)) == [1, 2, 3] and idx(order="newest", modified_after=401) == []


def test_one_pass_serves_strict_and_relaxed_searches(spark):
    """Strict hits come first in a relaxed pass, so they are all that is shown, up to the limit; by time too."""
    names = ["a b c.mp4", "a b.mp4", "c a b x.mp4", "b c a.mp4", "c.mp4"]
    lib = library(spark, names, mtimes=[1, 9, 2, 3, 4])

    def found(text, **o):
        result = search(*lib, text, SearchOptions(**o))
        return [*(r["idx"] for r in result.hits.collect()), result.best_matched]

    assert sorted(found("a b c")[:-1]) == [0, 2, 3] and found("a b c")[-1] is None and len(found("a b c", limit=2)) == 3
    assert found("a b c", order="newest") == [3, 2, 0, None]
    assert found("a b zzz") == found("a b zzz")[:-1] + [2] and set(found("a b zzz")[:-1]) == {0, 1, 2, 3}
    assert found("a b zzz", order="newest") == [1, 3, 2, 0, 2] and found("zz yy xx") == [None] and found("q zzz y") == [None]


def test_no_exchange_holds_all_files(spark, tmp_path):
    """Of the folders only those with a score meet the files."""
    files, dirs = library(spark, ["x.mp4"] * 3, [f"D:\\{n}" for n in ("oak", "elm", "ash")])
    for name, table in (("files", files), ("dirs", dirs)):
        table.write.parquet(str(tmp_path / name))
    files, dirs = (spark.read.parquet(str(tmp_path / n)) for n in ("files", "dirs"))
    plan = ranked(files, dirs, ["oak"], 1, SearchOptions())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_golden_scores(spark):
    # Names, queries and their scores.
    score = lambda name, text: ranked(*library(spark, [name], ["D:\\x"]), query_tokens(text), len(query_tokens(text)), SearchOptions()).first()["score"] % 100_000
    assert score("nhạc nền.mp3", "nhac nen") == 1447
    assert score("nhạc nền hàn.MP3", "nhac nen") == 1446
    assert score("bài 10.mp3", "bai") == 848


def test_filters_on_properties(spark):
    files, dirs = library(spark, ["a1.mp4", "a2.mp4", "a3.mp4", "a4.mp3"], kinds=["video", "video", "video", "audio"])
    props = spark.createDataFrame([(0, 1920, 1080, 30_000), (1, 1080, 1920, 90_000), (2, 0, 0, 0), (3, 0, 0, 60_000)], "idx long, width int, height int, duration_ms long")
    hits = lambda **o: [r["idx"] for r in search(files, dirs, "a", SearchOptions(**o), props).hits.collect()]
    assert hits(min_height=1080) == [0, 1]
    assert hits(min_duration_ms=60_000) == [1, 3]
    assert hits(max_duration_ms=60_000) == [0, 3]
    assert hits(kinds=("audio",)) == [3]
    assert hits(kinds=parse_kinds(["nonsense"])) == [0, 1, 2, 3]


def test_ties_are_by_position_and_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("idx"), F.lit("clip test.mp4").alias("name"), F.lit("clip test.mp4").alias("folded"), F.lit(0).cast("long").alias("dir_id"), F.lit("video").alias("kind"), F.lit("D").alias("volume"), F.col("id").alias("frn"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    dirs = library(spark, ["x"])[1]
    for _ in range(2):
        assert [r["idx"] for r in search(rows.repartition(7), dirs, "clip", SearchOptions(limit=50)).hits.collect()] == list(range(50))


def test_the_plan_takes_the_top_without_a_full_sort(spark):
    plan = ranked(*library(spark, ["a.mp4"]), ["a"], 1, SearchOptions())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_cutoff():
    assert recency_cutoff(0, 100) == 0 and recency_cutoff(1, 100_000) == 13_600 and recency_cutoff(30, 10) == 0


def test_without_a_limit_every_hit_is_served(spark, monkeypatch):
    """The most that a limit may ask for does not bound a search without one."""
    from shelfspark.operators import search as module
    from shelfspark.queries import ORACLE, QUERIES

    from .test_queries import compare

    monkeypatch.setattr(module, "MOST_LIMIT", 5)
    compare(spark, QUERIES["search_presets"], ORACLE["search_presets"])
