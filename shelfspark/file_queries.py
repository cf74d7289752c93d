"""Queries over files that tasks write from the test tables below the shared folder: headers of media files, byte ranges, trees; with DuckDB SQL."""

from __future__ import annotations

import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.fold import fold_native
from shelfspark.plans.engine import Engine
from shelfspark.queries import _read, query
from shelfspark.session import ship_package
from shelfspark.sources.contents import read_ranges
from shelfspark.sources.properties import located, read_media_properties
from shelfspark.sources.snapshot import PropertyStore, SnapshotStore, cut, shared_path
from shelfspark.sources.walk import tree_counts, walk_tree

# ---- media properties ----------------------------------------------------------------------


def _box(name: bytes, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return struct.pack(">I", 8 + len(content)) + name + content


def _media_header(kind: int, width: int, height: int, ms: int) -> bytes:
    """The start of a file of one of eight formats."""
    if kind == 0:
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height)
    if kind == 1:
        return b"GIF89a" + struct.pack("<HH", width, height)
    if kind == 2:
        return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, -height)
    if kind == 3:
        return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, height, width)
    if kind == 4:
        return b"RIFF" + bytes(4) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    if kind == 5:
        movie = _box(b"mvhd", bytes(12), struct.pack(">II", 1000, ms), bytes(80))
        tracks = [_box(b"trak", _box(b"tkhd", bytes(76), struct.pack(">II", w << 16, h << 16))) for w, h in ((0, 0), (width, height))]
        return _box(b"ftyp", b"isom") + _box(b"mdat", bytes(5000)) + _box(b"moov", movie, *tracks)
    if kind == 6:
        avih = b"avih" + struct.pack("<I", 56) + struct.pack("<IIIII", 40_000, 0, 0, 0, ms // 40) + bytes(12) + struct.pack("<II", width, height) + bytes(16)
        return b"RIFF" + bytes(4) + b"AVI LIST" + struct.pack("<I", 4 + len(avih)) + b"hdrl" + avih
    return b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", ms * 8)


def _written(rows: DataFrame, folder: str, content) -> DataFrame:
    """``rows`` (file, ...) with path and size, after each has been written as ``content(row)``; nothing is written where that is None."""
    ship_package(rows.sparkSession)

    def part(batches):
        for batch in batches:
            paths, sizes = [], []
            for row in batch.to_pylist():
                system, name = located(f"{folder}/{row['file']}")
                data = content(row)
                if data is not None:
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(name) as out:
                        out.write(data)
                paths.append(f"{folder}/{row['file']}")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, "path", "size"])

    schema = rows.withColumns({"path": F.lit(None).cast("string"), "size": F.lit(None).cast("long")}).schema
    return cut(rows.mapInArrow(part, schema))


def _media_files(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Documents as media files of eight formats below a folder, without those of every fiftieth."""

    def content(row):
        n = row["doc_id"]
        return None if n % 50 == 49 else _media_header(n % 8, 16 + n % 4000, 9 + n % 2200, n * 10 % 7_200_000) + bytes(100 + n % 700)

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id") % 100, F.lit("/"), "doc_id", F.lit(".bin")).alias("file"))
    return _written(docs, folder or f"{shared_path(spark)}/media", content)


_PROPS = """SELECT doc_id AS idx, CASE WHEN there AND k < 7 THEN CAST(16 + doc_id % 4000 AS INT) ELSE 0 END AS width, CASE WHEN there AND k < 7 THEN CAST(9 + doc_id % 2200 AS INT) ELSE 0 END AS height,
CASE WHEN there AND k IN (5, 7) THEN ms WHEN there AND k = 6 THEN ms // 40 * 40 ELSE 0 END AS duration_ms FROM (SELECT doc_id, doc_id % 8 AS k, doc_id % 50 <> 49 AS there, doc_id * 10 % 7200000 AS ms FROM documents)"""


@query("media_props", _PROPS)
def media_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, height and length from the headers of files; zeros for those that are not there."""
    files = _media_files(spark, sf_dir).withColumn("mtime", F.lit(1).cast("long"))
    found = read_media_properties(files)
    return found.select(F.regexp_extract("path_key", r"(\d+)\.bin$", 1).cast("long").alias("idx"), "width", "height", "duration_ms")


@query("read_queue_batches", f"SELECT idx, CASE WHEN near THEN width ELSE 0 END AS width, CASE WHEN near THEN height ELSE 0 END AS height, CASE WHEN near THEN duration_ms ELSE 0 END AS duration_ms, near AS cached FROM (SELECT *, idx % 10 <> 0 AS near FROM ({_PROPS}))")
def read_queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library's queue of unread files in rounds of batches of 500, stopped after the first and taken up again; network volumes are left out."""
    root = shared_path(spark)
    media = _media_files(spark, sf_dir, f"{root}/media")
    letter = F.when(F.col("doc_id") % 10 == 0, "N").otherwise("D")
    kind = F.when(F.col("doc_id") % 8 < 5, "image").when(F.col("doc_id") % 8 < 7, "video").otherwise("audio")
    name = F.concat("doc_id", F.lit(".bin"))
    files = media.select(F.col("doc_id").alias("idx"), name.alias("name"), name.alias("folded"), (F.col("doc_id") % 10 == 0).cast("long").alias("dir_id"), kind.alias("kind"), letter.alias("volume"), F.col("doc_id").alias("frn"), "size", F.lit(1).cast("long").alias("mtime"))
    dirs = spark.createDataFrame([(0, "D", "D:"), (1, "N", "N:")], "dir_id long, volume string, path string").select("*", fold_native(F.col("path")).alias("folded"), F.lit(5).cast("long").alias("frn"))
    SnapshotStore(spark, f"{root}/library").publish(files, dirs)
    engine, store, asked = Engine(spark, f"{root}/library"), PropertyStore(spark, f"{root}/props"), []
    network = spark.createDataFrame([("N",)], "letter string")
    at = F.concat(F.lit(f"{root}/media/"), F.col("idx") % 100, F.lit("/"), "name")  # where a file of the library is

    def read(part: DataFrame) -> DataFrame:
        asked.append(1)
        return read_media_properties(part.withColumn("at", at), "at")

    engine.read_properties(store, network, read, 500, stop=lambda: len(asked) > 0)
    engine.read_properties(store, network, read, 500)
    return engine.props.select("idx", "width", "height", "duration_ms", "cached")


# ---- byte ranges ---------------------------------------------------------------------------

_HEADERS = ["bytes=10-99", "bytes=-50", "bytes=100-", "bytes=5000000-", "bytes=7-3", "bytes=0-0", "pages=1-2"]


@query(
    "file_ranges",
    """WITH f AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS size, doc_id % 7 AS k FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, CASE k WHEN 0 THEN 10 WHEN 1 THEN greatest(size - 50, 0) WHEN 2 THEN 100 WHEN 5 THEN 0 END AS a, CASE k WHEN 0 THEN least(99, size - 1) WHEN 1 THEN size - 1 WHEN 2 THEN size - 1 WHEN 5 THEN 0 END AS b FROM f),
s AS (SELECT *, a < size AND a <= b AS ok FROM r)
SELECT doc_id, size, CASE WHEN ok THEN a END AS first, CASE WHEN ok THEN least(b, a + 4095) END AS last, CASE WHEN ok THEN md5(substr(x, 2 * a + 1, 2 * (least(b, a + 4095) - a + 1))) END AS digest FROM s""",
)
def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of files by range headers, capped to 4 KB an answer."""
    docs = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.col("doc_id") % 100, F.lit("/"), "doc_id").alias("file"), "text")
    files = _written(docs, f"{shared_path(spark)}/texts", lambda row: row["text"].encode()).drop("text", "size")
    header = F.get(F.array(*map(F.lit, _HEADERS)), (F.col("doc_id") % 7).cast("int"))
    found = read_ranges(files.withColumn("header", header), cap=4096)
    return found.select("doc_id", "size", "first", "last", F.md5(F.hex("content").cast("binary")).alias("digest"))


# ---- trees ---------------------------------------------------------------------------------

_TREE = """WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS l, CASE source WHEN 'src3' THEN 'AppData' WHEN 'src4' THEN '.cache' ELSE coalesce(source, 'none') END AS s FROM documents),
k AS (SELECT *, '/' || l || '/' || s AS f FROM d WHERE s NOT IN ('AppData', '.cache')),
t AS (SELECT '' AS path, 'listed' AS outcome, 0 AS depth UNION SELECT '/' || l, 'listed', 1 FROM d UNION SELECT '/' || l || '/' || s, CASE WHEN s IN ('AppData', '.cache') THEN 'excluded' ELSE 'listed' END, 2 FROM d
UNION SELECT f || '/Deep', 'listed', 3 FROM k WHERE doc_id % 7 = 0 UNION SELECT f || '/Deep/deeper', 'too_deep', 4 FROM k WHERE doc_id % 7 = 0
UNION SELECT f || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.mp4' END, 'file', 3 FROM k WHERE doc_id % 7 <> 0 UNION SELECT f || '/link' || doc_id, 'link', 3 FROM k WHERE doc_id % 25 = 1 AND doc_id % 7 <> 0)"""


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Documents as files below folders of language and source, two of which are excluded, some with links beside them, some too deep."""
    key = F.col("doc_id")
    source = F.when(F.col("source") == "src3", "AppData").when(F.col("source") == "src4", ".cache").otherwise(F.coalesce("source", F.lit("none")))
    file = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), source, F.when(key % 7 == 0, "/Deep/deeper/").otherwise("/"), key, F.when(key % 3 == 0, ".txt").otherwise(".mp4"))
    folder = f"{shared_path(spark)}/tree"

    def content(row):
        if row["doc_id"] % 25 == 1 and row["doc_id"] % 7:
            _, path = located(f"{folder}/{row['file']}")
            link = f"{path.rsplit('/', 1)[0]}/link{row['doc_id']}"
            os.makedirs(path.rsplit("/", 1)[0], exist_ok=True)
            if not os.path.lexists(link):
                os.symlink(path.rsplit("/", 3)[0], link)
        return b"x"

    _written(_read(spark, sf_dir, "documents").select(key, file.alias("file")), folder, content)
    return walk_tree(spark, folder, max_depth=4), folder


@query("walk_tree", _TREE + " SELECT path, outcome, CAST(depth AS INT) AS depth, CASE WHEN outcome = 'file' AND path LIKE '%.mp4' THEN 'video' END AS kind FROM t")
def walked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a walk sees, with its outcome."""
    found, folder = _walked(spark, sf_dir)
    return found.select(F.expr(f"substring(path, {len(folder) + 1})").alias("path"), "outcome", "depth", "kind")


@query(
    "walk_counts",
    _TREE + """ SELECT count_if(outcome = 'listed') AS directories_seen, CAST(0 AS BIGINT) AS orphaned, count_if(outcome = 'excluded') AS excluded, count_if(outcome = 'link') AS links, count_if(outcome = 'too_deep') AS too_deep,
count_if(outcome = 'file') AS files_seen, count_if(outcome = 'file' AND path LIKE '%.mp4') AS media_files_in, count_if(outcome = 'file' AND path LIKE '%.mp4') AS kept FROM t""",
)
def walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a walk."""
    return tree_counts(_walked(spark, sf_dir)[0])
