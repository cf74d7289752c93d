"""Queries that apply the engine's operators to the test tables, and DuckDB SQL for the same rows.

The tables hold no media library, so each query first shapes a table like one: part
names as file names, brands and types as folders, events as journal records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import media
from shelfspark.functions.fold import fold, fold_native, tokenize
from shelfspark.operators import audit, changes, dupes, enrich, search, tree
from shelfspark.sources.snapshot import carry_over, cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with SQL for the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- ranked search -------------------------------------------------------------------------


def part_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as files named by p_name in folders of brand and type, with sizes as properties."""
    part = _read(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit("/"), "p_type")
    names = part.select(path.alias("path")).distinct()
    dirs = names.select(F.xxhash64("path").alias("dir_id"), F.lit("D").alias("volume"), "path", fold_native(F.col("path")).alias("folded"), F.lit(0).cast("long").alias("frn"))
    kind = F.element_at(F.array(*map(F.lit, media.KINDS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), fold_native(F.col("p_name")).alias("folded"), F.xxhash64(path).alias("dir_id"), kind.alias("kind"), F.lit("D").alias("volume"), F.col("p_partkey").alias("frn"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") * 86_400).alias("mtime"))
    props = part.select(F.col("p_partkey").alias("idx"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 30).alias("height"), F.floor("p_retailprice").cast("long").alias("duration_ms"))
    return files, dirs, props


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("idx", "name", "matched", F.col("score").cast("long").alias("score"), "key")


_BOUNDARY = search.BOUNDARY.replace("'", "''")


def _score_sql(tokens: list[str], source: str, where: str = "true") -> str:
    """SQL for rows with matched and score, from a relation of idx, name, f, d, mtime."""
    name = lambda t: f"CASE WHEN strpos(f, '{t}') = 0 THEN NULL WHEN strpos(f, '{t}') = 1 THEN CASE WHEN '{t}' = f OR '{t}' = regexp_extract(f, '^(.*)\\.[^.]*$', 1) THEN 1000 ELSE 800 END WHEN strpos('{_BOUNDARY}', substr(f, strpos(f, '{t}') - 1, 1)) > 0 THEN 600 ELSE 400 END"
    dirs = lambda t: f"CASE WHEN strpos(d, '{t}') = 0 THEN NULL WHEN strpos(d, '{t}') = 1 OR strpos('{_BOUNDARY}', substr(d, strpos(d, '{t}') - 1, 1)) > 0 THEN 250 ELSE 200 END"
    scores = ", ".join(f"coalesce({name(t)}, {dirs(t)}) AS s{i}" for i, t in enumerate(tokens))
    matched = " + ".join(f"(s{i} IS NOT NULL)::INT" for i in range(len(tokens)))
    points = " + ".join(f"coalesce(s{i}, 0)" for i in range(len(tokens)))
    return f"""s AS (SELECT idx, name, f, mtime, {scores} FROM ({source}) WHERE {where}),
m AS (SELECT idx, name, mtime, CAST({matched} AS INT) AS matched, CAST(({matched}) * 100000 + {points} + greatest(50 - strlen(f) // 4, 0) AS BIGINT) AS score FROM s)"""


_PARTS = "SELECT p_partkey AS idx, p_name AS name, lower(p_name) AS f, lower(p_brand || '/' || p_type) AS d, p_partkey * 86400 AS mtime, p_size, p_retailprice FROM part"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over part names and folders."""
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.ranked(files, dirs, search.query_tokens("Ring, ECONOMY"), 2, search.SearchOptions(limit=20)))


query("search_strict", f"WITH {_score_sql(['ring', 'economy'], _PARTS)} SELECT idx, name, matched, score, score AS key FROM m WHERE matched = 2 ORDER BY score DESC, idx LIMIT 20")(flagship)


@query("search_relaxed", f"WITH {_score_sql(['red', 'widget', 'zzz'], _PARTS)}, k AS (SELECT * FROM m WHERE matched >= 2 ORDER BY score DESC, idx LIMIT 50) SELECT idx, name, matched, score, score AS key FROM k WHERE matched = (SELECT max(matched) FROM k)")
def search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.search(files, dirs, "red widget zzz", search.SearchOptions(limit=50)).hits)


@query("search_newest", f"WITH {_score_sql(['bolt'], _PARTS, 'mtime >= 8640000')} SELECT idx, name, matched, score, mtime AS key FROM m WHERE matched = 1 ORDER BY mtime DESC, idx LIMIT 100")
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.search(files, dirs, "bolt", search.SearchOptions(limit=100, order="newest", modified_after=8_640_000)).hits)


@query(
    "search_filters",
    f"""WITH {_score_sql(["red"], _PARTS, "p_partkey % 3 IN (0, 1) AND p_size * 30 >= 720 AND floor(p_retailprice) >= 901 AND floor(p_retailprice) <= 1500".replace("p_partkey", "idx"))}
SELECT idx, name, matched, score, score AS key FROM m WHERE matched = 1 ORDER BY score DESC, idx LIMIT 200""",
)
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dirs, props = part_library(spark, sf_dir)
    options = search.SearchOptions(kinds=("video", "image"), min_height=720, min_duration_ms=901, max_duration_ms=1500, limit=200)
    return _hits(search.search(files, dirs, "red", options, props).hits)


@query("search_page", f"WITH {_score_sql(['gear'], _PARTS)} SELECT idx, name, matched, score, score AS key FROM m WHERE matched = 1 ORDER BY score DESC, idx LIMIT 46 OFFSET 7")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dirs, _ = part_library(spark, sf_dir)
    return _hits(search.page(search.search(files, dirs, "gear", search.SearchOptions(limit=500)).hits, 10, 40))


@query("file_times", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS unix, strftime(ts, '%Y-%m-%d %Hh') AS hour FROM events")
def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + media.EPOCH_TICKS
    return _read(spark, sf_dir, "events").select("event_id", media.filetime_to_unix(ticks).alias("unix"), media.filetime_hour(ticks).alias("hour"))


@query("describe_changes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'D: gone' ELSE 'D: present ' || CASE WHEN event_type = 'view' THEN 'directory ' ELSE 'file ' END || event_type END AS what FROM events")
def describe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    what = media.describe_change(F.when(kind == "error", "gone").otherwise("present"), F.lit("D"), kind, kind == "view")
    return _read(spark, sf_dir, "events").select("event_id", what.alias("what"))


# ---- functions -----------------------------------------------------------------------------


@query("fold_text", "SELECT doc_id, md5(lower(strip_accents(replace(text, 'ß', 'ss')))) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query("tokenize", r"SELECT conv_id, turn, len(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(t, '[\p{L}\p{N}]+'), ' ')) AS tokens FROM (SELECT conv_id, turn, lower(strip_accents(replace(text, 'ß', 'ss'))) AS t FROM conversations)")
def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize(fold(F.col("text")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens"))


_EXTENSIONS = ["MP4", "jpeg", "flac", "ts", "zip", "m2ts", "", "toolong", "heic", "opus"]


@query(
    "classify_names",
    f"""WITH n AS (SELECT p_partkey, p_name || CASE WHEN e = '' THEN '' ELSE '.' || e END AS name FROM (SELECT *, (['{"','".join(_EXTENSIONS)}'])[p_partkey % 10 + 1] AS e FROM part)),
x AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext FROM n)
SELECT p_partkey, name, ext, CASE WHEN ext IN ('mp4', 'm2ts') THEN 'video' WHEN ext IN ('jpeg', 'heic') THEN 'image' WHEN ext IN ('flac', 'opus') THEN 'audio' END AS kind,
CASE ext WHEN 'mp4' THEN 'video/mp4' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'flac' THEN 'audio/flac' WHEN 'opus' THEN 'audio/ogg' ELSE 'application/octet-stream' END AS content_type FROM x""",
)
def classify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("name"))
    name = F.col("name")
    return rows.select("p_partkey", "name", media.report_extension(name).alias("ext"), media.media_kind(name).alias("kind"), media.content_type(name).alias("content_type"))


@query("ext_report", "SELECT ext, count(*) AS n FROM (SELECT CASE WHEN contains(url, '.') THEN lower(string_split(url, '.')[-1]) ELSE '' END AS ext FROM pages) GROUP BY ext ORDER BY n DESC, ext LIMIT 12")
def ext_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deletions_by_extension(_read(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.lit(False).alias("is_dir")))


@query(
    "path_functions",
    r"""WITH p AS (SELECT s_suppkey, 'd:\' || (['Phim', '.cache', 'Windows', 'Nhac'])[s_nationkey % 4 + 1] || '\' || s_name || '\x' AS path FROM supplier)
SELECT s_suppkey, path, upper(substr(path, 1, 1)) AS volume, CAST(3 AS INT) AS depth, 'd:\' || string_split(path, '\')[2] AS root,
string_split(path, '\')[2] IN ('.cache', 'Windows') AS excluded, starts_with(lower(path), 'd:\phim\') AS below, 'E:\Movies' || substr(path, length('d:\Phim') + 1) AS moved FROM p""",
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ["Phim", ".cache", "Windows", "Nhac"])), (F.col("s_nationkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("d:\\"), folder, F.lit("\\"), "s_name", F.lit("\\x")).alias("path"))
    p = F.col("path")
    return rows.select("s_suppkey", "path", media.volume_of(p).alias("volume"), media.depth(p).alias("depth"), media.top_root(p).alias("root"), media.excluded_path(p).alias("excluded"), media.is_under(p, F.lit("D:\\PHIM")).alias("below"), media.rewrite_prefix(p, F.lit("d:\\Phim"), F.lit("E:\\Movies")).alias("moved"))


@query(
    "format_bytes",
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', round(n / 1048576.0::DOUBLE, 1)) || ' MB'
WHEN n < 1099511627776 THEN printf('%.1f', round(n / 1073741824.0::DOUBLE, 1)) || ' GB' ELSE printf('%.2f', round(n / 1099511627776.0::DOUBLE, 2)) || ' TB' END AS label
FROM (SELECT o_orderkey, (o_orderkey * 7 + 3) * CAST(power(10, o_orderkey % 9) AS BIGINT) AS n FROM orders)""",
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * 7 + 3) * F.pow(F.lit(10), F.col("o_orderkey") % 9).cast("long")
    return _read(spark, sf_dir, "orders").select("o_orderkey", media.human_bytes(n).alias("label"))


@query(
    "format_duration",
    """SELECT o_orderkey, CASE WHEN ms = 0 THEN '' WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS label
FROM (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS t FROM (SELECT o_orderkey, o_orderkey * o_orderkey // 7 AS ms FROM orders))""",
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("o_orderkey") * F.col("o_orderkey") / 7).cast("long")
    return _read(spark, sf_dir, "orders").select("o_orderkey", media.human_duration(ms).alias("label"))


@query(
    "resolution_label",
    """SELECT p_partkey, CASE WHEN w = 0 OR h = 0 THEN '' WHEN least(w, h) >= 2160 THEN '4K' WHEN least(w, h) >= 1440 THEN '1440p' WHEN least(w, h) >= 1080 THEN '1080p'
WHEN least(w, h) >= 720 THEN '720p' WHEN least(w, h) >= 480 THEN '480p' ELSE w || '×' || h END AS label FROM (SELECT p_partkey, p_size * 70 AS w, p_partkey % 60 * 45 AS h FROM part)""",
)
def resolution_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", media.resolution_label(F.col("p_size") * 70, F.col("p_partkey") % 60 * 45).alias("label"))


@query(
    "range_slice",
    """WITH h AS (SELECT doc_id, text, length(text) AS size, CASE doc_id % 4 WHEN 0 THEN 'bytes=10-49' WHEN 1 THEN 'bytes=20-' WHEN 2 THEN 'bytes=-30' ELSE 'items=0-1' END AS header FROM documents),
r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN greatest(size - 30, 0) END AS a, CASE doc_id % 4 WHEN 0 THEN least(49, size - 1) WHEN 1 THEN size - 1 WHEN 2 THEN size - 1 END AS b FROM h)
SELECT doc_id, header, CASE WHEN a < size THEN CAST(a AS BIGINT) END AS first, CASE WHEN a < size THEN CAST(least(b, a + 8388607) AS BIGINT) END AS last,
CASE WHEN a < size THEN md5(substr(text, a + 1, least(b, a + 8388607) - a + 1)) END AS slice FROM r""",
)
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.element_at(F.array(*map(F.lit, ["bytes=10-49", "bytes=20-", "bytes=-30", "items=0-1"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", header.alias("header"))
    rows = rows.withColumn("r", media.byte_range(F.col("header"), F.length("text")))
    return rows.select("doc_id", "header", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"), F.md5(media.slice_bytes(F.col("text"), F.col("r"))).alias("slice"))


# ---- duplicates ----------------------------------------------------------------------------


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their characters."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.length("text").cast("long").alias("size"), F.col("text").alias("content"))


_FP = "sha256(CASE WHEN length(text) <= 128 THEN text ELSE substr(text, 1, 64) || right(text, 64) END)"


@query("dupes_size", "SELECT doc_id AS idx, CAST(length(text) AS BIGINT) AS size FROM documents QUALIFY length(text) >= 64 AND count(*) OVER (PARTITION BY length(text)) > 1")
def dupes_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.same_size(_contents(spark, sf_dir), 64).select("idx", "size")


@query("dupes_fp", f"SELECT size, fp, count(*) AS copies, min(doc_id) AS first, size * (count(*) - 1) AS wasted FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS size, {_FP} AS fp FROM documents WHERE length(text) >= 64) GROUP BY size, fp HAVING count(*) > 1")
def dupes_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.duplicate_groups(dupes.fingerprinted(dupes.same_size(_contents(spark, sf_dir), 64), edge=64))


@query("dupes_full", "SELECT doc_id AS idx, size, wasted, first, doc_id = first AS keep FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS size, min(doc_id) OVER w AS first, count(*) OVER w AS n, length(text) * (count(*) OVER w - 1) AS wasted FROM documents WHERE length(text) >= 64 WINDOW w AS (PARTITION BY length(text), sha256(text))) WHERE n > 1 QUALIFY dense_rank() OVER (ORDER BY wasted DESC, first) <= 500")
def dupes_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = cut(dupes.fingerprinted(dupes.same_size(_contents(spark, sf_dir), 64), whole=True))
    return dupes.duplicate_members(printed, dupes.duplicate_groups(printed)).select("idx", "size", "wasted", "first", "keep")


@query("dupes_totals", f"SELECT count(*) AS groups, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted FROM (SELECT length(text) AS size, count(*) AS n FROM documents WHERE length(text) >= 64 GROUP BY length(text), {_FP} HAVING count(*) > 1)")
def dupes_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.totals(dupes_fp(spark, sf_dir))


# ---- trees ---------------------------------------------------------------------------------


def _tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a binary tree of folders; some parents are missing, some folders excluded, two point at each other; each holds a file."""
    key = F.col("p_partkey")
    name = F.when(key % 31 == 7, "AppData").when(key % 41 == 9, ".git").otherwise(F.concat(F.lit("n"), key))
    parent = F.when(key == 1, F.lit(5)).when(key % 53 == 50, F.lit(9)).when(key == 20, 1021).when(key == 21, 1020).otherwise(F.floor(key / 2) + 1000)
    part = _read(spark, sf_dir, "part").where("p_partkey > 0")
    dirs = part.select((key + 1000).alias("frn"), parent.cast("long").alias("parent_frn"), name.alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("kind"))
    files = part.select((key + 10_000_000).alias("frn"), (key + 1000).alias("parent_frn"), F.concat("p_name", F.lit(".mp4")).alias("name"), F.lit(False).alias("is_dir"), F.lit("video").alias("kind"))
    return dirs.unionByName(files)


_TREE = r"""WITH RECURSIVE d AS (SELECT p_partkey + 1000 AS frn, CASE WHEN p_partkey = 1 THEN 5 WHEN p_partkey % 53 = 50 THEN 9 WHEN p_partkey = 20 THEN 1021 WHEN p_partkey = 21 THEN 1020 ELSE p_partkey // 2 + 1000 END AS parent,
CASE WHEN p_partkey % 31 = 7 THEN 'AppData' WHEN p_partkey % 41 = 9 THEN '.git' ELSE 'n' || p_partkey END AS name FROM part WHERE p_partkey > 0),
r AS (SELECT frn, 'C:\' || name AS path, name IN ('AppData', '.git') AS bad, CAST(1 AS BIGINT) AS depth FROM d WHERE parent = 5
  UNION ALL SELECT d.frn, path || '\' || name, bad OR name IN ('AppData', '.git'), depth + 1 FROM d JOIN r ON d.parent = r.frn),
o AS (SELECT frn FROM d WHERE parent = 9 UNION ALL SELECT d.frn FROM d JOIN o ON d.parent = o.frn),
t AS (SELECT d.frn, CASE WHEN o.frn IS NOT NULL THEN 'orphaned' WHEN r.frn IS NULL THEN 'cycle' WHEN bad THEN 'excluded' ELSE 'ok' END AS outcome, path FROM d LEFT JOIN r ON d.frn = r.frn LEFT JOIN o ON d.frn = o.frn)"""


@query("tree_paths", _TREE + " SELECT frn, outcome, CASE WHEN outcome = 'ok' THEN path END AS path FROM t UNION ALL SELECT 5, 'ok', 'C:'")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.resolve_directories(_tree_records(spark, sf_dir), "C").select("frn", "outcome", "path")


@query("tree_files", _TREE + r" SELECT p_partkey + 10000000 AS frn, outcome, CASE WHEN outcome = 'ok' THEN path || '\' || p_name || '.mp4' END AS path FROM part JOIN t ON t.frn = p_partkey + 1000")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _tree_records(spark, sf_dir)
    return tree.resolve_files(records, tree.resolve_directories(records, "C")).select("frn", "outcome", "path")


@query("tree_outcomes", _TREE + " SELECT outcome, count(*) AS files FROM part JOIN t ON t.frn = p_partkey + 1000 GROUP BY outcome")
def tree_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _tree_records(spark, sf_dir)
    return tree.outcome_counts(tree.resolve_files(records, tree.resolve_directories(records, "C")))


@query("subtree_prefix", _TREE + r" SELECT frn, path FROM t WHERE outcome = 'ok' AND starts_with(lower(path) || '\', 'c:\n1\n3\')")
def subtree_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = tree_paths(spark, sf_dir).where("outcome = 'ok'").select(F.lit("C").alias("volume"), "frn", "path")
    top = spark.range(1).select(F.lit("C").alias("volume"), F.lit("C:\\N1\\n3").alias("top"))
    return dirs.join(changes.below(dirs, top), ["volume", "path"]).select("frn", "path")


# ---- changes -------------------------------------------------------------------------------


@query("last_wins", "SELECT user_id AS frn, arg_max(event_type, event_id) AS name, max(event_id) AS seq FROM events WHERE user_id <> 0 GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("present").alias("op"), F.lit("D").alias("volume"), F.col("user_id").alias("frn"), F.lit(5).cast("long").alias("parent_frn"), F.col("event_type").alias("name"), F.lit(False).alias("is_dir"))
    return changes.latest_changes(rows).select("frn", "name", "seq")


def _merge(spark: SparkSession, sf_dir: str) -> changes.Merge:
    """Parts in folders by brand; a fifth is deleted, a fifth renamed, a fifth moved; one brand's folder renamed, one deleted, one created."""
    part = _read(spark, sf_dir, "part")
    brand = F.split("p_brand", "#")[1].cast("long")
    files = part.select(F.lit("D").alias("volume"), (F.col("p_partkey") + 1_000_000).alias("frn"), F.concat("p_name", F.lit(".mkv")).alias("name"), F.lit("video").alias("kind"), F.concat(F.lit("D:\\"), "p_brand").alias("dir"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("mtime"))
    roots = spark.range(1).select(F.lit("D").alias("volume"), F.lit(5).cast("long").alias("frn"), F.lit("D:").alias("path"))
    dirs = part.select("p_brand", brand.alias("b")).distinct().select(F.lit("D").alias("volume"), (F.col("b") + 100).alias("frn"), F.concat(F.lit("D:\\"), "p_brand").alias("path"))
    case = F.col("p_partkey") % 5
    moves = part.where(case < 3).select(
        F.col("p_partkey").alias("seq"), F.when(case == 0, "gone").otherwise("present").alias("op"), F.lit("D").alias("volume"), (F.col("p_partkey") + 1_000_000).alias("frn"),
        F.when(case == 2, 200).otherwise(brand + 100).cast("long").alias("parent_frn"), F.concat(F.lit("new "), "p_name", F.lit(".mkv")).alias("name"), F.lit(False).alias("is_dir"),
    )
    folders = spark.createDataFrame([(-3, "present", "D", 103, 5, "Renamed", True), (-2, "gone", "D", 104, 5, "Brand#4", True), (-1, "present", "D", 200, 103, "Fresh", True)], moves.schema)
    return changes.apply_changes(files, roots.unionByName(dirs), moves.unionByName(folders))


_MERGE = r"""WITH f AS (SELECT p_partkey + 1000000 AS frn, p_partkey % 5 AS c, p_name, CAST(p_size AS BIGINT) AS size, p_partkey AS mtime, CASE WHEN p_brand = 'Brand#3' THEN 'Renamed' ELSE p_brand END AS b FROM part),
g AS (SELECT frn, c, CASE WHEN c IN (1, 2) THEN 'new ' || p_name ELSE p_name END || '.mkv' AS name, CASE WHEN c = 2 THEN 'D:\Renamed\Fresh' ELSE 'D:\' || b END AS dir, size, mtime FROM f WHERE c <> 0 AND (c = 2 OR b <> 'Brand#4'))"""


@query("merge_apply", _MERGE + " SELECT frn, name, dir, size, mtime FROM g")
def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir).files.select("frn", "name", "dir", "size", "mtime")


@query("merge_counts", _MERGE + " SELECT CAST(0 AS BIGINT) AS files_added, (SELECT count(*) FROM part) - (SELECT count(*) FROM g) AS files_removed, count(*) FILTER (c IN (1, 2)) AS files_moved, 1::BIGINT AS dirs_added, 1::BIGINT AS dirs_removed, 1::BIGINT AS dirs_renamed, (SELECT count(*) FROM part WHERE p_partkey % 5 = 1 AND p_brand = 'Brand#4') AS unresolved FROM g")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _merge(spark, sf_dir).counts
    names = ["files_added", "files_removed", "files_moved", "dirs_added", "dirs_removed", "dirs_renamed", "unresolved"]
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("carry_over", "SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT c_custkey, c_nationkey, 'rescanned ' || c_name FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey % 2 = 0")
def carry_over_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    new = old.where("c_nationkey % 3 = 0 and c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("rescanned "), "c_name"))
    scanned = _read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return carry_over(old, new, scanned).select("c_custkey", "c_nationkey", "c_name")


# ---- properties ----------------------------------------------------------------------------


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    path = F.concat(F.upper("source"), F.lit("\\"), F.col("doc_id"))
    kind = F.element_at(F.array(*map(F.lit, media.KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    files = docs.select(F.col("doc_id").alias("idx"), path.alias("path"), kind.alias("kind"), F.col("source").alias("volume"), F.col("n_chars").alias("size"), F.lit(7).cast("long").alias("mtime"))
    labels = _read(spark, sf_dir, "labels")
    store = docs.join(labels, "doc_id").select(F.lower(path).alias("path_key"), (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("size"), F.lit(7).cast("long").alias("mtime"), (F.col("quality") * 1920).alias("width"), (F.col("toxic") + 1080).alias("height"), F.col("doc_id").alias("duration_ms"))
    return enrich.seed_from_store(files, store)


_SEEDED = "WITH s AS (SELECT d.doc_id AS idx, d.source, d.doc_id % 3 AS k, l.doc_id IS NOT NULL AND d.doc_id % 3 <> 0 AS cached, quality, toxic FROM documents d LEFT JOIN (SELECT DISTINCT * FROM labels) l USING (doc_id))"


@query("enrich_lookup", _SEEDED + " SELECT idx, CAST(CASE WHEN cached THEN quality * 1920 ELSE 0 END AS INT) AS width, CAST(CASE WHEN cached THEN toxic + 1080 ELSE 0 END AS INT) AS height, CASE WHEN cached THEN idx ELSE 0 END AS duration_ms, cached FROM s")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).select("idx", "width", "height", "duration_ms", "cached")


@query("enrich_queue", _SEEDED + " SELECT idx, CAST(k + 1 AS BIGINT) AS priority FROM s WHERE NOT cached AND source <> 'src3'")
def enrich_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.read_queue(_seeded(spark, sf_dir), spark.createDataFrame([("src3",)], "letter string")).select("idx", F.col("priority").cast("long").alias("priority"))


@query("enrich_status", _SEEDED + " SELECT count(*) FILTER (cached) AS done, (SELECT count(*) FROM s WHERE source <> 'src3') AS total FROM s")
def enrich_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.status(_seeded(spark, sf_dir), spark.createDataFrame([("src3",)], "letter string"))


# ---- reports -------------------------------------------------------------------------------


def _deletions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Error events as deletions in folders of nations and regions; half the regions' folders are themselves deleted."""
    nation = _read(spark, sf_dir, "nation")
    live = _read(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.lit("D").alias("volume"), (F.col("r_regionkey") + 100).cast("long").alias("frn"), F.concat(F.lit("D:\\"), "r_name").alias("path"))
    roots = spark.range(1).select(F.lit("D").alias("volume"), F.lit(5).cast("long").alias("frn"), F.lit("D:").alias("path"))
    dirs = live.unionByName(roots)
    time = F.lit(13_350_000_000 * 10_000_000).cast("long")
    folders = _read(spark, sf_dir, "region").where("r_regionkey % 2 = 1").select(F.lit("D").alias("volume"), (F.col("r_regionkey") + 100).cast("long").alias("frn"), F.when(F.col("r_regionkey") == 1, 5).otherwise(77).cast("long").alias("parent_frn"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"), time.alias("filetime"))
    folders = folders.unionByName(nation.select(F.lit("D").alias("volume"), (F.col("n_nationkey") + 200).cast("long").alias("frn"), (F.col("n_regionkey") + 100).cast("long").alias("parent_frn"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"), time.alias("filetime")))
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) * 10 + media.EPOCH_TICKS).alias("filetime")
    files = _read(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("D").alias("volume"), (F.col("event_id") + 1000).alias("frn"), (F.col("user_id") % 25 + 200).alias("parent_frn"), F.concat(F.lit("f"), "event_id", F.lit(".MP4")).alias("name"), F.lit(False).alias("is_dir"), ticks)
    return folders.unionByName(files), dirs


@query("audit_by_hour", "SELECT hour, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d %Hh') AS hour FROM events WHERE event_type = 'error') GROUP BY hour")
def audit_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deletions_by_hour(_deletions(spark, sf_dir)[0].where("not is_dir"))


@query("audit_by_dir", r"SELECT path, count(*) AS n FROM (SELECT 'D:\' || r_name || '\' || n_name AS path FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey WHERE event_type = 'error' AND (r_regionkey % 2 = 0 OR r_regionkey = 1)) GROUP BY path ORDER BY n DESC, path LIMIT 25")
def audit_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deletions_by_folder(*_deletions(spark, sf_dir))[0]


@query("audit_unknown", "SELECT count(*) AS unknown FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE event_type = 'error' AND n_regionkey % 2 = 1 AND n_regionkey <> 1")
def audit_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deletions_by_folder(*_deletions(spark, sf_dir))[1]


@query("audit_roots", r"SELECT path FROM (SELECT 'D:\' || r_name AS path FROM region WHERE r_regionkey = 1 UNION SELECT 'D:\' || r_name || '\' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey % 2 = 0) ORDER BY path LIMIT 25")
def audit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deleted_roots(*_deletions(spark, sf_dir))


def _inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("volume"), (F.col("l_linenumber") % 4).cast("long").alias("frn"), F.col("l_quantity").cast("long").alias("size"), F.col("l_orderkey").alias("idx"))
    part = _read(spark, sf_dir, "part")
    dirs = part.select(F.col("p_partkey").alias("dir_id"), F.concat(F.lit("D:\\"), "p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("\\"), "p_type")).otherwise(F.lit(""))).alias("path"))
    return files, dirs


@query("inventory_kind", "SELECT l_returnflag AS kind, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def inventory_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.files_by_kind(_inventory(spark, sf_dir)[0])


@query("inventory_volume", "SELECT l_linestatus AS volume, count(*) AS files, count(*) FILTER (l_linenumber % 4 <> 0) AS with_identity FROM lineitem GROUP BY 1")
def inventory_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.files_by_volume(_inventory(spark, sf_dir)[0])


@query("inventory_roots", r"SELECT 'D:\' || p_brand AS root, count(*) AS dirs FROM part GROUP BY 1")
def inventory_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dirs_by_root(_inventory(spark, sf_dir)[1])


@query("library_totals", "SELECT count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, (SELECT count(*) FROM part) AS dirs FROM lineitem")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.library_totals(*_inventory(spark, sf_dir))


@query("deepest_path", r"SELECT 'D:\' || p_brand || CASE WHEN p_size > 25 THEN '\' || p_type ELSE '' END AS path, CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS INT) AS depth FROM part ORDER BY depth DESC, p_partkey DESC LIMIT 1")
def deepest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deepest_path(_inventory(spark, sf_dir)[1])


@query("systematic_sample", "SELECT p_partkey AS idx, p_name AS name FROM part WHERE p_partkey % greatest((SELECT count(*) FROM part) // 20, 1) = 0 ORDER BY idx LIMIT 20")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.systematic_sample(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name")))


# ---- stream --------------------------------------------------------------------------------


@query("stream_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream: each micro-batch is reduced to last rows, merged with the state so far and written as a new version."""
    from shelfspark.streaming.journal import stream_last

    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")
    return stream_last(stream.select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


from shelfspark import file_queries, journal_queries  # noqa: E402, F401 - they register their queries in the same tables
