"""Ranked, diacritic-insensitive search over file names and folder paths.

A token scores by where it first occurs in the folded name, or else in the folded
folder path; a row's rank is its number of matched tokens, then its score.  Folders
are scored once each, and only those with a score meet their files, so the files need not be
moved unless very many folders match.  Filters on file columns come
first so that they reach the Parquet scan; only the best ``limit`` rows are ordered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.fold import fold_text, tokenize_text
from shelfspark.functions.media import KINDS, full_path
from shelfspark.sources.snapshot import cut

# Scores, and the characters after which a word begins.
EXACT, PREFIX, WORD, INSIDE, DIR_WORD, DIR_INSIDE, MOST_BONUS = 1000, 800, 600, 400, 250, 200, 50
BOUNDARY = " _-.()[]{},'+&@#~!;\\/"
MATCHED_WEIGHT = 100_000
LIMIT, MOST_LIMIT = 5000, 20_000
#: Bytes of folders beyond which those with a score are written before the join.
BROADCAST_FOLDERS = 64 << 20


@dataclass(frozen=True)
class SearchOptions:
    """What a search may be narrowed to; 0 or empty means no filter. A ``limit`` is ``MOST_LIMIT`` at most; None serves every hit."""

    kinds: tuple[str, ...] = ()
    min_height: int = 0
    min_duration_ms: int = 0
    max_duration_ms: int = 0
    modified_after: int = 0
    order: str = "relevance"
    limit: int | None = LIMIT

    @property
    def by_props(self) -> bool:
        return bool(self.min_height or self.min_duration_ms or self.max_duration_ms)


def parse_kinds(names: list[str]) -> tuple[str, ...]:
    """Known kind names; unknown ones are ignored, and if none is left there is no filter."""
    return tuple(n for n in names if n in KINDS)


#: Filters by name, of three sorts: resolution, length (from .. to, milliseconds), days since the last change.
PRESETS: dict[str, dict[str, int]] = {
    "720p": {"min_height": 720},
    "1080p": {"min_height": 1080},
    "4k": {"min_height": 2160},
    "short": {"max_duration_ms": 60_000},
    "medium": {"min_duration_ms": 60_000, "max_duration_ms": 600_000},
    "long": {"min_duration_ms": 600_000},
    "week": {"within_days": 7},
    "month": {"within_days": 30},
    "year": {"within_days": 365},
}


def preset_filters(*names: str) -> dict[str, int]:
    """The filters of presets, for ``Engine.search(..., **preset_filters("1080p", "long"))``. Raises ValueError on unknown names and on two of one sort."""
    out: dict[str, int] = {}
    for name in names:
        filters = PRESETS.get(name.lower())
        if filters is None:
            raise ValueError(f"unknown preset {name}; there are {', '.join(PRESETS)}")
        sort = {k.split("_", 1)[1] for k in filters}
        if any(k.split("_", 1)[1] in sort for k in out):
            raise ValueError(f"{name} narrows what another preset narrows already")
        out |= filters
    return out


def recency_cutoff(days: int, now: int) -> int:
    return max(now - days * 86_400, 0) if days else 0


def query_tokens(query: str) -> list[str]:
    return tokenize_text(fold_text(query))


def _occurs(text: Column, token: str) -> tuple[Column, Column]:
    """Where the token first occurs (0: nowhere), and whether a word begins there."""
    at = F.instr(text, token)
    return at, F.instr(F.lit(BOUNDARY), F.substring(text, at - 1, F.lit(1))) > 0


def name_score(folded: Column, token: str) -> Column:
    """Score of the token's first occurrence in a folded name; null if it does not occur."""
    at, word = _occurs(folded, token)
    stem = F.when(F.instr(folded, ".") > 0, F.substring(folded, F.lit(1), F.length(folded) - F.length(F.substring_index(folded, ".", -1)) - 1)).otherwise(folded)
    start = F.when((stem == token) | (folded == token), EXACT).otherwise(PREFIX)
    return F.when(at == 0, None).when(at == 1, start).when(word, WORD).otherwise(INSIDE)


def dir_score(folded: Column, token: str) -> Column:
    at, word = _occurs(folded, token)
    return F.when(at == 0, None).when((at == 1) | word, DIR_WORD).otherwise(DIR_INSIDE)


def length_bonus(folded: Column) -> Column:
    return F.greatest(F.lit(MOST_BONUS) - F.floor(F.octet_length(folded) / 4), F.lit(0)).cast("int")


def _accepted(files: DataFrame, options: SearchOptions, props: DataFrame | None) -> DataFrame:
    if options.kinds:
        files = files.where(F.col("kind").isin(list(options.kinds)))
    if options.modified_after:
        files = files.where(F.col("mtime") >= options.modified_after)
    if not options.by_props:
        return files
    if props is None:
        return files.limit(0)  # nothing is known about any file
    files = files.join(props.select("idx", "width", "height", "duration_ms"), "idx")  # unknown properties fail every filter
    short = F.least("width", "height")
    if options.min_height:
        files = files.where((short >= options.min_height) & (short > 0))
    if options.min_duration_ms:
        files = files.where(F.col("duration_ms") >= options.min_duration_ms)
    if options.max_duration_ms:
        files = files.where((F.col("duration_ms") > 0) & (F.col("duration_ms") <= options.max_duration_ms))
    return files.drop("width", "height", "duration_ms")


def _scored_folders(dirs: DataFrame, tokens: list[str]) -> DataFrame:
    """dir_id and each token's score (d0, d1, ...) of the folders in which any token occurs.

    Where the folders are too many to be broadcast, the ones with a score are written first, so
    that Spark plans the join with the files by their true size.
    """
    scored = dirs.select("dir_id", *(dir_score(F.col("folded"), t).alias(f"d{i}") for i, t in enumerate(tokens)))
    scored = scored.where(reduce(lambda a, b: a | b, (F.col(f"d{i}").isNotNull() for i in range(len(tokens)))))
    return cut(scored) if planned_bytes(dirs) > BROADCAST_FOLDERS else scored


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size: that of the files which it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ranked(files: DataFrame, dirs: DataFrame, tokens: list[str], floor: int, options: SearchOptions, props: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` files (None: all, in no order) that match at least ``floor`` of the tokens, with matched, score and key."""
    scored = _scored_folders(dirs, tokens)
    rows = _accepted(files, options, props).join(scored, "dir_id", "left")
    parts = [F.coalesce(name_score(F.col("folded"), t), F.col(f"d{i}")) for i, t in enumerate(tokens)]
    rows = rows.select(*files.columns, *(p.alias(f"s{i}") for i, p in enumerate(parts)))
    names = [F.col(f"s{i}") for i in range(len(tokens))]
    rows = rows.withColumn("matched", reduce(lambda a, b: a + b, (F.when(s.isNotNull(), 1).otherwise(0) for s in names)))
    points = reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0)) for s in names)) + length_bonus(F.col("folded"))
    rows = rows.where(F.col("matched") >= floor).withColumn("score", F.col("matched") * MATCHED_WEIGHT + points)
    key = F.col("mtime") if options.order == "newest" else F.col("score")
    rows = rows.withColumn("key", key.cast("long")).drop(*(f"s{i}" for i in range(len(tokens))))
    return rows if options.limit is None else rows.orderBy(F.desc("key"), "idx").limit(max(1, min(options.limit, MOST_LIMIT)))


@dataclass
class SearchResult:
    """Hits in order, and whether fewer than all tokens had to do."""

    hits: DataFrame
    tokens: list[str] = field(default_factory=list)
    best_matched: int | None = None


def with_paths(hits: DataFrame, dirs: DataFrame) -> DataFrame:
    """Full paths, for the rows that are returned only."""
    out = hits.join(dirs.select("dir_id", F.col("path").alias("dir")), "dir_id")
    return out.withColumn("path", full_path(F.col("dir"), F.col("name"))).orderBy(F.desc("key"), "idx")


def page(hits: DataFrame, first: int, rows: int, overscan: int = 3) -> DataFrame:
    """The hits of a window of a list, with a few before and after it."""
    start = max(first - overscan, 0)
    return hits.orderBy(F.desc("key"), "idx").offset(start).limit(first + rows + overscan - start)


def best_partial(rows: DataFrame) -> DataFrame:
    """Of a relaxed pass, the rows that match as many tokens as the best."""
    best = rows.agg(F.max("matched").alias("best_matched"))
    return rows.join(best, rows["matched"] == best["best_matched"]).drop("best_matched")


def no_hits(files: DataFrame) -> DataFrame:
    """An empty table of hits."""
    return files.withColumns({"matched": F.lit(0), "score": F.lit(0), "key": F.lit(0).cast("long")}).limit(0)


def search(files: DataFrame, dirs: DataFrame, query: str, options: SearchOptions = SearchOptions(), props: DataFrame | None = None) -> SearchResult:
    """All tokens must match; if nothing does and there are three or more, the best partial matches of half of them."""
    tokens = query_tokens(query)
    if not tokens or options.limit is not None and options.limit <= 0:
        return SearchResult(with_paths(no_hits(files), dirs), tokens)
    if len(tokens) < 3:
        return SearchResult(with_paths(ranked(files, dirs, tokens, len(tokens), options, props), dirs), tokens)
    half = -(-len(tokens) // 2)
    if options.order == "newest":  # its key doesn't put strict hits first
        strict = cut(ranked(files, dirs, tokens, len(tokens), options, props))
        if not strict.isEmpty():
            return SearchResult(with_paths(strict, dirs), tokens)
    # By relevance the rows that match most come first, so one pass over the files serves both; what is kept is ``limit`` rows at most, unless all are asked for.
    rows = cut(ranked(files, dirs, tokens, half, options, props))
    best = rows.agg(F.max("matched").alias("m")).first()["m"]
    if best is not None:
        rows = rows.where(F.col("matched") == best)
    return SearchResult(with_paths(rows, dirs), tokens, best if best != len(tokens) else None)
