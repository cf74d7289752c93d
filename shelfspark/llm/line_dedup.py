"""Operator 10: removal of lines that repeat or nearly repeat an earlier line.

Method: exact set-similarity join.  A line is the set of its lower-cased words; two lines
match at a Jaccard similarity of ``percent`` / 100.  Each line orders its words by rarity
and only the first ``n - ceil(t * n) + 1`` of them, its prefix, can hold the first word
that it shares with a match.  Lines that meet there must have lengths in proportion and
enough words left after the meeting (positional filter), and their signatures (parities
of words by cell) must differ in no more bits than the sets may differ in words; what remains is verified on the
words.  A line is removed if any earlier line (by doc_id, then by number) matches,
whether or not that one is removed itself.

A word is a long: its rarity above 57 bits of hash.  Where lines meet, 32 bits of it do: words that
share them only add candidates.  Rarity is the logarithm of the number
of words in the word's cell of ``CELLS``, counted over all documents; a table of fixed
size, which only orders the words, so its collisions cost work and never change a result.

Lines of equal sets are one from the start, so a frequent line is one row.  A word of at
most about ``MANY`` lines is a key at which its lines meet; lines whose first shared word is more frequent
share a second word too (or need one word only), so they meet at pairs of words, of which the
prefix has one word more.  At keys that many lines may hold, lines first meet two earlier lines only, and those that
these remove need no further partner: of a group of near copies not all pairs are made.
Everything is DataFrame operations.

Edge cases: lines with fewer than ``least_words`` words are kept; null texts have no
lines; a null doc_id comes after all others; rows with one doc_id count as one document
(lines of one number stand and fall together); a very long text or line is a longer array,
never cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import NO_ID, cut, with_null_ids

CELLS = 1 << 18
#: Spark's faster map of groups holds 2^16 by default; counting by cell gets four times as many as there are cells.
FAST_GROUPS, FAST_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit", 20
#: Lines, at most, that meet each other at one word, or at a frequent key without meeting the earliest first.
MANY = 4096
#: The numbers of the lines to verify are broadcast up to this size; beyond it, texts are shuffled by document once.
BROADCAST_BYTES = 32 << 20
#: A word's scale is STEPS for each doubling of its cell's count.
STEPS, TOP_SCALE, SHIFT = 3, 62, 57
SPACE = r"[ \t\x0B\f\r]"
LINE = ["doc_id", "line_no"]
#: A rare word whose cell counts at least 1 / CROWDED of MANY, and CROWDED_TIMES what half of the cells do, is a key at which lines meet two earlier ones first.
CROWDED, CROWDED_TIMES = 16, 4
#: Lines of more words have twice as many signature bits, and of more than twice as many words four times.
LONG, SIGNATURE = 96, ["bits", "half", "left", "right"]
FULL = (1 << 32) - 1


def _own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def _eligible(line: Column, least_words: int) -> Column:
    return line.rlike(rf"^{SPACE}*(?:[^ \t\x0B\f\r]+{SPACE}+){{{least_words - 1}}}[^ \t\x0B\f\r]")


def _scale(count: str) -> str:
    return f"cast(least(round({STEPS} * log2(1 + {count})), {TOP_SCALE}) as int)"


def rarity(docs: DataFrame) -> Column:
    """An array literal: the scale of each cell."""
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    counts = words.groupBy(F.expr(f"cast(xxhash64(w) & {CELLS - 1} as int)").alias("cell")).count()
    every = docs.sparkSession.range(CELLS).selectExpr("cast(id as int) as cell").join(counts, "cell", "left")
    scales = every.selectExpr("cell", f"{_scale('coalesce(count, 0)')} as scale").agg(F.expr("array_join(transform(array_sort(collect_list(struct(cell, scale))), c -> cast(c.scale as string)), ',') as scales"))
    conf = docs.sparkSession.conf
    before = conf.get(FAST_GROUPS)
    conf.set(FAST_GROUPS, str(FAST_BITS))
    try:
        found = scales.first()["scales"]
    finally:
        conf.set(FAST_GROUPS, before)
    return F.split(F.lit(found), ",").cast("array<long>")


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, line_no, line) of all lines, lower-cased, with blanks as their only white space."""
    odd = F.expr(r"contains(text, '\t') or contains(text, '\u000B') or contains(text, '\f') or contains(text, '\r')")
    text = F.when(odd, F.regexp_replace("text", r"[\t\x0B\f\r]", " ")).otherwise(F.col("text"))
    return docs.where("text is not null").select(_own_id(), *more, F.posexplode(F.split(F.lower(text), "\n")).alias("line_no", "line"))


def _hashed(line: str) -> Column:
    """The distinct words of a line, as longs."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def _tokens(lines: DataFrame, scales: Column, least_words: int) -> DataFrame:
    """(doc_id, line_no, tokens) of lines with enough words: the distinct words as sorted longs, rare ones first."""
    scale = lambda h: F.get(scales, h.bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    coded = F.transform(_hashed("line"), lambda h: F.shiftleft(scale(h), SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - SHIFT)))
    return lines.where(_eligible(F.col("line"), least_words)).select(*LINE, F.sort_array(coded).alias("tokens"))


def _prefixed(docs: DataFrame, scales: Column, percent: int, least_words: int) -> DataFrame:
    """(doc_id, line_no, n, SIGNATURE, prefix) of the first line of each set of words. The prefix has one word more than one shared word needs.

    ``bits`` are the parities of the numbers of words in 64 cells. For lines of more than ``LONG`` words, ``half`` are those of half of each
    cell's words, and for more than twice as many, ``left`` and ``right`` those of a quarter each: half of the words in ``bits`` without ``half``, and of those in ``half``.
    """
    sets = _tokens(_lines(docs), scales, least_words)
    n = F.size("tokens")
    bits = F.expr("aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, cast(t & 63 as int)))")
    part = lambda least, chosen: F.expr(f"if(size(tokens) > {least}, aggregate(tokens, 0L, (a, t) -> a ^ shiftleft({chosen}, cast(t & 63 as int))), 0L)")
    half, left, right = part(LONG, "shiftright(t, 6) & 1"), part(2 * LONG, "shiftright(t, 7) & ~shiftright(t, 6) & 1"), part(2 * LONG, "shiftright(t, 7) & shiftright(t, 6) & 1")
    signature = [bits.alias("bits"), half.alias("half"), left.alias("left"), right.alias("right")]
    rows = sets.select(F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g"), *LINE, n.alias("n"), *signature, F.slice("tokens", F.lit(1), (n - F.ceil(n * percent / 100) + 2).cast("int")).alias("prefix"))
    rows = rows.select("h", "g", F.struct(*LINE, "n", *SIGNATURE, "prefix").alias("row"))
    return rows.groupBy("h", "g").agg(F.min("row").alias("row")).select("row.*")


def _may_match(x: str, y: str, percent: int) -> str:
    """SQL: y is the later line, the lengths of x and y are in proportion, so few bits differ as words may, and both have room for the overlap from this word on; a y that is gone has none."""
    n_x, n_y, pos_x = f"({x}seat & {FULL})", f"({y}seat & {FULL})", f"greatest({x}pos, -1 - {x}pos)"
    overlap = f"ceil({percent} * ({n_x} + {n_y}) / {100 + percent})"
    later = f"({y}doc_id > {x}doc_id or {y}doc_id = {x}doc_id and {y}seat > {x}seat)"
    proportion = f"100 * least({n_x}, {n_y}) >= {percent} * greatest({n_x}, {n_y})"
    room = f"least({n_x} - {pos_x}, if({y}pos < 0, 0, {n_y} - {y}pos))"
    d = {c: f"({x}{c} ^ {y}{c})" for c in SIGNATURE}
    halves = f"bit_count({d['half']}) + bit_count({d['bits']} ^ {d['half']})"
    quarters = " + ".join(f"bit_count({q})" for q in (d["left"], f"{d['bits']} ^ {d['half']} ^ {d['left']}", d["right"], f"{d['half']} ^ {d['right']}"))
    shorter = f"least({n_x}, {n_y})"
    few = f"if({shorter} > {2 * LONG}, {quarters}, if({shorter} > {LONG}, {halves}, bit_count({d['bits']}))) <= {n_x} + {n_y} - 2 * {overlap}"
    return f"{later} and {proportion} and {few} and {room} >= {overlap}"


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    """(doc_id, line_no, x_doc, x_line, differ) of the lines that met, once each; ``differ`` is the number of their bits that do."""
    line = lambda at: F.expr(f"cast(shiftright({at}seat, 32) as int)")
    return met.select(F.col(f"{y}doc_id").alias("doc_id"), line(y).alias("line_no"), F.col(f"{x}doc_id").alias("x_doc"), line(x).alias("x_line"), F.expr(f"bit_count({x}bits ^ {y}bits)").alias("differ")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc_id, line_no) of those pairs that match. Words are read again for the lines of pairs only, by document.

    Each line meets the partner of the likest signature first, and the others only if that one does not match.
    """
    ends = pairs.select(*LINE).union(pairs.select("x_doc", "x_line"))
    wanted = cut(ends.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted")))
    size = wanted.agg(F.sum(24 + 8 * F.size("wanted")).alias("bytes")).first()["bytes"] or 0
    texts = docs.select(_own_id(), "text").join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "doc_id")
    lines = _lines(texts, "wanted").where(F.array_contains("wanted", F.col("line_no")))
    sets = cut(lines.select(*LINE, _hashed("line").alias("words")))
    earlier = sets.select(F.col("doc_id").alias("x_doc"), F.col("line_no").alias("x_line"), F.col("words").alias("x_words"))

    def matching(some: DataFrame) -> DataFrame:
        both = some.select(*LINE, "x_doc", "x_line").join(sets, LINE).join(earlier, ["x_doc", "x_line"]).withColumn("shared", F.size(F.array_intersect("words", "x_words")))
        return cut(both.where(f"100 * shared >= {percent} * (size(words) + size(x_words) - shared)").select(*LINE).distinct())

    likest = pairs.groupBy(*LINE).agg(F.min(F.struct("differ", "x_doc", "x_line")).alias("x"))
    gone = matching(likest.select(*LINE, "x.x_doc", "x.x_line"))
    return gone.unionByName(matching(pairs.join(gone, LINE, "left_anti").join(likest.select(*LINE, "x.x_doc", "x.x_line"), [*LINE, "x_doc", "x_line"], "left_anti")))


def _keys(lines: DataFrame, percent: int, least_scale: int = 0) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, seat, SIGNATURE, pos) of rare and of frequent words: where a line meets others, and the place of its first word there.

    These rows are most of what is shuffled, so they are narrow: ``seat`` is the line's number above 32 bits of its
    length, and ``pos`` of a line that is gone already, which needs no match but may be one, is ``-1 - pos``.
    Rare words of a scale below ``least_scale`` are left out.
    """
    need, seat = F.expr(f"ceil(n * {percent} / 100)").alias("need"), F.expr("shiftleft(cast(line_no as long), 32) | n").alias("seat")
    words = lines.select("doc_id", seat, "n", *SIGNATURE, "gone", need, "prefix", F.posexplode("prefix").alias("at", "word")).where("at <= n - need")
    is_rare = f"word < shiftleft({_scale(str(MANY))} + 1L, {SHIFT})"
    row = ["doc_id", "seat", *SIGNATURE, F.expr("if(gone, -1 - at, at)").alias("pos")]
    key = F.expr(f"cast((word & {FULL}) - {1 << 31} as int)").alias("key")
    rare, alone = words.where(f"{is_rare} and word >= shiftleft({least_scale}L, {SHIFT})").select(key, *row), words.where(f"not {is_rare} and need = 1").select(key, *row)
    pairs = words.where(f"not {is_rare}").select(key, *row, F.explode(F.expr("slice(prefix, at + 2, size(prefix))")).alias("second"))
    return rare, alone.unionByName(pairs.select(F.hash("key", "second").alias("key"), "doc_id", "seat", *SIGNATURE, "pos"))


def _gone_by_earliest(lines: DataFrame, docs: DataFrame, scales: Column, percent: int) -> DataFrame:
    """The lines (doc_id, line_no) that match an earlier line of a crowded rare word, or the earliest of a frequent key of more than ``MANY`` lines.

    This only saves work later, where all keys are met: a word of few lines has few pairs, so only words of crowded
    cells take part, and a running window over at most about ``MANY`` lines is short. A line meets the earliest
    line, and of all earlier ones that with the fewest rarer words: copies have foreign words before those they share, the middle of a group has none.
    """
    usual = F.get(F.sort_array(scales), F.lit(CELLS // 2)) + round(STEPS * math.log2(CROWDED_TIMES))
    crowded = docs.sparkSession.range(1).select(F.greatest(usual, F.expr(f"cast({_scale(str(MANY // CROWDED))} as long)"))).first()[0]
    rare, frequent = _keys(lines.withColumn("gone", F.lit(False)), percent, crowded)
    ends = F.struct("doc_id", "seat", "pos", *SIGNATURE)
    so_far = Window.partitionBy("key").orderBy("doc_id", "seat")
    middle = F.min(F.struct("pos", "doc_id", "seat", *SIGNATURE)).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    earlier = rare.select(ends.alias("y"), F.first(ends).over(so_far).alias("first"), middle.alias("m")).where("m is not null")
    both = earlier.select("y", F.explode(F.array("first", F.struct("m.doc_id", "m.seat", "m.pos", *(f"m.{b}" for b in SIGNATURE)))).alias("x"))
    many = cut(frequent.groupBy("key").count().where(f"count > {MANY}").select("key"))
    held = frequent.join(many, "key").select("key", ends.alias("y"))
    of_many = held.join(held.groupBy("key").agg(F.min("y").alias("x")), "key")
    met = both.unionByName(of_many.select("x", "y")).where(_may_match("x.", "y.", percent))
    return _verified(cut(_pairs(met, "x.", "y.")), docs, percent)


def first_lines(docs: DataFrame, percent: int = 80, least_words: int = 1) -> DataFrame:
    """(doc_id, line_no) of the lines that stay, of those with at least ``least_words`` words."""
    docs = docs.select("doc_id", "text")
    scales = rarity(docs)
    lines = cut(_prefixed(docs, scales, percent, least_words))
    gone = _gone_by_earliest(lines, docs, scales, percent)

    # Both sides of the join need the same rows and columns, so they read one exchange.
    marks = gone.withColumn("gone", F.lit(True))
    marked = lines.join(F.broadcast(marks) if 24 * gone.count() <= BROADCAST_BYTES else marks, LINE, "left").withColumn("gone", F.expr("gone is not null"))
    rare, frequent = _keys(marked, percent)
    keys = rare.unionByName(frequent)
    met = keys.alias("y").join(keys.alias("x"), F.expr(f"y.key = x.key and {_may_match('x.', 'y.', percent)}"))
    gone = gone.unionByName(_verified(cut(_pairs(met, "x.", "y.")), docs, percent))
    return lines.select(*LINE).join(gone, LINE, "left_anti")


def removed_lines(docs: DataFrame, percent: int = 80, least_words: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, and removed, the numbers (from 0) of the lines that go."""
    stay = first_lines(docs, percent, least_words).groupBy("doc_id").agg(F.collect_list("line_no").alias("stay"))
    every = docs.select(_own_id(), F.split("text", "\n").alias("lines"))
    able = F.filter(F.transform("lines", lambda s, i: F.when(_eligible(s, least_words), i)), lambda i: i.isNotNull())
    every = every.select("doc_id", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.coalesce(able, F.array().cast("array<int>")).alias("able"))
    out = every.join(stay, "doc_id", "left").select("doc_id", "n_lines", F.array_except("able", F.coalesce("stay", F.array().cast("array<int>"))).alias("removed"))
    return with_null_ids(out)


def without_repeated_lines(docs: DataFrame, percent: int = 80, least_words: int = 1) -> DataFrame:
    """Per document: doc_id and its text without the removed lines."""
    gone = removed_lines(docs.where("doc_id is not null"), percent, least_words).select("doc_id", "removed").dropDuplicates(["doc_id"])
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), "removed")
    text = F.array_join(F.transform(kept, lambda i: F.get(F.split("text", "\n"), i)), "\n")
    return docs.select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", F.when(F.col("removed").isNull() | (F.size("removed") == 0), F.col("text")).otherwise(text).alias("text"))
