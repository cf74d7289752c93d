"""Operator 12: collocations, mined by pivot partitioning of the phrases (as in MG-FSM).

Method: words are counted by language; those below ``least`` occurrences can be in no
frequent phrase.  Of a phrase's words the rarest is its pivot (ties: the lesser by UTF-8
bytes; of several occurrences in the phrase the first).  Every word occurrence sends one
rewritten fragment to the partition of its word: the words around it up to the first that
is rarer, infrequent, or beyond the piece of text, and at most ``most_words - 1`` on each
side.  All occurrences of a phrase are in fragments of its pivot, each in one of them, so a
partition counts its phrases alone and emits only those that its pivots own.

Equal fragments are sent once with their number, and all fragments for one partition, of one
language, as one row (see ``exchange``).  The fragments of a word with more than ``SPLIT``
occurrences are dealt to several partitions, whose counts are added up before the threshold is
applied, so neither a frequent word nor a frequent passage is one task's work.

Origins ask for the occurrences of their distinct words by a packed exchange, so the table of
frequent words may be of any size.  Words and runs are compared by their bytes, not by hashes.

A phrase's score is that of its lowest-scoring cut in two: floor(1000 * a * n / (l * r)), with
the occurrences a of the phrase, l and r of its parts, and n of all words of the language, in
exact decimal arithmetic.  Phrases inside a longer one that occurs as often are dropped.

Edge cases: null and empty texts have no words; a null language is ``und``; rows that share a
doc_id, or have none, are texts of their own; repeated rows count each; equal scores go by
occurrences, then by phrase in byte order; a very long text stays whole; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import ship_package

from . import exchange as X
from . import words as W

PIECE_ENDS = W._flags(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
BETWEEN = PIECE_ENDS | W._flags(lambda b: b in (0x20, 0x09))
WORDS = "bucket int, lang string, word string, n long"
KEYS, COUNTS = range(2)
TAB = pa.scalar("\t", pa.large_string())
FRAGMENTS = "bucket int, lang string, split boolean, texts binary, places binary, counts binary"
FOUND = "lang string, phrase string, n long, partial boolean"
#: Occurrences that one partition counts, about.
SPLIT = 500_000
#: Phrases of a language that one task of the ranking sorts first.
RANKED = 200_000
#: Spans whose bytes are gathered at once.
GATHERED = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens(NamedTuple):
    """The words of a block of texts: bytes and spans, the piece that each is in, language and word as numbers."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: pa.Array
    word: np.ndarray
    words: pa.Array


def tokens_of(block: pa.Table) -> Tokens:
    data, bounds = W.text_bytes(block["text"])
    s = W.split(_LOWER[data], bounds, BETWEEN)
    ended = np.cumsum(PIECE_ENDS[data], dtype=np.int32)
    lang = pc.dictionary_encode(block["lang"].combine_chunks())
    word = pc.dictionary_encode(span_strings(s.data, s.starts, s.ends))
    doc = s.doc
    return Tokens(s.data, s.starts, s.ends, ended[s.starts] + doc, lang.indices.to_numpy()[doc], lang.dictionary, word.indices.to_numpy().astype(np.int64), word.dictionary)


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    out = np.empty(offsets[-1], np.uint8)
    for a, b in _slices(len(starts)):  # the places of bytes take eight times the bytes
        at = np.repeat(starts[a:b] - offsets[a:b], ends[a:b] - starts[a:b]) + np.arange(offsets[a], offsets[b])
        out[offsets[a] : offsets[b]] = data[at]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def _slices(n: int) -> list[tuple[int, int]]:
    """0 to ``n`` in slices of ``GATHERED``."""
    return [(a, min(a + GATHERED, n)) for a in range(0, n, GATHERED)]


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, from 0 without gaps."""
    return pc.dictionary_encode(pa.array(keys)).indices.to_numpy().astype(np.int64)


def _longer(number: np.ndarray, first: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """The number of each run with the word at ``at`` added: equal runs have equal numbers. ``first``: words below ``size``."""
    return _numbered(number * size + first[at])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each group of equal keys, size of the group)."""
    number = _numbered(keys)
    first = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return first, np.bincount(number, minlength=len(first))


class Words(NamedTuple):
    """The distinct words of a block, in the order of their hashes: language, a tab and the word; first token, occurrences, hash; and the number of each token's word."""

    keys: pa.Array
    first: np.ndarray
    n: np.ndarray
    hashes: np.ndarray
    of: np.ndarray


def distinct_words(t: Tokens) -> Words:
    number = _numbered(t.lang.astype(np.int64) * len(t.words) + t.word)
    n = np.bincount(number)
    first = np.zeros(len(n), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    keys = pc.binary_join_element_wise(t.langs.take(t.lang[first]).cast(pa.large_string()), t.words.take(t.word[first]), TAB)
    hashes = _hashes(keys)
    order = np.argsort(hashes, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Words(keys.take(order), first[order], n[order], hashes[order], place[number])


def _packed(w: Words, origin: int, buckets: int) -> list[dict]:
    """A row for each bucket: number of words, their lengths, their occurrences, their bytes."""
    data, bounds = W.text_bytes(w.keys)
    size = np.diff(bounds).astype(np.int32)
    pack = lambda a, b: b"".join(x.tobytes() for x in (np.array([b - a]), size[a:b], w.n[a:b], data[bounds[a] : bounds[b]]))
    return [{"origin": origin, "kind": KEYS, "bucket": k, "packed": pack(a, b)} for k, a, b in X.bounds(w.hashes, buckets).spans()]


def _unpacked(packed: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, occurrences, where each pack begins and the last ends)."""
    sizes, counts, data = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
    for p in packed:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        sizes.append(np.frombuffer(p, np.int32, n, 8))
        counts.append(np.frombuffer(p, np.uint8, 8 * n, 8 + 4 * n).view(np.int64))
        data.append(np.frombuffer(p, np.uint8, offset=8 + 12 * n))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data) if data else np.zeros(0, np.uint8))])
    return words, np.concatenate(counts), np.cumsum([0, *map(len, sizes[1:])])


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, lang, word, n): occurrences of every word."""

    def send(batches):
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text", X.ORIGIN_BYTES):
                yield from X.table_of(_packed(distinct_words(tokens_of(block)), 0, buckets)).to_batches()

    def count(key, table):
        words, n, _ = _unpacked([v.as_buffer() for v in table["packed"]])
        words = pc.dictionary_encode(words)
        total = np.bincount(words.indices.to_numpy(), weights=n, minlength=len(words.dictionary)).astype(np.int64)
        parts = pc.split_pattern(words.dictionary, "\t", max_splits=1, reverse=True)
        columns = [pa.array(np.full(len(total), key[0].as_py(), np.int32)), *(pc.list_element(parts, i).cast(pa.string()) for i in (0, 1)), pa.array(total)]
        return pa.table(columns, schema=pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    return docs.select("lang", "text").mapInArrow(send, X.PACKED).groupBy("bucket").applyInArrow(count, WORDS)


def _asked(texts: DataFrame, often: DataFrame, buckets: int) -> DataFrame:
    """For each origin and bucket the occurrences in all texts of the origin's distinct words, in their order; 0 if a word is infrequent."""

    def reply(key, sent, own):
        words, _, edges = _unpacked([v.as_buffer() for v in sent["packed"]])
        known = pc.binary_join_element_wise(own["lang"].combine_chunks().cast(pa.large_string()), own["word"].combine_chunks().cast(pa.large_string()), TAB)
        at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
        n = np.append(own["n"].to_numpy(), 0)[at]  # the last stands for words that are not known
        return X.table_of([{"origin": o, "kind": COUNTS, "bucket": key[0].as_py(), "packed": X.planes(n[a:b])} for o, a, b in zip(sent["origin"].to_pylist(), edges[:-1], edges[1:], strict=True)])

    sent = X.alone(texts, lambda origin, table: X.table_of(_packed(distinct_words(tokens_of(table)), origin, buckets)), X.PACKED)
    return sent.groupBy("bucket").cogroup(often.select("bucket", "lang", "word", "n").groupBy("bucket")).applyInArrow(reply, X.PACKED)


def _ranks(t: Tokens, w: Words, n: np.ndarray, least: int) -> np.ndarray:
    """Each distinct word's place in the order of rarity, ties by bytes; -1 if it is infrequent. Only words of one language are compared."""
    order = np.empty(len(t.words), np.int64)
    order[pc.sort_indices(t.words).to_numpy()] = np.arange(len(t.words))
    place = np.empty(len(n), np.int64)
    place[np.lexsort((order[t.word[w.first]], n))] = np.arange(len(n))
    return np.where(n >= least, place, -1)


def reach(rank: np.ndarray, piece: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after each belong to its fragment: strictly more frequent ones before it, no rarer ones after it."""
    before, after = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for side, out in ((-1, before), (1, after)):
        going = rank >= 0
        for d in range(1, most):
            near = np.zeros(len(rank), bool)
            if d < len(rank):
                here, there = (slice(d, None), slice(None, -d)) if side < 0 else (slice(None, -d), slice(d, None))
                near[here] = (piece[there] == piece[here]) & ((rank[there] > rank[here]) if side < 0 else (rank[there] >= rank[here]))
            going = going & near
            out += going
    return before, after


def fragments_of(table: pa.Table, answered: np.ndarray, least: int, most: int, buckets: int, split: int) -> pa.Table:
    """The distinct fragments of an origin's words, a row for each partition and language. ``answered``: occurrences of the distinct words in all texts."""
    t = tokens_of(table)
    w = distinct_words(t)
    rank = _ranks(t, w, answered, least)[w.of]
    before, after = reach(rank, t.piece, most)
    size = before + after + 1
    pivot, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.flatnonzero(size > 1)  # only fragments are numbered, each up to its own length
    number = w.of[left - before[left]]
    for k in range(2, 2 * most):
        number = _longer(number, w.of, len(w.n), left - before[left] + k - 1)
        whole = size[left] == k
        at = left[whole]
        first, count = _groups(number[whole] * most + before[at])
        pivot.append(at[first])
        n.append(count)
        left, number = left[~whole], number[~whole]
    pivot, n = np.concatenate(pivot), np.concatenate(n)
    word = w.of[pivot]
    parts = 1 + answered[word] // split
    part = np.zeros(len(pivot), np.uint64)
    many = np.flatnonzero(parts > 1)
    if len(many):
        part[many] = _hashes(_joined(t, pivot[many] - before[pivot[many]], size[pivot[many]])) % parts[many].astype(np.uint64)
    bucket = (W.mix(w.hashes[word] + part) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((word, parts > 1, t.lang[pivot], bucket))
    pivot, n, bucket, divided = pivot[order], n[order], bucket[order], parts[order] > 1
    lang = t.lang[pivot]
    begins = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0) | (np.diff(divided.astype(np.int8), prepend=-1) != 0))
    edges = np.append(begins, len(pivot))
    data, bounds = W.text_bytes(_joined(t, pivot - before[pivot], size[pivot]))
    cut = lambda values, at: pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    columns = (bucket[begins].astype(np.int32), t.langs.take(lang[begins]).cast(pa.string()), divided[begins], cut(data, bounds[edges]), cut(before[pivot].astype(np.int8), edges), cut(n.astype(np.int32), edges))
    return pa.table(dict(zip(X.pa_schema(FRAGMENTS).names, columns, strict=True)))


def _hashes(strings: pa.Array) -> np.ndarray:
    data, bounds = W.text_bytes(strings)
    return W.span_hashes(W.Spans(data, bounds[:-1], bounds[1:], np.array([0, len(strings)])))


def _joined(t: Tokens, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of words as strings: one space between the words, a newline at the end."""
    parts = [_joined_bytes(t, first[a:b], size[a:b]) for a, b in _slices(len(first))]
    offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])))).astype(np.int64)
    out = np.concatenate([np.zeros(0, np.uint8), *(data for data, _ in parts)])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _joined_bytes(t: Tokens, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the runs of :func:`_joined`, and how many each has."""
    ends = np.cumsum(size)
    token = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
    length = t.ends[token] - t.starts[token] + 1
    after = np.cumsum(length)
    at = np.repeat(t.starts[token] - (after - length), length) + np.arange(after[-1])
    out = t.data[np.minimum(at, len(t.data) - 1)]
    out[after - 1] = 0x20
    out[after[ends - 1] - 1] = 0x0A
    return out, np.diff(after[ends - 1], prepend=0)


def mine(table: pa.Table, least: int, most: int) -> pa.Table:
    """The phrases of a partition that hold their fragment's pivot, and how often they occur."""
    data = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
    place = np.frombuffer(b"".join(table["places"].to_pylist()), np.int8).astype(np.int64)
    count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    ends = np.flatnonzero(data == 0x0A)
    s = W.split(data, np.concatenate(([0], ends + 1)), BETWEEN)
    lang = pc.dictionary_encode(table["lang"].combine_chunks())
    per_row = pc.binary_length(table["places"]).to_numpy()
    code, split = np.repeat(lang.indices.to_numpy(), per_row).astype(np.int64), np.repeat(table["split"].to_numpy(), per_row)
    word = pc.dictionary_encode(span_strings(s.data, s.starts, s.ends))
    of = s.doc
    base = _numbered(code[of] * len(word.dictionary) + word.indices.to_numpy().astype(np.int64))
    pivot = s.offsets[:-1] + place
    at = np.arange(len(base))
    at = at[at <= pivot[of]]  # no other run holds the pivot
    number, out = base[at], []
    for k in range(2, most + 1):
        at, number = at[going := at + k <= s.offsets[1:][of[at]]], number[going]
        number = _longer(number, base, len(base), at + k - 1)
        holds = pivot[of[at]] < at + k
        held, mine_at = number[holds], at[holds]
        total = np.bincount(held, weights=count[of[mine_at]], minlength=len(number)).astype(np.int64)
        example = np.zeros(len(total), np.int64)
        example[held] = mine_at
        good = np.flatnonzero(total)
        partial = split[of[example[good]]]
        good, partial = good[keep := partial | (total[good] >= least)], partial[keep]
        first = example[good]
        out.append(pa.table({"lang": lang.dictionary.take(code[of[first]]).cast(pa.string()), "phrase": span_strings(s.data, s.starts[first], s.ends[first + k - 1]).cast(pa.string()), "n": total[good], "partial": partial}, X.pa_schema(FOUND)))
    return pa.concat_tables(out)


def frequent_phrases(docs: DataFrame, least: int = 100, most_words: int = 5, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """((bucket, lang, word, n) of all words, (lang, phrase, n) of the phrases of 2 to ``most_words`` words with at least ``least`` occurrences)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    ship_package(docs.sparkSession)
    plan = X.Plan(docs)
    counts = X.cut(word_counts(docs, plan.buckets))
    often = counts.where(F.col("n") >= least)
    partitions = max(1, int(counts.agg(F.sum("n")).first()[0] or 0) // split)
    texts = X.by_origin(docs, plan, "text", "lang")

    def rewrite(origin, table, side):
        answered = np.concatenate([np.zeros(0, np.int64), *(X.unpack(p, np.int64)[0] for p in X.answers(side, COUNTS))])
        return fragments_of(table, answered, least, most_words, partitions, split)

    fragments = X.with_side(texts, _asked(texts, often, plan.buckets), rewrite, FRAGMENTS)
    found = X.cut(fragments.groupBy("bucket").applyInArrow(lambda table: mine(table, least, most_words), FOUND))
    added = found.where("partial").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counts, X.cut(found.where("not partial").select("lang", "phrase", "n").unionByName(added))


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, absorb_percent: int = 100, split: int = SPLIT) -> DataFrame:
    """Each language's best ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, phrases = frequent_phrases(docs, least, most_words, split)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    known = counts.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n"))
    part = lambda first, size: F.array_join(F.slice("ws", first, size), " ")
    of = lambda name: known.select("lang", F.col("part").alias(f"{name}_part"), F.col("n").alias(name))

    split_up = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = split_up.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("l_part"), part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("r_part"))
    cuts = cuts.join(of("l"), ["lang", "l_part"]).join(of("r"), ["lang", "r_part"]).join(totals, "lang")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({exact('a')} * {exact('n')} * cast(1000 as decimal(4, 0))) div ({exact('l')} * {exact('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = split_up.where(F.size("ws") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)))
    longer = inner.groupBy("lang", part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {absorb_percent} * a")
    kept = X.cut(kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))

    # The best of each part of a language first, so that no task sorts all of it.
    parts = 1 + kept.count() // RANKED
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*best)
    near = kept.withColumn("at", F.row_number().over(some)).where(F.col("at") <= top).drop("at")
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
