"""Operator 13: importance resampling towards a target distribution of hashed word n-grams.

Method: every run of 1 to ``most_run`` words is a feature and falls into a bucket by its
crc32.  A bucket's gain is the smoothed log-ratio of its shares in the target and in the
documents; a document's weight is the mean gain of its features.  Weight plus Gumbel noise
from a hash of the doc_id ranks the documents, and the best ``percent`` of those with
``least_words`` words are drawn, without replacement.

Overlap chunking keeps long texts from being one task's work: a text of more than
``chunk_words`` words is split at word boundaries into chunks that carry the first
``most_run - 1`` words of the next one.  A chunk owns the features that start at its own
words, so each feature is counted once; chunks are dealt to all tasks, and their counts and
gains are summed by document.  Shorter texts are chunks as they lie and are not moved.

What tasks send is at most one row for each bucket or chunk, without texts.  Ranks come from
a range-partitioned sort.

Edge cases: a null or empty text, or one without words, has no features and weight 0; rows
that share a doc_id are one document of all their texts, and so are all rows without one
(null, whose noise is that of the empty id, and which ties put last); equal scores are drawn
by doc_id; repeated rows count as often as they occur; a very long text is many chunks, only
a single word is never split; without a target every gain comes from the smoothing; empty
tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import ship_package
from shelfspark.sources.snapshot import assign_positions

from . import exchange as X
from . import words as W

CHUNK_WORDS = 8192
PIECES = "doc_id long, first long, own int, text string"
#: Words of more bytes go to zlib one by one.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """zlib's crc32 of each span of bytes, continued from ``before``: byte by byte, over all spans at once."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: those with a byte at place j come first
    size = (ends - starts)[order]
    c = np.zeros(len(starts), np.uint32) if before is None else before[order]
    long = int(np.searchsorted(-size, -LONG_WORD, "left"))
    for i in range(long):
        k = order[i]
        c[i] = zlib.crc32(data[starts[k] : ends[k]], int(c[i]))
    at, rest, size = starts[order[long:]], ~c[long:], size[long:]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        rest[:n] = _CRC[(rest[:n] ^ data[at[:n] + j]) & 255] ^ (rest[:n] >> 8)
    c[long:] = ~rest
    out = np.empty_like(c)
    out[order] = c
    return out


def feature_buckets(block: pa.Table, most_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the chunk, bucket) of every feature that the chunks of a block own, and the chunks' own words."""
    data, bounds = W.text_bytes(block["text"])
    s = W.split(_LOWER[data], bounds, W.NON_WORD)
    own = block["own"].to_numpy().astype(float)
    own = np.where(np.isnan(own), s.per_doc, own).astype(np.int64)
    chunk = s.doc
    place = np.arange(len(s.starts)) - s.offsets[chunk]
    last = s.offsets[chunk + 1] if len(chunk) else chunk
    of, found, crc = [], [], None
    for run in range(1, most_run + 1):
        n = max(len(s.starts) - run + 1, 0)
        joint = None if crc is None else _spaced(crc[:n])
        crc = crc32_spans(s.data, s.starts[run - 1 :], s.ends[run - 1 :], joint)
        mine = np.flatnonzero((place[:n] < own[chunk[:n]]) & (np.arange(run, n + run) <= last[:n]))
        of.append(chunk[mine])
        found.append(crc[mine].astype(np.int64) % buckets)
    return np.concatenate(of), np.concatenate(found), own


def _spaced(crc: np.ndarray) -> np.ndarray:
    """The crc after one more byte, a space."""
    c = ~crc
    return ~(_CRC[(c ^ np.uint32(32)) & 255] ^ (c >> 8))


def chunks(texts: DataFrame, most_run: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, first, own, text): short texts as they are (own is null), long ones as chunks, written and dealt out."""
    ship_package(texts.sparkSession)
    carry = most_run - 1

    def split(batches):
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data, bounds = W.text_bytes(pa.array([text.as_py()], pa.string()))
                s = W.split(data, bounds, W.NON_WORD)
                n = len(s.starts)
                for lo in range(0, max(n, 1), chunk_words):
                    hi = min(lo + chunk_words, n)
                    piece = data[s.starts[lo] : s.ends[min(hi + carry, n) - 1]].tobytes().decode() if n else ""
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id.as_py()], pa.int64()), "first": pa.array([lo], pa.int64()), "own": pa.array([hi - lo], pa.int32()), "text": pa.array([piece])})

    # A text of fewer bytes can't have more words.
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > 2 * chunk_words
    long = texts.where(is_long).mapInArrow(split, PIECES).repartition("doc_id", "first")
    short = texts.where(~is_long).select("doc_id", F.lit(0).cast("long").alias("first"), F.lit(None).cast("int").alias("own"), "text")
    return short.unionByName(X.cut(long))


def bucket_counts(pieces: DataFrame, most_run: int, buckets: int) -> np.ndarray:
    """How many features fall into each bucket. A task sends a row for each bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                total += np.bincount(feature_buckets(block, most_run, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for b, n in pieces.select("text", "own").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # ``buckets`` rows at most
        out[b] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log-ratio of the smoothed shares, rounded down."""
    n = len(raw)
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def importance_resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most_run: int = 2, buckets: int = 10_000, seed: int = 7, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score and rank (1, 2, ... of those drawn, else null).

    ``target``: the texts (column text) whose distribution the drawn documents shall approach.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(X.NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = chunks(texts, most_run, chunk_words)
    wanted = chunks(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), most_run, chunk_words)
    gains = bucket_gains(bucket_counts(pieces, most_run, buckets), bucket_counts(wanted, most_run, buckets))

    def weigh(batches):
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                of, found, own = feature_buckets(block, most_run, buckets)
                n = np.bincount(of, minlength=len(own))
                gain = np.bincount(of, weights=gains[found], minlength=len(own)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": block["doc_id"].combine_chunks(), "n_words": own, "n_features": n, "gain": gain})

    sums = pieces.select("doc_id", "own", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, gain long").groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    name = F.concat(F.lit(f"{seed}:"), F.when(F.col("doc_id") != X.NO_ID, F.col("doc_id").cast("string")).otherwise(""))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = sums.withColumn("weight", weight).withColumn("score", F.col("weight") + noise)
    scored = scored.select("doc_id", "n_words", "n_features", "weight", "score", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("less"))

    placed = X.cut(assign_positions(scored, "at", ["short", "less", "doc_id"]))  # a row for each document, without texts
    able = placed.where("not short").count()
    rank = F.when(F.col("at") < percent * able // 100, F.col("at") + 1)
    return X.with_null_ids(placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank")))


def resampled_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows without a doc_id are drawn together or not at all."""
    drawn = importance_resampled(docs, target, **how).where("rank is not null").select(F.col("doc_id").cast("long").alias("_drawn"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows, at = docs.toDF(*own), own[docs.columns.index("doc_id")]
    return rows.join(drawn, F.col(at).cast("long").eqNullSafe(F.col("_drawn")), "left_semi").toDF(*docs.columns)
