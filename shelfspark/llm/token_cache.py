"""Operator 6: token counts through a digest cache.

Method: the cache is a Parquet table (digest of the text, digest of the tokenizer,
n_tokens).  Texts meet it by digest; only digests that it lacks are encoded, once
each, and appended; then every document takes its count from the cache.  Another
tokenizer file has another digest, so its counts never mix with the old ones.

Content is the UTF-8 text as it stands: any further normalisation could change
counts.  Null counts as empty.

Counts are those of the ``tokenizers`` library.  For texts of ordinary Latin letters
the same vocabulary is run by ``tiktoken``, which gives the same counts several times
faster; texts with other characters, or with a special token's string, go to
``tokenizers`` itself.  The tests compare both.

Edge cases: null and empty texts have 0 tokens; repeated texts are encoded once; a
row that two runs appended to the cache counts once; null doc_ids are kept; other
columns are ignored; a very long text is encoded whole, in a block of its own; an empty
table encodes nothing.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import ship_package

from . import exchange as X
from . import words as W

CACHE = "digest binary, tokenizer string, n_tokens long"
_ORDINARY = re.compile("[\\x00-\\x7F\\u00A0-\\u024F]*")
_encoders: dict[str, object] = {}


class Encoder:
    """Counts tokens as the tokenizers library does, given a tokenizer's JSON."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(source)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = _byte_level_bpe(source)

    def count(self, texts: list[str]) -> list[int]:
        if self.fast is None:
            return self._counted(texts)
        plain = [bool(_ORDINARY.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self._counted([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [len(self.fast.encode_ordinary(t)) if p else next(rest) for t, p in zip(texts, plain, strict=True)]

    def _counted(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.exact.encode_batch(texts, add_special_tokens=False)] if texts else []


def _byte_level_bpe(source: str):
    """The vocabulary as ranks, if the file is a plain byte-level BPE; else None."""
    import json

    import tiktoken

    file = json.loads(source)
    model, splitter = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or splitter.get("use_regex") is False or file.get("normalizer"):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in file.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    if [vocabulary.get(a + b) for a, b in merges] != sorted(vocabulary[a + b] for a, b in merges if a + b in vocabulary):
        return None  # ids do not follow the order of merges
    ranks = {bytes(chars[c] for c in t): i for t, i in vocabulary.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_digest(source: str) -> str:
    """Names the tokenizer's version in the cache."""
    return hashlib.sha256(source.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty if nothing was written yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CACHE)


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(X.NO_ID)).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def encode_misses(docs: DataFrame, source: str, cache: str) -> None:
    """Append to the cache the counts of those texts that it lacks for this tokenizer."""
    spark, version = docs.sparkSession, tokenizer_digest(source)
    ship_package(spark)
    digested = _digested(docs)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    # Copies meet by digest, one of each task; so a text is one row, wherever its copies lie and however Spark joins.
    texts = digested.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    shared = spark.sparkContext.broadcast(source)

    def part(batches):
        if version not in _encoders:
            _encoders[version] = Encoder(shared.value)
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                counts = _encoders[version].count(block["text"].to_pylist())
                yield pa.RecordBatch.from_pydict({"digest": block["digest"].combine_chunks(), "tokenizer": pa.array([version] * len(counts), pa.string()), "n_tokens": pa.array(counts, pa.int64())})

    texts.mapInArrow(part, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, source: str, cache: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens under the tokenizer given as JSON.

    ``cache`` is a path that driver and executors share; by default a fresh one in
    spark.checkpoint.dir, so nothing is reused.
    """
    cache = cache or X.shared_path(docs.sparkSession)
    encode_misses(docs, source, cache)
    counts = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer_digest(source)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return X.with_null_ids(_digested(docs).select("doc_id", "digest", "n_bytes").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens"))
