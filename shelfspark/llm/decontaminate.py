"""Operator 7: benchmark passages inside documents, by winnowing.

Method: of every ``span - k + 1`` consecutive k-word hashes the smallest is a
fingerprint, so any shared run of ``span`` words or more shares one.  Where a
document's fingerprint is also a benchmark fingerprint, the hit is extended: the
whole run of ``span`` words around it is compared, by 128 bits of two hash families
(the second is taken only of texts with a hit).  Items shorter than ``span``
words are compared as a whole, at their own length.

A benchmark of at most ``BROADCAST_BYTES`` of text (checked) goes to every task.
A larger one is joined: fingerprints of both sides by shuffle, then each document
is scored against those items that share a fingerprint with it.

Edge cases: null and empty texts have no words; items without words or without id
are left out; repeated items count once; a null doc_id is returned as it is; a very long
text is a block of its own, whole; other columns are ignored; empty documents or an empty benchmark give no rows or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import ship_package

from . import exchange as X
from . import words as W

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>"
BROADCAST_BYTES = 32 << 20


def words_of(column) -> W.Spans:
    return W.split(*W.text_bytes(column), W.NON_WORD)


def fingerprints(hashes: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``span`` words within a text: its fingerprint, and where it starts."""
    grams, _ = W.windows(hashes, np.array([0, len(hashes)]), k)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, span - k + 1):
        np.minimum(least, grams[i : i + n], out=least)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(span, n + span) <= ends)
    return least[at], at


class Index:
    """Fingerprints and runs of a set of items."""

    def __init__(self, ids: list[int], texts: list[str], span: int, k: int):
        self.span, self.k = span, k
        words = words_of(pa.array(texts, pa.large_string()))
        h, second, offsets = W.span_hashes(words, W.LOWER), W.span_hashes(words, W.LOWER_2), words.offsets
        sizes, owner = np.diff(offsets), np.array(ids, np.int64)
        self.marks = np.unique(fingerprints(h, offsets, span, k)[0])
        #: By length: the runs' hashes (sorted), their hashes of the second family, and the items that hold them.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in [*{int(n) for n in sizes if 0 < n < span}, span]:
            found, at = W.windows(h, offsets, width)
            doc = np.searchsorted(offsets, at, "right") - 1
            whole = (sizes[doc] == width) | (width == span)
            rows = np.unique(np.stack([found, W.windows(second, offsets, width)[0], owner[doc].view(np.uint64)])[:, whole], axis=1)
            if rows.shape[1]:
                self.runs[width] = rows[0], rows[1], rows[2].view(np.int64)

    def hits(self, words: W.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of hit words by text, text and item of each occurrence)."""
        hashes, offsets, second = W.span_hashes(words, W.LOWER), words.offsets, None
        cover, docs, items = np.zeros(len(hashes) + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, (runs, runs_2, owner) in self.runs.items():
            if width == self.span:
                marks, at = fingerprints(hashes, offsets, self.span, self.k)
                at = at[_member(marks, self.marks)]
                full = run_hashes(hashes, at, width)
            else:
                full, at = W.windows(hashes, offsets, width)
            lo, hi = np.searchsorted(runs, full, "left"), np.searchsorted(runs, full, "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            if second is None:
                second = W.span_hashes(words, W.LOWER_2)
            run = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            same = runs_2[run] == run_hashes(second, at, width)
            at, run = at[same], run[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
            docs.append(np.searchsorted(offsets, at, "right") - 1)
            items.append(owner[run])
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        return np.diff(covered[offsets]), np.concatenate(docs), np.concatenate(items)


def run_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """As ``words.windows`` gives them, for the runs that start at ``at`` alone."""
    total = hashes[at]
    for j in range(1, width):
        total = total * W._ROLL + hashes[at + j]
    return W.mix(total + np.uint64(width))


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _scored(ids, words: W.Spans, index: Index) -> dict:
    n_hit, docs, items = index.hits(words)
    lists: list[list[int]] = [[] for _ in range(len(n_hit))]
    if len(docs):
        for d, i in np.unique(np.stack([docs, items]), axis=1).T.tolist():
            lists[d].append(i)
    return {"doc_id": ids, "n_words": words.per_doc, "n_hit": n_hit, "item_ids": pa.array(lists, pa.list_(pa.int64()))}


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: n_words, n_hit (words inside any run of ``span`` words that an item holds) and those items' ids."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    if (items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0) > broadcast_bytes:
        return _joined(docs, items, span, k)
    rows = items.collect()  # bounded by the check above
    shared = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def part(batches):
        index = Index(*shared.value, span, k)
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                out = _scored(block["doc_id"].combine_chunks(), words_of(block["text"]), index)
                yield pa.RecordBatch.from_pydict({n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in out.items()})

    return docs.mapInArrow(part, SCHEMA)


def _joined(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """The same for a benchmark of any size."""

    def marks(batches, lengths, name):
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                words = words_of(block["text"])
                h, offsets = W.span_hashes(words, W.LOWER), words.offsets
                sizes, ids, pairs = np.diff(offsets), block[name].to_numpy(), []
                for width in [*lengths, span]:
                    found, at = fingerprints(h, offsets, span, k) if width == span else W.windows(h, offsets, width)
                    doc = np.searchsorted(offsets, at, "right") - 1
                    if name == "item_id" and width < span:
                        found, doc = found[sizes[doc] == width], doc[sizes[doc] == width]
                    pairs.append(np.unique(np.stack([found + np.uint64(width), doc.astype(np.uint64)]), axis=1))
                mark, doc = np.concatenate(pairs, axis=1)
                yield pa.RecordBatch.from_pydict({"mark": pa.array(mark.view(np.int64)), "id": pa.array(ids[doc.astype(np.int64)], pa.int64())})

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array(words_of(batch["text"]).per_doc, pa.int64())})

    lengths = [r["n"] for r in items.mapInArrow(counted, "n long").where(f"n > 0 and n < {span}").distinct().collect()]  # fewer than span numbers
    known = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(X.NO_ID)))
    left = known.mapInArrow(lambda b: marks(b, lengths, "doc_id"), "mark long, id long").select("mark", F.col("id").alias("doc_id"))
    right = items.mapInArrow(lambda b: marks(b, lengths, "item_id"), "mark long, id long").select("mark", F.col("id").alias("item_id")).distinct()
    pairs = left.join(right, "mark").select("doc_id", "item_id").distinct()
    plan = X.Plan(docs)
    side = pairs.join(items, "item_id").select(X.origin_of(F.when(F.col("doc_id") != X.NO_ID, F.col("doc_id")), plan.origins).alias("origin"), "doc_id", "item_id", "text")

    def score(origin, table, side):
        # one index for all documents of the origin: what occurs in a document shares a fingerprint with it, so it is here
        items = pa.table({"item_id": side["item_id"], "text": side["text"]}).group_by(["item_id", "text"]).aggregate([])
        return pa.table(_scored(table["doc_id"], words_of(table["text"]), Index(items["item_id"].to_pylist(), items["text"].to_pylist(), span, k)))

    return X.with_null_ids(X.with_side(X.by_origin(docs.where("doc_id is not null"), plan), side, score, SCHEMA)).unionByName(
        _null_ids(docs, items, span, k)
    )


def _null_ids(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """Documents without an id: each gets a number of its own for the join."""
    some = docs.where("doc_id is null")
    if some.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    numbered = X.cut(some.withColumn("doc_id", F.monotonically_increasing_id()))
    return _joined(numbered, items, span, k).withColumn("doc_id", F.lit(None).cast("long"))
