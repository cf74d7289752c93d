"""Operator 11: document quality from a linear-chain conditional random field over lines.

Method: every line with a word is good or bad.  A line's features are shares of its
characters and words (symbols, capitals, repetitions and so on) and those of the lines before
and after it; a matrix of transitions ties neighbouring labels.  Forward-backward gives each
line's probability of being good; a document's score is their mean, weighted by the lines'
lengths in bytes.

The field is fitted by conditional likelihood, with every line labelled as its document is,
on a bounded sample: labelled documents in the order of a hash of their doc_id, at most
``most_labelled`` of them with at most ``most_lines`` lines together.  Each document weighs the
same, whatever its lines.  Tasks compute the sample's features; the driver gets these numbers alone, no
texts.  The doc_id chooses the sample and is no input of a score.

The messages of all chains of a block are found together: prefix products of two-by-two
matrices, doubled in length step by step, so a text of a million lines takes twenty steps.

Edge cases: a text without words (null and empty ones too) has no lines and gets the
share of good documents in the sample; without labels in the training folds, or with those of one kind, every
score is that share, or 0.5 if there are none; of contradicting labels the lowest counts, null
labels do not; rows that share a doc_id are scored each, and one of them is learned from; null doc_ids are scored, and
are not held out; a very long text is a block of its own, whole; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import ship_package

from . import words as W

SYMBOLS = W._flags(lambda b: b in b"#*$%&<>@^~=_{}[]\\")
#: Characters whose shares of a line's characters are features.
CLASSES = {
    "symbols": SYMBOLS,
    "pipes": W._flags(lambda b: b == 0x7C),
    "marks": W._flags(lambda b: b in b"!?"),
    "capitals": W._flags(lambda b: 65 <= b <= 90),
    "digits": W._flags(lambda b: 48 <= b <= 57),
    "stops": W._flags(lambda b: b in b".,;:"),
}
#: Features of a line alone: these shares, then the others in :func:`line_features`.
OWN = len(CLASSES) + 6
FEATURES = 3 * OWN + 3
SAMPLE = "doc_id long, quality int, n_lines long, packed binary"


@dataclass(frozen=True)
class Lines:
    """The lines with a word of a block of texts."""

    features: np.ndarray
    length: np.ndarray
    offsets: np.ndarray


def _soft(share: np.ndarray, half: float) -> np.ndarray:
    """From 0 to 1; a half at ``half``, so that small shares can be told apart."""
    return share / (share + half)


def line_features(column) -> Lines:
    data, bounds = W.text_bytes(column)
    words = W.split(data, bounds, W.SPACES)
    lines = W.split(data, bounds, W.NEWLINE)
    first, last = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    full = last > first
    first, last, starts, ends = first[full], last[full], lines.starts[full], lines.ends[full]
    offsets = np.concatenate(([0], np.cumsum(full)))[lines.offsets]
    n = (last - first).astype(float)

    def total(values):
        return np.concatenate(([0], np.cumsum(values)))

    def chars(flags):
        t = total(flags[data])
        return (t[ends] - t[starts]).astype(float)

    solid = np.maximum(chars(~W.SPACES), 1)
    of = np.repeat(np.arange(len(n)), last - first)
    hashes = W.span_hashes(words, W.LOWER)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    size = words.ends - words.starts
    per_line = lambda flag: np.diff(total(flag)[np.append(first, len(flag))]) if len(first) else np.zeros(0)
    shares = [_soft(chars(flags) / solid, 0.05) for flags in CLASSES.values()]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    own = np.stack(
        [
            *shares,
            _soft(per_line(same) / np.maximum(n, 1), 0.2),
            _soft(per_line(again) / np.maximum(n, 1), 0.5),
            _soft(per_line(size == 1) / np.maximum(n, 1), 0.2),
            np.clip(solid / np.maximum(n, 1) / 10, 0, 3),
            np.log1p(n) / 5,
            _earlier(W.span_hashes(W.Spans(data, starts, ends, offsets)), doc),
        ],
        axis=1,
    )
    out = np.zeros((len(n), FEATURES))
    out[:, 0] = 1
    out[:, 1 : OWN + 1] = own
    joined = np.flatnonzero(doc[1:] == doc[:-1])
    out[joined + 1, OWN + 1 : 2 * OWN + 1] = own[joined]
    out[joined, 2 * OWN + 1 : 3 * OWN + 1] = own[joined + 1]
    edges = np.ones((len(n), 2))
    edges[joined + 1, 0], edges[joined, 1] = 0, 0
    out[:, 3 * OWN + 1 :] = edges
    return Lines(out, (ends - starts).astype(float), offsets)


def _earlier(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 for a line that equals an earlier one of its text."""
    order = np.lexsort((np.arange(len(doc)), hashes, doc))
    out = np.zeros(len(doc))
    out[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return out


@dataclass
class Field:
    """Weights of the features for the label good, and of the transitions (from, to), both 0: bad, 1: good."""

    weights: np.ndarray
    steps: np.ndarray
    prior: float

    def marginals(self, lines: Lines) -> np.ndarray:
        """The probability that each line is good."""
        into, out = messages(lines.features @ self.weights, self.steps, lines.offsets)
        return into[1] * out[1] / (into * out).sum(0)

    def scores(self, lines: Lines) -> np.ndarray:
        """A document's mean marginal by its lines' lengths."""
        n = len(lines.offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(lines.offsets))
        weight = np.bincount(doc, weights=lines.length, minlength=n)
        good = np.bincount(doc, weights=lines.length * self.marginals(lines), minlength=n)
        return np.where(weight > 0, np.clip(good / np.maximum(weight, 1), 0, 1), self.prior)


def _odds_of_both(odds: np.ndarray) -> np.ndarray:
    """exp(0) and exp(odds) for the labels bad and good, the greater one scaled to 1."""
    return np.stack([np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))])


def messages(odds: np.ndarray, steps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each label and line the normalised forward message (with the line's own features) and the backward one (without)."""
    sizes = np.diff(offsets)
    place = np.arange(len(odds)) - np.repeat(offsets[:-1], sizes)
    left = np.repeat(sizes, sizes) - 1 - place
    by_line = np.exp(steps - steps.max())[:, :, None] * _odds_of_both(odds)  # (label before, own label, line)
    begin = np.where(place == 0, np.eye(2)[:, :, None] * _odds_of_both(odds), by_line)
    into = _products(begin, place).sum(0)
    # A line's backward message sums its successor's matrix and all that follow.
    rest = _products(by_line.swapaxes(0, 1)[:, :, ::-1], left[::-1])[:, :, ::-1].sum(0)
    out = np.ones((2, len(odds)))
    inner = np.flatnonzero(left > 0)
    out[:, inner] = rest[:, inner + 1]
    return into / into.sum(0), out / out.sum(0)


def _products(matrices: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The product of each chain's matrices (row, column, line) up to and with each place, up to a factor."""
    out, reach = matrices / matrices.max((0, 1)), 1
    at = np.arange(len(place))
    while len(at := at[place[at] >= reach]):
        before, own = out[:, :, at - reach], out[:, :, at]
        joint = before[:, 0, None] * own[None, 0] + before[:, 1, None] * own[None, 1]
        out[:, :, at] = joint / joint.max((0, 1))
        reach *= 2
    return out


def fit(features: np.ndarray, offsets: np.ndarray, good: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 3e-4, step_ridge: float = 0.02) -> Field:
    """Conditional likelihood by gradient steps with per-weight rates (Adam), with a ridge."""
    sizes = np.diff(offsets)
    label = np.repeat(good, sizes).astype(float)
    share = float(good.mean()) if len(good) else 0.5
    if not len(label) or share in (0.0, 1.0):
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), share)
    weight = np.repeat(1 / (np.maximum(sizes, 1) * len(good)), sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(doc[1:] == doc[:-1])  # lines with a successor
    same = label[inner] == np.array([[0.0], [1.0]])
    seen = np.zeros((2, 2))
    seen[[0, 1], [0, 1]] = (same * weight[inner]).sum(1)  # a document's lines share its label
    x = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        w, steps = x[:FEATURES], x[FEATURES:].reshape(2, 2)
        odds = features @ w
        into, out = messages(odds, steps, offsets)
        p = into[1] * out[1] / (into * out).sum(0)
        joint = into[:, None, inner] * np.exp(steps - steps.max())[:, :, None] * (_odds_of_both(odds) * out)[None, :, inner + 1]
        expected = (joint * (weight[inner] / joint.sum((0, 1)))).sum(2)
        slope = np.concatenate((features.T @ ((label - p) * weight) - ridge * w, (seen - expected - step_ridge * steps).ravel()))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        x = x + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Field(x[:FEATURES], x[FEATURES:].reshape(2, 2), share)


def _features(docs: DataFrame, schema: str, row) -> DataFrame:
    """``row(block, lines)`` gives the columns of ``schema`` for each block of texts."""
    ship_package(docs.sparkSession)

    def part(batches):
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                yield pa.RecordBatch.from_pydict(row(block, line_features(block["text"])))

    return docs.mapInArrow(part, schema)


def learn_field(docs: DataFrame, labels: DataFrame, held_out: Column, most_labelled: int = 4000, most_lines: int = 40_000) -> Field:
    """The field learned from ``labels`` (doc_id, quality) of documents that are not held out.

    At most ``most_labelled`` documents with ``most_lines`` lines together are used, in the order of
    a hash of their doc_id.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # at most most_labelled rows: may be broadcast

    def row(block, lines):
        packed = [lines.features[a:b].astype(np.float32).tobytes() for a, b in zip(lines.offsets[:-1], lines.offsets[1:], strict=True)]
        return {"doc_id": block["doc_id"].combine_chunks(), "quality": block["quality"].combine_chunks().cast(pa.int32()), "n_lines": np.diff(lines.offsets), "packed": pa.array(packed, pa.binary())}

    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    rows = _features(labelled, SAMPLE, row).groupBy("doc_id").agg(F.min(F.struct("n_lines", "packed", "quality")).alias("d")).select("doc_id", "d.*")
    upto = F.sum("n_lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # most_labelled rows
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= most_lines).orderBy("upto", "doc_id").select("quality", "n_lines", "packed").collect()
    features = np.frombuffer(b"".join(r["packed"] for r in rows), np.float32).reshape(-1, FEATURES).astype(float)
    return fit(features, np.concatenate(([0], np.cumsum([r["n_lines"] for r in rows]))).astype(np.int64), np.array([r["quality"] == 1 for r in rows], bool))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = 0.7, **how) -> DataFrame:
    """Per document: doc_id, held_out, n_lines, n_good (lines likelier good than bad), score and predicted (1 if the score is ``least`` or more).

    ``held_out``: a condition on doc_id; rows for which it holds are not learned from.
    """
    flag = F.coalesce(held_out, F.lit(False))
    field = learn_field(docs, labels, flag, **how)

    def row(block, lines):
        doc = np.repeat(np.arange(block.num_rows), np.diff(lines.offsets))
        good = np.bincount(doc, weights=field.marginals(lines) > 0.5, minlength=block.num_rows).astype(np.int64)
        score = field.scores(lines)
        return {"doc_id": block["doc_id"].combine_chunks(), "held_out": block["held_out"].combine_chunks(), "n_lines": np.diff(lines.offsets), "n_good": good, "score": score, "predicted": pa.array(score >= least).cast(pa.int32())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), flag.alias("held_out"))
    return _features(rows, "doc_id long, held_out boolean, n_lines long, n_good long, score double, predicted int", row)


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """Per line with a word: doc_id, line (its number among these, from 0) and good, the probability that it is."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def row(block, lines):
        sizes = np.diff(lines.offsets)
        doc = np.repeat(np.arange(block.num_rows), sizes)
        return {"doc_id": block["doc_id"].combine_chunks().take(pa.array(doc)), "line": np.arange(len(doc)) - np.repeat(lines.offsets[:-1], sizes), "good": field.marginals(lines)}

    return _features(rows, "doc_id long, line long, good double", row)
