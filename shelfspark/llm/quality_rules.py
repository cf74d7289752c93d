"""Operator 3: quality rules as a learned decision list.

Method: sequential covering.  On labelled documents' statistics a rule - a
conjunction of thresholds - is grown by information gain on two thirds of the
rows, pruned on the other third, and kept if it still is precise there; the rows
that it covers leave, and the next rule is grown.  The list becomes one ordered
Spark CASE expression over the statistics.

The learner sees at most ``most_labelled`` labelled rows (those whose doc_id hashes
least), so its work does not grow; statistics are computed for all documents.

Edge cases: a null or empty text has no words and fails the base rule; a
statistic is never null; without labels, or with labels of one kind, the list is
empty and only the base rule rejects; labels of documents that are absent are
unused, of contradicting labels the lowest quality counts, null labels do not;
repeated rows of the table are judged each, and a document is learned from once;
of conditions with equal gain the first by feature and threshold is taken, and a
value equal to a threshold is below it; a very long text is a block of its own,
whole; a column named like a statistic is replaced in :func:`judged` and kept by
:func:`kept_documents`; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.session import ship_package

from . import words as W

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long, n_pipes long"
SYMBOLS = W._flags(lambda b: b in b"#*$%&|<>")
UPPER = W._flags(lambda b: 65 <= b <= 90)
DIGIT = W._flags(lambda b: 48 <= b <= 57)
#: Exclamation and question marks.
MARKS = W._flags(lambda b: b in b"!?")
PIPES = W._flags(lambda b: b == 0x7C)
#: What the rules may ask: ratios of the statistics, so that a text's length matters only where it is meant.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "(n_symbols - n_pipes) / greatest(word_chars, 1)",
    "pipe_share": "n_pipes / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier key, occurs twice or more)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return later, twice


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ W.mix(doc.astype(np.uint64) + np.uint64(1)))


def text_statistics(column) -> dict[str, np.ndarray]:
    """The statistics of each text, for a block of texts at once."""
    data, bounds = W.text_bytes(column)
    words = W.split(data, bounds, W.SPACES)
    n = len(bounds) - 1

    def chars(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])

    found, at = W.windows(W.span_hashes(words), words.offsets, 3)
    twice = at[_again(_in_doc(found, words.doc[at]))[1]]
    cover = np.zeros(len(words.starts) + 3, bool)
    for k in range(3):
        cover[twice + k] = True
    lines = W.split(data, bounds, W.NEWLINE)
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    repeated = _again(_in_doc(W.span_hashes(lines), lines.doc))[0] & with_word
    return {
        "n_words": words.per_doc,
        "word_chars": chars(~W.SPACES[data] & ((data < 0x80) | (data >= 0xC0))),
        "n_symbols": chars(SYMBOLS[data]),
        "n_dup_lines": np.bincount(lines.doc[repeated], minlength=n),
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(cover)))[words.offsets]),
        "n_lines": np.bincount(lines.doc[with_word], minlength=n),
        "n_upper": chars(UPPER[data]),
        "n_digits": chars(DIGIT[data]),
        "n_marks": chars(MARKS[data]),
        "n_pipes": chars(PIPES[data]),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of ``text``; its other columns stay (a column of a statistic's name is replaced)."""
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in STATS.split(", ")]
    keep = docs.drop(*names)
    schema = StructType(list(keep.schema.fields))

    def part(batches):
        for batch in batches:
            for block in W.in_blocks(pa.Table.from_batches([batch]), "text"):
                stats = text_statistics(block["text"])
                table = pa.table({**{c: block[c] for c in block.column_names}, **{k: pa.array(stats[k], pa.int64()) for k in names}})
                yield from table.to_batches()

    for c in STATS.split(", "):
        schema = schema.add(*c.split())
    return keep.mapInArrow(part, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def _candidates(x: dict[str, np.ndarray], mask: np.ndarray, cuts: int = 32):
    for f, v in x.items():
        for t in np.unique(np.quantile(v[mask], np.linspace(0, 1, cuts + 1)[:-1])):
            yield Condition(f, True, float(t))
            yield Condition(f, False, float(t))


def _between(c: Condition, values: np.ndarray) -> Condition:
    """The condition with its threshold half-way between the values that it parts."""
    low, high = values[values <= c.threshold], values[values > c.threshold]
    return Condition(c.feature, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c


def _grow(x, bad, most: int) -> Rule:
    """A conjunction of at most ``most`` conditions, each the one of greatest information gain."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 0.0
        for c in _candidates(x, inside):
            into = inside & c.holds(x)
            q, m = bad[into].sum(), (~bad[into]).sum()
            if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain + 1e-9:
                best, gain = c, g
        if best is None:
            break
        best = _between(best, x[best.feature][inside])
        rule = (*(c for c in rule if (c.feature, c.above) != (best.feature, best.above)), best)  # the narrower threshold implies the wider
        inside &= best.holds(x)
    return rule


def _value(rule: Rule, x, bad) -> float:
    inside = _covers(rule, x, len(bad))
    q, m = bad[inside].sum(), (~bad[inside]).sum()
    return (q - m) / (q + m) if q + m else -1.0


def learn_decision_list(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray, most_conditions: int = 3, most_rules: int = 12, precision: float = 0.9) -> list[Rule]:
    """Rules, in order, each rejecting what it covers. ``order`` splits the rows: every third prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prune_rows = order % 3 == 2
    while len(rules) < most_rules:
        pick = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        (gx, gbad), (px, pbad) = pick(left & ~prune_rows), pick(left & prune_rows)
        if not gbad.any() or gbad.all():
            break
        rule = _grow(gx, gbad, most_conditions)
        while len(rule) > 1 and _value(rule[:-1], px, pbad) >= _value(rule, px, pbad):
            rule = rule[:-1]
        covered = _covers(rule, px, len(pbad))
        if not rule or not covered.any() or pbad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def verdict_column(rules: list[Rule]) -> Column:
    """True for a document that no rule rejects: an ordered CASE."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(False)).otherwise(out)
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **how) -> list[Rule]:
    """The decision list learned from ``labels`` (doc_id, quality) on statistics of ``docs``.

    At most ``most_labelled`` labels are used. Where rows share a doc_id, its lowest label and the
    least of each feature count, so a document is one row however often it occurs.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # at most most_labelled rows: may be broadcast
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), *(F.min(F.expr(e)).alias(f) for f, e in FEATURES.items())).orderBy("doc_id").toPandas()
    if rows.empty:
        return []
    x = {f: rows[f].to_numpy(float) for f in FEATURES}
    return learn_decision_list(x, rows["quality"].to_numpy() == 0, np.arange(len(rows)), **how)


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with statistics, base_failed and kept."""
    rules = learn_rules(docs, labels, **how)
    return with_statistics(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & verdict_column(rules))


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns unchanged, whatever these are called."""
    own = {c if c in ("doc_id", "text") else f"c{i}": c for i, c in enumerate(docs.columns)}
    return judged(docs.toDF(*own), labels, **how).where("kept").select(*(F.col(k).alias(c) for k, c in own.items()))
