"""Lines as sets of words, held against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import line_dedup
from shelfspark.llm.line_dedup import removed_lines, without_repeated_lines
from shelfspark.llm.queries import op10_line_dedup

DOCS = "doc_id long, text string"


def gone_by_words(rows, percent, least):
    lines = []
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for i, line in enumerate(t.split("\n")):
            if len(w := line.lower().split()) >= least:
                lines.append(((d, i), set(w)))
    return {at for k, (at, s) in enumerate(lines) if any(100 * len(s & t) >= percent * len(s | t) for _, t in lines[:k])}


def line_rows(seed):
    """Lines of rare and frequent words, short to long, with changed, added, removed and moved words."""
    rng = random.Random(seed)
    words = [f"w{int(3 * 1.12 ** rng.randrange(60))}" for _ in range(300)] + [f"r{i}" for i in range(400)]
    common = [[rng.choice(words) for _ in range(n)] for n in [1, 2, 3, 4, 4, 5, 6, 8, 9, 10, 12, 18, 27, 33, 36, 45]]
    rows = []
    for d in rng.sample(range(10_000), 90):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            w = list(rng.choice(common)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(1, 40))]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k, what = rng.randrange(len(w)), rng.random()
                if what < 0.5:
                    w[k] = rng.choice(words)
                elif what < 0.8:
                    w.insert(k, rng.choice(words))
                elif len(w) > 1:
                    del w[k]
            if rng.random() < 0.1:
                rng.shuffle(w)
            lines.append(" ".join(w).title() if rng.random() < 0.2 else " ".join(w))
        rows.append((d, "\n".join(lines)))
    return [*rows, (20_000, None), (20_001, ""), (20_002, " \n\n")]


@pytest.mark.parametrize(("percent", "least", "many", "cells"), [(80, 5, 3, 1 << 10), (80, 1, 0, 1 << 17), (50, 1, 2, 1 << 17), (50, 1, 8, 4), (80, 1, 256, 1 << 17)])
def test_lines_by_words(spark, monkeypatch, percent, least, many, cells):
    """``many`` so small that lines meet at pairs of words, and at the earliest line of a pair first."""
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 32 << 20 if many > 3 else 0)
    rows = line_rows(percent + least)
    got = removed_lines(spark.createDataFrame(rows, DOCS), percent, least).collect()
    want = gone_by_words(rows, percent, least)
    assert {(r["doc_id"], i) for r in got for i in r["removed"]} == want and len(want) > 60
    assert {r["doc_id"]: r["n_lines"] for r in got} == {d: 0 if t is None else t.count("\n") + 1 for d, t in rows}


def test_texts_without_repeated_lines(spark):
    rows = line_rows(3)
    gone = gone_by_words(rows, 80, 1)
    texts = {r["doc_id"]: r["text"] for r in without_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert texts == {d: None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_odd_tables(spark):
    """No rows; null ids, which come last; rows of one id; extra columns of the operator's own names; white space of all kinds."""
    assert removed_lines(spark.createDataFrame([], DOCS)).count() == 0
    line = "one two three four five six"
    rows = [(None, line, 1, "a"), (3, f"{line}\n{line}", 2, "b"), (3, "\tsix\x0bFIVE  four\rthree two\fone \n\t", 3, None), (2, "", None, ""), (4, None, 1, "")]
    table = spark.createDataFrame(rows, DOCS + ", line_no long, removed string")
    assert sorted((r["doc_id"] or -1, r["n_lines"], r["removed"]) for r in removed_lines(table).collect()) == [(-1, 1, [0]), (2, 1, []), (3, 2, []), (3, 2, [1]), (4, 0, [])]


def test_very_long_texts(spark):
    """A line of 60,000 words, its copy with a tenth of the words changed, and a text of 20,000 lines."""
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:54_000], *(f"x{i}" for i in range(6_000))])), (3, "\n".join(f"line number{i // 2} of{i // 2}" for i in range(20_000)))]
    got = {r["doc_id"]: r["removed"] for r in removed_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [], 2: [0], 3: list(range(1, 20_000, 2))}


def test_query_finds_one_changed_word_in_nine(spark, tmp_path):
    line = "a b c d e f g h i j k l".split()
    rows = [(1, " ".join(line)), (2, " ".join([*line[:5], "z", *line[6:]]))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["removed_lines"] for r in op10_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0"}


def test_query_removes_repeats_of_short_lines(spark, tmp_path):
    rows = [(1, "one\ntwo words\n\none"), (2, "Two  words\n\nthree"), (3, "one two three four\nfour three two one")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["removed_lines"] for r in op10_line_dedup(spark, str(tmp_path)).collect()} == {1: "3", 2: "0", 3: "1"}


@pytest.mark.parametrize("words", [90, 180, 400])
def test_long_lines_that_share_few_words_are_not_verified(spark, monkeypatch, words):
    """120 long lines with thirty words in common; the signatures tell them apart, and a near copy is found."""
    rng = random.Random(words)
    lines = [[*(f"s{i}" for i in range(30)), *(f"w{rng.randrange(10**9)}" for _ in range(words - 30))] for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)] + [(500, " ".join([*lines[7][3:], "x", "y"]))]
    seen, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    monkeypatch.setattr(line_dedup, "rarity", lambda docs: F.split(F.lit(",".join(["0"] * line_dedup.CELLS)), ",").cast("array<long>"))
    got = {r["doc_id"]: r["removed"] for r in removed_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d for d, gone in got.items() if gone} == {500}
    assert sum(seen) < 120


def test_a_group_of_near_copies_meets_its_middle_first(spark, monkeypatch):
    """400 copies match a line that is not their earliest, and not each other; they are not paired with each other."""
    rng = random.Random(1)
    middle = [f"m{i}" for i in range(40)]
    copies = []
    for i in range(400):
        at = rng.sample(range(40), 3)
        copies.append([f"c{i}x{k}" if k in at else w for k, w in enumerate(middle)])
    rows = [(i, " ".join(w)) for i, w in enumerate([copies[0], middle, *copies[1:]])]
    seen, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    got = {(r["doc_id"], i) for r in removed_lines(spark.createDataFrame(rows, DOCS)).collect() for i in r["removed"]}
    assert got == gone_by_words(rows, 80, 1) and len(got) == 400
    assert sum(seen) < 2_000
