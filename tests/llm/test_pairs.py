"""Near duplicates, repeated spans and repeated lines, held against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from shelfspark.llm import exchange
from shelfspark.llm.components import components
from shelfspark.llm.ngram_join import ngram_jaccard_components, prefix
from shelfspark.llm.substring_dedup import levels, remove_repeated_spans

DOCS = "doc_id long, text string"


@pytest.fixture
def small_blocks(monkeypatch):
    """So many origins and buckets that every exchange has something to do."""
    monkeypatch.setattr(exchange, "ORIGIN_BYTES", 20_000)
    monkeypatch.setattr(exchange, "BUCKET_HASHES", 3_000)


def near_copies(n, seed, vocabulary=300, length=120):
    """Variants of one text with 0 to 8 edits, unrelated texts, exact copies and odd cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    base = [rng.choice(words) for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            k = rng.randrange(len(w))
            if rng.random() < 0.6:
                w[k] = rng.choice(words)
            elif rng.random() < 0.5:
                w.insert(k, rng.choice(words))
            else:
                del w[k]
        rows.append((rng.randrange(10**9), " ".join(w).replace(" w1", "\nW1")))
    odd = ["", None, "  \t", "a b", "A  B", "a b c d e f", "a b c d e f", "ünï cödé", "x " * 3000]
    return rows + [(10**9 + i, t) for i, t in enumerate(odd)]


def linked(rows, width, percent):
    sets = defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            sets[d] |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}
    least = {d: d for d, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    by_shingle, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            by_shingle[g].append(d)
    for ids in by_shingle.values():
        shared.update(combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in least}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_copies(spark, small_blocks, width, percent):
    rows = near_copies(220, width)
    got = ngram_jaccard_components(spark.createDataFrame(rows, DOCS), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows, width, percent) and len(got) == len(rows)


def test_near_copies_odd_tables(spark):
    assert ngram_jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (9, None)]
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS + ", n long, component_id string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_jaccard_components(table).collect())
    assert got == [(-1, 7), (7, 7), (7, 7), (9, 9)]


def test_documents_of_several_texts(spark):
    """A document is linked by each of its texts, also one whose other text is a copy; null ids are one document."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (8, two + " end"), (9, three), (None, three), (None, "x y z a b c"), (20, "x y z a b c"), (30, "q r s t u"), (31, None), (31, "")]
    got = {(r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 36, 1), (5, 36, 1), (8, 37, 1), (9, 36, 9), (-1, 36, 9), (20, 2, 9), (30, 1, 30), (31, 0, 31)}


def test_prefix_lengthens_where_candidates_are_many():
    import numpy as np

    assert prefix(np.ones(100, np.uint8), 80) == (1, 21)
    ell, length = prefix(np.full(100, 12, np.uint8), 80)
    assert ell > 1 and length == 100 - 80 + ell
    assert prefix(np.array([5], np.uint8), 80) == (1, 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["doc_id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    least = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert got == {v: m for v, m in least.items() if any(a != b and v in (a, b) for a, b in edges)}


def spans(rows, width):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("start", [1, 2, 7, 13])
def test_repeated_spans(spark, small_blocks, start):
    rows = near_copies(120, 11)
    got = remove_repeated_spans(spark.createDataFrame(rows, DOCS), 13, start).collect()
    assert sorted(map(tuple, got), key=str) == spans(rows, 13)


def test_repeated_spans_odd_tables(spark):
    assert remove_repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    table = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (5, None, 4)], DOCS + ", n_words long")
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in remove_repeated_spans(table).collect()))
    assert got == [(-1, 20, 20), (4, 20, 0), (4, 20, 0), (5, 0, 0)]


def test_levels():
    assert levels(7, 13) == [7, 13] and levels(2, 13) == [2, 4, 8, 13] and levels(20, 13) == [13]


def test_kept_text_digest_is_of_utf8(spark):
    from pyspark.sql import functions as F

    got = remove_repeated_spans(spark.createDataFrame([(1, "é  ü\nx")], DOCS)).select(F.sha2("kept_text", 256)).first()[0]
    assert got == hashlib.sha256("é ü x".encode()).hexdigest()


def test_windows_need_the_same_order_of_words(spark):
    words = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(reversed(words)))]
    assert [r["n_removed"] for r in remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()] == [0, 0]
