"""Line labels (11), collocations (12) and importance resampling (13) against plain Python."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import collocations as C
from shelfspark.llm import importance as I
from shelfspark.llm import line_crf as L
from shelfspark.llm import words as W
from shelfspark.llm.decontaminate import Index, benchmark_hits, words_of
from shelfspark.llm.lm_scoring import class_model_scores
from shelfspark.llm.mixing import sampled_copies

DOCS = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(n, seed=0, words=60, longest=60):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "und", "Ünï", "x", "naïve", "a|b", *(f"w{i}" for i in range(words))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randrange(longest))
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".\r\n"]) for x in w), rng.choice(["en", "de", None])))
    return [*rows, (n, None, "en"), (n + 1, "", None), (n + 2, " \n", "de"), (n + 3, "日本 語 " * 30, "ja"), (None, "The of the of", "en"), (None, "x", None), (n + 4, "x " * 3000 + "y" * 300, "en"), (0, "twice the of", "en")]


# ---- 11: labels of lines


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(3)
    odds, steps, offsets = rng.normal(size=11) * 3, rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 11])
    into, out = L.messages(odds, steps, offsets)
    found = into[1] * out[1] / (into * out).sum(0)
    for lo, hi in itertools.pairwise(offsets):
        total, good = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=int(hi - lo)):
            e = math.exp(sum(odds[lo + i] * v for i, v in enumerate(y)) + sum(steps[a, b] for a, b in itertools.pairwise(y)))
            total, good = total + e, good + e * np.array(y)
        assert np.allclose(good / total, found[lo:hi])


def test_marginals_of_a_very_long_text_stay_finite():
    field = L.Field(np.random.default_rng(1).normal(size=L.FEATURES), np.array([[2.0, -2.0], [-2.0, 2.0]]), 0.5)
    lines = L.line_features(pa.array(["a b c\nD!! E!!\n" * 20_000, None, "x"]))
    p = field.marginals(lines)
    assert np.isfinite(p).all() and len(p) == 40_001
    scores = field.scores(lines)
    assert scores[1] == 0.5 and ((scores >= 0) & (scores <= 1)).all()


def test_the_gradient_leads_to_the_greatest_likelihood():
    """At the fitted weights, no single weight raises the penalised likelihood of a small sample."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 5, 30)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    good = rng.random(30) < 0.6
    features = rng.normal(size=(offsets[-1], L.FEATURES)) + np.repeat(good, sizes)[:, None] * 0.3
    ridge, step_ridge = 0.05, 0.05
    field = L.fit(features, offsets, good, rounds=600, rate=0.05, ridge=ridge, step_ridge=step_ridge)

    def value(w, steps):
        out = -ridge / 2 * (w @ w) - step_ridge / 2 * (steps**2).sum()
        for (lo, hi), y in zip(itertools.pairwise(offsets), good.astype(int)):
            odds, n = features[lo:hi] @ w, hi - lo
            total = sum(math.exp(sum(odds[i] * v for i, v in enumerate(z)) + sum(steps[a, b] for a, b in itertools.pairwise(z))) for z in itertools.product((0, 1), repeat=int(n)))
            # A line's share in its document's likelihood is what the marginals' gradient adds up to.
            out += (odds.sum() * y + steps[y, y] * (n - 1) - math.log(total)) / n / len(good)
        return out

    best = value(field.weights, field.steps)
    for k in range(0, L.FEATURES, 5):
        for d in (-0.05, 0.05):
            w = field.weights.copy()
            w[k] += d
            assert value(w, field.steps) < best + 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        for d in (-0.05, 0.05):
            s = field.steps.copy()
            s[i, j] += d
            assert value(field.weights, s) < best + 1e-6


def labelled(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        line = lambda: " ".join(rng.choice(["the", "sea", "was", "calm,", "over", "hills."]) for _ in range(rng.randrange(3, 9)))
        lines = [line() if good or k == 0 else line().upper().replace(" ", "!! ") for k in range(rng.randrange(2, 7))]
        rows.append((i, "\n".join(lines), good))
    return rows


def test_quality_scores_on_held_out_documents(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t, _ in rows] + [(None, "calm sea", 1, "y"), (1000, None, 1, "y"), (1001, "", 1, "y"), (3, rows[3][1], 1, "z")], "doc_id long, text string, score int, n_lines string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows] + [(0, 0), (5000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = L.quality_scores(docs, labels, held).collect()
    assert len(out) == 404
    truth = {i: g for i, _, g in rows}
    told = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in told} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r["predicted"] == 1) == truth[r["doc_id"]] for r in told) >= 0.95 * len(told)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    empty = [r["score"] for r in out if r["doc_id"] in (1000, 1001)]
    assert empty[0] == empty[1] and 0.5 < empty[0] < 0.9
    assert not next(r for r in out if r["doc_id"] is None)["held_out"]
    # The label of a held-out document does not reach the model.
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = L.quality_scores(docs, flipped, held).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in out)


def test_quality_scores_without_labels_or_rows(spark):
    held = F.lit(False)
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in L.quality_scores(docs, none, held).collect()] == [0.5, 0.5]
    one_kind = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["doc_id"]: r["score"] for r in L.quality_scores(docs, one_kind, held).collect()}[2] == 1.0
    assert L.quality_scores(docs.where("false"), none, held).collect() == []


def test_line_labels_name_the_bad_lines(spark):
    rows = labelled(300, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    field = L.learn_field(docs, spark.createDataFrame([(i, int(g)) for i, _, g in rows], "doc_id long, quality int"), F.lit(False))
    mixed = spark.createDataFrame([(1, "\n".join(["the sea was calm"] * 4 + ["THE!! SEA!! WAS!!"] * 4) + "\n\n ")], "doc_id long, text string")
    good = [r["good"] for r in L.line_labels(mixed, field).orderBy("line").collect()]
    assert len(good) == 8 and good[0] > 0.5 > good[7]


# ---- 12: collocations


def plain_collocations(rows, least, most, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        able = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                continue
            score, _, l, r = min((Fraction(1000 * a * n[lang], c[p[:k]] * c[p[k:]]).__floor__(), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("split", [500_000, 7])
def test_collocations(spark, split):
    """The same phrases whether or not frequent words' fragments are dealt to several partitions."""
    rows = prose(250, seed=2)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit("r"), "n": F.lit(1), "word": F.lit("w"), "bucket": F.lit(0)}).repartition(5)
    found = C.collocations(docs, least=4, most_words=5, top=60, split=split)
    expected = plain_collocations(rows, 4, 5, 60)
    assert len(expected) > 60 and sorted(map(tuple, found.collect())) == expected


def test_only_fragments_are_numbered(monkeypatch):
    """Words of no fragment take no part in the numbering of runs, whose memory is then that of the fragments."""
    table = pa.table({"doc_id": [1], "text": ["x y " + " ".join(f"w{i}" for i in range(500))], "lang": ["en"]})
    words, sizes = C.distinct_words(C.tokens_of(table)), []
    answered = np.array([100 if k.as_py() in ("en\tx", "en\ty") else 1 for k in words.keys])
    numbered = C._numbered
    monkeypatch.setattr(C, "_numbered", lambda keys: sizes.append(len(keys)) or numbered(keys))
    found = C.fragments_of(table, answered, 50, 5, 3, 500_000)
    assert b"".join(found["texts"].to_pylist()) == b"x y\n" and sizes[0] == 502 and max(sizes[1:]) <= 2


def test_collocations_of_repeats_and_other_lengths(spark):
    rows = [(i, "a a a a a b a a. New York City New York City", "en") for i in range(9)] + [(50, "a,a;a b c", "fr")]
    docs = spark.createDataFrame(rows, DOCS)
    for most, percent in ((2, 100), (3, 100), (4, 60)):
        found = C.collocations(docs, least=9, most_words=most, top=100, absorb_percent=percent)
        assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 9, most, 100, percent)
    assert C.collocations(docs.where("false")).collect() == []


def test_a_fragment_reaches_to_rarer_words():
    rank = np.array([5, 3, 4, -1, 3, 3, 9, 3])
    piece = np.array([0, 0, 0, 0, 0, 0, 0, 1])
    before, after = C.reach(rank, piece, 3)
    assert before.tolist() == [0, 1, 0, 0, 0, 0, 0, 0] and after.tolist() == [0, 1, 0, 0, 2, 1, 0, 0]


# ---- 13: importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most=2):
    w = WORD.findall(lower(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain_resampling(rows, target, percent, least, most=2, buckets=10_000, seed=7):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    own = defaultdict(lambda: [0, []])
    for d, text, *_ in rows:
        w, f = features(text, most)
        own[d][0] += len(w)
        own[d][1] += map(crc, f)
    s, t = Counter(b for _, f in own.values() for b in f), Counter(crc(f) for text in target for f in features(text, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = {}
    for d, (n, f) in own.items():
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out[d] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-v[3], d is None, d or 0, d) for d, v in out.items() if v[0] >= least)
    rank = {d: i for i, (*_, d) in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((str(d), *v, rank.get(d)) for d, v in out.items())


@pytest.mark.parametrize(("most", "chunk"), [(2, 8192), (2, 1), (2, 5), (3, 7), (1, 3)])
def test_importance_resampling(spark, most, chunk):
    """The same draw whatever the length of chunks."""
    rows = prose(120, seed=4) + [(900, "-", "en"), (901, "The of " * 400, "en"), (902, "?" * 500, "en")]
    target = ["the of the of w3 w4", None, "w1 " * 50, "z"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit("r"), "weight": F.lit(1), "own": F.lit("o"), "first": F.lit(0)}).repartition(4)
    found = I.importance_resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=40, least_words=3, most_run=most, chunk_words=chunk)
    ours = sorted((str(r["doc_id"]), r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    assert ours == plain_resampling(rows, target, 40, 3, most)


def test_resampling_leans_to_the_target(spark):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k) % 9}" for k in range(40)), "en") for i in range(200)]
    docs, target = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a1 a2 a3 a4 a5 a6 a7 a8 a0 " * 20,)], "text string")
    drawn = I.resampled_documents(docs, target, percent=25)
    assert drawn.columns == docs.columns and drawn.count() == 50
    assert drawn.where("text like 'a%'").count() > 45


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert I.importance_resampled(empty, empty).collect() == []
    one = I.importance_resampled(spark.createDataFrame([(1, None, None)], DOCS), empty).collect()
    assert [(r["doc_id"], r["n_features"], r["weight"], r["rank"]) for r in one] == [(1, 0, 0, None)]


def test_crc_of_spans_is_zlibs():
    words = [b"", b"a", b"abc", b"x" * 63, b"y" * 64, b"z" * 5000]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert I.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    assert I.crc32_spans(data, starts, ends, np.array([zlib.crc32(b"q")] * 6, np.uint32)).tolist() == [zlib.crc32(b"q" + w) for w in words]


# ---- very long texts in other operators


def test_very_long_texts_are_taken_whole(spark):
    """A text of 1.2 million words beside short ones: its size, the passage at its end, and its tokens all count."""
    item = "one passage of exactly eleven words that the benchmark holds verbatim"
    long = "w " * 1_200_000 + item
    docs = spark.createDataFrame([(1, long, "a"), (2, "w w w", "a"), (3, None, "b")], "doc_id long, text string, source string")
    mixed = {r["doc_id"]: r for r in sampled_copies(docs).collect()}
    assert mixed[1]["size"] == 1_200_011 and mixed[1]["source_size"] == 1_200_014 and mixed[1]["copies"] in (0, 1, 2)
    hits = {r["doc_id"]: r for r in benchmark_hits(docs.drop("source"), spark.createDataFrame([(7, item)], "item_id long, text string"), span=10, k=5).collect()}
    assert (hits[1]["n_hit"], hits[1]["n_words"], hits[2]["n_hit"]) == (11, 1_200_011, 0)
    scores = {r["doc_id"]: r for r in class_model_scores(docs.drop("source"), F.col("doc_id") == 2, classes=4, core_share=0.01, suffixes=8).collect()}
    assert scores[1]["n_tokens"] == 1_200_012 and scores[2]["n_known"] == 4 and math.isfinite(scores[1]["score"])


# ---- 7


def test_runs_of_equal_first_hashes_are_told_apart(spark, monkeypatch):
    """The first family maps all bytes of a class to one value, so many runs collide in it; the second one decides."""
    blunt = W.LOWER.copy()
    blunt[ord("a") : ord("z") + 1] = blunt[ord("A") : ord("Z") + 1] = blunt[ord("a")]
    monkeypatch.setattr(W, "LOWER", blunt)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((14, 12, 4, 3, 10))]
    docs = [" ".join(word() for _ in range(200)) for _ in range(6)] + [" ".join([word(), t, word()]).upper() for _, t in items]
    index = Index([i for i, _ in items], [t for _, t in items], 10, 5)
    n_hit, doc, item = index.hits(words_of(pa.array(docs, pa.large_string())))
    found = {(d, i) for d, i in zip(doc.tolist(), item.tolist(), strict=True)}
    want, covered = set(), [set() for _ in docs]
    for d, text in enumerate(docs):
        words = text.lower().split()
        for i, t in items:
            own = t.split()
            width = min(10, len(own))
            runs = {tuple(own[j : j + width]) for j in range(len(own) - width + 1)}
            for j in range(len(words) - width + 1):
                if tuple(words[j : j + width]) in runs:
                    want.add((d, i))
                    covered[d] |= set(range(j, j + width))
    assert found == want and n_hit.tolist() == [len(c) for c in covered] and len(want) >= len(items)
