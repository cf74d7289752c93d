"""The other operators: tables, filters, rules, mixing, tokens, benchmark passages, scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import brown, lm_scoring
from shelfspark.llm import quality_rules as Q
from shelfspark.llm import words as W
from shelfspark.llm.decontaminate import benchmark_hits
from shelfspark.llm.lm_scoring import class_model_scores
from shelfspark.llm.mixing import mixed_documents, sampled_copies
from shelfspark.llm.queries import URL_RULES
from shelfspark.llm.sharding import assign_shards, lookup_table, write_shards
from shelfspark.llm.token_cache import Encoder, count_tokens, encode_misses, read_cache
from shelfspark.llm.url_filter import judged_urls

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n, seed=0, longest=80):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "und", "Ünï", "x", "naïve", "***", "A|b", "end.", *(f"w{i}" for i in range(60))]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(longest))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for x in w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "日本 語 " * 30), (n + 5, "x " * 20_000)]


# ---- words


def test_words_and_hashes():
    import pyarrow as pa

    rows = [t for _, t in texts(60)]
    s = W.split(*W.text_bytes(pa.array(rows)), W.SPACES)
    found = [[bytes(s.data[a:b]).decode() for a, b in zip(s.starts[lo:hi], s.ends[lo:hi])] for lo, hi in zip(s.offsets, s.offsets[1:])]
    assert found == [WORD.findall(t or "") for t in rows]
    h = W.span_hashes(s).tolist()
    by_word = dict(zip([w for ws in found for w in ws], h))
    assert len(set(by_word.values())) == len(by_word) and all(by_word[w] == x for w, x in zip([w for ws in found for w in ws], h))
    lower = W.span_hashes(W.split(*W.text_bytes(pa.array(["ABC Éa abc"])), W.SPACES), W.LOWER)
    assert lower[0] == lower[2] != lower[1]
    words, at = W.windows(W.span_hashes(s), s.offsets, 3)
    assert len(at) == sum(max(0, len(ws) - 2) for ws in found)
    assert len(W.text_bytes(pa.array([], pa.string()))[0]) == 0


def test_hashes_do_not_depend_on_where_a_word_stands():
    import pyarrow as pa

    long = "y" * 3_000_000 + " word " + "z " * 700_000 + "word"
    s = W.split(*W.text_bytes(pa.array([long])), W.SPACES)
    h = W.span_hashes(s)
    assert h[1] == h[-1] and len(set(h.tolist())) == 3


# ---- 1


def test_lookup_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(7)]
    table = lookup_table(shards, 251)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = lookup_table(shards[:-1], 251)
    assert sum(shards[a] != shards[b] for a, b in zip(table, fewer) if a != 6) < 60
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(bad, 251)
    with pytest.raises(ValueError):
        lookup_table(["a"], 250)


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x", 1) for i in range(500)] + [(None, None, 2), (3, "x", 1)], "doc_id long, text string, slot int")
    placed = assign_shards(rows, ["a", "b", "c"], slots=251)
    assert placed.columns == ["doc_id", "text", "slot", "_slot", "shard"] and placed.where("slot in (1, 2)").count() == 502
    assert placed.where("shard is null").count() == 0 and placed.where("doc_id = 3").select("shard").distinct().count() == 1
    write_shards(rows.drop("slot"), str(tmp_path / "out"), ["a", "b", "c"], 2, slots=251)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 502
    assert assign_shards(rows.limit(0), ["a"], slots=251).count() == 0


# ---- 2


def test_urls(spark):
    urls = ["https://A.Example.COM/en/1?x#y", "http://www.example.com/en/9", "http://x.www.example.com/en/", "http://b.net/fr/2", "http://b.net/de/2", "ftp://net/es/", "no url", None, "http://c.com", "x://h#frag", "http://h.org?q://z/en/", "http://notnet/es/1"]
    got = [tuple(r)[:5] for r in judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).orderBy("page_id").collect()]
    assert got == [
        (0, "a.example.com", "/en/1", "example.com/en/", "block"), (1, "www.example.com", "/en/9", "www.example.com/en/", "allow"), (2, "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "b.net", "/fr/2", "net/fr/", "block"), (4, "b.net", "/de/2", None, "allow"), (5, "net", "/es/", "net/es/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "c.com", "", None, "allow"), (9, "h", "", None, "allow"), (10, "h.org", "", None, "allow"), (11, "notnet", "/es/1", None, "allow"),
    ]


def test_templates_of_blocked_pages_are_rejected(spark):
    rules = [("block", "bad.org/a/x"), ("allow", "bad.org/b/x")]
    urls = [f"http://bad.org/a/x{i}" for i in range(40)] + [f"http://bad.org/a/{i}" for i in range(20)] + [f"http://bad.org/b/x{i}" for i in range(40)] + [f"http://bad.org/b/{i}" for i in range(20)] + [f"http://bad.org/c/{i}" for i in range(20)]
    got = judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, least_pages=25, least_share=0.0)
    verdicts = {(r["path"].split("/")[1], r["rule"] is None): r["verdict"] for r in got.collect()}
    assert verdicts["b", True] == "allow" and verdicts["c", True] == "allow" and verdicts["a", True] == "block"
    assert "bad.org/a/*/" in {r["template"] for r in got.collect()}
    assert judged_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


# ---- 3


def statistics(t):
    w, seen, dup = WORD.findall(t or ""), set(), 0
    triples = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_statistics(spark):
    rows = [*texts(150, 3), (900, "a b c a b c\na b c a b c\nx"), (901, "l\nl\n\n\nl ")]
    got = Q.with_statistics(spark.createDataFrame([(d, t, "keep") for d, t in rows], DOCS + ", n_words string")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got} == {d: statistics(t) for d, t in rows}


def test_decision_list_is_grown_and_pruned():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] > 0.7) & (x["a"] < 0.3))
    rules = Q.learn_decision_list(x, bad, np.arange(3000))
    caught = np.logical_or.reduce([Q._covers(r, x, 3000) for r in rules])
    assert (caught == bad).mean() > 0.95 and len(rules) >= 2
    assert Q.learn_decision_list(x, np.zeros(3000, bool), np.arange(3000)) == [] and Q.learn_decision_list(x, np.ones(3000, bool), np.arange(3000)) == []


def test_rules_reject_junk_and_keep_the_clean(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(90)), 1) for i in range(150)]
    junk = [(200 + i, " ".join(rng.choice(words) + "***" for _ in range(90)), 0) for i in range(60)]
    rows = [*clean, *junk, (500, None, None), (501, "short", None), (502, "one two three " * 40, None)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows if d % 2 == 0] + [(9999, 0), (None, 0), (4, None)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.judged(docs, labels).collect()}
    assert all(got[d] == (False, True) for d, *_ in clean) and all(got[d] == (False, False) for d, *_ in junk)
    assert got[500] == got[501] == got[502] == (True, False)
    assert Q.judged(docs, labels.limit(0)).where("kept").count() == 210
    assert Q.judged(docs.limit(0), labels).count() == 0


# ---- 4


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 60))), rng.choice(["a", "b", "c", "d", None] + ["a"] * 5)) for i in range(4000)]
    docs = spark.createDataFrame([*rows, (9000, None, "empty"), (None, "w w", "a")], DOCS + ", source string")
    got = sampled_copies(docs).collect()
    size = Counter()
    for _, t, s in [*rows, (0, None, "empty"), (0, "w w", "a")]:
        size[s] += len(WORD.findall(t or ""))
    names = [*sorted(s for s in size if s is not None), None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] <= level * weight[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2 * size[s] for s in full})
        left -= sum(target[s] for s in full)
        free -= full
    source = {d: s for d, _, s in rows} | {9000: "empty", None: "a"}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9) and 0 <= r["copies"] <= 2
        taken[s] += r["size"] * r["copies"]
    assert len(got) == 4002 and all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 200 for s in names)
    assert sorted(map(str, sampled_copies(docs.repartition(3)).collect())) == sorted(map(str, got))
    copies = {r["doc_id"]: r["copies"] for r in got}
    mixed = Counter(r["doc_id"] for r in mixed_documents(docs).collect())
    assert mixed == {d: n for d, n in copies.items() if n} and mixed_documents(docs).columns == docs.columns
    assert sampled_copies(docs.limit(0)).count() == 0


# ---- 6


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def test_token_counts(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_str(tokenizer)
    rows = [*texts(80, 6), (500, "a<|endoftext|>b"), (501, "don't 1234, \u00a0x\u200b \U0001f600 ﬁ ǆ"), (None, "null id"), (None, "null id"), (7, "second text of 7")]
    docs = spark.createDataFrame(rows, DOCS)
    cache = str(tmp_path / "cache")
    count = lambda d: sorted(map(tuple, count_tokens(d, tokenizer, cache).collect()), key=str)
    expected = sorted(((d, len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False))) for d, t in rows), key=str)
    assert count(docs) == expected
    n = read_cache(spark, cache).count()
    assert n == len({t or "" for _, t in rows}) and count(docs) == expected and read_cache(spark, cache).count() == n
    encode_misses(spark.createDataFrame([(1, "new text")], DOCS), tokenizer, cache)
    assert read_cache(spark, cache).count() == n + 1
    assert count_tokens(docs.limit(0), tokenizer).count() == 0


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_a_text_is_encoded_once_wherever_its_copies_lie(spark, tokenizer, tmp_path, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        docs = spark.createDataFrame([(1, "one text " * 3000)] * 40 + [(2, "another")] * 3, DOCS).repartition(8)
        cache = str(tmp_path / "cache")
        for _ in range(2):
            encode_misses(docs, tokenizer, cache)
            assert read_cache(spark, cache).count() == 2
        assert count_tokens(docs, tokenizer, cache).where("doc_id = 1").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_both_libraries_count_alike(tokenizer):
    from tokenizers import Tokenizer

    encoder, exact = Encoder(tokenizer), Tokenizer.from_str(tokenizer)
    assert encoder.fast is not None
    rng = random.Random(0)
    alphabet = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 9, 10, 13]] + [" "] * 40 + list("etaoin") * 5
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    assert encoder.count(samples) == [len(exact.encode(t, add_special_tokens=False)) for t in samples]


def test_other_tokenizers_are_not_mistaken_for_plain_byte_bpe():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    assert encoder.fast is None and encoder.count(["Hello  World"]) == encoder.count(["hello world"])


# ---- 7


def passages(rows, items, span):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    runs = {}
    for i, t in items:
        w = find(low(t))
        k = min(span, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            runs.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, ids = find(low(t)), set(), set()
        for k in {len(r) for r in runs}:
            for a in range(len(w) - k + 1):
                if (r := tuple(w[a : a + k])) in runs:
                    hit |= set(range(a, a + k))
                    ids |= runs[r]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_benchmark_passages(spark, broadcast_bytes):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "B-2"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 30]))) for i in range(25)] + [(30, None), (31, "..."), (32, "only"), (None, text(12))]
    items.append((40, items[0][1]))
    rows = []
    for d in range(80):
        t = text(rng.randrange(60))
        if d % 2:
            w = (items[rng.randrange(25)][1] or "").split()
            t += ", " + " ".join(w[rng.randrange(len(w)) // 2 :]).upper() + "! " + text(5)
        rows.append((d, t))
    rows += [(100, None), (101, ""), (None, items[3][1])]
    got = benchmark_hits(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), 10, 5, broadcast_bytes)
    assert sorted((tuple(r)[:3] + (sorted(r["item_ids"]),) for r in got.collect()), key=str) == passages(rows, [i for i in items if i[0] is not None], 10)


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in benchmark_hits(docs, none).collect()] == [(1, 3, 0, [])] and benchmark_hits(docs.limit(0), none).count() == 0


# ---- 9


def test_gains_are_differences_of_the_objective():
    rng = np.random.default_rng(1)
    table, assigned = rng.integers(0, 9, (12, 12)).astype(float), rng.integers(0, 4, 12)
    one = np.eye(4)
    of = lambda c: one[c].T @ table @ one[c]
    for t in range(12):
        right, left = (np.bincount(assigned, weights=w, minlength=4) for w in (table[t], table[:, t]))
        gains = brown._gains(of(assigned), assigned[t], right, left, table[t, t])
        truth = []
        for c in range(4):
            moved = assigned.copy()
            moved[t] = c
            truth.append(brown.objective(of(moved)))
        assert np.allclose(gains - gains[0], np.array(truth) - truth[0])


def language(spark):
    rng = random.Random(9)
    rows = []
    for d in range(700):
        tail = rng.choice(["a", "o", "ing"])
        rows.append((d, " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{tail}" for _ in range(rng.randrange(5, 60)))))
    return [*rows, (800, None), (801, ""), (None, "Bada bada")]


def test_scores(spark):
    rows = language(spark)
    docs = spark.createDataFrame(rows, DOCS)
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in class_model_scores(docs, out, classes=8, suffixes=64).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(ws), sum(c[w] > 0 for w in ws), n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    test = [r for d, r in got.items() if held(d)]
    assert len(test) > 50 and sum(r["score"] for r in test) > 0.95 * sum(r["base_score"] for r in test)


def plain_model(monkeypatch, spark, rows, out, classes, **how):
    """The operator's rows, the class of each word, and the model that plain Python makes of these classes: log10 P(word | class before), and the words' probabilities."""
    seen = []
    whole = lm_scoring._classes
    monkeypatch.setattr(lm_scoring, "_classes", lambda texts, assigned, *more: seen.append(assigned) or whole(texts, assigned, *more))
    got = {r["doc_id"]: r for r in class_model_scores(spark.createDataFrame(rows, DOCS), out, classes=classes, **how).collect()}
    assigned = {t % (1 << 64): k for t, k in seen[0].collect()}
    n = how["suffixes"]

    def key(word):
        return 0 if word is None else int(lm_scoring._keys(pa.table({"text": [word]}), n)[0][0])

    def class_of(word):
        k = key(word)
        return assigned.get(k, assigned[n + k % n])

    tokens = {d: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None] for d, t in rows}
    training = {d: ws for d, ws in tokens.items() if not got[d]["held_out"]}
    c = Counter(w for ws in training.values() for w in ws)
    follows, size, kinds = Counter(), Counter(), Counter()
    for w, k in c.items():
        size[class_of(w)] += k
        kinds[class_of(w)] += 1
    for ws in training.values():
        follows.update((class_of(a), class_of(b)) for a, b in zip([None, *ws], ws))
    into, out_of, total = Counter(), Counter(), sum(follows.values())
    for (a, b), k in follows.items():
        out_of[a] += k
        into[b] += k

    def step(a, b):
        return (follows[a, b] + lm_scoring.PRIOR * (into[b] + 1) / (total + classes)) / (out_of[a] + lm_scoring.PRIOR)

    emit = lambda w, k: (c[w] + 1) / (size[k] + kinds[k] + 1)
    return got, tokens, c, class_of, step, emit


@pytest.mark.parametrize(("share", "least"), [(5e-4, 2), (1e-5, 1), (0.5, 3)])
def test_scores_are_those_of_a_plain_class_model(spark, monkeypatch, share, least):
    rows = language(spark)[:250] + [(900, "new words ab zz")]
    got, tokens, c, class_of, step, emit = plain_model(monkeypatch, spark, rows, F.col("doc_id") % 5 == 0, 6, core_share=share, suffixes=16, sweeps=3, least_count=least)
    for d, ws in tokens.items():
        ks = [class_of(w) for w in ws]
        assert math.isclose(got[d]["score"], sum(math.log10(step(a, k) * emit(w, k)) for w, a, k in zip(ws, [0, *ks], ks)), rel_tol=1e-9)
    for a in range(6):  # over all words and, in each class, one that is not known
        assert math.isclose(sum(step(a, class_of(w)) * emit(w, class_of(w)) for w in c) + sum(step(a, k) * emit("", k) for k in range(6)), 1)
    assert {class_of(w) for w in c if w is not None} == ({1, 2, 3, 4, 5} if share < 0.5 else {1}) and class_of(None) == 0  # without neighbours in the core nothing tells words apart


def test_newcomers_go_where_the_objective_is_highest():
    rng = np.random.default_rng(5)
    m, right, left = rng.integers(0, 50, (5, 5)).astype(float), rng.integers(0, 4, (20, 5)), rng.integers(0, 4, (20, 5))
    for t, k in enumerate(brown.newcomers(m, right, left)):
        with_it = []
        for c in range(1, 5):
            x = m.copy()
            x[c] += right[t]
            x[:, c] += left[t]
            with_it.append(brown.objective(x))
        assert math.isclose(with_it[k - 1], max(with_it))


@pytest.mark.parametrize("seed", range(40))
def test_newcomers_over_many_tables(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.choice([3, 8, 24]))
    m = rng.integers(0, 60, (k, k)).astype(float) * (rng.random((k, k)) < 0.6)
    right, left = (rng.integers(0, 9, (12, k)) * (rng.random((12, k)) < 0.3) for _ in range(2))
    for t, found in enumerate(brown.newcomers(m, right, left)):
        with_it = []
        for c in range(1, k):
            x = m.copy()
            x[c] += right[t]
            x[:, c] += left[t]
            with_it.append(brown.objective(x))
        assert math.isclose(with_it[found - 1], max(with_it), abs_tol=1e-9)


def test_limits_of_the_class_numbers(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    for classes in (1, 257):
        with pytest.raises(ValueError, match="classes"):
            class_model_scores(docs, F.lit(False), classes=classes)


def test_scores_of_odd_tables(spark):
    never = F.lit(False)
    assert class_model_scores(spark.createDataFrame([], DOCS), never).count() == 0
    only = class_model_scores(spark.createDataFrame([(1, "a b"), (1, "a b")], DOCS + "").withColumn("score", F.lit("x")), F.lit(True), classes=4, core_share=0.1, suffixes=8).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in only] == [(3, 0, 0)] * 2 and all(math.isfinite(r["score"]) for r in only)


