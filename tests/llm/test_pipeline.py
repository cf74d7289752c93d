"""The pipeline, stage by stage, against plain Python; and every query with SQL against DuckDB."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from shelfspark.llm.quality_rules import FEATURES, learn_rules
from shelfspark.llm.queries import ORACLE, QUERIES, SHARDS, SLOTS
from shelfspark.llm.sharding import _number, lookup_table

from ..test_queries import DATA, compare
from .test_operators import passages, statistics
from .test_pairs import linked

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        compare(spark, QUERIES[name], ORACLE[name])
    else:
        rows = QUERIES[name](spark, DATA)
        assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def features(text):
    n_words, chars, symbols, dup_lines, repeats = statistics(text)
    t = text or ""
    s = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats}
    s["n_lines"] = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in t.split("\n"))
    s |= {"n_upper": len(re.findall("[A-Z]", t)), "n_digits": len(re.findall("[0-9]", t)), "n_marks": len(re.findall("[!?]", t)), "n_pipes": t.count("|")}
    plain = {f: e.replace("cast(n_words as double)", "float(n_words)").replace("greatest", "max") for f, e in FEATURES.items()}
    return s, {f: eval(e, {"max": max}, dict(s)) for f, e in plain.items()}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    rules = learn_rules(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def rejected(text):
        s, x = features(text)
        if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
            return True
        return any(all((x[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)

    kept = {d: r for d, r in rows.items() if not rejected(r["text"])}
    groups = linked([(d, r["text"]) for d, r in kept.items()], 5, 80)
    kept = {d: r for d, r in kept.items() if groups[d][1] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {d: kept[d] for d, _, n_hit, _ in passages([(d, r["text"]) for d, r in kept.items()], items, 10) if not n_hit}

    stages, table = [], docs
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, DATA)
        stages.append(table)
        assert name == "sharding" or table.columns == docs.columns
    assert {r["doc_id"] for r in stages[2].collect()} == set(kept)
    mixed = Counter(r["doc_id"] for r in stages[3].collect())
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2
    words = lambda ids: sum(len(kept[d]["text"].split()) * n for d, n in ids.items())
    assert abs(words(mixed) - 1.5 * words(Counter(kept.keys()))) < 0.1 * words(mixed)
    owner = lookup_table(SHARDS, SLOTS)
    final = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in final) == mixed
    assert all(r["shard"] == SHARDS[owner[_number(str(r["doc_id"])) % SLOTS]] and r["text"] == rows[r["doc_id"]]["text"] for r in final)


def test_stages_on_empty_and_odd_tables(spark):
    """Documents of 60 words stay, and as the first of their copies; null ids pass; the mix takes rows of one id alike."""
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    text = " ".join(f"word{i}" for i in range(60))
    odd = spark.createDataFrame([(None, text, None, None, None), (1, None, "xx", "s", 0), (2, "", None, None, None), (3, text + " end", "en", None, 9), (3, text + " end", "en", None, 9), (4, text + " end", "en", None, 9)], schema)
    ids = lambda df: sorted((r["doc_id"] or -1 for r in df.collect()))
    want = {"quality_rules": [-1, 3, 3, 4], "ngram_jaccard_join": [-1, 1, 2, 3, 3], "benchmark_decontamination": [-1, 1, 2, 3, 3, 4], "sharding": [-1, 1, 2, 3, 3, 4]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, DATA)
        assert out.columns[:5] == schema.names
        assert ids(out) == want[name] if name in want else set(ids(out)) <= {-1, 1, 2, 3, 4}
        assert stage(spark, odd.limit(0), DATA).count() == 0


CLASH = "kept string, base_failed string, n_words long, n_hit long, component_id long, _id string, _copies string, _copy long, copies long, c0 string, key string, slot string, shard string, `two words` string"


def test_stages_carry_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(d, f"{text} {d} " * 2 if d % 2 else " ".join(f"{d}w{i}" for i in range(90)), "en", "s", 1, *(-7 if c.split()[-1] == "long" else f"{c}{d}" for c in CLASH.split(", "))) for d in range(1, 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, DATA)
        assert out.columns == [*table.columns, *(["_slot", "_shard"] if name == "sharding" else [])]
        got = {tuple(r)[: len(table.columns)] for r in out.collect()}
        assert got and got <= set(rows)
