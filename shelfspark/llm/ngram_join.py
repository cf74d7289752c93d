"""Operator 8: Jaccard self-join of documents on word shingles, and its components.

Method: adaptive multi-match prefixes.  All documents sort their shingles by one
global order, rare ones first (by the number of documents that hold them, counted
over all texts in scales of two).  Two sets with an overlap of at least T share at
least l of the first ``n - T + l`` shingles, for every l.  Each document picks the
l at which the postings that it would meet, and the candidates that would remain,
cost least; a pair that meets at its first shared shingle must then share as many
prefix shingles as the smaller of its two l before its sets are compared.

Equal texts are one class from the start.  A frequent prefix shingle is not
expanded into all pairs of its holders: they are first compared with one pivot
(the holder in which the shingle comes earliest), which joins most of a group of
near copies.  Only pairs of documents that are then still in different components
are generated, filtered and verified, so no link that could join two components is
missed, and links inside a component are not needed.

Edge cases: a text with fewer words than a shingle is one shingle; without words
or text a document has none and is linked with nothing; rows with one doc_id are
one document that holds all their texts (n_shingles: the largest); null doc_ids
count as one document; a very long text is a block of its own, whole; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.snapshot import assign_positions

from . import exchange as X
from . import words as W
from .components import components

#: kinds of side rows
COPY, CODES, REQUEST, SET, PAIR = range(5)
SIDE = "origin int, kind int, bucket int, a long, b long, packed binary"
PREFIXES = "doc_id long, n int, ell int, skip int, tokens array<long>, text string"
#: Cost of comparing two sets in units of one posting, and the most shared shingles that may be asked for.
VERIFY_COST, MOST_SHARED = 40, 8


def shingle_sets(texts: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    sets: list[np.ndarray] = []
    for block in W.in_blocks(pa.table({"text": texts}), "text"):
        s = W.split(*W.text_bytes(block["text"]), W.SPACES)
        h = W.span_hashes(s, W.LOWER)
        found, at = W.windows(h, s.offsets, width)
        cuts = np.searchsorted(at, s.offsets)
        for d, n in enumerate(s.per_doc):
            if 0 < n < width:
                total = np.zeros(1, np.uint64)
                for x in h[s.offsets[d] : s.offsets[d] + n]:
                    total = total * W._ROLL + x
                sets.append(W.mix(total + np.uint64(n)))
            else:
                sets.append(np.unique(found[cuts[d] : cuts[d + 1]]))
    return sets


def _own(table: pa.Table, side: pa.Table) -> pa.Table:
    """The origin's distinct texts, without later copies."""
    copies = side.filter(pc.equal(side["kind"], COPY))["a"]
    table = table.filter(pc.invert(pc.is_in(table["doc_id"], copies.combine_chunks())))
    return table.group_by(["doc_id", "text"], use_threads=False).aggregate([]) if X._repeats(table) else table


def _scales(packed: list) -> list[bytes]:
    """For each origin's shingles the scale (1 + log2, rounded down) of the number of documents that hold them."""
    if not packed:
        return []
    parts = [X.unpack(p, np.uint32, np.uint16) for p in packed]
    _, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    held = np.bincount(place, weights=np.concatenate([p[1] for p in parts]))
    scale = (np.log2(held).astype(np.uint8) + 1)[place]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [scale[e - len(p[0]) : e].tobytes() for p, e in zip(parts, ends, strict=True)]


def prefix(scale: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, length) of the prefix of a set whose shingles, in global order, have these scales."""
    n = len(scale)
    least = -(-percent * n // 100)
    ell = np.arange(1, max(1, min(MOST_SHARED, least)) + 1)
    others = np.concatenate(([0.0], np.cumsum(np.where(scale > 1, 1.5 * 2.0 ** (scale.astype(float) - 1) - 1, 0))))
    postings = others[np.minimum(n - least + ell, n)]
    best = int(ell[np.argmin(postings * (1 + VERIFY_COST / ell))])
    return best, min(n, n - least + best)


def _prefixes(docs: DataFrame, copies: DataFrame, width: int, percent: int) -> DataFrame:
    """For each class of equal texts: its size n, l, and its prefix shingles that any other class holds."""
    plan = X.Plan(docs)
    texts, b = X.by_origin(docs, plan), plan.buckets
    skip = copies.select(X.origin_of(F.col("doc_id"), plan.origins).alias("origin"), F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(b"").alias("packed"))

    def held(sets):
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)

    def send(origin, table, side):
        found, counts = held(shingle_sets(_own(table, side)["text"], width))
        return X.table_of(X.pack(origin, CODES, X.bounds(found, b), found.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)))

    codes = X.answer(X.with_side(texts, skip, send, X.PACKED), CODES, _scales)
    side = skip.unionByName(codes.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}))

    def choose(origin, table, side):
        own = _own(table, side)
        sets = shingle_sets(own["text"], width)
        found, _ = held(sets)
        scales = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(p, np.uint8) for p in X.answers(side, CODES))])
        rows = {"n": [], "ell": [], "skip": [], "tokens": [], "text": []}
        for s, text in zip(sets, own["text"], strict=True):
            scale = scales[np.searchsorted(found, s)]
            order = np.argsort(scale, kind="stable")  # s is sorted: ties by hash
            ell, length = prefix(scale[order], percent) if len(s) else (1, 0)
            alone = min(length, int((scale == 1).sum()))
            tokens = s[order[alone:length]].view(np.int64)
            for k, v in (("n", len(s)), ("ell", ell), ("skip", alone), ("tokens", tokens), ("text", text.as_py() if len(tokens) else None)):
                rows[k].append(v)
        return pa.table({"doc_id": own["doc_id"], **{k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()), strict=True)}})

    return X.cut(X.with_side(texts, side, choose, PREFIXES))


def _overlap(percent: int, n: str, m: str) -> str:
    """SQL: the least overlap of two linked sets of sizes n and m."""
    return f"ceil({percent} * ({n} + {m}) / {100 + percent})"


def _fits(percent: int, x: str, y: str) -> str:
    """SQL: sizes, and a shared prefix shingle's places, allow the overlap.

    Before that shingle at most the shingles that some other document holds can match (the
    first ``skip`` of a set are its own), after it at most the shorter rest.
    """
    most = f"least({x}.pos - {x}.skip, {y}.pos - {y}.skip) + least({x}.n - {x}.pos, {y}.n - {y}.pos)"
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {most} >= {_overlap(percent, f'{x}.n', f'{y}.n')}"


def _verified(texts: DataFrame, origins: int, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. a's set goes once to each origin with a partner."""
    nothing = {"bucket": F.lit(0), "packed": F.lit(b"")}
    to = X.origin_of(F.col("b"), origins).cast("long")
    asked = pairs.select("a", to.alias("b")).distinct().select(X.origin_of(F.col("a"), origins).alias("origin"), F.lit(REQUEST).alias("kind"), "a", "b").withColumns(nothing)

    def give(origin, table, side):
        sets = _by_doc(table, side["a"], width)
        rows = [(int(o), SET, 0, a, 0, s.tobytes()) for a, o in zip(side["a"].to_pylist(), side["b"].to_pylist(), strict=True) for s in sets.get(a, ())]
        return pa.table(dict(zip(X.pa_schema(SIDE).names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in X.pa_schema(SIDE).names}, X.pa_schema(SIDE))

    given = X.with_side(texts, asked.select("origin", "kind", "bucket", "a", "b", "packed"), give, SIDE)
    wanted = pairs.select(X.origin_of(F.col("b"), origins).alias("origin"), F.lit(PAIR).alias("kind"), "a", "b").withColumns(nothing)

    def compare(origin, table, side):
        want = side.filter(pc.equal(side["kind"], PAIR))
        got = side.filter(pc.equal(side["kind"], SET))
        theirs: dict[int, list] = {}
        for a, s in zip(got["a"].to_pylist(), got["packed"], strict=True):
            theirs.setdefault(a, []).append(np.frombuffer(s.as_buffer(), np.uint64))
        ours = _by_doc(table, want["b"], width)
        out = [(a, b) for a, b in zip(want["a"].to_pylist(), want["b"].to_pylist(), strict=True) if any(_similar(x, y, percent) for x in theirs.get(a, ()) for y in ours.get(b, ()))]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return X.with_side(texts, given.unionByName(wanted), compare, "a long, b long")


def _by_doc(table: pa.Table, ids: pa.ChunkedArray, width: int) -> dict[int, list[np.ndarray]]:
    table = table.filter(pc.is_in(table["doc_id"], ids.combine_chunks()))
    out: dict[int, list[np.ndarray]] = {}
    for d, s in zip(table["doc_id"].to_pylist(), shingle_sets(table["text"], width), strict=True):
        out.setdefault(d, []).append(s)
    return out


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _open_pairs(token: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components that share a prefix shingle early enough.

    At each shingle the members of its largest component meet only the others.
    """
    main = token.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("m.comp").alias("main"))
    open_ = X.cut(token.join(main, "token").select("token", "doc_id", "n", "skip", "pos", "comp", "main"))
    x, y = open_.where("comp <> main").alias("x"), open_.alias("y")
    # The first match of a linked pair leaves room for the whole overlap in both.
    first = f"least(x.n - x.pos, y.n - y.pos) >= {_overlap(percent, 'x.n', 'y.n')}"
    near = x.join(y, F.expr(f"x.token = y.token and x.comp <> y.comp and (y.comp = y.main or y.doc_id < x.doc_id) and {first} and {_fits(percent, 'x', 'y')}"))
    return near.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _enough_shared(pairs: DataFrame, able: DataFrame) -> DataFrame:
    """The pairs that share as many shingles of their prefixes as the smaller of their l."""
    of = lambda s: able.select(F.col("doc_id").alias(s), F.col("ell").alias(f"ell_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where("size(array_intersect(tokens_a, tokens_b)) >= least(ell_a, ell_b)").select("a", "b").distinct()


def copies_of(docs: DataFrame) -> DataFrame:
    """(doc_id, first): the least doc_id with the same text; documents without words stand alone."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(X.NO_ID)).alias("doc_id"), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.sha2("text", 256)).alias("digest"))
    first = keyed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "digest", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))


def ngram_jaccard_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Two documents link when the Jaccard similarity of their sets of lower-cased word
    shingles is at least ``percent`` / 100.  A document of several texts is in the component of each.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(X.NO_ID)).alias("doc_id"), "text")
    held = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"))
    several = X.cut(held.where("least <> most").select("doc_id"))
    if several.isEmpty():  # every document is one text, under its own number
        return _linked(docs, shingle_words, percent)
    # Each text of the others gets a number of its own, beyond all doc_ids (or below them, if there is no room).
    texts = assign_positions(rows.join(several, "doc_id", "left_semi").distinct(), "at", ["doc_id", "text"])
    least, most = (int(v or 0) for v in rows.where(F.col("doc_id") != X.NO_ID).agg(F.min("doc_id"), F.max("doc_id")).first())
    texts = X.cut(texts)
    first = most + 1 if most + 1 + (n := texts.count()) < X.NO_ID else least - n
    texts = X.cut(texts.select("doc_id", (F.col("at") + F.lit(first)).alias("key"), "text"))
    single = rows.join(several, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("key"), "text")
    one = X.cut(_linked(single.unionByName(texts).select(F.col("key").alias("doc_id"), "text"), shingle_words, percent).withColumnsRenamed({"doc_id": "key", "component_id": "comp"}).select(F.coalesce("key", F.lit(X.NO_ID)).alias("key"), "n_shingles", F.coalesce("comp", F.lit(X.NO_ID)).alias("comp")).distinct())
    # A document's texts tie their components together.
    own = X.cut(texts.select("doc_id", "key").join(one, "key"))
    edges = own.join(own.groupBy("doc_id").agg(F.min("comp").alias("a")), "doc_id").select("a", F.col("comp").alias("b"))
    tied = components(X.cut(edges.where("a <> b").distinct()), "a", "b").select(F.col("doc_id").alias("comp"), F.col("component_id").alias("whole"))
    of_key = one.join(texts.select("doc_id", "key"), "key", "left").withColumn("doc_id", F.coalesce("doc_id", "key"))
    of_key = X.cut(of_key.join(tied, "comp", "left").withColumn("whole", F.coalesce("whole", "comp")))
    smallest = of_key.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    found = of_key.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("whole").alias("whole")).join(smallest, "whole")
    out = rows.select("doc_id").join(found, "doc_id").select("doc_id", "n_shingles", "component_id")
    return X.with_null_ids(out).withColumn("component_id", F.when(F.col("component_id") != X.NO_ID, F.col("component_id")))


def _linked(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """:func:`ngram_jaccard_components` of documents with one text each."""
    members = X.cut(copies_of(docs))
    found = _prefixes(docs, members.where("doc_id <> first").select("doc_id"), shingle_words, percent)
    able = found.where(F.size("tokens") > 0)
    plan = X.Plan(able)
    texts = X.by_origin(able, plan)
    # Postings: the prefix for l = 1, which holds the first match of every linked pair.
    token = able.select("doc_id", "n", "skip", F.posexplode("tokens").alias("at", "token")).select("token", "doc_id", "n", "skip", (F.col("skip") + F.col("at")).alias("pos")).where(f"pos <= n - ceil({percent} * n / 100)")

    # Round 1: every holder of a shingle with the holder in which it comes first.
    pivot = token.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "n", "skip")).alias("p"), F.count("*").alias("holders")).where("holders > 1").select("token", "p.*")
    tried = X.cut(token.alias("y").join(pivot.alias("x"), "token").where(f"x.doc_id <> y.doc_id and {_fits(percent, 'x', 'y')}").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    links = X.cut(_verified(texts, plan.origins, _enough_shared(tried, able), shingle_words, percent))
    comp = X.cut(components(links, "a", "b"))

    # Round 2: pairs that are still in different components.
    kept = _open_pairs(token.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("component_id", "doc_id")), percent)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(texts, plan.origins, X.cut(_enough_shared(kept.join(done, ["a", "b"], "left_anti"), able)), shingle_words, percent)
    comp = components(links.unionByName(more), "a", "b")

    size = found.groupBy(F.col("doc_id").alias("first")).agg(F.max("n").alias("n"))
    out = members.join(size, "first", "left").join(comp.withColumnRenamed("doc_id", "first"), "first", "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "first").alias("component_id"))
    return X.with_null_ids(out).withColumn("component_id", F.when(F.col("component_id") != X.NO_ID, F.col("component_id")))
