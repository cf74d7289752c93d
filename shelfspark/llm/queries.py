"""One query for each operator of this subpackage, over its whole table, and SQL where it can say the same.

Every query is thin: the operator does the work, the query names its production
parameters and derives digests or flags from the operator's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: A prime of more than a hundred slots for each shard.
SLOTS = 2039
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_read(spark, sf_dir, "documents").select("doc_id"), SHARDS, slots=SLOTS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged_urls

    return judged_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import sampled_copies

    out = sampled_copies(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_spans

    out = remove_repeated_spans(_read(spark, sf_dir, "documents"), window_words=13, start_words=7)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_cache import count_tokens

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        source = file.read()
    return count_tokens(_read(spark, sf_dir, "documents"), source).withColumn("over_limit", F.col("n_tokens") > 512)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_hits

    out = benchmark_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), span=10, k=5)
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(_read(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import class_model_scores

    return class_model_scores(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import removed_lines

    out = removed_lines(_read(spark, sf_dir, "documents"), percent=80, least_words=1)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import quality_scores

    out = quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    return out.select("doc_id", "held_out", "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"), least=100, most_words=5, top=2000)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resampled

    out = importance_resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=25, least_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_join": op8_ngram_join,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
    "op11_line_crf": op11_line_crf,
    "op12_collocations": op12_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (win) WHERE least < doc_id),
k AS (SELECT t.doc_id, t.i, t.word, c.i IS NOT NULL AS gone FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i),
s AS (SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)""",
    "op8_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c ON c.doc_id = w.doc_id""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
r AS (SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS run
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, w, i, array_to_string(ws[i:i+w-1], ' ') AS run
      FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM r) WHERE len(ws) >= w)),
h AS (SELECT doc_id, i, g.w, item_id FROM g JOIN r ON g.w = r.w AND g.run = r.run),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op1_sharding": f"""
WITH RECURSIVE s AS (SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 2, '0') AS shard FROM range({len(SHARDS)}) t(k)),
p AS (SELECT list(('0x' || substr(md5('offset:' || shard), 1, 15))::BIGINT % {SLOTS} ORDER BY k) AS o, list(('0x' || substr(md5('skip:' || shard), 1, 15))::BIGINT % {SLOTS - 1} + 1 ORDER BY k) AS d FROM s),
f AS (SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS own, -1::BIGINT AS slot UNION ALL
      SELECT turn + 1, list_transform(own, lambda v, i: if(i - 1 = c, turn % {len(SHARDS)}, v)), c FROM (
        SELECT turn, own, list_filter(list_transform(range({SLOTS}), lambda j: (o[turn % {len(SHARDS)} + 1] + j * d[turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda q: own[q + 1] = -1)[1] AS c FROM f, p WHERE turn < {SLOTS})),
t AS (SELECT slot, (turn - 1) % {len(SHARDS)} AS k FROM f WHERE turn > 0)
SELECT doc_id, CAST(t.slot AS INTEGER) AS slot, shard FROM documents
JOIN t ON t.slot = ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} JOIN s USING (k)""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'b' || source END AS key, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents FROM d GROUP BY key),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT key, source_size, documents, CASE WHEN cap <= level * weight THEN cap
        ELSE (SELECT arg_min(level, (cap / weight, key)) FROM l WHERE cap > level * weight) * weight END AS target FROM l),
p AS (SELECT d.*, source_size, target, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % CAST(ceil(documents / 4096) AS BIGINT) AS block FROM d JOIN t USING (key)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY block, CASE WHEN block % 2 = 0 THEN size ELSE -size END, doc_id) AS rank,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('0:' || key), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u FROM p)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * rank + u) - floor(rate * (rank - 1) + u)) AS BIGINT) AS taken FROM r""",
    "op2_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
g AS (SELECT page_id, host, path, rule, list_transform([2, 3, 4], lambda k: coalesce(string_split(path, '/')[k], '')) AS seg FROM b),
x AS (SELECT page_id, host, path, rule, list_transform(seg, lambda v: CASE WHEN regexp_full_match(v, '[0-9]+') THEN '{n}' WHEN regexp_full_match(v, '[0-9]+\.[A-Za-z0-9]+') THEN '{n}.' || string_split(v, '.')[-1]
    WHEN regexp_full_match(v, '[0-9a-f-]{8,}') THEN '{id}' WHEN regexp_matches(v, '[0-9]') AND length(v) >= 6 THEN '{v}' ELSE v END) AS s FROM g),
y AS (SELECT page_id, host, path, rule, s[1] AS s1, s[2] AS s2, s[3] AS s3, rule IS NOT NULL AS lab, coalesce(rule IN ('example.com/en/', 'net/es/', 'net/fr/'), false) AS blk, '' AS t FROM x),
z AS (SELECT avg(blk::INT) AS share FROM y WHERE lab),
b0 AS (SELECT * FROM y),
"""
    + "".join(
        f"""
a{k} AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY host, t, s{k}) < greatest(5.0, count(*) OVER (PARTITION BY host, t) * 0.02) THEN '*' ELSE s{k} END AS u FROM b{k - 1}),
g{k} AS (SELECT host, t, u, count_if(lab) AS l, count_if(blk) AS b, count_if(blk) / count_if(lab) AS r FROM a{k} GROUP BY host, t, u HAVING l > 0),
j{k} AS (SELECT *, lag(l) OVER w AS pl, lag(b) OVER w AS pb, lag(r) OVER w AS pr FROM g{k} WINDOW w AS (PARTITION BY host, t ORDER BY r, u)),
i{k} AS (SELECT *, sum(CASE WHEN r - pr <= 1.96::DOUBLE * sqrt((b + pb) / (l + pl) * (1 - (b + pb) / (l + pl)) * (1 / l + 1 / pl)) THEN 0 ELSE 1 END) OVER (PARTITION BY host, t ORDER BY r, u) AS island FROM j{k}),
m{k} AS (SELECT host, t, u, array_to_string(list_sort(list(u) OVER (PARTITION BY host, t, island)), '|') AS name FROM i{k}),
b{k} AS (SELECT a.* EXCLUDE (t, u), a.t || '/' || coalesce(name, a.u) AS t FROM a{k} a LEFT JOIN m{k} m ON a.host = m.host AND a.t = m.t AND a.u = m.u),"""
        for k in (1, 2, 3)
    )
    + """
l AS (SELECT *, count_if(lab) OVER (PARTITION BY host, t) AS el, count_if(blk) OVER (PARTITION BY host, t) AS eb FROM b3)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN el >= 5 AND (eb + 2.0::DOUBLE * coalesce((SELECT share FROM z), 0)) / (el + 2.0::DOUBLE) >= 0.8 THEN 'block' ELSE 'allow' END AS verdict,
    host || t AS template FROM l""",
    "op12_collocations": rf"""
WITH p AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
q AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 100),
u AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k+1:], ' ') AS rp FROM (SELECT c.*, unnest(range(1, size)) AS k FROM c)),
x AS (SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score FROM u
  JOIN q l ON l.lang = u.lang AND l.phrase = lp JOIN q r ON r.lang = u.lang AND r.phrase = rp JOIN t ON t.lang = u.lang),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[b:b+m-1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS b FROM c, range(2, 5) t(m) WHERE m < size) GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000""",
    "op13_importance_resampling": rf"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT doc_id, array_to_string(ws[i:i+m-1], ' ') AS feature FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, range(1, 3) k(m) WHERE len(ws) >= m)),
h AS (SELECT array_to_string(ws[i:i+m-1], ' ') AS feature FROM (SELECT ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM e, range(1, 3) k(m) WHERE len(ws) >= m)),
v AS (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM (SELECT feature FROM g UNION ALL SELECT feature FROM h)),
b AS (SELECT feature, xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM g JOIN b USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM h JOIN b USING (feature) GROUP BY bucket),
w AS (SELECT n.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT bucket FROM b) n LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM g JOIN b USING (feature) JOIN w USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count_if(words >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END::BIGINT AS rank FROM k""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
e AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(line), '[^ \t\x0B\f\r]+'))) AS ws FROM l),
d AS (SELECT * FROM e WHERE len(ws) > 0 QUALIFY row_number() OVER (PARTITION BY ws ORDER BY doc_id, i) = 1),
t AS (SELECT doc_id, i, len(ws) AS n, unnest(ws) AS g FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY f, g) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM t)),
p AS (SELECT doc_id, i, n, g FROM o WHERE k <= n - ceil(80 * n / 100) + 1),
c AS (SELECT DISTINCT y.doc_id, y.i, x.doc_id AS xd, x.i AS xi FROM p y JOIN p x ON x.g = y.g AND (x.doc_id, x.i) < (y.doc_id, y.i) AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
r AS (SELECT DISTINCT c.doc_id, c.i FROM c JOIN d x ON x.doc_id = xd AND x.i = xi JOIN d y ON y.doc_id = c.doc_id AND y.i = c.i
      WHERE 100 * len(list_intersect(x.ws, y.ws)) >= 80 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
z AS (SELECT doc_id, i FROM e ANTI JOIN (SELECT doc_id, i FROM d ANTI JOIN r USING (doc_id, i)) USING (doc_id, i) WHERE len(ws) > 0),
a AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed_lines FROM z GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN a USING (doc_id)""",
}
