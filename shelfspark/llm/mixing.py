"""Operator 4: mixing sources to target weights by systematic sampling.

Method: a source's target, divided by its size, is the expected number of copies of
each of its documents.  Along an order of the source's documents the expected copies
are summed up, one random offset is added, and a document is taken once for every
integer boundary that its share crosses.

Targets: the sources share ``budget`` times all words by weight; none gets more than
``most_copies`` times its size, and what others cannot take is shared again by weight.

The order runs through blocks of a few thousand documents (by a hash), by size within
a block, upwards and downwards in turn: neighbours are of similar size, so that the
words taken come near the target, and a block, not a source, is what one task sorts.
Only counts of blocks are summed over a source.

Edge cases: null texts have size 0; a null source is a source of its own, the last;
null doc_ids are placed like empty ones; repeated rows are separate documents; sources
without words have target 0; other columns are kept by :func:`mixed_documents` and
ignored here; a very long text is one document of its size, which may be more than its
source's target; an empty table gives no rows.  The targets come from a window over one row for
each source, so sources are meant to be thousands, not millions.  Reruns agree: the offset comes from the
seed and the source's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import cut
from .sharding import key_number

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from a string."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most_copies: float) -> DataFrame:
    """(key, source_size, documents, target) by source; ``sizes`` has key (null sources last), size."""
    by_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    by_name = Window.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    # one row for each source from here on
    rows = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most_copies)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "key", "level"))).over(whole)["level"]
    return rows.select("key", "source_size", "documents", F.when(F.col("full"), F.col("cap")).otherwise(shared * F.col("weight")).alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0))).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("b"), "source"))  # code point order, null last
    return docs.select("doc_id", size.alias("size"), key.alias("key"))


def sampled_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most_copies: float = 2.0, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and copies."""
    return _sampled(cut(_keyed(docs).select("doc_id", "key", "size")), weights, budget, most_copies, seed)


def _sampled(sizes: DataFrame, weights: tuple[int, ...], budget: float, most_copies: float, seed: int) -> DataFrame:
    sources = cut(source_targets(sizes, weights, budget, most_copies))
    placed = sizes.join(sources, "key").withColumn("block", F.pmod(key_number(F.col("doc_id")), F.ceil(F.col("documents") / BLOCK_ROWS)))
    counts = placed.groupBy("key", "block").agg(F.count("*").alias("rows"))
    start = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "block", start.alias("start"))
    turn = F.when(F.col("block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    rank = F.row_number().over(Window.partitionBy("key", "block").orderBy(turn, "doc_id")) + F.col("start")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _uniform(F.concat(F.lit(f"{seed}:"), "key"))
    ranked = placed.join(starts, ["key", "block"]).withColumn("rank", rank).withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    return ranked.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most_copies: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Rows of one doc_id are one document and are taken alike."""
    sizes = _keyed(docs).groupBy("doc_id").agg(F.min("key").alias("key"), F.sum("size").alias("size"))
    taken = _sampled(cut(sizes), weights, budget, most_copies, seed).where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}  # the columns of docs may have any names
    rows = docs.toDF(*own).join(taken, F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("_id")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(k).alias(c) for k, c in own.items()))
