"""Training-data pipeline over ``documents``: quality rules, near-duplicate removal,
benchmark decontamination, mixing to target weights, sharding.

Every stage gets what its predecessor kept, written as Parquet and read again, and all
but the last return the columns of ``documents``.  Rows without a doc_id pass the
near-duplicate and the benchmark stage, which cannot name them; rows that share one
doc_id stand and fall together.  Null and empty texts fail the base rule and go in the first
stage; very long texts are judged, compared, mixed and placed whole; an empty table, or one of
which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm.decontaminate import benchmark_hits
from shelfspark.llm.exchange import cut
from shelfspark.llm.mixing import mixed_documents
from shelfspark.llm.ngram_join import ngram_jaccard_components
from shelfspark.llm.quality_rules import kept_documents
from shelfspark.llm.queries import SHARDS, SLOTS
from shelfspark.llm.sharding import assign_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on five-word shingles, the document of the least doc_id stays."""
    groups = ngram_jaccard_components(docs, shingle_words=5, percent=80)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10, k=5)
    return docs.join(hits.where("n_hit > 0").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: up to twice, or not at all."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return assign_shards(docs, SHARDS, slots=SLOTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A learned rule list has no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
