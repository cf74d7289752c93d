"""Connected components of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and u's neighbours."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, component_id) for every id in a link; component_id is the least id reachable.

    Alternating large-star and small-star steps: each hangs neighbours on the least
    id of a neighbourhood, so the rounds grow with the logarithm of a component's
    size.  Every round is written to the shared folder; nothing reaches the driver
    but two counts.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _least_neighbour(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    )
