"""Counting hashes across all documents with packed exchanges.

Row-wise shuffles of one row for each window of the corpus cost many times the
text.  Here documents are dealt into *origins* (by a hash of doc_id, a few MB of
text each); every origin sends the distinct hashes that it holds, packed as one
binary value for each *bucket* of the hash space; a bucket sees every origin's
share, and answers each with one packed value in the same order.  So a frequent
hash is one entry for each origin, however many rows hold it, and neither an
origin nor a bucket grows with the corpus: their numbers do.

The answers return to the documents by ``cogroup`` on the origin.  All steps lie
in one lazy plan, in which Spark shuffles the texts once and reuses that
exchange.  Within an origin rows are sorted, so a recomputed task (after a lost
executor) packs the same hashes in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import ship_package
from shelfspark.sources.snapshot import cut, shared_path  # noqa: F401

#: What origins send and buckets answer. kind tells several exchanges apart.
PACKED = "origin int, kind int, bucket int, packed binary"
_PACKED = pa.schema([("origin", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])

#: Stands for a null doc_id inside the exchanges: larger than every other.
NO_ID = (1 << 63) - 1

ORIGIN_BYTES = 8 << 20
BUCKET_HASHES = 2 << 20


class Plan:
    """How many origins and buckets a table of texts gets, from its total size."""

    def __init__(self, docs: DataFrame, text: str = "text", per_word: int = 6):
        ship_package(docs.sparkSession)
        total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
        self.origins = max(1, -(-total // ORIGIN_BYTES))
        self.buckets = max(1, -(-total // per_word // BUCKET_HASHES))


def by_origin(docs: DataFrame, plan: Plan, text: str = "text", *more: str) -> DataFrame:
    """(origin, doc_id, text, more) of all rows; other columns do not travel. A null doc_id becomes NO_ID, see :func:`with_null_ids`."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        origin_of(doc_id, plan.origins, F.when(doc_id.isNull(), F.col(text))).alias("origin"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"), *more
    )


def origin_of(doc_id: Column, origins: int, also: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(None).cast("string") if also is None else also), F.lit(origins)).cast("int")


def with_null_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def ordered(table: pa.Table) -> pa.Table:
    """Rows of an origin in an order that depends on their values alone."""
    table = table.drop_columns(["origin"])
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]) if _repeats(table) else pc.sort_indices(table["doc_id"])
    return table.take(order)


def _repeats(table: pa.Table) -> bool:
    return table.num_rows != pc.count_distinct(table["doc_id"], mode="all").as_py()


class Cuts(NamedTuple):
    """The buckets that sorted hashes fall into, in order, and where each begins (and the last ends)."""

    buckets: np.ndarray
    edges: np.ndarray

    def spans(self):
        return zip(self.buckets.tolist(), self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)


def bounds(sorted_hashes: np.ndarray, buckets: int) -> Cuts:
    """Bucket = upper 32 bits * buckets / 2**32. The work is in proportion to the hashes, however many buckets there are."""
    bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begins = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))) if len(bucket) else np.zeros(0, np.int64)
    return Cuts(bucket[begins].astype(np.int64), np.append(begins, len(bucket)))


def pack(origin: int, kind: int, cuts: Cuts, *columns: np.ndarray) -> list[dict]:
    """One row for each bucket that gets anything; columns are aligned with the sorted hashes."""
    return [{"origin": origin, "kind": kind, "bucket": b, "packed": b"".join(planes(c[lo:hi]) for c in columns)} for b, lo, hi in cuts.spans()]


def planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit integers by significance, so that the shuffle's compression finds the equal ones."""
    if values.dtype == np.int64:
        return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return np.ascontiguousarray(values).tobytes()


def unpack(packed: bytes, *types) -> list[np.ndarray]:
    """The columns that :func:`pack` joined."""
    n, at, out = len(packed) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        size = np.dtype(t).itemsize * n
        raw = np.frombuffer(packed, np.uint8, size, at)
        out.append(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel() if np.dtype(t) == np.int64 else raw.view(t))
        at += size
    return out


def joined(found: np.ndarray, counts: np.ndarray, *lists: np.ndarray) -> bytes:
    """Hashes, the number of entries of each, and lists of these entries, as one value."""
    return b"".join(x.tobytes() for x in (np.array([len(found)], np.int64), found, counts, *lists))


def separated(packed: bytes, *types) -> list[np.ndarray]:
    """What :func:`joined` joined; the first two of ``types`` are those of hashes and counts."""
    n, at, out = int(np.frombuffer(packed, np.int64, 1)[0]), 8, []
    for i, t in enumerate(types):
        size = n if i < 2 else int(out[1].sum())
        out.append(np.frombuffer(packed, t, size, at))
        at += out[-1].nbytes
    return out


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _PACKED)


def answer(sent: DataFrame, kind: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """For each bucket, ``reply`` gets all origins' packed values and returns as many."""

    def one(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["origin"]))
        replies = reply([v.as_buffer() for v in table["packed"].combine_chunks()] if table.num_rows else [])
        return table_of([{"origin": o, "kind": kind, "bucket": b, "packed": r} for o, b, r in zip(table["origin"].to_pylist(), table["bucket"].to_pylist(), replies, strict=True)])

    return sent.groupBy("bucket").applyInArrow(one, PACKED)


def answers(side: pa.Table, kind: int) -> Iterator[bytes]:
    """An origin's answers of one kind, by bucket."""
    mine = side.filter(pc.equal(side["kind"], kind))
    mine = mine.take(pc.sort_indices(mine["bucket"]))
    return [v.as_py() for v in mine["packed"]]


def bits(packed: list[bytes], cuts: Cuts) -> np.ndarray:
    """Bit masks by bucket, joined; a bucket that got nothing answered nothing."""
    sizes = np.diff(cuts.edges)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(p, np.uint8), count=int(n)).astype(bool) for p, n in zip(packed, sizes, strict=True))])


def with_side(docs: DataFrame, side: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(origin, documents, side rows)`` for each origin that has documents."""
    out = pa_schema(schema)

    def both(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        return fn(key[0].as_py(), ordered(left), right)

    return docs.groupBy("origin").cogroup(side.groupBy("origin")).applyInArrow(both, schema)


def alone(docs: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(origin, documents)`` for each origin."""
    return docs.groupBy("origin").applyInArrow(lambda key, table: fn(key[0].as_py(), ordered(table)), schema)


def pa_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of the types used here."""
    kinds = {"array<long>": pa.list_(pa.int64()), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
