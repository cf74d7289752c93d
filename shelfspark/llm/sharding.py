"""Operator 1: shards by a permutation-filled lookup table.

Method: every shard has a permutation of the table's slots (offset + j * skip, modulo
a prime).  Shards take turns, each claiming the first slot of its permutation that is
still free, until all slots are taken.  A row's key hashes to a slot, and the table,
whose size is a parameter, is broadcast; so placement takes constant time, shards
differ by at most one slot, and removing a shard moves few rows of the others.

Edge cases: a null key is placed like an empty one; equal keys share a shard; columns
of rows keep their names, so the new ones are _slot and _shard beside a slot or shard; other
columns, and texts of any length, are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_number(key: Column) -> Column:
    """60 bits of the md5 of a key, as a long; the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int = 65_537) -> list[int]:
    """The index of the owning shard for each slot."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots:
        raise ValueError("shards must be distinct, and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        owner[at[k]] = k
    return owner


def assign_shards(rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = 65_537) -> DataFrame:
    """``rows`` with slot and shard, or ``_slot`` and ``_shard`` (or more underscores) where rows has such columns."""
    owner = lookup_table(shards, slots)
    slot, shard = (_free(name, rows.columns) for name in ("slot", "shard"))
    table = rows.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner)], f"{slot} int, {shard} string")
    placed = rows.withColumn(slot, F.pmod(key_number(F.col(key)), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table), slot).select(*rows.columns, slot, shard)  # the table has exactly `slots` rows


def _free(name: str, taken: list[str]) -> str:
    return _free(f"_{name}", taken) if name.lower() in {c.lower() for c in taken} else name


def write_shards(rows: DataFrame, path: str, shards: list[str], files_per_shard: int = 1, **how) -> None:
    """One folder for each shard; a shard's rows are dealt to ``files_per_shard`` tasks."""
    placed = assign_shards(rows, shards, **how)
    dealt = placed.repartition(len(shards) * files_per_shard, placed.columns[-1], F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_shard)))
    dealt.write.partitionBy(placed.columns[-1]).parquet(path)
