"""Control records: one JSON object a row, with the version of its form.

A record that is damaged, lacks its version or kind, or comes from a later version is null, so a reader
skips it and goes on.  Fields that a reader does not know are ignored; those that are absent are null.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
#: What a scan tells while it runs and when it ends.
RECORD = "version int, kind string, volume string, done long, total long, finished boolean, error string"
KINDS = ("progress", "finished", "failed", "cancelled")


def control_record(kind: Column, volume: Column, done: Column, total: Column, error: Column | None = None) -> Column:
    """A record as JSON text; ``finished`` follows from its kind."""
    fields = {"version": F.lit(VERSION), "kind": kind, "volume": volume, "done": done.cast("long"), "total": total.cast("long"), "finished": kind != "progress", "error": F.lit(None).cast("string") if error is None else error}
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def parsed_record(text: Column) -> Column:
    """The record of a line as a struct (``RECORD``); null if it can't be used."""
    record = F.from_json(text, RECORD, {"mode": "PERMISSIVE"})
    usable = (record["version"] <= VERSION) & (record["version"] > 0) & record["kind"].isin(*KINDS)
    return F.when(usable, record)


def last_of(volume: Column, record: Column, order: Column) -> Column:
    """Aggregate: the record that tells how a volume stands, the last one that ends it or else the last of all."""
    return F.max_by(record, F.struct(record["finished"], order))


class Record(NamedTuple):
    """A control record outside of a table."""

    kind: str
    volume: str
    done: int = 0
    total: int = 0
    error: str | None = None

    def text(self) -> str:
        return json.dumps({"version": VERSION, **self._asdict(), "finished": self.kind != "progress"})


def record_of(text: str) -> Record | None:
    """The record of a line; None where :func:`parsed_record` is null."""
    try:
        fields = json.loads(text)
        record = Record(*(fields.get(name) for name in Record._fields))
        return record if 0 < fields["version"] <= VERSION and record.kind in KINDS else None
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
