"""Stamps of volumes: how far each volume's journal was read, and what an update has to do with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.snapshot import carry_over

JOURNALS = "letter string, serial long, journal_id long, first_usn long, next_usn long"
FROM_CURSOR, FULL, KEEP = "from_cursor", "full", "keep"


def network_drives(volumes: DataFrame) -> DataFrame:
    """(letter, label, remote) of the volumes that are on a network; of several rows of a letter one that names its target."""
    rows = volumes.where("kind = 'network'").groupBy("letter").agg(F.max(F.struct(F.col("remote").isNotNull().alias("known"), "remote", "label")).alias("v"))
    return rows.select("letter", "v.label", "v.remote")


def update_plan(stamps: DataFrame, journals: DataFrame) -> DataFrame:
    """(letter, action, reason, from_usn, to_usn) of every volume that has a stamp or is attached.

    ``stamps``: letter, serial, journal_id, next_usn as stored; ``journals``: the attached volumes
    as they say now (``JOURNALS``; a null journal_id: off or being deleted).  A volume that is not
    attached keeps its entries and its stamp; one whose position is worthless is scanned in full.
    """
    old = stamps.select("letter", F.col("serial").alias("old_serial"), F.col("journal_id").alias("old_journal"), F.col("next_usn").alias("from_usn"), F.lit(True).alias("stamped"))
    new = journals.select("letter", "serial", "journal_id", "first_usn", F.col("next_usn").alias("to_usn"), F.lit(True).alias("attached"))
    reason = (
        F.when(F.col("attached").isNull(), "not attached")
        .when(F.col("stamped").isNull(), "never scanned")
        .when(~F.col("serial").eqNullSafe(F.col("old_serial")), "another volume")
        .when(F.col("journal_id").isNull(), "the journal is off or being deleted")
        .when(~F.col("journal_id").eqNullSafe(F.col("old_journal")), "the journal was replaced")
        .when(F.col("from_usn").isNull() | (F.col("from_usn") < F.col("first_usn")), "records were lost before they were read")
    )
    rows = old.join(new, "letter", "full").withColumn("reason", reason)
    action = F.when(F.col("attached").isNull(), KEEP).when(F.col("reason").isNull(), FROM_CURSOR).otherwise(FULL)
    usable = action == FROM_CURSOR
    return rows.select("letter", action.alias("action"), "reason", F.when(usable, F.col("from_usn")).alias("from_usn"), F.when(usable, F.col("to_usn")).alias("to_usn"))


def unread(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Decoded ``records`` (with letter and usn) from each volume's stored position on, up to the journal's end."""
    spans = plan.where(F.col("action") == FROM_CURSOR).select("letter", "from_usn", "to_usn")
    return records.join(spans, "letter").where("usn >= from_usn and usn < to_usn").drop("from_usn", "to_usn")


def moved_stamps(stamps: DataFrame, journals: DataFrame, scanned: DataFrame) -> DataFrame:
    """The stamps after an update: those of the volumes ``scanned`` (letter) as their journals say now, all others carried over."""
    columns = ["letter", "serial", "journal_id", "next_usn"]
    new = journals.join(scanned.select("letter").distinct(), "letter").select(*columns)
    return carry_over(stamps.select(*columns), new, scanned.select("letter"))
