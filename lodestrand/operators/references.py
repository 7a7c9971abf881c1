"""References to records that do not exist (problem 6).

Method: a left anti join of the distinct non-null foreign keys against the parent keys gives the missing ones. A parent
may also be stored too late or be removed before the time of a reference: of the keys that have a parent, those whose
earliest or latest reference falls outside of its life are kept with its times. Both are joined back to the rows, from which
the counts per table and period follow. Only distinct keys meet the parent tables, and keys that orphan nothing, however many
references they have, are not joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(micros: Column) -> Column:
    """UTC month yyyy-MM of epoch microseconds, whatever the session's time zone; null gives unknown."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def change_references(feed: DataFrame) -> DataFrame:
    """(source_table, row_id, pageid, at) of the change feed, at in epoch microseconds."""
    return feed.where(F.col("rcid").isNotNull() & F.col("pageid").isNotNull() & (F.col("pageid") != 0)).select(
        F.lit("recent_changes").alias("source_table"), F.col("rcid").alias("row_id"), "pageid", F.unix_micros("timestamp").alias("at")
    )


def job_references(jobs: DataFrame) -> DataFrame:
    """(source_table, row_id, pageid, at) of the job table."""
    return jobs.where(F.col("pageId").isNotNull() & F.col("id").isNotNull()).select(
        F.lit("jobs").alias("source_table"),
        F.col("id").alias("row_id"),
        F.col("pageId").alias("pageid"),
        (F.col("updatedAt") * 1000).alias("at"),
    )


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(source_table, period, row_id) of the references that have no parent at their time, each once.

    ``parents`` has id, storedAt, tombstonedAt (epoch milliseconds) and deleted (null means false). A null
    time is never before ``storedAt``, nor is any time before a null ``storedAt``; a deleted parent orphans a
    reference at or after ``tombstonedAt``, and always if either time is null. Null keys are no references.
    Of several parent rows of one id the one stored last counts; empty tables are allowed.
    """
    removed = F.coalesce(F.col("deleted"), F.lit(False))
    at, never = F.col("at"), F.lit(None).cast("bigint")
    keys = references.where(F.col("pageid").isNotNull()).groupBy("pageid").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.bool_or(at.isNull()).alias("timeless"))
    stored, gone = F.col("storedAt") * 1000, F.when(removed, F.col("tombstonedAt") * 1000)
    present = (
        parents.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("pageid"))
        .agg(F.max(F.struct(stored.alias("stored"), removed.alias("removed"), gone.alias("gone"))).alias("p"))
        .select("pageid", "p.*")
    )
    missing = keys.join(present.select("pageid"), "pageid", "left_anti").select("pageid", F.lit(True).alias("missing"), never.alias("stored"), F.lit(False).alias("removed"), never.alias("gone"))
    outlived = F.col("removed") & (F.col("timeless") | F.col("gone").isNull() | (F.col("last") >= F.col("gone")))
    partly = keys.join(present, "pageid").where(F.coalesce(F.col("first") < F.col("stored"), F.lit(False)) | F.coalesce(outlived, F.lit(False)))
    facts = missing.unionByName(partly.select("pageid", F.lit(False).alias("missing"), "stored", "removed", "gone"))
    orphan = (
        F.col("missing")
        | F.coalesce(at < F.col("stored"), F.lit(False))
        | F.coalesce(F.col("removed") & (at.isNull() | F.col("gone").isNull() | (at >= F.col("gone"))), F.lit(False))
    )
    return (
        references.join(facts, "pageid")
        .where(orphan)
        .select("source_table", month_of(at).alias("period"), "row_id")
        .distinct()
    )


def orphan_counts(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphans per source table and period."""
    return orphan_references(references, parents).groupBy("source_table", "period").agg(F.count("*").alias("orphans"))
