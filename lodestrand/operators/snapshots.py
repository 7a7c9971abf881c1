"""What changed between consecutive full snapshots (problem 3).

Method: EXCEPT ALL both ways removes identical rows, a full join of the residues by key labels the rest.
Both EXCEPT ALLs are taken in one aggregation: rows of a snapshot count +1, the same rows of the snapshot
before count -1, and what does not cancel is the residue of one side or the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = ("title", "namespace", "isRedirect", "revisionId", "contentModel")


def latest_rows(scans: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """One live row per snapshot and id: the one with the highest ``localSeq`` unless it is deleted.

    A null ``localSeq`` is lower than any; ties are broken by the row's values, so the result is stable.
    """
    order = F.struct(F.coalesce(F.col("localSeq"), F.lit(-(2**62))).alias("s"), *columns, "deleted")
    return (
        scans.where(F.col("seenInReconciliation").isNotNull() & F.col("id").isNotNull())
        .withColumn("isRedirect", F.coalesce("isRedirect", F.lit(False)))
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        .groupBy("seenInReconciliation", "id")
        .agg(F.max(order).alias("r"))
        .where(~F.col("r.deleted"))
        .select("seenInReconciliation", "id", *[F.col(f"r.{c}").alias(c) for c in columns])
    )


def snapshot_changes(scans: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """(seenInReconciliation, id, change) for every snapshot but the first; change is added, removed or changed.

    A snapshot is compared with the next lower number present, gaps allowed. Nulls equal nulls and differ
    from any value, except null ``isRedirect`` and ``deleted``, which mean false. A snapshot whose rows are
    all deleted still counts as a snapshot. Empty input or a single snapshot gives no rows; further columns
    are ignored; rows without snapshot number or id are left out.
    """
    live = latest_rows(scans, columns)
    numbers = scans.select("seenInReconciliation").where("seenInReconciliation is not null").distinct()
    # the few snapshot numbers: an aggregate of one row, exploded to (number, next)
    steps = (
        numbers.agg(F.array_sort(F.collect_set("seenInReconciliation")).alias("s"))
        .select(
            F.explode(
                F.when(
                    F.size("s") > 1,
                    F.arrays_zip(
                        F.slice("s", 1, F.size("s") - 1).alias("seenInReconciliation"),
                        F.slice("s", 2, F.size("s") - 1).alias("next"),
                    ),
                )
            ).alias("x")
        )
        .select(F.col("x.seenInReconciliation"), F.col("x.next").alias("next"))
    )
    later = live.join(F.broadcast(steps.select(F.col("next").alias("seenInReconciliation"))), "seenInReconciliation", "left_semi")
    earlier = live.join(F.broadcast(steps), "seenInReconciliation").withColumn("seenInReconciliation", F.col("next")).drop("next")
    residue = (
        later.withColumn("n", F.lit(1))
        .unionByName(earlier.withColumn("n", F.lit(-1)))
        .groupBy("seenInReconciliation", "id", *columns)
        .agg(F.sum("n").alias("n"))
        .where("n <> 0")
    )
    new = residue.where("n > 0").select("seenInReconciliation", "id", F.lit(True).alias("new"))
    old = residue.where("n < 0").select("seenInReconciliation", "id", F.lit(True).alias("old"))
    return new.join(old, ["seenInReconciliation", "id"], "full_outer").select(
        "seenInReconciliation",
        "id",
        F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).otherwise(F.lit("changed")).alias("change"),
    )
