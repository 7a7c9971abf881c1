"""Keeping a mirror in step with its source: change log, scans and sequences (section 2.16).

Every function is declarative; what a browser does record by record over key lookups is here a join or an
aggregation whose partial results combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.sources.work import materialize

# fixed values: log types that touch a page
PAGE_LOGS = ("move", "delete", "import", "protect", "merge", "upload")
FACTS = ("title", "namespace", "isRedirect", "deleted", "revisionId", "contentModel")


def differs(columns: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Whether any column differs, null being a value of its own."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def is_edit() -> Column:
    return F.col("type").isin("edit", "new") & (F.col("pageid") > 0)


def is_page_log() -> Column:
    return (F.col("type") == "log") & F.col("logtype").isin(*PAGE_LOGS)


def window_from(feed: DataFrame, through: Column, overlap: str = "5 minutes") -> DataFrame:
    """Events from the committed cursor less the overlap, both ends included."""
    return feed.where(F.col("timestamp") >= through - F.expr(f"INTERVAL {overlap}"))


def new_events(feed: DataFrame, seen: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The first arrival of every rcid that is not among ``seen``; rows without rcid or ``delivery_id`` are left out.

    One aggregation by rcid that carries ``columns`` (default all), so only those are read and shuffled.
    """
    own = [c for c in columns or feed.columns if c not in ("rcid", "delivery_id")]
    rows = feed.where(F.col("rcid").isNotNull() & F.col("delivery_id").isNotNull())
    first = rows.groupBy("rcid").agg(F.min("delivery_id").alias("delivery_id"), *([F.min_by(F.struct(*own), "delivery_id").alias("_r")] if own else []))
    if seen is not None:
        first = first.join(seen.select("rcid").where(F.col("rcid").isNotNull()), "rcid", "left_anti")
    return first.select(*[F.col(f"_r.{c}").alias(c) if c in own else F.col(c) for c in columns or feed.columns])


def retained_markers(previous: DataFrame, events: DataFrame, through: Column, overlap: str = "5 minutes") -> DataFrame:
    """Rcid and timestamp of what may arrive again; of several rows of one rcid the latest event counts."""
    both = previous.select("rcid", "timestamp", F.lit(0).alias("n")).unionByName(events.select("rcid", "timestamp", F.lit(1).alias("n")))
    kept = both.where(F.col("rcid").isNotNull() & (F.col("timestamp") >= through - F.expr(f"INTERVAL {overlap}")))
    return kept.groupBy("rcid").agg(F.max(F.struct("n", "timestamp")).alias("m")).select("rcid", F.col("m.timestamp").alias("timestamp"))


def latest_per_page(events: DataFrame) -> DataFrame:
    """The event that decides a page: pageid, delivery_id.

    In order of arrival an edit replaces an event of at most its revision, a log entry replaces any. So it is the
    edit of the highest revision since the last log entry, the later of equals, or that entry itself.
    """
    chosen = events.where(F.coalesce(is_edit() | (is_page_log() & (F.col("logtype") != "move") & (F.col("pageid") > 0)), F.lit(False)))
    slim = chosen.select("pageid", "delivery_id", F.coalesce("revid", F.lit(0)).alias("revid"), (F.col("type") == "log").alias("log"))
    last_log = slim.groupBy("pageid").agg(F.coalesce(F.max(F.when(F.col("log"), F.col("delivery_id"))), F.lit(0)).alias("since"))
    rest = slim.join(last_log, "pageid").where(F.col("delivery_id") >= F.col("since"))
    return rest.groupBy("pageid").agg(F.max(F.struct("revid", "delivery_id")).alias("m")).select("pageid", F.col("m.delivery_id").alias("delivery_id"))


def affected_titles(events: DataFrame) -> DataFrame:
    """Distinct titles that have to be looked up by name: both ends of moves, log entries without a page id."""
    log = events.where(F.coalesce(is_page_log(), F.lit(False)))
    target = F.when(F.col("logtype") == "move", F.col("logparams")["target_title"])
    named = F.when((F.col("logtype") == "move") | (F.col("pageid") <= 0), F.col("title"))
    return log.select(F.explode(F.array(named, target)).alias("title")).where(F.col("title") != "").distinct()


def merge_scan(stored: DataFrame, scanned: DataFrame, fence: Column | None = None) -> DataFrame:
    """Scanned rows against stored ones: id, action, title, revisionId.

    action is added, changed or unchanged; kept where the stored row has a higher revision or was written after
    the ``fence`` (localSeq at the start of the scan). A null ``deleted`` is false. Both inputs have unique ids.
    """
    plain = lambda df: df.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("isRedirect", F.coalesce("isRedirect", F.lit(False)))
    a, b = plain(scanned).alias("a"), plain(stored).alias("b")
    late = F.coalesce(F.col("b.localSeq") > fence, F.lit(False)) if fence is not None else F.lit(False)
    newer = F.coalesce(F.col("b.revisionId") > F.col("a.revisionId"), F.lit(False))
    action = (
        F.when(F.col("b.id").isNull(), "added").when(late | newer, "kept").when(differs(FACTS), "changed").otherwise("unchanged")
    )
    keep = action == "kept"
    pick = lambda c: F.when(keep, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.id") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), action.alias("action"), pick("title"), pick("revisionId"))


def sweep(stored: DataFrame, scanned: DataFrame, fence: Column) -> DataFrame:
    """Live rows that the scan did not see and that were not written after its start: to be tombstoned."""
    live = stored.where(~F.coalesce(F.col("deleted"), F.lit(False)) & (F.coalesce("localSeq", F.lit(0)) <= fence))
    return live.join(scanned.select("id"), "id", "left_anti")


def tombstone(rows: DataFrame) -> DataFrame:
    """P10: the rows marked deleted, without bodies."""
    return rows.withColumns({"deleted": F.lit(True), "content": F.lit(None).cast("string"), "contentRevisionId": F.lit(None).cast("bigint")})


def tombstones_by_name(stored: DataFrame, missing: DataFrame, active_ids: DataFrame) -> DataFrame:
    """Live rows whose title is reported missing and whose id is not active."""
    live = stored.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return tombstone(live.join(missing.select("title").distinct(), "title", "left_semi").join(active_ids.select("id"), "id", "left_anti").select(*stored.columns))


def assign_sequence(rows: DataFrame, order: Sequence[str], base: int = 0, column: str = "localSeq") -> DataFrame:
    """``base`` + 1, 2, ... in ``order``, over any number of rows: no task sees more than its range partition.

    Rows are sorted by range, numbered within their partition and shifted by the counts of the partitions before.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sequence")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(before.select("_p", "_before")), "_p")
    return numbered.withColumn(column, F.lit(base) + F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def chunks(rows: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """Number of the fixed-size chunk of every row."""
    return assign_sequence(rows, order, column="_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")


def rows_after(stored: DataFrame, sequence: int) -> DataFrame:
    """Rows changed after a sequence, tombstones included; the filter reaches the Parquet scan."""
    return stored.where(F.col("localSeq") > sequence)


def highest_sequence(pages: DataFrame, files: DataFrame) -> DataFrame:
    """G1: one row, the highest sequence of pages and files, 0 without any."""
    a, b = pages.agg(F.max("localSeq").alias("a")), files.agg(F.max("writerSeq").alias("b"))
    return a.crossJoin(b).select(F.coalesce(F.greatest("a", "b"), F.lit(0)).alias("localSeq"))


def late_bodies(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Expected (pageid, revid) against received (pageid, revid): ok, defer (newer), stale or missing."""
    joined = expected.alias("e").join(received.alias("r"), F.col("e.pageid") == F.col("r.pageid"), "left")
    r, e = F.col("r.revid"), F.col("e.revid")
    return joined.select(F.col("e.pageid").alias("pageid"), F.when(r.isNull(), "missing").when(r == e, "ok").when(r > e, "defer").otherwise("stale").alias("result"))


def outer_repair(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages (pageId, wanted) against jobs (pageId, status, one per page): keep, put or delete per page."""
    joined = pages.alias("p").join(jobs.alias("j"), F.col("p.pageId") == F.col("j.pageId"), "full_outer")
    action = F.when(F.col("p.pageId").isNull(), "delete").when(F.col("j.status").eqNullSafe(F.col("p.wanted")), "keep").otherwise("put")
    return joined.select(F.coalesce("p.pageId", "j.pageId").alias("pageId"), action.alias("action"))


def namespace_options(pages: DataFrame) -> DataFrame:
    """Namespaces with the name that the highest id has."""
    return pages.groupBy("namespace").agg(F.max_by("namespaceName", "id").alias("name"))


def status_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of the number of rows per status between two states of the changed rows."""
    both = before.select("status", F.lit(-1).alias("n")).unionByName(after.select("status", F.lit(1).alias("n")))
    return both.groupBy("status").agg(F.sum("n").alias("delta")).where("delta <> 0")


def touches(changed: DataFrame, namespace: int) -> DataFrame:
    """One row, whether any changed row was or is in a namespace (columns namespace and old_namespace)."""
    hit = F.coalesce(F.col("namespace") == namespace, F.lit(False)) | F.coalesce(F.col("old_namespace") == namespace, F.lit(False))
    return changed.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("touched"))
