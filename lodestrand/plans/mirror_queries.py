"""Queries of the table-maintenance problems 1, 3, 5 and 6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.change_feed import apply_change_feed
from lodestrand.operators.messages import keep_one_copy, surplus_messages
from lodestrand.operators.references import change_references, job_references, orphan_counts, orphan_references
from lodestrand.operators.snapshots import snapshot_changes
from lodestrand.sources.work import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that exist after the whole feed."""
    return apply_change_feed(table(spark, sf_dir, "recent_changes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed ids of every snapshot after the first."""
    return snapshot_changes(table(spark, sf_dir, "page_scans"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of changes per snapshot and kind."""
    return p3_found(spark, sf_dir).groupBy("seenInReconciliation", "change").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus rows of the change feed."""
    return surplus_messages(table(spark, sf_dir, "recent_changes"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with one copy of each message."""
    return keep_one_copy(table(spark, sf_dir, "recent_changes")).select("delivery_id", "type", "pageid", "revid", "rcid")


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = change_references(table(spark, sf_dir, "recent_changes")).unionByName(job_references(table(spark, sf_dir, "jobs")))
    parents = [table(spark, sf_dir, t).select("id", "storedAt", "tombstonedAt", "deleted") for t in ("pages", "file_resources")]
    return refs, parents[0].unionByName(parents[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned references of change feed and jobs."""
    return orphan_references(*_references(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_counts(*_references(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p5_found": p5_found,
    "p5_kept": p5_kept,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}

_P1 = """
WITH e AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rcid ORDER BY delivery_id) AS rn FROM recent_changes WHERE rcid IS NOT NULL AND pageid IS NOT NULL) WHERE rn = 1
), names AS (
  SELECT title, min(pageid) AS owner FROM (
    SELECT title, pageid FROM e WHERE pageid <> 0
    UNION ALL SELECT logparams['target_title'], pageid FROM e WHERE pageid <> 0 AND "type" = 'log' AND logtype = 'move') n
  GROUP BY title
), f AS (
  SELECT CASE WHEN e.pageid = 0 THEN names.owner ELSE e.pageid END AS page, e.rcid, e.revid,
    CASE WHEN "type" IN ('new', 'edit') THEN 'w' WHEN "type" = 'log' AND logtype = 'move' THEN 'm'
      WHEN "type" = 'log' AND logtype = 'delete' AND logaction IN ('delete', 'delete_redir') THEN 'd'
      WHEN "type" = 'log' AND logtype = 'delete' AND logaction = 'restore' THEN 'r' END AS kind,
    CASE WHEN "type" = 'log' THEN logparams['target_title'] ELSE e.title END AS new_title
  FROM e LEFT JOIN names ON e.pageid = 0 AND e.title = names.title AND "type" = 'log' AND logtype = 'delete' AND logaction IN ('delete', 'delete_redir')
), lasts AS (
  SELECT page, max(rcid) FILTER (kind = 'w') AS w, max(rcid) FILTER (kind IN ('w', 'm')) AS t, max(rcid) FILTER (kind IN ('w', 'd', 'r')) AS x
  FROM f WHERE page IS NOT NULL AND kind IS NOT NULL GROUP BY page
)
SELECT l.page AS pageid, fw.revid, ft.new_title AS title
FROM lasts l JOIN f fw ON fw.page = l.page AND fw.rcid = l.w JOIN f ft ON ft.page = l.page AND ft.rcid = l.t JOIN f fx ON fx.page = l.page AND fx.rcid = l.x
WHERE fx.kind <> 'd'
"""

_P3 = """
WITH l AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seenInReconciliation, id ORDER BY localSeq DESC) AS rn FROM page_scans) WHERE rn = 1 AND NOT coalesce(deleted, false)
), s AS (
  SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM (SELECT DISTINCT seenInReconciliation AS n FROM page_scans)
), a AS (SELECT l.* FROM l WHERE seenInReconciliation IN (SELECT nx FROM s)
), b AS (SELECT l.* EXCLUDE (seenInReconciliation), s.nx AS seenInReconciliation FROM l JOIN s ON l.seenInReconciliation = s.n WHERE s.nx IS NOT NULL)
SELECT coalesce(a.seenInReconciliation, b.seenInReconciliation) AS seenInReconciliation, coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.seenInReconciliation = b.seenInReconciliation AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.title IS DISTINCT FROM b.title OR a.namespace IS DISTINCT FROM b.namespace
  OR coalesce(a.isRedirect, false) <> coalesce(b.isRedirect, false) OR a.revisionId IS DISTINCT FROM b.revisionId OR a.contentModel IS DISTINCT FROM b.contentModel
"""

_P5_KEYS = """
WITH q AS (SELECT "type" AS t, pageid AS p, revid AS r, "timestamp" AS s, min(rcid) AS rc FROM recent_changes GROUP BY 1, 2, 3, 4),
k AS (
  SELECT c.*, coalesce(CAST(coalesce(c.rcid, q.rc) AS VARCHAR), concat_ws('|', c."type", c.pageid, c.revid, epoch_us(c."timestamp"))) AS mkey
  FROM recent_changes c LEFT JOIN q ON c.rcid IS NULL AND c."type" IS NOT DISTINCT FROM q.t AND c.pageid IS NOT DISTINCT FROM q.p
    AND c.revid IS NOT DISTINCT FROM q.r AND c."timestamp" IS NOT DISTINCT FROM q.s
), n AS (SELECT *, row_number() OVER (PARTITION BY mkey ORDER BY delivery_id) AS rn FROM k)
"""

_P6 = """
WITH refs AS (
  SELECT 'recent_changes' AS source_table, rcid AS row_id, pageid AS page, epoch_us("timestamp") AS ref_at FROM recent_changes WHERE rcid IS NOT NULL AND pageid <> 0
  UNION ALL SELECT 'jobs', id, pageId, updatedAt * 1000 FROM jobs WHERE id IS NOT NULL AND pageId IS NOT NULL
), par AS (
  SELECT id, storedAt, tombstonedAt, coalesce(deleted, false) AS gone FROM pages UNION ALL SELECT id, storedAt, tombstonedAt, coalesce(deleted, false) FROM file_resources
), orphans AS (
  SELECT DISTINCT source_table, coalesce(strftime(make_timestamp(ref_at), '%Y-%m'), 'unknown') AS period, row_id
  FROM refs LEFT JOIN par ON par.id = refs.page
  WHERE par.id IS NULL OR coalesce(ref_at < storedAt * 1000, false) OR (gone AND (ref_at IS NULL OR tombstonedAt IS NULL OR ref_at >= tombstonedAt * 1000))
)
"""

ORACLES = {
    "p1_found": _P1,
    "p3_found": _P3,
    "p3_counts": f"SELECT seenInReconciliation, change, count(*) AS n FROM ({_P3}) GROUP BY 1, 2",
    "p5_found": _P5_KEYS + "SELECT delivery_id FROM n WHERE rn > 1",
    "p5_kept": _P5_KEYS + 'SELECT delivery_id, "type", pageid, revid, rcid FROM n WHERE rn = 1',
    "p6_found": _P6 + "SELECT source_table, period, row_id FROM orphans",
    "p6_counts": _P6 + "SELECT source_table, period, count(*) AS orphans FROM orphans GROUP BY 1, 2",
}
