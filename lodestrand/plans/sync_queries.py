"""Queries of the mirror operators over change log, scans, pages and jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.engine import ROW, Engine
from lodestrand.functions.text import Analyzer
from lodestrand.operators import jobs as queue
from lodestrand.operators import mirror
from lodestrand.operators.snapshots import latest_rows
from lodestrand.sources.store import Store
from lodestrand.sources.work import fresh_path, table
from lodestrand.streaming.feed import FeedMirror, read_feed
from lodestrand.streaming.sync import Sync

CURSOR = "2025-06-01 00:00:00"
FENCE = 30_000
EVENT = ["delivery_id", "rcid", "pageid", "revid", "type", "title"]


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "recent_changes")


def _through():
    return F.lit(CURSOR).cast("timestamp_ltz")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot: one live row per id."""
    scans = table(spark, sf_dir, "page_scans")
    last = scans.agg(F.max("seenInReconciliation").alias("seenInReconciliation"))
    return latest_rows(scans.join(F.broadcast(last), "seenInReconciliation", "left_semi")).withColumn("deleted", F.lit(False))


def rc_dedup(spark, sf_dir):
    return mirror.new_events(_feed(spark, sf_dir), columns=EVENT)


def rc_overlap_window(spark, sf_dir):
    return mirror.window_from(_feed(spark, sf_dir), _through()).select("delivery_id", "rcid")


def rc_retained_markers(spark, sf_dir):
    f = _feed(spark, sf_dir)
    old = f.where(F.col("timestamp") < _through())
    return mirror.retained_markers(old, f.where(F.col("timestamp") >= _through()), _through(), "30 days").withColumn("timestamp", F.unix_micros("timestamp"))


def rc_latest_per_page(spark, sf_dir):
    return mirror.latest_per_page(mirror.new_events(_feed(spark, sf_dir), columns=["delivery_id", "rcid", "type", "pageid", "revid", "logtype"]))


def rc_affected_titles(spark, sf_dir):
    return mirror.affected_titles(_feed(spark, sf_dir))


def rc_merge_pages(spark, sf_dir):
    return mirror.merge_scan(table(spark, sf_dir, "pages"), _scan(spark, sf_dir).where("namespace <> 6"))


def reconcile_fence(spark, sf_dir):
    return mirror.merge_scan(table(spark, sf_dir, "pages"), _scan(spark, sf_dir).where("namespace <> 6"), F.lit(FENCE))


def reconcile_sweep(spark, sf_dir):
    return mirror.tombstone(mirror.sweep(table(spark, sf_dir, "pages"), _scan(spark, sf_dir), F.lit(FENCE))).select("id", "title", "deleted", "content")


def rc_tombstones(spark, sf_dir):
    events, pages = mirror.new_events(_feed(spark, sf_dir), columns=["rcid", "type", "logtype", "logaction", "pageid", "title"]), table(spark, sf_dir, "pages")
    gone = events.where("type = 'log' and logtype = 'delete' and logaction in ('delete', 'delete_redir') and pageid = 0").select("title")
    active = events.where("type = 'new'").select(F.col("pageid").alias("id")).distinct()
    return mirror.tombstones_by_name(pages, gone, active).select("id", "title", "deleted", "content")


def rc_sequence_assign(spark, sf_dir):
    return mirror.assign_sequence(mirror.new_events(_feed(spark, sf_dir), columns=["delivery_id", "rcid"]), ["delivery_id"], base=1000)


def batch_chunks(spark, sf_dir):
    return mirror.chunks(table(spark, sf_dir, "pages").select("id"), ["id"])


def seq_delta_scan(spark, sf_dir):
    return mirror.rows_after(table(spark, sf_dir, "pages"), FENCE).select("id", "title", "localSeq", "deleted")


def local_sequence(spark, sf_dir):
    return mirror.highest_sequence(table(spark, sf_dir, "pages"), table(spark, sf_dir, "file_resources"))


def rc_deferred_bodies(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return mirror.late_bodies(
        pages.where("revisionId is not null").select(F.col("id").alias("pageid"), F.col("revisionId").alias("revid")),
        pages.where("content is not null and contentRevisionId is not null").select(F.col("id").alias("pageid"), F.col("contentRevisionId").alias("revid")),
    )


def _jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "jobs").distinct()


def jobs_status_counts(spark, sf_dir):
    status = F.when(F.col("status") == "running", "pending").otherwise(F.col("status")).alias("status")
    return _jobs(spark, sf_dir).groupBy(status).agg(F.count("*").alias("n"))


def jobs_repair(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("not coalesce(deleted, false)")
    wanted = F.when(F.col("content").isNotNull() & F.col("contentRevisionId").eqNullSafe(F.col("revisionId")), "done").otherwise("pending")
    jobs = _jobs(spark, sf_dir).groupBy("pageId").agg(F.max(F.struct("id", "status")).alias("j")).select("pageId", "j.status")
    return mirror.outer_repair(pages.select(F.col("id").alias("pageId"), wanted.alias("wanted")), jobs)


def jobs_stale(spark, sf_dir):
    live = table(spark, sf_dir, "pages").where("not coalesce(deleted, false)").select(F.col("id").alias("pageId"))
    return _jobs(spark, sf_dir).join(live, "pageId", "left_anti").select("id", "pageId")


def namespace_options(spark, sf_dir):
    return mirror.namespace_options(table(spark, sf_dir, "pages"))


def diagnostics_counts(spark, sf_dir):
    live = ~F.coalesce(F.col("deleted"), F.lit(False))
    model = F.lower("contentModel")
    return table(spark, sf_dir, "pages").agg(
        F.count_if(live).alias("live"), F.count_if(~live).alias("deleted"), F.count_if(live & F.col("content").isNotNull()).alias("bodies"),
        F.count_if(live & (model == "scribunto") & F.col("content").isNotNull()).alias("lua"), F.count_if(F.coalesce("isRedirect", F.lit(False))).alias("redirects"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
    )


def jobs_claimed(spark, sf_dir):
    """Every pending job with the batch it is fetched in."""
    return queue.claims(queue.current_jobs(table(spark, sf_dir, "jobs")))


def jobs_wanted(spark, sf_dir):
    """Every page's job as it has to be, and what becomes of the one it has."""
    return queue.repaired(queue.current_jobs(table(spark, sf_dir, "jobs")), queue.wanted_jobs(table(spark, sf_dir, "pages")))


def jobs_settled(spark, sf_dir):
    """All pending jobs fetched; the answers are the bodies that the mirror holds, one in seven of them missing."""
    pages, jobs = table(spark, sf_dir, "pages"), queue.current_jobs(table(spark, sf_dir, "jobs"))
    answers = pages.where("content is not null and id % 7 <> 0").select(
        F.col("id").alias("pageid"), F.col("contentRevisionId").alias("revid"), F.col("contentModel").alias("contentmodel"), F.col("content")
    )
    done = queue.settled(queue.claims(jobs), pages, answers)
    return done.select("pageId", "result", "revisionId", "contentRevisionId", "contentModel", F.length("content").cast("long").alias("chars"), "changed")


def _synced(spark, sf_dir) -> Sync:
    """One run over the change log after the cursor, against the last snapshot as the source; a body names its page and revision."""
    remote = _scan(spark, sf_dir).select(
        F.col("id").alias("pageid"), F.col("namespace").alias("ns"), "title", F.coalesce("isRedirect", F.lit(False)).alias("redirect"), F.col("revisionId").alias("lastrevid"),
        F.col("contentModel").alias("contentmodel"), F.lit(False).alias("missing"),
    )

    def lookup(ids, titles):
        gone = [F.lit(None).cast(t).alias(c) for c, t in (("ns", "bigint"), ("title", "string"), ("redirect", "boolean"), ("lastrevid", "bigint"), ("contentmodel", "string"))]
        by_id = remote.join(ids, "pageid", "left_semi").unionByName(ids.join(remote, "pageid", "left_anti").select("pageid", *gone, F.lit(True).alias("missing")))
        unknown = titles.join(remote, "title", "left_anti").withColumns({"pageid": F.lit(None).cast("bigint"), "ns": F.lit(0).cast("bigint"), "missing": F.lit(True)})
        by_title = remote.join(titles, "title", "left_semi").unionByName(unknown, allowMissingColumns=True)
        return by_id.unionByName(by_title)

    def bodies(ids):
        found = remote.join(ids, "pageid", "left_semi")
        return found.select("pageid", F.lit(False).alias("missing"), F.col("lastrevid").alias("revid"), "contentmodel", F.concat_ws(" ", F.lit("body"), "pageid", "lastrevid").alias("content"))

    engine = Engine(spark, fresh_path(spark, "mirror"), Analyzer(compatibility=False))
    pages, jobs = table(spark, sf_dir, "pages"), queue.current_jobs(table(spark, sf_dir, "jobs"))
    rows = pages.withColumns({"deleted": F.coalesce("deleted", F.lit(False)), "isRedirect": F.coalesce("isRedirect", F.lit(False))}).select(*[F.col(c).cast(t) for c, t in ROW.items()])
    start = {"pages.complete": CURSOR, "changes.through": CURSOR, "local-sequence": pages.agg(F.max("localSeq")).first()[0] or 0, "last-job": jobs.agg(F.max("id")).first()[0] or 0}
    states = jobs.withColumns({"removed": F.lit(False), "version": F.lit(0).cast("bigint")})
    engine.store.update(lambda _: ({"pages": rows, "jobs": states}, start))
    sync = Sync(engine, lookup, bodies)
    sync.changes(_feed(spark, sf_dir), "2099-01-01 00:00:00")
    return sync


def rc_sync_pages(spark, sf_dir):
    """The mirror's pages after one run."""
    rows = _synced(spark, sf_dir).engine.rows()
    return rows.select("id", "title", "namespace", "isRedirect", "deleted", "revisionId", "contentModel", "contentRevisionId", F.length("content").cast("long").alias("chars"), "localSeq")


def rc_sync_jobs(spark, sf_dir):
    """T5: the queue after the same run."""
    return _synced(spark, sf_dir).jobs().select("id", "pageId", "status", "targetRevisionId")


def stream_rc_dedup(spark, sf_dir):
    """The change log consumed as a stream into the versioned store."""
    path, feed = fresh_path(spark, "stream"), _feed(spark, sf_dir)
    mirrored = FeedMirror(Store(spark, f"{path}/store", {"events": 1}), EVENT)
    mirrored.run(read_feed(spark, f"{sf_dir}/recent_changes.parque[t]", feed.schema), f"{path}/checkpoint")
    return mirrored.events()


QUERIES = {
    f.__name__: f
    for f in (
        rc_dedup, rc_overlap_window, rc_retained_markers, rc_latest_per_page, rc_affected_titles, rc_merge_pages, reconcile_fence, reconcile_sweep, rc_tombstones,
        rc_sequence_assign, batch_chunks, seq_delta_scan, local_sequence, rc_deferred_bodies, jobs_status_counts, jobs_repair, jobs_stale, namespace_options,
        diagnostics_counts, stream_rc_dedup, jobs_claimed, jobs_wanted, jobs_settled, rc_sync_pages, rc_sync_jobs,
    )
}

_DEDUP = 'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rcid ORDER BY delivery_id) AS rn FROM recent_changes WHERE rcid IS NOT NULL) WHERE rn = 1'
_EVENTS = f'SELECT delivery_id, rcid, pageid, revid, "type", title FROM ({_DEDUP})'
_PAGELOG = "\"type\" = 'log' AND logtype IN ('move', 'delete', 'import', 'protect', 'merge', 'upload')"
_SCAN = """SELECT id, title, namespace, coalesce(isRedirect, false) AS isRedirect, revisionId, contentModel, false AS deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY localSeq DESC) AS rn FROM page_scans WHERE seenInReconciliation = (SELECT max(seenInReconciliation) FROM page_scans)) WHERE rn = 1 AND NOT coalesce(deleted, false)"""
_MERGE = """WITH a AS (SELECT * FROM ({scan}) WHERE namespace <> 6), m AS (SELECT a.*, b.title AS bt, b.revisionId AS br,
  CASE WHEN b.id IS NULL THEN 'added' WHEN coalesce(b.revisionId > a.revisionId, false) OR {late} THEN 'kept'
  WHEN a.title IS DISTINCT FROM b.title OR a.namespace IS DISTINCT FROM b.namespace OR a.isRedirect IS DISTINCT FROM coalesce(b.isRedirect, false)
    OR coalesce(b.deleted, false) OR a.revisionId IS DISTINCT FROM b.revisionId OR a.contentModel IS DISTINCT FROM b.contentModel THEN 'changed' ELSE 'unchanged' END AS action
  FROM a LEFT JOIN pages b ON a.id = b.id)
SELECT id, action, CASE WHEN action = 'kept' THEN bt ELSE title END AS title, CASE WHEN action = 'kept' THEN br ELSE revisionId END AS revisionId FROM m"""

_MODEL = "coalesce(lower({}) IN ('wikitext', 'bson', 'scribunto'), false)"
_JOBS = """SELECT id, pageId, status, targetRevisionId, error FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY coalesce(updatedAt, -1) DESC, coalesce(id, -1) DESC, status DESC) AS rn
  FROM jobs WHERE "type" = 'wikitext-content' AND pageId IS NOT NULL) WHERE rn = 1"""
_WANTED = f"""SELECT id AS pageId, CASE WHEN content IS NOT NULL AND contentRevisionId IS NOT DISTINCT FROM revisionId THEN 'done' ELSE 'pending' END AS status, revisionId AS targetRevisionId
  FROM {{}} WHERE NOT coalesce(deleted, false) AND NOT coalesce(isRedirect, false) AND {_MODEL.format('contentModel')}"""
_REPAIRED = """SELECT coalesce(w.pageId, j.pageId) AS pageId, j.id, CASE WHEN w.pageId IS NULL THEN j.status ELSE w.status END AS status,
  CASE WHEN w.pageId IS NULL THEN j.targetRevisionId ELSE w.targetRevisionId END AS targetRevisionId,
  CASE WHEN w.pageId IS NULL THEN 'delete' WHEN j.status IS NOT DISTINCT FROM w.status AND j.targetRevisionId IS NOT DISTINCT FROM w.targetRevisionId AND j.error IS NULL AND j.pageId IS NOT NULL THEN 'keep' ELSE 'put' END AS action
  FROM ({}) w FULL JOIN ({}) j ON w.pageId = j.pageId"""
_CLAIMED = f"SELECT id, pageId, targetRevisionId, CAST((row_number() OVER (ORDER BY id, pageId) - 1) // 50 AS BIGINT) AS batch FROM ({_JOBS}) WHERE status = 'pending'"
_SYNC = f"""WITH win AS (SELECT * FROM recent_changes WHERE rcid IS NOT NULL AND "timestamp" >= TIMESTAMPTZ '{CURSOR}+00' - INTERVAL 5 MINUTE),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rcid ORDER BY delivery_id) AS rn FROM win) WHERE rn = 1),
c AS (SELECT pageid, delivery_id, ns, coalesce(revid, 0) AS revid, "type" = 'log' AS lg FROM ev WHERE ("type" IN ('edit', 'new') AND pageid > 0) OR ({_PAGELOG} AND logtype <> 'move' AND pageid > 0)),
l AS (SELECT pageid, coalesce(max(delivery_id) FILTER (lg), 0) AS since FROM c GROUP BY pageid),
ids AS (SELECT pageid, ns FROM (SELECT c.*, row_number() OVER (PARTITION BY c.pageid ORDER BY revid DESC, delivery_id DESC) AS rn FROM c JOIN l ON l.pageid = c.pageid AND c.delivery_id >= l.since) WHERE rn = 1),
titles AS (SELECT title FROM (SELECT title FROM ev WHERE {_PAGELOG} AND (logtype = 'move' OR pageid <= 0) UNION SELECT logparams['target_title'] FROM ev WHERE {_PAGELOG} AND logtype = 'move') WHERE title <> ''),
remote AS ({_SCAN}),
active AS (SELECT * FROM remote WHERE namespace IS DISTINCT FROM 6 AND (id IN (SELECT pageid FROM ids) OR title IN (SELECT title FROM titles))),
m AS (SELECT a.id, a.title, coalesce(a.namespace, b.namespace, 0) AS namespace, a.isRedirect, a.revisionId, coalesce(a.contentModel, b.contentModel) AS contentModel,
  b.id IS NULL AS fresh, coalesce(b.revisionId > a.revisionId, false) AS older, b AS old,
  NOT a.isRedirect AND {_MODEL.format('a.contentModel')} AS eligible,
  NOT a.isRedirect AND {_MODEL.format('a.contentModel')} AND a.revisionId IS NOT NULL AND coalesce(b.revisionId, 0) <= a.revisionId AND b.contentRevisionId IS DISTINCT FROM a.revisionId AS fetched
  FROM active a LEFT JOIN pages b ON b.id = a.id),
n AS (SELECT id, title, namespace, isRedirect, false AS deleted, revisionId, contentModel, fresh, older, old,
  CASE WHEN NOT eligible THEN NULL WHEN fetched THEN 'body ' || id || ' ' || revisionId ELSE old.content END AS content,
  CASE WHEN NOT eligible THEN NULL WHEN fetched THEN revisionId ELSE old.contentRevisionId END AS contentRevisionId FROM m),
moved AS (SELECT * FROM n WHERE fresh OR (NOT older AND (title IS DISTINCT FROM old.title OR namespace IS DISTINCT FROM old.namespace OR old.namespaceName IS NULL OR isRedirect <> coalesce(old.isRedirect, false)
  OR coalesce(old.deleted, false) OR revisionId IS DISTINCT FROM old.revisionId OR contentModel IS DISTINCT FROM old.contentModel OR content IS DISTINCT FROM old.content OR contentRevisionId IS DISTINCT FROM old.contentRevisionId))),
gone AS (SELECT p.* FROM pages p WHERE NOT coalesce(p.deleted, false) AND p.id NOT IN (SELECT id FROM active)
  AND (p.id IN (SELECT pageid FROM ids WHERE ns IS DISTINCT FROM 6 AND pageid NOT IN (SELECT id FROM remote)) OR p.title IN (SELECT title FROM titles WHERE title NOT IN (SELECT title FROM remote WHERE title IS NOT NULL)))),
news AS (SELECT id, title, namespace, isRedirect, deleted, revisionId, contentModel, content, contentRevisionId FROM moved
  UNION ALL SELECT id, title, namespace, coalesce(isRedirect, false), true, revisionId, contentModel, NULL, NULL FROM gone),
numbered AS (SELECT *, (SELECT max(localSeq) FROM pages) + row_number() OVER (ORDER BY id) AS localSeq FROM news),
after AS (SELECT * FROM numbered UNION ALL SELECT id, title, namespace, coalesce(isRedirect, false), coalesce(deleted, false), revisionId, contentModel, content, contentRevisionId, localSeq FROM pages WHERE id NOT IN (SELECT id FROM news)),
touched AS (SELECT * FROM after WHERE id IN (SELECT id FROM active) OR id IN (SELECT id FROM gone))"""

ORACLES = {
    "jobs_claimed": _CLAIMED,
    "jobs_wanted": _REPAIRED.format(_WANTED.format("pages"), _JOBS),
    "jobs_settled": f"""WITH k AS ({_CLAIMED}), p AS (SELECT * FROM pages WHERE NOT coalesce(deleted, false) AND NOT coalesce(isRedirect, false) AND {_MODEL.format('contentModel')}),
r AS (SELECT * FROM pages WHERE content IS NOT NULL AND id % 7 <> 0),
x AS (SELECT k.pageId, CASE WHEN p.id IS NULL THEN 'gone' WHEN r.id IS NULL THEN 'failed' WHEN coalesce(r.contentRevisionId, 0) < greatest(coalesce(p.revisionId, 0), coalesce(p.contentRevisionId, 0), coalesce(k.targetRevisionId, 0)) THEN 'behind' ELSE 'done' END AS result,
  greatest(coalesce(p.revisionId, 0), coalesce(r.contentRevisionId, 0)) AS rev, r.contentRevisionId AS cr, coalesce(r.contentModel, p.contentModel, 'wikitext') AS cm, r.content AS body, p.content AS had, p.contentModel AS hm
  FROM k LEFT JOIN p ON p.id = k.pageId LEFT JOIN r ON r.id = k.pageId)
SELECT pageId, result, CASE WHEN result = 'done' THEN rev END AS revisionId, CASE WHEN result = 'done' THEN cr END AS contentRevisionId, CASE WHEN result = 'done' THEN cm END AS contentModel,
  CASE WHEN result = 'done' THEN length(body) END AS chars, result = 'done' AND (had IS DISTINCT FROM body OR lower(hm) IS DISTINCT FROM lower(cm)) AS changed FROM x""",
    "rc_sync_pages": f"{_SYNC} SELECT id, title, namespace, isRedirect, deleted, revisionId, contentModel, contentRevisionId, length(content) AS chars, localSeq FROM after",
    "rc_sync_jobs": f"""{_SYNC}, fixed AS ({_REPAIRED.format(_WANTED.format('touched'), f'SELECT * FROM ({_JOBS}) WHERE pageId IN (SELECT id FROM touched)')}),
made AS (SELECT pageId, (SELECT max(id) FROM ({_JOBS})) + row_number() OVER (ORDER BY pageId) AS made FROM fixed WHERE action = 'put' AND id IS NULL)
SELECT coalesce(f.id, made.made) AS id, f.pageId, f.status, f.targetRevisionId FROM fixed f LEFT JOIN made ON made.pageId = f.pageId WHERE action <> 'delete'
UNION ALL SELECT id, pageId, status, targetRevisionId FROM ({_JOBS}) WHERE pageId NOT IN (SELECT id FROM touched)""",
    "rc_dedup": _EVENTS,
    "stream_rc_dedup": f"SELECT rcid, pageid, revid, \"type\", title, delivery_id FROM ({_DEDUP})",
    "rc_overlap_window": f"SELECT delivery_id, rcid FROM recent_changes WHERE \"timestamp\" >= TIMESTAMPTZ '{CURSOR}+00' - INTERVAL 5 MINUTE",
    "rc_retained_markers": f"""SELECT rcid, epoch_us(max("timestamp")) AS "timestamp" FROM recent_changes WHERE rcid IS NOT NULL AND "timestamp" >= TIMESTAMPTZ '{CURSOR}+00' - INTERVAL 30 DAY GROUP BY rcid""",
    "rc_latest_per_page": f"""WITH c AS (SELECT pageid, delivery_id, coalesce(revid, 0) AS revid, "type" = 'log' AS lg FROM ({_DEDUP}) WHERE ("type" IN ('edit', 'new') AND pageid > 0) OR ({_PAGELOG} AND logtype <> 'move' AND pageid > 0)),
l AS (SELECT pageid, coalesce(max(delivery_id) FILTER (lg), 0) AS since FROM c GROUP BY pageid)
SELECT pageid, delivery_id FROM (SELECT c.*, row_number() OVER (PARTITION BY c.pageid ORDER BY revid DESC, delivery_id DESC) AS rn FROM c JOIN l ON l.pageid = c.pageid AND c.delivery_id >= l.since) WHERE rn = 1""",
    "rc_affected_titles": f"SELECT title FROM (SELECT title FROM recent_changes WHERE {_PAGELOG} AND (logtype = 'move' OR pageid <= 0) UNION SELECT logparams['target_title'] FROM recent_changes WHERE {_PAGELOG} AND logtype = 'move') WHERE title <> ''",
    "rc_merge_pages": _MERGE.format(scan=_SCAN, late="false"),
    "reconcile_fence": _MERGE.format(scan=_SCAN, late=f"coalesce(b.localSeq > {FENCE}, false)"),
    "reconcile_sweep": f"SELECT id, title, true AS deleted, CAST(NULL AS VARCHAR) AS content FROM pages WHERE NOT coalesce(deleted, false) AND coalesce(localSeq, 0) <= {FENCE} AND id NOT IN (SELECT id FROM ({_SCAN}))",
    "rc_tombstones": f"""SELECT id, title, true AS deleted, CAST(NULL AS VARCHAR) AS content FROM pages WHERE NOT coalesce(deleted, false)
  AND title IN (SELECT title FROM recent_changes WHERE rcid IS NOT NULL AND "type" = 'log' AND logtype = 'delete' AND logaction IN ('delete', 'delete_redir') AND pageid = 0)
  AND id NOT IN (SELECT pageid FROM recent_changes WHERE rcid IS NOT NULL AND "type" = 'new')""",
    "rc_sequence_assign": f"SELECT delivery_id, rcid, 1000 + row_number() OVER (ORDER BY delivery_id) AS localSeq FROM ({_DEDUP})",
    "batch_chunks": "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 50 AS BIGINT) AS chunk FROM pages",
    "seq_delta_scan": f"SELECT id, title, localSeq, deleted FROM pages WHERE localSeq > {FENCE}",
    "local_sequence": "SELECT coalesce(greatest((SELECT max(localSeq) FROM pages), (SELECT max(writerSeq) FROM file_resources)), 0) AS localSeq",
    "rc_deferred_bodies": """SELECT id AS pageid, CASE WHEN content IS NULL OR contentRevisionId IS NULL THEN 'missing' WHEN contentRevisionId = revisionId THEN 'ok'
  WHEN contentRevisionId > revisionId THEN 'defer' ELSE 'stale' END AS result FROM pages WHERE revisionId IS NOT NULL""",
    "jobs_status_counts": "SELECT CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, count(*) AS n FROM (SELECT DISTINCT * FROM jobs) GROUP BY 1",
    "jobs_repair": """WITH p AS (SELECT id AS pageId, CASE WHEN content IS NOT NULL AND contentRevisionId IS NOT DISTINCT FROM revisionId THEN 'done' ELSE 'pending' END AS wanted FROM pages WHERE NOT coalesce(deleted, false)),
j AS (SELECT pageId, status FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY id DESC, status DESC) AS rn FROM (SELECT DISTINCT * FROM jobs)) WHERE rn = 1)
SELECT coalesce(p.pageId, j.pageId) AS pageId, CASE WHEN p.pageId IS NULL THEN 'delete' WHEN j.status IS NOT DISTINCT FROM p.wanted THEN 'keep' ELSE 'put' END AS action FROM p FULL JOIN j ON p.pageId = j.pageId""",
    "jobs_stale": "SELECT id, pageId FROM (SELECT DISTINCT * FROM jobs) WHERE pageId NOT IN (SELECT id FROM pages WHERE NOT coalesce(deleted, false))",
    "namespace_options": "SELECT namespace, max_by(namespaceName, id) AS name FROM pages GROUP BY namespace",
    "diagnostics_counts": """SELECT count(*) FILTER (NOT coalesce(deleted, false)) AS live, count(*) FILTER (coalesce(deleted, false)) AS deleted,
  count(*) FILTER (NOT coalesce(deleted, false) AND content IS NOT NULL) AS bodies, count(*) FILTER (NOT coalesce(deleted, false) AND content IS NOT NULL AND lower(contentModel) = 'scribunto') AS lua,
  count(*) FILTER (coalesce(isRedirect, false)) AS redirects, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS bytes FROM pages""",
}
