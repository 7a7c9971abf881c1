"""The mirror brought up to date from its source, end to end (T1 to T16): change log, lookups, pages, files, jobs and cursor.

A run reads the change log from the cursor less an overlap, leaves out events already seen, finds the pages they touch,
looks these up, fetches the bodies that are needed and commits everything that follows, with the cursor, as one version of the
store. A run that fails has changed nothing and can be repeated. Who answers lookups is a parameter: ``remote`` asks the
source from the executors, in requests of fifty, spread over the partitions of the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.engine import FACTS, ROW, Engine
from lodestrand.operators import jobs as queue
from lodestrand.operators import mirror
from lodestrand.operators.search import live
from lodestrand.sources import wiki
from lodestrand.sources.store import Manifest
from lodestrand.sources.work import materialize

INFO = "pageid bigint, ns bigint, title string, redirect boolean, lastrevid bigint, contentmodel string, missing boolean"
BODY = "pageid bigint, missing boolean, revid bigint, contentmodel string, content string"
JOB = "id bigint, type string, pageId bigint, status string, targetRevisionId bigint, error string, updatedAt bigint, removed boolean, version bigint"
FILES, DATA = 6, 3500  # fixed values: namespaces of files and of data pages

Lookup = Callable[[DataFrame, DataFrame], DataFrame]  # (pageid), (title) -> INFO
Bodies = Callable[[DataFrame], DataFrame]  # (pageid) -> BODY


def _asked(frame: DataFrame, schema: str, ask: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """Answers to the values of a one-column frame, asked for by the tasks that hold them."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(ask(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in found], schema=kinds)

    spark = frame.sparkSession
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])
    return frame.mapInArrow(run, schema)


def remote(url: str, fetch: Callable[[str], dict] = wiki.fetch_json) -> tuple[Lookup, Bodies]:
    """Lookups at ``url``, by ids and titles in requests of at most fifty."""

    def info(**asked) -> Iterator[tuple]:
        for p in wiki.info_of(url, fetch=fetch, **asked):
            yield p.get("pageid"), p.get("ns"), p.get("title"), bool(p.get("redirect")), p.get("lastrevid"), p.get("contentmodel"), bool(p.get("missing"))

    def lookup(ids: DataFrame, titles: DataFrame) -> DataFrame:
        return _asked(ids, INFO, lambda v: info(ids=v)).unionByName(_asked(titles, INFO, lambda v: info(titles=v)))

    return lookup, lambda ids: _asked(ids, BODY, lambda v: wiki.bodies_of(url, v, fetch=fetch))


def candidates(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pageid, ns, title) of the event that decides each page, and the titles that have to be looked up by name."""
    deciding = mirror.latest_per_page(events).select("delivery_id")
    return events.join(deciding, "delivery_id", "left_semi").select("pageid", "ns", "title"), mirror.affected_titles(events)


def last_answers(info: DataFrame, asked: DataFrame) -> DataFrame:
    """One answer per page id, or per title where there is none, with the namespace of its event where it names none.

    A page that was moved meanwhile is answered twice; the higher revision counts.
    """
    key = F.coalesce(F.concat(F.lit("i"), F.col("pageid").cast("string")), F.concat(F.lit("t"), F.coalesce("title", F.lit(""))))
    columns = ["pageid", "ns", "title", "redirect", "lastrevid", "contentmodel", "missing"]
    order = F.struct(F.coalesce("lastrevid", F.lit(-1)).alias("_rev"), *columns)
    one = info.groupBy(key.alias("_key")).agg(F.max(order).alias("r")).select(*[f"r.{c}" for c in columns])
    known = asked.groupBy("pageid").agg(F.max_by("ns", F.struct("title", "ns")).alias("_ns"), F.max("title").alias("_title"))
    return one.join(known, "pageid", "left").withColumn("ns", F.coalesce("ns", "_ns")).drop("_ns")


@dataclass
class Sync:
    """Runs that bring the pages, files and jobs of ``engine`` up to its source."""

    engine: Engine
    lookup: Lookup
    bodies: Bodies
    overlap: str = "5 minutes"

    # tables besides the facts

    def jobs(self, base: Manifest | None = None) -> DataFrame:
        """The queue: one job per page that has one."""
        found = self.engine.store.read("jobs", base)
        if found is None:
            return self.engine.spark.createDataFrame([], JOB).drop("removed", "version")
        last = found.groupBy("pageId").agg(F.max_by(F.struct(*queue.COLUMNS, "removed"), "version").alias("j"))
        return last.where(~F.col("j.removed")).select(*[f"j.{c}" for c in queue.COLUMNS])

    def _job_states(self, base: Manifest, repaired: DataFrame, at: int) -> tuple[DataFrame, int]:
        """States to append for jobs that are put or deleted, new ones numbered on; the highest id after."""
        first = base.state.get("last-job", 0)
        put = repaired.where("action = 'put'")
        fresh = mirror.assign_sequence(put.where("id is null").drop("id"), ["pageId"], first, "id")
        every = put.where("id is not null").unionByName(fresh).unionByName(repaired.where("action = 'delete'"))
        last = fresh.agg(F.max("id")).first()[0] or first
        rows = every.select(
            "id", F.lit(queue.BODY_JOB).alias("type"), "pageId", "status", "targetRevisionId", F.lit(None).cast("string").alias("error"), F.lit(at).cast("bigint").alias("updatedAt"),
            (F.col("action") == "delete").alias("removed"), F.lit(base.version + 1).cast("bigint").alias("version"),
        )
        return rows, last

    # one step of the merge, on frames alone

    @staticmethod
    def wanted_bodies(stored: DataFrame, active: DataFrame) -> DataFrame:
        """F8: (pageid, revid) of pages that need a body and do not have it."""
        old = stored.select(F.col("id").alias("pageid"), F.col("revisionId").alias("_rev"), F.col("contentRevisionId").alias("_body"))
        need = ~F.coalesce("redirect", F.lit(False)) & queue.searchable_model(F.col("contentmodel")) & F.col("lastrevid").isNotNull()
        rows = active.where(need).join(old, "pageid", "left")
        return rows.where((F.coalesce("_rev", F.lit(0)) <= F.col("lastrevid")) & ~F.col("_body").eqNullSafe(F.col("lastrevid"))).select("pageid", F.col("lastrevid").alias("revid"))

    @staticmethod
    def merged(stored: DataFrame, active: DataFrame, received: DataFrame, normalize: Callable[[Column], Column], names: dict[int, str] | None = None) -> DataFrame:
        """(ROW, action, old_namespace) of active answers: new, changed, same, or kept where the stored revision is higher.

        A page that needs a body and got none keeps the one it has; one that needs none loses it.
        """
        a, b, r = active.alias("a"), stored.alias("b"), received.where(~F.coalesce("missing", F.lit(False))).alias("r")
        eligible = ~F.coalesce(F.col("a.redirect"), F.lit(False)) & queue.searchable_model(F.col("a.contentmodel"))
        body = lambda new, old: F.when(~eligible, F.lit(None)).when(F.col("r.pageid").isNotNull(), F.col(f"r.{new}")).otherwise(F.col(f"b.{old}"))
        title = F.coalesce("a.title", "b.title", "a._title", F.col("a.pageid").cast("string"))
        namespace = F.coalesce("a.ns", "b.namespace", F.lit(0))
        table = F.create_map(*[F.lit(x) for pair in (names or {-1: ""}).items() for x in pair])
        values = {
            "id": F.col("a.pageid"), "title": title, "normalizedTitle": normalize(title), "namespace": namespace,
            "namespaceName": F.coalesce(table[namespace], F.col("b.namespaceName"), namespace.cast("string")), "isRedirect": F.coalesce("a.redirect", F.lit(False)),
            "localSeq": F.col("b.localSeq"), "deleted": F.lit(False), "revisionId": F.col("a.lastrevid"), "contentModel": F.coalesce("r.contentmodel", "a.contentmodel", "b.contentModel"),
            "content": body("content", "content"), "contentRevisionId": body("revid", "contentRevisionId"),
        }
        joined = a.join(b, F.col("a.pageid") == F.col("b.id"), "left").join(r, F.col("a.pageid") == F.col("r.pageid"), "left")
        rows = joined.select(*[v.cast(ROW[c]).alias(c) for c, v in values.items()], *[F.col(f"b.{c}").alias(f"old_{c}") for c in FACTS], F.col("b.id").isNull().alias("fresh"))
        differs = F.lit(False)
        for c in FACTS:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        kept = F.coalesce(F.col("old_revisionId") > F.col("revisionId"), F.lit(False))
        action = F.when(F.col("fresh"), "new").when(kept, "kept").when(differs, "changed").otherwise("same")
        return rows.withColumn("action", action).select(*ROW, "action", "old_namespace")

    @staticmethod
    def removed(stored: DataFrame, info: DataFrame, active: DataFrame) -> DataFrame:
        """Tombstones of live rows that are answered as missing, by id or by title, unless their id is active."""
        gone = info.where(F.coalesce("missing", F.lit(False)))
        by_id = gone.where("pageid is not null").select(F.col("pageid").alias("id"))
        by_name = live(stored).join(gone.where("title is not null").select("title").distinct(), "title", "left_semi").select("id")
        ids = by_id.unionByName(by_name).distinct().join(active.select(F.col("pageid").alias("id")), "id", "left_anti")
        return mirror.tombstone(live(stored).join(ids, "id", "left_semi")).select(*ROW)

    # runs

    def changes(self, feed: DataFrame, through: str, at: int = 0, batch: int | None = None) -> Manifest:
        """One run over the change log ``feed`` up to ``through`` (the source's clock when the run began).

        Needs a complete scan of the pages (state ``pages.complete``), files are followed once they were scanned.
        """
        engine = self.engine

        def run(base: Manifest) -> tuple:
            if "pages.complete" not in base.state:
                raise LookupError("no complete scan of the pages")
            cursor = base.state.get("changes.through") or base.state["pages.complete"]
            window = mirror.window_from(feed, F.lit(cursor).cast("timestamp"), self.overlap).where(F.col("timestamp") <= F.lit(through).cast("timestamp"))
            markers = engine.store.read("markers", base)
            wanted = ["delivery_id", "rcid", "type", "ns", "title", "pageid", "revid", "timestamp", "logtype", "logparams"]
            events = materialize(mirror.new_events(window, markers, wanted), "events")
            asked, titles = candidates(events)
            info = materialize(last_answers(self.lookup(asked.select("pageid").distinct(), titles), asked), "info")
            stored, files = engine.rows("pages", base), engine.rows("files", base)
            pages = info.where(~F.coalesce(F.col("ns") == FILES, F.lit(False)))
            found = pages.where(~F.coalesce("missing", F.lit(False)) & F.col("pageid").isNotNull())
            expected = materialize(self.wanted_bodies(stored, found), "expected")
            received = materialize(self.bodies(expected.select("pageid")), "received")
            lost = received.where(F.coalesce("missing", F.lit(False))).select("pageid")
            verdict = mirror.late_bodies(expected.join(lost, "pageid", "left_anti"), received.select("pageid", "revid"))
            wrong = verdict.where(F.col("result").isin("missing", "stale")).select("pageid").first()
            if wrong:
                raise RuntimeError(f"no body, or one of an older revision, came for page {wrong[0]}")
            right = received.join(verdict.where("result = 'ok'").select("pageid"), "pageid", "left_semi")  # a newer one waits for its event
            active = found.join(lost, "pageid", "left_anti")
            names = {n["id"]: n["name"] for n in base.state.get("namespaces", [])}
            merged = materialize(self.merged(stored, active, right, engine.analyzer.normalize, names), "merged")
            dead = self.removed(stored, pages, active).withColumn("old_namespace", F.col("namespace"))
            moved = materialize(merged.where(F.col("action").isin("new", "changed")).drop("action").unionByName(dead), "moved")
            appends, state = {}, {"changes.through": through}
            changed, end = engine.numbered(moved.select(*ROW), base.state.get("local-sequence", 0))
            appends["pages"] = changed
            if base.state.get("files.complete"):
                own = info.where((F.col("ns") == FILES) & ~F.coalesce("missing", F.lit(False)) & F.col("pageid").isNotNull()).withColumn("contentmodel", F.lit(None).cast("string"))
                none = self.engine.spark.createDataFrame([], BODY)
                new = self.merged(files, own, none, engine.analyzer.normalize).where(F.col("action").isin("new", "changed")).select(*ROW)
                gone = self.removed(files, info.where(F.col("ns") == FILES), own)
                appends["files"], after = engine.numbered(new.unionByName(gone), end)
                state["files.changed"] = max(base.state.get("files.changed", 0), after if after > end else 0)
                end = after
            # jobs of every page that was looked up, changed or not
            touched = merged.where("action <> 'kept'").drop("action", "old_namespace").unionByName(dead.select(*ROW))
            kept = stored.join(merged.where("action = 'kept'").select("id"), "id", "left_semi").select(*ROW)
            touched = materialize(touched.unionByName(kept), "touched")
            mine = self.jobs(base).join(touched.select(F.col("id").alias("pageId")), "pageId", "left_semi")
            appends["jobs"], state["last-job"] = self._job_states(base, materialize(queue.repaired(mine, queue.wanted_jobs(touched)), "repaired"), at)
            if mirror.touches(moved, DATA).first()[0]:
                state["data.synced"] = 0
            before = markers if markers is not None else events.select("rcid", "timestamp").limit(0)
            tables = {"markers": mirror.retained_markers(before, events, F.lit(through).cast("timestamp"), self.overlap)}
            return tables, state | {"local-sequence": end}, appends

        return engine.store.update(run, batch=batch)

    def stream(self, feed: DataFrame, checkpoint: str, clock: Callable[[], str]) -> None:
        """Every micro-batch of a streaming change log as a run; a batch that comes again is recognised and skipped."""
        query = feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda batch, number: self.changes(batch, clock(), batch=number) and None).start().awaitTermination()

    def fetch(self, at: int = 0, size: int = queue.BATCH, force: bool = False) -> dict[str, int]:
        """Fetch the bodies of all pending jobs: rows per result.

        The jobs are claimed together and asked for by the tasks that hold them, ``size`` to a request. If an answer is older
        than what is known nothing is committed and the jobs stay pending.
        """
        engine, counts = self.engine, {}

        def run(base: Manifest) -> tuple:
            pages, jobs = engine.rows("pages", base), self.jobs(base)
            fixed = materialize(queue.repaired(jobs, queue.wanted_jobs(pages, force)), "repaired")
            states, last = self._job_states(base, fixed, at)
            states = materialize(states, "states")
            every = jobs.join(states.select("pageId"), "pageId", "left_anti").unionByName(states.where("not removed").drop("removed", "version"))
            claimed = materialize(queue.claims(every, size), "claimed")
            answers = materialize(self.bodies(claimed.select("pageId").withColumnRenamed("pageId", "pageid")), "answers")
            done = materialize(queue.settled(claimed, pages, answers), "settled")
            counts.update({r.result: r["n"] for r in done.groupBy("result").agg(F.count("*").alias("n")).collect()})  # at most four rows
            if counts.get("behind"):
                counts.clear()
                raise RuntimeError("bodies of older revisions came; the jobs stay pending")
            body = done.where("result = 'done'").drop("result").withColumnRenamed("pageId", "id")
            now = pages.drop(*[c for c in body.columns if c not in ("id", "changed")]).join(body, "id")
            noticed, end = engine.numbered(now.where("changed").select(*ROW), base.state.get("local-sequence", 0))
            # a body that says the same only sets its revision: no sequence number, but a later state of the row
            after = {"done": "done", "failed": "failed"}
            status = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])[F.col("result")]
            closed = every.select("id", "type", "pageId", F.col("targetRevisionId").alias("wanted")).join(done, "pageId").select(
                "id", "type", "pageId", F.coalesce(status, F.lit("done")).alias("status"), F.coalesce("revisionId", "wanted").alias("targetRevisionId"),
                F.when(F.col("result") == "failed", "no body came").alias("error"), F.lit(at).cast("bigint").alias("updatedAt"), (F.col("result") == "gone").alias("removed"),
                F.lit(base.version + 1).cast("bigint").alias("version"),
            )
            settled = states.join(closed.select("pageId"), "pageId", "left_anti").unionByName(closed)
            return {}, {"last-job": last, "local-sequence": end}, {"pages": noticed, "jobs": settled}

        engine.store.update(run)
        return counts

    # full scans

    def scan(self, namespaces: list[int], read: Callable[[int], DataFrame], began: str, restart: bool = False) -> Manifest:
        """All pages, namespace by namespace; taken up again where an earlier scan of the same namespaces stopped.

        ``read`` gives a namespace's pages (id, title, namespace, isRedirect, revisionId, contentModel). What is read is a part of
        the store with the place reached; the last step commits, as one version, pages that differ or are gone, jobs
        repaired from all pages, and the cursor, unless the change log has passed ``began`` meanwhile.
        """
        engine = self.engine
        base = engine.store.manifest()
        open_scan = modern_state(base.state).get("scan")
        if restart or not open_scan or open_scan["namespaces"] != namespaces:
            open_scan = {"namespaces": namespaces, "done": 0, "fence": base.state.get("local-sequence", 0), "began": began}
        for at in range(open_scan["done"], len(namespaces)):  # a fixed, short list
            rows = engine.shaped(read(namespaces[at]))
            progress = open_scan | {"done": at + 1}
            first = at == 0
            engine.store.update(lambda _, rows=rows, progress=progress, first=first: ({"scan": rows}, {"scan": progress}) if first else ({}, {"scan": progress}, {"scan": rows}))

        def finish(base: Manifest) -> tuple:
            scanned, stored, fence = engine.store.read("scan", base).select(*ROW), engine.rows("pages", base), open_scan["fence"]
            gone = mirror.tombstone(mirror.sweep(stored, scanned, F.lit(fence))).select(*ROW)
            moved = materialize(engine.merged(stored, scanned, fence).unionByName(gone), "moved")
            changed, end = engine.numbered(moved, base.state.get("local-sequence", 0))
            changed = materialize(changed, "numbered")
            now = engine.latest(stored.unionByName(changed))
            fixed = materialize(queue.repaired(self.jobs(base), queue.wanted_jobs(now)), "repaired")
            states, last = self._job_states(base, fixed, 0)
            known = base.state.get("changes.through")
            began = open_scan["began"]
            state = {"scan": None, "pages.complete": began, "local-sequence": end, "last-job": last}
            tables = {"scan": scanned.limit(0)}
            if not known or known <= began:  # times of one form, so that their order is that of their texts
                state["changes.through"] = began
                tables["markers"] = engine.spark.createDataFrame([], "rcid bigint, timestamp timestamp")
            old = stored.select("id", F.col("namespace").alias("old_namespace"))
            if mirror.touches(changed.join(old, "id", "left"), DATA).first()[0]:
                state["data.synced"] = 0
            return tables, state, {"pages": changed, "jobs": states}

        return engine.store.update(finish)

    def scan_files(self, files: DataFrame) -> Manifest:
        """All files; what the scan does not hold is deleted, without a tombstone, what is the same keeps its number."""
        engine = self.engine

        def run(base: Manifest) -> tuple:
            stored, scanned = engine.rows("files", base), engine.shaped(files)
            changed, end = engine.numbered(engine.merged(stored, scanned, None), base.state.get("local-sequence", 0))
            changed = materialize(changed, "numbered")
            same = stored.join(scanned.select("id"), "id", "left_semi").join(changed.select("id"), "id", "left_anti")
            return {"files": same.select(*ROW).unionByName(changed)}, {"files.complete": True, "files.changed": end, "local-sequence": end}

        return engine.store.update(run)


def modern_state(state: dict) -> dict:
    """H3: a state in which an older name of the place reached (apcontinue) has the present one (gapcontinue)."""
    scan = state.get("scan")
    if not isinstance(scan, dict) or "apcontinue" not in scan:
        return state
    rest = {k: v for k, v in scan.items() if k != "apcontinue"}
    return state | {"scan": {"gapcontinue": scan["apcontinue"]} | rest}


# fixed values: what went wrong in a run of several steps, the gravest first
OUTCOMES = ("login-required", "failed", "no-baseline", "busy", "complete")


def outcome(results: list[str]) -> str:
    """The outcome of a run from those of its steps: the gravest; complete if there were none."""
    unknown = [r for r in results if r not in OUTCOMES]
    return "failed" if unknown else min(results, key=OUTCOMES.index, default="complete")


def orchestrate(scan_due: Callable[[], bool], scan: Callable[[], str], changes: Callable[[], str], refresh: Callable[[], str], lock: Callable[[], bool], unlock: Callable[[], None]) -> str:
    """One periodic run: under a lock the scan if it is due, then the change log; after it the derived tables.

    A step that needs a login or fails ends the run; a run that finds the lock taken does nothing. The lock is given back
    before the derived tables are brought up, whatever happened.
    """
    if not lock():
        return "busy"
    results = []
    try:
        for step in ([scan] if scan_due() else []) + [changes]:
            results.append(step())
            if results[-1] in ("login-required", "failed"):
                break
    finally:
        unlock()
    if outcome(results) == "complete":
        results.append(refresh())
    return outcome(results)
