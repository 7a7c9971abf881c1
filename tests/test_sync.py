"""Runs over the change log, lookups, jobs and scans against a source held in plain Python."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestrand.engine import Engine
from lodestrand.functions.text import Analyzer
from lodestrand.operators import jobs as queue
from lodestrand.streaming import sync
from lodestrand.streaming.sync import BODY, INFO, Sync

T0 = datetime(2025, 5, 1, tzinfo=timezone.utc)
CHANGE = "type string, ns bigint, title string, pageid bigint, revid bigint, rcid bigint, timestamp timestamp, logtype string, logaction string, logparams map<string,string>, delivery_id bigint"
SCAN = "id bigint, title string, namespace bigint, isRedirect boolean, revisionId bigint, contentModel string"


class Source:
    """pages by id: [ns, title, redirect, revision, model, body]; ``later`` are bodies of revisions newer than announced."""

    def __init__(self, spark, pages):
        self.spark, self.pages, self.later, self.asked = spark, pages, {}, []

    def _frame(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def lookup(self, ids, titles):
        rows = []
        for (i,) in ids.collect():
            p = self.pages.get(i)
            rows.append((i, p[0], p[1], p[2], p[3], p[4], False) if p else (i, None, None, None, None, None, True))
        for (t,) in titles.collect():
            found = [i for i, p in self.pages.items() if p[1] == t]
            rows += [(i, p[0], p[1], p[2], p[3], p[4], False) for i in found for p in [self.pages[i]]] or [(None, 0, t, None, None, None, True)]
        return self._frame(rows, INFO)

    def bodies(self, ids):
        self.asked.append(sorted(r[0] for r in ids.collect()))
        rows = []
        for i in self.asked[-1]:
            p = self.pages.get(i)
            rev, body = self.later.get(i, (p[3], p[5])) if p else (None, None)
            if body is not None or not p:
                rows.append((i, not p, rev, p and p[4], body))
        return self._frame(rows, BODY)

    def scan(self, namespace):
        return self._frame([(i, p[1], p[0], p[2], p[3], p[4]) for i, p in self.pages.items() if p[0] == namespace], SCAN)


def change(n, page, rev=0, type_="edit", title="t", ns=0, logtype=None, action=None, target=None, at=1):
    return (type_, ns, title, page, rev, n, T0 + timedelta(minutes=at), logtype, action, {"target_title": target} if target else None, n)


def mirror_of(spark, path, pages):
    source = Source(spark, pages)
    return source, Sync(Engine(spark, str(path), Analyzer()), source.lookup, source.bodies)


def state(s):
    return {r.id: (r.title, r.revisionId, r.content, r.deleted) for r in s.engine.rows().collect()}


def jobs(s):
    return {r.pageId: (r.id, r.status, r.targetRevisionId) for r in s.jobs().collect()}


def test_scan_fetch_and_changes(spark, tmp_path):
    pages = {1: [0, "a", False, 10, "wikitext", "A"], 2: [0, "b", False, 20, "wikitext", "B"], 3: [10, "c", True, 30, "wikitext", None], 4: [10, "d", False, 40, "css", "x"]}
    source, s = mirror_of(spark, tmp_path / "m", pages)
    with pytest.raises(LookupError):
        s.changes(spark.createDataFrame([], CHANGE), "2025-05-01T00:10:00Z")
    s.scan([0, 10], source.scan, "2025-05-01T00:00:00Z")
    assert state(s) == {1: ("a", 10, None, False), 2: ("b", 20, None, False), 3: ("c", 30, None, False), 4: ("d", 40, None, False)}
    assert jobs(s) == {1: (1, "pending", 10), 2: (2, "pending", 20)}
    assert s.fetch(at=5) == {"done": 2} and source.asked == [[1, 2]] and s.engine.sequence == 6
    assert jobs(s) == {1: (1, "done", 10), 2: (2, "done", 20)} and state(s)[1][2] == "A"

    # page 1 edited, 2 deleted (named by title only), 5 new, 3 moved, 4 unchanged but touched, and everything delivered twice
    pages[1][3], pages[1][5], pages[5], pages[3][1] = 11, "A2", [0, "e", False, 50, "Scribunto", "E"], "c2"
    del pages[2]
    log = [
        change(1, 1, 11), change(2, 0, type_="log", title="b", logtype="delete", action="delete"), change(3, 5, 50, "new", "e"),
        change(4, 3, type_="log", title="c", logtype="move", action="move", target="c2"), change(5, 4, 40), change(6, 1, 10, at=-60),
    ]
    feed = spark.createDataFrame(log + log, CHANGE)
    done = s.changes(feed, "2025-05-01T00:10:00Z", at=9, batch=1)
    assert state(s) == {1: ("a", 11, "A2", False), 2: ("b", 20, None, True), 3: ("c2", 30, None, False), 4: ("d", 40, None, False), 5: ("e", 50, "E", False)}
    assert source.asked[-1] == [1, 5] and s.engine.sequence == 10
    assert jobs(s) == {1: (1, "done", 11), 5: (3, "done", 50)}
    assert done.state["changes.through"] == "2025-05-01T00:10:00Z"
    assert s.changes(feed, "2025-05-01T00:20:00Z", batch=1).version == done.version  # the batch once more
    again = s.changes(feed, "2025-05-01T00:12:00Z")  # within the overlap, all of it seen before
    assert s.engine.sequence == 10 and again.state["changes.through"] == "2025-05-01T00:12:00Z" and source.asked[-1] == []


def test_late_and_missing_bodies(spark, tmp_path):
    pages = {1: [0, "a", False, 10, "wikitext", "A"], 2: [0, "b", False, 20, "wikitext", "B"]}
    source, s = mirror_of(spark, tmp_path / "m", pages)
    s.scan([0], source.scan, "2025-05-01T00:00:00Z")
    source.later = {1: (12, "newer")}
    feed = spark.createDataFrame([change(1, 1, 10), change(2, 2, 20)], CHANGE)
    s.changes(feed, "2025-05-01T00:05:00Z")
    assert state(s)[1][2] is None and state(s)[2][2] == "B"  # the newer body waits for its own event
    assert jobs(s)[1][1] == "pending" and jobs(s)[2][1] == "done"
    source.later = {1: (9, "older")}
    before = s.engine.store.manifest().version
    with pytest.raises(RuntimeError):
        s.changes(spark.createDataFrame([change(3, 1, 10, at=4)], CHANGE), "2025-05-01T00:06:00Z")
    with pytest.raises(RuntimeError):
        s.fetch()
    assert s.engine.store.manifest().version == before and jobs(s)[1][1] == "pending"
    source.later = {1: (10, None)}
    assert s.fetch() == {"failed": 1} and jobs(s)[1][1] == "failed"
    source.later = {1: (12, "newer")}
    assert s.fetch() == {"done": 1} and state(s)[1] == ("a", 12, "newer", False)


def test_interrupted_scan_goes_on_and_keeps_later_writes(spark, tmp_path):
    pages = {1: [0, "a", False, 10, "wikitext", None], 2: [0, "b", False, 20, "wikitext", None], 3: [3500, "Data:x", False, 30, "bson", None]}
    source, s = mirror_of(spark, tmp_path / "m", pages)
    s.scan([0, 3500], source.scan, "2025-05-01T00:00:00Z")
    s.engine.store.update(lambda _: ({}, {"data.synced": 77}))
    del pages[2], pages[3]
    pages[1][1] = "a2"
    seen = []

    def broken(ns):
        seen.append(ns)
        if ns == 3500 and len(seen) < 3:
            raise OSError("cut off")
        return source.scan(ns)

    with pytest.raises(OSError):
        s.scan([0, 3500], broken, "2025-05-01T01:00:00Z")
    s.engine.ingest(spark.createDataFrame([(9, "late", 0, False, 1, "wikitext")], SCAN))  # written after the scan began
    pages[1][1] = "not seen again"
    s.scan([0, 3500], broken, "2025-05-01T01:00:00Z")
    assert seen == [0, 3500, 3500]
    assert {i: (t, d) for i, (t, _, _, d) in state(s).items()} == {1: ("a2", False), 2: ("b", True), 3: ("Data:x", True), 9: ("late", False)}
    assert set(jobs(s)) == {1, 9}
    after = s.engine.store.manifest().state
    assert after["data.synced"] == 0 and after["changes.through"] == "2025-05-01T01:00:00Z" and after["scan"] is None
    s.scan([0, 3500], source.scan, "2025-04-01T00:00:00Z")  # the change log is ahead of it and stays so
    assert s.engine.store.manifest().state["changes.through"] == "2025-05-01T01:00:00Z"


def test_files_are_deleted_by_a_scan_and_followed_by_changes(spark, tmp_path):
    source, s = mirror_of(spark, tmp_path / "m", {7: [6, "文件:x", False, 1, "wikitext", None]})
    s.scan([0], source.scan, "2025-05-01T00:00:00Z")
    s.scan_files(spark.createDataFrame([(7, "文件:x", 6, False, 1, None), (8, "文件:y", 6, False, 1, None)], SCAN))
    s.scan_files(source.scan(6).withColumn("contentModel", F.lit(None).cast("string")))
    assert [(r.id, r.localSeq) for r in s.engine.rows("files").collect()] == [(7, 1)]
    source.pages = {9: [6, "文件:z", False, 2, "wikitext", None]}
    log = [change(1, 9, 2, "log", "文件:z", 6, "upload", "upload"), change(2, 7, 0, "log", "文件:x", 6, "delete", "delete")]
    s.changes(spark.createDataFrame(log, CHANGE), "2025-05-01T00:05:00Z")
    assert {r.id: r.deleted for r in s.engine.rows("files").collect()} == {7: True, 9: False} and state(s) == {}
    assert s.engine.store.manifest().state["files.changed"] == s.engine.sequence


def test_lookups_are_asked_from_the_tasks(spark):
    def fetch(url):
        import urllib.parse

        q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
        if q["prop"] == "revisions":
            return {"query": {"pages": [{"pageid": int(i), "revisions": [{"revid": 5, "slots": {"main": {"contentmodel": "wikitext", "content": "b" + i}}}]} for i in q["pageids"].split("|")]}}
        if "pageids" in q:
            assert len(q["pageids"].split("|")) <= 50
            return {"query": {"pages": [{"pageid": int(i), "ns": 0, "title": "p" + i, "lastrevid": 5, "contentmodel": "wikitext"} for i in q["pageids"].split("|")]}}
        return {"query": {"pages": [{"ns": 0, "title": t, "missing": True} for t in q["titles"].split("|")]}}

    lookup, bodies = sync.remote("http://x/api", fetch)
    ids = spark.range(1, 121).withColumnRenamed("id", "pageid")
    info = lookup(ids, spark.createDataFrame([("gone",)], "title string")).collect()
    assert len(info) == 121 and sum(r.missing for r in info) == 1 and {r.content for r in bodies(ids).collect()} == {f"b{i}" for i in range(1, 121)}


def test_answers_given_twice_count_once(spark):
    info = spark.createDataFrame([(1, None, "old", False, 3, "wikitext", False), (1, None, "new", False, 4, "wikitext", False), (None, 0, "x", None, None, None, True), (None, 0, "x", None, None, None, True)], INFO)
    asked = spark.createDataFrame([(1, 10, "old")], "pageid bigint, ns bigint, title string")
    assert sorted((r.pageid or 0, r.ns, r.title) for r in sync.last_answers(info, asked).collect()) == [(0, 0, "x"), (1, 10, "new")]


def test_queue_on_odd_rows(spark):
    rows = [(1, queue.BODY_JOB, 5, "pending", 7, None, None)] * 2 + [(2, queue.BODY_JOB, 5, "done", 7, None, 3), (3, "other", 6, "pending", None, None, 1), (4, queue.BODY_JOB, None, "pending", 1, None, 1)]
    frame = spark.createDataFrame(rows, "id bigint, type string, pageId bigint, status string, targetRevisionId bigint, error string, updatedAt bigint")
    assert [(r.id, r.pageId) for r in queue.current_jobs(frame).collect()] == [(2, 5)]
    assert queue.current_jobs(frame.limit(0)).count() == 0 and queue.claims(frame.limit(0)).count() == 0
    many = spark.range(120).select("id", F.lit(queue.BODY_JOB).alias("type"), F.col("id").alias("pageId"), F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("targetRevisionId"))
    assert {r.batch: r["count"] for r in queue.claims(many).groupBy("batch").count().collect()} == {0: 50, 1: 50, 2: 20}


def test_outcomes_and_order():
    calls = []

    def step(name, result="complete"):
        return lambda: calls.append(name) or result

    run = lambda due=True, scan="complete", log="complete", free=True: sync.orchestrate(lambda: due, step("scan", scan), step("log", log), step("refresh"), lambda: free, step("unlock"))
    assert run() == "complete" and calls == ["scan", "log", "unlock", "refresh"]
    calls.clear()
    assert run(scan="login-required") == "login-required" and calls == ["scan", "unlock"]
    calls.clear()
    assert run(due=False, log="no-baseline") == "no-baseline" and calls == ["log", "unlock"]
    calls.clear()
    assert run(free=False) == "busy" and calls == []
    assert sync.outcome([]) == "complete" and sync.outcome(["complete", "strange"]) == "failed"
    assert sync.modern_state({"scan": {"apcontinue": "x", "n": 1}}) == {"scan": {"gapcontinue": "x", "n": 1}} and sync.modern_state({}) == {}
