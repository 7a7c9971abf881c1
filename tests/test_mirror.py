"""Mirror operators, store, stream and connector."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import mirror
from lodestrand.sources import wiki
from lodestrand.sources.store import Conflict, Incompatible, Manifest, Store, validated
from lodestrand.sources.wiki import RemoteError, WikiSource, bodies_of, changes_of, data_of, info_of, pages_of, query, retry_after, retryable
from lodestrand.streaming import schedule
from lodestrand.streaming.feed import FeedMirror, read_feed

EVENT = "delivery_id bigint, rcid bigint, type string, pageid bigint, revid bigint, title string, logtype string, logparams map<string,string>, timestamp timestamp"


def events(spark, rows):
    return spark.createDataFrame([(*r, None)[:9] if len(r) == 8 else r for r in rows], EVENT)


def test_latest_per_page(spark):
    rows = [
        (1, 1, "edit", 1, 10, "a", None, None), (2, 2, "edit", 1, 9, "a", None, None), (3, 3, "edit", 1, 10, "a", None, None),
        (4, 4, "edit", 2, 10, "b", None, None), (5, 5, "log", 2, 0, "b", "delete", None), (6, 6, "edit", 2, 3, "b", None, None),
        (7, 7, "log", 3, 0, "c", "protect", None), (8, 8, "log", 3, 0, "c", "newusers", None), (9, 9, "log", 4, 0, "d", "move", {"target_title": "e"}), (10, 10, "edit", 0, 5, "z", None, None),
    ]
    e = events(spark, rows)
    assert {(r.pageid, r.delivery_id) for r in mirror.latest_per_page(e).collect()} == {(1, 3), (2, 6), (3, 7)}
    assert {r.title for r in mirror.affected_titles(e).collect()} == {"d", "e"}
    assert mirror.latest_per_page(e.limit(0)).count() == 0


def test_thousand_edits_are_two_candidates(spark):
    rows = [(i, i, "edit", 1, 100 + i, "p", None, None) for i in range(1000)] + [(1000, 5, "edit", 1, 105, "p", None, None), (1001, 2000, "edit", 2, 1, "q", None, None)]
    fresh = mirror.new_events(events(spark, rows))
    assert fresh.count() == 1001 and mirror.latest_per_page(fresh).count() == 2
    assert mirror.new_events(fresh, fresh.where("rcid < 999").select("rcid")).count() == 2


ROW = "id bigint, title string, namespace bigint, isRedirect boolean, deleted boolean, revisionId bigint, contentModel string, localSeq bigint, content string, contentRevisionId bigint"


def test_merge_and_sweep(spark):
    row = lambda i, title="t", rev=1, deleted=None, seq=1: (i, title, 0, None, deleted, rev, None, seq, "c", 1)
    stored = spark.createDataFrame([row(1), row(2, rev=9), row(3), row(4, seq=50), row(5, deleted=True), row(6), row(7, seq=None)], ROW)
    scanned = spark.createDataFrame([row(1), row(2, rev=5), row(3, title="u"), row(4, title="v"), row(5), row(8)], ROW)
    got = {r.id: (r.action, r.title) for r in mirror.merge_scan(stored, scanned, F.lit(10)).collect()}
    assert got == {1: ("unchanged", "t"), 2: ("kept", "t"), 3: ("changed", "u"), 4: ("kept", "t"), 5: ("changed", "t"), 8: ("added", "t")}
    gone = mirror.tombstone(mirror.sweep(stored, scanned, F.lit(10)))
    assert {(r.id, r.deleted, r.content) for r in gone.collect()} == {(6, True, None), (7, True, None)}


def test_sequence_is_dense_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    out = mirror.assign_sequence(df, ["k"], base=5).orderBy("k").collect()
    assert [r.localSeq for r in out] == list(range(6, 1006))
    assert mirror.assign_sequence(df.limit(0), ["k"]).count() == 0
    assert mirror.chunks(df, ["k"], 300).groupBy("chunk").count().orderBy("chunk").collect()[3]["count"] == 100


def test_late_bodies_and_repair(spark):
    e = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "pageid bigint, revid bigint")
    r = spark.createDataFrame([(1, 5), (2, 6), (3, 4)], "pageid bigint, revid bigint")
    assert {tuple(x) for x in mirror.late_bodies(e, r).collect()} == {(1, "ok"), (2, "defer"), (3, "stale"), (4, "missing")}
    p = spark.createDataFrame([(1, "done"), (2, "pending")], "pageId bigint, wanted string")
    j = spark.createDataFrame([(1, "done"), (2, "done"), (3, "done")], "pageId bigint, status string")
    assert {tuple(x) for x in mirror.outer_repair(p, j).collect()} == {(1, "keep"), (2, "put"), (3, "delete")}


def test_store_commits_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"facts": 1})
    base = store.manifest()
    assert base.version == 0 and store.read("t") is None and store.status("t", 0) == "missing"
    first = store.commit(base, {"t": spark.range(3)}, {"t.through": 4})
    with pytest.raises(Conflict):
        store.commit(base, {"t": spark.range(9)})
    assert store.read("t").count() == 3 and store.manifest() == first
    assert store.status("t", 4) == "available" and store.status("t", 5) == "replay-required"
    second = store.update(lambda m: ({"u": spark.range(m.version)}, {}), batch=0)
    assert store.update(lambda m: ({"u": spark.range(99)}, {}), batch=0).version == second.version
    assert store.read("u").count() == 1 and store.read("t", first).count() == 3
    with pytest.raises(Incompatible):
        Store(spark, str(tmp_path / "s"), {"facts": 2}).commit(second, {})
    assert Store(spark, str(tmp_path / "s"), {"facts": 2}).status("t", 0) == "outdated"
    path = tmp_path / "s" / "manifests" / f"{second.version:012d}.json"
    broken = json.loads(path.read_text())
    broken["counts"]["t"] = [77]
    path.write_text(json.dumps(broken))
    (tmp_path / "s" / "manifests" / f".{second.version:012d}.json.crc").unlink(missing_ok=True)
    assert store.status("t", 0) == "corrupt"
    store.drop()
    assert Store(spark, str(tmp_path / "s")).manifest() == Manifest()


def test_stream_counts_every_event_once(spark, tmp_path):
    rows = [(i, i % 20, "edit", 1, i, "p", None, None) for i in range(60)]
    src = str(tmp_path / "in")
    e = events(spark, rows)
    e.repartition(3).write.parquet(src)
    cols = ["delivery_id", "rcid", "type", "title"]
    m = FeedMirror(Store(spark, str(tmp_path / "s")), cols)
    m.run(read_feed(spark, src, e.schema, 1), str(tmp_path / "c"))
    assert m.events().count() == 20 and m.store.manifest().batch == 2
    m.apply(e, 2)  # the last batch once more
    assert m.store.manifest().batch == 2 and m.events().count() == 20
    events(spark, [(100, 3, "edit", 1, 1, "p", None, None), (101, 500, "edit", 1, 1, "p", None, None)]).write.mode("append").parquet(src)
    m.run(read_feed(spark, src, e.schema, 1), str(tmp_path / "c"))
    assert m.events().count() == 21 and len(m.store.manifest().tables["events"]) > 3
    m.store.compact("events")
    assert m.events().count() == 21 and len(m.store.manifest().tables["events"]) == 1


def served(*answers):
    """A fetch function that gives the answers in turn, and the list of what was asked."""
    urls = []

    def fetch(url):
        urls.append(url)
        return answers[len(urls) - 1]

    return fetch, urls


def test_connector_follows_continuation():
    fetch, urls = served(
        {"query": {"pages": [{"pageid": 1, "ns": 0, "title": "a", "lastrevid": 5}]}, "continue": {"gapcontinue": "b"}},
        {"query": {"pages": [{"pageid": 2, "ns": 0, "title": "b", "redirect": True}]}},
    )
    got = list(pages_of("http://h/api", 0, fetch))
    assert [g[0] for g in got] == [1, 2] and got[1][3] is True and "gapcontinue=b" in urls[1] and "maxlag=5" in urls[0]
    change = {"type": "log", "rcid": 1, "timestamp": "2025-03-01T00:00:00Z", "logparams": {"target_title": "t", "target_ns": 0}}
    fetch, urls = served({"query": {"recentchanges": [change]}, "continue": {"rccontinue": "x|1"}}, {"query": {"recentchanges": [{"type": "edit"}]}})
    got = list(changes_of("u", "a", "b", fetch))
    assert got[0][11] == {"target_title": "t", "target_ns": "0"} and got[0][7].year == 2025 and got[1][7] is None and "rccontinue=x" in urls[1]


def test_connector_lookups():
    fetch, urls = served({"query": {"pages": [{"pageid": 1}]}}, {"query": {"pages": [{"pageid": 2}]}}, {"query": {"pages": [{"title": "t", "missing": True}]}})
    assert len(list(info_of("u", [1, 2], ["t"], fetch, size=1))) == 3 and "pageids=2" in urls[1] and "titles=t" in urls[2]
    fetch, _ = served({"query": {"pages": [{"pageid": 1, "missing": True}, {"pageid": 2, "revisions": [{"revid": 9, "slots": {"main": {"content": "c"}}}]}, {"pageid": 3}]}})
    assert list(bodies_of("u", [1, 2, 3], fetch)) == [(1, True, None, None, None), (2, False, 9, None, "c")]
    fetch, urls = served({"_embedded": [{"_id": "a"}], "_returned": 1}, {"_embedded": []})
    assert list(data_of("u", ["id"], fetch, size=1)) == [("a", '{"_id": "a"}')] and "keys=" in urls[0]
    with pytest.raises(RemoteError):
        list(data_of("u", None, lambda u: {"_embedded": [{}]}, size=1, most=2))


def test_connector_retries():
    slept = []
    fetch, urls = served({"error": {"code": "maxlag"}}, {"error": {"code": "maxlag"}}, {"ok": 1})
    assert query("u", {}, fetch, sleep=slept.append) == {"ok": 1} and slept == [0.5, 1.0] and len(urls) == 3
    with pytest.raises(RemoteError):
        query("u", {}, lambda u: {"error": {"code": "badtoken"}}, sleep=slept.append)
    assert len(slept) == 2


def test_connector_helpers():
    assert [retryable(s) for s in (200, 404, 408, 429, 500, 503)] == [False, False, True, True, True, True]
    assert retry_after("5") == 5.0 and retry_after(None) is None and retry_after("x") is None
    assert retry_after("Thu, 01 Jan 1970 00:01:00 GMT", now=0) == 60.0
    assert WikiSource.name() == "wiki_list" and len(WikiSource({"namespaces": "0,4"}).reader(None).partitions()) == 2


def test_manifest_shapes():
    good = vars(Manifest(1, {"t": ["p"]}, {"t": [3]}, {"t": ["d"]}, {"x": 1}, {}, 0))
    assert validated(good).counts == {"t": [3]}
    for broken in (None, [], {}, good | {"version": -1}, good | {"version": True}, good | {"tables": {"t": "p"}}, good | {"counts": {}}, good | {"counts": {"t": [1.5]}}, good | {"counts": {"t": [3, 4]}}, good | {"digests": {}}, good | {"batch": "1"}, good | {"format": 9}, good | {"more": 1}):
        with pytest.raises(Incompatible):
            validated(broken)


def test_deltas_and_touches(spark):
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert {tuple(r) for r in mirror.status_delta(rows("a", "a", "b"), rows("b", "b", "c")).collect()} == {("a", -2), ("b", 1), ("c", 1)}
    changed = spark.createDataFrame([(0, 3500), (1, None)], "namespace bigint, old_namespace bigint")
    assert mirror.touches(changed, 3500).first()[0] and not mirror.touches(changed, 9).first()[0] and not mirror.touches(changed.limit(0), 0).first()[0]


def test_schedule():
    d = schedule.DAY
    assert schedule.fresh(5, 1, d) and not schedule.fresh(0, 1, d) and not schedule.fresh(5, 0, 6) and not schedule.fresh(None, 1, 6) and not schedule.fresh(5, 1, 6, False)
    assert [schedule.scan_reason(*a) for a in ((True, 0, None, None), (False, d, None, 0), (False, d, 1, 0), (False, d, 1, 1))] == ["manual", "scheduled", "gap", None]
    assert schedule.next_due(10, 5, 4, lambda: 0.5) == 17


def test_namespaces_come_from_the_site(monkeypatch):
    site = {"0": {"id": 0, "name": ""}, "-1": {"id": -1, "name": "特殊"}, "6": {"id": 6, "name": "文件"}, "10": {"id": 10, "name": "", "canonical": "Template"}, "4": {"id": 4, "name": "项目", "canonical": "Project"}}
    fetch = lambda url: {"query": {"namespaces": site}}
    assert wiki.namespaces_of("http://x", fetch) == [(0, "（主）"), (4, "项目"), (10, "Template")]
    monkeypatch.setattr(wiki.namespaces_of, "__defaults__", (fetch,))
    assert [p.number for p in WikiSource({"url": "http://x"}).reader(None).partitions()] == [0, 4, 10]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    import threading

    stores = [Store(spark, str(tmp_path / "s")) for _ in range(2)]
    base, results, start = stores[0].manifest(), [], threading.Barrier(2)

    def write(n):
        df = spark.range(n + 1)
        start.wait()
        try:
            results.append(stores[n].commit(base, {"t": df}).version)
        except Conflict:
            results.append("conflict")

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, results)) == ["1", "conflict"] and stores[0].versions() == [1]
    assert [f for f in os.listdir(tmp_path / "s" / "manifests")] == ["000000000001.json"]


def test_parts_can_be_replaced_and_changed_files_are_noticed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda _: ({"t": spark.range(3)}, {}))
    for n in (1, 2):
        store.update(lambda _, n=n: ({}, {}, {"t": spark.range(n)}))
    m = store.update(lambda _: ({}, {}, {"t": spark.range(5)}, {"t": 1}))
    assert m.counts["t"] == [3, 5] and len(m.digests["t"]) == 2 and store.read("t").count() == 8 and store.status("t", 0) == "available"
    part = next(f for f in sorted(os.listdir(m.tables["t"][1])) if f.endswith(".parquet"))
    with open(os.path.join(m.tables["t"][1], part), "ab") as f:
        f.write(b"x")
    assert store.status("t", 0) == "corrupt"


def test_a_cluster_has_to_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from lodestrand.sources.work import work_dir

    conf = SimpleNamespace(get=lambda *a: None)
    for master, good in (("local[4]", True), ("local", True), ("local-cluster[3,2,1024]", False), ("spark://x:7077", False), ("yarn", False)):
        context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
        try:
            work_dir(SimpleNamespace(sparkContext=context, conf=conf))
        except RuntimeError:
            assert not good
        except AttributeError:  # the stand-in has no folder to give
            assert good


def test_time_is_sliced_without_gap_or_overlap():
    slices = wiki.time_slices("2025-05-01T00:00:00Z", "2025-05-01T00:00:09Z", 3)
    assert slices == [("2025-05-01T00:00:00Z", "2025-05-01T00:00:03Z"), ("2025-05-01T00:00:04Z", "2025-05-01T00:00:07Z"), ("2025-05-01T00:00:08Z", "2025-05-01T00:00:09Z")]
    assert wiki.time_slices("2025-05-01T00:00:00Z", "2025-05-01T00:00:00Z", 8) == [("2025-05-01T00:00:00Z", "2025-05-01T00:00:00Z")]
    assert wiki.time_slices("2025-05-01T00:00:01Z", "2025-05-01T00:00:00Z", 8) == []
