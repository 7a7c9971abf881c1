"""Change feed, messages, snapshots and references: defined cases and brute force."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from lodestrand.operators.change_feed import apply_change_feed
from lodestrand.operators import messages
from lodestrand.operators.messages import MessageStore, keep_one_copy, surplus_messages
from lodestrand.operators.references import change_references, job_references, month_of, orphan_counts, orphan_references
from lodestrand.operators.snapshots import snapshot_changes
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FEED = (
    "delivery_id bigint, batch_id bigint, type string, ns bigint, title string, pageid bigint, revid bigint, rcid bigint,"
    " timestamp timestamp, logtype string, logaction string, logparams map<string,string>, owner string, kind string, seq bigint"
)
T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)


def event(i, rcid, type_="edit", page=1, rev=0, title="t", logtype=None, action=None, target=None, at=T0):
    return (i, 1, type_, 0, title, page, rev, rcid, at, logtype, action, {"target_title": target} if target else None, "extra", "extra", 5)


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def state(df):
    return {r.pageid: (r.revid, r.title) for r in df.collect()}


def test_feed_orders_by_sequence_not_arrival(spark):
    rows = [
        event(1, 30, "log", title="a", logtype="delete", action="restore"),
        event(2, 10, "new", rev=1, title="a"),
        event(3, 20, "log", title="a", logtype="delete", action="delete"),
        event(4, 40, "log", title="a", logtype="move", action="move", target="b"),
        event(5, 10, "new", rev=1, title="a"),
    ]
    assert state(apply_change_feed(feed(spark, rows))) == {1: (1, "b")}


def test_feed_removal_by_title_and_unknown_logs(spark):
    rows = [
        event(1, 1, "new", page=7, rev=3, title="x"),
        event(2, 2, "log", page=7, title="x", logtype="move", action="move_redir", target="y"),
        event(3, 3, "log", page=0, title="y", logtype="delete", action="delete_redir"),
        event(4, 4, "new", page=8, rev=9, title="z"),
        event(5, 5, "log", page=8, title="z", logtype="delete", action="revision"),
        event(6, 6, "log", page=0, title="nobody", logtype="delete", action="delete"),
        event(7, None, "log", page=8, title="z", logtype="delete", action="delete"),
        event(8, 8, "log", page=9, title="q", logtype="delete", action="restore"),
        event(9, 9, None, page=8, title="q"),
        event(10, 10, "edit", page=None, title="q"),
        event(11, 11, "edit", page=8, rev=10, title=None),
    ]
    assert state(apply_change_feed(feed(spark, rows))) == {8: (10, None)}


def test_feed_against_replay(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for rcid in range(1, 400):
        page = rng.choice([1, 1, 1, 2, 3, 4, 5])
        kind = rng.choice(["edit", "edit", "new", "delete", "restore", "move", "block"])
        e = (
            event(i, rcid, kind, page, rcid, f"p{page}")
            if kind in ("edit", "new")
            else event(i, rcid, "log", page, 0, f"p{page}", "move" if kind == "move" else "delete" if kind in ("delete", "restore") else kind, kind, f"m{rcid}" if kind == "move" else None)
        )
        rows += [e] * rng.choice([1, 1, 2])
        i += 1
    rng.shuffle(rows)
    live, alive = {}, set()
    for r in sorted({r[7]: r for r in rows}.values(), key=lambda r: r[7]):
        if r[2] in ("edit", "new"):
            live[r[5]] = [r[6], r[4]]
            alive.add(r[5])
        elif r[9] == "move" and r[5] in live:
            live[r[5]][1] = r[11]["target_title"]
        elif r[10] == "delete":
            alive.discard(r[5])
        elif r[10] == "restore" and r[5] in live:
            alive.add(r[5])
    assert state(apply_change_feed(feed(spark, rows))) == {p: tuple(v) for p, v in live.items() if p in alive}


def test_feed_empty(spark):
    assert apply_change_feed(feed(spark, [])).columns == ["pageid", "revid", "title"]
    assert apply_change_feed(feed(spark, [])).count() == 0


def test_messages_against_brute_force(spark):
    rng = random.Random(9)
    rows = [event(i, rng.choice([None, *range(1, 25)]), page=rng.randint(1, 3), rev=rng.randint(1, 4)) for i in range(1, 300)]
    rows = [(*r[:6], None if i % 40 == 0 else r[6], *r[7:]) for i, r in enumerate(rows)]
    owner = {}
    for r in rows:
        if r[7] is not None:
            place = (r[2], r[5], r[6], r[8])
            owner[place] = min(owner.get(place, r[7]), r[7])
    seen, surplus = {}, set()
    for r in sorted(rows):
        place = (r[2], r[5], r[6], r[8])
        key = r[7] if r[7] is not None else owner.get(place, place)
        if key in seen:
            surplus.add(r[0])
        seen.setdefault(key, r[0])
    f = feed(spark, rows)
    assert {r[0] for r in surplus_messages(f, 3).collect()} == surplus
    assert keep_one_copy(f, 3).count() == len(rows) - len(surplus)
    assert surplus_messages(feed(spark, []), 3).count() == 0


def kept(store):
    return sorted(r.delivery_id for r in store.messages().collect())


def test_message_store_is_idempotent(spark, tmp_path):
    one, two = [event(3, 7), event(4, 8), event(5, 7)], [event(2, 7), event(9, 9)]
    store = MessageStore(spark, f"{tmp_path}/s", 3)
    store.upsert(feed(spark, one), "one")
    store.upsert(feed(spark, two), "two")
    store.upsert(feed(spark, two), "two")
    assert store.runs() == ["one", "two"] and spark.table(store.name).count() == 4 and kept(store) == [2, 4, 9]
    plan = store.spark.table(store.name).groupBy("slot").agg(F.min("delivery_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # several runs of a bucket meet in one task
    store.compact()
    assert len(store.runs()) == 1 and spark.table(store.name).count() == 3 and kept(store) == [2, 4, 9]
    store.upsert(feed(spark, [event(1, 9), event(10, 10)]), "three")
    assert kept(store) == [1, 2, 4, 10]
    with pytest.raises(ValueError):
        store.upsert(feed(spark, one), "no/name")
    store.close()
    again = MessageStore(spark, f"{tmp_path}/s", 17)  # opened by its path, with the buckets it was made with
    assert again.buckets == 3 and kept(again) == [1, 2, 4, 10]
    again.close()


def test_message_store_in_two_processes(spark, tmp_path):
    """A batch sent again by another process, after a compaction cut off before it removed what it had merged."""
    import subprocess
    import sys

    store = MessageStore(spark, f"{tmp_path}/s", 2)
    store.upsert(feed(spark, [event(5, 7), event(6, None, page=2)]), "one")
    store.close()
    code = """
import sys
from pyspark.sql import SparkSession
from lodestrand.operators.messages import MessageStore
sys.path.insert(0, "tests")
from test_maintenance import event, feed

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/w").config("spark.sql.session.timeZone", "UTC").getOrCreate()
store = MessageStore(spark, sys.argv[1] + "/s")
for again in range(2):
    store.upsert(feed(spark, [event(3, 7), event(8, 4, page=2)]), "two")

class CutOff:
    def __init__(self, fs):
        self.listStatus = fs.listStatus

    def delete(self, *args):
        pass

store._fs = CutOff(store._fs)
store.compact()
print(sorted(r.delivery_id for r in store.messages().collect()), len(store.runs()))
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, timeout=300)
    assert out.stdout.strip().endswith("[3, 6] 3"), out.stdout + out.stderr[-2000:]
    store = MessageStore(spark, f"{tmp_path}/s")
    assert kept(store) == [3, 6]
    store.compact()
    assert kept(store) == [3, 6] and len(store.runs()) == 1
    store.close()


def test_message_batches_find_each_other(spark, tmp_path):
    first, second = [event(1, None, page=1), event(2, None, page=2)], [event(3, 7, page=1), event(4, None, page=2), event(5, 7, page=1)]
    for n, order in enumerate(((first, second), (second, first))):
        store = MessageStore(spark, f"{tmp_path}/{n}", 3)
        for name, rows in zip("ab", order, strict=True):
            store.upsert(feed(spark, rows), name)
        assert kept(store) == [1, 2]
        store.compact()
        assert kept(store) == [1, 2]
        store.close()
    store = MessageStore(spark, f"{tmp_path}/runs", 3)
    many = feed(spark, [(*event(i, 7)[:1], i, *event(i, 7)[2:]) for i in range(1, 41)])
    store.load(many, F.pmod(F.xxhash64("batch_id"), F.lit(messages.RUNS)))
    assert len(store.runs()) == messages.RUNS == spark.table(store.name).count() and kept(store) == [1]
    with pytest.raises(ValueError):
        store.load(many, F.lit(0))
    store.close()


def test_message_keeps_its_places(spark, tmp_path):
    """A message whose copies differ is found at every place, also after a compaction; the lowest rcid owns a shared place."""
    store = MessageStore(spark, f"{tmp_path}/s", 3)
    store.upsert(feed(spark, [event(5, 7, page=1), event(6, 7, page=2), event(7, 9, page=2)]), "a")
    store.upsert(feed(spark, [event(8, 9, page=3)]), "b")
    store.compact()
    store.upsert(feed(spark, [event(1, None, page=2), event(2, None, page=3), (3, *event(3, None)[1:6], None, *event(3, None)[7:])]), "c")
    assert kept(store) == [1, 2, 3]
    store.close()


SCAN = "seenInReconciliation bigint, id bigint, title string, namespace bigint, isRedirect boolean, revisionId bigint, contentModel string, deleted boolean, localSeq bigint, n int, new boolean"


def scan(number, i, title="t", rev=1, deleted=None, seq=1, redirect=None):
    return (number, i, title, 0, redirect, rev, None, deleted, seq, 1, True)


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(spark.createDataFrame(rows, SCAN)).collect()))


def test_snapshots(spark):
    rows = [
        scan(1, 1), scan(1, 2), scan(1, 3), scan(1, 4, redirect=None), scan(1, 5, title=None),
        scan(4, 1), scan(4, 2, rev=None), scan(4, 3, deleted=True), scan(4, 4, redirect=False), scan(4, 5, title=None), scan(4, 6, seq=1), scan(4, 6, title="u", seq=2), scan(4, 6, title="u", seq=2),
        scan(9, 7, deleted=True),
        scan(None, 1), scan(1, None),
    ]
    first = [(4, 2, "changed"), (4, 3, "removed"), (4, 6, "added")]
    assert changes(spark, rows) == first + [(9, i, "removed") for i in (1, 2, 4, 5, 6)]
    assert changes(spark, rows[:5]) == [] and changes(spark, []) == []


def test_references(spark):
    parents = spark.createDataFrame(
        [(1, 100, None, None), (2, None, None, False), (3, 100, 200, True), (4, 100, None, True), (5, 100, 200, True), (5, 300, None, False)],
        "id bigint, storedAt bigint, tombstonedAt bigint, deleted boolean",
    )
    refs = spark.createDataFrame(
        [("r", i, p, None if t is None else t * 1000) for i, p, t in [(1, 1, 99), (2, 1, 100), (3, 1, None), (4, 2, 0), (5, 3, 150), (6, 3, 200), (7, 3, None), (8, 4, 150), (9, 77, 5), (9, 77, 5), (10, None, 5), (11, 5, 250), (12, 5, 300)]],
        "source_table string, row_id bigint, pageid bigint, at bigint",
    )
    found = {(r.row_id, r.period) for r in orphan_references(refs, parents).collect()}
    assert found == {(1, "1970-01"), (6, "1970-01"), (7, "unknown"), (8, "1970-01"), (9, "1970-01"), (11, "1970-01")}
    assert {(r.period, r.orphans) for r in orphan_counts(refs, parents).collect()} == {("1970-01", 5), ("unknown", 1)}
    assert orphan_references(refs.limit(0), parents).count() == 0
    assert orphan_references(refs, parents.limit(0)).count() == 11


def test_reference_forms(spark):
    f = feed(spark, [event(1, 5, page=3, at=T0 + timedelta(seconds=1)), event(2, None, page=3), event(3, 6, page=0)])
    assert [(r.row_id, r.pageid) for r in change_references(f).collect()] == [(5, 3)]
    jobs = spark.createDataFrame([(1, 2, None), (1, 2, None), (2, None, 5)], "id bigint, pageId bigint, updatedAt bigint")
    assert job_references(jobs).count() == 2
    months = spark.range(1).select(month_of(F.lit(-1)).alias("a"), month_of(F.lit(1_740_787_200_000_000)).alias("b"), month_of(F.lit(None).cast("bigint")).alias("c")).first()
    assert tuple(months) == ("1969-12", "2025-03", "unknown")
