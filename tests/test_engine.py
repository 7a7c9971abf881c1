"""The engine end to end: rebuild equals replay, fences, sequence rules, modes."""

import pytest

from lodestrand.engine import Engine
from lodestrand.functions.charmaps import simplified_table
from lodestrand.functions.text import Analyzer

ROW = "id bigint, title string, namespace bigint, revisionId bigint, contentModel string, content string, contentRevisionId bigint, isRedirect boolean"


def rows(spark, *given):
    return spark.createDataFrame([(i, t, ns, rev, model, body, rev if body else None, False) for i, t, ns, rev, model, body in given], ROW)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "m"), Analyzer(simplified=simplified_table(spark)))


def found(df):
    return [r.id for r in df.collect()]


def test_life_of_a_mirror(spark, engine):
    start = rows(spark, (1, "12号鹿弹", 0, 10, "wikitext", "'''brick''' [[砖块]]"), (2, "鹿弹", 0, 20, "wikitext", None), (3, "模块:A", 828, 30, "Scribunto", "local p = {}\nfunction p.open() end\nreturn p"))
    assert engine.ingest(start) == 3 and engine.ingest(start) == 3  # nothing changed, no number taken
    assert found(engine.search("title", "鹿彈"))[:2] == [2, 1]
    assert found(engine.search("content", "砖块")) == [1] and found(engine.search("lua", "open")) == [3]
    assert engine.refresh("title") == "current" and engine.status("content") == "available"
    assert engine.ingest(rows(spark, (2, "熊弹", 0, 21, "wikitext", "bear"), (1, "old", 0, 9, "wikitext", None))) == 4  # 1 is stale
    assert engine.remove(spark.createDataFrame([(3,), (99,)], "id bigint")) == 5
    assert engine.status("title") == "replay-required" and engine.refresh("title") == "replayed"
    replayed = sorted(map(tuple, engine.index("title").postings.collect()))
    assert engine.refresh("title", rebuild=True) == "rebuilt"
    assert sorted(map(tuple, engine.index("title").postings.collect())) == replayed
    assert found(engine.search("title", "熊弹"))[0] == 2 and 2 not in found(engine.search("title", "鹿弹"))
    assert found(engine.search("lua", "open")) == [] and found(engine.search("content", "bear")) == [2]
    engine.clear()
    assert engine.status("title") == "outdated" and engine.refresh("title") == "rebuilt"
    before = sorted(map(tuple, engine.rows().collect()), key=lambda r: r[0])
    engine.compact()
    assert sorted(map(tuple, engine.rows().collect()), key=lambda r: r[0]) == before and len(engine.store.manifest().tables["pages"]) == 1
    d = engine.diagnostics()
    assert (d["pages"], d["tombstones"], d["bodies"], d["modules"], d["sequence"]) == (2, 1, 2, 0, 5)


def test_reconcile_keeps_what_was_written_during_the_scan(spark, engine):
    engine.ingest(rows(spark, (1, "a", 0, 1, "wikitext", "x"), (2, "b", 0, 1, "wikitext", None), (3, "c", 0, 5, "wikitext", None)))
    began = engine.sequence
    engine.ingest(rows(spark, (4, "new", 0, 1, "wikitext", None)))
    engine.remove(spark.createDataFrame([(2,)], "id bigint"))
    scan = rows(spark, (1, "a", 0, 1, "wikitext", None), (2, "b", 0, 1, "wikitext", None), (3, "c", 0, 4, "wikitext", None), (5, "missed", 0, 1, "wikitext", None))
    engine.reconcile(scan, began)
    state = {r.id: (r.deleted, r.content) for r in engine.rows().collect()}
    assert state == {1: (False, "x"), 2: (True, None), 3: (False, None), 4: (False, None), 5: (False, None)}
    after = engine.sequence
    engine.reconcile(rows(spark, (1, "a", 0, 1, "wikitext", None)), after)
    assert {r.id for r in engine.rows().where("not deleted").collect()} == {1} and engine.sequence == after + 3


def test_files_data_and_batches(spark, engine):
    engine.ingest(rows(spark, (7, "文件:morphine.png", 6, 1, None, None)), "files", batch=3)
    assert engine.ingest(rows(spark, (8, "文件:again.png", 6, 1, None, None)), "files", batch=3) == 1  # the batch once more
    assert found(engine.search("file", "morphine")) == [7] and found(engine.search("file", "again")) == []
    with pytest.raises(LookupError):
        engine.search("data", "x")
    docs = spark.createDataFrame([("Data:Item/a", '{"id":"bricks","locales":{"zh-CN":{"name":" 砖块 "}}}'), ("Data:Item/b", '{"id":"q"}'), (None, "{")], "source string, json string")
    assert engine.load_data_codes(docs) == 1
    assert [r.code for r in engine.search("data", "磚塊").collect()] == ["bricks"]
    with pytest.raises(ValueError):
        engine.search("nothing", "x")
    assert engine.diagnostics()["title index"] == "missing"


def test_empty_engine(engine):
    assert found(engine.search("title", "x")) == [] and found(engine.search("content", "x y")) == [] and engine.sequence == 0


def test_parts_are_merged_when_they_grow_and_searches_stay_the_same(spark, tmp_path):
    from lodestrand.operators.index import merge_from

    assert merge_from([100]) == 1 and merge_from([100, 10]) == 2 and merge_from([100, 10, 2]) == 3 and merge_from([100, 10, 6]) == 1 and merge_from([10, 6]) == 0
    assert merge_from([100, 0]) == 2
    engine = Engine(spark, str(tmp_path / "m"), Analyzer())
    engine.ingest(rows(spark, *[(i, f"title{i} common", 0, 1, "wikitext", None) for i in range(1, 40)]))
    assert engine.refresh("title") == "rebuilt"
    seen = []
    for step in range(4):
        engine.ingest(rows(spark, *[(i, f"changed{step} common", 0, 2 + step, "wikitext", None) for i in range(1 + 2 * step, 4 + 2 * step)], (100 + step, f"added{step}", 0, 1, "wikitext", None)))
        engine.remove(spark.createDataFrame([(30 + step,)], "id bigint"))
        assert engine.refresh("title") == "replayed"
        seen.append([c for c in engine.store.manifest().counts["title"]])
    assert len(seen[0]) == 2 and seen[0][0] == 39 and any(len(x) < len(y) + 1 for x, y in zip(seen[1:], seen, strict=False)) and all(x[0] == 39 for x in seen[:2])
    index = engine.index("title")
    state = lambda i: (sorted(map(tuple, i.postings.collect())), sorted(map(tuple, i.stats.select("id", "field_len", "title").collect())), sorted(map(tuple, i.words.select("term", "df").collect())), i.totals)
    kept = state(index)
    found_common = found(engine.search("title", "common"))
    engine.refresh("title", rebuild=True)
    assert state(engine.index("title")) == kept and found(engine.search("title", "common")) == found_common and len(engine.store.manifest().counts["title"]) == 1


def test_index_belongs_to_what_made_it(spark, tmp_path):
    root = str(tmp_path / "m")
    plain, simple = Engine(spark, root, Analyzer()), Engine(spark, root, Analyzer(simplified=simplified_table(spark)))
    plain.ingest(rows(spark, (1, "鹿彈", 0, 1, "wikitext", None)))
    assert plain.refresh("title") == "rebuilt" and simple.refresh("title") == "rebuilt" and plain.status("title") == "outdated"
    with pytest.raises(ValueError):
        Engine(spark, root, Analyzer(segmenter=lambda t: [t])).refresh("title")
    own = [Engine(spark, root, Analyzer(segmenter=lambda t: [t], engine=e))._key("title") for e in ("one", "two")]
    assert own[0] != own[1]
    docs = spark.createDataFrame([("Data:Item/a", '{"id":"b","locales":{"zh-CN":{"name":"x"}}}')], "source string, json string")
    plain.load_data_codes(docs)
    assert found_codes(plain.search("data", "x")) == ["b"]
    with pytest.raises(LookupError):
        Engine(spark, root, Analyzer(), rules="* = .id").search("data", "x")


def found_codes(df):
    return [r.code for r in df.collect()]


def test_repeated_ids_of_one_batch_count_once(spark, engine):
    engine.ingest(rows(spark, (1, "old", 0, 3, "wikitext", None), (1, "new", 0, 4, "wikitext", None), (1, "older", 0, 2, "wikitext", None)))
    assert [(r.id, r.title, r.localSeq) for r in engine.rows().collect()] == [(1, "new", 1)]


def test_title_search_reads_only_row_groups_of_its_terms(spark, engine):
    engine.ingest(rows(spark, (1, "Lantern", 0, 1, "wikitext", None), (2, "zantern zebra", 0, 1, "wikitext", None)))
    engine.refresh("title")
    from lodestrand.operators import search

    hits = search.title_search(engine.index("title"), "lantern", engine.analyzer)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "title.terms" in line and "PushedFilters" in line]
    assert scans and all("StringStartsWith(term,lantern)" in line and "EqualTo(term,zantern)" in line for line in scans)
    assert found(hits) == [1]
