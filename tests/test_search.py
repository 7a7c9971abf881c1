"""Search operators: golden orders and rebuild equals incremental equals reload."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions.charmaps import simplified_table
from lodestrand.functions.text import Analyzer
from lodestrand.operators import search
from lodestrand.operators.index import SearchIndex, apply_changes, build_index, corpus_stats, vocabulary
from lodestrand.plans import search_queries

PAGE = "id bigint, title string, normalizedTitle string, namespace bigint, namespaceName string, deleted boolean, isRedirect boolean, contentModel string, content string"


@pytest.fixture(scope="module")
def analyzer(spark):
    return Analyzer(simplified=simplified_table(spark))


def pages(spark, analyzer, *rows):
    full = [(i, t, None if t is None else analyzer.normalize_text(t), ns, "x", d, None, "wikitext", None) for i, t, ns, d in rows]
    return spark.createDataFrame(full, PAGE)


def ids(df):
    return [r.id for r in df.collect()]


def test_linear(spark, analyzer):
    p = pages(spark, analyzer, (1, "12号鹿弹", 0, None), (2, "模板:PopupNotice", 10, False), (3, "鹿弹", 0, None), (4, "鹿弹", 0, True), (5, None, 0, None), (6, "", 0, None))
    assert ids(search.linear_search(p, "鹿彈", analyzer)) == [3, 1]
    assert ids(search.linear_search(p, "opu", analyzer, namespace=10)) == [2]
    assert ids(search.linear_search(p, "opu", analyzer, namespace=0)) == []
    assert ids(search.linear_search(p, " ! ", analyzer)) == []
    many = search.linear_search_many(p, ["鹿", "opu", ""], analyzer).collect()
    assert {(r.query, r.id, r["rank"]) for r in many} == {("鹿", 3, 1), ("鹿", 1, 2), ("opu", 2, 1)}


def test_queries_of_any_length(spark, analyzer):
    many = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    assert len(set(analyzer.query_tokens(analyzer.normalize_text(many)))) > 62
    p = pages(spark, analyzer, (1, many, 0, None), (2, many[:30], 0, None), (3, many[::-1], 0, None), (4, "x", 0, None))
    index = build_index(p, "title", analyzer)
    terms = analyzer.query_tokens(analyzer.normalize_text(many))
    assert ids(search.ranked_hits(index, terms)) == [1]
    assert sorted(ids(search.ranked_hits(index, [*terms, "zzz"]))) == [1, 2, 3]
    assert ids(search.title_search(index, many, analyzer)) == [1]


def test_ranked_titles(spark, analyzer):
    p = pages(spark, analyzer, (1, "12号鹿弹", 0, None), (2, "12号霰弹弹盒", 0, None), (3, "鹿弹", 0, None), (4, "模块:Popups", 828, None), (5, "医用级兴奋剂", 0, None))
    index = build_index(p, "title", analyzer)
    find = lambda q, **k: ids(search.title_search(index, q, analyzer, **k))
    assert find("鹿弹")[:2] == [3, 1]
    assert find("醫用級興奮劑")[0] == 5 and find("opu")[0] == 4
    assert find("popupz")[0] == 4 and find("治错") == [] and find("") == []
    assert find("鹿弹", namespace=828) == []


def test_ties_and_typos(spark, analyzer):
    p = pages(spark, analyzer, (2, "测试乙", 0, None), (1, "测试甲", 0, None), (10, "治疗指南", 0, None), (11, "治疗方案", 0, None), (12, "化疗说明", 0, None))
    index = build_index(p, "title", analyzer)
    assert ids(search.title_search(index, "测试", analyzer)) == [1, 2]
    assert ids(search.title_search(index, "治错", analyzer)) == []
    assert ids(search.title_search(index, "治", analyzer)) == [10, 11]
    both = search.combined_search(search.title_search(index, "测试", analyzer), search.linear_search(p, "测试", analyzer))
    assert [r.score > 9_000 for r in both.collect()] == [True, True]


def test_empty_index(spark, analyzer):
    p = pages(spark, analyzer)
    index = build_index(p, "title", analyzer)
    assert ids(search.title_search(index, "x yz", analyzer)) == []
    assert corpus_stats(index).first()["docs"] == 0 and vocabulary(index).count() == 0


def test_content_relaxes_only_when_nothing_has_all(spark, analyzer):
    docs = spark.createDataFrame([(1, "t", "t", 0, "alpha beta"), (2, "t", "t", 0, "alpha"), (3, "alpha", "alpha", 0, "alpha gamma"), (4, "t", "t", 0, None)], "id bigint, title string, normalizedTitle string, namespace bigint, text string")
    index, texts = build_index(docs, "text", analyzer), docs.select("id", "text")
    found = lambda q: set(ids(search.content_search(index, texts, q, analyzer)))
    assert found("alpha beta") == {1} and found("beta gamma") == {1, 3}
    top = search.content_search(index, texts, "alpha", analyzer).orderBy(F.desc("score")).first()
    assert top.id == 3 and "alpha" in top.snippet


def test_rebuild_equals_incremental_equals_reload(spark, analyzer, tmp_path):
    old = pages(spark, analyzer, (1, "Lantern one", 0, None), (2, "Torch two", 0, None))
    changed = pages(spark, analyzer, (1, "Rope one", 0, None), (2, "Torch two", 0, True), (3, "Knife three", 0, None))
    now = pages(spark, analyzer, (1, "Rope one", 0, None), (3, "Knife three", 0, None))
    build_index(old, "title", analyzer).save(str(tmp_path))
    updated = apply_changes(SearchIndex.load(spark, str(tmp_path)), changed, "title", analyzer)
    fresh = build_index(now, "title", analyzer)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(updated.postings.select("term", "id")) == rows(fresh.postings.select("term", "id"))
    assert rows(updated.stats) == rows(fresh.stats)


def test_index_lookup_is_pushed_down(spark, analyzer, tmp_path):
    build_index(pages(spark, analyzer, (1, "Lantern one", 0, None)), "title", analyzer).save(str(tmp_path))
    plan = SearchIndex.load(spark, str(tmp_path)).postings.where(F.col("term").startswith("lan"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan


def test_lua_search_prefers_exact_keys(spark, analyzer):
    rows = [
        (1, "模块:A", "local t = {}\nreturn { _meta = 1, other = 2 }"),
        (2, "模块:B", "local s = '_meta'\nlocal q = '_meta extra'"),
        (3, "模块:C", "local z = 'nothing'"),
    ]
    p = spark.createDataFrame([(i, t, t, 828, "模块", None, False, "Scribunto", c) for i, t, c in rows], PAGE)
    out = search.lua_search(search.lua_documents(p), "_meta", analyzer).collect()
    assert [r.id for r in out] == [1, 2] and out[0].matches[0].kind == "return-key"
    assert search.lua_search(search.lua_documents(p), "", analyzer).count() == 0


def test_data_codes(spark, analyzer):
    rows = [("Data:Item/a", "pistol", "手枪", "Item", "手枪", None, ["手枪", "半自动武器"]), ("Data:Item/b", "smallmagazine", "手枪弹匣", "Item", "手枪弹匣", None, None), ("Data:Item/c", "Morphine", "吗啡", "Item", "吗啡", None, None)]
    r = spark.createDataFrame(rows, "source string, code string, chineseName string, dataType string, normalizedName string, normalizedSearchText string, normalizedSearchValues array<string>")
    codes = lambda q: [x.code for x in search.data_code_search(r, q, analyzer).collect()]
    assert codes("手枪") == ["pistol", "smallmagazine"] and codes("半自动武器") == ["pistol"]
    assert codes("morph") == ["Morphine"] and codes("不要命中") == [] and codes("") == []


def test_incremental_query_replaces_and_removes(spark, tmp_path, monkeypatch):
    rows = [(i, f"page{i}", f"page{i}", 0, "x", i % 5 == 0, None, "wikitext", None, i) for i in range(1, 41)]
    spark.createDataFrame(rows, PAGE + ", localSeq bigint").write.parquet(f"{tmp_path}/pages.parquet")
    seen = {}

    def watched(index, changed, text, analyzer):
        before = {r.id: r.title for r in index.stats.collect()}
        for r in changed.collect():
            seen.setdefault("removed" if r.deleted and r.id in before else "added" if r.id not in before else "replaced" if before[r.id] != r.title else "same", []).append(r.id)
        return apply_changes(index, changed, text, analyzer)

    monkeypatch.setattr(search_queries, "apply_changes", watched)
    got = search_queries.index_incremental_equals_rebuild(spark, str(tmp_path)).collect()
    assert {r.id for r in got} == {r[0] for r in rows if not r[5]} and not any("older" in (r.first_term, r.last_term) for r in got)
    assert seen.keys() == {"added", "replaced", "removed"} and len(seen["removed"]) == 8
