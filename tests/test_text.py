"""Analyzer, extraction, Lua and rules: golden cases."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import extract, lua, rules, text
from lodestrand.functions.charmaps import simplified_table
from lodestrand.functions.text import Analyzer


@pytest.fixture(scope="module")
def analyzer(spark):
    return Analyzer(simplified=simplified_table(spark))


def run(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_normalize(spark, analyzer):
    cases = {" ＭＯＤ　安裝教學 ": "mod 安装教学", "a  b": "a b", "": "", "ﬃ": "ffi"}
    assert run(spark, analyzer.normalize, *cases) == list(cases.values())
    assert [analyzer.normalize_text(v) for v in cases] == list(cases.values())
    assert run(spark, analyzer.normalize, None) == [None]
    assert run(spark, analyzer.compact, "L.R.D. 血清", "é!") == ["lrd血清", ""]


def test_document_tokens(spark, analyzer):
    one, spaced, camel, pop, empty, none = run(spark, analyzer.document_tokens, "医用级兴奋剂", "医疗-救治", "getId", "Popups", "", None)
    assert {"医", "用", "医用", "兴奋", "奋剂"} <= set(one)
    assert "疗救" not in spaced and "医疗" in spaced
    assert "id" in camel and "getid" in camel and "opu" in pop and empty == [] and none == []


def test_column_and_string_forms_agree(spark, analyzer):
    values = ["HTTPServer_v2.Foo", "a..b", "12号鹿弹 ABC", "模块:Foo.bar-test", "XMLHttp", "ＡＢ.cd", "____", "一", "é"]
    columns = run(spark, text.latin_runs, *values)
    assert columns[3] == ["Foo.bar", "test"]
    for v, got in zip(values, run(spark, lambda c: F.transform(text.latin_runs(c), text.latin_parts), *values), strict=True):
        assert [sorted(x) for x in got] == [sorted(text.latin_parts_text(r)) for r in __import__("re").findall(text.LATIN_RUN, v)]


def test_query_tokens(analyzer):
    assert analyzer.query_tokens("鹿") == ["鹿"]
    assert {"鹿", "x"} <= set(analyzer.query_tokens("鹿x"))
    assert analyzer.query_tokens("  ") == []
    assert "疗救" not in analyzer.query_tokens("医疗 救治")
    assert [text.fuzzy_budget(t) for t in ("abc", "abcd", "治疗", "治疗法")] == [0, 1, 0, 1]


def test_segmenters(spark):
    assert run(spark, Analyzer(segmenter="whole").document_tokens, "ab cd")[0][:2] == ["ab", "cd"]
    assert "naïve" in run(spark, Analyzer(segmenter="words").document_tokens, "naïve x")[0]
    assert "B" in run(spark, Analyzer(segmenter=lambda t: ["A B"]).document_tokens, "z")[0]


def test_dictionary_segmenter(spark):
    from lodestrand.functions.segment import DictionarySegmenter

    words = DictionarySegmenter.read(["防毒面具 50 n", "防毒 80", "面具 90", "医用 60", "兴奋剂 30", "兴奋 70", "", "x", "兴奋 1"])
    assert words.cut("医用级兴奋剂") == ["医用", "级", "兴奋剂"] and words("防毒面具，abc1") == ["防毒", "面具", "防毒面具", "abc1"]
    assert words("") == [] and words("， 。") == [] and DictionarySegmenter({})("中文 ab") == ["中", "文", "ab"]
    assert len(words("兴" * 5000)) == 5000
    a = Analyzer(segmenter=words.share(spark), engine="tiny")
    tokens = run(spark, a.document_tokens, "医用级防毒面具", None)
    assert {"防毒面具", "防毒", "医用"} <= set(tokens[0]) and tokens[1] == []
    assert "防毒面具" in a.query_tokens("防毒面具") and a.digest() != Analyzer().digest()
    with pytest.raises(ValueError):
        Analyzer(segmenter=words).digest()


def test_phrases(spark):
    a = Analyzer(phrases={"滑鼠": "鼠标", "滑": "华", "a.c": "dot"}, simplified={ord("標"): "标"})
    values = ["用滑鼠標", "滑 a.c abc", "", None]
    assert run(spark, a.normalize, *values) == ["用鼠标标", "华 dot abc", "", None] and [a.normalize_text(v) for v in values[:3]] == ["用鼠标标", "华 dot abc", ""]


def test_long_link_texts_and_deep_documents(spark):
    import time

    began = time.time()
    assert run(spark, extract.wikitext, "[//" + "x" * 200_000, "[https://a.b c d] e", "[//a.b]c d]") == ["[//" + "x" * 200_000, "c d e", "d"]
    assert time.time() - began < 60
    for text_ in ['{"a": [1, 2.50, -0, 1e3, true, null, "x"], "a": {"b": ""}}', '[1, "\\ud83d\\ude00 \\ud800"]', " 12 ", '"\\u0041"', '{"2": 1, "1": 2}']:
        assert extract.parse_json(text_) == extract.parse_deep_json(text_)
    for bad in ("", "{", "[1,]", "NaN", "[Infinity]", '{"a" 1}', "01", "'a'", '"\t"', "[1] x"):
        for parse in (extract.parse_json, extract.parse_deep_json):
            with pytest.raises(ValueError):
                parse(bad)
    assert extract.json_token_text("[" * 100_000 + '"x"' + "]" * 100_000) == "x"


def test_snippet(spark, analyzer):
    long = "x" * 50 + " Needle " + "y" * 100
    cut, direct, none, null = run(spark, lambda c: text.snippet(c, "needle", analyzer), long, "a needle", "nothing here", None)
    assert cut.startswith("…") and cut.endswith("…") and "Needle" in cut and len(cut) == 36 + 6 + 64 + 2
    assert direct == "a needle" and none == "nothing here" and null == ""


def test_links_and_sizes(spark):
    row = spark.createDataFrame([("文件:A b.png", 6)], "t string, n bigint").select(
        text.wiki_link(F.col("t"), "q", F.col("n")), text.page_path(F.lit("A b/c:d")), text.byte_size(F.lit(10)), text.byte_size(F.lit(2048))
    ).first()
    assert tuple(row) == ("[[:文件:A b.png|q]]", "A_b%2Fc%3Ad", "10 B", "2.0 KiB")


def test_wikitext(spark):
    cases = {
        "[[医用级兴奋剂|强效兴奋剂]]用于-{zh-hans:急救;zh-hant:急救處置}-": "医用级兴奋剂 强效兴奋剂用于急救 急救處置",
        "{{物品信息框|代码=highgradestimulant}}": "物品信息框 代码 highgradestimulant",
        "a<!-- x\ny -->b<ref name=q>z</ref>c<ref name=r />d": "a b c d",
        "&amp; &lt; &gt; &quot; &apos; &#20320;&#x597D; &copy;": "& < > \" ' 你好 &copy;",
        "&amp;lt;": "&lt;",
        "&#0; &#xD800; &#1114112; &#128512;": "&#0; &#xD800; &#1114112; 😀",
        "<script>bad()</script>ok<br/>y [http://e.org/x label] [https://e.org]": "ok y label",
        "* '''bold''' text\n# next": "bold text next",
        "": "",
    }
    assert run(spark, extract.wikitext, *cases) == list(cases.values())
    assert run(spark, extract.wikitext, None) == [None]


def test_json_tokens():
    source = '{"id":"bricks","locales":{"zh-CN":{"name":"砖块","description":"可用于搭建耐火墙体"}},"properties":{"blastResistance":12.5,"craftable":true,"n":null,"m":1.0,"b":" "}}'
    assert extract.json_token_text(source) == "id bricks locales zh-CN name 砖块 description 可用于搭建耐火墙体 properties blastResistance 12.5 craftable true n m 1 b"
    assert extract.json_token_text('{"b":1,"10":2,"2":3}') == "2 3 10 b 1"
    deep = '{"a":' * 12_000 + '"deepMarker"' + "}" * 12_000
    assert "deepMarker" in extract.json_token_text(deep)
    for bad in ("", None, "{", "[1,]", '{"a":1,}', "1 2", "{'a':1}", "nul", "[1]]", '"\x01"'):
        assert extract.json_token_text(bad) == "", bad
    assert extract.parse_json('["\\u4f60\\n\\ud83d\\ude00", [], {}]') == ["你\n😀", [], {}]


def test_content_text(spark):
    df = spark.createDataFrame([("WikiText", "'''a'''"), ("bson", '{"k":"v"}'), ("css", "x"), (None, "x"), ("wikitext", None)], "m string, c string")
    assert [r[0] for r in df.select(extract.content_text(F.col("m"), F.col("c"))).collect()] == ["a", "k v", "", "", ""]


LUA = """
-- require('Module:Fake')
--[==[ function hidden() end ]==]
local p = {}
local base = require('Module:Base/查询工具')
local d = mw.loadData "Module:Data"
function p.render_read_error(frame) return 1 end
p.alias = function() end
x=1-- "hidden line"
if p.foo == e or p.bar ~= e then end
p.real = [[long]]
local q = 1..'a\\'b'
return p
"""


def test_lua():
    got = lua.lua_symbols_of(LUA)
    assert got["functions"] == ["p.render_read_error", "p.alias"]
    assert set(got["returnKeys"]) == {"render_read_error", "alias", "real"}
    assert got["dependencies"] == ["Module:Base/查询工具", "Module:Data"]
    assert "hidden line" not in got["strings"] and "a'b" in got["strings"] and "long" in got["strings"]
    keys = lua.lua_symbols_of('return { ok = false, ["error-code"] = 2, [1] = f(a, b), nested = { inner = 1 }, "x" }')["returnKeys"]
    assert keys == ["ok", "error-code", "1", "nested"]
    long = "local a = " + ".".join(["b"] * 400) + "\nfunction after() end"
    assert lua.lua_symbols_of(long)["functions"] == ["after"]
    assert lua.lua_symbols_of(None) == {"functions": [], "returnKeys": [], "strings": [], "dependencies": []}
    assert lua.lua_tokens("0x1F.8p+2 3..4 1e5")[0] == ("number", "0x1F.8p+2")


def test_rules():
    parsed = rules.parse_rules('# note\nItem = .locales["zh-CN"].name, .properties.aliases[]\n* = .a.*.b, .c.**')
    assert parsed["Item"] == [["locales", "zh-CN", "name"], ["properties", "aliases"]]
    doc = '{"locales":{"zh-CN":{"name":" 手枪 "}},"properties":{"aliases":["x",2,"x"]},"a":{"q":{"b":true}},"c":{"d":[{"e":1}]}}'
    assert rules.selected_values(doc, "Data:Item/p.json", parsed) == ["手枪", "x", "2"]
    assert rules.selected_values(doc, "Data:Other/p.json", parsed) == ["true", "1"]
    assert rules.selected_values("{", "x", parsed) == [] and rules.selected_values(None, None, parsed) == []
    assert rules.projection(parsed) == ["id", "locales.zh-CN.name", "properties.aliases", "a", "c"]
    assert rules.projection({"*": [["**"]]}) is None
    for bad in ("", "x", "a = b", "a = .", "a = .x*", 'a = .["x', "= .a"):
        with pytest.raises(rules.RuleError):
            rules.parse_rules(bad)
    assert rules.upgrade_rules(rules.OLDER_RULES) == rules.DEFAULT_RULES != rules.OLDER_RULES
    assert rules.upgrade_rules(rules.OLDER_RULES + " ") == rules.OLDER_RULES + " " and rules.upgrade_rules(None) is None
    assert rules.first_valid([None, "no rule", rules.OLDER_RULES]) == rules.DEFAULT_RULES
    assert rules.first_valid([None, "bad", "a = .b"]) == "a = .b"
