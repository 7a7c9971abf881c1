"""Queries of the text functions over pages, documents and events, and their SQL."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import functions as F

from lodestrand.functions import extract, lua, rules, text
from lodestrand.functions.charmaps import simplified_table
from lodestrand.functions.text import Analyzer
from lodestrand.operators.mirror import assign_sequence
from lodestrand.operators.search import live
from lodestrand.plans.search_queries import _CJK, _compact, full, lua_search_sql, page_content_sql, tokens_sql
from lodestrand.sources.work import spread, table

PLAIN = Analyzer(compatibility=False)
# fixed values: markup counted by the corpus profile
PATTERNS = {"template": "{{", "link": "[[", "table": "{|", "heading": "==", "bold": "'''", "reference": "<ref", "comment": "<!--", "list": "\n*", "redirect": "#"}


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _bodies(spark, sf_dir, model):
    return spread(live(_pages(spark, sf_dir))).where((F.lower("contentModel") == model) & F.col("content").isNotNull())


def normalize_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", PLAIN.normalize(F.col("title")).alias("normalized"))


def normalize_full(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", full(spark).normalize(F.col("title")).alias("normalized"))


def compact_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", PLAIN.compact(F.col("title")).alias("compact"), text.cjk_of(F.col("title")).alias("cjk"))


def latin_runs(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", text.latin_runs(F.col("title")).alias("runs"))


def latin_parts(spark, sf_dir):
    runs = _pages(spark, sf_dir).select(F.explode(text.latin_runs(F.col("title"))).alias("run")).distinct()
    return runs.select("run", F.sort_array(text.latin_parts(F.col("run"))).alias("parts"))


def trigrams(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", text.grams(F.col("title"), 3).alias("grams"))


def doc_tokens(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", F.sort_array(PLAIN.document_tokens(F.col("title"))).alias("tokens"))


def doc_tokens_whole(spark, sf_dir):
    """With the whole normalised text as a word, split again at blanks."""
    whole = Analyzer(compatibility=False, segmenter="whole", engine="whole")
    return _pages(spark, sf_dir).select("id", F.sort_array(whole.document_tokens(F.col("title"))).alias("tokens"))


def cjk_tokens(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", F.sort_array(text.cjk_tokens(F.col("title"))).alias("tokens"))


def wikitext_text(spark, sf_dir):
    return _bodies(spark, sf_dir, "wikitext").select("id", extract.wikitext(F.col("content")).alias("text"))


def decode_entities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", extract.decode_entities(F.col("text")).alias("decoded"))


def json_tokens(spark, sf_dir):
    return _bodies(spark, sf_dir, "bson").select("id", extract.json_tokens(F.col("content")).alias("text"))


def json_rule_values(spark, sf_dir):
    chosen = rules.parse_rules('* = .locales["zh-CN"].name, .id')
    return _bodies(spark, sf_dir, "bson").select("id", F.sort_array(rules.rule_values(F.col("content"), F.lit("x"), chosen)).alias("found"))


def json_wildcard_values(spark, sf_dir):
    chosen = rules.parse_rules("* = .locales.**")
    return _bodies(spark, sf_dir, "bson").select("id", F.sort_array(rules.rule_values(F.col("content"), F.col("title"), chosen)).alias("found"))


def lua_symbols(spark, sf_dir):
    """One row per symbol of every live module."""
    found = _bodies(spark, sf_dir, "scribunto").withColumn("s", lua.lua_symbols(F.col("content")))
    return found.select("id", F.explode(lua.typed_symbols(F.col("s"))).alias("x")).select("id", "x.*")


def lua_function_names(spark, sf_dir):
    """Every declared function by regular expression, one row per match."""
    return _bodies(spark, sf_dir, "scribunto").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"function\s+([A-Za-z_][A-Za-z0-9_.:]*)\s*\("), F.lit(1))).alias("name"))


def syntax_counts(spark, sf_dir):
    """Pages that contain each kind of markup."""
    return _pages(spark, sf_dir).agg(*[F.count_if(F.col("content").contains(p)).alias(n) for n, p in PATTERNS.items()])


def corpus_profile(spark, sf_dir):
    """Per content model pages, characters, empty bodies and batches of 50."""
    return _pages(spark, sf_dir).groupBy("contentModel").agg(
        F.countDistinct("id").alias("pages"), F.sum(F.length("content")).alias("chars"), F.count_if(F.coalesce(F.col("content"), F.lit("")) == "").alias("empty"),
        F.ceil(F.count("*") / 50).alias("batches"),
    )


def longest_docs(spark, sf_dir):
    """The 15 longest bodies."""
    return _pages(spark, sf_dir).where("content is not null").select("id", F.length("content").cast("long").alias("n")).orderBy(F.desc("n"), "id").limit(15)


def latency_percentiles(spark, sf_dir):
    """Value at place floor(n * q) of the sorted values, by event type."""
    v = table(spark, sf_dir, "events").where("value is not null")
    # ranks by range partitions: no task holds a whole type
    ranked = assign_sequence(v.select("event_type", "value"), ["event_type", "value"], column="at")
    groups = ranked.groupBy("event_type").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row per type
    ranked = ranked.join(groups, "event_type").withColumn("rn", F.col("at") - F.col("first") + 1)
    pick = lambda q: F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * q) + 1, F.col("n")), F.col("value")))
    return ranked.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max("value").alias("worst"))


def page_paths(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", text.page_path(F.col("title")).alias("path"), text.wiki_link(F.col("title"), "x", F.col("namespace")).alias("link"))


def byte_sizes(spark, sf_dir):
    return _pages(spark, sf_dir).where("content is not null").select("id", F.sha2("content", 256).alias("sha256"), text.byte_size(F.octet_length("content")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, normalize_full, compact_text, latin_runs, latin_parts, trigrams, doc_tokens, doc_tokens_whole, cjk_tokens, wikitext_text, decode_entities, json_tokens,
        json_rule_values, json_wildcard_values, lua_symbols, lua_function_names, syntax_counts, corpus_profile, longest_docs, latency_percentiles, page_paths, byte_sizes,
    )
}

_BLANK = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _wikitext_sql(c: str) -> str:
    """The chain of replacements; only markup that SQL's expressions can state."""
    blocks = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in extract.BLOCKS.split("|"))
    steps = [
        (r"(?s)<!--.*?-->", " "), (f"(?is){blocks}", " "), (extract.REFERENCE, " "), (extract.LINK_LABEL, r"\1 \2"), (extract.LINK, r"\1"),
        (r"\[(?:https?:)?//\S+\s+([^\]]+)\]", r"\1"), (extract.EXTERNAL, " "), (r"(?i)<br\s*/?>", " "), ("<[^>]+>", " "),
    ]
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    c = _entities_sql(c)
    for pattern, by in ((r"\{\{|\}\}|\{\||\|\}", " "), ("[|=]+", " "), ("''{2,}", ""), (r"(?m)^\s*[!*#:;]+", " "), (_BLANK, " ")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim({c})"


def _entities_sql(c: str) -> str:
    for name, by in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        c = f"regexp_replace({c}, '(?i)&{name};', '{by}', 'g')"
    return c


# Lua that SQL's expressions can cut: comments to the end of a line, strings without escapes, flat tables
_LUA_TOKEN = r"--[^\n]*|\[\[(?s:.*?)(?:\]\]|\z)|''[^'']*(?:''|\z)|\"[^\"]*(?:\"|\z)|function\s+[A-Za-z_][A-Za-z0-9_.:]*\s*\(|require\s*\(|return\s*\{|return\s+[A-Za-z_][A-Za-z0-9_]*\s*;?\s*\z|[A-Za-z_][A-Za-z0-9_]*\s*=|[{}\[\]=]"
# symbols (id, kind, value, priority, place) of every live module; places order the symbols of a module
LUA_SYMBOLS_SQL = rf"""WITH cuts AS (SELECT id, regexp_extract_all(content, '{_LUA_TOKEN}') AS cut FROM pages WHERE NOT coalesce(deleted, false) AND lower(contentModel) = 'scribunto' AND content IS NOT NULL),
marks AS (SELECT id, unnest(cut) AS tok, unnest(generate_series(1, len(cut))) AS i FROM cuts),
seen AS (SELECT *, max(CASE WHEN tok LIKE 'return%{{' THEN i END) OVER w AS opened, max(CASE WHEN tok = '}}' THEN i END) OVER w AS closed, lag(tok) OVER o AS prior, lead(tok) OVER o AS nxt, lead(tok, 2) OVER o AS nxt2
  FROM marks WHERE tok NOT LIKE '--%' WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY id ORDER BY i)),
bare AS (SELECT *, CASE WHEN left(tok, 1) IN (chr(39), chr(34)) THEN replace(tok, left(tok, 1), '') WHEN tok LIKE '[[%' THEN regexp_replace(tok, '^\[\[|\]\]$', '', 'g') END AS raw,
  CASE WHEN left(nxt, 1) IN (chr(39), chr(34)) THEN replace(nxt, left(nxt, 1), '') END AS needed FROM seen),
texts AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, regexp_replace(needed, '^\s+|\s+$', '', 'g') AS loaded, opened > coalesce(closed, 0) AS inside,
  regexp_extract(tok, '^function\s+(.*?)\s*\($', 1) AS fn, regexp_extract(tok, '^return\s+([A-Za-z_][A-Za-z0-9_]*)\s*;?\s*$', 1) AS root FROM bare),
roots AS (SELECT id, root FROM texts WHERE root <> ''),
found AS (SELECT id, 'function' AS kind, fn AS value, 4 AS priority, i AS place FROM texts WHERE fn <> ''
  UNION ALL SELECT id, 'return-key', text, 3, i FROM texts WHERE inside AND prior = '[' AND nxt = ']' AND nxt2 = '=' AND text IS NOT NULL
  UNION ALL SELECT id, 'return-key', regexp_extract(tok, '^[A-Za-z0-9_]+'), 3, i FROM texts WHERE inside AND regexp_matches(tok, '^[A-Za-z_][A-Za-z0-9_]*\s*=$')
  UNION ALL SELECT t.id, 'return-key', regexp_extract(substr(t.fn, length(r.root) + 2), '^[^.:]+'), 3, 1000000 + i FROM texts t JOIN roots r ON r.id = t.id WHERE starts_with(t.fn, r.root || '.') OR starts_with(t.fn, r.root || ':')
  UNION ALL SELECT id, 'dependency', loaded, 2, i FROM texts WHERE tok LIKE 'require%(' AND loaded <> ''
  UNION ALL SELECT id, 'string', text, 1, i FROM texts WHERE text <> '')
SELECT id, kind, value, priority, priority * -100000000 + min(place) AS place FROM found GROUP BY id, kind, value, priority"""


def _page_path_sql() -> str:
    encoded = "url_encode(replace(title, ' ', '_'))"
    for code, sign in (*text.PLAIN_SIGNS.items(), ("%2A", "*")):
        encoded = f"replace({encoded}, '{code}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return encoded


_BSON = "NOT coalesce(deleted, false) AND lower(contentModel) = 'bson' AND content IS NOT NULL"
_P = "SELECT id, title AS text FROM pages"
_SORTED = "list_sort(coalesce(list(term) FILTER (term IS NOT NULL), []))"

ORACLES = {
    "normalize_text": f"SELECT id, trim(regexp_replace(lower(title), '{_BLANK}', ' ', 'g')) AS normalized FROM pages",
    "compact_text": f"SELECT id, {_compact('lower(title)')} AS compact, regexp_replace(title, '[^{_CJK}]', '', 'g') AS cjk FROM pages",
    "latin_runs": "SELECT id, regexp_extract_all(title, '[A-Za-z0-9._]+') AS runs FROM pages",
    "latin_parts": """WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(title, '[A-Za-z0-9._]+')) AS run FROM pages),
c AS (SELECT run, lower(run) AS low, lower(regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')) AS sp, regexp_replace(lower(run), '[^a-z0-9]', '', 'g') AS bare FROM r),
p AS (SELECT run, low AS term FROM c WHERE bare <> '' UNION SELECT run, term FROM (SELECT run, unnest(string_split_regex(low, '[._]+')) AS term FROM c) WHERE term <> ''
  UNION SELECT run, term FROM (SELECT run, unnest(string_split_regex(sp, '[ ._]+')) AS term FROM c) WHERE term <> ''
  UNION SELECT run, substr(bare, CAST(i AS BIGINT), 3) FROM (SELECT run, bare, unnest(generate_series(1, length(bare) - 2)) AS i FROM c WHERE length(bare) >= 4))
SELECT r.run, list_sort(coalesce(list(p.term) FILTER (p.term IS NOT NULL), [])) AS parts FROM r LEFT JOIN p ON p.run = r.run GROUP BY r.run""",
    "trigrams": "SELECT id, CASE WHEN title IS NOT NULL THEN list_transform(generate_series(1, length(title) - 2), lambda i: substr(title, CAST(i AS BIGINT), 3)) ELSE [] END AS grams FROM pages",
    "doc_tokens": f"WITH {tokens_sql(_P)} SELECT src.id, {_SORTED} AS tokens FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id",
    "cjk_tokens": f"WITH {tokens_sql(_P)} SELECT src.id, {_SORTED} AS tokens FROM src LEFT JOIN (SELECT * FROM tok WHERE regexp_matches(term, '[{_CJK}]')) tok ON tok.id = src.id GROUP BY src.id",
    "wikitext_text": f"SELECT id, {_wikitext_sql('content')} AS text FROM pages WHERE NOT coalesce(deleted, false) AND lower(contentModel) = 'wikitext' AND content IS NOT NULL",
    # the documents hold no numeric references
    "decode_entities": f"SELECT doc_id, {_entities_sql('text')} AS decoded FROM documents",
    "json_tokens": f"""WITH t AS (SELECT p.id AS page, j.* FROM (SELECT id, content FROM pages WHERE {_BSON} AND json_valid(content)) p, json_tree(p.content) j),
k AS (SELECT t.page, t.id AS pos, 0 AS part, t.key AS token FROM t JOIN t AS u ON u.page = t.page AND u.id = t.parent WHERE u.type = 'OBJECT'
  UNION ALL SELECT page, id, 1, CASE WHEN type = 'DOUBLE' THEN regexp_replace(atom ->> '$', '\\.0+$', '') ELSE trim(atom ->> '$') END FROM t WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND trim(atom ->> '$') <> ''),
f AS (SELECT page, token, min(pos * 2 + part) AS pos FROM k GROUP BY page, token)
SELECT b.id, trim(regexp_replace(coalesce(string_agg(f.token, ' ' ORDER BY f.pos), ''), '\\s+', ' ', 'g')) AS text FROM (SELECT id FROM pages WHERE {_BSON}) b LEFT JOIN f ON f.page = b.id GROUP BY b.id""",
    "json_wildcard_values": f"""WITH t AS (SELECT p.id AS page, CASE WHEN j.type = 'DOUBLE' THEN regexp_replace(j.atom ->> '$', '\\.0+$', '') ELSE trim(j.atom ->> '$') END AS token
  FROM (SELECT id, content FROM pages WHERE {_BSON} AND json_valid(content)) p, json_tree(p.content, '$.locales') j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT b.id, list_sort(coalesce(list(DISTINCT t.token) FILTER (t.token <> ''), [])) AS found FROM (SELECT id FROM pages WHERE {_BSON}) b LEFT JOIN t ON t.page = b.id GROUP BY b.id""",
    "lua_symbols": f"SELECT id, kind, value, priority FROM ({LUA_SYMBOLS_SQL})",
    "page_paths": "SELECT id, " + _page_path_sql() + """ AS path, '[[' || CASE WHEN namespace IN (6, 14) THEN ':' ELSE '' END || title || CASE WHEN lower(title) = 'x' THEN '' ELSE '|x' END || ']]' AS link FROM pages""",
    "doc_tokens_whole": f"""WITH {tokens_sql(_P)}, every AS (SELECT id, term FROM tok UNION SELECT id, unnest(string_split(trim(regexp_replace(lower(text), '{_BLANK}', ' ', 'g')), ' ')) FROM src)
SELECT src.id, list_sort(coalesce(list(term) FILTER (term <> ''), [])) AS tokens FROM src LEFT JOIN every ON every.id = src.id GROUP BY src.id""",
    "json_rule_values": f"SELECT id, list_sort(list_distinct(list_filter([trim(content ->> '$.locales.zh-CN.name'), trim(content ->> '$.id')], lambda x: x <> ''))) AS found FROM (SELECT id, CASE WHEN json_valid(content) THEN content END AS content FROM pages WHERE {_BSON})",
    "lua_function_names": r"SELECT id, unnest(regexp_extract_all(content, 'function\s+([A-Za-z_][A-Za-z0-9_.:]*)\s*\(', 1)) AS name FROM pages WHERE NOT coalesce(deleted, false) AND lower(contentModel) = 'scribunto' AND content IS NOT NULL",
    "syntax_counts": "SELECT " + ", ".join(f"count(*) FILTER (contains(content, {'chr(10) || ' if p[0] == chr(10) else ''}'{p.strip(chr(10)).replace(chr(39), chr(39) * 2)}')) AS {n}" for n, p in PATTERNS.items()) + " FROM pages",
    "corpus_profile": "SELECT contentModel, count(DISTINCT id) AS pages, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) FILTER (coalesce(content, '') = '') AS empty, CAST(ceil(count(*) / 50) AS BIGINT) AS batches FROM pages GROUP BY contentModel",
    "longest_docs": "SELECT id, length(content) AS n FROM pages WHERE content IS NOT NULL ORDER BY n DESC, id LIMIT 15",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (rn = least(floor(n * 0.5) + 1, n)) AS p50, max(value) FILTER (rn = least(floor(n * 0.95) + 1, n)) AS p95, max(value) AS worst FROM r GROUP BY event_type""",
    "byte_sizes": "SELECT id, sha256(content) AS sha256, CASE WHEN strlen(content) < 1024 THEN strlen(content) || ' B' WHEN strlen(content) < 1048576 THEN format('{:.1f} KiB', round(strlen(content) / 1024.0, 1)) ELSE format('{:.1f} MiB', round(strlen(content) / 1048576.0, 1)) END AS size FROM pages WHERE content IS NOT NULL",
}
# searches over what is extracted here
ORACLES["page_content_search"] = page_content_sql(f"SELECT * FROM ({ORACLES['wikitext_text']}) UNION ALL SELECT * FROM ({ORACLES['json_tokens']})")
ORACLES["lua_search"] = lua_search_sql(LUA_SYMBOLS_SQL)


def mapped_sql(source: str, table: dict[str, str]) -> str:
    """A SELECT of key and text with every character replaced by ``table`` and composed again (SQL has no decomposition)."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items())
    return f"""(WITH src AS ({source}), m(k, v) AS (VALUES {rows}),
c AS (SELECT key, i, substr(text, CAST(i AS BIGINT), 1) AS ch FROM (SELECT key, text, unnest(generate_series(1, length(text))) AS i FROM src)),
j AS (SELECT c.key, nfc_normalize(string_agg(coalesce(m.v, c.ch), '' ORDER BY c.i)) AS text FROM c LEFT JOIN m ON m.k = c.ch GROUP BY c.key)
SELECT src.key, CASE WHEN src.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text FROM src LEFT JOIN j ON j.key = src.key)"""


@functools.lru_cache(maxsize=1)
def late_oracles(spark) -> dict[str, str]:
    """SQL with the character tables of ICU, which a running session gives."""
    compatible = {}
    for point in range(0x80, 0x110000):
        ch = chr(point)
        if not 0xD800 <= point <= 0xDFFF and unicodedata.decomposition(ch) and (plain := unicodedata.normalize("NFKD", ch)) != unicodedata.normalize("NFD", ch):
            compatible[ch] = plain
    simple = simplified_table(spark)
    before, after = "".join(map(chr, simple)), "".join(simple.values())
    folded = mapped_sql("SELECT id AS key, title AS text FROM pages", compatible)
    return {"normalize_full": f"SELECT key AS id, trim(regexp_replace(lower(translate(text, '{before}', '{after}')), '{_BLANK}', ' ', 'g')) AS normalized FROM {folded}"}
