"""Search queries over the mirror's pages, files and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.charmaps import simplified_table
from lodestrand.functions.extract import content_text
from lodestrand.functions.rules import DEFAULT_RULES, category, parse_rules, rule_values
from lodestrand.functions.text import CJK, Analyzer, fuzzy_budget
from lodestrand.operators import search
from lodestrand.operators.index import META, SearchIndex, apply_changes, build_index, corpus_stats, vocabulary
from lodestrand.sources.work import fresh_path, materialize, spread, table

# SQL has no NFKC: the queries that are compared with SQL fold case only, the others do everything
PLAIN = Analyzer(compatibility=False)
TITLE, FUZZY, COMBINED = "Gasket 背包", "gaskat", "Jasper"
BODY_AND, BODY_OR, BODY_PREFIX = "generator 输液袋", "generator 输液袋 zzyzx", "tourni"
BODY_PAGES, LUA = "体温计 渡口", "scalpel"
MANY = ("背包", "模块", "Lantern", "jasper", "渡口", "")


def full(spark: SparkSession) -> Analyzer:
    """Everything on: NFKC, simplified characters, words of word characters."""
    return Analyzer(simplified=simplified_table(spark), segmenter="words", engine="words")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("id", "title", "normalizedTitle", "namespace", "namespaceName", "isRedirect", "deleted", "contentModel", "content", "localSeq")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live titles."""
    return search.live(pages(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bodies: the source is the title, the language the namespace."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("source").alias("normalizedTitle"), F.col("lang").alias("namespace"), "text")


def body_index(spark: SparkSession, sf_dir: str) -> tuple[SearchIndex, DataFrame]:
    d = spread(documents(spark, sf_dir))
    return build_index(d, "text", PLAIN), d.select("id", "text")


def title_linear_search(spark, sf_dir):
    return search.linear_search(pages(spark, sf_dir), "背包", PLAIN)


def title_linear_namespace(spark, sf_dir):
    return search.linear_search(pages(spark, sf_dir), "Lantern", PLAIN, namespace=828)


def file_search(spark, sf_dir):
    return search.linear_search(table(spark, sf_dir, "file_resources"), "Torch", PLAIN)


def linear_multi_query(spark, sf_dir):
    return search.linear_search_many(pages(spark, sf_dir), MANY, PLAIN).withColumn("rank", F.col("rank").cast("long"))


def title_ranked_search(spark, sf_dir):
    return search.title_search(build_index(titles(spark, sf_dir), "title", PLAIN), TITLE, PLAIN)


def title_search_fuzzy(spark, sf_dir):
    return search.title_search(build_index(titles(spark, sf_dir), "title", PLAIN), FUZZY, PLAIN)


def title_combined_search(spark, sf_dir):
    index = build_index(titles(spark, sf_dir), "title", PLAIN)
    return search.combined_search(search.title_search(index, COMBINED, PLAIN), search.linear_search(pages(spark, sf_dir), COMBINED, PLAIN))


def title_search_full(spark, sf_dir):
    a = full(spark)
    return search.title_search(build_index(titles(spark, sf_dir), "title", a), "ＧＡＳＫＥＴ 背包", a)


def content_search_and(spark, sf_dir):
    return search.content_search(*body_index(spark, sf_dir), BODY_AND, PLAIN)


def content_search_or_fallback(spark, sf_dir):
    return search.content_search(*body_index(spark, sf_dir), BODY_OR, PLAIN).drop("snippet")


def content_search_namespace(spark, sf_dir):
    return search.content_search(*body_index(spark, sf_dir), BODY_AND, PLAIN, namespace="en").drop("snippet")


def content_search_prefix(spark, sf_dir):
    return search.content_search(*body_index(spark, sf_dir), BODY_PREFIX, PLAIN).drop("snippet")


def _page_content(spark, sf_dir, query: str, a: Analyzer):
    rows = spread(titles(spark, sf_dir)).where(~F.coalesce("isRedirect", F.lit(False)) & F.col("content").isNotNull())
    # the extracted texts are a derived table of their own: index and snippets read it
    docs = materialize(rows.select("id", *META, content_text(F.col("contentModel"), F.col("content")).alias("text")), "extracted").where("text <> ''")
    return search.content_search(build_index(docs, "text", a), docs.select("id", "text"), query, a)


def page_content_search(spark, sf_dir):
    """Bodies extracted from wiki markup and JSON."""
    return _page_content(spark, sf_dir, BODY_PAGES, PLAIN)


def page_content_search_full(spark, sf_dir):
    """The same with everything on."""
    return _page_content(spark, sf_dir, "體溫計 渡口", full(spark))


def _lua_search(spark, sf_dir, a: Analyzer):
    docs = materialize(search.lua_documents(spread(pages(spark, sf_dir))).select("id", *META, "symbols", "text"), "modules")
    found = search.lua_search(docs, LUA, a)
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws("=", m["kind"], m["value"])), "; "))


def lua_search(spark, sf_dir):
    """Modules by their best symbol, with the three best."""
    return _lua_search(spark, sf_dir, PLAIN)


def lua_search_full(spark, sf_dir):
    """The same with everything on."""
    return _lua_search(spark, sf_dir, full(spark))


def data_codes(spark, sf_dir) -> DataFrame:
    """Data pages as code records."""
    rows = titles(spark, sf_dir).where((F.lower("contentModel") == "bson") & F.col("content").isNotNull())
    name = F.trim(F.get_json_object("content", "$.locales['zh-CN'].name"))
    code = F.get_json_object("content", "$.id")
    rows = rows.select(F.col("title").alias("source"), code.alias("code"), name.alias("chineseName"), "content").where("source <> '' and code <> '' and chineseName <> ''")
    values = rule_values(F.col("content"), F.col("source"), parse_rules(DEFAULT_RULES))
    kind = category(F.col("source"))
    out = rows.withColumn("values", values).withColumn("dataType", F.when(kind == "*", "Data").otherwise(kind))
    normal = PLAIN.normalize
    return out.select(
        "source", "code", "chineseName", "dataType", normal(F.col("chineseName")).alias("normalizedName"),
        normal(F.array_join("values", " ")).alias("normalizedSearchText"), F.transform("values", normal).alias("normalizedSearchValues"),
    )


def data_code_search(spark, sf_dir):
    return search.data_code_search(data_codes(spark, sf_dir), "铁锅", PLAIN)


def vocab_df(spark, sf_dir):
    return vocabulary(body_index(spark, sf_dir)[0])


def corpus_statistics(spark, sf_dir):
    return corpus_stats(body_index(spark, sf_dir)[0]).withColumn("avg_len", F.round("avg_len", 6))


def field_lengths(spark, sf_dir):
    return body_index(spark, sf_dir)[0].stats.select("id", F.col("field_len").cast("long").alias("field_len"))


def index_incremental_equals_rebuild(spark, sf_dir):
    """Index of an earlier state of the pages, saved, loaded and brought up to date: per document its terms.

    In the earlier state the pages of one hash class in three are missing, those of another have an older title, and
    pages that are deleted now were live under theirs. All of these are the change set, which so adds, replaces and
    removes; the other live pages are not touched.
    """
    kind = F.pmod(F.xxhash64("id"), F.lit(3))
    now = pages(spark, sf_dir).withColumn("kind", kind).withColumn("gone", F.coalesce(F.col("deleted"), F.lit(False)))
    older = F.when(F.col("kind") == 1, F.concat(F.lit("older "), "title")).otherwise(F.col("title"))
    old = now.where((F.col("kind") != 0) | F.col("gone")).withColumn("title", older).withColumn("deleted", F.lit(False))
    path = fresh_path(spark, "index")
    build_index(old, "title", PLAIN).save(path)
    index = apply_changes(SearchIndex.load(spark, path), now.where((F.col("kind") != 2) | F.col("gone")), "title", PLAIN)
    return index.postings.groupBy("id").agg(F.count("*").alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


QUERIES = {
    f.__name__: f
    for f in (
        title_linear_search, title_linear_namespace, file_search, linear_multi_query, title_ranked_search, title_search_fuzzy, title_combined_search,
        title_search_full, content_search_and, content_search_or_fallback, content_search_namespace, content_search_prefix, page_content_search, page_content_search_full, lua_search, lua_search_full,
        data_code_search, vocab_df, corpus_statistics, field_lengths, index_incremental_equals_rebuild,
    )
}

_CJK = "".join(f"\\x{{{ord(c):x}}}" if ord(c) > 127 else c for c in CJK)
_LIVE = "NOT coalesce(deleted, false)"


def _compact(sql: str) -> str:
    return f"regexp_replace({sql}, '[^0-9a-z{_CJK}]', '', 'g')"



def tokens_sql(source: str) -> str:
    """CTEs up to ``tok`` (id, term), distinct, of a SELECT giving id and text."""
    return f"""src AS ({source}), forms AS (SELECT id, text AS form FROM src UNION ALL SELECT id, lower(text) FROM src),
runs AS (SELECT DISTINCT id, unnest(regexp_extract_all(form, '[A-Za-z0-9._]+')) AS run FROM forms),
camel AS (SELECT id, run, lower(run) AS low, lower(regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')) AS spaced,
  regexp_replace(lower(run), '[^a-z0-9]', '', 'g') AS bare FROM runs),
cjk AS (SELECT id, unnest(regexp_extract_all(lower(text), '[{_CJK}]+')) AS run FROM src),
tok AS (
  SELECT id, low AS term FROM camel WHERE bare <> ''
  UNION SELECT id, term FROM (SELECT id, unnest(string_split_regex(low, '[._]+')) AS term FROM camel) WHERE term <> ''
  UNION SELECT id, term FROM (SELECT id, unnest(string_split_regex(spaced, '[ ._]+')) AS term FROM camel) WHERE term <> ''
  UNION SELECT id, substr(bare, CAST(i AS BIGINT), 3) FROM (SELECT id, bare, unnest(generate_series(1, length(bare) - 2)) AS i FROM camel WHERE length(bare) >= 4)
  UNION SELECT id, substr(run, CAST(i AS BIGINT), 1) FROM (SELECT id, run, unnest(generate_series(1, length(run))) AS i FROM cjk)
  UNION SELECT id, substr(run, CAST(i AS BIGINT), 2) FROM (SELECT id, run, unnest(generate_series(1, length(run) - 1)) AS i FROM cjk WHERE length(run) >= 2)
), lens AS (SELECT src.id, count(tok.term) AS field_len FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id)"""


def _linear_sql(source: str, query: str, where: str = "true", limit: str = "LIMIT 20") -> str:
    q = PLAIN.compact_text(query)
    c = _compact("normalizedTitle")
    return f"""SELECT id, title, namespace, CAST(10000 - (strpos(c, '{q}') - 1) * 10 - length(c) + CASE WHEN c = '{q}' THEN 1000000 WHEN starts_with(c, '{q}') THEN 100000 ELSE 0 END AS DOUBLE) AS score
FROM (SELECT *, {c} AS c FROM {source} WHERE {_LIVE} AND {where}) x WHERE strpos(c, '{q}') > 0 ORDER BY score DESC, id {limit}"""


def _ranked_sql(source: str, meta: str, query: str, boost: str, where: str = "true", fuzzy: bool = False, relax: bool = True, limit: int = 20, extra: str = "", digits: str = "round({}, 6)") -> str:
    terms = list(dict.fromkeys(PLAIN.query_tokens(PLAIN.normalize_text(query))))
    arms = []
    for i, t in enumerate(terms):
        near = f" WHEN abs(length(term) - {len(t)}) <= 1 AND levenshtein(term, '{t}') <= 1 THEN 0.45" if fuzzy and fuzzy_budget(t) else ""
        arms.append(f"SELECT term, {i} AS q, CASE WHEN term = '{t}' THEN 1.0 WHEN starts_with(term, '{t}') THEN CAST(0.375 AS DOUBLE) * {len(t)} / length(term){near} END AS w FROM df")
    need = f"hit = {len(terms)}" + (f" OR (SELECT max(hit) FROM scored) < {len(terms)}" if relax and len(terms) > 1 else "")
    return f"""WITH {tokens_sql(source)}, meta AS ({meta}), df AS (SELECT term, count(*) AS df FROM tok GROUP BY term),
size AS (SELECT count(*) AS n, avg(field_len) AS al FROM lens),
wts AS (SELECT term, q, CAST(w AS DOUBLE) AS w FROM ({' UNION ALL '.join(arms)}) WHERE w IS NOT NULL),
gain AS (SELECT tok.id, sum(ln(1 + (size.n - df.df + 0.5) / (df.df + 0.5)) * wts.w) AS g, count(DISTINCT wts.q) AS hit FROM tok JOIN wts USING (term) JOIN df USING (term), size GROUP BY tok.id),
scored AS (SELECT meta.*, gain.hit, gain.g * (2.2 / (1 + 1.2 * (1 - 0.7 + 0.7 * lens.field_len / size.al)) + 0.5) AS base FROM gain JOIN lens ON lens.id = gain.id JOIN meta ON meta.id = gain.id, size WHERE {where}),
top AS (SELECT *, {digits.format(f'base * {boost}')} AS score FROM scored WHERE {need} ORDER BY score DESC, id LIMIT {limit})
SELECT id, title, namespace, score{extra} FROM top"""


_T_SRC, _T_META = f"SELECT id, title AS text FROM pages WHERE {_LIVE}", f"SELECT id, title, namespace FROM pages WHERE {_LIVE}"
_D_SRC = "SELECT doc_id AS id, text FROM documents"
_D_META = "SELECT doc_id AS id, source AS title, lang AS namespace, text FROM documents"


def _title_boost(query: str) -> str:
    q, c = PLAIN.compact_text(query), _compact("lower(title)")
    return f"CASE WHEN {c} = '{q}' THEN 100.0 WHEN starts_with({c}, '{q}') THEN 10.0 WHEN strpos({c}, '{q}') > 0 THEN 3.0 ELSE 1.0 END"


def _body_boost(query: str) -> str:
    return f"CASE WHEN strpos({_compact('title')}, '{PLAIN.compact_text(query)}') > 0 THEN 3.0 ELSE 1.0 END"


def _snippet_sql(query: str) -> str:
    q, flat = PLAIN.normalize_text(query), "trim(regexp_replace(coalesce(text, ''), '[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'))"
    found = f"CASE WHEN strpos({flat}, '{q}') > 0 THEN strpos({flat}, '{q}') ELSE strpos(lower({flat}), '{q}') END"
    shown = f"CASE WHEN {found} > 0 THEN {flat} ELSE lower({flat}) END"
    at, width = f"greatest({found} - 1, 0)", f"CASE WHEN {found} > 0 THEN {len(q)} ELSE 0 END"
    start, end = f"greatest({at} - 36, 0)", f"least(length({shown}), {at} + {width} + 64)"
    return f", CASE WHEN {start} > 0 THEN '…' ELSE '' END || substr({shown}, CAST({start} AS BIGINT) + 1, CAST({end} - ({start}) AS BIGINT)) || CASE WHEN {end} < length({shown}) THEN '…' ELSE '' END AS snippet"


_COMBINED_SQL = f"""SELECT id, max(title) AS title, max(namespace) AS namespace, max(score) AS score FROM (
  SELECT * FROM ({_ranked_sql(_T_SRC, _T_META, COMBINED, _title_boost(COMBINED), fuzzy=True)}) UNION ALL SELECT * FROM ({_linear_sql('pages', COMBINED)}))
GROUP BY id ORDER BY score DESC, id LIMIT 20"""

_MANY_SQL = "SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{q}' AS query, id, score FROM ({_linear_sql('pages', q, limit='')})" for q in MANY if q
) + ")) WHERE rank <= 20"

_DATA_SQL = f"""WITH d AS (SELECT title AS source, content ->> '$.id' AS code, trim(content ->> '$.locales.zh-CN.name') AS chineseName,
  coalesce(nullif(regexp_extract(title, '^Data:([^/]+)', 1), ''), 'Data') AS dataType,
  trim(coalesce(content ->> '$.wiki.locales.zh-CN.name', '')) AS wiki FROM pages WHERE {_LIVE} AND lower(contentModel) = 'bson' AND json_valid(content)),
v AS (SELECT source, code, chineseName, dataType, unnest([chineseName, wiki]) AS val FROM d WHERE source <> '' AND code <> '' AND chineseName <> ''),
c AS (SELECT *, {_compact('lower(val)')} AS c, lower(code) AS lc FROM v),
s AS (SELECT source, code, chineseName, dataType, max(CASE WHEN strpos(c, '铁锅') > 0 THEN 10000 - (strpos(c, '铁锅') - 1) * 10 - length(c) + CASE WHEN c = '铁锅' THEN 1000000 WHEN starts_with(c, '铁锅') THEN 100000 ELSE 0 END ELSE 0 END) AS f,
  max(CASE WHEN strpos(lc, '铁锅') > 0 THEN 5000 - (strpos(lc, '铁锅') - 1) * 10 - length(lc) ELSE NULL END) AS k FROM c GROUP BY ALL)
SELECT source, code, chineseName, dataType, CAST(greatest(f, coalesce(k, f)) AS DOUBLE) AS score FROM s WHERE f > 0 OR k IS NOT NULL ORDER BY score DESC, code COLLATE NOCASE, source LIMIT 20"""



def page_content_sql(texts: str) -> str:
    """Over ``texts``, a SELECT of id and text of extracted bodies."""
    eligible = f"SELECT id FROM pages WHERE {_LIVE} AND NOT coalesce(isRedirect, false) AND content IS NOT NULL"
    source = f"SELECT id, text FROM ({texts}) WHERE text <> '' AND id IN ({eligible})"
    meta = f"SELECT p.id, p.title, p.namespace, p.normalizedTitle, s.text FROM pages p JOIN ({source}) s ON s.id = p.id"
    boost = f"CASE WHEN strpos(coalesce({_compact('normalizedTitle')}, ''), '{PLAIN.compact_text(BODY_PAGES)}') > 0 THEN 3.0 ELSE 1.0 END"
    return _ranked_sql(source, meta, BODY_PAGES, boost, extra=_snippet_sql(BODY_PAGES))


def lua_search_sql(symbols: str) -> str:
    """Over ``symbols``, a SELECT of id, kind, value, priority and place."""
    q, c, terms = PLAIN.normalize_text(LUA), PLAIN.compact_text(LUA), list(dict.fromkeys(PLAIN.query_tokens(PLAIN.normalize_text(LUA))))
    modules = f"SELECT s.id, string_agg(value, ' ') AS text FROM ({symbols}) s JOIN pages p ON p.id = s.id WHERE NOT coalesce(p.isRedirect, false) GROUP BY s.id"
    hits = _ranked_sql(modules, f"SELECT id, title, namespace FROM pages WHERE {_LIVE}", LUA, "1.0", limit=1_000_000_000, digits="{}")
    listed = ", ".join(f"'{t}'" for t in terms)
    overlap = f"WITH {tokens_sql('SELECT DISTINCT value AS id, value AS text FROM sym')} SELECT id AS v, count(*) FILTER (term IN ({listed})) AS n FROM tok GROUP BY id"
    flat = "trim(regexp_replace(lower(value), '\\s+', ' ', 'g'))"
    return f"""WITH sym AS MATERIALIZED (SELECT * FROM ({symbols})), hits AS ({hits}), shared AS ({overlap}),
forms AS (SELECT sym.*, {flat} AS flat, {_compact(flat)} AS tight, coalesce(shared.n, 0) AS n FROM sym JOIN hits ON hits.id = sym.id LEFT JOIN shared ON shared.v = sym.value),
rel AS (SELECT *, CASE WHEN flat = '{q}' OR tight = '{c}' THEN 100.0 WHEN starts_with(flat, '{q}') OR starts_with(tight, '{c}') THEN 60.0 WHEN strpos(flat, '{q}') > 0 OR strpos(tight, '{c}') > 0 THEN 40.0 ELSE CAST(n AS DOUBLE) / {len(terms)} * 20 END AS r FROM forms),
best AS (SELECT id, kind, value, CAST(r AS DOUBLE) + priority AS rank, row_number() OVER (PARTITION BY id ORDER BY CAST(r AS DOUBLE) + priority DESC, length(value), place) AS rn FROM rel WHERE r > 0),
three AS (SELECT id, max(rank) AS match_rank, string_agg(kind || '=' || value, '; ' ORDER BY rn) AS matches FROM best WHERE rn <= 3 GROUP BY id)
SELECT hits.id, hits.title, round(hits.score * CASE WHEN strpos({_compact('lower(hits.title)')}, '{c}') > 0 THEN 3.0 ELSE 1.0 END * (1 + coalesce(match_rank, 0) / 100), 6) AS score, coalesce(match_rank, 0.0) AS match_rank, matches
FROM hits LEFT JOIN three ON three.id = hits.id ORDER BY match_rank DESC, score DESC, hits.id LIMIT 20"""


ORACLES = {
    "title_linear_search": _linear_sql("pages", "背包"),
    "title_linear_namespace": _linear_sql("pages", "Lantern", "namespace = 828"),
    "file_search": _linear_sql("file_resources", "Torch"),
    "linear_multi_query": _MANY_SQL,
    "title_ranked_search": _ranked_sql(_T_SRC, _T_META, TITLE, _title_boost(TITLE), fuzzy=True),
    "title_search_fuzzy": _ranked_sql(_T_SRC, _T_META, FUZZY, _title_boost(FUZZY), fuzzy=True),
    "title_combined_search": _COMBINED_SQL,
    "content_search_and": _ranked_sql(_D_SRC, _D_META, BODY_AND, _body_boost(BODY_AND), extra=_snippet_sql(BODY_AND)),
    "content_search_or_fallback": _ranked_sql(_D_SRC, _D_META, BODY_OR, _body_boost(BODY_OR)),
    "content_search_namespace": _ranked_sql(_D_SRC, _D_META, BODY_AND, _body_boost(BODY_AND), where="meta.namespace = 'en'"),
    "content_search_prefix": _ranked_sql(_D_SRC, _D_META, BODY_PREFIX, _body_boost(BODY_PREFIX)),
    "data_code_search": _DATA_SQL,
    "vocab_df": f"WITH {tokens_sql(_D_SRC)} SELECT term, count(*) AS df FROM tok GROUP BY term",
    "corpus_statistics": f"WITH {tokens_sql(_D_SRC)} SELECT count(*) AS docs, round(avg(field_len), 6) AS avg_len, CAST(sum(field_len) AS BIGINT) AS postings FROM lens",
    "field_lengths": f"WITH {tokens_sql(_D_SRC)} SELECT id, field_len FROM lens",
    "index_incremental_equals_rebuild": f"WITH {tokens_sql(_T_SRC)} SELECT id, count(*) AS terms, min(term) AS first_term, max(term) AS last_term FROM tok GROUP BY id",
}
