"""Ranked and linear search.

A query string is small and analysed on the driver; everything after it is one Spark plan. A ranked search is:
words of the vocabulary that equal, extend or nearly equal a query term, their postings, one aggregation per
document, the statistics of the documents hit, top-k. Whether all terms are required, or any of them because no
document has all, is decided inside the plan, not by a second query.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.lua import lua_symbols, searchable_text, typed_symbols
from lodestrand.functions.text import Analyzer, compact_normalized, fuzzy_budget, snippet
from lodestrand.operators.index import SearchIndex, build_index, vocabulary

# our choice, after Lv and Zhai, Lower-Bounding Term Frequency Normalization (CIKM 2011)
K, B, DELTA = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
TERMS_A_MASK = 62
DIGITS = 6
NEAR_WORDS = 1_000  # looked up by name; more are found by reading


def live(rows: DataFrame) -> DataFrame:
    """rows that are not deleted; null means not deleted."""
    return rows.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def in_namespace(rows: DataFrame, namespace) -> DataFrame:
    """rows of one namespace, all without one."""
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


def match_score(text: Column, query: str, base: int = 10_000, exact: int = 1_000_000, prefix: int = 100_000) -> Column:
    """M1: score of a substring match, null without one."""
    at = F.instr(text, query) - 1
    bonus = F.when(text == query, exact).when(at == 0, prefix).otherwise(0)
    return F.when(at >= 0, F.lit(base) - at * 10 - F.length(text) + bonus)


def linear_search(rows: DataFrame, query: str, analyzer: Analyzer, namespace=None, limit: int | None = 20) -> DataFrame:
    """Q1, Q7: titles whose compact form contains the query's: id, title, namespace, score, best first, ties by id.

    An empty query finds nothing. Null titles never match. ``normalizedTitle`` is used as stored.
    """
    compact = analyzer.compact_text(query)
    found = in_namespace(live(rows), namespace).select(
        "id", "title", "namespace", match_score(compact_normalized(F.col("normalizedTitle")), compact).cast("double").alias("score")
    )
    found = found.where(F.col("score").isNotNull() if compact else F.lit(False))
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def linear_search_many(rows: DataFrame, queries: Sequence[str], analyzer: Analyzer, limit: int = 20) -> DataFrame:
    """The same for several stated queries at once: query, id, score, rank within the query."""
    compact = {q: c for q in dict.fromkeys(queries) if (c := analyzer.compact_text(q))}
    rows = live(rows).withColumn("compact", compact_normalized(F.col("normalizedTitle")))
    scored = F.array(*[F.struct(F.lit(q).alias("query"), match_score(F.col("compact"), c).cast("double").alias("score")) for q, c in compact.items()])
    hits = rows.select("id", F.explode(F.filter(scored, lambda x: x["score"].isNotNull())).alias("x")).select("x.query", "id", "x.score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def _joined(op: Callable[[Column, Column], Column], parts: Sequence[Column]) -> Column:
    """``parts`` joined by ``op`` pairwise, so that an expression over many terms stays flat enough to be analysed."""
    half = len(parts) // 2
    return op(_joined(op, parts[:half]), _joined(op, parts[half:])) if half else parts[0]


def _term_weights(terms: Sequence[str], fuzzy: bool) -> list[tuple[Column, Column]]:
    """Per query term, whether a vocabulary term matches it and with what weight."""
    out = []
    for t in terms:
        near = F.lit(False)
        if fuzzy and fuzzy_budget(t):
            close = F.length("term").between(len(t) - 1, len(t) + 1)
            near = close & F.levenshtein(F.col("term"), F.lit(t), 1).between(0, 1)
        starts = F.col("term").startswith(t)
        weight = (
            F.when(F.col("term") == t, 1.0)
            .when(starts, F.lit(PREFIX_WEIGHT) * len(t) / F.length("term"))
            .otherwise(F.lit(FUZZY_WEIGHT))
        )
        out.append((starts | near, weight))
    return out


def _posting_filter(index: SearchIndex, terms: Sequence[str], weights: list[tuple[Column, Column]]) -> Column:
    """Which postings can matter to a search that allows an edit: those of the prefixes, and of the words that nearly equal a
    term. With a kept vocabulary these words are looked up first, so that the scan can skip all others; they are few, and
    where they are not, every posting is looked at."""
    starts = _joined(operator.or_, [F.col("term").startswith(t) for t in terms])
    near = _joined(operator.or_, [m for m, _ in weights])
    if index.words is None:
        return near
    found = [r.term for r in index.words.where(near & ~starts).select("term").limit(NEAR_WORDS + 1).collect()]  # at most so many rows
    if len(found) > NEAR_WORDS:
        return near
    return _joined(operator.or_, [starts, *[F.col("term") == w for w in found]]) if len(found) <= 8 else starts | F.col("term").isin(found)


def ranked_hits(index: SearchIndex, terms: Sequence[str], namespace=None, fuzzy: bool = False, relax: bool = True) -> DataFrame:
    """Stats columns and base ``score`` of the documents with all ``terms``, or with any if none has all and ``relax``."""
    terms = list(dict.fromkeys(terms))
    stats = in_namespace(index.stats, namespace)
    if not terms:
        return stats.withColumn("score", F.lit(0.0)).where(F.lit(False))
    weights = _term_weights(terms, fuzzy)
    is_hit = _joined(operator.or_, [m for m, _ in weights])
    words = vocabulary(index).where(is_hit)
    postings = index.postings.where(_posting_filter(index, terms, weights) if fuzzy else is_hit)
    size, columns = None, ["n_docs", "avg_len"]
    if index.totals is None:
        size = F.broadcast(index.stats.agg(F.count("*").alias("n_docs"), F.avg("field_len").alias("avg_len")))  # one row
    docs, of_all = index.totals or (0, 0)
    sized = lambda df: df.crossJoin(size) if size is not None else df.withColumns({"n_docs": F.lit(docs), "avg_len": F.lit(of_all / docs if docs else None).cast("double")})
    df = sized(words)
    weight = _joined(operator.add, [F.when(m, w).otherwise(0.0) for m, w in weights])
    # which terms a document has, as many masks as they need
    masks = {}
    for at in range(0, len(weights), TERMS_A_MASK):
        parts = [F.when(m, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (m, _) in enumerate(weights[at : at + TERMS_A_MASK])]
        masks[f"bits{len(masks)}"] = _joined(Column.bitwiseOR, parts)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms_hit = df.select("term", (idf * weight).alias("gain"), *[bits.alias(n) for n, bits in masks.items()])
    hits = postings.join(terms_hit, "term").groupBy("id").agg(F.sum("gain").alias("gain"), *[F.bit_or(n).alias(n) for n in masks])
    length = (K + 1) / (1 + F.lit(K) * (1 - B + F.lit(B) * F.col("field_len") / F.col("avg_len"))) + DELTA
    hits = sized(hits.join(stats, "id")).withColumn("score", F.col("gain") * length).withColumn("hit", _joined(operator.add, [F.bit_count(n) for n in masks]))
    if not relax or len(terms) == 1:
        return hits.where(F.col("hit") == len(terms)).drop("gain", *masks, "hit", *columns)
    most = hits.agg(F.max("hit").alias("most"))  # one row
    return hits.crossJoin(F.broadcast(most)).where((F.col("hit") == len(terms)) | (F.col("most") < len(terms))).drop("gain", *masks, "hit", *columns, "most")


def _top(hits: DataFrame, score: Column, limit: int | None, *extra: str) -> DataFrame:
    out = hits.select("id", "title", "namespace", F.round(score, DIGITS).alias("score"), *extra)
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def title_search(index: SearchIndex, query: str, analyzer: Analyzer, namespace=None, limit: int | None = 20) -> DataFrame:
    """Q2: ranked titles, with prefixes and one edit; a pure query of at most two CJK characters is never relaxed."""
    normalized = analyzer.normalize_text(query)
    compact = analyzer.compact_text(query)
    short = 0 < len(compact) <= 2 and not compact.isascii() and all(not c.isascii() for c in compact)
    hits = ranked_hits(index, analyzer.query_tokens(normalized), namespace, fuzzy=True, relax=not short)
    title = analyzer.compact(F.col("title"))
    boost = F.when(title == compact, 100.0).when(title.startswith(compact), 10.0).when(title.contains(compact), 3.0).otherwise(1.0)
    return _top(hits, F.col("score") * boost, limit)


def combined_search(primary: DataFrame, fallback: DataFrame, limit: int = 20) -> DataFrame:
    """Two result lists, each already cut, merged by best score."""
    both = primary.select("id", "title", "namespace", "score").unionByName(fallback.select("id", "title", "namespace", "score"))
    best = both.groupBy("id").agg(F.max(F.struct("score", "title", "namespace")).alias("r")).select("id", "r.title", "r.namespace", "r.score")
    return best.orderBy(F.desc("score"), "id").limit(limit)


def content_search(index: SearchIndex, texts: DataFrame, query: str, analyzer: Analyzer, namespace=None, limit: int = 20) -> DataFrame:
    """Q4: ranked bodies with prefixes; titles holding the query count three times. ``texts`` (id, text) is joined
    to the ``limit`` rows that are left, only then are snippets cut."""
    normalized, compact = analyzer.normalize_text(query), analyzer.compact_text(query)
    hits = ranked_hits(index, analyzer.query_tokens(normalized), namespace)
    boost = F.when(F.coalesce(compact_normalized(F.col("normalizedTitle")).contains(compact), F.lit(False)), 3.0).otherwise(1.0)
    top = _top(hits, F.col("score") * boost, limit)
    cut = snippet(F.col("text"), normalized, analyzer).alias("snippet")
    return texts.join(F.broadcast(top), "id").select("id", "title", "namespace", "score", cut)  # top has at most limit rows


def lua_documents(pages: DataFrame) -> DataFrame:
    """Live code modules with their symbols and the text that is indexed."""
    chosen = live(pages).where(~F.coalesce(F.col("isRedirect"), F.lit(False)) & (F.lower("contentModel") == "scribunto") & F.col("content").isNotNull())
    found = chosen.withColumn("symbols", lua_symbols(F.col("content")))
    return found.withColumn("text", searchable_text(F.col("symbols"))).where("text <> ''")


def symbol_rank(value: Column, priority: Column, query: str, terms: Sequence[str], analyzer: Analyzer) -> Column:
    """M5: relevance of one symbol plus its priority; null if it has nothing of the query."""
    normalized, compact_query = analyzer.normalize(value), analyzer.compact_text(query)
    compact = compact_normalized(normalized)
    overlap = F.size(F.array_intersect(analyzer.document_tokens(value), F.array(*[F.lit(t) for t in terms])))
    relevance = (
        F.when((normalized == query) | (compact == compact_query), 100.0)
        .when(normalized.startswith(query) | compact.startswith(compact_query), 60.0)
        .when(normalized.contains(query) | compact.contains(compact_query), 40.0)
        .otherwise(overlap / F.lit(float(len(terms))) * 20)
    )
    return F.when(relevance > 0, relevance + priority)


def lua_search(docs: DataFrame, query: str, analyzer: Analyzer, limit: int = 20, shown: int = 3, index: SearchIndex | None = None) -> DataFrame:
    """Q5: modules by their best symbol, then score: id, title, score, match_rank and the ``shown`` best symbols.

    ``docs`` comes from ``lua_documents``, ``index`` is one of their texts, made here if there is none. Symbols are ranked only for the documents that the index finds.
    """
    normalized = analyzer.normalize_text(query)
    terms = analyzer.query_tokens(normalized)
    hits = ranked_hits(index or build_index(docs, "text", analyzer), terms).select("id", "score")
    if not terms:
        return hits.select("id", F.lit("").alias("title"), "score", F.lit(0.0).alias("match_rank"), F.array().cast("array<struct<kind:string,value:string>>").alias("matches"))
    symbols = docs.join(hits, "id").select("id", F.posexplode(typed_symbols(F.col("symbols"))).alias("pos", "s")).select("id", "pos", "s.*")
    ranked = symbols.withColumn("rank", symbol_rank(F.col("value"), F.col("priority"), normalized, terms, analyzer)).where("rank is not null")
    order = Window.partitionBy("id").orderBy(F.desc("rank"), F.length("value"), "pos")
    best = (
        ranked.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= shown)
        .groupBy("id")
        .agg(F.max("rank").alias("match_rank"), F.transform(F.array_sort(F.collect_list(F.struct("n", "kind", "value"))), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("matches"))
    )
    boost = F.when(analyzer.compact(F.col("title")).contains(analyzer.compact_text(query)), 3.0).otherwise(1.0)
    rank = F.coalesce("match_rank", F.lit(0.0))
    return (
        hits.join(docs.select("id", "title"), "id")
        .join(best, "id", "left")
        .select("id", "title", F.round(F.col("score") * boost * (1 + rank / 100), DIGITS).alias("score"), rank.alias("match_rank"), "matches")
        .orderBy(F.desc("match_rank"), F.desc("score"), "id")
        .limit(limit)
    )


def data_code_search(records: DataFrame, query: str, analyzer: Analyzer, limit: int = 20) -> DataFrame:
    """Q6: data codes by their best field or by code: source, code, chineseName, dataType, score.

    ``records`` has source, code, chineseName, dataType, normalizedName and optionally normalizedSearchText and
    normalizedSearchValues. Field scores of 0 or less are no match. Order is score, then code in Unicode collation.
    """
    normalized, compact = analyzer.normalize_text(query), analyzer.compact_text(query)
    text = F.coalesce("normalizedSearchText", "normalizedName")
    values = F.transform(F.coalesce("normalizedSearchValues", F.array(text)), compact_normalized)
    best = F.greatest(F.coalesce(F.array_max(F.transform(values, lambda v: match_score(v, compact))), F.lit(0)), F.lit(0))
    code = F.lower(analyzer.fold(F.col("code")))
    by_code = match_score(code, normalized, 5_000, 500_000, 50_000)
    rows = records.withColumn("field", best).withColumn("by_code", by_code).where((F.col("field") > 0) | F.col("by_code").isNotNull())
    score = F.greatest(F.col("field"), F.coalesce("by_code", F.col("field"))).cast("double")
    out = rows.select("source", "code", "chineseName", "dataType", score.alias("score")).where(F.lit(bool(compact)))
    return out.orderBy(F.desc("score"), F.collate("code", "UNICODE"), "source").limit(limit)
