"""Inverted index as tables: postings and document statistics.

``postings`` has one row per document and distinct term (a token set, so the term frequency is 1), ``stats`` one
row per document. Saved as Parquet, postings are sorted by term, so that looking up a term or prefix reads only
the row groups whose range holds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import Analyzer
from lodestrand.sources.work import materialize

META = ("title", "normalizedTitle", "namespace", "namespaceName")


@dataclass
class SearchIndex:
    """postings (term, id) and stats (id, field_len, title, normalizedTitle, namespace, namespaceName); where they are kept,
    words (term, df) and (documents, terms of all of them)."""

    postings: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    totals: tuple[int, int] | None = None

    def save(self, path: str, partitions: int | None = None) -> None:
        """Write the tables below ``path``, the vocabulary and the totals with them."""
        spark = self.postings.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        saved = SearchIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))
        by_term(vocabulary(saved)).write.mode("overwrite").parquet(f"{path}/words")
        size = saved.stats.agg(F.count("*").alias("docs"), F.coalesce(F.sum("field_len"), F.lit(0)).cast("bigint").alias("terms"))
        size.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchIndex:
        """Read what ``save`` wrote."""
        postings, stats, words, totals = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "stats", "words", "totals"))
        return SearchIndex(postings, stats, words, tuple(totals.first()))


def by_term(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in ranges of terms, sorted: a lookup then reads the row groups of its terms only."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "term").sortWithinPartitions("term")


def tokenised(docs: DataFrame, text: str, analyzer: Analyzer) -> DataFrame:
    """``docs`` (id and META columns, missing ones as null) with ``tokens`` of column ``text``."""
    have = set(docs.columns)
    meta = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in META]
    return docs.select("id", *meta, analyzer.document_tokens(F.col(text)).alias("tokens"))


def build_index(docs: DataFrame, text: str, analyzer: Analyzer, stored: bool = True) -> SearchIndex:
    """Index of ``docs``, one row per id; null texts give documents without terms.

    The token sets are written to the shared folder once (``stored``), since every search reads them more than
    once; for an index that is used again, ``save`` sorts the postings by term.
    """
    tokens = tokenised(docs, text, analyzer)
    if stored:
        tokens = materialize(tokens, "tokens")
    return SearchIndex(
        # explode_outer: explode would repeat the tokenisation in the filters inferred for it
        tokens.select(F.explode_outer("tokens").alias("term"), "id").where(F.col("term").isNotNull()),
        tokens.select("id", F.size("tokens").alias("field_len"), *META),
    )


def apply_changes(index: SearchIndex, changed: DataFrame, text: str, analyzer: Analyzer) -> SearchIndex:
    """Rows of ``changed`` replace those of their ids; rows with ``deleted`` true only remove.

    Only the last state of an id counts, so ``changed`` has one row per id. Ids that were not indexed are added.
    """
    ids = changed.select("id")
    fresh = build_index(changed.where(~F.coalesce(F.col("deleted"), F.lit(False))), text, analyzer)
    return SearchIndex(
        index.postings.join(ids, "id", "left_anti").select("term", "id").unionByName(fresh.postings),
        index.stats.join(ids, "id", "left_anti").select("id", "field_len", *META).unionByName(fresh.stats),
    )


def vocabulary(index: SearchIndex) -> DataFrame:
    """Document frequency of every term."""
    if index.words is not None:
        return index.words
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(index: SearchIndex) -> DataFrame:
    """One row: documents, average field length, postings."""
    return index.stats.agg(
        F.count("*").alias("docs"), F.avg("field_len").alias("avg_len"), F.coalesce(F.sum("field_len"), F.lit(0)).alias("postings")
    )


# segments: an index that is added to is a list of parts, each with its own postings, documents and words


def superseded(docs: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """(seq) of the states of documents that have a later one: as many as were replaced since they were last merged away.

    ``newer`` are the parts that can hold later states, all but the first, in which every document has one state.
    """
    slim = docs.select("id", "seq")
    top = (slim if newer is None else newer).groupBy("id").agg(F.max("seq").alias("top"))
    return slim.join(top, "id").where(F.col("seq") < F.col("top")).select("seq")


def live_documents(docs: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """The last state of every document (id, seq, removed and others) that is not removed."""
    return docs.join(superseded(docs, newer), "seq", "left_anti").where(~F.col("removed")).drop("removed")


def live_postings(postings: DataFrame, docs: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """(term, id) without those of states that were replaced; a filter by term still reaches the scan."""
    return postings.join(superseded(docs, newer), "seq", "left_anti").select("term", "id")


def merge_from(sizes: Sequence[int]) -> int:
    """How many parts stay, given the rows of all, so that each is more than twice as large as all after it together: a row is
    then written anew only as often as the logarithm of what there is."""
    keep, tail = len(sizes), 0
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i] <= 2 * tail:
            keep = i
        tail += sizes[i]
    return keep if keep < len(sizes) - 1 or len(sizes) < 2 else len(sizes)
