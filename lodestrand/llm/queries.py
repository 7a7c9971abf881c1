"""Queries of problems 2, 4, 7, 8 and 9, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import confusables, mixing, neardup, toxicity
from lodestrand.llm import tokenize as tokenizer
from lodestrand.llm.oracle import ORACLES, late_oracles  # noqa: F401
from lodestrand.sources.work import table

BODY = {"threshold": 0.7, "width": 5, "least": 200}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose titles, or normalised titles, look the same but differ."""
    return confusables.look_alike_pairs(table(spark, sf_dir, "pages"), "id", ["title", "normalizedTitle"])


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and normalised title."""
    return confusables.look_alike_classes(table(spark, sf_dir, "pages"), "id", ["title", "normalizedTitle"])


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts and the number of classes that look the same, for every title and normalised title."""
    return confusables.look_alike_links(table(spark, sf_dir, "pages"), "id", ["title", "normalizedTitle"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages with nearly the same body."""
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "pages"), "id", "content", **BODY)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal bodies and its links for every page with a long enough body."""
    return neardup.near_duplicate_classes(table(spark, sf_dir, "pages"), "id", "content", **BODY)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals per source."""
    counted = tokenizer.count_tokens(table(spark, sf_dir, "documents"), ["source"], "text")
    return counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text as it comes back from its ids."""
    ids = tokenizer.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tokenizer.decode_corpus(ids, "doc_id").select("doc_id", F.md5("text").alias("digest"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the sources of mix_targets."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    return mixing.mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source that has a text is at its share, to within its largest document, and within its repeats."""
    rows = p8_shares(spark, sf_dir).where("available_tokens > 0")
    whole = rows.agg(F.sum("used_tokens").alias("whole"), F.sum("target_share").alias("shares"), F.max("largest").alias("widest"), F.count("*").alias("n"))  # one row
    off = F.abs(F.col("used_tokens") - F.col("whole") * F.col("target_share") / F.col("shares"))
    near = off <= F.col("largest") + F.col("target_share") / F.col("shares") * F.col("widest") * F.col("n")
    return rows.crossJoin(F.broadcast(whole)).select("source", near.alias("at_share"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p8_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture of a stated size, ten million tokens at scale 1, for which the scarcest sources are used up to their repeats."""
    documents = table(spark, sf_dir, "documents")
    return mixing.mixture_report(documents, table(spark, sf_dir, "mix_targets"), total=100.0 * documents.count())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return toxicity.harmful_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.harm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))[0]


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate per source."""
    return toxicity.harmful_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p2_classes": p2_classes,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p7_ids": p7_ids,
    "p7_counts": p7_counts,
    "p7_decoded": p7_decoded,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_bounds": p8_bounds,
    "p8_total": p8_total,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
