"""Texts that look the same but differ in their characters (problem 2).

Method: confusables skeleton. A text is decomposed, every character replaced by its prototype from the
look-alike table, and decomposed again; texts of equal skeleton look the same. The table is read from the
confusables data of the ICU library that Spark itself ships, by asking it for the skeleton of every assigned
character once (about 140,000 characters, seven calls, under a second), then narrowed by the project's
rules: letter case, accents, simplified against traditional characters, a digit in place of a letter and
raised or circled digits are a different look; width of letters and blanks, invisible characters and
blanks at the ends are not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.work import materialize

_MARK = "\x02"
_tables: dict[str, tuple[dict, dict]] = {}  # by ICU's version


def _is_unified_han(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith("CJK UNIFIED IDEOGRAPH")


def _keeps_look(ch: str, prototype: str) -> bool:
    """Whether the project counts ``ch`` and its ICU prototype as one look."""
    kind = unicodedata.category(ch)
    if kind in ("Nd", "No"):  # digits stay digits, raised and circled ones themselves
        return False
    if kind.startswith("L") and any(unicodedata.category(p) in ("Nd", "No") for p in prototype):
        return False
    if kind == "Mn" and prototype:  # accents count
        return False
    return not (_is_unified_han(ch) and all(_is_unified_han(p) for p in prototype) and prototype)


def fold_table() -> dict[int, str]:
    """Width and blanks: every wide or narrow form and every kind of blank, by Unicode's own decompositions."""
    table: dict[int, str] = {}
    for cp in range(0x110000):
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            table[cp] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.category(ch) == "Zs" or ch.isspace():
            table[cp] = " "
        elif unicodedata.category(ch) == "Nd" and unicodedata.decomposition(ch).startswith("<font>"):
            table[cp] = unicodedata.normalize("NFKC", ch)
    table.pop(0x20)
    return table


def look_alike_table(spark: SparkSession) -> dict[int, str]:
    """Prototype of every character that has one, invisible characters mapping to nothing."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    chars = [
        chr(cp)
        for cp in range(0x110000)
        if not 0xAC00 <= cp <= 0xD7A3 and unicodedata.category(chr(cp)) not in ("Cc", "Cn", "Co", "Cs")
    ]
    table: dict[int, str] = {}
    for at in range(0, len(chars), 20_000):
        part = chars[at : at + 20_000]
        for ch, prototype in zip(part, checker.getSkeleton(_MARK.join(part)).split(_MARK), strict=True):
            if prototype != unicodedata.normalize("NFD", ch) and _keeps_look(ch, prototype):
                table[ord(ch)] = prototype
    return table


def tables(spark: SparkSession) -> tuple[dict[int, str], dict[int, str]]:
    """(width and blank folding, look-alike prototypes); built once per driver, some ten thousand entries."""
    key = spark.sparkContext._jvm.com.ibm.icu.util.VersionInfo.ICU_VERSION.toString()
    if key not in _tables:
        _tables[key] = fold_table(), look_alike_table(spark)
    return _tables[key]


def skeleton_of(text: str, fold: dict[int, str], alike: dict[int, str]) -> str:
    """The one form that all texts looking like ``text`` share."""
    text = unicodedata.normalize("NFD", text.translate(fold))
    return unicodedata.normalize("NFD", text.translate(alike)).strip(" ")


def with_skeleton(df: DataFrame, column: str, name: str = "skeleton") -> DataFrame:
    """``df`` with the consistent form of string ``column``; null stays null, empty stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(tables(df.sparkSession))

    @F.pandas_udf("string")
    def skeleton(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fold, alike = shared.value
        for texts in batches:
            yield texts.map(lambda t: None if t is None else skeleton_of(t, fold, alike))

    return df.withColumn(name, skeleton(F.col(column)))


def _texts(rows: DataFrame, id_column: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, kind, text) of every text that is compared, and (kind, text, skeleton) of the distinct ones; kind numbers ``columns``."""
    long = rows.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("x"),
    )
    long = long.select("id", "x.kind", "x.text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return long, with_skeleton(long.select("kind", "text").distinct(), "text").where("skeleton <> ''")


def look_alike_pairs(rows: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows with look-alike but different texts in one of ``columns``, each pair once.

    Null and empty texts, and texts of nothing but invisible characters, are not compared; equal texts are
    no pair. The skeleton is computed once per distinct text, after map-side combining, so copies cost one row; different
    texts are paired first and the rows that hold them attached to these pairs, so that no row ever meets another of the same
    text. Rows that share an id are never a pair of themselves; an empty table gives an empty result.
    """
    long, texts = _texts(rows, id_column, columns)
    ambiguous = (
        texts.groupBy("kind", "skeleton")
        .agg(F.min("text").alias("a"), F.max("text").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("kind", "skeleton")
    )
    # few rows: the different texts of the classes that have more than one
    classes = materialize(texts.join(ambiguous, ["kind", "skeleton"], "left_semi"), "look-alike")
    a, b = (classes.select("kind", "skeleton", F.col("text").alias(f"text_{s}")) for s in "ab")
    pairs = a.join(b, ["kind", "skeleton"]).where(F.col("text_a") < F.col("text_b")).select("kind", "text_a", "text_b")
    holders = materialize(long.join(classes.select("kind", "text"), ["kind", "text"], "left_semi"), "holders")
    ha, hb = (holders.select(F.col("id").alias(f"id_{s}"), "kind", F.col("text").alias(f"text_{s}")) for s in "ab")
    return (
        pairs.join(ha, ["kind", "text_a"])
        .join(hb, ["kind", "text_b"])
        .where(F.col("id_a") != F.col("id_b"))
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .distinct()
    )


def look_alike_links(rows: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, column, class_id, links): per row and column the class of equal texts it is in, named by its lowest id, and the
    number of other classes that look the same.

    The form for large tables: it grows with the rows, not with their pairs. Texts that are not compared have no class and
    no row here.
    """
    long, texts = _texts(rows, id_column, columns)
    looks = texts.groupBy("kind", "skeleton").agg((F.count("*") - 1).alias("links")).where("links > 0")
    first = long.groupBy("kind", "text").agg(F.min("id").alias("class_id"))
    known = texts.join(looks, ["kind", "skeleton"], "left").join(first, ["kind", "text"]).select("kind", "text", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    names = F.array(*[F.lit(c) for c in columns])
    return long.join(known, ["kind", "text"]).select("id", F.get(names, F.col("kind")).alias("column"), "class_id", "links")


def look_alike_classes(rows: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, column, text, skeleton): one row per row of ``rows`` and name in ``columns``, its text and the consistent form of it,
    composed."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])).alias("x")
    formed = with_skeleton(rows.select(F.col(id_column).alias("id"), texts).select("id", "x.column", "x.text"), "text")
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce("skeleton", F.lit("")), F.lit(False))
    return formed.withColumn("skeleton", F.when(F.col("skeleton").isNotNull(), composed))
