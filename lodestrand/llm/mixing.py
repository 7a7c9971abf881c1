"""Mixing sources to target weights (problem 8).

Method: pivotal dependent rounding. A source that must give ``f`` times its size gives every document floor(f)
copies and one more with probability f - floor(f). The fractional probabilities of two documents meet and mass
moves at random from one to the other until one of them is 0 or 1; the other goes on to meet the next. The
expected copies of every document stay what they were, and the sum over a source is kept to within one
document. Documents meet from the largest to the smallest, so what
moves is replaced by something of about the same size and the residual is small.

A bucket of at most LEAF documents is rounded in one task and leaves at most one fractional residual; the
residuals of LEAF buckets meet in the next level, and so on: a reduction tree whose depth is the logarithm of
the largest source to the base LEAF. No task sees more than LEAF documents, however large a source is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tokenize import VOCABULARY, count_tokens
from lodestrand.sources.work import materialize

LEAF = 20_000
TINY = 1e-9


def pivotal(probability: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round one after another; returns 0/1 (or the residual) per entry and the residual's place, -1 if none."""
    p = probability.astype(float).copy()
    draws = np.random.default_rng(seed).random(len(p))
    open_at = -1
    for i in range(len(p)):
        if p[i] <= TINY or p[i] >= 1 - TINY:
            p[i] = round(p[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = p[open_at], p[i]
        if a + b <= 1:  # one of them ends at 0, the other takes both
            loser, winner = (open_at, i) if draws[i] < b / (a + b) else (i, open_at)
            p[loser], p[winner] = 0.0, a + b
        else:  # one of them ends at 1, the other keeps the rest
            winner, loser = (open_at, i) if draws[i] < (1 - b) / (2 - a - b) else (i, open_at)
            p[winner], p[loser] = 1.0, a + b - 1
        left = loser if a + b > 1 else winner
        if p[left] <= TINY or p[left] >= 1 - TINY:
            p[left], left = round(p[left]), -1
        open_at = left
    return p, open_at


def _round_level(docs: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: every (source, bucket) is rounded; the open document stays fractional unless ``last``."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id"], ascending=False, kind="stable", ignore_index=True)
        own = xxhash.xxh3_64_intdigest(f"{key[0]}\n{key[1]}") >> 1
        p, rest = pivotal(frame["p"].to_numpy(), seed * 7919 + own)
        if last and rest >= 0:
            p[rest] = float(np.random.default_rng(seed * 104_729 + own).random() < p[rest])
        return frame.assign(p=p)

    return docs.groupBy("source", "bucket").applyInPandas(run, docs.schema)


def source_factors(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """How often each source is used: source, target_share, max_repeats, available, docs, share, factor.

    ``sizes`` has source, available (tokens) and docs. Sources of a positive share without a token cannot give
    anything; their shares go to the others in proportion (``share``). Without ``total`` the mixture is as large
    as it can be with every source at its share, which the scarcest source decides: total = min(max_repeats *
    available / share). With ``total`` a source that would exceed max_repeats stays at it and its shortage
    shows in the report. Several rows of one source in ``targets`` count once (the largest share).
    """
    wanted = (
        targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(sizes, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
    )
    usable = F.col("available") > 0
    whole = wanted.agg(F.sum(F.when(usable, F.col("target_share"))).alias("whole"))
    shared = wanted.crossJoin(F.broadcast(whole)).withColumn("share", F.when(usable, F.col("target_share") / F.col("whole")).otherwise(0.0)).drop("whole")
    if total is None:
        size = shared.agg(F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("share"))).alias("total"))
        shared = shared.crossJoin(F.broadcast(size))
    else:
        shared = shared.withColumn("total", F.lit(float(total)))
    factor = F.least(F.col("share") * F.col("total") / F.col("available"), F.col("max_repeats").cast("double"))
    return shared.withColumn("factor", F.when(usable, factor).otherwise(0.0)).drop("total")


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total: float | None = None,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, source, tokens, copies): the mixture, every document that is used with its number of copies.

    No document is used more than its source's ``max_repeats`` times. Documents without a source, of a source
    that ``targets`` does not name, and without tokens (null and empty texts) are not used. A repeated doc_id
    is two documents. Tied sizes are ordered by doc_id; equal seeds give equal mixtures. Empty tables give an
    empty mixture. ``factor`` at an integer means exact copies and no chance at all.
    """
    return _mixed(documents, targets, total, seed, id_column, text_column, vocabulary)[0]


def _mixed(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """The mixture and (source, available, docs) of what it was drawn from."""
    named = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counted = count_tokens(named.select(F.col(id_column).alias("doc_id"), "source", text_column), ["doc_id", "source"], text_column, vocabulary)
    counted = materialize(counted.where("tokens > 0"), "sizes")
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
    factors = materialize(source_factors(sizes, targets, total), "factors")  # one row per target
    whole = F.floor(F.col("factor") + TINY)
    plan = factors.where("factor > 0").select(
        "source",
        whole.alias("base"),
        F.greatest(F.col("factor") - whole, F.lit(0.0)).alias("p"),
        F.greatest(F.ceil(F.col("docs") / F.lit(LEAF * 0.9)), F.lit(1)).alias("buckets"),
    )
    docs = counted.join(F.broadcast(plan), "source").select(
        "doc_id", "source", "tokens", "base", "p", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("long").alias("bucket")
    )
    most = plan.agg(F.max("buckets")).first()[0] or 1  # one number
    levels = 1 + max(0, math.ceil(math.log(most) / math.log(LEAF) - TINY)) if most > 1 else 1
    state, done = docs, None
    for level in range(levels):
        last = level == levels - 1
        state = materialize(_round_level(state, seed + level, last), f"round{level}")
        settled = state if last else state.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        state = state.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("bucket", F.floor(F.col("bucket") / LEAF).cast("long"))
    return done.select("doc_id", "source", "tokens", (F.col("base") + F.round("p")).cast("long").alias("copies")).where("copies > 0"), sizes


def mixture_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Per target source: share wanted and reached, documents and tokens available and used, most copies and largest document.

    Takes the options of ``mix_sources``. A source named several times in ``targets`` has one row, as it is used: its largest
    share and number of repeats.
    """
    targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    mixture, sizes = _mixed(documents, targets, **options)
    used = mixture.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"), F.max("tokens").alias("largest")
    )
    sizes = sizes.select("source", F.col("available").alias("available_tokens"))
    counts = ("available_tokens", "used_tokens", "used_docs", "most_copies", "largest")
    rows = targets.join(used, "source", "left").join(sizes, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    whole = rows.agg(F.sum("used_tokens").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("reached_share", F.when(F.col("whole") > 0, F.round(F.col("used_tokens") / F.col("whole"), 6)).otherwise(0.0)).drop("whole")
