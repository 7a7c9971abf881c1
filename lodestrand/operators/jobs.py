"""The queue of bodies to fetch (F4, F5, F21, F22, P8, P9, J3 to J5, T14): one job per page, as joins over whole tables.

A job has id, type, pageId, status, targetRevisionId, error and updatedAt. What a page needs follows from the page alone, so
a queue can always be repaired from the pages, and a batch that fails goes back to where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.mirror import assign_sequence

# fixed values: type of these jobs and the content models whose bodies are searched
BODY_JOB = "wikitext-content"
MODELS = ("wikitext", "bson", "scribunto")
BATCH = 50
COLUMNS = ["id", "type", "pageId", "status", "targetRevisionId", "error", "updatedAt"]


def searchable_model(model: Column) -> Column:
    """whether bodies of a content model are searched, whatever its case; false for null."""
    return F.coalesce(F.lower(model).isin(*MODELS), F.lit(False))


def needs_job(pages: DataFrame) -> DataFrame:
    """live pages that are no redirect and have a searchable model."""
    return pages.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("isRedirect", F.lit(False)) & searchable_model(F.col("contentModel")))


def wanted_jobs(pages: DataFrame, force: bool = False) -> DataFrame:
    """(pageId, status, targetRevisionId) that every page needs; done if its body is of its revision, unless ``force``."""
    fresh = F.col("content").isNotNull() & F.col("contentRevisionId").eqNullSafe(F.col("revisionId")) & F.lit(not force)
    return needs_job(pages).select(F.col("id").alias("pageId"), F.when(fresh, "done").otherwise("pending").alias("status"), F.col("revisionId").alias("targetRevisionId"))


def current_jobs(jobs: DataFrame) -> DataFrame:
    """One job per page: the one updated last, of equals the one of the highest id, repeated rows being one."""
    own = jobs.where((F.col("type") == BODY_JOB) & F.col("pageId").isNotNull())
    rest = [c for c in COLUMNS if c not in ("id", "pageId", "updatedAt")]
    order = F.struct(F.coalesce("updatedAt", F.lit(-1)).alias("at"), F.coalesce("id", F.lit(-1)).alias("n"), "updatedAt", "id", *rest)
    return own.groupBy("pageId").agg(F.max(order).alias("j")).select("j.id", "j.type", "pageId", *[f"j.{c}" for c in rest[1:]], "j.updatedAt")


def repaired(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``jobs`` (one per page) against ``wanted``: keep, put or delete per page, with the job as it is after that.

    A job that says something else than its page needs is put again under its id, one without a page is deleted, one with an
    error is put without it.
    """
    a, b = wanted.alias("a"), jobs.alias("b")
    same = F.col("b.status").eqNullSafe(F.col("a.status")) & F.col("b.targetRevisionId").eqNullSafe(F.col("a.targetRevisionId")) & F.col("b.error").isNull()
    action = F.when(F.col("a.pageId").isNull(), "delete").when(F.col("b.pageId").isNotNull() & same, "keep").otherwise("put")
    mine = lambda c: F.when(F.col("a.pageId").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.pageId") == F.col("b.pageId"), "full_outer").select(
        F.coalesce("a.pageId", "b.pageId").alias("pageId"), F.col("b.id").alias("id"), mine("status"), mine("targetRevisionId"), action.alias("action")
    )


def claims(jobs: DataFrame, size: int = BATCH) -> DataFrame:
    """(id, pageId, targetRevisionId, batch): the pending jobs in order of id, ``size`` to a batch, from 0."""
    pending = jobs.where((F.col("type") == BODY_JOB) & (F.col("status") == "pending")).select("id", "pageId", "targetRevisionId")
    numbered = assign_sequence(pending, ["id", "pageId"], column="n")
    return numbered.select("id", "pageId", "targetRevisionId", F.floor((F.col("n") - 1) / size).alias("batch"))


def settled(claimed: DataFrame, pages: DataFrame, answers: DataFrame) -> DataFrame:
    """What becomes of claimed jobs (pageId, targetRevisionId), given ``pages`` and ``answers`` (pageid, revid, contentmodel, content).

    result is gone (the page needs no job any more), failed (no body came), behind (the body is older than one already known:
    the whole batch has to be tried again) or done, then with the page's new body and revision and whether a search would
    notice (``changed``).
    """
    p, r = needs_job(pages).alias("p"), answers.where(F.col("content").isNotNull()).alias("r")
    joined = claimed.alias("c").join(p, F.col("c.pageId") == F.col("p.id"), "left").join(r, F.col("c.pageId") == F.col("r.pageid"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = F.greatest(zero("p.revisionId"), zero("p.contentRevisionId"), zero("c.targetRevisionId"))
    result = (
        F.when(F.col("p.id").isNull(), "gone").when(F.col("r.content").isNull(), "failed").when(zero("r.revid") < expected, "behind").otherwise("done")
    )
    model = F.coalesce("r.contentmodel", "p.contentModel", F.lit("wikitext"))
    noticed = ~F.col("p.content").eqNullSafe(F.col("r.content")) | ~F.lower("p.contentModel").eqNullSafe(F.lower(model))
    done = F.col("result") == "done"
    rows = joined.select(
        F.col("c.pageId").alias("pageId"), result.alias("result"), F.greatest(zero("p.revisionId"), zero("r.revid")).alias("revisionId"),
        F.col("r.revid").alias("contentRevisionId"), model.alias("contentModel"), F.col("r.content").alias("content"), noticed.alias("changed"),
    )
    only = [F.when(done, F.col(c)).alias(c) for c in ("revisionId", "contentRevisionId", "contentModel", "content")]
    return rows.select("pageId", "result", *only, (done & F.col("changed")).alias("changed"))
