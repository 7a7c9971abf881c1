"""Applying a feed of inserts, updates and deletes (problem 1).

Method: column-wise last writer wins. Every field of the result is ``max_by(value, sequence)`` over
the changes that set this field, and only sequences after the latest removal count, unless a restore after it brings
back what was set before. All of it is one aggregation per page, so it combines on the map side: a page that holds a
third of the feed costs one partial row per map task. No ordering of the input is needed, and a
repeated or late message changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.sources.work import materialize

REMOVALS = ("delete", "delete_redir")


def _is_log(logtype: str, *actions: str) -> Column:
    hit = (F.col("type") == "log") & (F.col("logtype") == logtype)
    return hit & F.col("logaction").isin(*actions) if actions else hit


def apply_change_feed(feed: DataFrame) -> DataFrame:
    """Current pages (pageid, revid, title) after the whole ``feed``.

    Sequence is ``rcid``; rows without one are left out and of several rows of one ``rcid`` the one with
    the lowest ``delivery_id`` counts. new/edit set title and revid and make the page exist; move sets the
    title; delete and delete_redir remove it and all its fields with it; restore takes that back. A removal with ``pageid`` 0 is resolved by its title.

    Defined cases: null ``type``/``pageid`` rows change nothing; a page that was never created or edited
    in the feed does not exist, whatever else is logged of it; a move without a target title sets nothing;
    null or empty titles are kept as they are, the latest writer winning even with a null; an unresolvable
    removal is ignored; an empty feed gives an empty table; columns beyond those named are ignored.
    """
    writes = F.col("type").isin("new", "edit")
    moves = _is_log("move")
    removes = _is_log("delete", *REMOVALS)
    restores = _is_log("delete", "restore")
    # struct order: highest rcid first, within it the earliest delivery
    seq = F.struct(F.col("rcid"), (-F.col("delivery_id")).alias("d"))
    kind = (
        F.when(writes, F.lit("w")).when(moves, F.lit("m")).when(removes, F.lit("d")).when(restores, F.lit("r"))
    )
    rows = feed.select(
        "pageid",
        "rcid",
        "delivery_id",
        "revid",
        kind.alias("kind"),
        "title",
        F.when(moves, F.col("logparams")["target_title"]).alias("target"),
    ).where(F.col("rcid").isNotNull() & F.col("pageid").isNotNull())

    # removals that name the page by title only: few rows, resolved against the titles pages have had
    blind = materialize(rows.where((F.col("kind") == "d") & (F.col("pageid") == 0) & F.col("title").isNotNull()), "blind")
    owners = (
        rows.where(F.col("pageid") != 0)
        .select("pageid", F.explode(F.array("title", "target")).alias("title"))
        .where(F.col("title").isNotNull())
        .join(blind.select("title").distinct(), "title", "left_semi")
        .groupBy("title")
        .agg(F.min("pageid").alias("owner"))
    )
    resolved = blind.join(owners, "title").select(
        F.col("owner").alias("pageid"), "rcid", "delivery_id", "revid", "kind", "title", "target"
    )
    events = rows.where((F.col("pageid") != 0) & F.col("kind").isNotNull()).unionByName(resolved)

    is_write = F.col("kind") == "w"
    sets_title = is_write | ((F.col("kind") == "m") & F.col("target").isNotNull())
    when = lambda kind: F.max(F.when(F.col("kind") == kind, seq))
    state = events.groupBy("pageid").agg(
        F.max_by(F.when(is_write, F.col("title")).otherwise(F.col("target")), F.when(sets_title, seq)).alias("title"),
        F.max_by("revid", F.when(is_write, seq)).alias("revid"),
        when("w").alias("written"),
        when("d").alias("removed"),
        when("r").alias("restored"),
    )
    # what was set up to the cutoff is gone; a write sets every field, so after a later one nothing older is left to win
    restored = F.coalesce(F.col("restored") > F.col("removed"), F.lit(False))
    cutoff = F.when(~restored, F.col("removed"))
    return state.where(F.col("written").isNotNull() & (cutoff.isNull() | (F.col("written") > cutoff))).select("pageid", "revid", "title")
