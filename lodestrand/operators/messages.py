"""At-least-once messages: keep exactly one copy of each (problem 5).

Method: an idempotent upsert into hash-bucketed, sorted storage by identifier. A batch becomes one sorted run, its
rows collapsed only among themselves while they are shuffled to their buckets (partial ``min``, so a hot identifier arrives as
one row per map task). Compaction merges the sorted runs of a bucket in one task, without an exchange, so that equal
identifiers collapse to one, and rewrites the store as that one run. Rows without an identifier of their own are found by
their place, among the stored rows of all runs; only they and their places are exchanged.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.work import fresh_path, materialize

PLACE = ["type", "pageid", "revid", "at"]
ROW = ["slot", "blank", *PLACE, "delivery_id"]
RUNS = 4  # runs that a feed is written as


def stored_rows(batch: DataFrame, run: Column) -> DataFrame:
    """A batch as rows of the store: ``slot`` is the rcid, or a hash of the place of a row without one (``blank``).

    The place is type, pageid, revid and timestamp; of equal identifiers and places in one run the lowest ``delivery_id``
    is kept. Rows with a null ``delivery_id`` are left out.
    """
    place = [F.unix_micros("timestamp").alias("at") if c == "at" else F.col(c) for c in PLACE]
    slim = batch.where(F.col("delivery_id").isNotNull()).select("rcid", *place, "delivery_id", run.cast("string").alias("run"))
    slot = F.coalesce("rcid", F.xxhash64(*PLACE)).alias("slot")
    rows = slim.select(slot, F.col("rcid").isNull().alias("blank"), *PLACE, "delivery_id", "run")
    return rows.groupBy("run", *ROW[:-1]).agg(F.min("delivery_id").alias("delivery_id"))


class MessageStore:
    """Runs of messages below ``path``, each in ``buckets`` hash buckets sorted by identifier; opened again by its path.

    ``upsert`` may be repeated with the same run name, in this or another process: the run is replaced, not doubled.
    ``compact`` rewrites all runs as one; if it is cut off, what it has written repeats what is there and changes nothing.
    ``messages`` gives one row per message. ``close`` forgets the catalog entry, the files stay. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "messages")).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._opened(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = "lodestrand_messages_" + uuid.uuid4().hex[:12]
        columns = "slot BIGINT, blank BOOLEAN, type STRING, pageid BIGINT, revid BIGINT, at BIGINT, delivery_id BIGINT, run STRING"
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (run) CLUSTERED BY (slot) SORTED BY (slot)"
            f" INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'"
        )
        self._refresh()

    def _opened(self, buckets: int) -> int:
        """The number of buckets that the store was made with, ``buckets`` for a new one."""
        about = self._path(f"{self.path}/store.json")
        if self._fs.exists(about):
            stream = self._fs.open(about)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())["buckets"]
            finally:
                stream.close()
        out = self._fs.create(about, False)
        out.write(bytearray(json.dumps({"buckets": buckets}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/runs"))
        return buckets

    def _refresh(self) -> None:
        self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")  # the catalog lists the runs that the files make
        self.spark.catalog.refreshTable(self.name)

    def runs(self) -> list[str]:
        """Names of the runs."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/runs")) if s.isDirectory()]
        return sorted(n.removeprefix("run=") for n in found if n.startswith("run="))

    def _insert(self, rows: DataFrame, run: str, how: str) -> None:
        view = "lodestrand_batch_" + uuid.uuid4().hex[:12]
        rows.select(*ROW).createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT {how} {self.name} PARTITION (run = '{run}') SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def upsert(self, batch: DataFrame, run: str) -> None:
        """Write one batch of messages as the sorted run of this name, in place of an earlier one."""
        if not re.fullmatch("[A-Za-z0-9_-]+", run):
            raise ValueError("a run is named by letters, digits, - and _")
        self._insert(stored_rows(batch, F.lit(run)).repartition(self.buckets, "slot"), run, "OVERWRITE")

    def load(self, feed: DataFrame, run: Column) -> None:
        """The first content of an empty store: the batches of ``feed``, each in the run that ``run`` names, in one pass."""
        if self.runs():
            raise ValueError("the store is not empty")
        stored_rows(feed, run).repartition(self.buckets, "slot").select(*ROW, "run").write.insertInto(self.name)

    def compact(self) -> None:
        """Merge the runs bucket by bucket into one, equal identifiers of a place collapsing, and remove what was merged."""
        before = self.runs()
        if len(before) < 2:
            return
        merged = self.spark.table(self.name).groupBy(*ROW[:-1]).agg(F.min("delivery_id").alias("delivery_id"))
        self._insert(merged, "merged-" + uuid.uuid4().hex, "INTO")
        for run in before:
            self._fs.delete(self._path(f"{self.path}/runs/run={run}"), True)
        self._refresh()

    def messages(self) -> DataFrame:
        """(delivery_id) of the kept copy of every message: the lowest of all copies.

        A row without an rcid belongs to the message that has its place (null equals null), to the lowest rcid where several
        have; if no row of that place has an rcid, the place itself is the identifier. Rows with one stay in their buckets.
        """
        rows = self.spark.table(self.name)
        known, blank = rows.where(~F.col("blank")), rows.where("blank").groupBy("slot", *PLACE).agg(F.min("delivery_id").alias("d"))
        here = lambda a, b: functools.reduce(operator.and_, [a[c].eqNullSafe(b[c]) for c in PLACE])
        lost = blank.select(*PLACE)
        owners = known.join(lost, here(known, lost), "left_semi").groupBy(*PLACE).agg(F.min("slot").alias("owner"))
        found = blank.join(owners, here(blank, owners), "left").select("d", "owner")
        added = found.where(F.col("owner").isNotNull()).groupBy("owner").agg(F.min("d").alias("d"))
        own = known.groupBy("slot").agg(F.min("delivery_id").alias("own"))
        kept = own.join(added, own["slot"] == added["owner"], "left").select(F.least("own", "d").alias("delivery_id"))
        return kept.unionByName(found.where(F.col("owner").isNull()).select(F.col("d").alias("delivery_id")))

    def close(self) -> None:
        """Forget the catalog entry."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def kept_copies(feed: DataFrame, buckets: int | None = None) -> DataFrame:
    """delivery_id of the copy that is kept of every message: batches of ``feed`` as RUNS runs (one without ``batch_id``), compacted."""
    store = MessageStore(feed.sparkSession, buckets=buckets)
    store.load(feed, F.pmod(F.xxhash64("batch_id"), F.lit(RUNS)) if "batch_id" in feed.columns else F.lit(0))
    store.compact()
    kept = materialize(store.messages(), "kept")
    store.close()
    return kept


def surplus_messages(feed: DataFrame, buckets: int | None = None) -> DataFrame:
    """delivery_id of every row of ``feed`` that is not the kept copy (lowest ``delivery_id``) of its message.

    An empty feed gives an empty result; rows with a null ``delivery_id`` cannot be told apart and are left
    out; all columns but rcid, delivery_id, batch_id, type, pageid, revid and timestamp are ignored.
    """
    feed = feed.where(F.col("delivery_id").isNotNull())
    return feed.select("delivery_id").join(kept_copies(feed, buckets), "delivery_id", "left_anti")


def keep_one_copy(feed: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``feed`` without the surplus copies, all columns kept."""
    return feed.join(kept_copies(feed, buckets), "delivery_id", "left_semi")
