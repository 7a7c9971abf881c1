"""The change log as a stream (T1 to T5): every event once, whatever is delivered twice, late or again after a failure.

``foreachBatch`` makes facts, markers and the id of the batch one commit of the versioned store, so a batch that
is run again after a failure is recognised and skipped. A batch is compared with all events that are already there, not only with
those of an overlap, because deliveries may be weeks late; new events are added as a part, nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrand.operators.mirror import new_events
from lodestrand.sources.store import Manifest, Store


def read_feed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Streaming read of the feed files of a folder; a single file is named by a glob pattern, as Spark needs it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class FeedMirror:
    """Events of a feed in the table ``events`` of ``store``: the first arrival of every rcid."""

    def __init__(self, store: Store, columns: list[str]):
        self.store, self.columns = store, columns

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch; running it again changes nothing."""

        edges = batch.agg(F.min("rcid").alias("low"), F.max("timestamp").alias("top")).first()  # one row

        def change(base: Manifest) -> tuple[dict[str, DataFrame], dict, dict[str, DataFrame]]:
            known = self.store.read("events", base)
            if known is not None and edges["low"] is not None:
                # rcid rises with time: the bound reaches the scan and skips the parts of old events
                known = known.where(F.col("rcid") >= edges["low"])
            fresh = new_events(batch, known, self.columns)
            through = max(filter(None, (base.state.get("through"), edges["top"] and str(edges["top"]))), default="")
            return {}, {"through": through}, {"events": fresh}

        self.store.update(change, batch=batch_id)

    def run(self, feed: DataFrame, checkpoint: str) -> None:
        """Consume everything that is available, then stop."""
        query = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply).trigger(availableNow=True).start()
        query.awaitTermination()

    def events(self) -> DataFrame | None:
        """The mirrored events."""
        return self.store.read("events")
