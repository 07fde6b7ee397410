"""The change feed as a stream: named events, delivered batch by batch from a checkpointed position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldstone.operators.history import event_name

HIDDEN = ("confidential", "restricted")


def events(changes: DataFrame, names: list[str] | None = None, sensitivity: str | None = None) -> DataFrame:
    """Changes with their event's name, only those subscribed to; values of confidential or restricted attributes are left out."""
    out = changes.withColumn("event", event_name(F.col("kind")))
    out = out.filter(F.col("event").isin(names)) if names else out
    if sensitivity:
        hidden = F.col(sensitivity).isin(*HIDDEN)
        out = out.withColumns({c: F.when(~F.coalesce(hidden, F.lit(False)), F.col(c)) for c in ("value", "old_value") if c in out.columns})
    return out


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """The append-only change table as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deliver(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, names: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Gives each micro-batch of events to `handle`, in the order of seq within it; the checkpoint is the subscriber's cursor. At least once: a
    batch that failed comes again under the same number."""

    def each(batch: DataFrame, number: int) -> None:
        handle(events(batch, names).sortWithinPartitions("seq"), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """External events, each (type, source, external id) once within the lateness allowed, in bounded state."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def incremental(stream: DataFrame, recompute: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls recompute with the distinct record ids that each micro-batch touches: for search documents, derived attributes, lists."""
    return stream.writeStream.foreachBatch(lambda batch, _: recompute(batch.select("record_id").distinct())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
