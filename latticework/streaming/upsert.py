"""Micro-batch upserts: a stream of operations into a log. The checkpoint takes the place of a write-ahead log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends (seq, op, key, value) rows to a Parquet log, once each: the file sink records the batches
    that it has committed. Without an interval it takes what is there and ends."""
    columns = stream.select("seq", "op", "key", "value")
    writer = columns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def kv_stream(events: DataFrame) -> DataFrame:
    """Operations of an event stream: the last event type of each user."""
    seq = F.struct("ts", "event_id").alias("seq")
    return events.select(seq, F.lit("PUT").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))
