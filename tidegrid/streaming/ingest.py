"""Bars from a stream of deliveries, and event bars by tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.sources.store import Store


def upsert_stream(deliveries: DataFrame, store: Store, checkpoint: str, name: str = "bars", once: bool = True) -> StreamingQuery:
    """Merge each micro-batch into a stored table. A repeated batch changes nothing: rows are compared by key."""

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(name, batch).count()

    writer = deliveries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(event_type, start, n, open, high, low, close, total) of events(event_id, event_type, ts, value), streamed or not.
    The watermark needs a timestamp with a zone; events later than `late` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    bars = timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("total")
    )
    return bars.select("event_type", F.col("w.start").alias("start"), "n", "open", "high", "low", "close", "total")
