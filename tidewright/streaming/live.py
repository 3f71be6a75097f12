"""A streaming front end: events become a series by event time, with late rows admitted up to a watermark.

This goes beyond what batch forecasting needs; it keeps a table of buckets that the batch operators read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bucket_stream(events: DataFrame, ts: str = "ts", value: str = "value", key: Column | None = None, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """series_id, ts (start of the bucket), y, n over a stream (or a table) of events."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    keyed = own.select((key if key is not None else F.lit("all")).alias("series_id"), F.col(ts).alias("at"), F.col(value).alias("v"))
    out = keyed.groupBy("series_id", F.window("at", every).alias("w")).agg(F.sum("v").alias("y"), F.count("*").alias("n"))
    return out.select("series_id", F.col("w.start").alias("ts"), "y", "n")


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there, batch by batch (exactly once with an idempotent handler), then stop."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()
    return query
