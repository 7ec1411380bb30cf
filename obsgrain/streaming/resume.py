"""Streaming forms: resumable extraction and sessions of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Applies step to what has arrived and appends it to Parquet files; started again it goes on where it stopped."""
    return step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with pauses below `gap`: start, end, n. On a stream state is dropped `late` after the watermark."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
