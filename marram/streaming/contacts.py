"""Contacts from a stream of events: an extension for graphs that arrive as they happen.

Two events of one type within a few minutes make a contact of their users; contacts gathered over a
window are the edges that the batch operators take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contacts(events: DataFrame, seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """(u, v, ts) for each pair of events of one type within so many seconds, as a stream-stream join whose state the watermark bounds.

    events: ts timestamp, user_id, event_type.
    """
    one = events.select(F.col("event_type").alias("t1"), F.col("user_id").alias("a"), F.col("ts").alias("ts1"))
    two = events.select(F.col("event_type").alias("t2"), F.col("user_id").alias("b"), F.col("ts").alias("ts2"))
    if events.isStreaming:
        one, two = one.withWatermark("ts1", late), two.withWatermark("ts2", late)
    near = F.expr(f"t1 = t2 and ts2 > ts1 and ts2 <= ts1 + interval {seconds} seconds and a <> b")
    met = one.join(two, near)
    return met.select(F.least("a", "b").cast("long").alias("u"), F.greatest("a", "b").cast("long").alias("v"), F.col("ts2").alias("ts"))


def contact_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per user and window: a tumbling aggregation with late data up to the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "user_id", "n")
