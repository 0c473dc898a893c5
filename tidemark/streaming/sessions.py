"""Gap sessions of an event stream: an addition for runs that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(run_id, start, end, n_events) of events (run_id, ts); the same plan for a batch and for a stream with late rows."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        held = held.withWatermark("ts", late)
    found = held.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
