"""An extension: moments of events by time window and type, the same plan for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_moments(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, mean, sd. On a stream, state older than ``late`` behind the newest event is closed and later rows for it go."""
    kind = dict(events.dtypes)["ts"]  # a watermark needs an instant; the result has the type of ts again
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    by = source.groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "mean", "sd")
