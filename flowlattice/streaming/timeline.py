"""Timeline counts of a transaction stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, width: str = "24 hours", lateness: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """(bucket_start, type, n, amount) per tumbling window; rows later than ``lateness`` are left out, state is dropped behind the watermark."""
    window = F.window(ts, width)
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(window.alias("w"), "type")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
        .select(F.col("w.start").alias("bucket_start"), "type", "n", "amount")
    )
