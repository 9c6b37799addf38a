"""Punctuality of a live stream of completed legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_on_time(stream: DataFrame, time: str, key: str, delay: str, window: str = "1 hour", late_data: str = "2 hours") -> DataFrame:
    """On-time counts by place and window of event time; legs later than ``late_data`` are left out.

    Works on a streaming frame (append mode closes a window once the
    watermark has passed it) and, with the same result, on a batch.
    """
    own = stream.withWatermark(time, late_data).where(F.col(delay).isNotNull())
    out = own.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("flights"), F.count_if(F.col(delay) <= 15).alias("otp15_count"), F.sum(delay).alias("delay_sum"))
    return out.select(F.col("w.start").alias("window_start"), key, "flights", "otp15_count", "delay_sum")
