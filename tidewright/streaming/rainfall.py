"""Rainfall readings as a stream: hourly windows with a watermark, scored like a scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_intensity(readings: DataFrame, late: str = "30 minutes", window: str = "1 hour") -> DataFrame:
    """(start, end, mm_per_hour, n) of readings (timestamp, rainfall_mm_hr); later ones than ``late`` are left out on a stream."""
    held = readings.withWatermark("timestamp", late) if readings.isStreaming else readings
    out = held.groupBy(F.window("timestamp", window).alias("w")).agg(F.avg("rainfall_mm_hr").alias("mm_per_hour"), F.count("*").alias("n"))
    return out.select("w.start", "w.end", "mm_per_hour", "n")
