"""Structured Streaming forms: hourly arrivals with late data, and activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_reports(positions: DataFrame, late: str = "2 hours") -> DataFrame:
    """Reports and vessels per destination and hour; rows later than `late` are dropped. Vessels are counted approximately,
    because a stream keeps no distinct sets."""
    w = F.window("timestamp", "1 hour")
    out = positions.withWatermark("timestamp", late).groupBy("port_key", w).agg(F.count("*").alias("reports"), F.approx_count_distinct("mmsi").alias("vessels"))
    return out.select("port_key", F.col("window.start").alias("datetime_hour"), "reports", "vessels")


def sessions(positions: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of reports of a vessel without a gap longer than `gap`."""
    w = F.session_window("timestamp", gap)
    out = positions.withWatermark("timestamp", late).groupBy("mmsi", w).agg(F.count("*").alias("reports"), F.avg("speed").alias("mean_speed"))
    return out.select("mmsi", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "reports", "mean_speed")
