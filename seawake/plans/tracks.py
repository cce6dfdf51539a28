"""Features of vessel tracks: deltas, rolling means, jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seawake.functions import geo
from seawake.operators import blocks, series

#: The order of a vessel's rows, and what is compared with the row before.
ORDER, OWN = ["timestamp", "position_id"], ["timestamp", "latitude", "longitude", "speed", "course"]


def track() -> WindowSpec:
    """A vessel's rows in order."""
    return Window.partitionBy("mmsi").orderBy("timestamp", "position_id")


def deltas(positions: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Time, distance, implied speed, acceleration and turn since the row before, and the time of the next (`_next_time`).

    A vessel's rows are cut into days; `source` has the same positions where that is cheaper to read.
    """
    rows = positions if blocks.BLOCK in positions.columns else blocks.by_block(positions, "timestamp")
    beside = blocks.neighbours(rows, "mmsi", ORDER, OWN, None if source is None else blocks.by_block(source, "timestamp"))
    positions = beside.withColumn("_next_time", F.col("_next.timestamp")).drop("_next")
    c, lag = F.col, lambda n: F.col(f"_prev.{n}")
    raw = series.seconds(lag("timestamp"), c("timestamp"))
    out = positions.withColumn("delta_time_s", F.when(raw > 0, raw)).withColumn("delta_distance_km", geo.haversine_km(lag("latitude"), lag("longitude"), c("latitude"), c("longitude")))
    hours = c("delta_time_s") / 3600
    out = out.withColumns({
        "speed_estimated_kn": c("delta_distance_km") / geo.KM_PER_NM / hours, "acceleration_kn_per_h": (c("speed") - lag("speed")) / hours,
        "course_change_deg": geo.turn_deg(lag("course"), c("course")),
    })
    return out.withColumn("course_change_rate_deg_per_h", c("course_change_deg") / hours).drop("_prev")


def rolling(features: DataFrame, sizes: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Rolling mean and deviation of speed (0 where undefined) over the last rows, and means of the derived features."""
    out = features
    for n in sizes:
        w = track().rowsBetween(-(n - 1), 0)
        out = out.withColumns({f"speed_roll_mean_{n}": F.avg("speed").over(w), f"speed_roll_std_{n}": F.coalesce(F.stddev_samp("speed").over(w), F.lit(0.0))})
        if n > 3:
            out = out.withColumns({f"speed_est_roll_mean_{n}": F.avg("speed_estimated_kn").over(w), f"course_change_roll_mean_{n}": F.avg("course_change_deg").over(w)})
    return out


def clock(features: DataFrame) -> DataFrame:
    """Hour with fraction and weekday (Monday 0)."""
    return features.withColumns({"hour_of_day": F.hour("timestamp") + F.minute("timestamp") / 60.0, "day_of_week": F.weekday("timestamp")})


def eta_label(positions: DataFrame, arrivals: DataFrame, most_days: int = 14) -> DataFrame:
    """Minutes to the vessel's next arrival, within (0, 14 days]."""
    ahead = arrivals.select("mmsi", F.col("arrival_time").alias("_a"), (-F.unix_micros(F.col("arrival_time").cast("timestamp"))).alias("_back"))
    back = positions.withColumn("_back", -F.unix_micros(F.col("timestamp").cast("timestamp")))
    ahead = ahead.withColumn("_moment_back", F.timestamp_micros("_back"))  # time runs backwards, blocks too
    out = series.asof(back.withColumn("_moment_back", F.timestamp_micros("_back")), ahead, "mmsi", "_back", "_back", ["_a"], "_a", "_moment_back").drop("_moment_back", blocks.BLOCK)
    minutes = (F.unix_micros(F.col("_a").cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 6e7
    return out.withColumn("eta_minutes_label", F.when((minutes > 0) & (minutes <= most_days * 1440), minutes)).drop("_a", "_back")


def jumps(positions: DataFrame, minutes: float = 30, far_km: float = 20, near_km: float = 5, fast_kn: float = 40) -> DataFrame:
    """Rows that are implausibly far from the one before: far, or near but too fast, within half an hour."""
    lag = lambda n: F.col(f"_prev.{n}")
    out = blocks.neighbours(blocks.by_block(positions, "timestamp"), "mmsi", ORDER, OWN[:3]).withColumn("delta_minutes", series.seconds(lag("timestamp"), F.col("timestamp")) / 60).withColumn("jump_km", geo.planar_km(lag("latitude"), lag("longitude"), F.col("latitude"), F.col("longitude")))
    out = out.withColumn("implied_kn", F.col("jump_km") / geo.KM_PER_NM / (F.nullif(F.col("delta_minutes"), F.lit(0.0)) / 60))
    near = F.col("delta_minutes").between(0, minutes) & (F.col("delta_minutes") > 0)
    return out.filter(near & ((F.col("jump_km") >= far_km) | ((F.col("jump_km") >= near_km) & (F.col("implied_kn") >= fast_kn)))).drop("_prev", "_next", blocks.BLOCK)


def far_moves(features: DataFrame, minutes: float = 30, km: float = 80) -> DataFrame:
    """The same idea by great circles: at least 80 km within half an hour."""
    return features.withColumn("anomaly_jump_30m", (F.coalesce(F.col("delta_time_s"), F.lit(0.0)) > 0) & (F.col("delta_time_s") <= minutes * 60) & (F.coalesce(F.col("delta_distance_km"), F.lit(0.0)) >= km))


def recent(positions: DataFrame, n: int = 20) -> DataFrame:
    """The last rows of each vessel."""
    return series.last_rows(positions, ["mmsi"], [F.desc("timestamp"), F.desc("position_id")], n)
