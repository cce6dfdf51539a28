"""Port-day metrics, routes, stay outliers, and the text chunks made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seawake.operators import quantiles, series


def stay_flags(stays: DataFrame) -> DataFrame:
    """Stays in their port's lowest and highest tenth."""
    ends = quantiles.quantiles(stays, ["port_key"], "dwell_minutes", [0.1, 0.9], "_ends").withColumnRenamed("port_key", "_port")
    low, high = F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1))
    out = stays.join(ends, F.col("port_key").eqNullSafe(F.col("_port")), "left")
    out = out.withColumn("anomaly_short_dwell", F.coalesce(F.col("dwell_minutes") <= low, F.lit(False))).withColumn("anomaly_long_dwell", F.coalesce(F.col("dwell_minutes") >= high, F.lit(False))).drop("_port", "_ends")
    return out.withColumn("anomaly_flag", F.col("anomaly_short_dwell") | F.col("anomaly_long_dwell"))


def port_days(flagged: DataFrame, proxy_daily: DataFrame) -> DataFrame:
    """Counts, dwell and the commonest origin and next port per port and day, with proxy arrivals beside them."""
    keyed = flagged.withColumn("date", F.col("arrival_time").cast("date"))
    keys = ["port_key", "date"]
    hours = F.col("dwell_minutes") / 60
    out = keyed.groupBy(*keys).agg(
        F.count("*").alias("arrivals_events"), F.countDistinct("mmsi").alias("arrivals_vessels"), F.avg(hours).alias("avg_dwell_hours"), F.percentile(hours, F.lit(0.5)).alias("median_dwell_hours"),
        F.count_if("anomaly_short_dwell").alias("short_dwell_count"), F.count_if("anomaly_long_dwell").alias("long_dwell_count"), F.count_if("anomaly_flag").alias("anomaly_count"),
        F.coalesce(F.mode("origin", True), F.lit("UNKNOWN")).alias("most_frequent_origin"), F.coalesce(F.mode("next_port", True), F.lit("UNKNOWN")).alias("most_frequent_next_destination"),
    )
    proxy = proxy_daily.groupBy(*keys).agg(F.sum("arrivals_events").alias("ais_proxy_arrivals_events"), F.sum("arrivals_vessels").alias("ais_proxy_arrivals_vessels"))
    return out.join(proxy, keys, "left")


def routes(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("origin").alias("origin_port"), F.col("next_port").alias("destination")).agg(F.count("*").alias("route_count"), F.countDistinct("mmsi").alias("vessels"))


def event_chunks(flagged: DataFrame) -> DataFrame:
    """One sentence per call with its metadata."""
    said = F.format_string("Vessel %s (%s) arrived at %s on %s and stayed %.2f hours.", "mmsi", "vessel_type_norm", "port_label", F.date_format("arrival_time", "yyyy-MM-dd HH:mm"), F.col("dwell_minutes") / 60)
    return flagged.select(F.concat(F.lit("A_"), "call_id").alias("id"), said.alias("text"), "port_key", F.col("arrival_time").cast("date").alias("date"), F.lit("port_call").alias("event_type"), "anomaly_flag")


def port_day_chunks(days: DataFrame, proxy_daily: DataFrame) -> DataFrame:
    """One sentence per port-day, and one for each proxy port-day without calls."""
    called = days.select("port_key", "date", F.format_string("On %s port %s had %d arrivals by %d vessels, median stay %.2f hours.", F.col("date").cast("string"), "port_key", "arrivals_events", "arrivals_vessels", "median_dwell_hours").alias("text"))
    proxy = proxy_daily.groupBy("port_key", "date").agg(F.sum("arrivals_events").alias("n")).join(days.select("port_key", "date"), ["port_key", "date"], "left_anti")
    only = proxy.select("port_key", "date", F.format_string("On %s port %s was the reported destination of %d reports.", F.col("date").cast("string"), "port_key", "n").alias("text"))
    return called.withColumn("source", F.lit("port_call")).unionByName(only.withColumn("source", F.lit("ais_proxy"))).withColumn("id", F.concat_ws("_", F.lit("B"), "port_key", "date"))


def window_chunks(stays: DataFrame, size: int = 5) -> DataFrame:
    """Each port's calls in windows of `size`, in order of arrival, with the two commonest vessel types.

    Calls are numbered within a port's day and days by running counts, so no task holds all calls of a port.
    """
    day = stays.withColumn("_day", F.col("arrival_time").cast("date"))
    days = day.groupBy("port_key", "_day").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.partitionBy("port_key").orderBy("_day")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("port_key", "_day").orderBy("arrival_time", "call_id")) - 1
    numbered = day.withColumn("_i", inner).join(days, ["port_key", "_day"]).withColumn("window_no", F.floor((F.col("_before") + F.col("_i")) / size).cast("long"))
    keys = ["port_key", "window_no"]
    main = numbered.groupBy(*keys).agg(F.min("arrival_time").alias("first"), F.max("arrival_time").alias("last"), F.count("*").alias("events"), F.countDistinct("mmsi").alias("vessels"), F.avg("dwell_minutes").alias("mean_minutes"))
    ranked = series.last_rows(numbered.groupBy(*keys, "vessel_type_norm").count(), keys, [F.desc("count"), F.col("vessel_type_norm")], 2)
    top = ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "vessel_type_norm"))), lambda s: s["vessel_type_norm"]), ",").alias("top_types"))
    return main.join(top, keys)
