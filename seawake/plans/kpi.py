"""Port activity marts and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.operators import quantiles, series

PORT = ("port_key", "port_label")


# ---- marts


def proxy_arrivals(positions: DataFrame, grain: str = "day") -> DataFrame:
    """Arrivals by reported destination: a vessel counts once per port, type and day or hour."""
    when = F.col("timestamp").cast("date") if grain == "day" else F.date_trunc("hour", "timestamp")
    name = "date" if grain == "day" else "datetime_hour"
    once = positions.select("mmsi", *PORT, when.alias(name), "vessel_type_norm").dropDuplicates()
    return once.groupBy(*PORT, name, "vessel_type_norm").agg(F.countDistinct("mmsi").alias("arrivals_vessels"), F.count("*").alias("arrivals_events"))


def call_arrivals(calls: DataFrame, grain: str = "day") -> DataFrame:
    """Arrivals by port call."""
    when = F.col("arrival_time").cast("date") if grain == "day" else F.date_trunc("hour", "arrival_time")
    name = "date" if grain == "day" else "datetime_hour"
    return calls.groupBy(*PORT, when.alias(name), "vessel_type_norm").agg(F.countDistinct("mmsi").alias("arrivals_vessels"), F.count("*").alias("arrivals_events"))


def dwell(calls: DataFrame, most_days: int = 45) -> DataFrame:
    """Minutes of each stay; stays that are not positive or longer than `most_days` go."""
    minutes = series.seconds(F.col("arrival_time"), F.col("departure_time")) / 60
    return calls.withColumn("dwell_minutes", minutes).filter((F.col("dwell_minutes") > 0) & (F.col("dwell_minutes") <= most_days * 1440))


def occupancy(stays: DataFrame) -> DataFrame:
    """Vessels and calls present in each port and hour."""
    return series.present(stays, [*PORT], "mmsi", "arrival_time", "departure_time", members="occupancy_vessels", events="occupancy_events")


def port_days(daily: DataFrame) -> DataFrame:
    """Arrivals per port and day over all types; one label per port."""
    return daily.groupBy("port_key", "date").agg(F.min("port_label").alias("port_label"), F.sum("arrivals_vessels").alias("arrivals_vessels"), F.sum("arrivals_events").alias("arrivals_events"))


def congestion(calls_daily: DataFrame, proxy_daily: DataFrame, stays: DataFrame) -> DataFrame:
    """Arrivals and median dwell, each against its port's median over all days; port calls go before proxy arrivals."""
    a, p = port_days(calls_daily), port_days(proxy_daily)
    both = a.alias("a").join(p.alias("p"), ["port_key", "date"], "full_outer").select(
        "port_key", "date", F.coalesce("a.port_label", "p.port_label").alias("port_label"), F.when(F.col("a.port_label").isNotNull(), "port_call").otherwise("ais_destination_proxy").alias("source_kind"),
        F.coalesce("a.arrivals_vessels", "p.arrivals_vessels").cast("double").alias("arrivals_vessels"), F.coalesce("a.arrivals_events", "p.arrivals_events").cast("double").alias("arrivals_events"),
    )
    d = stays.groupBy("port_key", F.col("arrival_time").cast("date").alias("date")).agg(F.percentile("dwell_minutes", F.lit(0.5)).alias("median_dwell_minutes"))
    w = Window.partitionBy("port_key")
    ratio = lambda c: F.col(c) / F.nullif(F.percentile(c, F.lit(0.5)).over(w), F.lit(0.0))
    out = both.join(d, ["port_key", "date"], "left").withColumn("has_dwell", F.col("median_dwell_minutes").isNotNull())
    out = out.withColumn("arrivals_ratio", ratio("arrivals_vessels")).withColumn("dwell_ratio", ratio("median_dwell_minutes"))
    return out.withColumn("congestion_index", F.when(F.col("dwell_ratio").isNull(), F.col("arrivals_ratio")).otherwise(F.col("arrivals_ratio") + F.col("dwell_ratio")))


def port_catalog(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*PORT).agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.sum("arrivals_vessels").alias("arrivals_total"))


def capabilities(daily: DataFrame, stays: DataFrame) -> DataFrame:
    """One row that says what the marts hold."""
    a = daily.agg(F.count("*").alias("arrival_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("port_key").alias("ports"))
    return a.crossJoin(stays.agg((F.count("*") > 0).alias("has_dwell")))  # one row with one row


# ---- filters


def for_port(df: DataFrame, port: str | None) -> DataFrame:
    """Rows whose key is the port, or whose label contains it."""
    if not port:
        return df
    return df.filter((F.upper("port_key") == port.strip().upper()) | F.lower("port_label").contains(port.strip().lower()))


def for_dates(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date", whole_end_day: bool = False) -> DataFrame:
    """Rows from `start` to `end`; for timestamps the last day counts to its midnight only, unless `whole_end_day`."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        last = F.lit(end).cast("timestamp_ntz")
        df = df.filter(F.col(column) < last + F.expr("interval 1 day")) if whole_end_day else df.filter(F.col(column) <= last)
    return df


def last_weeks(df: DataFrame, weeks: int, column: str = "date") -> DataFrame:
    """Rows of the last `weeks` weeks before the latest date that is left; both ends count."""
    latest = df.agg(F.max(column).alias("_latest"))
    return df.crossJoin(latest).filter(F.col(column) >= F.date_sub(F.col("_latest"), 7 * weeks)).drop("_latest")  # with one row


def for_type(df: DataFrame, vessel_type: str | None) -> DataFrame:
    return df.filter(F.col("vessel_type_norm").contains(vessel_type.lower())) if vessel_type else df


def for_weekday(df: DataFrame, day: str | None, column: str = "date") -> DataFrame:
    """Rows of a named weekday, of `Weekend` or of `Weekday`."""
    if not day:
        return df
    n = F.weekday(column)
    return df.filter(n >= 5 if day.lower() == "weekend" else n < 5 if day.lower() == "weekday" else F.date_format(column, "EEEE") == day.capitalize())


# ---- questions


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.sum("arrivals_vessels").alias("arrivals"))


def arrivals(daily: DataFrame) -> DataFrame:
    return daily_totals(daily).agg(F.sum("arrivals").alias("arrivals"), F.count("*").alias("days"))


def peak_day(daily: DataFrame) -> DataFrame:
    return daily_totals(daily).orderBy(F.desc("arrivals"), "date").limit(1)


def top_ports(daily: DataFrame, n: int = 10) -> DataFrame:
    return daily.groupBy(*PORT).agg(F.sum("arrivals_vessels").alias("arrivals")).orderBy(F.desc("arrivals"), "port_key").limit(max(1, n))


def by_weekday(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("date", "EEEE").alias("day_of_week")).agg(F.sum("arrivals_vessels").alias("arrivals"))


def busiest_weekday(daily: DataFrame) -> DataFrame:
    return by_weekday(daily).orderBy(F.desc("arrivals"), "day_of_week").limit(1)


def compare_weekdays(daily: DataFrame, a: str, b: str) -> DataFrame:
    """Arrivals of two weekdays, the winner (b on a tie) and its ratio to the other; no row unless both occur."""
    total = lambda d: F.sum(F.when(F.col("day_of_week") == d, F.col("arrivals")))
    both = by_weekday(daily).agg(total(a).alias("a"), total(b).alias("b")).dropna()
    return both.select("a", "b", F.when(F.col("a") > F.col("b"), a).otherwise(b).alias("winner"), (F.greatest("a", "b") / F.greatest(F.least("a", "b"), F.lit(1))).alias("ratio"))


def busiest_hour(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(F.hour("datetime_hour").alias("hour")).agg(F.sum("arrivals_vessels").alias("arrivals")).orderBy(F.desc("arrivals"), "hour").limit(1)


def dwell_stats(stays: DataFrame) -> DataFrame:
    middle = quantiles.quantiles(stays, ["vessel_type_norm"], "dwell_minutes", [0.5]).select(F.col("vessel_type_norm").alias("_type"), F.get("quantiles", 0).alias("median_minutes"))
    means = stays.groupBy("vessel_type_norm").agg(F.count("*").alias("calls"), F.avg("dwell_minutes").alias("mean_minutes"))
    return means.join(middle, F.col("vessel_type_norm").eqNullSafe(F.col("_type")), "left").select("vessel_type_norm", "calls", "median_minutes", "mean_minutes")


def port_stays(stays: DataFrame, mmsi: str) -> DataFrame:
    """Number, hours and median hours of a vessel's stays, per port."""
    mine = stays.filter(F.regexp_replace("mmsi", r"\D", "") == "".join(c for c in mmsi if c.isdigit()))
    hours = F.col("dwell_minutes") / 60
    return mine.groupBy("port_key").agg(F.count("*").alias("stays"), F.sum(hours).alias("hours"), F.percentile(hours, F.lit(0.5)).alias("median_hours"))


def congestion_by_date(index: DataFrame) -> DataFrame:
    return index.groupBy("date").agg(F.avg("congestion_index").alias("congestion_index"), F.sum("arrivals_vessels").alias("arrivals"), F.percentile("median_dwell_minutes", F.lit(0.5)).alias("median_dwell_minutes"))


def congestion_summary(index: DataFrame) -> DataFrame:
    """Mean and peak of the daily index, and the share of rows with dwell behind it."""
    daily = congestion_by_date(index).agg(F.avg("congestion_index").alias("mean_index"), F.max("congestion_index").alias("peak_index"), F.max_by("date", F.struct("congestion_index", -F.unix_date("date"))).alias("peak_date"))
    return daily.crossJoin(index.agg(F.avg(F.col("has_dwell").cast("double")).alias("dwell_share")))  # one row with one row


def compare_ports(daily: DataFrame, index: DataFrame, stays: DataFrame, metric: str) -> DataFrame:
    """One number per port: median of type medians of dwell, mean daily index, or total arrivals."""
    if metric == "dwell":
        return dwell_by(stays, ["port_key", "vessel_type_norm"]).groupBy("port_key").agg(F.percentile("median_minutes", F.lit(0.5)).alias("value"))
    if metric == "congestion":
        return index.groupBy("port_key", "date").agg(F.avg("congestion_index").alias("v")).groupBy("port_key").agg(F.avg("v").alias("value"))
    return daily.groupBy("port_key").agg(F.sum("arrivals_vessels").cast("double").alias("value"))


def dwell_by(stays: DataFrame, keys: list[str | Column]) -> DataFrame:
    return stays.groupBy(*keys).agg(F.percentile("dwell_minutes", F.lit(0.5)).alias("median_minutes"))


def diagnose(daily: DataFrame, stays: DataFrame) -> DataFrame:
    """Arrivals by type beside the types' median dwell."""
    return daily.groupBy("vessel_type_norm").agg(F.sum("arrivals_vessels").alias("arrivals")).join(dwell_by(stays, ["vessel_type_norm"]), "vessel_type_norm", "left")


def arrival_spikes(daily: DataFrame) -> DataFrame:
    return series.spikes(port_days(daily), ["port_key"], "date", "arrivals_vessels")


def coverage(daily: DataFrame) -> DataFrame:
    return daily.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("vessel_type_norm")), ",").alias("types"))
