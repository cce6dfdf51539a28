"""Forecasts of daily series per port, seasonal analogs and backtests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seawake.functions import labels
from seawake.operators import series


def daily_series(daily: DataFrame, value: str) -> DataFrame:
    """(port_key, date, value): the metric summed per port and observed day."""
    return daily.groupBy("port_key", "date").agg(F.sum(value).cast("double").alias("value")).filter("value IS NOT NULL")


def long_enough(df: DataFrame, least: int = 14) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("port_key"))).filter(F.col("_n") >= least).drop("_n")


def one_step(df: DataFrame) -> DataFrame:
    return series.one_step(df, ["port_key"], "date", "value")


def horizon(df: DataFrame, weeks: int = 2) -> DataFrame:
    """A forecast for 7 days a week of horizon, for ports with enough history."""
    return series.horizon(long_enough(df), ["port_key"], "date", "value", 7 * weeks)


def weekday_outlook(df: DataFrame, weekday: str, weeks: int = 4) -> DataFrame:
    """The mean forecast over the coming days of one weekday, with its level."""
    days = horizon(df, weeks).filter(F.date_format("date", "EEEE") == weekday)
    out = days.groupBy("port_key").agg(F.avg("predicted").alias("predicted"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"), F.count("*").alias("days"))
    return out.withColumn("level", labels.congestion_level(F.col("predicted")))


def seasonal_analog(df: DataFrame, target: str) -> DataFrame:
    """Mean of the days most like a date, by the first of seven ever wider likenesses that has enough days.

    One aggregation counts every likeness at once; a second takes the values of the chosen one.
    """
    t = dt.date.fromisoformat(target)
    month, day, week, name = F.month("date") == t.month, F.dayofmonth("date"), F.weekofyear("date") == t.isocalendar().week, F.date_format("date", "EEEE") == t.strftime("%A")
    tiers = [(month & (day == t.day), 1), (month & (F.abs(day - t.day) <= 2) & name, 2), (week & name, 3), (month & name, 3), (month, 5), (name, 5), (F.lit(True), 1)]
    marked = df.select("port_key", "value", *(m.alias(f"t{i}") for i, (m, _) in enumerate(tiers, 1)))
    counts = marked.groupBy("port_key").agg(*(F.count_if(f"t{i}").alias(f"n{i}") for i in range(1, 8)))
    tier = F.coalesce(*(F.when(F.col(f"n{i}") >= least, i) for i, (_, least) in enumerate(tiers, 1)))
    chosen = marked.join(counts.select("port_key", tier.alias("tier")), "port_key")
    held = F.lit(False)
    for i in range(1, 8):
        held = held | ((F.col("tier") == i) & F.col(f"t{i}"))
    v = F.col("value")
    out = chosen.filter(held).groupBy("port_key", "tier").agg(F.count("*").alias("samples"), F.avg(v).alias("predicted"), F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"))
    one = F.col("samples") == 1
    return out.select("port_key", "tier", "samples", "predicted", F.greatest(F.lit(0.0), F.when(one, F.col("predicted") * 0.8).otherwise(F.col("p10"))).alias("lower"), F.when(one, F.col("predicted") * 1.2).otherwise(F.col("p90")).alias("upper"), labels.analog_confidence(F.col("tier"), F.col("samples")).alias("confidence"))


def analog_means(df: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, analog): as `seasonal_analog`, for the target days of many questions (question_id, key, target_date) over
    series (key, date, value) at once."""
    both = asked.join(df, "key")
    day, target = F.dayofmonth("date") - F.dayofmonth("target_date"), F.col("target_date")
    month, name, week = F.month("date") == F.month(target), F.weekday("date") == F.weekday(target), F.weekofyear("date") == F.weekofyear(target)
    tiers = [(month & (day == 0), 1), (month & (F.abs(day) <= 2) & name, 2), (week & name, 3), (month & name, 3), (month, 5), (name, 5), (F.lit(True), 1)]
    per = both.groupBy("question_id").agg(*(F.count_if(t).alias(f"n{i}") for i, (t, _) in enumerate(tiers)), *(F.avg(F.when(t, F.col("value"))).alias(f"m{i}") for i, (t, _) in enumerate(tiers)))
    return per.select("question_id", F.coalesce(*(F.when(F.col(f"n{i}") >= least, F.col(f"m{i}")) for i, (_, least) in enumerate(tiers))).alias("analog"))


def backtest(df: DataFrame, least_history: int = 60, test_rows: int = 28, ports: int = 20) -> DataFrame:
    """One-step errors over the last rows of the ports with the largest totals."""
    w = Window.partitionBy("port_key")
    sized = df.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least_history)
    top = sized.groupBy("port_key").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "port_key").limit(ports)
    tested = one_step(sized.join(top.select("port_key"), "port_key", "left_semi")).withColumn("_back", F.row_number().over(w.orderBy(F.desc("date")))).filter(F.col("_back") <= test_rows)
    error = F.abs(F.col("value") - F.col("predicted"))
    return tested.groupBy("port_key").agg(F.count("*").alias("test_points"), F.avg(error).alias("mae"), (F.avg(error / F.greatest(F.abs("value"), F.lit(1.0))) * 100).alias("mape"))


def compare(df: DataFrame, a: str, b: str, weeks: int = 2) -> DataFrame:
    """Mean forecasts of two ports; the first wins a tie."""
    means = horizon(df.filter(F.col("port_key").isin(a, b)), weeks).groupBy("port_key").agg(F.avg("predicted").alias("predicted"))
    return means.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("predicted"), F.when(F.col("port_key") == a, 0).otherwise(1))))


def with_history(df: DataFrame, forecast: DataFrame, tail: int = 120) -> DataFrame:
    """Observed and predicted values as one long table for a chart."""
    seen = series.last_rows(df, ["port_key"], [F.desc("date")], tail).select("port_key", "date", F.lit("actual").alias("series"), "value")
    return seen.unionByName(forecast.select("port_key", "date", F.lit("predicted").alias("series"), F.col("predicted").alias("value")))


def pivoted(long: DataFrame) -> DataFrame:
    return long.groupBy("port_key", "date").pivot("series", ["actual", "predicted"]).agg(F.avg("value"))
