"""The domain tables over the star-schema test tables: port calls from orders or purchases, positions from other events.

Everything is arithmetic that another engine can repeat, so every query over it can be checked there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vessel types by user number.
VESSEL_BY_USER = ("oil tanker", "bulk carrier", "container ship", "passenger", "tug", "other")
MOORED_DAYS = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _port(name: str = "n_name") -> list:
    return [F.replace(F.upper(name), F.lit(" "), F.lit("_")).alias("port_key"), F.col(name).alias("port_label")]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals: one call per order, at the customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(F.col("o_custkey").cast("string").alias("mmsi"), *_port(), F.col("o_orderdate").alias("arrival_time"), F.lower("c_mktsegment").alias("vessel_type_norm"), "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of up to 45 days: an order's date to a line's shipping date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("departure_time"))
    both = calls(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    minutes = (F.unix_micros(F.col("departure_time").cast("timestamp")) - F.unix_micros(F.col("arrival_time").cast("timestamp"))) / 6e7
    return both.withColumn("dwell_minutes", minutes).filter((F.col("dwell_minutes") > 0) & (F.col("dwell_minutes") <= MOORED_DAYS * 1440)).drop("l_orderkey")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports: every event that is no purchase."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e = e.filter(F.col("event_type") != "purchase").withColumn("_n", (F.col("user_id") % 25).cast("int"))
    u, i = F.col("user_id"), F.col("event_id")
    kinds = F.array(*map(F.lit, VESSEL_BY_USER))
    return e.join(n, F.col("_n") == F.col("n_nationkey")).select(
        i.alias("position_id"), u.cast("string").alias("mmsi"), F.col("ts").alias("timestamp"), (F.col("value") / 10).alias("speed"), (F.lit(54.0) + (u % 10) * 0.5 + (i % 97) / 400.0).alias("latitude"),
        (F.lit(10.0) + (u % 7) + (i % 89) / 400.0).alias("longitude"), ((i * 37) % 360).cast("double").alias("course"), F.col("n_name").alias("destination_raw"), F.element_at(kinds, (u % 6).cast("int") + 1).alias("vessel_type_norm"), *_port(),
    )


def port_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with hours: purchases; the stay is proportional to the value."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e = e.filter(F.col("event_type") == "purchase").withColumn("_n", (F.col("user_id") % 25).cast("int"))
    u = F.col("user_id")
    kinds = F.array(*map(F.lit, VESSEL_BY_USER))
    departure = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 720).cast("long") * 1_000_000)
    out = e.join(n, F.col("_n") == F.col("n_nationkey")).select(
        F.col("event_id").alias("call_no"), u.cast("string").alias("mmsi"), F.col("ts").cast("timestamp").alias("arrival_time"), departure.alias("departure_time"), *_port(), F.element_at(kinds, (u % 6).cast("int") + 1).alias("vessel_type_norm"),
        F.element_at(F.array(F.lit("SEGOT"), F.lit("LVRIX"), F.lit("DEKEL")), (F.col("event_id") % 3).cast("int") + 1).alias("origin"), F.element_at(F.array(F.lit("LTKLJ"), F.lit("DETRV")), (F.col("event_id") % 2).cast("int") + 1).alias("next_port"),
    )
    return out.withColumn("call_id", F.concat_ws("_", "mmsi", F.date_format("arrival_time", "yyyy-MM-dd'T'HH-mm-ss"), "port_key"))
