"""Stored marts that are brought up to date unit by unit.

A mart is a Parquet folder with a sub-folder for each unit: a day, or a bucket of vessels where a row depends on its vessel's
history. Beside it lies, for each unit, a fingerprint of the source rows that it was built from. A refresh reads the
source once for fingerprints, builds the units whose fingerprint has changed, and replaces their folders only; units that the source
no longer has become empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.session import kept
from seawake.sources.feeds import path_exists

#: Changed units that may be named in a filter of the source; more are joined.
NAMED = 1000


def bucket(key: str, n: int = 64) -> Column:
    """The unit of a vessel: one of `n` buckets by its hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def fingerprints(source: DataFrame, unit: str) -> DataFrame:
    """(unit, rows, mark): a mark of the rows of each unit that does not depend on their order, but on repeats."""
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in source.columns))
    return source.groupBy(unit).agg(F.count("*").alias("rows"), F.sum(F.shiftrightunsigned(whole, 16).cast("decimal(38,0)")).cast("string").alias("mark"))


def refresh(source: DataFrame, unit: str, build: Callable[[DataFrame], DataFrame], path: str) -> list:
    """Brings the mart at `path` up to date with `source`; returns the units that were built anew.

    `build` makes the mart's rows, with the unit's column, from all source rows of some units. Rows of a null unit are left out.
    A unit is written before its fingerprint, so one whose writing was cut off is built again.
    """
    spark = source.sparkSession
    source = source.filter(F.col(unit).isNotNull())
    now = kept(fingerprints(source, unit))
    known = spark.read.parquet(f"{path}/state") if path_exists(spark, f"{path}/state") else now.limit(0)
    known = kept(known)
    both = now.withColumnRenamed("mark", "new").join(known.select(unit, F.col("mark").alias("old")), unit, "full_outer")
    changed = [r[unit] for r in both.filter(~F.col("new").eqNullSafe(F.col("old"))).select(unit).collect()]  # a row for each unit
    if not changed:
        return []
    keys = spark.createDataFrame([(u,) for u in changed], spark.createDataFrame([], source.select(unit).schema).schema)
    part = source.filter(F.col(unit).isin(changed)) if len(changed) <= NAMED else source.join(F.broadcast(keys), unit, "left_semi")
    rows = build(part)
    gone = keys.join(now.select(unit), unit, "left_anti")
    rows = kept(rows.withColumn("_real", F.lit(True)).unionByName(gone.withColumn("_real", F.lit(False)), allowMissingColumns=True))
    empty = keys.join(rows.select(unit).distinct(), unit, "left_anti").withColumn("_real", F.lit(False))  # units that have no row of the mart
    rows = rows.unionByName(empty, allowMissingColumns=True)
    rows.repartition(unit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(f"{path}/rows")
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    return changed


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a mart."""
    return spark.read.parquet(f"{path}/rows").filter("_real").drop("_real")
