"""Session defaults. A cluster's own settings win: only what is unset is set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "seawake", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; keywords use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which all executors share; where none is named, one beside the warehouse,
    and only if driver and executors are one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints")
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
