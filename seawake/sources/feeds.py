"""Raw feeds and stores: CSV feeds, marts as Parquet, chunks as JSON lines, exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.functions import text

# The columns by which a feed is recognised.
POSITION_COLUMNS = "MMSI TimePosition Latitude Longitude Speed Course Heading NavStatus IMO Name Callsign Flag VesselType Destination TimeETA Draught".split()
CALL_COLUMNS = "portID portName portLocode portArrival portDeparture vesselMMSI vesselIMO vesselName vesselDestinationArrival vesselDestinationDeparture vesselType".split()


def read_csv(spark: SparkSession, path: str, limit: int | None = None, infer: bool = False) -> DataFrame:
    """A headered CSV feed, every column text unless `infer`."""
    df = spark.read.csv(path, header=True, inferSchema=infer, multiLine=False)
    return df if limit is None else df.limit(limit)


def feed_kind(columns: list[str]) -> str | None:
    """`position` or `call` by how many known columns there are."""
    have = {*columns}
    if len(have & {*POSITION_COLUMNS}) >= 8:
        return "position"
    return "call" if len(have & {*CALL_COLUMNS}) >= 6 else None


def with_columns(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    """`df` with nulls for what it lacks."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_mart(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A Parquet mart, or an empty one with its schema where the path does not exist yet."""
    df = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def write_mart(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def ensure_mart(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition: list[str] | None = None) -> DataFrame:
    """The mart at `path`, built and written first if there is nothing there; one that cannot be read is an error."""
    if not path_exists(spark, path):
        write_mart(build(), path, partition)
    return spark.read.parquet(path)


def write_manifest(facts: DataFrame, path: str) -> None:
    """Facts about a table, one row, as one JSON file."""
    facts.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def clean_positions(raw: DataFrame, source: str) -> DataFrame:
    """Typed and valid position rows of a raw feed (rules for nulls: missing text is empty or `unknown`)."""
    c, df = F.col, with_columns(raw, POSITION_COLUMNS)
    out = df.select(
        text.identifier(c("MMSI")).alias("mmsi"), text.identifier(c("IMO")).alias("imo"), text.moment(c("TimePosition")).alias("timestamp"), text.number(c("Latitude")).alias("latitude"),
        text.number(c("Longitude")).alias("longitude"), text.number(c("Speed")).alias("speed"), text.number(c("Course")).alias("course"), text.number(c("Heading")).alias("heading"),
        text.number(c("Draught")).alias("draught"), text.vessel_type(c("VesselType")).alias("vessel_type_norm"), text.named(c("Flag")).alias("flag_norm"), text.named(c("NavStatus")).alias("nav_status_norm"),
        c("Destination").alias("destination_raw"), text.destination(c("Destination")).alias("destination_norm"), text.moment(c("TimeETA")).alias("eta_time"), F.lit(source).alias("source_file"),
    )
    out = out.filter(c("timestamp").isNotNull() & (c("mmsi") != "") & c("latitude").between(-90, 90) & c("longitude").between(-180, 180))
    return out.withColumn("stable_id", F.format_string("%s_%s_%.5f_%.5f", "mmsi", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), "latitude", "longitude"))


def clean_calls(raw: DataFrame, source: str) -> DataFrame:
    """Typed port calls of a raw feed with their port key and label."""
    c, df = F.col, with_columns(raw, CALL_COLUMNS)
    out = df.select(
        text.identifier(c("vesselMMSI")).alias("mmsi"), text.identifier(c("vesselIMO")).alias("imo"), text.port_key(c("portLocode"), c("portName")).alias("port_key"),
        text.port_label(c("portLocode"), c("portName")).alias("port_label"), text.locode(c("portLocode")).alias("locode_norm"), text.named(c("portName")).alias("port_name_norm"),
        text.vessel_type(c("vesselType")).alias("vessel_type_norm"), text.moment(c("portArrival")).alias("arrival_time"), text.moment(c("portDeparture")).alias("departure_time"),
        text.destination(c("vesselDestinationArrival")).alias("destination_arrival"), text.destination(c("vesselDestinationDeparture")).alias("destination_departure"), F.lit(source).alias("source_file"),
    )
    return out.filter(c("arrival_time").isNotNull() & (c("mmsi") != "") & (c("port_key") != "") & (c("port_key") != "UNKNOWN"))


def ingest(feeds: list[tuple[str, DataFrame]]) -> tuple[DataFrame | None, DataFrame | None]:
    """The positions and the calls of several raw feeds, each recognised by its columns; unknown feeds are left out."""
    found: dict[str, list[DataFrame]] = {"position": [], "call": []}
    for name, df in feeds:
        if kind := feed_kind(df.columns):
            found[kind].append((clean_positions if kind == "position" else clean_calls)(df, name))
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return tuple(reduce(union, found[k]) if found[k] else None for k in ("position", "call"))


def latest_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert semantics: the last row of each id."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def number_repeats(df: DataFrame, key: str, order: str, name: str = "unique_id") -> DataFrame:
    """Ids made unique: `_1`, `_2`, ... for the second and later rows of an id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn(name, F.when(n == 0, F.col(key).cast("string")).otherwise(F.concat_ws("_", F.col(key).cast("string"), n.cast("string"))))
