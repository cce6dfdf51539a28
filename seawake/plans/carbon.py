"""The emission inventory: calls joined to positions, modes, durations, emissions, segments and their aggregates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.functions import emission, labels, text
from seawake.operators import blocks, quantiles, series
from seawake.plans import tracks
from seawake.session import kept

CALL = ["call_id", "arrival_time", "departure_time", "port_key", "port_label"]
#: The factors in canonical form with the rules beside them: its hash, and so every evidence id, changes with any of them.
PARAMS = json.dumps({"vessels": emission.VESSELS, "modes": emission.MODES, "fuels": emission.FUELS}, sort_keys=True, separators=(",", ":")) + "|mode rules v1|closed form"


def inside_calls(positions: DataFrame, calls: DataFrame) -> DataFrame:
    """Positions with the call they fall into: the last arrival at or before them, if its departure is not past."""
    p = positions.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumnRenamed("port_key", "destination_norm").drop("port_label")  # in blocks of days, like the deltas
    out = series.asof(p, calls.select("mmsi", "call_no", *CALL), "mmsi", "timestamp", "arrival_time", CALL, "call_no")
    inside = F.coalesce(F.col("timestamp") <= F.col("departure_time"), F.lit(False))
    return out.withColumn("inside_call", inside).withColumns({c: F.when(F.col("inside_call"), F.col(c)) for c in CALL})


def modes(rows: DataFrame) -> DataFrame:
    """Transit, manoeuvring, berth or anchorage by speed and by the hours around arrival and departure; from the time at
    the berth on, where the rows have one, berth."""
    c, h = F.col, lambda n: F.expr(f"interval {n} hours")
    out = rows.withColumn("speed_kn", F.greatest(F.coalesce("speed", "speed_estimated_kn", F.lit(0.0)), F.lit(0.0))).withColumn("speed_interpolated", c("speed").isNull() & c("speed_estimated_kn").isNotNull())
    t, v = c("timestamp"), c("speed_kn")
    near = t.between(c("arrival_time") - h(2), c("arrival_time") + h(1)) | t.between(c("departure_time") - h(1), c("departure_time") + h(2))
    moored = F.coalesce(t >= c("berth_timestamp"), F.lit(False)) if "berth_timestamp" in rows.columns else F.lit(False)
    mode = F.when(~c("inside_call"), "transit").when(v.between(0.5, 8.0) & near, "manoeuvring").when((v <= 0.5) | moored, "berth").when(v <= 2.0, "anchorage").otherwise("transit")
    return out.withColumn("mode", mode)


def durations(rows: DataFrame) -> DataFrame:
    """Hours to the next report; beyond six or below zero the vessel's median of the plausible ones, ten minutes if none."""
    c = F.col
    raw = rows.withColumn("duration_h_raw", series.seconds(c("timestamp"), c("_next_time").cast("timestamp")) / 3600).drop("_next_time")
    middle = quantiles.quantiles(raw.filter((c("duration_h_raw") > 0) & (c("duration_h_raw") <= 2)), ["mmsi"], "duration_h_raw", [0.5])
    middle = middle.select(c("mmsi").alias("_mmsi"), F.get("quantiles", 0).alias("_median"))
    out = raw.join(middle, c("mmsi").eqNullSafe(c("_mmsi")), "left")
    sane = F.when((c("duration_h_raw") > 0) & (c("duration_h_raw") <= 6), c("duration_h_raw")).otherwise(c("_median"))
    out = out.withColumn("duration_h", F.least(F.greatest(F.coalesce(sane, F.lit(1 / 6)), F.lit(1 / 120)), F.lit(6.0))).drop("_mmsi", "_median")
    return out.withColumn("ais_gap_flag", c("duration_h") > 0.5)


def row_emissions(spark: SparkSession, positions: DataFrame, calls: DataFrame) -> DataFrame:
    """Emissions of every position row. What calls, neighbours and modes say of a row is computed once and kept, as the
    medians of the vessels are taken from it before they go into it."""
    within = inside_calls(positions, calls)
    rows = durations(kept(modes(tracks.deltas(within, positions.withColumn("timestamp", F.col("timestamp").cast("timestamp"))))))
    rows = rows.withColumn("vessel_class", text.vessel_class(F.col("vessel_type_norm"))).join(F.broadcast(emission.factor_table(spark)), ["vessel_class", "mode"])  # 24 rows
    rows = emission.with_emissions(rows).withColumn("fallback_flag", emission.is_fallback())
    return rows.withColumn("rel_sigma", emission.relative_sigma(F.col("speed_interpolated"), F.col("ais_gap_flag"), F.col("fallback_flag")))


def segmented(rows: DataFrame) -> DataFrame:
    """Rows with their segment: a new one where mode or call changes, or after a gap of half an hour."""
    lag = lambda c: F.col(f"_prev.{c}")
    beside = blocks.neighbours(rows, "mmsi", tracks.ORDER, ["mode", "call_id", "duration_h"])
    starts = lag("mode").isNull() | (F.col("mode") != lag("mode")) | (F.coalesce("call_id", F.lit("")) != F.coalesce(lag("call_id"), F.lit(""))) | (F.coalesce(lag("duration_h"), F.lit(0.0)) > 0.5)
    flagged = beside.withColumn("_start", starts).drop("_prev", "_next")
    out = series.islands(flagged, "mmsi", tracks.ORDER, F.col("_start"), "segment_ord").drop("_start", blocks.BLOCK)
    return out.withColumn("segment_id", F.concat(F.col("mmsi"), F.lit("_seg_"), F.lpad(F.col("segment_ord").cast("string"), 6, "0")))


def segments(rows: DataFrame) -> DataFrame:
    """One row per segment with sums, ratios, bounds, confidence and evidence id."""
    order = F.struct("timestamp", "position_id")
    first = lambda c, n=None: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(n or c)
    ratio = lambda c, n: F.avg(F.col(c).cast("double")).alias(n)
    out = segmented(rows).groupBy("segment_id", "mmsi").agg(
        *map(first, ("call_id", "mode", "vessel_class", "engine_family", "fuel_type", "port_key", "port_label", "destination_norm")),
        F.min("timestamp").alias("timestamp_start"), F.max("timestamp").alias("timestamp_end"), F.count("*").alias("row_count"),
        F.min_by("position_id", order).cast("string").alias("input_row_start_id"), F.max_by("position_id", order).cast("string").alias("input_row_end_id"), F.sum("duration_h").alias("duration_h"),
        ratio("ais_gap_flag", "ais_gap_ratio"), ratio("speed_interpolated", "interpolation_ratio"), ratio("fallback_flag", "fallback_usage_ratio"), F.avg("rel_sigma").alias("rel_sigma_weighted"),
        F.sum("fuel_t").alias("fuel_t"), *(F.sum(p).alias(p) for p in emission.POLLUTANTS),
    )
    return evidence_ids(intervals(out).withColumn("date", F.col("timestamp_start").cast("date")))


def intervals(df: DataFrame, fallback: str = "fallback_usage_ratio") -> DataFrame:
    """Bounds of every pollutant, the relative width of the interval, and the confidence label."""
    out = df.select("*", *(b for p in emission.POLLUTANTS for b in emission.bounds(p, F.col("rel_sigma_weighted"))))
    out = out.withColumn("ci_width_rel", F.coalesce((F.col("wtw_co2e_t_upper") - F.col("wtw_co2e_t_lower")) / F.nullif(F.col("wtw_co2e_t"), F.lit(0.0)), F.lit(0.0)))
    return out.withColumn("confidence_label", labels.confidence(F.col("ci_width_rel"), F.col(fallback)))


def evidence_ids(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.lit(PARAMS), 256)
    return df.withColumn("params_hash", digest).withColumn("evidence_id", F.substring(F.sha1(F.concat_ws("|", "segment_id", digest)), 1, 24))


def aggregate(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Segments summed over keys, with bounds."""
    out = segs.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.sum("duration_h").alias("duration_h"), F.sum("row_count").alias("row_count"), F.avg("ais_gap_ratio").alias("ais_gap_ratio"), F.avg("interpolation_ratio").alias("interpolation_ratio"),
        F.avg("fallback_usage_ratio").alias("fallback_usage_ratio"), F.avg("rel_sigma_weighted").alias("rel_sigma_weighted"), *(F.sum(p).alias(p) for p in emission.POLLUTANTS),
    )
    return intervals(out)


def sampled_intervals(df: DataFrame, keys: list[str], seed: int = 42, draws: int = emission.DRAWS) -> DataFrame:
    """Aggregates with bounds from seeded draws of clipped normals around each total instead of the closed form.

    The draws of a row and pollutant depend on the seed, the pollutant and the row's keys alone (by their MD5), so they are
    the same on any cluster and whatever rows are beside it. A row needs `draws` numbers for each pollutant, a batch a
    bounded number of rows at a time.
    """
    plain = df.drop(*(f"{p}{s}" for p in emission.POLLUTANTS for s in ("_lower", "_upper")), "ci_width_rel", "confidence_label")
    code = lambda p: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(p), *(F.col(k).cast("string") for k in keys)))
    word = lambda p, at: F.conv(F.substring(code(p), at, 8), 16, 10).cast("long")
    rows = plain.withColumn("_seeds", F.array(*(word(p, at) for p in emission.POLLUTANTS for at in (1, 9))))
    names, n = plain.columns, len(emission.POLLUTANTS)
    at = [names.index(p) for p in emission.POLLUTANTS]
    sigma_at = names.index("rel_sigma_weighted")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, len(whole), 2048)):
                seeds = batch.column(len(names)).flatten().to_numpy().reshape(-1, 2 * n)
                number = lambda i: pc.fill_null(batch.column(i), 0.0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                bounds = [b for j, i in enumerate(at) for b in emission.sampled_bounds(number(i), number(sigma_at), seeds[:, 2 * j], seeds[:, 2 * j + 1], draws)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, bounds)], [*names, *(f"{p}{s}" for p in emission.POLLUTANTS for s in ("_lower", "_upper"))])

    kind = T.StructType([*plain.schema.fields, *(T.StructField(f"{p}{s}", T.DoubleType()) for p in emission.POLLUTANTS for s in ("_lower", "_upper"))])
    out = rows.mapInArrow(task, kind)
    either = lambda s: F.coalesce(F.when(F.col(f"wtw_co2e_t{s}") > 0, F.col(f"wtw_co2e_t{s}")).otherwise(F.col(f"co2_t{s}")), F.lit(0.0))
    width = F.when(either("") > 0, (either("_upper") - either("_lower")) / either("")).otherwise(1.0)
    out = out.withColumn("ci_width_rel", width).withColumn("confidence_label", labels.confidence(F.col("ci_width_rel"), F.col("fallback_usage_ratio")))
    coverage = 1 - F.least(F.lit(1.0), F.col("ais_gap_ratio"))
    return out.withColumn("confidence_reason", F.format_string("interval %.2f, defaults %.2f, coverage %.2f", "ci_width_rel", "fallback_usage_ratio", coverage))


def summed(segs: DataFrame) -> DataFrame:
    """Of segments what sums over days, calls and ports read, computed once."""
    bounds = (f"{p}{s}" for p in ("ttw_co2e_t", "wtw_co2e_t") for s in ("_lower", "_upper"))
    ratios = ("ais_gap_ratio", "interpolation_ratio", "fallback_usage_ratio", "rel_sigma_weighted")
    return kept(segs.select("call_id", "mmsi", "port_key", "port_label", "destination_norm", "date", "duration_h", "row_count", *ratios, *emission.POLLUTANTS, *bounds))


def daily_port(segs: DataFrame) -> DataFrame:
    """Per day and port; segments outside calls count for the port they head for."""
    proxy = segs.withColumn("port_key", F.coalesce("port_key", "destination_norm"))
    return aggregate(proxy, ["date", "port_key"])


def by_call(segs: DataFrame) -> DataFrame:
    return aggregate(segs.filter(F.coalesce("call_id", F.lit("")) != ""), ["call_id", "mmsi", "port_key", "port_label"])


def by_month(segs: DataFrame) -> DataFrame:
    linked = segs.filter(F.coalesce("call_id", F.lit("")) != "")
    return aggregate(linked.withColumn("month", F.date_format("date", "yyyy-MM")), ["month", "port_key"])


def scope(df: DataFrame, port: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a port (key equal, equal without punctuation, or contained) and of whole days from start to end."""
    if port:
        p = "".join(ch for ch in port.upper() if ch.isalnum())
        key = text.alnum(F.col("port_key"))
        df = df.filter((F.upper("port_key") == port.upper()) | (key == p) | key.contains(p))
    if start:
        df = df.filter(F.col("date") >= start)
    return df.filter(F.col("date") <= end) if end else df


def uncertainty(df: DataFrame) -> DataFrame:
    """Sum and summed bounds per pollutant, as rows."""
    sums = df.agg(*(F.sum(f"{p}{s}").alias(f"{p}{s}") for p in emission.POLLUTANTS for s in ("", "_lower", "_upper")))
    rows = F.array(*(F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("point"), F.col(f"{p}_lower").alias("lower"), F.col(f"{p}_upper").alias("upper")) for p in emission.POLLUTANTS))
    return sums.select(F.inline(rows))


def diagnostics(calls: DataFrame, high_t: float = 50.0) -> DataFrame:
    """How a scope's calls are spread, and whether the total can be trusted. The calls are computed once."""
    calls = kept(calls.select("call_id", "wtw_co2e_t"))
    out = calls.agg(F.countDistinct("call_id").alias("unique_calls"), F.count("*").alias("rows"), F.sum("wtw_co2e_t").alias("total_t"), F.max("wtw_co2e_t").alias("max_t"))
    out = out.crossJoin(quantiles.quantile(calls, F.col("wtw_co2e_t"), [0.5]).select(F.get("quantiles", 0).alias("median_t")))  # one row with one row
    return out.withColumn("duplicate_rows", F.col("rows") - F.col("unique_calls")).withColumn("sanity", F.when(F.col("unique_calls") == 0, "no calls").when(F.col("duplicate_rows") > 0, "duplicates").when(F.col("max_t") > high_t, "high call").otherwise("ok"))


def trace(segs: DataFrame) -> DataFrame:
    """The modes a call is made of."""
    linked = segs.filter(F.coalesce("call_id", F.lit("")) != "")
    return linked.groupBy("call_id").agg(F.min("timestamp_start").alias("first"), F.max("timestamp_end").alias("last"), F.sum("duration_h").alias("duration_h"), F.sum("wtw_co2e_t").alias("wtw_co2e_t"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


def find_call(calls: DataFrame, call_id: str) -> DataFrame:
    """The call of exactly this id, else of the same letters and digits if that is only one."""
    key = "".join(ch for ch in call_id.upper() if ch.isalnum())
    near = calls.filter(text.alnum(F.col("call_id")) == key).withColumn("_exact", F.col("call_id") == call_id)
    w = Window.partitionBy(F.lit(1))  # the rows of one call id
    return near.withColumn("_any", F.max("_exact").over(w)).withColumn("_n", F.size(F.collect_set("call_id").over(w))).filter(F.col("_exact") | (~F.col("_any") & (F.col("_n") == 1))).drop("_exact", "_any", "_n")


def scenarios(spark: SparkSession, assumed: DataFrame, sigma: float = 0.30) -> DataFrame:
    """Emissions of assumed stays (vessel_type, mode, duration_h, speed_kn), any number of them; other columns stay. Stays in
    an unknown mode have no row."""
    rows = assumed.withColumn("vessel_class", text.vessel_class(F.col("vessel_type"))).join(F.broadcast(emission.factor_table(spark)), ["vessel_class", "mode"])  # 24 rows
    out = emission.with_emissions(rows).withColumn("rel_sigma_weighted", F.lit(sigma))
    return out.select(*assumed.columns, "vessel_class", "load_factor", "fuel_t", *emission.POLLUTANTS, *(b for p in emission.POLLUTANTS for b in emission.bounds(p, F.col("rel_sigma_weighted"))))


def scenario(spark: SparkSession, vessel_type: str, mode: str, hours: float, speed_kn: float, sigma: float = 0.30) -> DataFrame:
    """Emissions of one assumed stay, as one row."""
    row = spark.createDataFrame([(vessel_type, mode, float(hours), float(speed_kn))], "vessel_type string, mode string, duration_h double, speed_kn double")
    return scenarios(spark, row, sigma).drop("vessel_type", "duration_h", "speed_kn")


def intensities(calls: DataFrame) -> DataFrame:
    """Total, kg per call and kg per hour."""
    t = F.sum("wtw_co2e_t")
    return calls.agg(t.alias("total_t"), (t * 1000 / F.nullif(F.countDistinct("call_id"), F.lit(0))).alias("kg_per_call"), (t * 1000 / F.nullif(F.sum("duration_h"), F.lit(0.0))).alias("kg_per_hour"))


def bands(daily: DataFrame, value: str = "wtw_co2e_t") -> DataFrame:
    """Every row with its band between the quartiles of all rows, which are computed once."""
    daily = kept(daily)
    q = quantiles.quantile(daily, F.col(value), [0.25, 0.5, 0.75], "_q")
    out = daily.crossJoin(q)  # with one row
    return out.withColumn("band", labels.band(F.col(value), F.col("_q")[0], F.col("_q")[1], F.col("_q")[2])).drop("_q")


def findings(daily: DataFrame) -> DataFrame:
    """Highest day and the largest rise and drop from one day with data to the next."""
    total = daily.groupBy("date").agg(F.sum("wtw_co2e_t").alias("v"))
    months = total.withColumn("month", F.date_format("date", "yyyy-MM"))
    d = months.withColumn("change", F.col("v") - F.lag("v").over(Window.partitionBy("month").orderBy("date")))
    pick = lambda f, c: f("date", F.struct(c, -F.unix_date("date")))
    return d.groupBy("month").agg(F.max_by("date", F.struct("v", -F.unix_date("date"))).alias("highest"), pick(F.max_by, "change").alias("largest_rise"), F.min_by("date", F.when(F.col("change").isNotNull(), F.struct("change", F.unix_date("date")))).alias("largest_drop"))


def nearest_period(daily: DataFrame, when: str) -> DataFrame:
    """The day nearest to a date, the earlier of two."""
    return daily.orderBy(F.abs(F.datediff("date", F.lit(when).cast("date"))), "date", "port_key").limit(1)
