"""Answers to a whole table of questions: each is routed to a plan, and all plans return rows of one shape.

Every mart is read once for all questions that need it. A question is about one port or about all (`*`); marts are summed by
port and over all ports before they meet the questions, so the join is on the port and a question meets as many rows as its
days, not as there are reports. Results are (question_id, state, value, second, label, n): what they mean depends on the
route (see `ROUTES`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seawake.functions import emission, labels, text
from seawake.operators import quantiles
from seawake.plans import answers, carbon, forecast, kpi, questions, retrieval, tracks
from seawake.session import kept

#: What value, second, label and n are, by route.
ROUTES = {
    "arrivals": "arrivals; -; -; days", "peak_day": "arrivals; -; day; days", "compare_weekdays": "arrivals of the first; of the second; the busier; days", "busiest_weekday": "arrivals; -; weekday; days",
    "top_ports": "arrivals; -; port; ports", "compare_ports": "metric of the first; -; port; ports", "busiest_hour": "arrivals; -; hour; hours with any", "dwell": "mean minutes; median; -; stays",
    "port_stays": "hours; -; port of most; stays", "congestion": "mean index; highest; its day; days", "forecast_date": "index; -; method; -", "forecast_weekday": "index; -; level; days", "diagnose": "arrivals of a type; its median dwell; type; types",
    "spikes": "-; -; -; spikes", "jumps": "longest km; -; -; jumps", "port_by_day": "t CO2e or the pollutant; -; mode; calls", "port_by_month": "the same; -; mode; calls", "call": "t CO2e; -; reason; -",
    "estimate": "t CO2e; -; class; -", "forecast_only": "-", "unsupported": "-",
}
ALL = "*"
SHAPE = "question_id long, state string, value double, second double, label string, n long"


def _says(c: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def routed(understood: DataFrame) -> DataFrame:
    """`understood` questions with their route."""
    q, c = F.lower("question"), F.col
    dated = c("date_from").isNotNull() | c("date_to").isNotNull()
    emissions = (
        F.when(c("call_id").isNotNull() & c("mmsi").isNotNull(), "call").when(c("carbon_route") == "estimate", "estimate")
        .when(_says(q, "forecast", "predict", "expected", "future", "next", "coming", "will") & ~dated, "forecast_only").when(_says(q, "monthly", "per month"), "port_by_month").otherwise("port_by_day")
    )
    plain = (
        F.when(c("aggregation") == "peak_day", "peak_day").when(c("mmsi").isNotNull() & _says(q, "how long", "dwell", "in port", "port stay", "stayed"), "port_stays").when(_says(q, "top") & _says(q, "port"), "top_ports")
        .when(_says(q, "dwell"), "dwell").when(_says(q, "congestion"), "congestion").otherwise("arrivals")
    )
    pattern = F.when(c("aggregation") == "peak_day", "peak_day").when(c("dow").isNotNull() & c("dow_compare").isNotNull(), "compare_weekdays").when(_says(q, "hour"), "busiest_hour").otherwise("busiest_weekday")
    by_kind = {"G": F.lit("unsupported"), "H": emissions, "A": plain, "B": pattern, "C": F.when(c("target_date").isNotNull(), "forecast_date").otherwise("forecast_weekday"), "D": F.lit("compare_ports"), "E": F.lit("diagnose"), "F": F.when(_says(q, "jump", "spoof", "teleport", "impossible"), "jumps").otherwise("spikes")}
    return understood.withColumn("route", F.coalesce(*(F.when(c("intent") == k, r) for k, r in by_kind.items())))


def scoped(asked: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """Questions (question_id, question, user_port, user_from, user_to) understood, routed, and with the port they are about:
    the first of what the user chose and what the question names that the catalog knows, `*` for none."""
    u = routed(questions.understood(asked, today))
    named = F.filter(F.split("ports", ","), lambda p: p != "")
    tokens = F.concat(
        F.array(F.struct(F.lit(0).alias("place"), F.lit("user_filter").alias("source"), F.col("user_port").alias("token")), F.struct(F.lit(1).alias("place"), F.lit("entity_primary").alias("source"), F.col("port").alias("token"))),
        F.transform(named, lambda p, i: F.struct((i + 2).alias("place"), F.lit("entity_port").alias("source"), p.alias("token"))),
    )
    u = kept(u)
    scopes = retrieval.resolve_scopes(u.select(F.col("question_id").alias("question"), F.inline(tokens)), catalog).select(F.col("question").alias("question_id"), F.col("port").alias("scope_port"))
    out = u.join(scopes, "question_id", "left").withColumn("key", F.coalesce("scope_port", F.lit(ALL)))
    weeks = F.regexp_extract(F.coalesce("window", F.lit("")), r"(\d+)", 1)
    return out.withColumns({"first_day": F.coalesce("user_from", "date_from"), "last_day": F.coalesce("user_to", "date_to"), "last_weeks": F.when(weeks != "", weeks.cast("int"))}).drop("scope_port")


def _both(df: DataFrame, keys: list[str], values: list[Column], port: str = "port_key") -> DataFrame:
    """Rows summed by port and over all ports, under `key`."""
    return df.groupBy(F.col(port).alias("key"), *keys).agg(*values).unionByName(df.groupBy(F.lit(ALL).alias("key"), *keys).agg(*values))


def _on(routes: list[str], asked: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each question's port and days; of the last weeks up to its latest day where it asks for these."""
    q = asked.filter(F.col("route").isin(routes)).select("question_id", "key", "route", "first_day", "last_day", "last_weeks", *columns)
    inside = (F.col("first_day").isNull() | (F.col("date") >= F.col("first_day"))) & (F.col("last_day").isNull() | (F.col("date") <= F.col("last_day")))
    met = q.join(rows, "key").filter(inside)
    latest = F.max("date").over(Window.partitionBy("question_id"))
    return met.withColumn("_latest", latest).filter(F.col("last_weeks").isNull() | (F.col("date") >= F.date_sub("_latest", F.col("last_weeks") * 7))).drop("_latest")


def _row(df: DataFrame, value: Column | None = None, second: Column | None = None, label: Column | None = None, n: Column | None = None, state: Column | None = None) -> DataFrame:
    none = F.lit(None)
    pick = lambda c, kind: (none if c is None else c).cast(kind)
    return df.select("question_id", (F.lit("OK") if state is None else state).alias("state"), pick(value, "double").alias("value"), pick(second, "double").alias("second"), pick(label, "string").alias("label"), pick(n, "long").alias("n"))


def from_arrivals(asked: DataFrame, daily: DataFrame) -> list[DataFrame]:
    """Everything that is said by arrivals per day."""
    v = F.sum("arrivals_vessels").alias("v")
    met = _on(["arrivals", "peak_day", "compare_weekdays", "busiest_weekday"], asked, _both(daily, ["date", "vessel_type_norm"], [v]), "vessel_type", "dow", "dow_compare")
    met = met.filter(F.col("vessel_type").isNull() | F.contains("vessel_type_norm", "vessel_type"))
    name = F.date_format("date", "EEEE")
    met = met.filter((F.col("route") != "arrivals") | F.col("dow").isNull() | (F.col("dow") == name) | (F.col("dow").isin("Weekend") & (F.weekday("date") >= 5)) | (F.col("dow").isin("Weekday") & (F.weekday("date") < 5)))
    days = met.groupBy("question_id", "route", "dow", "dow_compare", "date").agg(F.sum("v").alias("v"))
    week = [F.sum(F.when(name == d.title(), F.col("v"))).alias(d) for d in questions.DAYS]
    per = days.groupBy("question_id", "route", "dow", "dow_compare").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.max("v").alias("most"), F.max_by("date", F.struct("v", -F.unix_date("date"))).alias("day"), *week)
    sums = F.array(*(F.struct(F.col(d).alias("v"), F.lit(d.title()).alias("d")) for d in questions.DAYS))
    of = lambda c: F.element_at(F.filter(sums, lambda s: s["d"] == F.col(c)), 1)["v"]
    held = F.filter(sums, lambda s: s["v"].isNotNull())
    top = F.element_at(F.array_sort(F.transform(held, lambda s: F.struct((-s["v"]).alias("v"), s["d"].alias("d")))), 1)
    r = F.col("route")
    compare = (r == "compare_weekdays") & of("dow").isNotNull() & of("dow_compare").isNotNull()
    value = F.when(r == "arrivals", F.col("total")).when(r == "peak_day", F.col("most")).when(compare, of("dow")).when(r == "busiest_weekday", -top["v"])
    label = F.when(r == "peak_day", F.col("day").cast("string")).when(compare, F.when(of("dow") > of("dow_compare"), F.col("dow")).otherwise(F.col("dow_compare"))).when(r == "busiest_weekday", top["d"])
    out = [_row(per.filter((r != "compare_weekdays") | compare), value, F.when(compare, of("dow_compare")), label, F.col("n"))]

    by_port = daily.groupBy(F.lit(ALL).alias("key"), "port_key", "date", "vessel_type_norm").agg(v)
    every = asked.withColumn("key", F.lit(ALL))  # the port of the question is not asked for
    ports = _on(["top_ports"], every, by_port, "vessel_type").filter(F.col("vessel_type").isNull() | F.contains("vessel_type_norm", "vessel_type")).groupBy("question_id", "port_key").agg(F.sum("v").alias("v"))
    best = ports.groupBy("question_id").agg(F.min_by("port_key", F.struct(-F.col("v"), "port_key")).alias("port"), F.max("v").alias("v"), F.count("*").alias("n"))
    out.append(_row(best, F.col("v"), None, F.col("port"), F.col("n")))
    spikes = kpi.arrival_spikes(daily)
    spiked = _both(spikes.filter(F.round(F.col("arrivals_vessels") - F.col("threshold"), 9) > 0), ["date"], [F.count("*").alias("c")])
    out.append(_row(_on(["spikes"], asked, spiked).groupBy("question_id").agg(F.sum("c").alias("n")), None, None, None, F.col("n")))
    return out


def from_stays(asked: DataFrame, daily: DataFrame, stays: DataFrame) -> list[DataFrame]:
    """Dwell, one vessel's stays, and what types of vessel make a port busy."""
    s = stays.select(F.col("port_key").alias("key"), F.col("arrival_time").cast("date").alias("date"), "vessel_type_norm", "mmsi", "dwell_minutes")
    s = kept(s.unionByName(s.withColumn("key", F.lit(ALL))))
    typed = _on(["dwell"], asked, s, "vessel_type").filter(F.col("vessel_type").isNull() | F.contains("vessel_type_norm", "vessel_type"))
    means = typed.groupBy("question_id").agg(F.avg("dwell_minutes").alias("mean"), F.count("*").alias("n")).join(quantiles.quantiles(typed, ["question_id"], "dwell_minutes", [0.5]), "question_id")
    out = [_row(means, F.col("mean"), F.get("quantiles", 0), None, F.col("n"))]
    own = asked.filter("route = 'port_stays'").select("question_id", F.col("mmsi").alias("_mmsi"), "first_day", "last_day").join(s.filter(F.col("key") != ALL), F.col("_mmsi") == F.col("mmsi"))
    own = own.filter((F.col("first_day").isNull() | (F.col("date") >= F.col("first_day"))) & (F.col("last_day").isNull() | (F.col("date") <= F.col("last_day"))))
    ports = own.groupBy("question_id", "key").agg(F.sum("dwell_minutes").alias("m"), F.count("*").alias("n"))
    out.append(_row(ports.groupBy("question_id").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.min_by("key", F.struct(-F.col("m"), "key")).alias("port")), F.col("m") / 60, None, F.col("port"), F.col("n")))
    types = _on(["diagnose"], asked, _both(daily, ["date", "vessel_type_norm"], [F.sum("arrivals_vessels").alias("v")])).groupBy("question_id", "vessel_type_norm").agg(F.sum("v").alias("v"))
    lead = types.groupBy("question_id").agg(F.min_by("vessel_type_norm", F.struct(-F.col("v"), "vessel_type_norm")).alias("type"), F.max("v").alias("v"), F.count("*").alias("n"))
    stayed = _on(["diagnose"], asked, s).join(lead.select("question_id", F.col("type").alias("vessel_type_norm")), ["question_id", "vessel_type_norm"])
    lead = lead.join(quantiles.quantiles(stayed, ["question_id"], "dwell_minutes", [0.5]), "question_id", "left")
    out.append(_row(lead, F.col("v"), F.get("quantiles", 0), F.col("type"), F.col("n")))
    return out


def from_positions(asked: DataFrame, positions: DataFrame) -> list[DataFrame]:
    """The busiest hour by reported destination, and jumps."""
    hourly = kpi.proxy_arrivals(positions, "hour")
    hours = _both(hourly, ["datetime_hour", "vessel_type_norm"], [F.sum("arrivals_vessels").alias("v")]).withColumns({"date": F.col("datetime_hour").cast("date"), "hour": F.hour("datetime_hour")})
    met = _on(["busiest_hour"], asked, hours, "vessel_type").filter(F.col("vessel_type").isNull() | F.contains("vessel_type_norm", "vessel_type")).groupBy("question_id", "hour").agg(F.sum("v").alias("v"))
    best = met.groupBy("question_id").agg(F.min_by("hour", F.struct(-F.col("v"), "hour")).alias("hour"), F.max("v").alias("v"), F.count("*").alias("n"))
    jumps = tracks.jumps(positions).select(F.lit(ALL).alias("key"), F.col("timestamp").cast("date").alias("date"), F.col("mmsi").alias("_mmsi"), "jump_km")
    seen = _on(["jumps"], asked.withColumn("key", F.lit(ALL)), jumps, "mmsi").filter(F.col("mmsi").isNull() | (F.col("mmsi") == F.col("_mmsi")))
    return [_row(best, F.col("v"), None, F.col("hour"), F.col("n")), _row(seen.groupBy("question_id").agg(F.max("jump_km").alias("far"), F.count("*").alias("n")), F.col("far"), None, None, F.col("n"))]


def from_index(asked: DataFrame, index: DataFrame) -> list[DataFrame]:
    """Congestion as it was and as it is expected."""
    series = kept(_both(index.filter("congestion_index is not null"), ["date"], [F.avg("congestion_index").alias("value")]))
    met = _on(["congestion"], asked, series).groupBy("question_id").agg(F.avg("value").alias("v"), F.max("value").alias("most"), F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("day"), F.count("*").alias("n"))
    out = [_row(met, F.col("v"), F.col("most"), F.col("day"), F.col("n"))]
    ahead = kept(forecast.horizon(series.withColumnRenamed("key", "port_key"), 12).withColumnRenamed("port_key", "key"))
    q = asked.filter("route = 'forecast_weekday'").select("question_id", "key", "horizon_weeks", F.coalesce("dow", F.lit("Friday")).alias("dow"))
    days = q.join(ahead, "key").filter((F.date_format("date", "EEEE") == F.col("dow")) & (F.col("step") <= F.col("horizon_weeks") * 7)).groupBy("question_id").agg(F.avg("predicted").alias("v"), F.count("*").alias("n"))
    out.append(_row(days, F.col("v"), None, labels.congestion_level(F.col("v")), F.col("n")))
    q = asked.filter("route = 'forecast_date'").select("question_id", "key", "target_date", "horizon_weeks")
    ends = series.groupBy("key").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    seen = q.join(series.select("key", F.col("date").alias("target_date"), F.col("value").alias("seen")), ["key", "target_date"], "left").join(ends, "key")
    model = ahead.select("key", F.col("date").alias("target_date"), "step", F.col("predicted").alias("model"))
    both = seen.join(model, ["key", "target_date"], "left").withColumn("near", F.col("model").isNotNull() & (F.col("step") <= F.col("horizon_weeks") * 7))
    both = both.join(forecast.analog_means(series, q.select("question_id", "key", "target_date")), "question_id", "left")
    value = F.coalesce("seen", F.when(F.col("near"), F.col("model")).otherwise(F.col("analog")))
    out.append(_row(both, value, None, F.when(F.col("seen").isNotNull(), "observed").when(F.col("near"), "model").otherwise("analog")))
    return out


def from_comparison(asked: DataFrame, daily: DataFrame, index: DataFrame, stays: DataFrame, catalog: DataFrame) -> list[DataFrame]:
    """Ports against each other by arrivals, mean index or median dwell; the port of the question counts among those it names."""
    q = asked.filter("route = 'compare_ports'")
    tokens = q.select("question_id", F.explode(F.array_distinct(F.concat(F.array("key"), F.filter(F.split("ports", ","), lambda p: p != "")))).alias("asked"))
    known = retrieval.resolve_ports(tokens.filter(F.col("asked") != ALL).select("asked").distinct(), catalog).filter("port_key is not null")
    pairs = tokens.join(known, "asked").select("question_id", "port_key").distinct().join(q.select("question_id", "metric", "route", "first_day", "last_day", "last_weeks"), "question_id").withColumnRenamed("port_key", "key")
    own = lambda m: pairs.filter(F.col("metric") == m if m else ~F.col("metric").isin("dwell_minutes", "congestion_index"))
    d = _on(["compare_ports"], own(None), daily.groupBy(F.col("port_key").alias("key"), "date").agg(F.sum("arrivals_vessels").alias("v"))).groupBy("question_id", "key").agg(F.sum("v").cast("double").alias("v"))
    i = _on(["compare_ports"], own("congestion_index"), index.select(F.col("port_key").alias("key"), "date", F.col("congestion_index").alias("v"))).groupBy("question_id", "key").agg(F.avg("v").alias("v"))
    s = _on(["compare_ports"], own("dwell_minutes"), stays.select(F.col("port_key").alias("key"), F.col("arrival_time").cast("date").alias("date"), "dwell_minutes"))
    s = quantiles.quantiles(s, ["question_id", "key"], "dwell_minutes", [0.5]).select("question_id", "key", F.get("quantiles", 0).alias("v"))
    best = d.unionByName(i).unionByName(s).groupBy("question_id").agg(F.min_by("key", F.struct(-F.col("v"), "key")).alias("port"), F.max("v").alias("v"), F.count("*").alias("n"))
    return [_row(best, F.col("v"), None, F.col("port"), F.col("n"))]


def from_emissions(spark: SparkSession, asked: DataFrame, segs: DataFrame, positions: DataFrame) -> list[DataFrame]:
    """Emissions of ports, of calls and of assumed stays. Where nothing can be computed for a port but traffic was reported
    for it, the state is RETRIEVAL_ONLY and n counts the reports."""
    segs = carbon.summed(segs)
    ports = asked.filter(F.col("route").isin("port_by_day", "port_by_month"))
    scopes = ports.select(F.col("question_id").alias("scope_id"), F.col("key").alias("port_key"), F.col("first_day").alias("date_from"), F.col("last_day").alias("date_to"), "boundary")
    every = segs.withColumns({"port_key": F.lit(ALL), "destination_norm": F.lit(ALL)})
    found = answers.port_emissions(segs.unionByName(every), scopes).withColumnRenamed("scope_id", "question_id")
    reports = _both(positions.withColumn("date", F.col("timestamp").cast("date")), ["date"], [F.count("*").alias("c")])
    evidence = _on(["port_by_day", "port_by_month"], asked, reports).groupBy("question_id").agg(F.sum("c").alias("reports"))
    found = found.join(evidence, "question_id", "left")
    only = (F.col("state") == "NOT_COMPUTABLE") & F.col("reports").isNotNull()
    out = [_row(found, F.col("total"), None, F.col("mode"), F.when(only, F.col("reports")).otherwise(F.col("unique_calls")), F.when(only, "RETRIEVAL_ONLY").otherwise(F.col("state")))]
    calls = answers.call_emissions(carbon.by_call(segs), asked.filter("route = 'call'").select(F.col("question_id").alias("ask_id"), "mmsi", "call_id")).withColumnRenamed("ask_id", "question_id")
    out.append(_row(calls, F.col("total"), None, F.col("reason"), None, F.col("state")))
    q = F.lower("question")
    number = lambda unit: F.nullif(F.regexp_extract(q, rf"(\d+(?:\.\d+)?)\s*(?:{unit})\b", 1), F.lit("")).cast("double")
    assumed = asked.filter("route = 'estimate'").select(
        "question_id", "boundary", text.vessel_class(F.coalesce("vessel_type", F.lit(""))).alias("vessel_class"), F.coalesce(*(F.when(F.contains(q, F.lit(m)), m) for m in emission.MODES), F.lit("transit")).alias("mode"),
        F.coalesce(number("h|hours?"), F.lit(1.0)).alias("duration_h"), F.coalesce(number("kn|knots?"), F.lit(0.0)).alias("speed_kn"),
    )
    assumed = emission.with_emissions(assumed.join(F.broadcast(emission.factor_table(spark)), ["vessel_class", "mode"]))  # 24 rows
    out.append(_row(assumed, F.when(F.col("boundary") == "WTW", F.col("wtw_co2e_t")).otherwise(F.col("ttw_co2e_t")), None, F.col("vessel_class"), None, F.lit("COMPUTED")))
    return out


def answered(spark: SparkSession, asked: DataFrame, today: Column, *, daily: DataFrame, stays: DataFrame, index: DataFrame, positions: DataFrame, segs: DataFrame) -> DataFrame:
    """One row per question: question_id, route, port, state, value, second, label, n. States are OK, NO_DATA, UNSUPPORTED,
    FORECAST_ONLY, RETRIEVAL_ONLY, COMPUTED, COMPUTED_ZERO and NOT_COMPUTABLE."""
    daily, index = kept(daily), kept(index)  # a row for each port and day (and type), read by most parts
    catalog = kept(kpi.port_catalog(daily))
    asked = kept(scoped(asked, catalog, today))
    parts = from_arrivals(asked, daily) + from_stays(asked, daily, stays) + from_positions(asked, positions) + from_index(asked, index) + from_comparison(asked, daily, index, stays, catalog) + from_emissions(spark, asked, segs, positions)
    found = reduce(DataFrame.unionByName, parts)
    out = asked.select("question_id", "route", "key").join(found, "question_id", "left")
    none = F.when(F.col("route") == "unsupported", "UNSUPPORTED").when(F.col("route") == "forecast_only", "FORECAST_ONLY").when(F.col("route").isin("spikes", "jumps"), "OK").otherwise("NO_DATA")
    counted = F.when(F.col("route").isin("spikes", "jumps"), F.coalesce("n", F.lit(0))).otherwise(F.col("n"))
    return out.select("question_id", "route", F.col("key").alias("port"), F.coalesce("state", none).alias("state"), "value", "second", "label", counted.alias("n"))
