"""Answers to many questions at once: each is a row of a small table of scopes, and gets a state beside its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.functions import labels, text
from seawake.plans import carbon, forecast

#: What is implausible for one call, and too small to compare with.
MAX_CALL_HOURS, MAX_CALL_T, LEAST_BASELINE_T = 240.0, 500.0, 1.0


def _chosen(suffix: str = "") -> Column:
    """The total of the boundary that the scope asks for."""
    return F.when(F.col("boundary") == "WTW", F.col(f"wtw_co2e_t{suffix}")).otherwise(F.col(f"ttw_co2e_t{suffix}"))


def _within(df: DataFrame, scopes: DataFrame, port: Column) -> DataFrame:
    """Rows of each scope's port and days. Scopes are a stated set of questions, so they are the small side."""
    s = scopes.select("scope_id", F.col("port_key").alias("_port"), "date_from", "date_to", "boundary")
    on = (port == F.col("_port")) & (F.col("date_from").isNull() | (F.col("date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("date") <= F.col("date_to")))
    return df.join(s, on)


def port_emissions(segs: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row per scope (scope_id, port_key, date_from, date_to, boundary): emissions from the segments of calls, else from
    the daily inventory of the port, with bounds, confidence, checks and state.

    States: COMPUTED, COMPUTED_ZERO, and NOT_COMPUTABLE where the range is reversed or nothing matches. The total over
    unique calls is summed by itself, so that it can be compared with the total of the segments.
    """
    linked = _within(segs.filter(F.coalesce("call_id", F.lit("")) != ""), scopes, F.col("port_key"))
    sums = [F.sum(_chosen(x)).alias(n) for x, n in (("", "total"), ("_lower", "lower"), ("_upper", "upper"))]
    calls = linked.groupBy("scope_id", "call_id").agg(*sums, F.sum("duration_h").alias("hours"), F.sum("fallback_usage_ratio").alias("fallback"), F.count("*").alias("n"))
    by_call = calls.groupBy("scope_id").agg(
        F.sum("lower").alias("lower"), F.sum("upper").alias("upper"), F.sum("total").alias("calls_total"), F.count("*").alias("unique_calls"), (F.sum("fallback") / F.sum("n")).alias("fallback"),
        F.max("total").alias("max_t"), F.max("hours").alias("max_h"),
    )
    by_segment = linked.groupBy("scope_id").agg(F.sum(_chosen()).alias("total"))
    daily = carbon.daily_port(segs)
    proxy = _within(daily, scopes, F.col("port_key")).groupBy("scope_id").agg(*(F.sum(_chosen(x)).alias(f"p_{n}") for x, n in (("", "total"), ("_lower", "lower"), ("_upper", "upper"))), F.avg("fallback_usage_ratio").alias("p_fallback"))
    base = daily.groupBy(F.col("port_key").alias("_base")).agg(F.percentile("ttw_co2e_t", F.lit(0.5)).alias("_ttw"), F.percentile("wtw_co2e_t", F.lit(0.5)).alias("_wtw"))
    out = scopes.join(by_call, "scope_id", "left").join(by_segment, "scope_id", "left").join(proxy, "scope_id", "left").join(base, F.col("port_key") == F.col("_base"), "left")

    reversed_ = F.coalesce(F.col("date_from") > F.col("date_to"), F.lit(False))
    mode = F.when(reversed_, None).when(F.col("unique_calls") > 0, "call_linked").when(F.col("p_total").isNotNull(), "daily_proxy")
    either = lambda a, b: F.when(F.col("mode") == "call_linked", F.col(a)).when(F.col("mode") == "daily_proxy", F.col(b))
    out = out.withColumn("mode", mode).withColumns({n: either(n, f"p_{n}") for n in ("total", "lower", "upper", "fallback")})
    width = F.when(F.col("total") > 0, (F.col("upper") - F.col("lower")) / F.col("total")).otherwise(0.0)
    label = labels.confidence(width, F.col("fallback"))
    label = F.when(F.col("mode").isNotNull(), F.when((F.col("mode") == "daily_proxy") & (label == "high"), "medium").otherwise(label))
    state = F.when(F.col("mode").isNull(), "NOT_COMPUTABLE").when(F.abs("total") < 1e-12, "COMPUTED_ZERO").otherwise("COMPUTED")
    baseline = F.coalesce(F.when(F.col("boundary") == "WTW", F.col("_wtw")).otherwise(F.col("_ttw")), F.lit(0.0))
    warned = (F.col("mode") == "call_linked") & ((F.col("max_h") > MAX_CALL_HOURS) | (F.col("max_t") > MAX_CALL_T))
    sanity = F.when(F.col("mode").isNull() | (baseline < LEAST_BASELINE_T), "unstable baseline").when(warned, "warning").otherwise("checked")
    return out.select(
        "scope_id", state.alias("state"), "mode", "total", "lower", "upper", label.alias("confidence"), F.when(F.col("mode") == "call_linked", F.col("calls_total")).alias("calls_total"),
        F.when(~reversed_, F.coalesce("unique_calls", F.lit(0))).otherwise(0).cast("long").alias("unique_calls"), sanity.alias("sanity"),
    )


def call_emissions(calls: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per (mmsi, call_id) asked for: the call of exactly that id, else of the same letters and digits if that is only
    one. States: COMPUTED, COMPUTED_ZERO, and NOT_COMPUTABLE with the reason `no match` or `ambiguous`."""
    key = lambda c: text.alnum(F.regexp_replace(c, r"^[\s:_\-]+", ""))
    a = asked.select("ask_id", F.trim("mmsi").alias("_mmsi"), F.regexp_replace(F.trim("call_id"), r"^[\s:_\-]+", "").alias("_call"))
    near = a.join(calls, (F.col("_mmsi") == F.col("mmsi")) & (key(F.col("_call")) == key(F.col("call_id"))))
    exact = F.col("_call") == F.col("call_id")
    sums = lambda cond: [F.sum(F.when(cond, F.col(f"wtw_co2e_t{s}"))) for s in ("", "_lower", "_upper")]
    found = near.groupBy("ask_id").agg(F.max(exact).alias("exact"), F.countDistinct("call_id").alias("n"), F.array(*sums(exact)).alias("x"), F.array(*sums(F.lit(True))).alias("y"))
    out = asked.select("ask_id").join(found, "ask_id", "left")
    one = F.when(F.col("exact"), F.col("x")).when(F.col("n") == 1, F.col("y"))
    reason = F.when(F.col("n").isNull(), "no match").when(~F.col("exact") & (F.col("n") > 1), "ambiguous")
    state = F.when(one.isNull(), "NOT_COMPUTABLE").when(F.abs(F.get(one, 0)) < 1e-12, "COMPUTED_ZERO").otherwise("COMPUTED")
    return out.select("ask_id", state.alias("state"), reason.alias("reason"), *(F.get(one, i).alias(c) for i, c in enumerate(("total", "lower", "upper"))))


def congestion_on(index: DataFrame, target: str, weeks: int = 4) -> DataFrame:
    """One row per port: its value on a day if it was observed, a forecast if the day is within the horizon of a long enough
    history, else the seasonal analog; with method, confidence and level. `index` is (port_key, date, value)."""
    day = F.lit(target).cast("date")
    ends = index.groupBy("port_key").agg(F.max("date").alias("last"), F.count("*").alias("n"), F.max(F.when(F.col("date") == day, F.col("value"))).alias("seen"))
    ahead = F.datediff(day, F.col("last"))
    ends = ends.select("port_key", "seen", ahead.alias("ahead"), ((ahead > 0) & (ahead <= 7 * weeks) & (F.col("n") >= 14)).alias("near"))
    model = forecast.horizon(index, weeks).filter(F.col("date") == day).select("port_key", F.col("predicted").alias("m"), F.col("lower").alias("ml"), F.col("upper").alias("mu"))
    analog = forecast.seasonal_analog(index, target).select("port_key", F.col("predicted").alias("a"), F.col("lower").alias("al"), F.col("upper").alias("au"), F.col("confidence").alias("ac"))
    out = ends.join(model, "port_key", "left").join(analog, "port_key", "left")
    pick = lambda m, a: F.coalesce("seen", F.when(F.col("near"), F.col(m)).otherwise(F.col(a)))
    seen = F.col("seen").isNotNull()
    out = out.select(
        "port_key", F.when(seen, "observed").when(F.col("near"), "model").otherwise("analog").alias("method"), pick("m", "a").alias("predicted"), pick("ml", "al").alias("lower"), pick("mu", "au").alias("upper"),
        F.when(seen, None).when(F.col("near"), F.when(F.col("ahead") <= 14, "high").otherwise("medium")).otherwise(F.col("ac")).alias("confidence"),
    )
    return out.withColumn("level", labels.congestion_level(F.col("predicted")))


def emission_changes(daily: DataFrame, least_base: float = LEAST_BASELINE_T) -> DataFrame:
    """Per port and day: total, its unit, the change from the day with data before and from the port's mean of the seven before,
    in per cent where the base is large enough, and a level from the port's share of them."""
    total = daily.groupBy("port_key", "date").agg(F.sum("wtw_co2e_t").alias("total_t"))
    w = Window.partitionBy("port_key").orderBy("date")
    before, mean = F.lag("total_t").over(w), F.avg("total_t").over(w.rowsBetween(-7, -1))
    out = total.withColumns({"day_change": labels.percent_change(F.col("total_t"), before, least_base), "mean_change": labels.percent_change(F.col("total_t"), mean, least_base)})
    level = F.when(F.col("mean_change").isNull(), "no baseline").when(F.col("mean_change") >= 80, "very high").when(F.col("mean_change") >= 30, "high").when(F.col("mean_change") <= -30, "low").otherwise("usual")
    return out.withColumns({"shown": labels.mass_text(F.col("total_t")), "level": level})


def evidence_lines(chunks: DataFrame, most: int = 160) -> DataFrame:
    """`[source | port | date] text` with the first `most` characters of the text in one line."""
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("n/a"))
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    short = F.when(F.length(line) > most, F.concat(F.rtrim(F.left(line, F.lit(most))), F.lit("..."))).otherwise(line)
    return chunks.withColumn("line", F.concat(F.lit("["), F.concat_ws(" | ", known("source"), known("port_key"), known("date")), F.lit("] "), short))


def evidence_span(evidence: DataFrame) -> DataFrame:
    """The most frequent port of some evidence (the first of equals), its first and last day, and the range of its values."""
    ports = evidence.groupBy("question", "port_key").count()
    top = ports.groupBy("question").agg(F.min_by("port_key", F.struct(-F.col("count"), "port_key")).alias("top_port"))
    span = evidence.groupBy("question").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    return span.join(top, "question")
