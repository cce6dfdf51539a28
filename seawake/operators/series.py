"""Windows over ordered rows: as-of joins, sessions, rolling features, forecasts by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.operators import blocks


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, payload: list[str], tie: str, moment: str | None = None) -> DataFrame:
    """`left` with the `payload` of the last right row of the same `by` at or before its time.

    Both sides are stacked and the last right row is carried forward, so there is one shuffle and no join whose size depends on
    how many rows match. `tie` orders right rows of one time (the largest wins). Rows are cut into blocks of days of `moment`
    (the left time unless it is another column of both sides), each with the last right row before it, so no task holds all
    rows of a key; the block stays as a column.
    """
    call = F.struct(*payload)
    numbered = lambda df, t: df.withColumn("_at", F.col(t)).withColumn("_moment", F.col(moment or t).cast("timestamp"))
    kind = right.select(call.alias("c")).schema["c"].dataType
    l = blocks.by_block(numbered(left, left_time), "_moment")  # noqa: E741
    l = l.select(by, blocks.BLOCK, F.col("_at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*(c for c in left.columns if c != blocks.BLOCK)).alias("_row"), F.lit(None).cast(kind).alias("_call"))  # noqa: E741
    r = blocks.by_block(numbered(right, right_time), "_moment").select(by, blocks.BLOCK, F.col("_at").alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), call.alias("_call"))
    ends = l.select(by, blocks.BLOCK).distinct().withColumn("_call", F.lit(None).cast(kind)).unionByName(r.groupBy(by, blocks.BLOCK).agg(F.max_by("_call", F.struct("_t", "_tie")).alias("_call")))
    ends = ends.groupBy(by, blocks.BLOCK).agg(F.first("_call", ignorenulls=True).alias("_call"))
    carried = blocks.last_known(l.unionByName(r), by, ["_t", "_side", "_tie"], "_call", ends).filter("_side = 1")
    return carried.select("_row.*", blocks.BLOCK, *(F.col(f"_call.{c}").alias(c) for c in payload))


def present(df: DataFrame, by: list[str], member: str, start: str, end: str, name: str = "datetime_hour", members: str = "members", events: str = "events") -> DataFrame:
    """How many members and events are present in each key and hour, for the hours that have any.

    An interval is one step up in its first hour and one down after its last; steps of equal hours are summed before any
    window, so windows are as long as there are hours, not intervals. A member's intervals that overlap or touch are one.
    Hours are written out only for runs of the result.
    """
    up, down = F.date_trunc("hour", start), F.date_trunc("hour", end) + F.expr("interval 1 hour")
    steps = df.filter(F.col(start) <= F.col(end)).select(*by, member, F.explode(F.array(F.struct(up.alias("h"), F.lit(1).alias("d")), F.struct(down.alias("h"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*by, member, F.col("s.h").alias("h")).agg(F.sum("s.d").alias("d"))
    own = Window.partitionBy(*by, member).orderBy("h")
    there = F.sum("d").over(own.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("_now", there).withColumn("_before", F.coalesce(F.lag("_now").over(own), F.lit(0)))
    steps = steps.groupBy(*by, "h").agg(F.sum((F.col("_now") > 0).cast("int") - (F.col("_before") > 0).cast("int")).alias("m"), F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("h")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = steps.select(*by, "h", F.sum("m").over(upto).alias(members), F.sum("d").over(upto).alias(events), F.lead("h").over(w).alias("_end")).filter(F.col(events) > 0)
    return runs.select(*by, F.explode(F.sequence("h", F.col("_end") - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias(name), members, events)


def islands(df: DataFrame, by: str, order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers the runs of each `by`; a row for which `starts` holds begins a run. Rows have blocks."""
    return blocks.running_sum(df, by, order, starts.cast("int"), name)


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b, with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def spikes(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows above mean plus two deviations of the seven before them, of which there must be three."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-7, -1)
    out = df.withColumn("threshold", F.when(F.count(value).over(w) >= 3, F.avg(value).over(w) + 2 * F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))))
    return out.filter(F.col(value) > F.col("threshold"))


def one_step(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """`predicted` from the rows before: 0.7 of the seventh last (or the last) plus 0.3 of the mean of up to seven."""
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(-7, -1)
    n = F.row_number().over(w) - 1
    guess = 0.7 * F.when(n >= 7, F.lag(value, 7).over(w)).otherwise(F.lag(value, 1).over(w)) + 0.3 * F.avg(value).over(before)
    return df.withColumn("predicted", F.when(n == 0, None).when(n == 1, F.greatest(F.lag(value, 1).over(w), F.lit(0.0))).otherwise(F.greatest(guess, F.lit(0.0))))


def horizon(df: DataFrame, by: list[str], order: str, value: str, days: int) -> DataFrame:
    """A forecast of `days` steps per key: each step is fed back, and the band widens with the root of the step.

    The state is the last seven values, held in an array, so a key costs one small row.
    """
    fit = one_step(df, by, order, value).withColumn("residual", F.col(value) - F.col("predicted"))
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    last = fit.withColumn("_n", F.row_number().over(w))
    stats = last.groupBy(*by).agg(
        F.max(order).alias("_last"),
        F.when(F.count("residual") >= 3, F.stddev_samp("residual")).when(F.count(value) > 1, F.stddev_pop(value)).otherwise(F.greatest(F.max(value), F.lit(1.0)) * 0.15).alias("_sigma"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= 7, F.struct((-F.col("_n")).alias("o"), F.col(value).cast("double").alias("v"))))).alias("_h"),
    )
    mean = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / F.size(h)
    guess = lambda h: F.greatest(F.lit(0.0), F.when(F.size(h) == 1, h[0]).otherwise(0.7 * F.when(F.size(h) >= 7, F.element_at(h, 1)).otherwise(F.element_at(h, -1)) + 0.3 * mean(h)))
    state = F.struct(F.transform("_h", lambda s: s["v"]).alias("h"), F.array().cast("array<double>").alias("out"))
    push = lambda h, x: F.slice(F.concat(h, F.array(x)), -F.least(F.size(h) + 1, F.lit(7)), 7)
    run = F.aggregate(F.sequence(F.lit(1), F.lit(days)), state, lambda a, _: F.struct(push(a["h"], guess(a["h"])).alias("h"), F.concat(a["out"], F.array(guess(a["h"]))).alias("out")), lambda a: a["out"])
    rows = stats.select(*by, "_last", "_sigma", F.posexplode(run).alias("_p", "predicted"))
    step = F.col("_p") + 1
    return rows.select(*by, step.alias("step"), F.date_add(F.col("_last").cast("date"), step).alias("date"), "predicted", F.greatest(F.lit(0.0), F.col("predicted") - 1.96 * F.col("_sigma") * F.sqrt(step)).alias("lower"), (F.col("predicted") + 1.96 * F.col("_sigma") * F.sqrt(step)).alias("upper"))


def last_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
