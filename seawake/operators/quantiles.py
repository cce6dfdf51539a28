"""Exact quantiles of groups of any size.

Values of a group are counted by ranges between its least and greatest, so a task sends one row per group and range. The
ranges that hold the wanted ranks are cut into ranges again, round after round, until few enough values are left to sort.
No state holds a group's values, and only counts are shuffled before the last round. Where all groups are small they are
sorted at once, with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.session import kept

#: Ranges of a round; values of a range that may be sorted in one state; rows of wanted ranks that may be broadcast.
RANGES, FEW, SHIPPED = 1 << 12, 1 << 16, 100_000


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys), F.lit(True))


def _held(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in a wanted range of their group. Ranges of one group that differ do not overlap."""
    w = wanted.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    w = F.broadcast(w) if wanted.count() <= SHIPPED else w
    return rows.join(w, _same(keys) & F.col("v").between(F.col("lo"), F.col("hi"))).drop(*(f"_w_{k}" for k in keys))


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], name: str = "quantiles") -> DataFrame:
    """(keys, `name`): the quantiles `at` of the values of each group, interpolated between neighbours, as an array.

    Nulls and non-finite values do not count; a group without others has no row, and neither has an empty table.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if (most or 0) <= FEW:
        found = rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, at))).alias(name), F.count("*").alias("_n"))
        return found.filter("_n > 0").drop("_n")
    rows = kept(rows)
    spans = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in at))))
    sizes = spans.select(*keys, F.col("n").alias("size"))
    state = kept(spans.select(*keys, F.explode(ranks.cast("array<bigint>")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n"))
    known = [state.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))]
    state = state.filter("lo < hi")
    while True:
        few = state.filter(F.col("n") <= FEW)
        part = _held(rows, few.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
        known.append(few.withColumnsRenamed({k: f"_w_{k}" for k in keys}).withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(part, _same(keys) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))).select(*keys, "rank", F.get("sorted", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
        state = state.filter(F.col("n") > FEW)
        if state.isEmpty():
            break
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no difference overflows
        cell = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")
        counts = _held(rows, state.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("cell"))
        counts = counts.withColumn("upto", upto).withColumnsRenamed({"lo": "_lo", "hi": "_hi", "n": "_n"}).withColumnsRenamed({k: f"_w_{k}" for k in keys})
        inside = (F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("_n"))
        state = state.join(counts, _same(keys) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & inside)
        state = kept(state.select(*keys, "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("below") + F.col("upto") - F.col("_n")).alias("below"), F.col("_n").alias("n")))
        known.append(state.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("x")))
        state = state.filter("lo < hi")
    found = reduce(DataFrame.unionByName, known).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))
    found = found.withColumnsRenamed({k: f"_w_{k}" for k in keys}).join(sizes, _same(keys))
    pos = [(F.col("size") - 1) * F.lit(float(p)) for p in at]
    low = [F.element_at("_x", F.floor(p).cast("long")) for p in pos]
    high = [F.element_at("_x", F.ceil(p).cast("long")) for p in pos]
    mixed = [F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b) for p, a, b in zip(pos, low, high, strict=True)]
    return found.select(*keys, F.array(*mixed).alias(name))


def quantile(df: DataFrame, value: Column, at: list[float], name: str = "quantiles") -> DataFrame:
    """One row: the quantiles of a column of the whole table (null where it has no values)."""
    found = quantiles(df.select(value.alias("_v"), F.lit(0).alias("_all")), ["_all"], "_v", at, name)
    return df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(found, "_all", "left").drop("_all")
