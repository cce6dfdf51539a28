"""Ordered rows of a key cut into blocks of time, so that a key which holds most rows is still many tasks.

What a window over the whole key would see from beyond a block comes from one row per block: the rows at its two ends, the
last known value, a sum. Windows over these rows are as long as a key has blocks. All functions expect the column `BLOCK`
and read and shuffle rows by (key, block) only, so several in a row need one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
DAY_MICROS = 86_400_000_000


def by_block(df: DataFrame, time: str, days: float = 1) -> DataFrame:
    """`df` with the number of the block of `days` days that its time falls into; rows without a time share block null."""
    return df.withColumn(BLOCK, F.floor(F.unix_micros(F.col(time).cast("timestamp")) / int(days * DAY_MICROS)))


def within(by: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(by, BLOCK).orderBy(*order)


def _joined(df: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """`df` with the columns of its block's row in `ends`; null keys and null blocks meet, too."""
    e = ends.withColumnsRenamed({by: "_e_by", BLOCK: "_e_block"})
    return df.join(e, F.col(by).eqNullSafe(F.col("_e_by")) & F.col(BLOCK).eqNullSafe(F.col("_e_block")), "left").drop("_e_by", "_e_block")


def neighbours(df: DataFrame, by: str, order: list[str], columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """`df` with `_prev` and `_next`: the `columns` of the row before and after it in its key (null at the ends).

    `source` has the same rows with at least these columns; the ends of blocks are taken from it where it is cheaper to read.
    """
    row, at = F.struct(*columns), F.struct(*order)
    ends = (df if source is None else source).groupBy(by, BLOCK).agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    w, inner = Window.partitionBy(by).orderBy(BLOCK), within(by, order)
    ends = ends.select(by, BLOCK, F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    local = df.withColumns({"_lag": F.lag(row).over(inner), "_lead": F.lead(row).over(inner)})
    return _joined(local, ends, by).withColumns({"_prev": F.coalesce("_lag", "_before"), "_next": F.coalesce("_lead", "_after")}).drop("_lag", "_lead", "_before", "_after")


def last_known(df: DataFrame, by: str, order: list[str], value: str, ends: DataFrame) -> DataFrame:
    """`df` with `value` filled from the last row of its key that has one. `ends` is (by, block, value): each block's last."""
    carried = ends.withColumn("_carried", F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))).drop(value)
    local = df.withColumn(value, F.last(value, ignorenulls=True).over(within(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(local, carried, by).withColumn(value, F.coalesce(value, "_carried")).drop("_carried")


def running_sum(df: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows of its key up to it."""
    sums = df.groupBy(by, BLOCK).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    local = df.withColumn(name, F.sum(value).over(within(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(local, sums.select(by, BLOCK, before.alias("_carried")), by).withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_carried")
