"""Joins of strings that are alike or contain each other, by indexes of character pairs.

Likeness is the ratio of matching blocks, twice the matched characters over all characters. With M matched of T characters
in all, two strings have at least 3 M - T + 1 pairs of neighbouring characters in common (ends marked, repeats numbered): a
character left over in one string breaks two of its pairs, a gap in the other one. So a ratio of r leaves at least
(1.5 r - 1) T + 1 common pairs, and of the pairs of a string, rarest first, one of the leading ones must be shared. No pair
of strings is lost; what the index proposes is verified. Ratios below two thirds are refused, as they need no common pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.session import kept

START, END = "\x02", "\x03"


def pairs(s: str) -> list[str]:
    """Pairs of neighbouring characters, ends marked, the second and later of equal ones numbered."""
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip(START + s, s + END, strict=True):
        seen[a + b] += 1
        out.append(a + b + (str(seen[a + b]) if seen[a + b] > 1 else ""))
    return out


def leading(n: Column, least: float) -> Column:
    """How many of a string's n + 1 pairs, rarest first, must hold one that it shares with a string as alike as `least`."""
    shortest = F.ceil(n * (least / (2 - least)) - 1e-9)
    common = F.ceil((n + shortest) * (1.5 * least - 1) + 1 - 1e-9)
    return F.greatest(F.lit(0), n + 2 - common).cast("int")


def _pairs_of(names: DataFrame) -> DataFrame:
    """(side, s, n, g) for every pair of every different string."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pairs(s) for s in batch.column(1).to_pylist()]
            row = pa.array([i for i, g in enumerate(found) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([len(g) - 1 for g in found for _ in g], pa.int32()), pa.array([x for g in found for x in g], pa.string())], ["side", "s", "n", "g"])

    return names.mapInArrow(task, "side int, s string, n int, g string")


def alike(left: DataFrame, right: DataFrame, least: float = 0.80) -> DataFrame:
    """(a, b, ratio) for all different strings a of `left(a)` and b of `right(b)` with a ratio of at least `least`. Nulls are
    alike to nothing; two empty strings are (ratio 1)."""
    if not 2 / 3 <= least <= 1:
        raise ValueError(f"least must lie between 2/3 and 1, not {least}")
    names = left.select(F.lit(0).alias("side"), F.col("a").alias("s")).unionByName(right.select(F.lit(1).alias("side"), F.col("b").alias("s"))).filter("s is not null").distinct()
    grams = kept(_pairs_of(names))
    often = grams.groupBy("g").agg(F.count("*").alias("often"))
    ranked = grams.join(often, "g").groupBy("side", "s", "n").agg(F.sort_array(F.collect_list(F.struct("often", "g"))).alias("gs"))  # a string's own pairs
    heads = kept(ranked.select("side", "s", "n", F.explode(F.slice("gs", F.lit(1), leading(F.col("n"), least))).alias("x")).select("side", "s", "n", "x.g"))
    a = heads.filter("side = 0").select("g", F.col("s").alias("a"), F.col("n").alias("n"))
    b = heads.filter("side = 1").select("g", F.col("s").alias("b"), F.col("n").alias("m"))
    fits = F.least("n", "m") * 2 + 1e-9 >= (F.col("n") + F.col("m")) * least
    candidates = a.join(b, "g").filter(fits).select("a", "b").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio, last, m = [], None, SequenceMatcher(None, "", "")
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y != last:
                    m.set_seq2(y)  # what is indexed of the second string serves all that are compared with it
                    last = y
                m.set_seq1(x)
                ratio.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], ["a", "b", "ratio"])

    return candidates.mapInArrow(verify, "a string, b string, ratio double").filter(F.col("ratio") >= least)


def _inner(c: Column) -> Column:
    """The different pairs of neighbouring characters within a string; a string of one character is its own."""
    n = F.length(c)
    return F.array_distinct(F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, 2))).when(n == 1, F.array(c)).otherwise(F.array().cast("array<string>")))


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) for all different strings a of `left(a)` and b of `right(b)` of which one contains the other; nulls and empty
    strings are contained in nothing.

    A string is looked up by the rarest of its pairs among the pairs of the strings that could contain it.
    """

    def within(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        have = long.select(F.col(t), F.explode(F.array_distinct(F.concat(_inner(F.col(t)), F.split(t, "")))).alias("g"))
        often = have.groupBy("g").agg(F.count("*").alias("often"))
        wanted = short.select(F.col(s), F.explode(_inner(F.col(s))).alias("g")).join(often, "g")
        size = F.size(_inner(F.col(s)))
        rarest = wanted.groupBy(s).agg(F.min(F.struct("often", "g")).alias("x"), F.count("*").alias("found")).filter(F.col("found") == size)  # one that no string has rules a string out
        return rarest.select(s, "x.g").join(have, "g").filter(F.contains(F.col(t), F.col(s))).select("a", "b")

    a, b = (d.filter(f"{c} is not null and {c} <> ''").select(c).distinct() for d, c in ((left, "a"), (right, "b")))
    return within(a, "a", b, "b").unionByName(within(b, "b", a, "a")).distinct()
