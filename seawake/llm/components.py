"""Connected components of an edge list, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.words import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; the component is its smallest node.

    In each round every node points to the neighbour of the least hash, itself included; pointers are followed once more
    and edges move to what their ends point to. Hashed order keeps the pointer chains short for any numbering, so the
    number of rounds grows with the logarithm of the nodes. Minima are combined before each shuffle, and what a round
    leaves is checkpointed, so a hub with very many neighbours costs one row per task.
    """
    left = cut(edges.select("a", "b").filter("a <> b").distinct())
    names = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        to = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(order("a"), "m")["n"].alias("p"))
        to = cut(to)
        twice = to.alias("x").join(to.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p"))
        twice = cut(twice)
        if names is None:
            names = twice.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            names = names.join(twice.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        names = cut(names)
        left = left.join(twice, "a").select(F.col("p").alias("a"), "b").join(twice.select(F.col("a").alias("b"), F.col("p").alias("q")), "b")
        left = cut(left.select(F.least("a", "q").alias("a"), F.greatest("a", "q").alias("b")).filter("a <> b").distinct())
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = cut(names.groupBy("component").agg(F.min("node").alias("least")))  # by itself, so that Spark can split a large component's rows in the join
    return names.join(least, "component").select("node", F.col("least").alias("component"))
