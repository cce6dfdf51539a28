"""Exact vector search."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine in double precision, at least 0; 1 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / norms))


#: Vectors of up to so many entries are compared by an expression that is compiled, longer ones entry by entry.
UNROLLED = 512


def distance_to(a: Column, query: list[float]) -> Column:
    """The cosine distance to a given vector, summed in one expression; null for vectors of another length."""
    length = math.sqrt(math.fsum(x * x for x in query))
    if not query or not length or len(query) > UNROLLED:
        return F.when(F.size(a) == len(query), cosine_distance(a, F.array(*(F.lit(float(x)) for x in query))))
    entries = [F.get(a, F.lit(i)).cast("double") for i in range(len(query))]
    total = lambda xs: reduce(lambda p, q: p + q, xs)
    norm = F.sqrt(total([e * e for e in entries]))
    cosine = total([e * F.lit(x / length) for e, x in zip(entries, query, strict=True)]) / norm
    return F.when(F.size(a) == len(query), F.when(norm == 0, 1.0).when(cosine.isNotNull() & ~F.isnan(cosine), F.greatest(F.lit(0.0), 1 - cosine)))


def nearest(items: DataFrame, vector: str, query: list[float] | DataFrame, key: str, k: int) -> DataFrame:
    """The `k` items nearest to `query`, a vector or a table of one row with a column `query` (which is read first): filter
    first, then an exact top-k."""
    if isinstance(query, DataFrame):
        row = query.select("query").first()
        query = list(row.query) if row and row.query else []
    return items.withColumn("distance", distance_to(F.col(vector), [float(x) for x in query])).orderBy(F.asc_nulls_last("distance"), key).limit(k)


def merged(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """One ranking of several."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.orderBy("distance", key).limit(k)


def answerable(found: DataFrame, threshold: float = 0.42) -> DataFrame:
    """Whether the nearest item is near enough to answer from."""
    return found.agg(F.count("*").alias("n_items"), F.min("distance").alias("min_distance")).withColumn("answerable", F.coalesce(F.col("min_distance") <= threshold, F.lit(False)))
