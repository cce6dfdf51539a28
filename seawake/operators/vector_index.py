"""A stored inverted-file index over vectors: rows in cells around k-means centres, one folder for each cell.

A search by cosine distance reads the cells nearest to a query (`probes`), which a partition filter prunes to, and ranks
their rows exactly. The exact way then reads the cells that could still hold a nearer row: no row of a cell is nearer to the
query than the angle between query and centre less the cell's reach, the largest angle of a row to its centre.

Centres are fitted on at most `sample` rows, those of the smallest hashes; every row is indexed. There are at most
`MOST_CELLS` centres, which are on the driver and shipped to tasks. Rows of a cell are compared in parts of about
`PART_ROWS`. Null vectors are left out; zero vectors, and those that hold null or non-finite entries or have another length
than the centres, lie in cell -1, which every search reads: a zero vector is at distance 1, the others at none (null).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.operators import vectors
from seawake.session import kept

MOST_CELLS, PART_ROWS, NEAR = 4096, 8192, 1e-9


@dataclass
class Index:
    """Where an index lies, what its rows are called, and its centres (unit rows), reaches (angles) and sizes by cell."""

    path: str
    key: str
    vector: str
    centres: np.ndarray
    reach: np.ndarray
    size: np.ndarray
    columns: T.StructType
    other: int = 0

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.columns).parquet(f"{self.path}/cells").filter(F.col(self.key).isNotNull())

    def angles(self, q: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(q @ self.centres.T, -1, 1))

    def least(self, q: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have to each (unit) query."""
        d = 1 - np.cos(np.maximum(self.angles(q) - self.reach, 0)) - NEAR
        return np.where(self.size > 0, d, np.inf)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _sound(c: Column, d: int | None = None) -> Column:
    good = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(c, lambda v: v != 0)
    return F.coalesce((F.size(c) > 0 if d is None else F.size(c) == d) & good, F.lit(False))


def _placed(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """`rows` with `cell` and the angle to its centre."""
    at, names = rows.columns.index(vector), rows.columns
    d = centres.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle, sound = np.full(len(batch), -1, np.int32), np.zeros(len(batch)), batch.column(len(names)).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(sound)
            if len(some):
                x = _unit(batch.column(at).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
                cosine = x @ centres.T
                cell[some] = cosine.argmax(1)
                angle[some] = np.arccos(np.clip(cosine.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell), pa.array(angle)], [*names, "cell", "angle"])

    kind = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return rows.withColumn("_sound", _sound(F.col(vector), d)).mapInArrow(task, kind)


def _described(index: Index, spark: SparkSession) -> Index:
    """The index with reaches and sizes of what is stored; a row for each cell."""
    index.reach, index.size = np.zeros(len(index.centres)), np.zeros(len(index.centres), np.int64)
    for r in index.rows(spark).groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).collect():
        if r.cell < 0:
            index.other = r.n
        else:
            index.reach[r.cell], index.size[r.cell] = r.reach, r.n
    rows = [(i, c.tolist(), float(index.reach[i]), int(index.size[i])) for i, c in enumerate(index.centres)]
    about = spark.createDataFrame([*rows, (-1, None, 0.0, index.other)], "cell int, centre array<double>, reach double, n long")
    about.withColumns({"key": F.lit(index.key), "vector": F.lit(index.vector), "columns": F.lit(index.columns.json())}).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centres")
    return index


def build(items: DataFrame, key: str, vector: str, path: str, *, cells: int | None = None, sample: int = 65_536, rounds: int = 10, seed: int = 5) -> Index:
    """Writes the index of `items` to `path`; about the square root of the number of rows in cells, unless given."""
    spark, items = items.sparkSession, items.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    sound = items.filter(_sound(F.col(vector))).select(key, F.col(vector).cast("array<double>").alias("v"))
    sizes = {r.d: r.n for r in sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}  # the most frequent length
    d, n = next(iter(sizes.items()), (1, 0))
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, sample / max(n, 1)))
    k = min(MOST_CELLS, cells or max(1, round(n**0.5)), max(n, 1))
    centres = np.eye(1, d)
    if n:
        some = sound.filter((F.size("v") == d) & share).select(array_to_vector("v").alias("v"))
        model = KMeans(k=max(2, k), distanceMeasure="cosine", maxIter=rounds, seed=seed, featuresCol="v").fit(some) if k > 1 and some.limit(2).count() > 1 else None
        centres = _unit(np.array(model.clusterCenters())) if model else np.eye(1, d)
    placed = _placed(items, vector, centres)
    spread = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // (len(centres) * 50 * PART_ROWS)))))  # large cells in several files
    placed.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    return _described(Index(path, key, vector, centres, np.empty(0), np.empty(0), placed.schema), spark)


def load(spark: SparkSession, path: str) -> Index:
    """The stored index at `path`."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS and one
    own = [r for r in rows if r.cell >= 0]
    return Index(path, rows[0].key, rows[0].vector, np.array([r.centre for r in own]), np.array([r.reach for r in own]), np.array([r.n for r in own]), T.StructType.fromJson(json.loads(rows[0].columns)), next((r.n for r in rows if r.cell < 0), 0))


def upsert(index: Index, items: DataFrame) -> Index:
    """The index with `items` put in, in place of rows of equal keys (the columns of the index; one row for each key). Only cells that gain
    or lose a row are written again."""
    spark = items.sparkSession
    new = kept(_placed(items.filter(F.col(index.vector).isNotNull() & F.col(index.key).isNotNull()), index.vector, index.centres))
    old = index.rows(spark)
    keys = new.select(index.key).distinct()
    touched = [r.cell for r in new.select("cell").union(old.join(keys, index.key, "left_semi").select("cell")).distinct().collect()]  # at most MOST_CELLS and one
    left = old.filter(F.col("cell").isin(touched)).join(keys, index.key, "left_anti")
    empty = spark.createDataFrame([(c,) for c in touched], "cell int")  # a cell that loses its last row is written, too
    after = kept(left.unionByName(new).unionByName(empty, allowMissingColumns=True))
    after.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{index.path}/cells")
    return _described(index, spark)


def _first(found: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("distance"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(index: Index, spark: SparkSession, query: list[float], k: int, *, probes: int = 8, exact: bool = False, where: Column | None = None) -> DataFrame:
    """The `k` rows nearest to one query vector, with `distance`. Cells are chosen on the driver, so the filter prunes folders."""
    q = _unit(np.array([query], np.float64))
    by = np.argsort(index.angles(q)[0], kind="stable")
    by = by[index.size[by] > 0]
    read = lambda cells: index.rows(spark).filter(F.col("cell").isin([int(c) for c in cells]))
    held = lambda cells: (read(cells) if where is None else read(cells).filter(where)).drop("cell", "angle")
    some = [*by[:probes], -1]
    if exact:
        best = vectors.nearest(held(some), index.vector, list(query), index.key, k).select("distance").collect()  # k rows
        bound = best[-1].distance if len(best) == k and best[-1].distance is not None else np.inf
        some = [c for c in by if index.least(q)[0][c] <= bound] + [-1]
    return vectors.nearest(held(some), index.vector, list(query), index.key, k)


def _chosen(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """A row for each query and part of a cell to read: the nearest `probes` cells, or where `bound` is not null all others
    that can hold a row within it."""
    parts = np.append(-(-index.size // PART_ROWS), max(1, -(-index.other // PART_ROWS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                q = _unit(one.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(one), -1))
                angle = np.where(index.size > 0, index.angles(q), np.inf)
                place = angle.argsort(1, kind="stable").argsort(1, kind="stable")
                bound = one.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                first = np.isnan(bound)[:, None]
                take = np.where(first, place < probes, (place >= probes) & (index.least(q) <= bound[:, None])) & (index.size > 0)
                take = np.column_stack((take, first & (index.other > 0)))  # the last column is cell -1
                row, cell = np.nonzero(take)
                n = parts[cell]
                row, cell, part = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.where(cell == len(index.size), -1, cell)
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array(row)), one.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], ["query_id", "query", "cell", "part"])

    kind = T.StructType([queries.schema["query_id"], queries.schema["query"], T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())])
    return queries.select("query_id", "query", "bound").mapInArrow(task, kind)


def _compared(index: Index, chosen: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The `k` nearest rows of each query in each part of a cell that it reads."""
    key, vector, d = index.key, index.vector, index.centres.shape[1]
    parts = {int(c): int(n) for c, n in enumerate(-(-index.size // PART_ROWS)) if n > 1} | {-1: max(1, -(-index.other // PART_ROWS))}
    count = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in parts.items() for x in p)), F.col("cell")), F.lit(1))
    items = items.withColumn("part", F.pmod(F.xxhash64(key), count).cast("int")).select("cell", "part", key, vector)
    kind = T.StructType([chosen.schema["query_id"], T.StructField(key, items.schema[key].dataType), T.StructField("distance", T.DoubleType())])

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], key: [], "distance": []})
        good = [v is not None and len(v) == d and bool(np.isfinite(np.array(v, float)).all()) for v in rows[vector]]
        x = np.array([v if g else np.zeros(d) for v, g in zip(rows[vector], good, strict=True)], np.float64)
        out = []
        rows = rows.reset_index(drop=True)
        for a in range(0, len(queries), 512):
            some = queries.iloc[a : a + 512]
            distance = np.round(np.maximum(0, 1 - _unit(np.array(some["query"].tolist(), np.float64)) @ _unit(x).T), 12)
            distance[:, ~np.array(good)] = np.nan
            for i, q in enumerate(some.query_id):
                top = np.lexsort((rows[key].to_numpy(), distance[i]))[:k]
                out.append(pd.DataFrame({"query_id": [q] * len(top), key: rows[key].to_numpy()[top], "distance": distance[i][top]}))
        return pd.concat(out)

    found = chosen.groupBy("cell", "part").cogroup(items.groupBy("cell", "part")).applyInPandas(compare, kind)
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def nearest_many(index: Index, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, key, distance, rank): the `k` rows nearest to each of `queries(query_id, query)`, all at once.

    Queries with unsound vectors have no rows. The exact way compares each query with further cells only where these can hold
    a row nearer than its k-th so far.
    """
    rows = index.rows(queries.sparkSession)
    sound = queries.filter(_sound(F.col("query"), index.centres.shape[1]))
    found = _compared(index, _chosen(index, sound.withColumn("bound", F.lit(None).cast("double")), probes), rows, k)
    if exact:
        found = kept(_first(found, ["query_id"], index.key, k).drop("rank"))
        last = found.groupBy("query_id").agg(F.when((F.count("*") == k) & (F.count("distance") == k), F.max("distance")).otherwise(float("inf")).alias("bound"))
        again = sound.join(last, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = found.unionByName(_compared(index, _chosen(index, again, probes), rows, k))
    return _first(found, ["query_id"], index.key, k)
