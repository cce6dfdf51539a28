"""The stored vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seawake.operators import vector_index as vi
from seawake.operators import vectors

KIND = "id long, v array<float>, note string"


def clustered(rng, n, d=12, groups=9):
    centres = rng.standard_normal((groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)


def brute(x, ids, q, k):
    x, q = x.astype(np.float64), np.asarray(q, np.float64)
    d = np.round(1 - x @ q / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(q), 1e-300), 9)
    return [ids[i] for i in np.lexsort((ids, d))[:k]]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = clustered(rng, 900)
    x[5] = x[6]
    return x


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), "n") for i, v in enumerate(x)], KIND).repartition(3)


def many(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_search_is_exact_and_probing_is_nearly_so(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 25)
    index = vi.build(table(spark, data), "id", "v", str(tmp_path / "i"), seed=3)
    assert len(index.centres) == 30 and index.size.sum() == len(data) and vi.load(spark, index.path).size.tolist() == index.size.tolist()
    queries = table(spark, data[::30]).select((F.col("id") * 30).alias("query_id"), F.col("v").alias("query"))
    want = {30 * i: brute(data, np.arange(len(data)), q, 7) for i, q in enumerate(data[::30])}
    assert many(vi.nearest_many(index, queries, 7, exact=True)) == want
    probed = many(vi.nearest_many(index, queries, 7, probes=6))
    assert np.mean([len({*probed[q]} & {*want[q]}) / 7 for q in want]) >= 0.95
    one = vi.nearest(index, spark, data[30].tolist(), 7, exact=True)
    assert [r.id for r in one.collect()] == want[30] == [r.id for r in vectors.nearest(table(spark, data), "v", data[30].tolist(), "id", 7).collect()]
    plan = vi.nearest(index, spark, data[30].tolist(), 7)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    few = vi.nearest(index, spark, data[30].tolist(), 3, exact=True, where=F.col("id") % 2 == 1)
    assert [r.id for r in few.collect()] == brute(data[1::2], np.arange(1, 900, 2), data[30], 3)


def test_upsert_moves_rows_between_cells(spark, data, tmp_path):
    index = vi.build(table(spark, data[:300]), "id", "v", str(tmp_path / "i"), cells=60)
    lone = int(np.flatnonzero(index.size == 1)[0]) if (index.size == 1).any() else None
    moved = data[:300].copy()
    moved[::2] = -moved[::2]  # every second row goes elsewhere, and cells become empty
    grown = np.concatenate((moved, data[300:340]))
    index = vi.upsert(index, table(spark, np.concatenate((moved[::2], data[300:340]))).withColumn("id", F.when(F.col("id") < 150, F.col("id") * 2).otherwise(F.col("id") + 150)))
    assert index.size.sum() == 340 and index.rows(spark).count() == 340 and (lone is None or index.size[lone] >= 0)
    queries = table(spark, grown[::20]).select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    assert many(vi.nearest_many(vi.load(spark, index.path), queries, 4, exact=True)) == {i: brute(grown, np.arange(340), q, 4) for i, q in enumerate(grown[::20])}


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "zero"), (3, None, "null"), (4, [1.0], "short"), (5, [float("nan"), 1.0], "nan"), (None, [1.0, 1.0], "no id"), (6, [0.0, 2.0], "b"), (7, [1.0, None], "hole")]
    index = vi.build(spark.createDataFrame(rows, KIND), "id", "v", str(tmp_path / "i"))
    got = vi.nearest(index, spark, [1.0, 1.0], 9, exact=True).collect()
    assert [r.id for r in got][:3] == [1, 6, 2] and abs(got[0].distance - (1 - 0.5**0.5)) < 1e-12 and got[2].distance == 1.0 and {r.id for r in got[3:]} == {4, 5, 7} and all(r.distance is None for r in got[3:])
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, None), (2, [0.0, 0.0])], "query_id int, query array<double>")
    assert many(vi.nearest_many(index, q, 3, exact=True)) == {0: [1, 6, 2]}
    empty = vi.build(spark.createDataFrame([], KIND), "id", "v", str(tmp_path / "e"))
    assert vi.nearest(empty, spark, [1.0], 3, exact=True).count() == 0 and vi.nearest_many(empty, spark.createDataFrame([(0, [1.0])], "query_id int, query array<double>"), 3, exact=True).count() == 0
