"""Operators on keys that hold most rows: against the twins on skewed tables, and against brute force."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seawake.operators import blocks, quantiles, series
from seawake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The test tables with nine in ten events of one vessel."""
    folder = tmp_path_factory.mktemp("skewed")
    events = pd.read_parquet(f"{SF}/events.parquet")
    events.loc[events.index % 10 != 0, "user_id"] = 7
    events.to_parquet(folder / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    (folder / "nation.parquet").symlink_to(f"{SF}/nation.parquet")
    return str(folder)


def whole_key_windows(df, key):
    """Windows of a plan that are partitioned by the key alone and read more than the ends of blocks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Window [" in line and f", [{key}#" in line and "_block" not in line.split(f", [{key}#")[1].split("]")[0] and "_last" not in line and "_call" not in line and "_sum" not in line]


@pytest.mark.parametrize("name", ["asof_calls", "carbon_segments", "track_features", "eta_labels", "occupancy_hourly", "jump_events"])
def test_twin_with_one_vessel_that_holds_most_rows(spark, skewed, name):
    from test_queries import rows

    con = duckdb.connect()
    for t in ("events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{skewed}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, skewed)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-6 * abs(x) for x, y in zip(a, b, strict=True)), (a, b)
    if name != "occupancy_hourly":
        assert not whole_key_windows(df, "mmsi")


def test_neighbours_and_sums_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 1, 30, 500]) + i), rng.randint(0, 9)) for k in ("a", "b", None) for i in range(60)] + [("c", 1, None, 3), ("c", 2, None, 4)]
    df = blocks.by_block(spark.createDataFrame(rows, "k string, i int, t timestamp, v int").repartition(4), "t")
    out = blocks.running_sum(blocks.neighbours(df, "k", ["t", "i"], ["i", "v"]), "k", ["t", "i"], F.col("v"), "s")
    got = {(r.k, r.i): (r._prev and r._prev.i, r._next and r._next.i, r.s) for r in out.collect()}
    for k in ("a", "b", None, "c"):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] or dt.datetime(1, 1, 1), r[1]))
        for n, r in enumerate(mine):
            assert got[k, r[1]] == (mine[n - 1][1] if n else None, mine[n + 1][1] if n + 1 < len(mine) else None, sum(x[3] for x in mine[: n + 1]))


@pytest.mark.parametrize("few", [1, 7, 1 << 16])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", 4)
    rng = np.random.default_rng(few)
    groups = {
        "normal": rng.normal(size=80).tolist(), "wide": [float(s) * 10.0**e for e in range(-12, 13, 2) for s in (-3, 1, 2)] + [1.7e308, -1.7e308], "equal": [2.5] * 50, "two": [1.0] * 30 + [2.0] * 31,
        "one": [4.0], None: [*range(20)], "none": [None, float("nan"), float("inf")], "zeros": [-0.0, 0.0, 0.0, 1.0],
    }
    rows = [(k, float(v) if v is not None else None, "x") for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double, n string").repartition(3)
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.quantiles for r in quantiles.quantiles(df, ["k"], "v", at).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for k, q in got.items():
        if k != "wide":
            assert np.allclose(q, np.quantile(np.array(groups[k], float), at), rtol=1e-12, atol=1e-300), k
        else:
            s = sorted(groups[k])
            assert q[0] == s[0] and q[-1] == s[-1] and np.isclose(q[3], np.quantile(s, 0.5), rtol=1e-12)
    assert quantiles.quantile(df.filter("false"), F.col("v"), [0.5]).collect()[0].quantiles is None


def test_presence_equals_a_grid_of_hours(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(200):
        start = t0 + dt.timedelta(minutes=rng.randint(0, 6000))
        rows.append((rng.choice("pq"), rng.randint(1, 4), start, start + dt.timedelta(minutes=rng.choice([-5, 0, 10, 300, 4000]))))
    df = spark.createDataFrame(rows, "port string, ship int, a timestamp, d timestamp")
    want = {}
    for p, s, a, d in rows:
        h = a.replace(minute=0, second=0)
        while a <= d and h <= d:
            want.setdefault((p, h), []).append(s)
            h += dt.timedelta(hours=1)
    got = {(r.port, r.datetime_hour): (r.members, r.events) for r in series.present(df, ["port"], "ship", "a", "d").collect()}
    assert got == {k: (len({*v}), len(v)) for k, v in want.items()}
