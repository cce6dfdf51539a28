"""Stored marts against full builds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seawake.plans import carbon, kpi
from seawake.sources import bindings as B
from seawake.sources import feeds, marts

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_only_changed_days_are_built(spark, tmp_path):
    calls = B.port_calls(spark, SF).withColumn("date", F.col("arrival_time").cast("date"))
    path, day = str(tmp_path / "m"), dt.date(2024, 1, 10)
    first = marts.refresh(calls.filter(F.col("date") != F.lit(day)), "date", kpi.call_arrivals, path)
    assert len(first) > 5 and day not in first and rows(marts.read(spark, path)) == rows(kpi.call_arrivals(calls.filter(F.col("date") != F.lit(day))))
    assert marts.refresh(calls, "date", kpi.call_arrivals, path) == [day] and rows(marts.read(spark, path)) == rows(kpi.call_arrivals(calls))
    assert marts.refresh(calls, "date", kpi.call_arrivals, path) == []
    doubled = calls.unionByName(calls.filter(F.col("date") == F.lit(day)).limit(1))  # a repeated row counts
    assert marts.refresh(doubled, "date", kpi.call_arrivals, path) == [day]
    gone = calls.filter(F.col("date") != F.lit(day))
    assert marts.refresh(gone, "date", kpi.call_arrivals, path) == [day] and rows(marts.read(spark, path)) == rows(kpi.call_arrivals(gone))


def test_emissions_from_segments_of_changed_vessels(spark, tmp_path):
    positions, calls = B.positions(spark, SF), B.port_calls(spark, SF)
    path = str(tmp_path / "segments")
    build = lambda p: carbon.segments(carbon.row_emissions(spark, p.drop("unit"), calls)).withColumn("unit", marts.bucket("mmsi", 8))
    source = positions.withColumn("unit", marts.bucket("mmsi", 8))
    last = positions.agg(F.max(F.col("timestamp").cast("date"))).first()[0]
    before = source.filter((F.col("timestamp").cast("date") < F.lit(last)) | (F.col("unit") > 1))  # the last day of two units comes later
    assert len(marts.refresh(before, "unit", build, path)) == before.select("unit").distinct().count()
    assert set(marts.refresh(source, "unit", build, path)) <= {0, 1}
    full = carbon.daily_port(carbon.segments(carbon.row_emissions(spark, positions, calls)))
    assert rows(carbon.daily_port(marts.read(spark, path).drop("unit"))) == rows(full)


def test_a_mart_that_cannot_be_read_is_not_overwritten(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "notes.txt").write_text("kept")
    with pytest.raises(Exception):  # noqa: B017
        feeds.ensure_mart(spark, str(tmp_path / "m"), lambda: spark.range(1))
    assert (tmp_path / "m" / "notes.txt").read_text() == "kept"
    assert feeds.ensure_mart(spark, str(tmp_path / "n"), lambda: spark.range(3)).count() == 3
