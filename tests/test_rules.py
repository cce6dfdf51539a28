"""Rules on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seawake.functions import geo, labels, text
from seawake.operators import series, vectors
from seawake.plans import carbon, forecast, kpi, learning, questions, retrieval, tracks
from seawake.sources import feeds
from seawake.streaming import activity

T = dt.datetime


def values(spark, f, *items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_text_rules(spark):
    assert values(spark, text.identifier, "266232000.0", " 7 ", None) == ["266232000", "7", ""]
    assert values(spark, text.destination, "SE GOT", "se-got", "lv v-nt", "", None, "fi hel", "HAMBURG") == ["SEGOT", "SEGOT", "LVVNT", "UNKNOWN", "UNKNOWN", "FIHEL", "HAMBURG"]
    assert values(spark, text.locode, " lv vnt", None, "nan") == ["LVVNT", "", ""]
    assert values(spark, text.vessel_class, "Oil Tanker", "big fishing boat", None, "yacht") == ["tanker", "service", "unknown", "unknown"]
    assert values(spark, text.number, "1,5", "2.5", "x", None) == [1.5, 2.5, None, None]
    assert values(spark, text.country, "SEGOT", "S", None) == ["SE", "UNK", "UNK"]
    assert values(spark, lambda c: text.chunk_texts(c, 4, 1), "abcdefgh", "", None) == [["abcd", "defg", "gh"], [], []]


def test_feeds(spark, tmp_path):
    (tmp_path / "ais.csv").write_text(
        "MMSI,TimePosition,Latitude,Longitude,Speed,Course,Heading,NavStatus,IMO,Name,Destination,VesselType\n"
        "266232000.0,2021-01-01T00:04:03.000Z,57.7,11.9,10,90,90,0,1,A,se-got,Cargo\n"
        "1,broken,57.7,11.9,10,90,90,0,1,A,X,Cargo\n2,2021-01-01T00:04:03.000Z,91,11.9,10,90,90,0,1,A,X,\n"
    )
    raw = feeds.read_csv(spark, str(tmp_path / "ais.csv"))
    assert feeds.feed_kind(raw.columns) == "position"
    positions, calls = feeds.ingest([("ais", raw), ("other", spark.createDataFrame([(1,)], "a int"))])
    assert calls is None
    (r,) = positions.collect()
    assert (r.mmsi, r.destination_norm, r.stable_id) == ("266232000", "SEGOT", "266232000_2021-01-01T00:04:03_57.70000_11.90000")
    feeds.write_mart(positions, str(tmp_path / "mart"))
    assert feeds.read_mart(spark, str(tmp_path / "mart"), positions.schema, ["mmsi"]).count() == 1
    assert feeds.read_mart(spark, str(tmp_path / "none"), positions.schema).count() == 0
    feeds.write_json_lines(positions.select("mmsi"), str(tmp_path / "json"))
    assert feeds.read_json_lines(spark, str(tmp_path / "json"), "mmsi string").count() == 1


def test_call_feed(spark):
    row = ("1", "Ventspils", " lv vnt", "2021-01-01T00:00:00Z", "2021-01-02T00:00:00Z", "7.0", "9", "A", "x", "y", None)
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in feeds.CALL_COLUMNS))
    (r,) = feeds.clean_calls(df, "f").collect()
    assert (r.port_key, r.port_label, r.mmsi, r.vessel_type_norm) == ("LVVNT", "Ventspils (LVVNT)", "7", "unknown")


def test_asof_ties_and_exact_times(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 1), ("b", 4, 5), (None, 5, 5)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 5, "y", 2), ("a", 9, "z", 3)], "k string, u int, v string, n int")
    got = {r.id: r.v for r in series.asof(left, right, "k", "t", "u", ["v"], "n").collect()}
    assert got == {1: "y", 2: "z", 3: None, 4: None, 5: None}


def test_occupancy_hours(spark):
    stays = spark.createDataFrame([("1", "P", "P", T(2024, 1, 1, 0, 30), T(2024, 1, 1, 2, 0))], "mmsi string, port_key string, port_label string, arrival_time timestamp, departure_time timestamp")
    assert sorted(r.datetime_hour.hour for r in kpi.occupancy(stays).collect()) == [0, 1, 2]


def test_dwell_limits(spark):
    day = lambda n: T(2024, 1, 1) + dt.timedelta(days=n)
    stays = spark.createDataFrame([(i, day(0), day(n)) for i, n in enumerate((-1, 0, 1, 45, 46))], "i int, arrival_time timestamp, departure_time timestamp")
    assert sorted(r.i for r in kpi.dwell(stays).collect()) == [2, 3]


def test_one_step_and_horizon(spark):
    v = [3.0, 5.0, 4.0, 8.0, 2.0, 7.0, 6.0, 9.0, 1.0]
    df = spark.createDataFrame([("p", dt.date(2024, 1, 1 + i), x) for i, x in enumerate(v)], "k string, d date, v double")
    step = lambda h: max(0.0, h[-1] if len(h) == 1 else 0.7 * (h[-7] if len(h) >= 7 else h[-1]) + 0.3 * sum(h[-7:]) / len(h[-7:]))
    got = [r.predicted for r in series.one_step(df, ["k"], "d", "v").orderBy("d").collect()]
    assert got[0] is None and got[1:] == pytest.approx([step(v[:i]) for i in range(1, len(v))])
    h = list(v)
    for _ in range(10):
        h.append(step(h))
    out = series.horizon(df, ["k"], "d", "v", 10).orderBy("step").collect()
    assert [r.predicted for r in out] == pytest.approx(h[len(v) :])
    assert out[0].date == dt.date(2024, 1, 10) and out[3].upper - out[3].predicted == pytest.approx(2 * (out[0].upper - out[0].predicted))
    short = series.horizon(df.limit(1), ["k"], "d", "v", 3).collect()
    assert [r.predicted for r in short] == pytest.approx([3.0, 3.0, 3.0])


def test_scenario_by_hand(spark):
    (r,) = carbon.scenario(spark, "tanker", "manoeuvring", 2, 6).collect()
    assert (r.load_factor, r.fuel_t, r.co2_t, r.wtt_co2e_t, r.wtw_co2e_t, r.nox_kg, r.pm_kg, r.sox_kg) == pytest.approx((0.2, 1.4735, 4.588479, 1.09039, 5.678869, 91.357, 2.283925, 4.4205))


def test_labels_and_geo(spark):
    df = spark.createDataFrame([(0.2, 10.0), (12.0, 10.0)], "b double, x double")
    assert [r[0] for r in df.select(labels.percent_change(F.lit(12.0), F.when(F.col("b") > 1, F.col("x")).otherwise(F.col("b")), 1.0)).collect()] == [None, pytest.approx(20.0)]
    one = spark.range(1)
    assert one.select(geo.turn_deg(F.lit(350.0), F.lit(10.0))).first()[0] == 20
    assert one.select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0] == pytest.approx(111.195, abs=0.01)
    assert [one.select(labels.congestion_level(F.lit(v))).first()[0] for v in (0.5, 1.0, 1.5, 2.0)] == ["below normal", "normal", "elevated", "high"]


def test_jumps(spark):
    rows = [(1, "a", T(2024, 1, 1, 0, 0), 54.0, 10.0), (2, "a", T(2024, 1, 1, 0, 10), 54.3, 10.0), (3, "a", T(2024, 1, 1, 2, 0), 60.0, 10.0), (4, "a", T(2024, 1, 1, 2, 5), 60.06, 10.0)]
    df = spark.createDataFrame(rows, "position_id int, mmsi string, timestamp timestamp, latitude double, longitude double")
    assert sorted(r.position_id for r in tracks.jumps(df).collect()) == [2, 4]


def test_call_lookup(spark):
    calls = spark.createDataFrame([("111_2022-03-05T10-00-00_SEGOT",), ("222_x",), ("22_2x",)], "call_id string")
    assert carbon.find_call(calls, "111 2022-03-05t10-00-00 segot").count() == 1
    assert carbon.find_call(calls, "222x").count() == 0
    assert carbon.find_call(calls, "222_x").count() == 1


def test_ranks_without_one_task(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("v"))
    rows, n = learning.ranked(df, ["v"])
    assert n == 1000 and rows.filter("v <> position").count() == 0
    assert sorted(r.v for r in learning.evenly(df, ["v"], 10).collect()) == [i * 999 // 9 for i in range(10)]
    assert learning.evenly(df.limit(0), ["v"], 10).count() == 0


def test_retrieval(spark):
    q = spark.createDataFrame([("What does the regulation say?",), ("arrivals of vessels",), ("hello",)], "question string")
    assert [r.route for r in retrieval.routed(q).collect()] == ["docs", "traffic", "both"]
    assert retrieval.visible_text("<script>x</script><header>h</header><p>a <b>b</b></p>") == "a b"
    catalog = spark.createDataFrame([("LVVNT", "Ventspils", 100), ("SEGOT", "Göteborg", 90)], "port_key string, port_label string, arrivals_total long")
    asked = spark.createDataFrame([("Port of Ventspils",), ("Goteborg",), ("Ventspilss",), ("DAILY",), (None,)], "asked string")
    got = {r.asked: r.port_key for r in retrieval.resolve_ports(asked, catalog.repartition(2)).collect()}
    assert [got[r.asked] for r in asked.collect()] == ["LVVNT", "SEGOT", "LVVNT", None, None]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id int, v array<double>")
    assert [(r.id, r.distance) for r in vectors.nearest(zero, "v", [1.0, 1.0], "id", 2).collect()] == [(2, pytest.approx(0.0)), (1, 1.0)]


def test_analog_of_one_day(spark):
    df = spark.createDataFrame([("p", dt.date(2023, 3, 14), 10.0)], "port_key string, date date, value double")
    (r,) = forecast.seasonal_analog(df, "2024-03-14").collect()
    assert (r.tier, r.samples, r.lower, r.upper, r.confidence) == (1, 1, pytest.approx(8.0), pytest.approx(12.0), "low")


def test_streams(spark, tmp_path):
    rows = [("a", T(2024, 1, 1, 0, m), "P", 5.0) for m in (0, 10, 50)] + [("a", T(2024, 1, 2), "P", 1.0)]
    spark.createDataFrame(rows, "mmsi string, timestamp timestamp, port_key string, speed double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi string, timestamp timestamp, port_key string, speed double").parquet(str(tmp_path / "in"))
    for i, f in enumerate((activity.hourly_reports, activity.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"out{i}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r.reports for r in spark.table("out0").collect()] == [3]
    assert sorted(r.reports for r in spark.table("out1").collect()) == [1, 2]


def test_questions(spark):
    asked = [
        ("Show daily arrival counts at LVVNT between 2022-02-01 and 2022-02-28.", "A", ["LVVNT"]), ("Show monthly WTW CO2e trend for SETRG in 2022.", "H", ["SETRG"]),
        ("What is truck turn-time at the gate for SEGOT today?", "G", ["SEGOT"]), ("Give exact berth-level queue length for vessel arrivals at GDANSK.", "G", ["GDANSK"]),
        ("Compare Fridays with Mondays near Riga", "B", ["Riga"]), ("Compare SE GOT with lt klj", "D", ["SEGOT", "LTKLJ"]), ("", "A", []), (None, None, None),
    ]
    got = questions.understood(spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(asked)], "k int, question string"), F.lit("2024-01-03").cast("date"))
    for r in got.collect():
        _, kind, ports = asked[r.k]
        assert kind is None or (r.intent, r.ports.split(",") if r.ports else []) == (kind, ports), r
    days = spark.createDataFrame([("next Wednesday",), ("this wednesday",), ("next Friday",), ("on Friday, February 20, 2026",), ("in May 2022",), ("last 6 weeks",)], "question string")
    got = [(str(r.date_from), str(r.date_to), r.window, r.horizon_weeks) for r in questions.understood(days.coalesce(1), F.lit("2024-01-03").cast("date")).collect()]
    assert got == [("2024-01-10", "2024-01-10", None, 4), ("2024-01-03", "2024-01-03", None, 4), ("2024-01-05", "2024-01-05", None, 4), ("2026-02-20", "2026-02-20", None, 4), ("2022-05-01", "2022-05-31", None, 4), ("None", "None", "last_6_weeks", 6)]


def test_gaps_count_as_medians(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)] + [(100, None, 2.0), (101, None, None), (102, 500.0, 400.0)], "k int, a double, b double")
    got = {r.k: r.anomaly_score for r in learning.isolation_score(rows, ["a", "b"], learning.fit_isolation(rows, ["a", "b"])).collect()}
    assert got[101] is None and got[100] is not None and got[102] == max(v for v in got.values() if v is not None)


def test_marts_are_built_once_and_models_come_back(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(float(i % 9), float(i)) for i in range(60)], "speed double, eta_minutes_label double").selectExpr("*", *(f"speed + {k} AS {c}" for k, c in enumerate(learning.FEATURES[1:])))

    mart = feeds.ensure_mart(spark, str(tmp_path / "mart"), build)
    assert feeds.ensure_mart(spark, str(tmp_path / "mart"), build).count() == mart.count() == 60 and len(built) == 1
    feeds.write_manifest(kpi.capabilities(spark.createDataFrame([("A", dt.date(2024, 1, 1))], "port_key string, date date"), spark.createDataFrame([(1.0,)], "dwell_minutes double")), str(tmp_path / "facts"))
    assert spark.read.json(str(tmp_path / "facts")).first().ports == 1
    model = learning.train_eta(mart, rounds=2)
    learning.save_model(model, str(tmp_path / "model"))
    assert [r.prediction for r in learning.load_model(str(tmp_path / "model")).transform(mart).collect()] == [r.prediction for r in model.transform(mart).collect()]


def test_modes_at_the_berth(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    rows = spark.createDataFrame([(1, t(5), 0.2), (2, t(9), 1.0), (3, t(14), 1.0), (4, t(14), 9.0), (5, t(1), 3.0)], "k int, timestamp timestamp, speed double")
    rows = rows.withColumns({"speed_estimated_kn": F.lit(None).cast("double"), "inside_call": F.lit(True), "arrival_time": F.lit(t(0)), "departure_time": F.lit(t(20))})
    assert [r["mode"] for r in carbon.modes(rows).orderBy("k").collect()] == ["berth", "anchorage", "anchorage", "transit", "manoeuvring"]
    assert [r["mode"] for r in carbon.modes(rows.withColumn("berth_timestamp", F.lit(t(12)))).orderBy("k").collect()] == ["berth", "anchorage", "berth", "berth", "manoeuvring"]


def test_draws_are_normal_and_bounds_near_the_closed_form():
    import numpy as np

    from seawake.functions import emission

    rng = np.random.default_rng(1)
    seed, other = (rng.integers(0, 1 << 32, 400) for _ in range(2))
    z = emission.normals(seed, other, 500)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(np.corrcoef(z[:, :-1].ravel(), z[:, 1:].ravel())[0, 1]) < 0.01 and (emission.normals(seed, other, 500) == z).all()
    total, sigma = np.array([10.0, 0.0, -1.0, 5.0]), np.array([0.2, 0.2, 0.2, 0.9])
    low, high = emission.sampled_bounds(total, sigma, seed[:4], other[:4])
    assert abs(low[0] - 10 * (1 - 1.96 * 0.2)) < 0.8 and abs(high[0] - 10 * (1 + 1.96 * 0.2)) < 0.8 and low[1] == high[1] == low[2] == high[2] == 0 and low[3] == 0 and high[3] > 10


def test_questions_are_routed(spark):
    from seawake.plans import dispatch

    asked = {
        "How long did MMSI 123456789 stay in port?": "port_stays", "Which are the top ports?": "top_ports", "Average dwell of tankers": "dwell", "Is Friday busier versus Monday?": "compare_weekdays", "Busiest hour?": "busiest_hour",
        "Busiest weekday?": "busiest_weekday", "Predict congestion on 2024-02-10": "forecast_date", "Predict congestion": "forecast_weekday", "Compare ports": "compare_ports", "Why so slow?": "diagnose", "Unusual spike": "spikes",
        "Impossible teleport": "jumps", "TEU throughput": "unsupported", "CO2 next year": "forecast_only", "monthly co2": "port_by_month", "co2 in 2024-01": "port_by_day", "co2 for mmsi 123456789 call_id_9": "call", "estimate co2 of 2 hours": "estimate", "hello": "arrivals",
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "question_id long, question string")
    got = {r.question: r.route for r in dispatch.routed(questions.understood(df, F.lit("2024-01-31").cast("date"))).select("question", "route").collect()}
    assert got == asked and {*asked.values()} <= {*dispatch.ROUTES}
