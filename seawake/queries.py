"""Registered queries over the bound test tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.functions import emission, labels, text
from seawake.operators import vector_index, vectors
from seawake.plans import answers, carbon, dispatch, forecast, kpi, learning, portday, questions, retrieval, tracks
from seawake.session import kept, shared_folder
from seawake.sources import bindings as B
from seawake.sources import feeds, marts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name; in both engines doubles are rounded to six places and the columns
    named in `dates` are text."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(F.col(c), 6) if kind == "double" else F.col(c).cast("string") if kind == "date" else F.col(c)).alias(c) for c, kind in df.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            shown = ", ".join(f"{d}::VARCHAR AS {d}" for d in dates.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if shown else sql
        return run

    return register


def stamp(c: str) -> object:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# ---- SQL of the bindings

KINDS = "['oil tanker', 'bulk carrier', 'container ship', 'passenger', 'tug', 'other']"
CALLS = """calls AS (SELECT o_custkey::VARCHAR AS mmsi, replace(upper(n_name), ' ', '_') AS port_key, n_name AS port_label, o_orderdate AS arrival_time, lower(c_mktsegment) AS vessel_type_norm, o_orderkey, o_orderdate::DATE AS date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DAILY = "daily AS (SELECT port_key, port_label, date, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM calls GROUP BY ALL)"
STAYS = "stays AS (SELECT * FROM (SELECT calls.*, l_linenumber, l_shipdate AS departure_time, (epoch_us(l_shipdate) - epoch_us(arrival_time)) / 6e7 AS dwell_minutes FROM calls JOIN lineitem ON o_orderkey = l_orderkey) WHERE dwell_minutes > 0 AND dwell_minutes <= 64800)"
POSITIONS = f"""positions AS (SELECT event_id AS position_id, user_id::VARCHAR AS mmsi, ts AS timestamp, value / 10 AS speed, 54.0 + (user_id % 10) * 0.5 + (event_id % 97) / 400.0 AS latitude, 10.0 + (user_id % 7) + (event_id % 89) / 400.0 AS longitude,
  ((event_id * 37) % 360)::DOUBLE AS course, n_name AS destination_raw, {KINDS}[user_id % 6 + 1] AS vessel_type_norm, replace(upper(n_name), ' ', '_') AS port_key, n_name AS port_label
  FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type <> 'purchase')"""
PORT_CALLS = f"""port_calls AS (SELECT event_id AS call_no, user_id::VARCHAR AS mmsi, ts AS arrival_time, make_timestamp(epoch_us(ts) + round(value * 720)::BIGINT * 1000000) AS departure_time, replace(upper(n_name), ' ', '_') AS port_key, n_name AS port_label,
  {KINDS}[user_id % 6 + 1] AS vessel_type_norm, ['SEGOT', 'LVRIX', 'DEKEL'][event_id % 3 + 1] AS origin, ['LTKLJ', 'DETRV'][event_id % 2 + 1] AS next_port,
  user_id::VARCHAR || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || replace(upper(n_name), ' ', '_') AS call_id
  FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'purchase')"""
PC_STAYS = "pc_stays AS (SELECT *, (epoch_us(departure_time) - epoch_us(arrival_time)) / 6e7 AS dwell_minutes FROM port_calls WHERE departure_time > arrival_time AND epoch_us(departure_time) - epoch_us(arrival_time) <= 3888000000000)"
PROXY = "proxy AS (SELECT port_key, port_label, timestamp::DATE AS date, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(DISTINCT mmsi) AS arrivals_events FROM positions GROUP BY ALL)"


def W(*parts: str, tail: str) -> str:  # noqa: N802
    return f"WITH {', '.join(parts)} {tail}"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.call_arrivals(B.calls(spark, sf))


def proxy(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.proxy_arrivals(B.positions(spark, sf))


# ---- port activity


@query(W(CALLS, DAILY, tail="SELECT * FROM daily"), dates="date")
def arrivals_daily(spark, sf):
    return daily(spark, sf)


@query(W(POSITIONS, PROXY, tail="SELECT * FROM proxy"), dates="date")
def arrivals_daily_proxy(spark, sf):
    return proxy(spark, sf)


@query(W(POSITIONS, tail="SELECT port_key, port_label, strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS datetime_hour, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(DISTINCT mmsi) AS arrivals_events FROM positions GROUP BY ALL"))
def arrivals_hourly_proxy(spark, sf):
    return kpi.proxy_arrivals(B.positions(spark, sf), "hour").withColumn("datetime_hour", stamp("datetime_hour"))


@query(W(PORT_CALLS, tail="SELECT port_key, port_label, strftime(date_trunc('hour', arrival_time), '%Y-%m-%d %H:%M:%S') AS datetime_hour, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM port_calls GROUP BY ALL"))
def arrivals_hourly(spark, sf):
    return kpi.call_arrivals(B.port_calls(spark, sf), "hour").withColumn("datetime_hour", stamp("datetime_hour"))


@query(W(CALLS, STAYS, tail="SELECT mmsi, port_key, port_label, date, vessel_type_norm, o_orderkey, l_linenumber, dwell_minutes FROM stays"), dates="date")
def dwell_time(spark, sf):
    return B.stays(spark, sf).select("mmsi", "port_key", "port_label", "date", "vessel_type_norm", "o_orderkey", "l_linenumber", "dwell_minutes")


OCCUPANCY = """SELECT port_key, port_label, strftime(h, '%Y-%m-%d %H:%M:%S') AS datetime_hour, count(DISTINCT mmsi) AS occupancy_vessels, count(*) AS occupancy_events
FROM (SELECT *, unnest(generate_series(date_trunc('hour', arrival_time), date_trunc('hour', departure_time), INTERVAL 1 HOUR)) AS h FROM pc_stays) GROUP BY ALL"""


@query(W(PORT_CALLS, PC_STAYS, tail=OCCUPANCY))
def occupancy_hourly(spark, sf):
    return kpi.occupancy(kpi.dwell(B.port_calls(spark, sf))).withColumn("datetime_hour", stamp("datetime_hour"))


INDEX = """a AS (SELECT port_key, date, min(port_label) AS port_label, sum(arrivals_vessels)::BIGINT AS v, sum(arrivals_events)::BIGINT AS e FROM daily GROUP BY ALL),
p AS (SELECT port_key, date, min(port_label) AS port_label, sum(arrivals_vessels)::BIGINT AS v, sum(arrivals_events)::BIGINT AS e FROM proxy GROUP BY ALL),
j AS (SELECT coalesce(a.port_key, p.port_key) AS port_key, coalesce(a.date, p.date) AS date, coalesce(a.port_label, p.port_label) AS port_label, CASE WHEN a.port_key IS NOT NULL THEN 'port_call' ELSE 'ais_destination_proxy' END AS source_kind,
  coalesce(a.v, p.v)::DOUBLE AS arrivals_vessels, coalesce(a.e, p.e)::DOUBLE AS arrivals_events FROM a FULL JOIN p ON a.port_key = p.port_key AND a.date = p.date),
dm AS (SELECT port_key, date, median(dwell_minutes) AS median_dwell_minutes FROM stays GROUP BY ALL),
r AS (SELECT j.*, median_dwell_minutes, median_dwell_minutes IS NOT NULL AS has_dwell, arrivals_vessels / nullif(median(arrivals_vessels) OVER (PARTITION BY port_key), 0) AS arrivals_ratio,
  median_dwell_minutes / nullif(median(median_dwell_minutes) OVER (PARTITION BY port_key), 0) AS dwell_ratio FROM j LEFT JOIN dm USING (port_key, date)),
idx AS (SELECT *, CASE WHEN dwell_ratio IS NULL THEN arrivals_ratio ELSE arrivals_ratio + dwell_ratio END AS congestion_index FROM r)"""
R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


def index(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.congestion(daily(spark, sf), proxy(spark, sf), B.stays(spark, sf))


@query(W(CALLS, DAILY, STAYS, POSITIONS, PROXY, INDEX, tail=f"SELECT port_key, date, port_label, source_kind, arrivals_vessels, arrivals_events, has_dwell, {R6('median_dwell_minutes', 'arrivals_ratio', 'dwell_ratio', 'congestion_index')} FROM idx"), dates="date")
def congestion_daily(spark, sf):
    return index(spark, sf)


@query(W(CALLS, DAILY, tail="SELECT port_key, port_label, min(date) AS first_seen, max(date) AS last_seen, sum(arrivals_vessels)::BIGINT AS arrivals_total FROM daily GROUP BY ALL"), dates="first_seen last_seen")
def port_catalog(spark, sf):
    return kpi.port_catalog(daily(spark, sf))


@query(W(CALLS, DAILY, STAYS, tail="SELECT count(*) AS arrival_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT port_key) AS ports, (SELECT count(*) > 0 FROM stays) AS has_dwell FROM daily"), dates="first_date last_date")
def capabilities(spark, sf):
    return kpi.capabilities(daily(spark, sf), B.stays(spark, sf))


@query(W(CALLS, DAILY, tail="SELECT sum(arrivals)::BIGINT AS arrivals, count(*) AS days FROM (SELECT date, sum(arrivals_vessels) AS arrivals FROM daily WHERE port_key = 'NATION_6' AND date >= DATE '1996-01-01' AND date <= DATE '1996-12-31' AND vessel_type_norm LIKE '%auto%' GROUP BY date)"))
def get_arrivals(spark, sf):
    return kpi.arrivals(kpi.for_type(kpi.for_dates(kpi.for_port(daily(spark, sf), "nation_6"), "1996-01-01", "1996-12-31"), "auto"))


@query(W(CALLS, DAILY, tail="SELECT date, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily WHERE port_key = 'NATION_7' GROUP BY date ORDER BY arrivals DESC, date LIMIT 1"), dates="date")
def peak_day(spark, sf):
    return kpi.peak_day(kpi.for_port(daily(spark, sf), "nation_7"))


@query(W(CALLS, DAILY, tail="SELECT port_key, port_label, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily WHERE isodow(date) >= 6 GROUP BY ALL ORDER BY arrivals DESC, port_key LIMIT 10"))
def top_ports(spark, sf):
    return kpi.top_ports(kpi.for_weekday(daily(spark, sf), "Weekend"))


@query(W(CALLS, DAILY, tail="SELECT dayname(date) AS day_of_week, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY ALL ORDER BY arrivals DESC, day_of_week LIMIT 1"))
def busiest_weekday(spark, sf):
    return kpi.busiest_weekday(daily(spark, sf))


@query(W(CALLS, DAILY, "t AS (SELECT sum(arrivals_vessels) FILTER (WHERE dayname(date) = 'Monday')::BIGINT AS a, sum(arrivals_vessels) FILTER (WHERE dayname(date) = 'Friday')::BIGINT AS b FROM daily)", tail="SELECT a, b, CASE WHEN a > b THEN 'Monday' ELSE 'Friday' END AS winner, round(greatest(a, b) / greatest(least(a, b), 1), 6) AS ratio FROM t WHERE a IS NOT NULL AND b IS NOT NULL"))
def compare_weekdays(spark, sf):
    return kpi.compare_weekdays(daily(spark, sf), "Monday", "Friday")


@query(W(POSITIONS, "h AS (SELECT port_key, date_trunc('hour', timestamp) AS datetime_hour, vessel_type_norm, count(DISTINCT mmsi) AS v FROM positions GROUP BY ALL)", tail="SELECT hour(datetime_hour)::INTEGER AS hour, sum(v)::BIGINT AS arrivals FROM h GROUP BY ALL ORDER BY arrivals DESC, hour LIMIT 1"))
def busiest_hour(spark, sf):
    return kpi.busiest_hour(kpi.proxy_arrivals(B.positions(spark, sf), "hour"))


@query(W(CALLS, STAYS, tail="SELECT vessel_type_norm, count(*) AS calls, round(median(dwell_minutes), 6) AS median_minutes, round(avg(dwell_minutes), 6) AS mean_minutes FROM stays GROUP BY ALL"))
def dwell_stats(spark, sf):
    return kpi.dwell_stats(B.stays(spark, sf))


@query(W(PORT_CALLS, PC_STAYS, tail="SELECT port_key, count(*) AS stays, round(sum(dwell_minutes / 60), 6) AS hours, round(median(dwell_minutes / 60), 6) AS median_hours FROM pc_stays WHERE mmsi = '7' GROUP BY ALL"))
def port_stays(spark, sf):
    return kpi.port_stays(kpi.dwell(B.port_calls(spark, sf)), "MMSI 7")


BY_DATE = "bd AS (SELECT date, avg(congestion_index) AS congestion_index, sum(arrivals_vessels) AS arrivals, median(median_dwell_minutes) AS median_dwell_minutes FROM idx GROUP BY date)"


@query(W(CALLS, DAILY, STAYS, POSITIONS, PROXY, INDEX, BY_DATE, tail=f"SELECT date, {R6('congestion_index', 'arrivals', 'median_dwell_minutes')} FROM bd"), dates="date")
def congestion_by_date(spark, sf):
    return kpi.congestion_by_date(index(spark, sf))


@query(W(CALLS, DAILY, STAYS, POSITIONS, PROXY, INDEX.replace("FROM r)", "FROM r WHERE port_key = 'NATION_3')"), BY_DATE, tail="SELECT round(avg(congestion_index), 6) AS mean_index, round(max(congestion_index), 6) AS peak_index, (SELECT date FROM bd ORDER BY congestion_index DESC NULLS LAST, date LIMIT 1) AS peak_date, (SELECT round(avg(has_dwell::INT), 6) FROM idx) AS dwell_share FROM bd"), dates="peak_date")
def get_congestion(spark, sf):
    return kpi.congestion_summary(kpi.for_port(index(spark, sf), "NATION_3"))


@query(W(CALLS, DAILY, STAYS, POSITIONS, PROXY, INDEX, tail="""SELECT 'arrivals' AS metric, port_key, sum(arrivals_vessels)::DOUBLE AS value FROM daily GROUP BY port_key
UNION ALL SELECT 'dwell', port_key, round(median(m), 6) FROM (SELECT port_key, vessel_type_norm, median(dwell_minutes) AS m FROM stays GROUP BY ALL) GROUP BY port_key
UNION ALL SELECT 'congestion', port_key, round(avg(v), 6) FROM (SELECT port_key, date, avg(congestion_index) AS v FROM idx GROUP BY ALL) GROUP BY port_key"""))
def compare_ports(spark, sf):
    d, i, s = daily(spark, sf), index(spark, sf), B.stays(spark, sf)
    parts = [kpi.compare_ports(d, i, s, m).select(F.lit(m).alias("metric"), "port_key", "value") for m in ("arrivals", "dwell", "congestion")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(W(CALLS, DAILY, STAYS, tail="SELECT vessel_type_norm, arrivals, median_minutes FROM (SELECT vessel_type_norm, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily WHERE port_key = 'NATION_18' GROUP BY ALL) LEFT JOIN (SELECT vessel_type_norm, round(median(dwell_minutes), 6) AS median_minutes FROM stays WHERE port_key = 'NATION_18' GROUP BY ALL) USING (vessel_type_norm)"))
def diagnose_port(spark, sf):
    return kpi.diagnose(kpi.for_port(daily(spark, sf), "nation_18"), kpi.for_port(B.stays(spark, sf), "nation_18"))


PORT_DAY = "pd AS (SELECT port_key, date, min(port_label) AS port_label, sum(arrivals_vessels)::BIGINT AS arrivals_vessels, sum(arrivals_events)::BIGINT AS arrivals_events FROM daily GROUP BY ALL)"


@query(W(CALLS, DAILY, PORT_DAY, "t AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(arrivals_vessels) OVER w + 2 * coalesce(stddev_samp(arrivals_vessels) OVER w, 0) END AS threshold FROM pd WINDOW w AS (PARTITION BY port_key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))", tail="SELECT * REPLACE (round(threshold, 6) AS threshold) FROM t WHERE round(arrivals_vessels - threshold, 9) > 0"), dates="date")
def arrival_spikes(spark, sf):
    return kpi.arrival_spikes(daily(spark, sf)).filter(F.round(F.col("arrivals_vessels") - F.col("threshold"), 9) > 0)


@query(W(CALLS, DAILY, tail="SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS rows, string_agg(DISTINCT vessel_type_norm, ',' ORDER BY vessel_type_norm) AS types FROM daily"), dates="first_date last_date")
def coverage_notes(spark, sf):
    return kpi.coverage(daily(spark, sf))


@query(W(CALLS, DAILY, tail="SELECT count(*) AS rows, min(date) AS first_date FROM daily WHERE port_key = 'NATION_8' AND date >= (SELECT max(date) FROM daily WHERE port_key = 'NATION_8') - 28"), dates="first_date")
def last_four_weeks(spark, sf):
    return kpi.last_weeks(kpi.for_port(daily(spark, sf), "nation_8"), 4).agg(F.count("*").alias("rows"), F.min("date").alias("first_date"))


@query(W(PORT_CALLS, "d AS (SELECT port_key, port_label, arrival_time::DATE AS date, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM port_calls GROUP BY ALL)", tail="SELECT * FROM d"), dates="date")
def arrivals_from_mart(spark, sf):
    """Arrivals per day from a stored mart that was built without the last day and then brought up to date."""
    calls = B.port_calls(spark, sf).withColumn("date", F.col("arrival_time").cast("date"))
    path, last = f"{shared_folder(spark)}/mart-{uuid.uuid4().hex}", calls.agg(F.max("date")).first()[0]
    for part in (calls.filter(F.col("date") != F.lit(last)), calls):
        marts.refresh(part, "date", kpi.call_arrivals, path)
    return marts.read(spark, path)


# ---- tracks

HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
DELTAS = f"""l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(speed) OVER w AS ps, lag(course) OVER w AS pc FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp, position_id)),
d0 AS (SELECT *, CASE WHEN epoch_us(timestamp) > epoch_us(pt) THEN (epoch_us(timestamp) - epoch_us(pt)) / 1e6 END AS delta_time_s, {HAV.format(a='plat', b='latitude', c='plon', d='longitude')} AS delta_distance_km, abs(course - pc) % 360 AS turn FROM l),
deltas AS (SELECT * EXCLUDE (pt, plat, plon, ps, pc, turn), delta_distance_km / 1.852 / (delta_time_s / 3600) AS speed_estimated_kn, (speed - ps) / (delta_time_s / 3600) AS acceleration_kn_per_h, least(turn, 360 - turn) AS course_change_deg,
  least(turn, 360 - turn) / (delta_time_s / 3600) AS course_change_rate_deg_per_h FROM d0)"""
TRACK_COLS = ("delta_time_s", "delta_distance_km", "speed_estimated_kn", "acceleration_kn_per_h", "course_change_deg", "course_change_rate_deg_per_h")


@query(W(POSITIONS, DELTAS, tail=f"SELECT position_id, {R6(*TRACK_COLS)} FROM deltas"))
def track_features(spark, sf):
    return tracks.deltas(B.positions(spark, sf)).select("position_id", *TRACK_COLS)


ROLL_COLS = [f"speed_roll_{k}_{n}" for n in (3, 5, 10) for k in ("mean", "std")] + [f"{k}_roll_mean_{n}" for n in (5, 10) for k in ("speed_est", "course_change")]
ROLL = ", ".join(f"avg(speed) OVER w{n} AS speed_roll_mean_{n}, coalesce(stddev_samp(speed) OVER w{n}, 0) AS speed_roll_std_{n}" for n in (3, 5, 10)) + ", " + ", ".join(f"avg(speed_estimated_kn) OVER w{n} AS speed_est_roll_mean_{n}, avg(course_change_deg) OVER w{n} AS course_change_roll_mean_{n}" for n in (5, 10))
WINDOWS = ", ".join(f"w{n} AS (PARTITION BY mmsi ORDER BY timestamp, position_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 10))


@query(W(POSITIONS, DELTAS, f"r AS (SELECT position_id, timestamp, {ROLL} FROM deltas WINDOW {WINDOWS})", tail=f"SELECT position_id, round(hour(timestamp) + minute(timestamp) / 60.0, 6)::DOUBLE AS hour_of_day, (isodow(timestamp) - 1)::INTEGER AS day_of_week, {R6(*ROLL_COLS)} FROM r"))
def rolling_features(spark, sf):
    return tracks.clock(tracks.rolling(tracks.deltas(B.positions(spark, sf)))).select("position_id", "hour_of_day", "day_of_week", *ROLL_COLS)


@query(W(POSITIONS, "j AS (SELECT position_id, mmsi, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 6e7 AS delta_minutes, 111.0 * sqrt(pow(latitude - lag(latitude) OVER w, 2) + pow(longitude - lag(longitude) OVER w, 2)) AS jump_km FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp, position_id))", "k AS (SELECT *, jump_km / 1.852 / (nullif(delta_minutes, 0) / 60) AS implied_kn FROM j)", tail=f"SELECT position_id, mmsi, {R6('delta_minutes', 'jump_km', 'implied_kn')} FROM k WHERE delta_minutes > 0 AND delta_minutes <= 30 AND (jump_km >= 20 OR (jump_km >= 5 AND implied_kn >= 40))"))
def jump_events(spark, sf):
    return tracks.jumps(B.positions(spark, sf)).select("position_id", "mmsi", "delta_minutes", "jump_km", "implied_kn")


@query(W(POSITIONS, DELTAS, tail="SELECT position_id, coalesce(delta_time_s, 0) > 0 AND delta_time_s <= 1800 AND coalesce(delta_distance_km, 0) >= 20 AS anomaly_jump_30m FROM deltas").replace("AND delta_time_s <=", "AND coalesce(delta_time_s, 0) <="))
def far_moves(spark, sf):
    return tracks.far_moves(tracks.deltas(B.positions(spark, sf)), km=20).select("position_id", "anomaly_jump_30m")


@query(W(POSITIONS, tail="SELECT mmsi, position_id FROM positions QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY timestamp DESC, position_id DESC) <= 5"))
def recent_points(spark, sf):
    return tracks.recent(B.positions(spark, sf), 5).select("mmsi", "position_id")


@query(W(POSITIONS, PORT_CALLS, "e AS (SELECT position_id, (epoch_us(arrival_time) - epoch_us(timestamp)) / 6e7 AS m FROM positions p ASOF LEFT JOIN port_calls c ON p.mmsi = c.mmsi AND p.timestamp <= c.arrival_time)", tail="SELECT position_id, CASE WHEN m > 0 AND m <= 20160 THEN round(m * 60, 6) END AS eta_seconds FROM e"))
def eta_labels(spark, sf):
    return tracks.eta_label(B.positions(spark, sf), B.port_calls(spark, sf)).select("position_id", (F.col("eta_minutes_label") * 60).alias("eta_seconds"))


# ---- emissions


def _case(column: str, table: dict[str, object]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


CLASS = "CASE " + " ".join(f"WHEN vessel_type_norm = '{a}' THEN '{k}'" for a, k in text.VESSEL_ALIASES) + " " + " ".join(f"WHEN contains(vessel_type_norm, '{a}') THEN '{k}'" for a, k in text.VESSEL_ALIASES) + " ELSE 'unknown' END"
FACTORS = "factors(vessel_class, mode, mcr_kw, ref_speed_kn, fuel_type, engine_family, aux_kw, sfc_main, sfc_aux, sulphur, nox_kg_per_t, pm_kg_per_t, co2_factor, wtt_factor) AS (VALUES " + ", ".join(
    f"('{c}', '{m}', {mcr}::DOUBLE, {ref}::DOUBLE, '{fuel}', '{eng}', {aux[i]}::DOUBLE, " + ", ".join(f"{x}::DOUBLE" for x in (*mv[:3], mv[3 + ("slow", "medium", "high").index(eng)], mv[6 + ("slow", "medium", "high").index(eng)], *emission.FUELS[fuel])) + ")"
    for c, (mcr, ref, fuel, eng, *aux) in emission.VESSELS.items()
    for i, (m, mv) in enumerate(emission.MODES.items())
) + ")"
INSIDE = """asof0 AS (SELECT p.position_id, c.call_id, c.arrival_time, c.departure_time, c.port_key AS call_port, c.port_label AS call_label FROM positions p ASOF LEFT JOIN port_calls c ON p.mmsi = c.mmsi AND p.timestamp >= c.arrival_time),
ins AS (SELECT d.* EXCLUDE (port_key, port_label), d.port_key AS destination_norm, coalesce(d.timestamp <= a.departure_time, false) AS inside_call,
  CASE WHEN d.timestamp <= a.departure_time THEN a.call_id END AS call_id, CASE WHEN d.timestamp <= a.departure_time THEN a.arrival_time END AS arrival_time, CASE WHEN d.timestamp <= a.departure_time THEN a.departure_time END AS departure_time,
  CASE WHEN d.timestamp <= a.departure_time THEN a.call_port END AS port_key, CASE WHEN d.timestamp <= a.departure_time THEN a.call_label END AS port_label FROM deltas d JOIN asof0 a USING (position_id))"""
MODED = """md0 AS (SELECT *, greatest(coalesce(speed, speed_estimated_kn, 0.0), 0.0) AS speed_kn, speed IS NULL AND speed_estimated_kn IS NOT NULL AS speed_interpolated,
  (timestamp BETWEEN arrival_time - INTERVAL 2 HOUR AND arrival_time + INTERVAL 1 HOUR) OR (timestamp BETWEEN departure_time - INTERVAL 1 HOUR AND departure_time + INTERVAL 2 HOUR) AS near FROM ins),
md AS (SELECT *, CASE WHEN NOT inside_call THEN 'transit' WHEN speed_kn BETWEEN 0.5 AND 8.0 AND near THEN 'manoeuvring' WHEN speed_kn <= 0.5 THEN 'berth' WHEN speed_kn <= 2.0 THEN 'anchorage' ELSE 'transit' END AS mode FROM md0)"""
DURED = """du0 AS (SELECT *, (epoch_us(lead(timestamp) OVER (PARTITION BY mmsi ORDER BY timestamp, position_id)) - epoch_us(timestamp)) / 3.6e9 AS raw FROM md),
du1 AS (SELECT *, median(CASE WHEN raw > 0 AND raw <= 2 THEN raw END) OVER (PARTITION BY mmsi) AS med FROM du0),
du AS (SELECT *, least(greatest(coalesce(CASE WHEN raw > 0 AND raw <= 6 THEN raw ELSE med END, 1.0::DOUBLE / 6), 1.0::DOUBLE / 120), 6.0) AS duration_h FROM du1)"""
EMIT = f"""em0 AS (SELECT *, {CLASS} AS vessel_class FROM du), em1 AS (SELECT em0.*, f.* EXCLUDE (vessel_class, mode), em0.duration_h > 0.5 AS ais_gap_flag,
  em0.vessel_class = 'unknown' OR fuel_type = 'MGO' OR engine_family = 'medium' AS fallback_flag, CASE WHEN em0.mode IN ('transit', 'manoeuvring') THEN least(greatest(pow(speed_kn / ref_speed_kn, 3), 0.2), 1.0) ELSE 0.0 END AS load_factor
  FROM em0 JOIN factors f ON em0.vessel_class = f.vessel_class AND em0.mode = f.mode),
em2 AS (SELECT *, greatest((mcr_kw * load_factor * sfc_main + aux_kw * sfc_aux) * duration_h / 1e6, 0) AS fuel_t FROM em1),
em AS (SELECT *, fuel_t * co2_factor AS co2_t, fuel_t * nox_kg_per_t AS nox_kg, fuel_t * sulphur * 2000.0 AS sox_kg, fuel_t * pm_kg_per_t AS pm_kg, fuel_t * co2_factor AS ttw_co2e_t, fuel_t * wtt_factor AS wtt_co2e_t, fuel_t * co2_factor + fuel_t * wtt_factor AS wtw_co2e_t,
  least(greatest(sqrt(0.0064::DOUBLE + 0.01 + 0.0064) + speed_interpolated::INT * 0.10 + ais_gap_flag::INT * 0.08 + fallback_flag::INT * 0.12, 0.05), 0.95)::DOUBLE AS rel_sigma FROM em2)"""
ROWS = (POSITIONS, PORT_CALLS, DELTAS, INSIDE, MODED, DURED, FACTORS, EMIT)
POLL = emission.POLLUTANTS
BOUNDS = ", ".join(f"greatest({p} * (1 - 1.96 * least(greatest(rel_sigma_weighted, 0.05), 0.95)), 0) AS {p}_lower, greatest({p} * (1 + 1.96 * least(greatest(rel_sigma_weighted, 0.05), 0.95)), 0) AS {p}_upper" for p in POLL)
WIDTH = "coalesce((wtw_co2e_t_upper - wtw_co2e_t_lower) / nullif(wtw_co2e_t, 0), 0)"
CONF = "CASE WHEN ci_width_rel <= 0.20 AND fallback_usage_ratio <= 0.05 THEN 'high' WHEN ci_width_rel <= 0.40 OR fallback_usage_ratio <= 0.20 THEN 'medium' ELSE 'low' END AS confidence_label"
SEGS = f"""sg0 AS (SELECT *, lag(mode) OVER w IS NULL OR mode <> lag(mode) OVER w OR coalesce(call_id, '') <> coalesce(lag(call_id) OVER w, '') OR coalesce(lag(duration_h) OVER w, 0) > 0.5 AS st FROM em WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp, position_id)),
sg1 AS (SELECT *, sum(st::INT) OVER (PARTITION BY mmsi ORDER BY timestamp, position_id) AS ord FROM sg0),
sg2 AS (SELECT mmsi || '_seg_' || lpad(ord::VARCHAR, 6, '0') AS segment_id, mmsi, {', '.join(f'arg_min({c}, (timestamp, position_id)) AS {c}' for c in ('call_id', 'mode', 'vessel_class', 'port_key', 'port_label', 'destination_norm'))},
  min(timestamp) AS timestamp_start, max(timestamp) AS timestamp_end, count(*) AS row_count, arg_min(position_id, (timestamp, position_id))::VARCHAR AS input_row_start_id, arg_max(position_id, (timestamp, position_id))::VARCHAR AS input_row_end_id,
  sum(duration_h) AS duration_h, avg(ais_gap_flag::INT) AS ais_gap_ratio, avg(speed_interpolated::INT) AS interpolation_ratio, avg(fallback_flag::INT) AS fallback_usage_ratio, avg(rel_sigma) AS rel_sigma_weighted, sum(fuel_t) AS fuel_t, {', '.join(f'sum({p}) AS {p}' for p in POLL)} FROM sg1 GROUP BY mmsi, ord),
sg3 AS (SELECT *, {BOUNDS} FROM sg2), sg4 AS (SELECT *, {WIDTH} AS ci_width_rel, timestamp_start::DATE AS date FROM sg3),
segs AS (SELECT *, {CONF}, substring(sha1(segment_id || '|' || sha256('{carbon.PARAMS}')), 1, 24) AS evidence_id FROM sg4)"""


def _agg(name: str, source: str, keys: str, extra: str = "") -> str:
    sums = ", ".join(f"sum({p}) AS {p}" for p in POLL)
    return f"""{name}0 AS (SELECT {keys}, count(*) AS segments, sum(duration_h) AS duration_h, sum(row_count)::BIGINT AS row_count, avg(ais_gap_ratio) AS ais_gap_ratio, avg(interpolation_ratio) AS interpolation_ratio, avg(fallback_usage_ratio) AS fallback_usage_ratio, avg(rel_sigma_weighted) AS rel_sigma_weighted, {sums} FROM {source} GROUP BY ALL),
{name}1 AS (SELECT *, {BOUNDS} FROM {name}0), {name}2 AS (SELECT *, {WIDTH} AS ci_width_rel FROM {name}1), {name} AS (SELECT *, {CONF} FROM {name}2)"""


DAILY_PORT = _agg("dp", "(SELECT * REPLACE (coalesce(port_key, destination_norm) AS port_key) FROM segs)", "date, port_key")
BY_CALL = _agg("cl", "(SELECT * FROM segs WHERE call_id IS NOT NULL)", "call_id, mmsi, port_key, port_label")
BY_MONTH = _agg("mo", "(SELECT *, strftime(date, '%Y-%m') AS month FROM segs WHERE call_id IS NOT NULL)", "month, port_key")
AGG_COLS = ("duration_h", "ais_gap_ratio", "interpolation_ratio", "fallback_usage_ratio", "rel_sigma_weighted", *(f"{p}{s}" for p in POLL for s in ("", "_lower", "_upper")), "ci_width_rel")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return carbon.row_emissions(spark, B.positions(spark, sf), B.port_calls(spark, sf))


def segs(spark: SparkSession, sf: str) -> DataFrame:
    return carbon.segments(rows(spark, sf))


@query(W(POSITIONS, PORT_CALLS, DELTAS, INSIDE, tail="SELECT position_id, mmsi, inside_call, call_id, port_key FROM ins"))
def asof_calls(spark, sf):
    return carbon.inside_calls(B.positions(spark, sf), B.port_calls(spark, sf)).select("position_id", "mmsi", "inside_call", "call_id", "port_key")


@query(W(*ROWS, tail=f"SELECT position_id, mode, vessel_class, ais_gap_flag, fallback_flag, {R6('duration_h', 'load_factor', 'fuel_t', *POLL, 'rel_sigma')} FROM em"))
def row_emissions(spark, sf):
    return rows(spark, sf).select("position_id", "mode", "vessel_class", "ais_gap_flag", "fallback_flag", "duration_h", "load_factor", "fuel_t", *POLL, "rel_sigma")


SEG_COLS = ("segment_id", "mmsi", "call_id", "mode", "vessel_class", "port_key", "port_label", "destination_norm", "date", "row_count", "input_row_start_id", "input_row_end_id", "confidence_label", "evidence_id")


@query(W(*ROWS, SEGS, tail=f"SELECT {', '.join(SEG_COLS)}, {R6('fuel_t', *AGG_COLS)} FROM segs"), dates="date")
def carbon_segments(spark, sf):
    return segs(spark, sf).select(*SEG_COLS, "fuel_t", *AGG_COLS)


@query(W(*ROWS, SEGS, DAILY_PORT, tail=f"SELECT date, port_key, segments, row_count, confidence_label, {R6(*AGG_COLS)} FROM dp"), dates="date")
def carbon_daily_port(spark, sf):
    return carbon.daily_port(segs(spark, sf)).select("date", "port_key", "segments", "row_count", "confidence_label", *AGG_COLS)


@query(W(*ROWS, SEGS, BY_CALL, tail=f"SELECT call_id, mmsi, port_key, port_label, segments, row_count, confidence_label, {R6(*AGG_COLS)} FROM cl"))
def carbon_call(spark, sf):
    return carbon.by_call(segs(spark, sf)).select("call_id", "mmsi", "port_key", "port_label", "segments", "row_count", "confidence_label", *AGG_COLS)


@query(W(*ROWS, SEGS, BY_MONTH, tail=f"SELECT month, port_key, segments, row_count, confidence_label, {R6(*AGG_COLS)} FROM mo"))
def carbon_month(spark, sf):
    return carbon.by_month(segs(spark, sf)).select("month", "port_key", "segments", "row_count", "confidence_label", *AGG_COLS)


_NORMAL = "sqrt(-2 * ln((xor(s.u >> 16, s.u) + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * xor(s.v >> 16, s.v) / 4294967296.0::DOUBLE)"


def _sampled(name: str, source: str, keys: tuple[str, ...], seed: int) -> str:
    """SQL for aggregates with drawn bounds: the 500 draws of each pollutant as a sorted list."""
    mix = lambda x: f"list_reduce([{x}, 0, 0], lambda a, _: (xor(a >> 16, a) * {emission.MIX}) & 4294967295)"
    code = lambda p: f"md5(concat_ws('|', '{seed}', '{p}', {', '.join(f'{k}::VARCHAR' for k in keys)}))"
    word = lambda p, at: f"('0x' || substr({code(p)}, {at}, 8))::BIGINT"
    counted = lambda w: mix(f"(({w}) + i * {emission.STEP}) & 4294967295")
    seeds = ", ".join(f"{word(p, 1)} AS {p}_a, {word(p, 9)} AS {p}_b" for p in POLL)
    plain = ", ".join(f"{p}_lower, {p}_upper" for p in POLL)
    drawn = ", ".join(f"list_sort(list_transform(list_transform(range({emission.DRAWS}), lambda i: {{'u': {counted(f'{p}_a')}, 'v': {counted(f'{p}_b')}}}), lambda s: greatest({p} * (1 + least(greatest(rel_sigma_weighted, 0.05), 0.95) * {_NORMAL}), 0))) AS {p}_d" for p in POLL)
    low, high = (emission.DRAWS - 1) * 0.025, (emission.DRAWS - 1) * 0.975
    end = lambda p, at: f"CASE WHEN {p} > 0 THEN {p}_d[{int(at) + 1}] + ({p}_d[{int(at) + 2}] - {p}_d[{int(at) + 1}]) * {at - int(at)!r}::DOUBLE ELSE 0 END"
    ends = ", ".join(f"{end(p, low)} AS {p}_lower, {end(p, high)} AS {p}_upper" for p in POLL)
    either = lambda s: f"coalesce(CASE WHEN wtw_co2e_t{s} > 0 THEN wtw_co2e_t{s} ELSE co2_t{s} END, 0)"
    return f"""{name}a AS (SELECT * EXCLUDE ({plain}, ci_width_rel, confidence_label), {seeds} FROM {source}), {name}b AS (SELECT *, {drawn} FROM {name}a), {name}c AS (SELECT *, {ends} FROM {name}b),
{name}d AS (SELECT *, CASE WHEN {either('')} > 0 THEN ({either('_upper')} - {either('_lower')}) / {either('')} ELSE 1.0 END AS ci_width_rel FROM {name}c), {name} AS (SELECT *, {CONF} FROM {name}d)"""


@query(W(*ROWS, SEGS, DAILY_PORT, _sampled("sd", "dp", ("date", "port_key"), 42), tail=f"SELECT date, port_key, segments, row_count, confidence_label, {R6(*AGG_COLS)} FROM sd"), dates="date")
def carbon_daily_port_sampled(spark, sf):
    return carbon.sampled_intervals(carbon.daily_port(segs(spark, sf)), ["date", "port_key"]).select("date", "port_key", "segments", "row_count", "confidence_label", *AGG_COLS)


@query(W(*ROWS, SEGS, BY_CALL, _sampled("sc", "cl", ("call_id", "mmsi", "port_key", "port_label"), 43), tail=f"SELECT call_id, mmsi, port_key, port_label, segments, row_count, confidence_label, {R6(*AGG_COLS)} FROM sc"))
def carbon_call_sampled(spark, sf):
    out = carbon.sampled_intervals(carbon.by_call(segs(spark, sf)), ["call_id", "mmsi", "port_key", "port_label"], 43)
    return out.select("call_id", "mmsi", "port_key", "port_label", "segments", "row_count", "confidence_label", *AGG_COLS)


@query(W(*ROWS, SEGS, tail=" UNION ALL ".join(f"SELECT '{p}' AS pollutant, round(sum({p}), 6) AS point, round(sum({p}_lower), 6) AS lower, round(sum({p}_upper), 6) AS upper FROM segs WHERE date >= DATE '2024-01-05' AND date <= DATE '2024-01-20' AND contains(coalesce(port_key, ''), 'NATION_6')" for p in POLL)))
def carbon_uncertainty(spark, sf):
    return carbon.uncertainty(carbon.scope(segs(spark, sf), "NATION_6", "2024-01-05", "2024-01-20"))


@query(W(*ROWS, SEGS, BY_CALL, tail="SELECT *, rows - unique_calls AS duplicate_rows, CASE WHEN unique_calls = 0 THEN 'no calls' WHEN rows > unique_calls THEN 'duplicates' WHEN max_t > 50 THEN 'high call' ELSE 'ok' END AS sanity FROM (SELECT count(DISTINCT call_id) AS unique_calls, count(*) AS rows, round(sum(wtw_co2e_t), 6) AS total_t, round(median(wtw_co2e_t), 6) AS median_t, round(max(wtw_co2e_t), 6) AS max_t FROM cl)"))
def carbon_diagnostics(spark, sf):
    return carbon.diagnostics(carbon.by_call(segs(spark, sf)))


@query(W(*ROWS, SEGS, tail="SELECT call_id, strftime(min(timestamp_start), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(timestamp_end), '%Y-%m-%d %H:%M:%S') AS last, round(sum(duration_h), 6) AS duration_h, round(sum(wtw_co2e_t), 6) AS wtw_co2e_t, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM segs WHERE call_id IS NOT NULL GROUP BY call_id"))
def carbon_call_trace(spark, sf):
    return carbon.trace(segs(spark, sf)).withColumn("first", stamp("first")).withColumn("last", stamp("last"))


@query(W(*ROWS, SEGS, BY_CALL, tail="SELECT round(sum(wtw_co2e_t), 6) AS total_t, round(sum(wtw_co2e_t) * 1000 / nullif(count(DISTINCT call_id), 0), 6) AS kg_per_call, round(sum(wtw_co2e_t) * 1000 / nullif(sum(duration_h), 0), 6) AS kg_per_hour FROM cl"))
def carbon_intensity(spark, sf):
    return carbon.intensities(carbon.by_call(segs(spark, sf)))


@query(W(*ROWS, SEGS, DAILY_PORT, "q AS (SELECT quantile_cont(wtw_co2e_t, 0.25) AS a, quantile_cont(wtw_co2e_t, 0.5) AS b, quantile_cont(wtw_co2e_t, 0.75) AS c FROM dp)", tail="SELECT date, port_key, CASE WHEN wtw_co2e_t <= a THEN 'Low' WHEN wtw_co2e_t <= b THEN 'Moderate' WHEN wtw_co2e_t <= c THEN 'High' ELSE 'Very High' END AS band FROM dp, q"), dates="date")
def carbon_bands(spark, sf):
    return carbon.bands(carbon.daily_port(segs(spark, sf))).select("date", "port_key", "band")


@query(W(*ROWS, SEGS, DAILY_PORT, "t AS (SELECT date, strftime(date, '%Y-%m') AS month, sum(wtw_co2e_t) AS v FROM dp GROUP BY ALL)", "c AS (SELECT *, v - lag(v) OVER (PARTITION BY month ORDER BY date) AS change FROM t)", tail="SELECT month, arg_max(date, v) AS highest, arg_max(date, change) AS largest_rise, arg_min(date, change) AS largest_drop FROM c GROUP BY month"), dates="highest largest_rise largest_drop")
def carbon_findings(spark, sf):
    return carbon.findings(carbon.daily_port(segs(spark, sf)))


@query(W(*ROWS, SEGS, DAILY_PORT, tail="SELECT date, port_key, round(wtw_co2e_t, 6) AS wtw_co2e_t FROM dp ORDER BY abs(date_diff('day', date, DATE '2024-01-15')), date, port_key LIMIT 1"), dates="date")
def carbon_nearest_period(spark, sf):
    return carbon.nearest_period(carbon.daily_port(segs(spark, sf)), "2024-01-15").select("date", "port_key", "wtw_co2e_t")


@query(W(*ROWS, SEGS, tail="SELECT evidence_id, segment_id, call_id FROM segs WHERE mmsi = '3'"))
def carbon_evidence(spark, sf):
    return segs(spark, sf).filter("mmsi = '3'").select("evidence_id", "segment_id", "call_id")


_MODES = list(emission.MODES)
_LOWER_UPPER = ", ".join(f"round(greatest({p} * (1 - 1.96 * 0.3::DOUBLE), 0), 6) AS {p}_lower, round({p} * (1 + 1.96 * 0.3::DOUBLE), 6) AS {p}_upper" for p in POLL)


@query(W(PORT_CALLS, FACTORS, f"a AS (SELECT call_no, {_MODES}[call_no % 4 + 1] AS mode, 1 + call_no % 48 / 4.0::DOUBLE AS duration_h, (call_no % 23)::DOUBLE AS speed_kn, {CLASS} AS vessel_class FROM port_calls)",
    "l AS (SELECT a.*, f.* EXCLUDE (vessel_class, mode), CASE WHEN a.mode IN ('transit', 'manoeuvring') THEN least(greatest(pow(speed_kn / ref_speed_kn, 3), 0.2), 1.0) ELSE 0.0 END AS load_factor FROM a JOIN factors f ON a.vessel_class = f.vessel_class AND a.mode = f.mode)",
    "e AS (SELECT *, (mcr_kw * load_factor * sfc_main + aux_kw * sfc_aux) * duration_h / 1e6 AS fuel_t FROM l)", "p AS (SELECT *, fuel_t * co2_factor AS co2_t, fuel_t * nox_kg_per_t AS nox_kg, fuel_t * sulphur * 2000.0 AS sox_kg, fuel_t * pm_kg_per_t AS pm_kg, fuel_t * co2_factor AS ttw_co2e_t, fuel_t * wtt_factor AS wtt_co2e_t, fuel_t * (co2_factor + wtt_factor) AS wtw_co2e_t FROM e)",
    tail=f"SELECT call_no, vessel_class, mode, {R6('load_factor', 'fuel_t', *POLL)}, {_LOWER_UPPER} FROM p"))
def scenario_estimate(spark, sf):
    """An assumed stay for every port call: mode, hours and speed by its number."""
    i = F.col("call_no")
    a = B.port_calls(spark, sf).select(i, F.col("vessel_type_norm").alias("vessel_type"), F.element_at(F.array(*map(F.lit, _MODES)), (i % 4).cast("int") + 1).alias("mode"), (1 + i % 48 / 4.0).cast("double").alias("duration_h"), (i % 23).cast("double").alias("speed_kn"))
    return carbon.scenarios(spark, a).drop("vessel_type", "duration_h", "speed_kn")


# ---- forecasts

SERIES = "s AS (SELECT port_key, date, sum(arrivals_vessels)::DOUBLE AS value FROM daily GROUP BY ALL)"
ONE = """o0 AS (SELECT *, row_number() OVER w - 1 AS n, lag(value, 7) OVER w AS l7, lag(value) OVER w AS l1, avg(value) OVER (PARTITION BY port_key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM s WINDOW w AS (PARTITION BY port_key ORDER BY date)),
o AS (SELECT port_key, date, value, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN greatest(l1, 0) ELSE greatest(0.7 * CASE WHEN n >= 7 THEN l7 ELSE l1 END + 0.3 * m, 0) END AS predicted FROM o0)"""


def values(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.daily_series(daily(spark, sf), "arrivals_vessels")


@query(W(CALLS, DAILY, SERIES, ONE, tail=f"SELECT port_key, date, value, {R6('predicted')} FROM o"), dates="date")
def one_step_forecast(spark, sf):
    return forecast.one_step(values(spark, sf))


HORIZON = """b AS (SELECT port_key, max(date) AS last, stddev_samp(value - predicted) AS sigma FROM o GROUP BY port_key HAVING count(*) >= 14),
h0 AS (SELECT port_key, list(value ORDER BY date) AS h FROM (SELECT *, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS r FROM s) WHERE r <= 7 GROUP BY port_key)"""


@query("WITH RECURSIVE " + ", ".join((CALLS, DAILY, SERIES, ONE, HORIZON)) + """, f AS (SELECT port_key, 0 AS step, h, NULL::DOUBLE AS predicted FROM h0
UNION ALL SELECT port_key, step + 1, h[2:7] || [greatest(0, 0.7 * h[1] + 0.3 * list_avg(h))], greatest(0, 0.7 * h[1] + 0.3 * list_avg(h)) FROM f WHERE step < 14)
SELECT port_key, step, last + step AS date, round(predicted, 6) AS predicted, round(greatest(0, predicted - 1.96 * sigma * sqrt(step)), 6) AS lower, round(predicted + 1.96 * sigma * sqrt(step), 6) AS upper FROM f JOIN b USING (port_key) WHERE step > 0""", dates="date")
def forecast_horizon(spark, sf):
    return forecast.horizon(values(spark, sf), 2)


@query("WITH RECURSIVE " + ", ".join((CALLS, DAILY, SERIES, ONE, HORIZON)) + """, f AS (SELECT port_key, 0 AS step, h, NULL::DOUBLE AS predicted FROM h0
UNION ALL SELECT port_key, step + 1, h[2:7] || [greatest(0, 0.7 * h[1] + 0.3 * list_avg(h))], greatest(0, 0.7 * h[1] + 0.3 * list_avg(h)) FROM f WHERE step < 28),
g AS (SELECT port_key, avg(predicted) AS predicted, avg(greatest(0, predicted - 1.96 * sigma * sqrt(step))) AS lower, avg(predicted + 1.96 * sigma * sqrt(step)) AS upper, count(*) AS days FROM f JOIN b USING (port_key) WHERE step > 0 AND dayname(last + step) = 'Monday' GROUP BY port_key)
SELECT port_key, round(predicted, 6) AS predicted, round(lower, 6) AS lower, round(upper, 6) AS upper, days, CASE WHEN predicted < 0.8 THEN 'below normal' WHEN predicted < 1.2 THEN 'normal' WHEN predicted < 1.6 THEN 'elevated' ELSE 'high' END AS level FROM g""")
def forecast_weekday(spark, sf):
    return forecast.weekday_outlook(values(spark, sf), "Monday")


_T = ["month(date) = 3 AND day(date) = 14", "month(date) = 3 AND abs(day(date) - 14) <= 2 AND dayname(date) = 'Tuesday'", "week(date) = 11 AND dayname(date) = 'Tuesday'", "month(date) = 3 AND dayname(date) = 'Tuesday'", "month(date) = 3", "dayname(date) = 'Tuesday'", "true"]
_M = [1, 2, 3, 3, 5, 5, 1]


@query(W(CALLS, DAILY, SERIES, "m AS (SELECT port_key, value, " + ", ".join(f"({t}) AS t{i}" for i, t in enumerate(_T, 1)) + " FROM s)", "c AS (SELECT port_key, CASE " + " ".join(f"WHEN count(*) FILTER (WHERE t{i}) >= {k} THEN {i}" for i, k in enumerate(_M, 1)) + " END AS tier FROM m GROUP BY port_key)", "x AS (SELECT port_key, tier, value FROM m JOIN c USING (port_key) WHERE " + " OR ".join(f"(tier = {i} AND t{i})" for i in range(1, 8)) + ")", "y AS (SELECT port_key, tier, count(*) AS samples, avg(value) AS predicted, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM x GROUP BY ALL)",
    tail="SELECT port_key, tier, samples, round(predicted, 6) AS predicted, round(greatest(0, CASE WHEN samples = 1 THEN predicted * 0.8 ELSE a END), 6) AS lower, round(CASE WHEN samples = 1 THEN predicted * 1.2 ELSE b END, 6) AS upper, CASE WHEN tier = 1 AND samples >= 4 THEN 'high' WHEN tier = 1 AND samples >= 2 THEN 'medium' WHEN tier = 2 AND samples >= 3 THEN 'high' WHEN tier = 2 AND samples >= 2 THEN 'medium' WHEN tier <= 4 AND samples >= 3 THEN 'medium' WHEN samples >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM y"))
def seasonal_analog(spark, sf):
    return forecast.seasonal_analog(values(spark, sf), "2000-03-14")


@query(W(CALLS, DAILY, SERIES, "z AS (SELECT port_key, sum(value) AS total FROM s GROUP BY port_key HAVING count(*) >= 60 ORDER BY total DESC, port_key LIMIT 20)", ONE, "u AS (SELECT o.*, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS back FROM o WHERE port_key IN (SELECT port_key FROM z))", tail="SELECT port_key, count(*) AS test_points, round(avg(abs(value - predicted)), 6) AS mae, round(avg(abs(value - predicted) / greatest(abs(value), 1)) * 100, 6) AS mape FROM u WHERE back <= 28 GROUP BY port_key"))
def backtest_ports(spark, sf):
    return forecast.backtest(values(spark, sf))


STEPS = """, f AS (SELECT port_key, 0 AS step, h, NULL::DOUBLE AS predicted FROM h0
UNION ALL SELECT port_key, step + 1, h[2:7] || [greatest(0, 0.7 * h[1] + 0.3 * list_avg(h))], greatest(0, 0.7 * h[1] + 0.3 * list_avg(h)) FROM f WHERE step < 14)"""


@query("WITH RECURSIVE " + ", ".join((CALLS, DAILY, SERIES, ONE, HORIZON)) + STEPS + """ SELECT port_key, round(p, 6) AS predicted, rank() OVER (ORDER BY p DESC, port_key)::BIGINT AS rank
FROM (SELECT port_key, avg(predicted) AS p FROM f JOIN b USING (port_key) WHERE step > 0 AND port_key IN ('NATION_6', 'NATION_7') GROUP BY port_key)""")
def forecast_comparison(spark, sf):
    return forecast.compare(values(spark, sf), "NATION_6", "NATION_7").withColumn("rank", F.col("rank").cast("long"))


@query("WITH RECURSIVE " + ", ".join((CALLS, DAILY, SERIES, ONE, HORIZON)) + STEPS + """ SELECT port_key, date, round(avg(actual), 6) AS actual, round(avg(predicted), 6) AS predicted FROM (
SELECT port_key, date, value AS actual, NULL::DOUBLE AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS r FROM s) WHERE r <= 30
UNION ALL SELECT port_key, last + step, NULL, predicted FROM f JOIN b USING (port_key) WHERE step > 0) GROUP BY ALL""", dates="date")
def forecast_chart(spark, sf):
    v = values(spark, sf)
    return forecast.pivoted(forecast.with_history(v, forecast.horizon(v, 2), 30))


# ---- port days

FLAGGED = "fl AS (SELECT *, dwell_minutes <= quantile_cont(dwell_minutes, 0.1) OVER (PARTITION BY port_key) AS s, dwell_minutes >= quantile_cont(dwell_minutes, 0.9) OVER (PARTITION BY port_key) AS l FROM pc_stays)"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return portday.stay_flags(kpi.dwell(B.port_calls(spark, sf)))


@query(W(PORT_CALLS, PC_STAYS, FLAGGED, tail="SELECT call_no, s AS anomaly_short_dwell, l AS anomaly_long_dwell, s OR l AS anomaly_flag FROM fl"))
def dwell_outliers(spark, sf):
    return flagged(spark, sf).select("call_no", "anomaly_short_dwell", "anomaly_long_dwell", "anomaly_flag")


def _top(column: str, name: str) -> str:
    return f"(SELECT port_key, date, {column} AS {name} FROM (SELECT port_key, arrival_time::DATE AS date, {column}, count(*) AS n FROM fl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY port_key, date ORDER BY n DESC, {column}) = 1)"


@query(W(POSITIONS, PROXY, PORT_CALLS, PC_STAYS, FLAGGED, "k AS (SELECT port_key, arrival_time::DATE AS date, count(*) AS arrivals_events, count(DISTINCT mmsi) AS arrivals_vessels, round(avg(dwell_minutes / 60), 6) AS avg_dwell_hours, round(median(dwell_minutes / 60), 6) AS median_dwell_hours, count(*) FILTER (WHERE s) AS short_dwell_count, count(*) FILTER (WHERE l) AS long_dwell_count, count(*) FILTER (WHERE s OR l) AS anomaly_count FROM fl GROUP BY ALL)", "x AS (SELECT port_key, date, sum(arrivals_events)::BIGINT AS ais_proxy_arrivals_events, sum(arrivals_vessels)::BIGINT AS ais_proxy_arrivals_vessels FROM proxy GROUP BY ALL)",
    tail=f"SELECT * FROM k JOIN {_top('origin', 'most_frequent_origin')} USING (port_key, date) JOIN {_top('next_port', 'most_frequent_next_destination')} USING (port_key, date) LEFT JOIN x USING (port_key, date)"), dates="date")
def port_day_metrics(spark, sf):
    return portday.port_days(flagged(spark, sf), proxy(spark, sf))


@query(W(PORT_CALLS, tail="SELECT origin AS origin_port, next_port AS destination, count(*) AS route_count, count(DISTINCT mmsi) AS vessels FROM port_calls GROUP BY ALL"))
def route_frequency(spark, sf):
    return portday.routes(B.port_calls(spark, sf))


@query(W(PORT_CALLS, PC_STAYS, "n AS (SELECT *, ((row_number() OVER (PARTITION BY port_key ORDER BY arrival_time, call_id) - 1) // 5)::BIGINT AS window_no FROM pc_stays)", "t0 AS (SELECT port_key, window_no, vessel_type_norm, count(*) AS c FROM n GROUP BY ALL)", "t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY port_key, window_no ORDER BY c DESC, vessel_type_norm) <= 2)",
    tail="SELECT port_key, window_no, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, events, vessels, mean_minutes, top_types FROM (SELECT port_key, window_no, min(arrival_time) AS first, max(arrival_time) AS last, count(*) AS events, count(DISTINCT mmsi) AS vessels, round(avg(dwell_minutes), 6) AS mean_minutes FROM n GROUP BY ALL) JOIN (SELECT port_key, window_no, string_agg(vessel_type_norm, ',' ORDER BY c DESC, vessel_type_norm) AS top_types FROM t GROUP BY ALL) USING (port_key, window_no)"))
def window_chunks(spark, sf):
    return portday.window_chunks(kpi.dwell(B.port_calls(spark, sf))).withColumn("first", stamp("first")).withColumn("last", stamp("last"))


@query(W(PORT_CALLS, PC_STAYS, FLAGGED, tail="SELECT 'A_' || call_id AS id, format('Vessel {} ({}) arrived at {} on {} and stayed {:.2f} hours.', mmsi, vessel_type_norm, port_label, strftime(arrival_time, '%Y-%m-%d %H:%M'), dwell_minutes / 60) AS text, port_key, arrival_time::DATE AS date, 'port_call' AS event_type, s OR l AS anomaly_flag FROM fl"), dates="date")
def event_chunks(spark, sf):
    return portday.event_chunks(flagged(spark, sf))


@query(W(POSITIONS, PROXY, PORT_CALLS, PC_STAYS, "k AS (SELECT DISTINCT port_key, arrival_time::DATE AS date FROM pc_stays)", tail="SELECT 'B_' || port_key || '_' || date::VARCHAR AS id, port_key, date, 'port_call' AS source FROM k UNION ALL SELECT 'B_' || port_key || '_' || date::VARCHAR, port_key, date, 'ais_proxy' FROM (SELECT DISTINCT port_key, date FROM proxy) p WHERE NOT EXISTS (FROM k WHERE k.port_key = p.port_key AND k.date = p.date)"), dates="date")
def port_day_chunks(spark, sf):
    days = portday.port_days(flagged(spark, sf), proxy(spark, sf))
    return portday.port_day_chunks(days, proxy(spark, sf)).select("id", "port_key", "date", "source")


# ---- retrieval

COS = "greatest(0, 1 - list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))))"
VEC = f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), dist AS (SELECT vec_id, label, {COS} AS distance FROM embeddings e, q)"


def _query_vector(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("query"))


@query(W(VEC, tail="SELECT vec_id, round(distance, 6) AS distance FROM dist ORDER BY distance, vec_id LIMIT 5"))
def vector_topk(spark, sf):
    return vectors.nearest(B.table(spark, sf, "embeddings"), "embedding", _query_vector(spark, sf), "vec_id", 5).select("vec_id", "distance")


def stored_index(spark: SparkSession, sf: str) -> vector_index.Index:
    return vector_index.build(B.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}")


MANY = f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, round({COS}, 12) AS distance FROM embeddings e, q), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)"


def _hundredths(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return B.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"{MANY} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM f WHERE rank <= 5")
def vector_index_topk(spark, sf):
    """The five nearest of every query from a stored index, the exact way."""
    return vector_index.nearest_many(stored_index(spark, sf), _hundredths(spark, sf), 5, exact=True).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*) AS queries, true AS at_least_95_percent FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf):
    """Whether probing three quarters of the cells (the test vectors hardly cluster) finds at least 95 % of what the exact way finds."""
    index, q = stored_index(spark, sf), _hundredths(spark, sf)
    exact = vector_index.nearest_many(index, q, 5, exact=True).select("query_id", "vec_id")
    probed = vector_index.nearest_many(index, q, 5, probes=-(-3 * len(index.centres) // 4)).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    both = exact.join(probed, ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.95 * F.count("*")).alias("at_least_95_percent"))


@query(W(VEC, tail="SELECT vec_id, label, round(distance, 6) AS distance FROM dist WHERE label = 3 ORDER BY distance, vec_id LIMIT 5"))
def filtered_vector_topk(spark, sf):
    items = retrieval.matching(B.table(spark, sf, "embeddings"), {"label": 3})
    return vectors.nearest(items, "embedding", _query_vector(spark, sf), "vec_id", 5).select("vec_id", "label", "distance")


@query(W(VEC, tail="SELECT * FROM (SELECT vec_id, label, round(distance, 6) AS distance FROM dist WHERE label = 1 ORDER BY dist.distance, vec_id LIMIT 5) UNION ALL SELECT * FROM (SELECT vec_id, label, round(distance, 6) FROM dist WHERE label = 2 ORDER BY dist.distance, vec_id LIMIT 5) ORDER BY 3, 1 LIMIT 5"))
def merged_topk(spark, sf):
    e, q = B.table(spark, sf, "embeddings"), _query_vector(spark, sf)
    return vectors.merged([vectors.nearest(e.filter(F.col("label") == n), "embedding", q, "vec_id", 5).select("vec_id", "label", "distance") for n in (1, 2)], "vec_id", 5)


@query(W(VEC, tail="SELECT count(*) AS n_items, round(min(distance), 6) AS min_distance, coalesce(min(distance) <= 0.42, false) AS answerable FROM (FROM dist WHERE label = 4 ORDER BY distance LIMIT 5)"))
def answer_gate(spark, sf):
    return vectors.answerable(vectors.nearest(B.table(spark, sf, "embeddings").filter("label = 4"), "embedding", _query_vector(spark, sf), "vec_id", 5))


@query(W(POSITIONS, tail="SELECT count(*) AS n, (SELECT string_agg(mmsi || '-' || position_id, ',' ORDER BY mmsi || '-' || position_id) FROM (SELECT * FROM positions WHERE vessel_type_norm = 'tug' AND latitude BETWEEN 54 AND 56 AND longitude BETWEEN 10 AND 14 ORDER BY mmsi || '-' || position_id LIMIT 200)) AS first_ids FROM positions WHERE vessel_type_norm = 'tug' AND latitude BETWEEN 54 AND 56 AND longitude BETWEEN 10 AND 14"))
def traffic_count(spark, sf):
    p = retrieval.matching(B.positions(spark, sf), {"vessel_type_norm": "tug"}, box=(54, 56, 10, 14))
    return retrieval.counted(p.withColumn("id", F.concat_ws("-", "mmsi", "position_id")), "id")


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, (i // 1000)::INTEGER AS chunk_index, substring(text, i::INTEGER + 1, 1200) AS chunk, doc_id::VARCHAR || '_' || (i // 1000)::VARCHAR AS id FROM c")
def text_chunks(spark, sf):
    return retrieval.chunked(B.table(spark, sf, "documents"), "text", "doc_id")


@query()
def web_chunks(spark, sf):
    return retrieval.web_chunks(B.table(spark, sf, "pages"))


_RANKED = "res AS (SELECT 's' || (label % 3)::VARCHAR AS strategy, (vec_id % 40)::VARCHAR AS question, vec_id::VARCHAR AS id, vec_id % 17 + 1.0 AS latency_ms, row_number() OVER (PARTITION BY label % 3, vec_id % 40 ORDER BY vec_id) AS rank FROM embeddings), ex AS (SELECT (vec_id % 40)::VARCHAR AS question, vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 7 = 0)"


@query(W(_RANKED, "per AS (SELECT strategy, res.question, max((ex.id IS NOT NULL)::INT) AS hit, max(latency_ms) AS l FROM res LEFT JOIN ex ON res.question = ex.question AND res.id = ex.id WHERE rank <= 5 GROUP BY ALL)", tail="SELECT strategy, round(avg(hit), 6) AS hit_at_k, round(avg(l), 6)::DOUBLE AS latency_ms, count(*) AS questions FROM per GROUP BY strategy"))
def hit_at_k(spark, sf):
    from pyspark.sql import Window

    e = B.table(spark, sf, "embeddings")
    s = lambda c: F.col(c).cast("string")
    q = e.withColumn("strategy", F.concat(F.lit("s"), (F.col("label") % 3).cast("string"))).withColumn("question", (F.col("vec_id") % 40).cast("string"))
    ranked = q.withColumn("rank", F.row_number().over(Window.partitionBy("strategy", "question").orderBy("vec_id"))).select("strategy", "question", s("vec_id").alias("id"), (F.col("vec_id") % 17 + 1.0).alias("latency_ms"), "rank")
    return retrieval.hit_rate(ranked, q.filter("vec_id % 7 = 0").select("question", s("vec_id").alias("id")))


@query("WITH c AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(string_agg(text, ' ') FILTER (WHERE role = 'user')), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(string_agg(text, ' ') FILTER (WHERE role <> 'user')), '[a-z0-9]+')) AS a FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role <> 'user') > 0) SELECT conv_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) ELSE 0.0 END, 6)::DOUBLE AS relevance, len(list_filter(a, lambda x: NOT list_contains(q, x))) > 0 AS hallucinated FROM c")
def answer_grounding(spark, sf):
    c = B.table(spark, sf, "conversations").filter("text IS NOT NULL")
    said = lambda cond: F.array_join(F.collect_list(F.when(cond, F.col("text"))), " ")
    both = c.groupBy("conv_id").agg(said(F.col("role") == "user").alias("q"), said(F.col("role") != "user").alias("a"), F.count_if(F.col("role") == "user").alias("nq"), F.count_if(F.col("role") != "user").alias("na")).filter("nq > 0 AND na > 0")
    two = both.select("conv_id", F.col("q").alias("question"), F.col("a").alias("evidence"), F.col("a").alias("answer"))
    out = retrieval.grounding(two).withColumn("hallucinated", text.novel(text.tokens(F.col("answer")), text.tokens(F.col("question"))))
    return out.select("conv_id", "relevance", "hallucinated")


# ---- cleaning


RAW_DESTINATIONS = ("  ", "se-got", "RU LED", "fihel!", " lv vnt", "lv v nt", "Port Hamburg", "nan", "GOT 12", "***", "LT  KLJ", "None.")


@query(f"""WITH r AS (SELECT *, [{", ".join(f"'{d}'" for d in RAW_DESTINATIONS)}][(c_custkey % {len(RAW_DESTINATIONS)})::INT + 1] AS raw FROM customer),
u AS (SELECT *, upper(trim(raw)) AS up, trim(regexp_replace(regexp_replace(upper(trim(raw)), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM r),
d AS (SELECT *, CASE WHEN up IN ('', 'NAN', 'NONE') OR t = '' THEN 'UNKNOWN' WHEN replace(t, ' ', '') IN ('RULED', 'LTKLJ', 'SEGOT', 'SEKAR', 'FIHEL') THEN replace(t, ' ', '')
  WHEN regexp_matches(replace(t, ' ', ''), '^[A-Z]{{5}}$') THEN replace(t, ' ', '') ELSE t END AS destination FROM u)
SELECT c_custkey, regexp_replace(trim(c_custkey::VARCHAR || '.0'), '^(\\d+)\\.0+$', '\\1') AS mmsi, destination, CASE WHEN length(destination) < 2 THEN 'UNK' ELSE upper(substring(destination, 1, 2)) END AS country, c_acctbal AS amount FROM d""")
def normalised(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, RAW_DESTINATIONS)), (F.col("c_custkey") % len(RAW_DESTINATIONS)).cast("int") + 1)
    c = B.table(spark, sf, "customer").withColumn("d", text.destination(raw))
    amount = text.number(F.replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return c.select("c_custkey", text.identifier(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("mmsi"), F.col("d").alias("destination"), text.country(F.col("d")).alias("country"), amount.alias("amount"))


@query(f"""WITH r AS (SELECT *, [{", ".join(f"'{d}'" for d in RAW_DESTINATIONS)}][(c_custkey % {len(RAW_DESTINATIONS)})::INT + 1] AS raw FROM customer)
SELECT c_custkey, regexp_extract(upper(replace(trim(raw), ' ', '')), '^([A-Z]{{5}})$', 1) AS code, regexp_replace(upper(trim(raw)), '\\s+', ' ', 'g') AS plain, CASE WHEN lower(trim(raw)) NOT IN ('', 'unknown', 'nan', 'none') THEN trim(raw) ELSE c_mktsegment END AS known,
[true, false, true, false][(c_custkey % 4)::INT + 1] AS flag, nullif(regexp_replace(c_name, '\\D', '', 'g'), '') AS digits, round(c_acctbal / nullif(c_custkey % 3, 0), 6) AS part FROM r""")
def cleaned_values(spark, sf):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs)).cast("int") + 1)
    raw, flag = pick(*RAW_DESTINATIONS), pick("1", "0", " TRUE", "no")
    return B.table(spark, sf, "customer").select(
        "c_custkey", text.five_letter_code(F.upper(F.replace(F.trim(raw), F.lit(" "), F.lit("")))).alias("code"), text.plain_destination(raw).alias("plain"), text.first_known(raw, F.col("c_mktsegment")).alias("known"),
        text.truth(flag).alias("flag"), text.digits(F.col("c_name")).alias("digits"), labels.share(F.col("c_acctbal"), (F.col("c_custkey") % 3).cast("double")).alias("part"),
    )


@query("SELECT conv_id, turn, CASE WHEN d AND NOT t THEN 'docs' WHEN t AND NOT d THEN 'traffic' ELSE 'both' END AS route FROM (SELECT conv_id, turn, list_has_any(w, ['regulation', 'policy', 'guideline', 'guidance', 'document', 'report', 'procedure', 'definition', 'convention']) AS d, list_has_any(w, ['vessel', 'vessels', 'arrival', 'arrivals', 'port', 'ship', 'ships', 'mmsi', 'dwell', 'congestion', 'traffic', 'position', 'jump']) AS t FROM (SELECT conv_id, turn, regexp_extract_all(lower(text || CASE turn % 3 WHEN 0 THEN ' port policy' WHEN 1 THEN ' arrivals' ELSE ' guidance' END), '[a-z0-9]+') AS w FROM conversations WHERE text IS NOT NULL))")
def question_routes(spark, sf):
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " port policy").when(F.col("turn") % 3 == 1, " arrivals").otherwise(" guidance"))
    return retrieval.routed(B.table(spark, sf, "conversations").filter("text IS NOT NULL").withColumn("question", said)).select("conv_id", "turn", "route")


@query(f"WITH t AS (SELECT p_partkey, lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' oil tanker' WHEN 1 THEN '' WHEN 2 THEN ' fishing boat' ELSE ' ro-ro cargo' END AS vessel_type_norm FROM part) SELECT p_partkey, {CLASS} AS vessel_class FROM t")
def vessel_classes(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" oil tanker", "", " fishing boat", " ro-ro cargo"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return B.table(spark, sf, "part").select("p_partkey", text.vessel_class(F.concat(F.lower("p_type"), tail)).alias("vessel_class"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || CASE WHEN n = 0 THEN '' ELSE '_' || n::VARCHAR END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS n FROM lineitem)")
def unique_ids(spark, sf):
    return feeds.number_repeats(B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_rows(spark, sf):
    return feeds.latest_by_id(B.table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query(W(POSITIONS, tail="SELECT position_id, printf('Vessel %s (%s) reported %.3f kn at %.5f, %.5f on %s, bound for %s.', mmsi, vessel_type_norm, round(speed, 3), round(latitude, 5), round(longitude, 5), strftime(timestamp, '%Y-%m-%d %H:%M:%S'), destination_raw) AS text FROM positions"))
def position_sentences(spark, sf):
    p = B.positions(spark, sf)
    return retrieval.position_sentences(p.withColumns({"speed": F.round("speed", 3), "latitude": F.round("latitude", 5), "longitude": F.round("longitude", 5)}))


@query("WITH a AS (SELECT replace(upper(n_name), ' ', '_') AS port_key, 'Port of ' || n_name AS asked FROM nation) SELECT asked, port_key FROM a WHERE port_key IN (SELECT DISTINCT replace(upper(n_name), ' ', '_') FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey)")
def resolved_ports(spark, sf):
    asked = B.table(spark, sf, "nation").select(F.concat(F.lit("Port of "), "n_name").alias("asked"))
    return retrieval.resolve_ports(asked, kpi.port_catalog(daily(spark, sf))).filter("port_key IS NOT NULL")


@query()
def fuzzy_ports(spark, sf):
    """What each customer's nation, written with a letter left out or doubled, is resolved to."""
    c, n = B.table(spark, sf, "customer"), B.table(spark, sf, "nation")
    at = F.col("c_custkey") % F.length("n_name") + 1
    worn = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.substring("n_name", F.lit(1), at - 1), F.expr("substring(n_name, c_custkey % length(n_name) + 2)"))).otherwise(F.concat(F.substring("n_name", F.lit(1), at), F.expr("substring(n_name, c_custkey % length(n_name) + 1)")))
    asked_ = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", worn.alias("asked"))  # 25 nations
    found = retrieval.resolve_ports(asked_.select("asked").distinct(), kpi.port_catalog(daily(spark, sf)))
    return asked_.join(found, "asked").select("c_custkey", "asked", "port_key")


SCOPE_TRIES = """c AS (SELECT n_nationkey * 4 + k AS question, k, n_name, replace(upper(n_name), ' ', '_') AS key FROM nation, range(4) r(k)),
known AS (SELECT DISTINCT replace(upper(n_name), ' ', '_') AS key FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey)"""


@query(W(SCOPE_TRIES, tail="""SELECT question, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 'QQZZX' ELSE key END AS port, CASE k WHEN 0 THEN 'user_filter' WHEN 1 THEN 'entity_port' WHEN 3 THEN 'user_filter' END AS source, CASE k WHEN 1 THEN 2 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS tried,
CASE WHEN k = 0 AND 'Port of ' || n_name <> key THEN 'Port of ' || n_name || ' -> ' || key WHEN k = 1 THEN 'XQXQX -> ' || key WHEN k = 2 THEN 'ZZXQQ ignored' END AS correction FROM c WHERE key IN (FROM known)"""))
def resolved_scopes(spark, sf):
    """The port of a question from several candidates: chosen by name, a wrong token before a right one, no right one, a wrong choice."""
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey"), "n_name", F.replace(F.upper("n_name"), F.lit(" "), F.lit("_")).alias("key"))
    known = kpi.port_catalog(daily(spark, sf))
    tries = [(0, 0, "user_filter", F.concat(F.lit("Port of "), "n_name")), (0, 1, "entity_primary", F.lit("QXQXQ")), (1, 1, "entity_primary", F.lit("XQXQX")), (1, 2, "entity_port", F.col("n_name")), (2, 1, "entity_primary", F.lit("ZZXQQ")), (3, 0, "user_filter", F.lit("QQZZX"))]
    rows_ = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("place"), F.lit(s).alias("source"), t.alias("token")) for k, p, s, t in tries))
    c = n.join(known.select(F.col("port_key").alias("key")).distinct(), "key", "left_semi").select("n_nationkey", F.inline(rows_))
    return retrieval.resolve_scopes(c.select((F.col("n_nationkey") * 4 + F.col("k")).alias("question"), "place", "source", "token"), known)


@query(W(PORT_CALLS, PC_STAYS, FLAGGED, tail="""SELECT 'a' AS asked, call_no FROM fl WHERE contains(upper(port_label), 'NATION_1') AND (s OR l) UNION ALL SELECT 'b', call_no FROM fl WHERE vessel_type_norm = 'tug' AND arrival_time::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
UNION ALL SELECT 'c', call_no FROM fl WHERE NOT (s OR l) AND (port_key = 'NATION_20' OR contains(upper(port_label), 'NATION_20'))"""))
def chosen_calls(spark, sf):
    f = portday.stay_flags(kpi.dwell(B.port_calls(spark, sf)))
    c = f.select("call_no", F.col("port_label").alias("port"), F.col("port_key").alias("locode"), F.col("vessel_type_norm").alias("vessel_type"), F.col("anomaly_flag").alias("anomaly"), F.col("arrival_time").cast("date").alias("date"))
    asked_ = {"a": {"port": " nation_1 ", "vessel_type": "ALL", "anomaly": True}, "b": {"vessel_type": "Tug ", "start": "2024-01-05", "end": "2024-01-20"}, "c": {"port": "nation_20", "anomaly": False}}
    out = [retrieval.chosen(c, **x).select(F.lit(k).alias("asked"), "call_no") for k, x in asked_.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- answers

SCOPE_SQL = """sc AS (SELECT n_nationkey * 10 + k AS scope_id, CASE WHEN k = 5 THEN 'NOWHERE' ELSE replace(upper(n_name), ' ', '_') END AS port_key, [DATE '2024-01-01', DATE '2024-01-10', DATE '2024-02-01', DATE '2023-01-01', NULL][k] AS date_from,
  [DATE '2024-01-31', DATE '2024-01-12', DATE '2024-01-01', DATE '2023-02-01', NULL][k] AS date_to, CASE WHEN k = 2 THEN 'TTW' ELSE 'WTW' END AS boundary FROM nation, range(1, 6) r(k))"""
_CH = lambda s="": f"CASE WHEN boundary = 'WTW' THEN wtw_co2e_t{s} ELSE ttw_co2e_t{s} END"
_IN = "(date_from IS NULL OR date >= date_from) AND (date_to IS NULL OR date <= date_to)"


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    days = (("2024-01-01", "2024-01-31"), ("2024-01-10", "2024-01-12"), ("2024-02-01", "2024-01-01"), ("2023-01-01", "2023-02-01"), (None, None))
    rows_ = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).cast("date").alias("date_from"), F.lit(b).cast("date").alias("date_to")) for k, (a, b) in enumerate(days, 1)))
    n = B.table(spark, sf, "nation").select("n_nationkey", "n_name", F.inline(rows_))
    port = F.when(F.col("k") == 5, "NOWHERE").otherwise(F.replace(F.upper("n_name"), F.lit(" "), F.lit("_")))
    return n.select((F.col("n_nationkey") * 10 + F.col("k")).cast("long").alias("scope_id"), port.alias("port_key"), "date_from", "date_to", F.when(F.col("k") == 2, "TTW").otherwise("WTW").alias("boundary"))


EMISSIONS_OF_SCOPES = f"""li AS (SELECT scope_id, call_id, {_CH()} AS t, {_CH('_lower')} AS lo, {_CH('_upper')} AS up, duration_h, fallback_usage_ratio FROM segs JOIN sc USING (port_key) WHERE call_id IS NOT NULL AND {_IN}),
bc AS (SELECT scope_id, call_id, sum(t) AS t, sum(lo) AS lo, sum(up) AS up, sum(duration_h) AS h FROM li GROUP BY ALL), bs AS (SELECT scope_id, sum(t) AS t, avg(fallback_usage_ratio) AS f FROM li GROUP BY ALL),
ca AS (SELECT scope_id, sum(t) AS ct, sum(lo) AS lo, sum(up) AS up, count(*) AS n, max(t) AS mt, max(h) AS mh FROM bc GROUP BY ALL),
pr AS (SELECT scope_id, sum({_CH()}) AS pt, sum({_CH('_lower')}) AS pl, sum({_CH('_upper')}) AS pu, avg(fallback_usage_ratio) AS pf FROM dp JOIN sc USING (port_key) WHERE {_IN} GROUP BY ALL),
ba AS (SELECT port_key, median(ttw_co2e_t) AS bt, median(wtw_co2e_t) AS bw FROM dp GROUP BY ALL),
jo AS (SELECT sc.*, ca.*, bs.t, bs.f, pr.*, coalesce(CASE WHEN boundary = 'WTW' THEN bw ELSE bt END, 0) AS base, CASE WHEN coalesce(date_from > date_to, false) THEN NULL WHEN ca.n > 0 THEN 'call_linked' WHEN pt IS NOT NULL THEN 'daily_proxy' END AS mode
  FROM sc LEFT JOIN ca ON sc.scope_id = ca.scope_id LEFT JOIN bs ON sc.scope_id = bs.scope_id LEFT JOIN pr ON sc.scope_id = pr.scope_id LEFT JOIN ba ON sc.port_key = ba.port_key),
ei AS (SELECT *, CASE mode WHEN 'call_linked' THEN t WHEN 'daily_proxy' THEN pt END AS total, CASE mode WHEN 'call_linked' THEN lo WHEN 'daily_proxy' THEN pl END AS lower, CASE mode WHEN 'call_linked' THEN up WHEN 'daily_proxy' THEN pu END AS upper, CASE mode WHEN 'call_linked' THEN f WHEN 'daily_proxy' THEN pf END AS fb FROM jo),
la AS (SELECT *, CASE WHEN total > 0 THEN (upper - lower) / total ELSE 0 END AS w FROM ei), lb AS (SELECT *, CASE WHEN w <= 0.2 AND fb <= 0.05 THEN 'high' WHEN w <= 0.4 OR fb <= 0.2 THEN 'medium' ELSE 'low' END AS c FROM la)"""


@query(W(*ROWS, SEGS, DAILY_PORT, SCOPE_SQL, EMISSIONS_OF_SCOPES,
    tail="""SELECT scope_id::BIGINT AS scope_id, CASE WHEN mode IS NULL THEN 'NOT_COMPUTABLE' WHEN abs(total) < 1e-12 THEN 'COMPUTED_ZERO' ELSE 'COMPUTED' END AS state, mode, round(total, 6) AS total, round(lower, 6) AS lower, round(upper, 6) AS upper,
CASE WHEN mode IS NULL THEN NULL WHEN mode = 'daily_proxy' AND c = 'high' THEN 'medium' ELSE c END AS confidence, CASE WHEN mode = 'call_linked' THEN round(ct, 6) END AS calls_total, CASE WHEN coalesce(date_from > date_to, false) THEN 0 ELSE coalesce(n, 0) END::BIGINT AS unique_calls,
CASE WHEN mode IS NULL OR base < 1 THEN 'unstable baseline' WHEN mode = 'call_linked' AND (mh > 240 OR mt > 500) THEN 'warning' ELSE 'checked' END AS sanity FROM lb"""))
def port_emission_answers(spark, sf):
    return answers.port_emissions(carbon.summed(segs(spark, sf)), scopes(spark, sf))


ASK_SQL = """ak AS (SELECT call_no * 4 + k AS ask_id, mmsi, CASE k WHEN 0 THEN call_id WHEN 1 THEN ' _' || lower(replace(call_id, '-', '')) WHEN 2 THEN call_id || 'X' ELSE replace(call_id, '_', ':') END AS call_id FROM port_calls, range(4) r(k) WHERE call_no % 7 = 0)"""


@query(W(*ROWS, SEGS, BY_CALL, ASK_SQL, """ne AS (SELECT ask_id, ltrim(trim(ak.call_id), ' :_-') = cl.call_id AS ex, cl.* FROM ak JOIN cl ON ak.mmsi = cl.mmsi AND regexp_replace(upper(ak.call_id), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(cl.call_id), '[^A-Z0-9]', '', 'g')),
fo AS (SELECT ask_id, bool_or(ex) AS ex, count(DISTINCT call_id) AS n, sum(wtw_co2e_t) FILTER (WHERE ex) AS xt, sum(wtw_co2e_t_lower) FILTER (WHERE ex) AS xl, sum(wtw_co2e_t_upper) FILTER (WHERE ex) AS xu, sum(wtw_co2e_t) AS yt, sum(wtw_co2e_t_lower) AS yl, sum(wtw_co2e_t_upper) AS yu FROM ne GROUP BY ask_id),
re AS (SELECT ask_id, n, ex, CASE WHEN ex THEN xt WHEN n = 1 THEN yt END AS total, CASE WHEN ex THEN xl WHEN n = 1 THEN yl END AS lower, CASE WHEN ex THEN xu WHEN n = 1 THEN yu END AS upper FROM ak LEFT JOIN fo USING (ask_id))""",
    tail="SELECT ask_id::BIGINT AS ask_id, CASE WHEN total IS NULL THEN 'NOT_COMPUTABLE' WHEN abs(total) < 1e-12 THEN 'COMPUTED_ZERO' ELSE 'COMPUTED' END AS state, CASE WHEN n IS NULL THEN 'no match' WHEN NOT ex AND n > 1 THEN 'ambiguous' END AS reason, round(total, 6) AS total, round(lower, 6) AS lower, round(upper, 6) AS upper FROM re"))
def call_emission_answers(spark, sf):
    c = B.port_calls(spark, sf).filter("call_no % 7 = 0").select("call_no", "mmsi", "call_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    asked_id = F.when(F.col("k") == 0, F.col("call_id")).when(F.col("k") == 1, F.concat(F.lit(" _"), F.lower(F.replace("call_id", F.lit("-"), F.lit(""))))).when(F.col("k") == 2, F.concat("call_id", F.lit("X"))).otherwise(F.replace("call_id", F.lit("_"), F.lit(":")))
    return answers.call_emissions(carbon.by_call(segs(spark, sf)), c.select((F.col("call_no") * 4 + F.col("k")).alias("ask_id"), "mmsi", asked_id.alias("call_id")))


CONGESTION_SERIES = "s AS (SELECT port_key, date, sum(congestion_index)::DOUBLE AS value FROM idx WHERE congestion_index IS NOT NULL GROUP BY ALL)"


def _on(target: str) -> str:
    """SQL for one target day."""
    d = f"DATE '{target}'"
    t = [f"month(date) = month({d}) AND day(date) = day({d})", f"month(date) = month({d}) AND abs(day(date) - day({d})) <= 2 AND dayname(date) = dayname({d})", f"week(date) = week({d}) AND dayname(date) = dayname({d})", f"month(date) = month({d}) AND dayname(date) = dayname({d})", f"month(date) = month({d})", f"dayname(date) = dayname({d})", "true"]
    tier = " ".join(f"WHEN count(*) FILTER (WHERE {x}) >= {k} THEN {i}" for i, (x, k) in enumerate(zip(t, _M, strict=True), 1))
    held = " OR ".join(f"(tier = {i} AND {x})" for i, x in enumerate(t, 1))
    return f"""SELECT '{target}' AS target, port_key, method, round(v, 6) AS predicted, round(lo, 6) AS lower, round(up, 6) AS upper, confidence, CASE WHEN v < 0.8 THEN 'below normal' WHEN v < 1.2 THEN 'normal' WHEN v < 1.6 THEN 'elevated' WHEN v IS NOT NULL THEN 'high' END AS level FROM (
SELECT e.port_key, CASE WHEN seen IS NOT NULL THEN 'observed' WHEN near THEN 'model' ELSE 'analog' END AS method, coalesce(seen, CASE WHEN near THEN predicted ELSE p END) AS v, coalesce(seen, CASE WHEN near THEN greatest(0, predicted - 1.96 * sigma * sqrt(step)) ELSE greatest(0, CASE WHEN k = 1 THEN p * 0.8 ELSE a END) END) AS lo,
  coalesce(seen, CASE WHEN near THEN predicted + 1.96 * sigma * sqrt(step) WHEN k = 1 THEN p * 1.2 ELSE b2 END) AS up, CASE WHEN seen IS NOT NULL THEN NULL WHEN near THEN CASE WHEN ahead <= 14 THEN 'high' ELSE 'medium' END
  WHEN tier = 1 AND k >= 4 THEN 'high' WHEN tier = 1 AND k >= 2 THEN 'medium' WHEN tier = 2 AND k >= 3 THEN 'high' WHEN tier = 2 AND k >= 2 THEN 'medium' WHEN tier <= 4 AND k >= 3 THEN 'medium' WHEN k >= 5 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, ahead > 0 AND ahead <= 28 AND n >= 14 AS near FROM (SELECT port_key, date_diff('day', max(date), {d}) AS ahead, count(*) AS n, max(value) FILTER (WHERE date = {d}) AS seen FROM s GROUP BY port_key)) e
LEFT JOIN (SELECT port_key, step, predicted, sigma FROM f JOIN b USING (port_key) WHERE step > 0 AND last + step = {d}) g ON e.port_key = g.port_key
LEFT JOIN (SELECT port_key, tier, count(*) AS k, avg(value) AS p, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b2 FROM s JOIN (SELECT port_key, CASE {tier} END AS tier FROM s GROUP BY port_key) USING (port_key) WHERE {held} GROUP BY ALL) x ON e.port_key = x.port_key)"""


TARGETS = ("2024-01-15", "2024-02-05", "2024-02-20", "2025-03-14")


@query("WITH RECURSIVE " + ", ".join((CALLS, DAILY, STAYS, POSITIONS, PROXY, INDEX, CONGESTION_SERIES, ONE, HORIZON)) + """, f AS (SELECT port_key, 0 AS step, h, NULL::DOUBLE AS predicted FROM h0
UNION ALL SELECT port_key, step + 1, h[2:7] || [greatest(0, 0.7 * h[1] + 0.3 * list_avg(h))], greatest(0, 0.7 * h[1] + 0.3 * list_avg(h)) FROM f WHERE step < 28) """ + " UNION ALL ".join(map(_on, TARGETS)))
def congestion_on_date(spark, sf):
    series_ = forecast.daily_series(index(spark, sf), "congestion_index")
    out = [answers.congestion_on(series_, t).select(F.lit(t).alias("target"), "*") for t in TARGETS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(W(*ROWS, SEGS, DAILY_PORT, "t AS (SELECT port_key, date, sum(wtw_co2e_t) AS total_t FROM dp GROUP BY ALL)", "v AS (SELECT *, lag(total_t) OVER w AS y, avg(total_t) OVER (PARTITION BY port_key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM t WINDOW w AS (PARTITION BY port_key ORDER BY date))",
    "u AS (SELECT *, CASE WHEN abs(y) >= 1 THEN (total_t - y) / abs(y) * 100 END AS day_change, CASE WHEN abs(m) >= 1 THEN (total_t - m) / abs(m) * 100 END AS mean_change FROM v)",
    tail="SELECT port_key, date, round(total_t, 6) AS total_t, round(day_change, 6) AS day_change, round(mean_change, 6) AS mean_change, CASE WHEN round(total_t, 9) >= 1e6 THEN format('{:,.2f} Mt', total_t / 1e6) WHEN total_t >= 1e3 THEN format('{:,.2f} kt', total_t / 1e3) ELSE format('{:,.2f} t', total_t) END AS shown, CASE WHEN mean_change IS NULL THEN 'no baseline' WHEN mean_change >= 80 THEN 'very high' WHEN mean_change >= 30 THEN 'high' WHEN mean_change <= -30 THEN 'low' ELSE 'usual' END AS level FROM u"), dates="date")
def emission_changes(spark, sf):
    return answers.emission_changes(carbon.daily_port(segs(spark, sf)))


LINE_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, '[' || role || ' | n/a | ' || turn::VARCHAR || '] ' || CASE WHEN length({LINE_SQL}) > 160 THEN rtrim(substring({LINE_SQL}, 1, 160)) || '...' ELSE {LINE_SQL} END AS line FROM conversations WHERE text IS NOT NULL")
def evidence_lines(spark, sf):
    c = B.table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.col("role").alias("source"), F.lit(" ").alias("port_key"), F.col("turn").alias("date"), "text")
    return answers.evidence_lines(c).select("conv_id", "turn", "line")


@query(W(POSITIONS, "c AS (SELECT vessel_type_norm AS question, port_key, count(*) AS k FROM positions GROUP BY ALL)", tail="SELECT question, min(timestamp::DATE) AS first, max(timestamp::DATE) AS last, round(min(speed), 6) AS least, round(max(speed), 6) AS most, count(*) AS n, (SELECT port_key FROM c WHERE c.question = p.vessel_type_norm ORDER BY k DESC, port_key LIMIT 1) AS top_port FROM (SELECT *, vessel_type_norm AS question FROM positions) p GROUP BY question, vessel_type_norm"), dates="first last")
def evidence_span(spark, sf):
    p = B.positions(spark, sf).select(F.col("vessel_type_norm").alias("question"), "port_key", F.col("timestamp").cast("date").alias("date"), F.col("speed").alias("value"))
    return answers.evidence_span(p)


# ---- questions

ASKED = (
    "Show daily arrival counts at LVVNT between 2022-02-01 and 2022-02-28 for %s.", "Show monthly WTW CO2e trend for SETRG in 2022.", "What are call-level emissions for MMSI 123456789 and call_id_123456789_2022-03-01T10-00-00_SEGOT?",
    "What is truck turn-time at the gate for SEGOT today?", "Give exact berth-level queue length for vessel arrivals at GDANSK.", "Which port is busier, FI HEL or %s, on Fridays versus Mondays?", "Predict congestion at %s for the next 6 weeks",
    "Any suspicious jump near Gothenburg on 2022-03-05?", "Why was dwell time so high in March 2022?", "When is Klaipeda usually busiest, by hour?", "What was the peak arrival date last 3 weeks for tankers?", "NOx and PM per call in 2022-04", "how busy is it on February 20, 2026?",
)
KIND_SQL = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
QUESTIONS_SQL = f"""q0 AS (SELECT n_nationkey, k, replace([{", ".join(f"'{a}'" for a in ASKED)}][k], '%s', n_name) AS question FROM nation, range(1, {len(ASKED)} + 1) r(k)), q1 AS (SELECT *, lower(question) AS q FROM q0)"""
INTENT_SQL = f"""CASE WHEN {KIND_SQL(questions.UNSUPPORTED)} OR regexp_matches(q, '{questions.UNSUPPORTED_PATTERN}') THEN 'G' WHEN {KIND_SQL(questions.CARBON)} THEN 'H' WHEN {KIND_SQL(questions.ANOMALY)} THEN 'F'
WHEN {KIND_SQL(questions.FORECAST)} THEN 'C' WHEN {KIND_SQL(questions.COMPARE)} AND {KIND_SQL((*questions.DAYS, 'weekend', 'weekday'))} THEN 'B' WHEN {KIND_SQL(questions.COMPARE)} THEN 'D'
WHEN {KIND_SQL(questions.DIAGNOSTIC)} THEN 'E' WHEN {KIND_SQL(questions.PATTERN)} THEN 'B' ELSE 'A' END"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").select("n_nationkey", "n_name", F.posexplode(F.array(*map(F.lit, ASKED))).alias("k", "t"))
    return n.select("n_nationkey", (F.col("k") + 1).cast("long").alias("k"), F.replace("t", F.lit("%s"), F.col("n_name")).alias("question"))


@query(W(QUESTIONS_SQL, tail=f"""SELECT n_nationkey, k, {INTENT_SQL} AS intent, CASE WHEN contains(q, 'dwell') THEN 'dwell_minutes' WHEN contains(q, 'congestion') OR contains(q, 'busy') THEN 'congestion_index' WHEN contains(q, 'occupancy') THEN 'occupancy_vessels'
WHEN contains(q, 'arrival') OR contains(q, 'arrive') THEN 'arrivals_vessels' WHEN contains(q, 'spike') OR contains(q, 'anomaly') THEN 'arrivals_spike' ELSE 'arrivals_vessels' END AS metric,
CASE WHEN (contains(q, 'highest') OR contains(q, 'max') OR contains(q, 'peak')) AND (contains(q, 'day') OR contains(q, 'date')) THEN 'peak_day' END AS aggregation,
CASE WHEN contains(q, 'tanker') THEN 'tanker' WHEN contains(q, 'cargo') THEN 'cargo ship' WHEN contains(q, 'container') THEN 'container ship' END AS vessel_type,
CASE WHEN contains(q, 'wtw') OR contains(q, 'well-to-wake') OR contains(q, 'well to wake') OR contains(q, 'lifecycle') OR contains(q, 'co2e') THEN 'WTW' ELSE 'TTW' END AS boundary,
least(greatest(coalesce(try_cast(nullif(regexp_extract(q, '\\b(\\d{{1,2}})\\s+weeks?\\b', 1), '') AS INT), 4), 1), 12) AS horizon_weeks, nullif(regexp_extract(q, '\\bmmsi\\s*[:#]?\\s*(\\d{{6,9}})\\b', 1), '') AS mmsi FROM q1"""))
def question_intents(spark, sf):
    return questions.understood(asked(spark, sf), F.lit("2022-03-02").cast("date")).select("n_nationkey", "k", "intent", "metric", "aggregation", "vessel_type", "boundary", "horizon_weeks", "mmsi")


SPAN_SQL = """CASE k WHEN 1 THEN ['2022-02-01', '2022-02-28'] WHEN 8 THEN ['2022-03-05', '2022-03-05'] WHEN 9 THEN ['2022-03-01', '2022-03-31'] WHEN 12 THEN ['2022-04-01', '2022-04-30'] WHEN 13 THEN ['2026-02-20', '2026-02-20'] END"""
FIRST_PORT_SQL = "CASE k WHEN 1 THEN 'LVVNT' WHEN 2 THEN 'SETRG' WHEN 4 THEN 'SEGOT' WHEN 5 THEN 'GDANSK' WHEN 6 THEN 'FIHEL' WHEN 7 THEN regexp_extract(question, 'at ([A-Za-z]+)', 1) WHEN 8 THEN 'Gothenburg' WHEN 9 THEN 'March' WHEN 10 THEN 'Klaipeda' WHEN 11 THEN 'tankers' END"


@query(W(QUESTIONS_SQL, tail=f"""SELECT n_nationkey, k, ({SPAN_SQL})[1] AS date_from, ({SPAN_SQL})[2] AS date_to, CASE WHEN k = 11 THEN 'last_3_weeks' END AS "window", CASE k WHEN 3 THEN '123456789_2022-03-01T10-00-00_SEGOT' END AS call_id,
CASE k WHEN 6 THEN 'Friday' END AS dow, CASE k WHEN 6 THEN 'Monday' END AS dow_compare, {FIRST_PORT_SQL} AS port FROM q1"""), dates="")
def question_entities(spark, sf):
    got = questions.understood(asked(spark, sf), F.lit("2022-03-02").cast("date"))
    return got.select("n_nationkey", "k", F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"), "window", "call_id", "dow", "dow_compare", "port")


HERE = (
    "How many vessels arrived between 2024-01-05 and 2024-01-20?", "What was the peak arrival date last 3 weeks?", "Which are the top ports in January 2024?", "Average dwell time of tankers in January 2024",
    "How high was congestion in January 2024?", "Is it busier on Fridays versus Mondays?", "Which hour is usually busiest?", "What weekday is busiest?", "Predict congestion on 2024-02-10",
    "What congestion is expected on Mondays in the next 3 weeks?", "Compare arrivals here", "Why was it so slow?", "Any unusual spike?", "Any suspicious jump on 2024-01-10?", "What are truck turn-time figures?",
    "CO2e emissions WTW in January 2024", "Monthly NOx emissions", "Will carbon emissions rise?", "Estimate emissions of a tanker manoeuvring 2 hours at 6 kn", "Emissions in March 2021", "emissions of mmsi 123456 call_id_none",
)


_ROUTES = ("arrivals", "peak_day", "top_ports", "dwell", "congestion", "compare_weekdays", "busiest_hour", "busiest_weekday", "forecast_date", "forecast_weekday", "compare_ports", "diagnose", "spikes", "jumps", "unsupported", "port_by_day", "port_by_month", "forecast_only", "estimate", "port_by_day", "call")
_FEB = "DATE '2024-02-10'"
_LIKE = ["month(date) = 2 AND day(date) = 10", "month(date) = 2 AND abs(day(date) - 10) <= 2 AND isodow(date) = 6", "week(date) = 6 AND isodow(date) = 6", "month(date) = 2 AND isodow(date) = 6", "month(date) = 2", "isodow(date) = 6", "true"]
_ANALOG = "coalesce(" + ", ".join(f"CASE WHEN count(*) FILTER (WHERE {t}) >= {k} THEN avg(value) FILTER (WHERE {t}) END" for t, k in zip(_LIKE, _M, strict=True)) + ")"
ANSWERS_SQL = f"""d AS (SELECT port_key AS key, arrival_time::DATE AS date, vessel_type_norm AS type, count(DISTINCT mmsi) AS v FROM port_calls GROUP BY ALL), dd AS (SELECT key, date, sum(v) AS v FROM d GROUP BY ALL),
st AS (SELECT port_key AS key, arrival_time::DATE AS date, vessel_type_norm AS type, dwell_minutes FROM pc_stays), pq AS (SELECT DISTINCT n_nationkey * 100 AS id, replace(upper(n_name), ' ', '_') AS key FROM nation JOIN d ON replace(upper(n_name), ' ', '_') = d.key),
daily AS (SELECT port_key, port_label, arrival_time::DATE AS date, vessel_type_norm, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM port_calls GROUP BY ALL), stays AS (SELECT *, arrival_time::DATE AS date FROM pc_stays),
{INDEX}, s AS (SELECT port_key, date, avg(congestion_index) AS value FROM idx WHERE congestion_index IS NOT NULL GROUP BY ALL), {ONE}, {HORIZON},
f AS (SELECT port_key, 0 AS step, h, NULL::DOUBLE AS predicted FROM h0 UNION ALL SELECT port_key, step + 1, h[2:7] || [greatest(0, 0.7 * h[1] + 0.3 * list_avg(h))], greatest(0, 0.7 * h[1] + 0.3 * list_avg(h)) FROM f WHERE step < 28),
wk AS (SELECT key, dayname(date) AS w, sum(v) AS v, count(*) AS n FROM dd GROUP BY ALL), hr AS (SELECT port_key AS key, hour(h) AS hour, sum(v) AS v FROM (SELECT port_key, date_trunc('hour', timestamp) AS h, vessel_type_norm, count(DISTINCT mmsi) AS v FROM positions GROUP BY ALL) GROUP BY ALL),
ty AS (SELECT key, type, sum(v) AS v FROM d GROUP BY ALL), lead AS (SELECT key, arg_min(type, (-v, type)) AS type, max(v) AS v, count(*) AS n FROM ty GROUP BY key),
sp AS (SELECT key, date, v, CASE WHEN count(*) OVER w >= 3 THEN avg(v) OVER w + 2 * coalesce(stddev_samp(v) OVER w, 0) END AS threshold FROM dd WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
ju AS (SELECT timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 6e7 AS m, 111.0 * sqrt(pow(latitude - lag(latitude) OVER w, 2) + pow(longitude - lag(longitude) OVER w, 2)) AS km FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp, position_id)),
jn AS (SELECT count(*) AS n, max(km) AS km FROM ju WHERE timestamp::DATE = DATE '2024-01-10' AND m > 0 AND m <= 30 AND (km >= 20 OR (km >= 5 AND km / 1.852 / (m / 60) >= 40))),
tp AS (SELECT arg_min(key, (-v, key)) AS key, max(v) AS v, count(*) AS n FROM (SELECT key, sum(v) AS v FROM dd WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY key)),
sc AS (SELECT pq.id + k AS scope_id, key AS port_key, CASE k WHEN 16 THEN DATE '2024-01-01' WHEN 20 THEN DATE '2021-03-01' END AS date_from, CASE k WHEN 16 THEN DATE '2024-01-31' WHEN 20 THEN DATE '2021-03-31' END AS date_to, CASE k WHEN 16 THEN 'WTW' ELSE 'TTW' END AS boundary FROM pq, (VALUES (16), (17), (20)) r(k)),
{EMISSIONS_OF_SCOPES},
x AS (SELECT id + 1 AS q, sum(v)::DOUBLE AS value, NULL::DOUBLE AS second, NULL::VARCHAR AS label, count(*) AS n, 'OK' AS state FROM pq JOIN dd USING (key) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY id
UNION ALL SELECT id + 2, max(v), NULL, arg_max(date, (v, -date_diff('day', DATE '2000-01-01', date)))::VARCHAR, count(*), 'OK' FROM (SELECT *, max(date) OVER (PARTITION BY key) AS l FROM pq JOIN dd USING (key)) WHERE date >= l - 21 GROUP BY id
UNION ALL SELECT id + 3, v, NULL, tp.key, n, 'OK' FROM pq, tp WHERE n > 0
UNION ALL SELECT id + 4, avg(dwell_minutes), median(dwell_minutes), NULL, count(*), 'OK' FROM pq JOIN st USING (key) WHERE type LIKE '%tanker%' AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY id
UNION ALL SELECT id + 5, avg(value), max(value), arg_max(date, (value, -date_diff('day', DATE '2000-01-01', date)))::VARCHAR, count(*), 'OK' FROM pq JOIN s ON key = port_key WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY id
UNION ALL SELECT id + 6, a.v, b.v, CASE WHEN a.v > b.v THEN 'Friday' ELSE 'Monday' END, (SELECT sum(n) FROM wk c WHERE c.key = pq.key)::BIGINT, 'OK' FROM pq JOIN wk a ON a.key = pq.key AND a.w = 'Friday' JOIN wk b ON b.key = pq.key AND b.w = 'Monday'
UNION ALL SELECT id + 7, max(v), NULL, arg_min(hour, (-v, hour))::VARCHAR, count(*), 'OK' FROM pq JOIN hr USING (key) GROUP BY id
UNION ALL SELECT id + 8, max(v), NULL, arg_min(w, (-v, w)), sum(n)::BIGINT, 'OK' FROM pq JOIN wk USING (key) GROUP BY id
UNION ALL SELECT id + 9, coalesce(seen, p, a), NULL, CASE WHEN seen IS NOT NULL THEN 'observed' WHEN p IS NOT NULL THEN 'model' ELSE 'analog' END, NULL, 'OK' FROM pq JOIN (SELECT port_key, max(value) FILTER (WHERE date = {_FEB}) AS seen, {_ANALOG} AS a FROM s GROUP BY port_key) e ON e.port_key = key
  LEFT JOIN (SELECT port_key, predicted AS p FROM f JOIN b USING (port_key) WHERE step > 0 AND last + step = {_FEB}) g ON g.port_key = key
UNION ALL SELECT id + 10, avg(predicted), NULL, CASE WHEN avg(predicted) < 0.8 THEN 'below normal' WHEN avg(predicted) < 1.2 THEN 'normal' WHEN avg(predicted) < 1.6 THEN 'elevated' ELSE 'high' END, count(*), 'OK' FROM pq JOIN f ON f.port_key = key JOIN b ON b.port_key = key WHERE step BETWEEN 1 AND 21 AND isodow(last + step) = 1 GROUP BY id
UNION ALL SELECT id + 11, sum(v), NULL, key, 1, 'OK' FROM pq JOIN dd USING (key) GROUP BY id, key
UNION ALL SELECT id + 12, v, (SELECT median(dwell_minutes) FROM st WHERE st.key = lead.key AND st.type = lead.type), type, n, 'OK' FROM pq JOIN lead USING (key)
UNION ALL SELECT id + 13, NULL, NULL, NULL, count(*) FILTER (WHERE round(v - threshold, 9) > 0), 'OK' FROM pq JOIN sp USING (key) GROUP BY id
UNION ALL SELECT id + 14, km, NULL, NULL, n, 'OK' FROM pq, jn
UNION ALL SELECT scope_id, total, NULL, mode, CASE WHEN mode IS NULL THEN 0 ELSE coalesce(n, 0) END, CASE WHEN mode IS NULL THEN 'NOT_COMPUTABLE' WHEN abs(total) < 1e-12 THEN 'COMPUTED_ZERO' ELSE 'COMPUTED' END FROM lb
UNION ALL SELECT id + 19, (mcr_kw * 0.2 * sfc_main + aux_kw * sfc_aux) * 2 / 1e6 * co2_factor, NULL, vessel_class, NULL, 'COMPUTED' FROM pq, factors WHERE vessel_class = 'tanker' AND mode = 'manoeuvring'
UNION ALL SELECT id + 21, NULL, NULL, 'no match', NULL, 'NOT_COMPUTABLE' FROM pq)"""


@query("WITH RECURSIVE " + ", ".join((*ROWS, PC_STAYS, PROXY, SEGS, DAILY_PORT, ANSWERS_SQL)) + f""" SELECT (id + k)::BIGINT AS question_id, {list(_ROUTES)}[k] AS route, key AS port, coalesce(x.state, CASE WHEN k = 15 THEN 'UNSUPPORTED' WHEN k = 18 THEN 'FORECAST_ONLY' WHEN k IN (13, 14) THEN 'OK' ELSE 'NO_DATA' END) AS state,
round(value, 6) AS value, round(second, 6) AS second, label, x.n::BIGINT AS n FROM pq CROSS JOIN range(1, {len(_ROUTES)} + 1) r(k) LEFT JOIN x ON x.q = id + k""")
def answered_questions(spark, sf):
    """Every question of `HERE` for every port with calls, which the user chose by its label."""
    calls, positions = B.port_calls(spark, sf), B.positions(spark, sf)
    ports = calls.select(F.col("port_label").alias("n_name")).distinct()
    n = B.table(spark, sf, "nation").join(ports, "n_name", "left_semi").select("n_nationkey", F.col("n_name").alias("user_port"), F.posexplode(F.array(*map(F.lit, HERE))).alias("k", "question"))
    none = F.lit(None).cast("date")
    asked_ = n.select((F.col("n_nationkey") * 100 + F.col("k") + 1).cast("long").alias("question_id"), "question", "user_port", none.alias("user_from"), none.alias("user_to"))
    by_day, stays = kept(kpi.call_arrivals(calls)), kpi.dwell(calls)
    return dispatch.answered(spark, asked_, F.lit("2024-01-31").cast("date"), daily=by_day, stays=stays, index=kpi.congestion(by_day, kpi.proxy_arrivals(positions), stays), positions=positions, segs=segs(spark, sf))


# ---- learning


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i IN (SELECT (k * (SELECT count(*) - 1 FROM events)) // 99 FROM range(100) r(k))")
def linspace_sample(spark, sf):
    return learning.evenly(B.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 100).select("event_id")


@query("SELECT is_train, count(*) AS n, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 < floor(0.8 * count(*) OVER ()) AS is_train FROM events) GROUP BY is_train")
def time_split(spark, sf):
    return learning.time_split(B.table(spark, sf, "events"), ["ts", "event_id"]).groupBy("is_train").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query(W(POSITIONS, "c AS (SELECT port_key, count(*) AS n FROM positions GROUP BY port_key)", tail="SELECT port_key, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"))
def class_weights(spark, sf):
    return learning.class_weights(B.positions(spark, sf), "port_key")


@query(W(POSITIONS, DELTAS, tail="SELECT round(quantile_cont(abs(acceleration_kn_per_h), 0.99), 6) AS acceleration_p99, round(quantile_cont(course_change_deg, 0.95), 6) AS course_change_p95 FROM deltas"))
def anomaly_thresholds(spark, sf):
    return learning.thresholds(tracks.deltas(B.positions(spark, sf)))


@query(W(CALLS, DAILY, SERIES, ONE, tail="SELECT round(avg(abs(value - predicted)), 6) AS mae, round(sqrt(avg((value - predicted) * (value - predicted))), 6) AS rmse, round(median(abs(value - predicted)), 6) AS median_ae FROM o"))
def regression_metrics(spark, sf):
    return learning.regression_report(forecast.one_step(values(spark, sf)), "value", "predicted")


@query(W("p AS (SELECT o_orderpriority AS label, lag(o_orderpriority, 1, '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prediction FROM orders)", "t AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hits FROM p GROUP BY label)", "q AS (SELECT prediction AS class, count(*) AS predicted FROM p GROUP BY prediction)", "m AS (SELECT class, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM t FULL JOIN q USING (class))", "r AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM m)", tail=f"SELECT class, support, hits, predicted, {R6('precision', 'recall')}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r"))
def classification_metrics(spark, sf):
    from pyspark.sql import Window

    o = B.table(spark, sf, "orders")
    lag = F.lag("o_orderpriority", 1, "1-URGENT").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return learning.classification_report(o.select(F.col("o_orderpriority").alias("label"), lag.alias("prediction")))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.clock(tracks.deltas(B.positions(spark, sf)))


def _model_rows(rows: DataFrame, *labels: str) -> DataFrame:
    """What models read of the rows, computed once: fitting passes over them many times."""
    return kept(rows.select("position_id", "timestamp", *learning.FEATURES, *labels))


@query()
def destination_predictions(spark, sf):
    rows = _model_rows(_features(spark, sf).withColumnRenamed("port_key", "destination_norm"), "destination_norm")
    known = learning.frequent_classes(rows, "destination_norm")
    model = learning.train_destination(learning.time_split(known, ["timestamp", "position_id"]).filter("is_train").drop("position", "is_train"))
    return learning.top_classes(model.transform(rows), list(model.stages[0].labels), 3).select("position_id", F.array_join(F.transform("top", lambda t: t["name"]), ",").alias("top"))


@query()
def eta_predictions(spark, sf):
    rows = _model_rows(tracks.clock(tracks.eta_label(tracks.deltas(B.positions(spark, sf)), B.port_calls(spark, sf))), "eta_minutes_label")
    return learning.train_eta(rows, rounds=5).transform(rows).select("position_id", "eta_minutes_label", "prediction")


@query()
def destination_metrics(spark, sf):
    """Accuracy over the last fifth of the time of a model of the rest."""
    rows = _model_rows(_features(spark, sf).withColumnRenamed("port_key", "destination_norm"), "destination_norm")
    rows = learning.time_split(rows, ["timestamp", "position_id"])
    model = learning.train_destination(learning.frequent_classes(rows.filter("is_train"), "destination_norm").drop("position", "is_train"))
    scored = learning.top_classes(model.transform(rows.filter("NOT is_train")), list(model.stages[0].labels), 5)
    return learning.accuracy(scored.withColumn("names", F.transform("top", lambda t: t["name"])), "destination_norm", "names")


@query()
def eta_metrics(spark, sf):
    """Errors over the last fifth of the time of a model of the rest."""
    rows = _model_rows(tracks.clock(tracks.eta_label(tracks.deltas(B.positions(spark, sf)), B.port_calls(spark, sf))), "eta_minutes_label")
    rows = learning.time_split(rows, ["timestamp", "position_id"])
    model = learning.train_eta(rows.filter("is_train").drop("position", "is_train"), rounds=5)
    return learning.regression_report(model.transform(rows.filter("NOT is_train AND eta_minutes_label IS NOT NULL")), "eta_minutes_label")


@query()
def track_anomalies(spark, sf):
    rows, columns = _features(spark, sf), ["speed", "delta_distance_km", "course_change_deg"]
    return learning.isolation_score(rows, columns, learning.fit_isolation(rows, columns)).select("position_id", "anomaly_score")


