"""Queries on sources, incidents, events, health, evaluation, injection and the learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EVENT_TEXT, NOTES, SENSORS, TOLERANCE, UNITS, VARS, WARMUP
from ..operators import board, evaluate, events, features, fusion, health, incidents, inject, models, qc
from ..operators.neighbours import neighbour_support, residuals, spatial_z
from ..sources import packets, tables
from ..sources.scratch import scratch_path
from ..streaming.edge import edge_qc
from . import fixtures
from . import incident_sql as inc
from .fixtures import CLEAN
from .layers import Layers
from .oracle import build, each, r6, runs
from .queries import EXTREMES, KEY, SQL, VECTOR_SQL, of, pick, query

# ------------------------------------------------------------------ sources and sinks


def _csv(x: Layers) -> DataFrame:
    path = scratch_path(x.spark, "observations")
    stamp = F.date_format(F.timestamp_seconds(F.col("minute") * 60), "yyyy-MM-dd HH:mm:ss")
    x.panel.select(F.col("station").alias("Station_ID"), stamp.alias("TIME"), F.col("T_raw").alias("Temp"), F.col("P_raw").alias("pressure"), F.col("RH_raw").alias("Humidity")).write.option("header", True).csv(path)
    return tables.read_observations(x.spark, path)


query("s1_read_observations", lambda x: pick(_csv(x).select(F.col("station").cast("long").alias("station"), tables.minute_number(F.col("time")).alias("minute"), "T_raw", "P_raw", "RH_raw"), KEY, "T_raw P_raw RH_raw"), build("panel", f"SELECT station, minute, {r6('T_raw P_raw RH_raw')} FROM panel"))


def _stations_csv(x: Layers) -> DataFrame:
    path = scratch_path(x.spark, "stations")
    x.stations.select(F.col("station").alias("Station"), "lat", "lon").write.option("header", True).csv(path)
    return tables.read_stations(x.spark, path)


query("s2_read_stations", lambda x: pick(_stations_csv(x).withColumns({"station": F.col("station").cast("long")}), "station city", "lat lon elev"), build("stations", "SELECT station, CAST(station AS VARCHAR) AS city, round(lat + 1.3e-8, 6) + 0.0 AS lat, round(lon + 1.3e-8, 6) + 0.0 AS lon, round(0.0 + 1.3e-8, 6) + 0.0 AS elev FROM stations"))
query(
    "s3_first_per_minute",
    lambda x: tables.first_per_minute(x.spark.read.parquet(f"{x.sf}/events.parquet").select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("time"), "event_id", "value"), "event_id").select("station", "minute", "event_id"),
    "SELECT station, minute, event_id FROM (SELECT user_id AS station, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 60) ORDER BY event_id) AS r FROM events) WHERE r = 1",
)
query(
    "s4_densify",
    lambda x: pick(tables.densify(x.panel.where("minute % 7 <> 3 AND station <> 5").select("station", "minute", "T_raw"), x.stations), KEY, "T_raw"),
    build("panel stations", "SELECT g.station, g.minute, round(p.T_raw + 1.3e-8, 6) + 0.0 AS T_raw FROM (SELECT station, unnest(range(a, b + 1)) AS minute FROM stations, (SELECT min(minute) AS a, max(minute) AS b FROM panel WHERE minute % 7 <> 3 AND station <> 5)) g LEFT JOIN panel p ON p.station = g.station AND p.minute = g.minute AND p.minute % 7 <> 3 AND p.station <> 5"),
)


def _written(x: Layers) -> DataFrame:
    return tables.write_alerts(x.incidents.withColumn("kind", F.lit("fault")).select("kind", "station", "onset", "end", "type", "checks", "corrected"), scratch_path(x.spark, "alerts"))


query("s6_write_alerts", _written, build("alerts", "SELECT 'fault' AS kind, count(*) AS n FROM alerts"))
_POINTS = "prob ts T P RH " + of("exp exp_lo exp_hi")
_SHOWN = "round(prob + 1.3e-8, 3) + 0.0 AS prob, round(least(ts, 5.0) + 1.3e-8, 2) + 0.0 AS ts, round(CASE WHEN T_raw > -90 THEN T_raw END + 1.3e-8, 2) + 0.0 AS T, round(CASE WHEN P_raw > 1 THEN P_raw END + 1.3e-8, 2) + 0.0 AS P, round(CASE WHEN RH_raw > -90 THEN RH_raw END + 1.3e-8, 2) + 0.0 AS RH, " + ", ".join(f"round({c} + 1.3e-8, 2) + 0.0 AS {c}" for c in of("exp exp_lo exp_hi").split())
query(
    "s8_station_timeline",
    lambda x: board.station_timeline(x.expected).select("station", F.explode("points").alias("p")).select("station", "p.minute", *[(F.col(f"p.{c}") + 0.0).alias(c) for c in _POINTS.split()]),
    build("exp", f"SELECT station, minute, {_SHOWN} FROM expected WHERE minute > (SELECT max(minute) FROM expected) - 120"),
)


def _packets(x: Layers) -> DataFrame:
    text = F.to_json(F.struct(F.col("station").cast("string").alias("id"), F.col("T_raw").alias("t"), F.col("P_raw").alias("p"), F.col("RH_raw").alias("rh"), (F.col("minute") % 64).cast("int").alias("flags")))
    return packets.decode_flags(packets.parse_packets(x.panel.select("minute", text.alias("value")))).withColumn("station", F.col("station").cast("long"))


query("s9_parse_packets", lambda x: pick(_packets(x), KEY + "flags", "T_raw P_raw RH_raw"), build("panel", f"SELECT station, minute, CAST(minute % 64 AS INTEGER) AS flags, {r6('T_raw P_raw RH_raw')} FROM panel"))
query(
    "f9_decode_flags", lambda x: _packets(x).select("station", "minute", *[f"flag_{k}" for k in packets.FLAGS], "suspicious"),
    build("panel", "SELECT station, minute, " + ", ".join(f"(minute % 64) & {b} <> 0 AS flag_{k}" for k, b in packets.FLAGS.items()) + ", minute % 64 <> 0 AS suspicious FROM panel"),
)
query(
    "s10_station_directory",
    lambda x: pick(board.station_directory(x.stations, x.edges).select("station", "city", F.explode_outer("neighbours").alias("n")).select("station", "city", "n.*"), "station city rank nb", "lon lat km"),
    build("edges", "SELECT s.station, s.city, e.rank, e.nb, round(n.lon + 1.3e-8, 6) + 0.0 AS lon, round(n.lat + 1.3e-8, 6) + 0.0 AS lat, round(round(e.km, 0) + 1.3e-8, 6) + 0.0 AS km FROM stations s LEFT JOIN edges e ON e.station = s.station LEFT JOIN stations n ON n.station = e.nb"),
)

# ------------------------------------------------------------------ incidents
query("j11_incident_evidence", lambda x: incidents.incident_evidence(x.alerts, x.scored.select("station", "minute", "hard"), 90, 10).select("station", "run_onset", "minute", "hard"), build("alerts", 'SELECT h.station, a.onset AS run_onset, h.minute, h.hard FROM alerts a JOIN hard h ON h.station = a.station AND h.minute >= a.onset - 90 AND h.minute < greatest(a."end", a.onset + 60) + 10'))
_INCIDENT = "station run_onset "
_LONGS, _DOUBLES = " ".join([*inc.BOOLS, *[k for k in inc.LONGS if k != "end"]]), " ".join(k for k in inc.DOUBLES if k != "dew_mid")


def _profile(x: Layers) -> DataFrame:
    """All of a profile: its numbers, and the length and sum of its series."""
    sums = [F.aggregate(f"series_{v}", F.lit(0.0), lambda a, r: a + r["d"]).alias(f"sum_{v}") for v in VARS]
    found = x.incidents.select(*_INCIDENT.split(), *_LONGS.split(), *_DOUBLES.split(), "end", "dew_moved", *sums, *[F.size(f"series_{v}").cast("long").alias(f"n_{v}") for v in VARS])
    return pick(found, f"{_INCIDENT} end {_LONGS} {of('n')}", f"{_DOUBLES} dew_moved {of('sum')}")


_SUMS = ", ".join(f"CAST(len(s_{v}) AS BIGINT) AS n_{v}, round(list_sum(list_transform(s_{v}, lambda r: r.d)) + 1.3e-8, 6) + 0.0 AS sum_{v}" for v in VARS)
query("a7_incident_profile", _profile, inc.sql(inc.PROFILE, f'SELECT station, run_onset, "end", {", ".join(_LONGS.split())}, {_SUMS}, {r6(_DOUBLES)}, round(dew_td - dew_mid + 1.3e-8, 6) + 0.0 AS dew_moved FROM prof'))
query("i1_i2_main_variable", lambda x: pick(x.incidents, _INCIDENT + "main", of("peak zpeak")), inc.sql(inc.MAIN, f"SELECT station, run_onset, main, {r6(of('peak zpeak'))} FROM main"))
query("i3_classify_fault", lambda x: pick(x.incidents, _INCIDENT + "type main"), inc.sql(inc.TYPED, "SELECT station, run_onset, type, main FROM typed"))
query("t5_largest_deviations", lambda x: pick(x.incidents, _INCIDENT + "rise", "pk"), inc.sql(inc.TYPED, f"SELECT station, run_onset, CAST(rise AS BIGINT) AS rise, {r6('pk')} FROM typed"))
_FLAT = "station run_onset onset detect end ongoing type var sensor severity unit label cause action explanation"
query(
    "i4_i12_incidents", lambda x: pick(x.incidents.withColumn("vars", F.array_join("vars", " ")), _FLAT + " vars", "magnitude confidence"),
    inc.sql(inc.DESCRIBED, f"SELECT {', '.join(chr(34) + c + chr(34) for c in _FLAT.split())}, array_to_string(vars, ' ') AS vars, {r6('magnitude confidence')} FROM described"),
)
query("i9_checks", lambda x: x.incidents.select("station", "run_onset", F.explode("checks").alias("c")).select("station", "run_onset", "c.*"), inc.sql(inc.DESCRIBED, inc.CHECKED))
query("i11_contributions", lambda x: x.incidents.select("station", "run_onset", F.explode("contributions").alias("c")).select("station", "run_onset", "c.*"), inc.sql(inc.DESCRIBED, inc.SHARED))
query("j10_corrected_value", lambda x: pick(x.incidents.select("station", "run_onset", F.explode("corrected").alias("c")).select("station", "run_onset", "c.*"), "station run_onset var", "observed corrected"), inc.sql(inc.DESCRIBED, f"SELECT station, run_onset, var, {r6('observed corrected')} FROM ({inc.CORRECTED})"))

# ------------------------------------------------------------------ events
_MOVES = 'mv AS (SELECT station, minute, T, P, RH, abs(T - lag(T) OVER (PARTITION BY station ORDER BY minute)) AS jump FROM masked), around AS (SELECT w.station, w.start, w."end" AS stop, m.minute - w.start AS rel, m.T, m.P, m.RH, m.jump FROM weather w JOIN mv m ON m.station = w.station AND m.minute >= w.start - 60 AND m.minute < w.start + 60)'
_MED = lambda v, a, b: f"quantile_cont(CASE WHEN rel >= {a} AND rel < {b} THEN {v} END, 0.5)"
_KIND = f"""{_MOVES}, agg AS (SELECT station, start, stop, {', '.join(f"{_MED(v, 0, 40)} - {_MED(v, -60, -5)} AS d{v}" for v in VARS)}, {_MED('RH', 0, 60)} AS rh, max(CASE WHEN rel >= 1 AND rel < 15 THEN jump END) AS jump FROM around GROUP BY station, start, stop)
SELECT station, start, stop AS "end", CASE WHEN dT >= 3 THEN 'Heatwave' WHEN dT <= -2.5 AND dRH >= 5 AND abs(dP) < 4 THEN CASE WHEN start > 0 AND stop > start + 1 AND jump > 0.3 THEN 'Thunderstorm outflow' ELSE 'Cold front' END
  WHEN dT <= -2.5 THEN 'Cold front' WHEN rh >= 95 AND dT <= 0 THEN 'Fog' ELSE 'Weather change' END AS kind, {r6('dT dP dRH')} FROM agg"""
query("i13_weather_kind", lambda x: pick(events.weather_kind(x.weather, x.masked), "station start end kind", "dT dP dRH"), build("weather", "").rstrip() + ", " + _KIND)
_AGREE = 'said AS (SELECT w.station, w.start, w."end" AS stop, e.nb, max(m.ts) AS top FROM weather w JOIN edges e ON e.station = w.station JOIN masked m ON m.station = e.nb AND m.minute >= w.start AND m.minute < w."end" GROUP BY ALL), yes AS (SELECT station, start, stop, sum(CASE WHEN top >= 0.7 THEN 1.0 ELSE 0.0 END) AS yes FROM said GROUP BY ALL), lst AS (SELECT station, count(*) AS n FROM edges GROUP BY station), agreed AS (SELECT w.station, w.start, w."end" AS stop, coalesce(y.yes, 0.0) / l.n AS neighbours_agree, coalesce(l.n, 0) AS n_neighbours FROM weather w LEFT JOIN yes y ON y.station = w.station AND y.start = w.start LEFT JOIN lst l ON l.station = w.station)'
_agreed = lambda x: events.neighbour_agreement(x.weather, x.edges, x.masked)
query("j15_neighbour_agreement", lambda x: pick(_agreed(x), "station start end n_neighbours", "neighbours_agree"), build("weather edges", "").rstrip() + f', {_AGREE} SELECT station, start, stop AS "end", n_neighbours, {r6("neighbours_agree")} FROM agreed')
_TEXT = f"CASE WHEN n_neighbours > 0 THEN {inc.fill(EVENT_TEXT['weather'], agree='CAST(round_even(neighbours_agree * n_neighbours, 0) AS BIGINT)', n='n_neighbours')} ELSE {inc.quoted(EVENT_TEXT['alone'])} END"
query("i14_event_confidence", lambda x: pick(events.describe_events(_agreed(x)), "station start end severity explanation", "confidence"), build("weather edges", "").rstrip() + f""", {_AGREE} SELECT station, start, stop AS "end", 'ok' AS severity, round(round_even(least(0.98, 0.72 + 0.25 * coalesce(neighbours_agree, 0.3)), 3) + 1.3e-8, 6) + 0.0 AS confidence, {_TEXT} AS explanation FROM agreed""")


def _union(x: Layers) -> DataFrame:
    faults = x.alerts.select("station", F.lit("fault").alias("type"), "onset", "detect", "end", "ongoing")
    weather = events.describe_events(events.neighbour_agreement(events.weather_kind(x.weather, x.masked), x.edges, x.masked))
    extremes = incidents.extreme_runs(x.masked, x.edges).withColumn("end", F.col("last") + 1)
    extremes = events.describe_events(events.neighbour_agreement(extremes, x.edges, x.masked, extreme=True), extreme=True)
    return events.union_all(faults, weather, extremes).select("kind", "station", "onset", "detect", "end")


query("u1_union_all", _union, build("weather edges", "").rstrip() + EXTREMES + " SELECT 'fault' AS kind, station, onset, detect, \"end\" FROM alerts UNION ALL SELECT 'event', station, start, start, \"end\" FROM weather UNION ALL SELECT 'event', station, start, detect, last + 1 FROM ext")

# ------------------------------------------------------------------ health
_BLOCKS = """ended AS (SELECT *, (SELECT max(minute) FROM expected) - minute AS back, least(72 * 60, (SELECT max(minute) - min(minute) + 1 FROM expected)) AS width FROM expected),
long AS (""" + each("SELECT station, minute, '@' AS var, dev_@ AS dev, CAST(floor(back / 60) AS BIGINT) AS block, floor(width / 60) AS whole FROM ended WHERE back < width", " UNION ALL ") + """),
enough AS (SELECT station, var FROM long GROUP BY ALL HAVING count(dev) > 120),
blocks AS (SELECT l.station, l.var, l.block, quantile_cont(dev, 0.5) AS median FROM long l JOIN enough e ON e.station = l.station AND e.var = l.var WHERE block < whole GROUP BY ALL)"""
_DRIFT = _BLOCKS + """, drifts AS (SELECT station, var, CASE WHEN count(median) >= 6 THEN quantile_cont(CASE WHEN block < 12 THEN median END, 0.5) END AS bias, CASE WHEN count(median) >= 24 THEN regr_slope(median, -block / 24.0) END AS s FROM blocks GROUP BY ALL),
drift AS (SELECT station, var, bias, CASE WHEN bias IS NOT NULL THEN s END AS drift FROM drifts)"""
query("a8_hourly_blocks", lambda x: pick(health.blocks(x.expected), "station var block", "median"), build("exp", "").rstrip() + f", {_BLOCKS} SELECT station, var, block, {r6('median')} FROM blocks")
query("a9_bias_and_drift", lambda x: pick(health.bias_and_drift(health.blocks(x.expected)), "station var", "bias drift"), build("exp", "").rstrip() + f", {_DRIFT} SELECT station, var, {r6('bias drift')} FROM drift")


def _faults(x: Layers) -> DataFrame:
    """Threshold alerts, on temperature and humidity."""
    return incidents.detect_runs(x.expected, qc.threshold_mask(), need=1, win=1).select("station", F.array(F.lit("T"), F.lit("RH")).alias("vars"), "onset", "end")


def _measured(x: Layers) -> DataFrame:
    from ..operators.profile import dsd_reference

    # the evidence has the history that both need: no other pass over the panel
    noise = health.noise_and_faults(x.expected, dsd_reference(x.expected), _faults(x))
    return noise.join(health.bias_and_drift(health.blocks(x.expected)), ["station", "var"], "left")


_NOISE = "hit AS (SELECT DISTINCT station, unnest(range(onset, \"end\")) AS minute FROM plainruns), recent AS (SELECT * FROM feat WHERE minute > (SELECT max(minute) FROM feat) - 1440), lng AS (" + each("SELECT station, minute, '@' AS var, dsd_@ AS dsd, (SELECT quantile_cont(dsd_@, 0.5) FROM feat) AS ref FROM recent", " UNION ALL ") + "), noise AS (SELECT l.station, l.var, quantile_cont(l.dsd, 0.5) / greatest(min(l.ref), 1e-6) AS noise, avg(CASE WHEN h.minute IS NOT NULL AND l.var <> 'P' THEN 1.0 ELSE 0.0 END) AS fault_share FROM lng l LEFT JOIN hit h ON h.station = l.station AND h.minute = l.minute GROUP BY ALL)"
query("a10_noise_and_faults", lambda x: pick(_measured(x), "station var", "noise fault_share"), build("limits", "").rstrip() + f", {_NOISE} SELECT station, var, {r6('noise fault_share')} FROM noise")
_TOL = "CASE var " + " ".join(f"WHEN '{v}' THEN {TOLERANCE[v]}" for v in VARS) + " END"
_HEALTH = f"""{_DRIFT}, {_NOISE}, m AS (SELECT n.*, d.bias, d.drift, {_TOL.replace('var ', 'n.var ')} AS tol FROM noise n LEFT JOIN drift d ON d.station = n.station AND d.var = n.var),
dy AS (SELECT *, CASE WHEN bias IS NOT NULL AND drift IS NOT NULL AND abs(drift) > 0.03 * tol AND sign(drift) = sign(CASE WHEN abs(bias) > 0.15 * tol THEN bias ELSE drift END) THEN greatest(0.0, (tol - abs(bias)) / abs(drift)) END AS days_to_limit FROM m),
sc AS (SELECT *, 100 - least(100.0, 60 * least(1.0, fault_share * 4) + 25 * least(1.0, abs(coalesce(bias, 0.0)) / tol) + 15 * least(1.0, greatest(0.0, coalesce(noise, 0.0) - 1.5) / 3) + CASE WHEN days_to_limit < 7 THEN 10 ELSE 0 END) AS raw_score FROM dy),
health AS (SELECT *, CAST(round_even(raw_score, 0) AS BIGINT) AS score, CASE WHEN raw_score >= 80 THEN 'ok' WHEN raw_score >= 55 THEN 'watch' ELSE 'degraded' END AS status FROM sc)"""
_health = lambda x: health.health_score(_measured(x))
query("a11_health_score", lambda x: pick(_health(x), "station var score status", "days_to_limit raw_score"), build("exp limits", "").rstrip() + f", {_HEALTH} SELECT station, var, score, status, {r6('days_to_limit raw_score')} FROM health")
query("a12_overall_health", lambda x: health.overall(_health(x)), build("exp limits", "").rstrip() + f", {_HEALTH} SELECT station, var, score, status FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score, CASE var WHEN 'T' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS r FROM health) WHERE r = 1")
_SENSOR, _UNIT, _LIMIT = inc.const(SENSORS, "var"), inc.const(UNITS, "var"), inc.const({v: f"{TOLERANCE[v]:g}" for v in VARS}, "var")
_NOTE = f"CASE WHEN days_to_limit < 30 THEN {inc.fill(NOTES['drift'], sensor=_SENSOR, rate=inc.fixed('abs(drift)', 2), unit=_UNIT, limit=_LIMIT, days=inc.fixed('days_to_limit', 1))} WHEN status <> 'ok' THEN {inc.fill(NOTES['weak'], sensor=_SENSOR, score='score')} END"
query(
    "a13_maintenance_notes", lambda x: health.maintenance_notes(_health(x)).select("station", F.explode("notes").alias("note")),
    build("exp limits", "").rstrip() + f", {_HEALTH}, nt AS (SELECT station, {_NOTE} AS note FROM health) SELECT station, note FROM nt WHERE note IS NOT NULL UNION ALL SELECT station, {inc.quoted(NOTES['none'])} FROM nt GROUP BY station HAVING count(note) = 0",
)
query(
    "i15_health_override", lambda x: health.override_by_alert(health.overall(_health(x)), x.alerts.where("ongoing").select("station", F.lit(0.9).alias("confidence"))),
    build("exp limits alerts", "").rstrip() + f", {_HEALTH}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score, CASE var WHEN 'T' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS r FROM health) WHERE r = 1), op AS (SELECT DISTINCT station FROM alerts WHERE ongoing), n AS (SELECT o.station, o.var, CASE WHEN op.station IS NULL THEN o.score ELSE least(o.score, 42) END AS score, o.status AS old, op.station IS NOT NULL AS hit FROM o LEFT JOIN op ON op.station = o.station) SELECT station, var, score, CASE WHEN NOT hit THEN old WHEN score >= 80 THEN 'ok' WHEN score >= 55 THEN 'watch' ELSE 'degraded' END AS status FROM n",
)

# ------------------------------------------------------------------ evaluation
_TRUTH = """isl AS (SELECT station, minute, anom, sum(fresh) OVER (PARTITION BY station ORDER BY minute) AS g FROM (SELECT station, minute, anom, CASE WHEN coalesce(anom <> lag(anom) OVER w OR minute - lag(minute) OVER w > 1, true) THEN 1 ELSE 0 END AS fresh FROM panel WINDOW w AS (PARTITION BY station ORDER BY minute))),
truth AS (SELECT station * 100000000 + min(minute) AS truth, station, min(anom) AS type, min(minute) AS start, max(minute) + 1 AS stop FROM isl WHERE anom <> '' GROUP BY station, g),
al AS (SELECT station * 100000000 + onset AS alert, station, CAST(floor(station / 7) AS BIGINT) AS city, onset, detect, "end" AS a_end, CASE WHEN "end" - onset > 20 THEN 'level_shift' ELSE 'spike' END AS found FROM plainruns),
ov AS (SELECT t.*, a.alert, a.onset, a.detect, a.a_end, a.found, least(a.a_end, t.stop + 20) - greatest(a.onset, t.start) AS over FROM truth t JOIN al a ON a.station = t.station AND a.onset <= t.stop + 20 AND a.a_end >= t.start),
mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY over DESC, alert) AS r FROM ov) WHERE r = 1)"""


def _alerts(x: Layers) -> DataFrame:
    runs = incidents.detect_runs(x.features, qc.threshold_mask(), need=1, win=1)
    found = F.when(F.col("end") - F.col("onset") > 20, "level_shift").otherwise("spike")
    return runs.select((F.col("station") * 100_000_000 + F.col("onset")).alias("alert"), "station", F.floor(F.col("station") / 7).alias("city"), "onset", "detect", "end", found.alias("found"))


def _truth(x: Layers) -> DataFrame:
    return evaluate.truth_faults(x.panel.select("station", "minute", "anom"))


def _truth_of(labels: DataFrame) -> DataFrame:
    return evaluate.truth_faults(labels).where(F.col("start") >= WARMUP)


def _events(panel: DataFrame) -> DataFrame:
    """Genuine weather: runs of wx by city."""
    rows = panel.where("wx = 1").select("city", "minute").distinct()
    return incidents.group_runs(rows.withColumnRenamed("city", "station"), F.lit(True), 10).select(F.col("station").alias("city"), "start", (F.col("last") + 1).alias("end"))


_EVENTS = "wxm AS (SELECT DISTINCT city, minute FROM panel WHERE wx = 1), wxs AS (SELECT *, sum(f) OVER (PARTITION BY city ORDER BY minute) AS g FROM (SELECT *, CASE WHEN coalesce(minute - lag(minute) OVER (PARTITION BY city ORDER BY minute) > 10, true) THEN 1 ELSE 0 END AS f FROM wxm)), wxe AS (SELECT city, min(minute) AS start, max(minute) + 1 AS stop FROM wxs GROUP BY city, g)"
_EVAL = build("limits", "").rstrip() + ", " + _TRUTH
query("g9_truth_faults", _truth, _EVAL + ' SELECT truth, station, type, start, stop AS "end" FROM truth')
query("j12_match_truth", lambda x: evaluate.match_truth(_truth(x), _alerts(x)).select("truth", "alert", "type", "found", "over"), _EVAL + " SELECT truth, alert, type, found, over FROM mt")
query("u4_false_alarms", lambda x: evaluate.false_alarms(_truth(x), _alerts(x)).select("alert", "station", "onset"), _EVAL + " SELECT alert, station, onset FROM al WHERE alert NOT IN (SELECT alert FROM ov)")
query("j13_events_hit", lambda x: evaluate.events_hit(_events(x.panel), _alerts(x)).select("city", "start", "end"), _EVAL + f', {_EVENTS} SELECT city, start, stop AS "end" FROM wxe WHERE start >= 300 AND EXISTS (SELECT 1 FROM al WHERE al.city = wxe.city AND al.onset < wxe.stop AND al.a_end > wxe.start)')
query("a15_recall_by_type", lambda x: pick(evaluate.recall_by_type(_truth(x), _alerts(x)), "type n", "recall"), _EVAL + " SELECT t.type, count(*) AS n, round(avg(CASE WHEN m.truth IS NULL THEN 0.0 ELSE 1.0 END) + 1.3e-8, 6) + 0.0 AS recall FROM truth t LEFT JOIN mt m ON m.truth = t.truth GROUP BY t.type")
query("a15_confusion", lambda x: evaluate.confusion(_truth(x), _alerts(x)), _EVAL + " SELECT type || '->' || found AS pair, count(*) AS n FROM mt WHERE type <> found GROUP BY 1")
query("s7_write_report", lambda x: tables.write_report(pick(evaluate.recall_by_type(_truth(x), _alerts(x)), "type n", "recall"), scratch_path(x.spark, "report")), SQL["a15_recall_by_type"])
_A14 = "recall precision f1 false_per_station_day kept_rate median_latency p90_latency cause_right"
query(
    "a14_detection_metrics", lambda x: pick(evaluate.detection_metrics(_truth(x), _alerts(x), _events(x.panel), x.stations, 4.0), "injected detected alerts false_alarms events flagged", _A14),
    _EVAL.replace("FROM plainruns)", "FROM plainruns WHERE detect >= 300)").replace("WHERE anom <> '' GROUP BY station, g)", "WHERE anom <> '' GROUP BY station, g HAVING min(minute) >= 300)")
    + f""", {_EVENTS}, fa AS (SELECT * FROM al WHERE alert NOT IN (SELECT alert FROM ov)), n AS (SELECT (SELECT count(*) FROM truth) AS injected, (SELECT count(*) FROM mt) AS detected, (SELECT count(*) FROM al) AS alerts, (SELECT count(*) FROM fa) AS false_alarms, (SELECT count(*) FROM wxe WHERE start >= 300) AS events,
  (SELECT count(*) FROM wxe WHERE start >= 300 AND EXISTS (SELECT 1 FROM fa WHERE fa.city = wxe.city AND fa.onset < wxe.stop AND fa.a_end > wxe.start)) AS flagged, (SELECT count(DISTINCT station) FROM panel) AS stations, (SELECT quantile_cont(greatest(0, detect - start), 0.5) FROM mt) AS median_latency, (SELECT quantile_cont(greatest(0, detect - start), 0.9) FROM mt) AS p90_latency, (SELECT avg(CASE WHEN type = found THEN 1.0 ELSE 0.0 END) FROM mt) AS cause_right),
rt AS (SELECT *, detected / greatest(1, injected) AS recall, (alerts - false_alarms) / greatest(1, alerts) AS precision FROM n), qt AS (SELECT *, 2 * precision * recall / greatest(1e-9, precision + recall) AS f1, false_alarms / (stations * 4.0) AS false_per_station_day, 1 - flagged / greatest(1, events) AS kept_rate FROM rt)
SELECT injected, detected, alerts, false_alarms, events, flagged, {r6(_A14)} FROM qt""",
)
query(
    "a16_auc_and_ap", lambda x: pick(evaluate.auc_and_ap(x.scored.select(F.round("prob", 4).alias("prob"), (F.col("anom") != "").alias("y"))), "", "auc ap"),
    build("hard", "").rstrip() + f""", gv AS (SELECT round(prob, 4) AS prob, sum(CASE WHEN anom <> '' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN anom = '' THEN 1 ELSE 0 END) AS neg FROM hard GROUP BY 1),
cv AS (SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS ap, sum(neg) OVER (ORDER BY prob DESC) AS an FROM gv), fv AS (SELECT sum(neg * (ap - pos / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos * ap / (ap + an)) / sum(pos) AS ap FROM cv) SELECT {r6('auc ap')} FROM fv""",
)


def _by_city(x: Layers) -> DataFrame:
    """Recall and counts of each city, as if it were a run of its type."""
    met = evaluate.match_truth(_truth(x), _alerts(x)).select("truth", F.lit(1.0).alias("hit"))
    runs = _truth(x).join(met, "truth", "left").groupBy(F.col("type").alias("name"), F.floor(F.col("station") / 7).alias("city"))
    return runs.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"), F.count("*").alias("injected"))


query("a17_summarise_runs", lambda x: pick(evaluate.summarise_runs(_by_city(x), ["recall"], ["injected"]), "name injected", "recall"), _EVAL + ", rr AS (SELECT t.type AS name, floor(t.station / 7) AS city, avg(CASE WHEN m.truth IS NULL THEN 0.0 ELSE 1.0 END) AS recall, count(*) AS injected FROM truth t LEFT JOIN mt m ON m.truth = t.truth GROUP BY 1, 2) SELECT name, CAST(sum(injected) AS BIGINT) AS injected, round(avg(recall) + 1.3e-8, 6) + 0.0 AS recall FROM rr GROUP BY name")
query(
    "a18_parity", lambda x: evaluate.parity(x.alerts, incidents.detect_runs(x.scored, F.col("prob") >= 0.7)),
    build("alerts", "").rstrip() + ", " + runs("slow", "hard", "prob >= 0.7") + " SELECT (SELECT count(DISTINCT (station, detect)) FROM alerts) AS batch, (SELECT count(DISTINCT (station, detect)) FROM slow) AS stream, (SELECT count(*) FROM (SELECT station, detect FROM alerts INTERSECT SELECT station, detect FROM slow)) AS identical",
)

# ------------------------------------------------------------------ boards


def _incidents(x: Layers) -> DataFrame:
    """Alerts with a severity and a confidence by their length."""
    n = F.col("end") - F.col("onset")
    return x.alerts.select("station", F.lit("fault").alias("kind"), "onset", "detect", "end", F.when(n > 20, "high").when(n > 3, "medium").otherwise("low").alias("severity"), (n / 100.0).alias("confidence"), F.concat(F.lit("length "), n.cast("string")).alias("label"))


_INC = """inc AS (SELECT station, 'fault' AS kind, onset, detect, "end" AS stop, CASE WHEN "end" - onset > 20 THEN 'high' WHEN "end" - onset > 3 THEN 'medium' ELSE 'low' END AS severity, ("end" - onset) / 100.0 AS confidence, 'length ' || ("end" - onset) AS label FROM alerts),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY confidence DESC, detect, label) AS r FROM inc WHERE detect >= 400 - 60 AND stop > 400) WHERE r = 1),
board AS (SELECT s.station, CASE WHEN t.station IS NULL THEN 'ok' ELSE t.severity END AS status, t.label, t.detect FROM stations s LEFT JOIN top t ON t.station = s.station)"""
_board = lambda x: board.status_board(x.stations, _incidents(x), 400)
query("t1_alert_feed", lambda x: board.alert_feed(_incidents(x)).select("station", "detect", "onset", "severity"), build("alerts", "").rstrip() + f", {_INC.split('top AS')[0].rstrip().rstrip(',')} SELECT station, detect, onset, severity FROM inc ORDER BY detect, station, onset LIMIT 25")
query("t2_status_board", lambda x: _board(x).select("station", "status", "label", "detect"), build("alerts stations", "").rstrip() + f", {_INC} SELECT station, status, label, detect FROM board")
query("t3_work_queue", lambda x: board.work_queue(_board(x)).select("station", "status", "rank", "headline"), build("alerts stations", "").rstrip() + f", {_INC} SELECT station, status, CAST(CASE WHEN status = 'high' THEN 0 WHEN status IN ('medium', 'low') THEN 1 WHEN status = 'event' THEN 2 ELSE 3 END AS BIGINT) AS rank, coalesce(label, 'All sensors normal') AS headline FROM board")
query("a19_status_counts", lambda x: board.status_counts(_board(x)), build("alerts stations", "").rstrip() + f", {_INC} SELECT CASE WHEN status IN ('high', 'medium', 'low') THEN 'alert' ELSE status END AS status, count(*) AS n FROM board GROUP BY 1")

# ------------------------------------------------------------------ labelled injection: a plan with one fault a station
_PLAN = """SELECT station, CASE CAST(station % 5 AS INT) WHEN 0 THEN 'spike' WHEN 1 THEN 'level_shift' WHEN 2 THEN 'drift' WHEN 3 THEN 'stuck' ELSE 'comm_error' END AS kind,
  CASE CAST(station % 3 AS INT) WHEN 0 THEN 'T' WHEN 1 THEN 'P' ELSE 'RH' END AS var, CAST(60 + station AS BIGINT) AS start, CAST(160 + station AS BIGINT) AS "end", CASE WHEN station % 2 = 0 THEN 1 ELSE -1 END AS sign, CAST(6.0 AS DOUBLE) AS mag, CASE WHEN station % 2 = 0 THEN 'sentinel' ELSE 'dropout' END AS form FROM """


def _plan(x: Layers, *kinds: str) -> DataFrame:
    return x.spark.sql(_PLAN.replace('"end"', "end") + "{s}", s=x.stations).where(F.col("kind").isin(*kinds))


def _rule(v: str) -> str:
    sent = {"T": "-99.9", "P": "0.0", "RH": "-99.9"}[v]
    return f"""round(CASE WHEN q.var = '{v}' AND q.kind = 'spike' THEN {v}_raw + q.sign * q.mag WHEN q.var = '{v}' AND q.kind = 'level_shift' THEN {v}_raw + q.sign * q.mag * least(1.0, (p.minute - q.start + 1) / 2.0)
  WHEN q.var = '{v}' AND q.kind = 'drift' THEN {v}_raw + q.sign * q.mag * (p.minute - q.start + 1) / 100 WHEN q.var = '{v}' AND q.kind = 'stuck' THEN coalesce((SELECT z.{v}_raw FROM panel z WHERE z.station = p.station AND z.minute = q.start - 1), {v}_raw)
  WHEN q.kind = 'comm_error' THEN CASE WHEN q.form = 'sentinel' THEN {sent} END ELSE {v}_raw END + 1.3e-8, 6) + 0.0 AS {v}_raw"""


for _name, _kind in (("g1_spike", "spike"), ("g2_level_shift", "level_shift"), ("g3_drift", "drift"), ("g4_stuck", "stuck"), ("g6_comm_error", "comm_error")):
    query(
        _name, lambda x, k=_kind: pick(inject.inject(x.panel, _plan(x, k)), KEY + "anom", "T_raw P_raw RH_raw"),
        build("panel stations", "").rstrip() + f""", q AS (SELECT * FROM ({_PLAN} stations) WHERE kind = '{_kind}') SELECT p.station, p.minute, coalesce(q.kind, '') AS anom, {', '.join(_rule(v) for v in VARS)} FROM panel p LEFT JOIN q ON q.station = p.station AND p.minute >= q.start AND p.minute < q."end" """,
    )
_DRAW = lambda seed: f"((CAST('0x' || substr(md5(CAST(p.station AS VARCHAR) || '-' || CAST(p.minute AS VARCHAR) || '-{seed}'), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)!r})"


def _shaken(k: int, v: str) -> str:
    low, high = inject.GLITCH[v]
    burst = f"q.mag * (sqrt(-2 * ln({_DRAW(47 + 2 * k)})) * cos(2 * pi() * {_DRAW(48 + 2 * k)}))"
    jump = f"CASE WHEN {_DRAW(27 + k)} < 0.5 THEN -1 ELSE 1 END * ({low} + {_DRAW(37 + k)} * {high - low}) * 0.8"
    return f"round(CASE WHEN q.kind = 'noise_burst' AND q.var = '{v}' THEN {v}_raw + {burst} WHEN q.kind = 'power_glitch' AND ({_DRAW(17)} < 0.35 OR p.minute = q.start) THEN {v}_raw + {jump} ELSE {v}_raw END + 1.3e-8, 6) + 0.0 AS {v}_raw"


query(
    "g5_g7_random_faults", lambda x: pick(inject.inject(x.panel, _plan(x, "spike", "drift").withColumn("kind", F.when(F.col("kind") == "spike", "noise_burst").otherwise("power_glitch"))), KEY + "anom", "T_raw P_raw RH_raw"),
    build("panel stations", "").rstrip() + f""", q AS (SELECT * REPLACE (CASE WHEN kind = 'spike' THEN 'noise_burst' ELSE 'power_glitch' END AS kind) FROM ({_PLAN} stations) WHERE kind IN ('spike', 'drift'))
  SELECT p.station, p.minute, coalesce(q.kind, '') AS anom, {', '.join(_shaken(k, v) for k, v in enumerate(VARS))} FROM panel p LEFT JOIN q ON q.station = p.station AND p.minute >= q.start AND p.minute < q."end" """,
)
query(
    "g8_degradation", lambda x: pick(inject.degrade(x.panel, x.stations.select("station", F.when(F.col("station") % 2 == 0, "T").otherwise("RH").alias("var"), F.lit(0.4).alias("rate"))), KEY, "T_raw P_raw RH_raw"),
    build("panel", "SELECT station, minute, round(CASE WHEN station % 2 = 0 THEN T_raw + 0.4 * (minute / 1440.0) ELSE T_raw END + 1.3e-8, 6) + 0.0 AS T_raw, round(P_raw + 1.3e-8, 6) + 0.0 AS P_raw, round(CASE WHEN station % 2 = 1 AND RH_raw IS NOT NULL THEN least(100.0, greatest(1.0, RH_raw * (1 + 0.4 / 100.0 * (minute / 1440.0)))) ELSE RH_raw END + 1.3e-8, 6) + 0.0 AS RH_raw FROM panel"),
)



def _share(draw: str, shares: dict[str, float]) -> str:
    upto, text = 0.0, ""
    for name in list(shares)[:-1]:
        upto = round(upto + shares[name], 6)
        text += f" WHEN {draw} < {upto} THEN '{name}'"
    return f"CASE{text} ELSE '{list(shares)[-1]}' END"


_U = lambda k: _DRAW(2000 + k).replace("p.minute", "p.slot")
_SIZES = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{v}' AS var, {subtle} AS subtle, CAST({sizes[inject.SIZED[kind]][v][0]} AS DOUBLE) AS low, CAST({sizes[inject.SIZED[kind]][v][1]} AS DOUBLE) AS high"
    for kind in inject.SIZED for v in VARS for subtle, sizes in (("false", inject.GROSS), ("true", inject.SUBTLE))
)
_LENGTHS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {a} AS least, {b} AS most" for kind, (a, b) in inject.LENGTHS.items())
query(
    "g10_random_plan", lambda x: pick(inject.random_plan(x.clean, seed=2), "station kind var start end sign form", "mag"),
    f"""WITH {CLEAN}, sizes AS ({_SIZES}), lens AS ({_LENGTHS}), spans AS (SELECT station, max(minute) + 1 - 20 AS last FROM clean GROUP BY station), slots AS (SELECT station, last, unnest(range(CAST(floor((last - 1 - 300) / 690) AS BIGINT) + 1)) AS slot FROM spans WHERE last > 300),
rooms AS (SELECT *, 300 + slot * 690 AS first, least(690, last - (300 + slot * 690)) - 90 AS room FROM slots), kinds AS (SELECT p.*, {_share(_U(1), inject.SHARES)} AS kind, {_share(_U(2), inject.VAR_SHARES)} AS var, {_U(3)} < 0.5 AS subtle FROM rooms p WHERE room >= 30),
sized AS (SELECT p.*, z.low, z.high, CAST(least(room, least + floor({_U(4)} * (most - least))) AS BIGINT) AS length FROM kinds p JOIN lens USING (kind) LEFT JOIN sizes z ON z.kind = p.kind AND z.var = p.var AND z.subtle = p.subtle),
begun AS (SELECT p.*, CAST(first + floor({_U(5)} * (room - length + 1)) AS BIGINT) AS start FROM sized p)
SELECT station, kind, CASE WHEN kind IN ('comm_error', 'power_glitch') OR kind = 'stuck' AND subtle THEN 'all' ELSE var END AS var, start, start + length AS "end", CASE WHEN {_U(6)} < 0.5 THEN -1 ELSE 1 END AS sign,
  CASE WHEN {_U(8)} < 0.5 THEN 'dropout' ELSE 'sentinel' END AS form, round(low + {_U(7)} * (high - low) + 1.3e-8, 6) + 0.0 AS mag FROM begun p""",
)

# ------------------------------------------------------------------ learned models
_W14 = """i1 AS (SELECT station, minute, anom, row_number() OVER w - 1 AS rn, lag(anom) OVER w AS before, CASE WHEN coalesce(anom <> lag(anom) OVER w, true) THEN 1 ELSE 0 END AS fresh FROM panel WINDOW w AS (PARTITION BY station ORDER BY minute)),
i2 AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY minute) AS g, max(CASE WHEN fresh = 1 AND before <> '' THEN rn END) OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ended FROM i1),
i3 AS (SELECT *, row_number() OVER (PARTITION BY station, g ORDER BY minute) - 1 AS pos, count(*) OVER (PARTITION BY station, g) AS n FROM i2),
weights AS (SELECT station, minute, anom, CASE WHEN rn < 300 OR (anom = 'drift' AND pos < floor(n / 3)) OR ended IS NOT NULL THEN 0.0 ELSE 1.0 END AS weight FROM i3)"""
query("w14_training_weights", lambda x: pick(fusion.training_weights(x.panel.select("station", "minute", "anom")), KEY + "anom", "weight"), build("panel", "").rstrip() + f", {_W14} SELECT station, minute, anom, round(CAST(weight AS DOUBLE) + 1.3e-8, 6) + 0.0 AS weight FROM weights")


def _training(x: Layers) -> DataFrame:
    rows = x.scored.join(fusion.training_weights(x.panel.select("station", "minute", "anom")).select("station", "minute", "weight"), ["station", "minute"])
    return fusion.training_rows(rows.withColumns({"ts_if": F.col("ts"), "ts_ae": F.col("ts")}))


query(
    "u2_training_rows", lambda x: pick(_training(x).groupBy("label", F.round("f_has_nb", 6).alias("f_has_nb")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "n", "label f_has_nb weight"),
    build("hard", "").rstrip() + f""", {_W14}, u AS (SELECT CASE WHEN h.anom <> '' THEN 1.0 ELSE 0.0 END AS label, CASE WHEN h.has_nb THEN 1.0 ELSE 0.0 END AS f_has_nb, w.weight FROM hard h JOIN weights w ON w.station = h.station AND w.minute = h.minute),
bu AS (SELECT * FROM u UNION ALL SELECT label, 0.0, weight * 0.35 FROM u), cu AS (SELECT CAST(label AS DOUBLE) AS label, CAST(f_has_nb AS DOUBLE) AS f_has_nb, count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN weight * 3 ELSE weight END) AS DOUBLE) AS weight FROM bu WHERE weight > 0 GROUP BY 1, 2) SELECT n, {r6('label f_has_nb weight')} FROM cu""",
)
query("m1_sample_rows", lambda x: models.sample_rows(features.feature_vector(x.features)).select("station", "minute"), build("feat", "").rstrip() + VECTOR_SQL + " SELECT station, minute FROM vec WHERE complete ORDER BY md5(CAST(station AS VARCHAR) || '-' || CAST(minute AS VARCHAR) || '-0'), station, minute LIMIT 70000")
query("m2_m3_anomaly_scores", lambda x: models.anomaly_scores(x.vector, x.anomaly).select("station", "minute", "ts_if", "ts_ae", "ts"))
query("m4_temporal_score", lambda x: models.anomaly_scores(x.vector, x.anomaly).select("station", "minute", "ts"))
query("a4_score_reference", lambda x: models.score_reference(x.vector, x.anomaly))


def _quiet(x: Layers) -> DataFrame:
    return x.panel.withColumns({f"{v}_raw": F.when(F.col("anom") == "", F.col(f"{v}_raw")) for v in VARS})


def _model(x: Layers) -> fusion.QualityModel:
    return fusion.QualityModel.fit(_quiet(x), x.stations).calibrate(x.panel)


query("m5_m6_score", lambda x: _model(x).score(x.panel).select("station", "minute", "p_model", "hard", "instant", "prob"))
query("m8_without_neighbours", lambda x: pick(spatial_z(residuals(neighbour_support(x.anomalies, x.edges.where("false"))), x.spatial), KEY + "nn has_nb", "nb_ts zL_T"), build("feat", "SELECT station, minute, CAST(0 AS BIGINT) AS nn, false AS has_nb, round(0.0 + 1.3e-8, 6) + 0.0 AS nb_ts, CAST(NULL AS DOUBLE) AS zL_T FROM feat"))

def _all_methods(x: Layers, scored: DataFrame, edges: DataFrame, cities: DataFrame) -> dict[str, DataFrame]:
    """Alerts by method; stored, since every measure reads them again."""
    full = evaluate.named_alerts(incidents.incidents(scored, edges), cities, F.col("type"))
    found = {k: evaluate.named_alerts(r, cities, F.lit("?")) for k, r in evaluate.baseline_runs(scored).items()} | {"full": full}
    return {k: x._stored("found", r) for k, r in found.items()}


def _end_to_end(x: Layers) -> DataFrame:
    """Fit, inject, score and match: what each method finds of faults that the model has not seen."""
    return evaluate.end_to_end(x.judged, x.trial, x._stored("wx", _events(x.clean)), x.stations, _all_methods(x, x.judged, x.judge.edges, x.stations))


def _no_neighbours(x: Layers) -> DataFrame:
    """The same faults, scored as if no station had a neighbour."""
    none = x.judge.edges.where("false")
    scored = x._stored("alone", x.judge.score(x.trial, none))
    return evaluate.end_to_end(scored, x.trial, x._stored("wx", _events(x.clean)), x.stations, {"full": _all_methods(x, scored, none, x.stations)["full"]})


def _other_network(x: Layers) -> DataFrame:
    """The fusion of one network on another, of which only a clean history is known."""
    clean, places = fixtures.highland(x.spark, x.sf)
    clean, places = x._stored("highland", clean), x._stored("places", places)
    other = fusion.QualityModel.fit(clean, places).reuse_fusion(x.judge)
    trial = x._stored("trial", inject.inject(clean, inject.random_plan(clean, seed=3), seed=300))
    scored = x._stored("judged", other.score(trial))
    return evaluate.end_to_end(scored, trial, x._stored("wx", _events(clean)), places, _all_methods(x, scored, other.edges, places))


query("a14_end_to_end", _end_to_end)
query("a15_end_to_end_by_type", lambda x: evaluate.recall_by_type(_truth_of(x.trial), _all_methods(x, x.judged, x.judge.edges, x.stations)["full"]))
query("m7_other_network", _other_network)
query("m8_score_without_neighbours", _no_neighbours)
query("r6_edge_qc", lambda x: edge_qc(x.panel))
