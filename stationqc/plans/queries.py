"""One query an operator, over the whole derived panel, beside its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import VARS
from ..functions import physics, text
from ..operators import features, incidents, neighbours, profile, qc
from .layers import Layers, layers
from .oracle import CTES, build, each, r6

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[Layers], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(layers(spark, sf_dir))
    if sql:
        SQL[name] = sql


def pick(df: DataFrame, plain: str, doubles: str = "") -> DataFrame:
    return df.select(*plain.split(), *[(F.round(F.col(c) + 1.3e-8, 6) + 0.0).alias(c) for c in doubles.split()])


def table(name: str, run, plain: str, doubles: str, last: str, source: str, where: str = "") -> None:
    """A query that shows columns of a layer."""
    shown = ", ".join([*['"end"' if c == "end" else c for c in plain.split()], *([r6(doubles)] if doubles else [])])
    query(name, lambda layer: pick(run(layer), plain, doubles), build(last, f"SELECT {shown} FROM {source} {where}"))


KEY = "station minute "
of = lambda stem: " ".join(f"{s}_{v}" for s in stem.split() for v in VARS)

# row-wise checks
table("p1_flag_missing", lambda x: qc.flag_missing(x.panel), KEY + "comm", "", "comm", "commed")
table("p2_flag_range", lambda x: qc.flag_range(qc.flag_missing(x.panel)), KEY + of("rng"), "", "chk", "chk")
table("p3_clean_values", lambda x: qc.clean_values(x.panel), KEY, "T P RH", "chk", "chk")
table("p4_tail", lambda x: qc.tail(x.panel, 90), KEY, "T_raw P_raw RH_raw", "panel", "panel", "WHERE minute > (SELECT max(minute) FROM panel) - 90")
table("p5_anomaly_from_climate", lambda x: x.anomalies, KEY, of("A"), "anomaly", "anomaly")
table("s5_canonical_observations", lambda x: x.panel, KEY + "city anom", "T_raw P_raw RH_raw", "panel", "panel")

# history of one station
table("w1_d1", lambda x: x.features, KEY, of("d1"), "feat", "feat")
table("w2_d5", lambda x: x.features, KEY, of("d5"), "feat", "feat")
table("w3_innov", lambda x: x.features, KEY, of("innov"), "feat", "feat")
table("w4_dsd", lambda x: x.features, KEY, of("dsd"), "feat", "feat")
table("w5_run", lambda x: x.features, KEY + of("run"), "", "feat", "feat")
table("w6_dew_point_change", lambda x: x.features, KEY, "td td_innov td_d1", "feat", "feat")
table("w7_step_stuck", lambda x: x.features, KEY + of("step stuck") + " step_any stuck_any", "", "feat", "feat")
table("w8_physics_and_spread", lambda x: x.features, KEY, "ph dsd_max", "feat", "feat")
table("w16_cut_history", lambda x: features.features(x.checked, x.climate, part=480), KEY + of("run stuck"), of("d1 innov dsd"), "feat", "feat")
table("w9_recently_flagged", lambda x: x.scored.withColumn("excluded", features.recently(F.col("prob") >= 0.5)), KEY + "excluded", "", "excl", "excl")
table("w15_hour_interp", lambda x: features.with_climate(x.checked, x.climate), KEY, of("cl"), "cl", "cl")

_LRUN = each("ln(1 + run_@) AS lrun_@")
_FULL = " AND ".join(f"{c} IS NOT NULL" for c in features.VECTOR)
VECTOR_SQL = f", vec AS (SELECT *, {_FULL} AS complete FROM (SELECT *, {_LRUN} FROM feat))"
query("p7_feature_vector", lambda x: pick(features.feature_vector(x.features), KEY + "complete", " ".join(features.VECTOR)), build("feat", "").rstrip() + VECTOR_SQL + f" SELECT station, minute, complete, {r6(' '.join(features.VECTOR))} FROM vec")
_Q3 = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in features.VECTOR)
_SCALE = (
    VECTOR_SQL + f", q3 AS (SELECT {_Q3} FROM vec WHERE complete), q9 AS (SELECT " + ", ".join(f"quantile_cont(abs({c} - m_{c}), 0.9) AS n_{c}" for c in features.VECTOR) + " FROM vec, q3 WHERE complete), scale AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS med, greatest(b_{c} - a_{c}, n_{c} * 0.5 + 1e-3) AS iqr FROM q3, q9" for c in features.VECTOR) + ")"
)
query("a3_feature_scale", lambda x: pick(profile.feature_scale(x.vector), "feature", "med iqr"), build("feat", "").rstrip() + _SCALE + f" SELECT feature, {r6('med iqr')} FROM scale")
query("a3_bounded_scale", lambda x: pick(profile.feature_scale(x.vector, most=10_000), "feature", "med iqr"), build("feat", "").rstrip() + _SCALE + f" SELECT feature, {r6('med iqr')} FROM scale")


def _scaled(x: Layers) -> DataFrame:
    return pick(profile.robust_scale(x.vector, profile.read_scale(x.vector)), KEY, " ".join(features.VECTOR))


query(
    "p6_robust_scale", _scaled,
    build("feat", "").rstrip() + _SCALE + ", wide AS (SELECT " + ", ".join(f"max(CASE WHEN feature = '{c}' THEN med END) AS m_{c}, max(CASE WHEN feature = '{c}' THEN iqr END) AS i_{c}" for c in features.VECTOR)
    + " FROM scale) SELECT station, minute, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(-40.0, least(40.0, ({c} - m_{c}) / i_{c})) END + 1.3e-8, 6) + 0.0 AS {c}" for c in features.VECTOR) + " FROM vec, wide",
)

# learned profiles
table("a1_climatology", lambda x: profile.climatology(x.checked), "station hour", "T P RH", "clim", "clim")
query("a2_dsd_reference", lambda x: pick(profile.dsd_reference(x.features), "", of("dsd_ref")), build("feat", "SELECT " + each("round(quantile_cont(dsd_@, 0.5) + 1.3e-8, 6) + 0.0 AS dsd_ref_@") + " FROM feat"))
query("a2_bounded_reference", lambda x: pick(profile.dsd_reference(x.features, most=10_000), "", of("dsd_ref")), build("feat", "SELECT " + each("round(quantile_cont(dsd_@, 0.5) + 1.3e-8, 6) + 0.0 AS dsd_ref_@") + " FROM feat"))
query(
    "a5_spatial_offsets",
    lambda x: pick(profile.spatial_tables(x.residuals).select("station", "n_T", "n_P", "n_RH", F.posexplode(F.arrays_zip(*[f"off_{v}" for v in VARS])).alias("hour", "o")).select("station", "hour", "n_T", "n_P", "n_RH", "o.*"), "station hour n_T n_P n_RH", of("off")),
    build("offs", f"SELECT station, hour, n_T, n_P, n_RH, {r6(of('off'))} FROM offs"),
)
table("a6_spatial_sigma", lambda x: x.spatial, "station", of("sig sigI"), "sigma", "sigma")

# neighbours
table("j1_build_neighbours", lambda x: x.edges, "station nb rank listed", "km", "edges", "edges")
table("t4_nearest_neighbours", lambda x: neighbours.build_neighbours(x.stations, k=3), "station nb rank", "km", "edges", "edges", "WHERE rank <= 3")
table("j2_neighbour_median", lambda x: x.residuals, KEY + "nn", of("med medI"), "res", "res")
table("j3_neighbour_spread", lambda x: x.residuals, KEY, of("spread"), "res", "res")
table("j4_spatial_residuals", lambda x: x.residuals, KEY, of("res resI"), "res", "res")
table("j5_spatial_z", lambda x: x.z, KEY, of("zL zI"), "z", "z")
table("j6_neighbour_support", lambda x: x.residuals, KEY + "nn has_nb", "nb_ts", "res", "res")
table("j7_exclude_flagged", lambda x: x.second, KEY + "excluded nn has_nb", "nb_ts " + of("zL zI"), "second", "second_z")
# Each step once: a planner that puts the steps in line would repeat both passes of the neighbours many times over.
SQL["j7_exclude_flagged"] = re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", SQL["j7_exclude_flagged"])
table("j8_expected_series", lambda x: x.expected, KEY, of("exp"), "exp", "expected")
table("j9_expected_band", lambda x: x.expected, KEY, of("exp_lo exp_hi"), "exp", "expected")
table("p11_deviation_native", lambda x: x.expected, KEY, of("dev"), "exp", "expected")

_ZERO = lambda c, top: f"CASE WHEN has_nb THEN least(coalesce(abs({c}), 0.0), {top}) ELSE 0.0 END"
_FUSION = {
    "f_if": "least(ts, 8.0)", "f_ae": "least(ts, 8.0)", "f_bad": "CASE WHEN comm OR rng_T OR rng_P OR rng_RH THEN 1.0 ELSE 0.0 END", "f_stuck": "CASE WHEN stuck_any THEN 1.0 ELSE 0.0 END", "f_step": "CASE WHEN step_any THEN 1.0 ELSE 0.0 END",
    "f_ph": "least(ph, 6.0)", "f_dsd": "least(dsd_max, 30.0)", **{f"f_{z.lower()}_{v}": _ZERO(f"{z}_{v}", "40.0") for z in ("zL", "zI") for v in VARS}, "f_has_nb": "CASE WHEN has_nb THEN 1.0 ELSE 0.0 END", "f_nb_ts": _ZERO("nb_ts", "8.0"),
}
query(
    "p8_fusion_features",
    lambda x: pick(features.fusion_features(x.scored.withColumns({"ts_if": F.col("ts"), "ts_ae": F.col("ts")})), KEY, " ".join(features.FUSION)),
    build("hard", "SELECT station, minute, " + ", ".join(f"round(CAST({v} AS DOUBLE) + 1.3e-8, 6) + 0.0 AS {k}" for k, v in _FUSION.items()) + " FROM hard"),
)
table("p9_hard_and_instant", lambda x: x.scored, KEY + "hard instant", "p_model prob", "hard", "hard")
query("p10_baseline_masks", lambda x: x.features.select("station", "minute", qc.threshold_mask().alias("threshold_mask"), qc.temporal_mask().alias("temporal_mask")), build("limits", "SELECT station, minute, bad AS threshold_mask, ts >= 1 AS temporal_mask FROM limits"))

# sessions
RUN = "station onset detect end ongoing"
table("w10_detect_runs", lambda x: x.alerts, RUN, "", "alerts", "alerts")
table("w10_cut_detect_runs", lambda x: incidents.detect_runs(x.scored, F.col("prob") >= 0.7, F.col("instant"), part=1440), RUN, "", "alerts", "alerts")
table("w10_threshold_runs", lambda x: incidents.detect_runs(x.features, qc.threshold_mask(), need=1, win=1), RUN, "", "limits", "plainruns")
table("w11_group_runs", lambda x: incidents.group_runs(x.panel, F.col("anom") != "", 10), "station start last", "", "panel", "(SELECT station, min(minute) AS start, max(minute) AS last FROM (SELECT station, minute, sum(fresh) OVER (PARTITION BY station ORDER BY minute) AS g FROM (SELECT station, minute, CASE WHEN coalesce(minute - lag(minute) OVER (PARTITION BY station ORDER BY minute) > 10, true) THEN 1 ELSE 0 END AS fresh FROM panel WHERE anom <> '')) GROUP BY station, g)")
table("w12_weather_runs", lambda x: x.weather, "station start end", "", "weather", "weather")
table("w12_cut_weather_runs", lambda x: incidents.weather_runs(x.masked, 1440), "station start end", "", "weather", "weather")
EXTREMES = """, ext_m AS (SELECT station, minute, coalesce(A_T, 0.0) AS a, lag(minute) OVER (PARTITION BY station ORDER BY minute) AS p FROM masked WHERE abs(A_T) >= 4 AND NOT in_fault AND station IN (SELECT station FROM edges)),
ext_s AS (SELECT *, sum(CASE WHEN coalesce(minute - p > 10, true) THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY minute) AS g FROM ext_m),
ext_r AS (SELECT station, min(minute) AS start, max(minute) AS last FROM ext_s GROUP BY station, g HAVING max(minute) - min(minute) >= 30),
ext AS (SELECT r.station, r.start, r.last, r.start + 30 AS detect, avg(coalesce(m.A_T, 0.0)) AS mean, r.last >= (SELECT max(minute) FROM masked) - 1 AS ongoing FROM ext_r r JOIN masked m ON m.station = r.station AND m.minute BETWEEN r.start AND r.last GROUP BY r.station, r.start, r.last)"""
query("w13_extreme_runs", lambda x: pick(incidents.extreme_runs(x.masked, x.edges), "station start last detect kind ongoing", "mean"), build("masked", "").rstrip() + EXTREMES + " SELECT station, start, last, detect, CASE WHEN mean > 0 THEN 'Heatwave' ELSE 'Cold spell' END AS kind, ongoing, round(mean + 1.3e-8, 6) + 0.0 AS mean FROM ext")
table("j14_fault_minutes", lambda x: x.masked, KEY + "in_fault", "", "masked", "masked")

# scalar functions
_BOTH = "round({0}, 6) + 0.0 AS {1}"
query(
    "f1_saturation_vapour_pressure", lambda x: x.checked.select("station", "minute", (F.round(physics.sat_vp(F.col("T")), 6) + 0.0).alias("es")),
    build("chk", "SELECT station, minute, " + _BOTH.format("6.112 * exp(17.67 * T / (T + 243.5))", "es") + " FROM chk"),
)
query(
    "f2_vapour_pressure", lambda x: x.checked.select("station", "minute", (F.round(physics.vapour_pressure(F.col("T"), F.col("RH")), 6) + 0.0).alias("e")),
    build("chk", "SELECT station, minute, " + _BOTH.format("RH / 100.0 * 6.112 * exp(17.67 * T / (T + 243.5))", "e") + " FROM chk"),
)
table("f3_dewpoint", lambda x: x.checked.withColumn("td", physics.dewpoint(F.col("T"), F.col("RH"))), KEY, "td", "dew", "dew")
query(
    "f4_rh_from_dew", lambda x: x.features.select("station", "minute", (F.round(physics.rh_from_dew(F.col("T"), F.col("td") - 2), 6) + 0.0).alias("rh")),
    build("dew", "SELECT station, minute, " + _BOTH.format("CASE WHEN td IS NOT NULL THEN least(100.0, greatest(0.0, 100.0 * exp(17.67 * (td - 2) / (td - 2 + 243.5)) / exp(17.67 * T / (T + 243.5)))) END", "rh") + " FROM dew"),
)
query("f5_station_pressure", lambda x: x.stations.select("station", (F.round(physics.station_pressure(F.col("elev")), 6) + 0.0).alias("p0")), build("stations", "SELECT station, " + _BOTH.format("1013.25 * pow(1 - 2.25577e-5 * elev, 5.25588)", "p0") + " FROM stations"))
query(
    "f6_haversine_km", lambda x: x.stations.select("station", (F.round(physics.haversine_km(F.col("lon"), F.col("lat"), F.lit(77.2), F.lit(28.6)), 6) + 0.0).alias("km")),
    build("stations", "SELECT station, " + _BOTH.format("2 * 6371.0 * asin(sqrt(pow(sin(radians(28.6 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(28.6)) * pow(sin(radians(77.2 - lon) / 2), 2)))", "km") + " FROM stations"),
)
_SIGN = lambda x, plus: f"CASE WHEN {x} < 0 THEN '−' ELSE '{plus}' END || printf('%.1f', round_even(abs({x}), 1))"
query("f7_signed_text", lambda x: x.panel.select("station", "minute", text.plain(F.col("T_raw")).alias("plain"), text.signed(F.col("RH_raw") - 60).alias("signed")), build("panel", f"SELECT station, minute, {_SIGN('T_raw', '')} AS plain, {_SIGN('(RH_raw - 60)', '+')} AS signed FROM panel"))
query(
    "f8_fraction_hour", lambda x: x.spark.read.parquet(f"{x.sf}/events.parquet").select("event_id", (F.round(physics.fraction_hour(F.col("ts")), 6) + 0.0).alias("hour")),
    "SELECT event_id, round(hour(ts) + minute(ts) / 60.0, 6) + 0.0 AS hour FROM events",
)
assert CTES
