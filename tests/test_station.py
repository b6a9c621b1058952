import math
import random
import re
import time
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stationqc.functions import text
from stationqc.operators import evaluate, evidence, features, incidents, inject, models, neighbours, profile, qc
from stationqc.plans import incident_sql
from stationqc.plans.layers import CLEANED, Layers
from stationqc.sources import tables
from stationqc.streaming import edge


def panel(spark, series, station="a"):
    rows = [(station, m, *[None if v is None else float(v) for v in r]) for m, r in enumerate(series)]
    return spark.createDataFrame(rows, "station string, minute long, T_raw double, P_raw double, RH_raw double")


def test_row_checks(spark):
    rows = panel(spark, [(20, 1000, 50), (None, 1000, 50), (float("nan"), 1000, 50), (-99.9, 0, -99.9), (60, 1000, 50), (20, 1000, 130), (50, 1080, 100)])
    got = {r.minute: r for r in qc.checked(rows).collect()}
    assert [got[m].comm for m in range(7)] == [False, True, True, True, False, False, False]
    assert got[4].rng_T and got[4].T is None and got[4].P == 1000
    assert got[5].rng_RH and got[5].RH is None
    assert not (got[3].rng_T or got[6].rng_T or got[6].rng_P or got[6].rng_RH) and got[3].T is None
    assert got[1].T is None and got[1].P == 1000


def test_features_against_pandas(spark):
    rng = np.random.default_rng(1)
    t = np.round(25 + rng.normal(0, 0.3, 120).cumsum() * 0.1, 2)
    t[40:60] = t[40]
    t[70:73] = np.nan
    rows = panel(spark, [(None if np.isnan(x) else x, 1000 + 0.1 * i % 3, 50 + i % 7) for i, x in enumerate(t)])
    checked = qc.checked(rows)
    got = features.features(checked, profile.climate_profile(checked)).orderBy("minute").toPandas()
    x = pd.Series(t)
    d1 = x.diff()
    same = lambda a, b: np.testing.assert_allclose(a.astype(float), b, atol=1e-9)
    same(got["d1_T"], d1)
    same(got["dsd_T"], d1.rolling(10, min_periods=6).std() / 0.08)
    run, want = 0, []
    for i in range(120):
        run = run + 1 if i and t[i] == t[i - 1] else 0
        want.append(run)
    assert got["run_T"].tolist() == want
    assert got["stuck_T"].tolist() == [r >= 15 for r in want]
    base = x.shift(1).rolling(30, min_periods=15).median()
    assert got["innov_T"].isna().tolist()[:15] == (x - base).isna().tolist()[:15]


def test_cut_histories_give_the_same_features(spark):
    rng = np.random.default_rng(5)
    t = np.round(25 + rng.normal(0, 0.3, 300).cumsum() * 0.1, 2)
    t[45:180] = t[45]  # a run over several parts
    t[200:204] = np.nan
    rows = panel(spark, [(None if np.isnan(x) else x, 1000 + 0.1 * i % 3, 50 + i % 7) for i, x in enumerate(t)])
    checked = qc.checked(rows)
    climate = profile.climate_profile(checked)
    whole = features.features(checked, climate)
    want = whole.orderBy("minute").collect()
    for part in (31, 50, 1000):
        got = features.features(checked, climate, part).select(*whole.columns).orderBy("minute").collect()
        assert [str(r) for r in got] == [str(r) for r in want]
    with pytest.raises(ValueError):
        features.features(checked, climate, 30)


def literal_runs(act, instant, need, win, close):
    """The minute-by-minute rule."""
    n, out, t = len(act), [], 0
    act = [a or i for a, i in zip(act, instant)]
    seen = [max(sum(act[max(0, k - win + 1) : k + 1]), need if instant[k] else 0) for k in range(n)]
    while t < n:
        if seen[t] >= need:
            start = max(0, t - win + 1)
            onset, detect, last = start + act[start : t + 1].index(True), t, t
            while t < n and t - last < close:
                t += 1
                if t < n and act[t]:
                    last = t
            out.append((onset, detect, last + 1, t >= n and n - 1 - last < close))
            t = last + close
        else:
            t += 1
    return out


def test_faults_and_alerts_meet_by_day_as_by_all_pairs(spark):
    rng, span = random.Random(3), 6 * 1440
    draw = lambda i: (i, rng.randrange(3), s := rng.randrange(span), s + rng.choice([1, 5, 60, 1500, 4000]))
    faults, alerts = [draw(i) for i in range(60)] + [(60, 0, 1440, 1441)], [draw(100 + i) for i in range(80)] + [(180, 0, 1461, 1462), (181, 0, 1400, 1440)]
    truth = spark.createDataFrame([(i, k, "spike", a, b) for i, k, a, b in faults], "truth long, station long, type string, start long, end long")
    named = spark.createDataFrame([(i, k, k, a, a, b) for i, k, a, b in alerts], "alert long, station long, city long, onset long, detect long, end long")
    met = evaluate.overlaps(truth, named)
    got = [(r.truth, r.alert) for r in met.collect()]
    assert sorted(got) == sorted((t[0], a[0]) for t in faults for a in alerts if t[1] == a[1] and a[2] <= t[3] + 20 and a[3] >= t[2])
    assert "day" in met._jdf.queryExecution().analyzed().toString()
    events = truth.select(F.col("station").alias("city"), "start", "end")
    hit = [(r.city, r.start, r.end) for r in evaluate.events_hit(events, named, 0).collect()]
    assert sorted(hit) == sorted({t[1:] for t in faults if any(t[1] == a[1] and a[2] < t[3] and a[3] > t[2] for a in alerts)})


def test_fixed_digits_by_decimals_in_sql_and_in_spark(spark):
    values = [6.949999999999999, 7.949999999999999, 7.050000000000001, 12.450000000000001, 0.05, 0.15, 0.25, 12.35, 4.35, 8.05, 0.0, 1e-7, 1234.55, 99.95]
    want = [f"{Decimal(repr(x)).quantize(Decimal('0.1'), ROUND_HALF_EVEN)}" for x in values]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    assert [r.t for r in rows.select("i", text.fixed(F.col("x"), 1).alias("t")).orderBy("i").collect()] == want
    assert [r[0] for r in duckdb.sql(f"SELECT {incident_sql.fixed('x', 1)} FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()] == want
    assert duckdb.sql(f"SELECT {incident_sql.fixed('2.5', 0)}, {incident_sql.fixed('3.5::DOUBLE', 0)}, {incident_sql.fixed('NULL::DOUBLE', 1)}").fetchall()[0][:2] == ("2", "4")


def test_features_are_one_pass_in_order_whatever_the_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(s, m, None if rng.random() < 0.1 else round(float(rng.normal(20, 1)), 1), 1000.0, float(50 + m % 7)) for s in (1, 2) for m in range(120)]
    checked = qc.checked(spark.createDataFrame(rows, "station long, minute long, T_raw double, P_raw double, RH_raw double").repartition(3))
    climate = profile.climate_profile(checked)
    made = features.features(checked, climate)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    whole = made.orderBy("station", "minute").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert features.features(checked, climate).orderBy("station", "minute").collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_layers_store_only_what_rows_alone_do_not_tell(spark):
    made = Layers(spark, "/root/testdata/sf0.001")
    assert {"zL_T", "exp_T", "dev_RH", "stuck_any", "td"} <= set(made.expected.columns)
    widths = {p.rsplit("/", 1)[1].split("-")[1]: len(spark.read.parquet(p).columns) for p in made.paths}
    made.release()
    assert "scored" not in widths and "expected" not in widths and "features" not in widths and max(widths.values()) <= 36, widths


def test_layers_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    was, before = spark.conf.get(CLEANED, None), shuffled()
    made = Layers(spark, "/root/testdata/sf0.001")
    assert "med_T" in made.near.columns
    left = shuffled() - before
    made.release()
    assert not left and spark.conf.get(CLEANED, None) == was


def test_sessions_equal_the_literal_rule(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(60):
        p, q = rng.random(), rng.random() * 0.1
        act, now = [rng.random() < p * 0.5 for _ in range(80)], [rng.random() < q for _ in range(80)]
        rows += [(f"s{k:02}", m, a, i) for m, (a, i) in enumerate(zip(act, now))]
        want[f"s{k:02}"] = act, now
    df = spark.createDataFrame(rows, "station string, minute long, act boolean, now boolean").persist()
    for need, win, close in ((4, 6, 10), (1, 1, 10), (3, 5, 15)):
        got = incidents.detect_runs(df, F.col("act"), F.col("now"), need, win, close).orderBy("station", "onset").collect()
        flat = [(s, *r) for s in sorted(want) for r in literal_runs(*want[s], need, win, close)]
        assert [tuple(r) for r in got] == flat


def test_sessions_of_cut_histories_equal_the_literal_rule_at_every_cut(spark):
    rng, rows, want = random.Random(11), [], {}
    for k in range(40):
        p, q = rng.random() ** 2, rng.random() * 0.1
        act, now = [rng.random() < p for _ in range(70)], [rng.random() < q for _ in range(70)]
        if k == 0:
            act = [True] * 70  # one session over all parts
        if k == 1:
            act = [m % 11 == 0 for m in range(70)]  # gaps as long as a part
        rows += [(f"s{k:02}", m, a, i) for m, (a, i) in enumerate(zip(act, now))]
        want[f"s{k:02}"] = act, now
    df = spark.createDataFrame(rows, "station string, minute long, act boolean, now boolean").persist()
    merged = [tuple(r) for r in incidents.group_runs(df, F.col("act"), 10).orderBy("station", "start").collect()]
    for need, win, close in ((4, 6, 10), (1, 1, 10), (3, 5, 15)):
        flat = [(s, *r) for s in sorted(want) for r in literal_runs(*want[s], need, win, close)]
        for part in (win, 7, 10, 11, 23, 70, 1000):
            got = incidents.detect_runs(df, F.col("act"), F.col("now"), need, win, close, part=part).orderBy("station", "onset").collect()
            assert [tuple(r) for r in got] == flat, (need, win, close, part)
    for part in (1, 5, 11, 12, 40):
        assert [tuple(r) for r in incidents.group_runs(df, F.col("act"), 10, part).orderBy("station", "start").collect()] == merged
    with pytest.raises(ValueError):
        incidents.detect_runs(df, F.col("act"), part=5)


@pytest.mark.parametrize("cell", [1, 5, 32])
def test_neighbour_values_by_cells_equal_those_by_edges(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    rng = np.random.default_rng(cell)
    # a dense town over a cell's edge, pairs at one point, stations across the date line, and one that is alone
    pts = [(i, 77 + float(rng.normal(0, 0.3)), 28.0 + float(rng.normal(0, 0.3))) for i in range(50)] + [(50, 77.0, 28.0), (51, 77.0, 28.0), (60, 179.95, 60.0), (61, -179.95, 60.1), (70, 10.0, -40.0)]
    edges = neighbours.build_neighbours(spark.createDataFrame(pts, "station long, lon double, lat double")).persist()
    place = {(r.cell, r.slot) for r in edges.select("cell", "slot", "station").distinct().collect()}
    assert len(place) == edges.select("station").distinct().count() and max(s for _, s in place) < cell
    said = {(p[0], m): (None if rng.random() < 0.2 else float(np.round(rng.normal(), 1)), bool(rng.random() < 0.2)) for p in pts for m in range(6) if rng.random() < 0.9}
    rows = spark.createDataFrame([(s, m, x, h) for (s, m), (x, h) in said.items()], "station long, minute long, x double, h boolean")
    listed = {}
    for e in edges.collect():
        listed.setdefault(e.station, []).append(e.nb)
    for hidden in (None, F.col("h")):
        for given in (edges, edges.drop("cell", "slot")):
            got = {(r.station, r.minute): (r.listed, r.x) for r in neighbours.neighbour_values(rows, given, ["x"], hidden).collect()}
            for s, nbs in listed.items():
                for m in range(6):
                    want = sorted(x for x, h in (said.get((n, m), (None, True)) for n in nbs) if x is not None and not (hidden is not None and h))
                    n, values = got.get((s, m), (len(nbs), []))
                    assert (n, values) == (len(nbs), want)
            assert 70 not in {s for s, _ in got}


def test_support_of_neighbours_is_one_exchange_whatever_the_batches(spark):
    rng = np.random.default_rng(8)
    pts = [(i, 77 + float(rng.normal(0, 0.3)), 28.0 + float(rng.normal(0, 0.3))) for i in range(40)] + [(70, 10.0, -40.0)]
    edges = neighbours.build_neighbours(spark.createDataFrame(pts, "station long, lon double, lat double")).persist()
    columns = [*neighbours.SPATIAL, "ts"]
    value = lambda: None if rng.random() < 0.3 else float(np.round(rng.normal(), 1))
    rows = spark.createDataFrame([(p[0], m, "x", bool(rng.random() < 0.2), *[value() for _ in columns]) for p in pts for m in (0, 1, 2, 1439, 1440) if rng.random() < 0.9], f"station long, minute long, note string, h boolean, {', '.join(f'{c} double' for c in columns)}").persist()
    for hidden in (None, F.col("h")):
        said = neighbours.neighbour_values(rows, edges, columns, hidden)
        found = said.select("station", "minute", *[neighbours.neighbour_median(F.col(a)).alias(f"{k}_{v}") for k, stem in (("med", "A"), ("medI", "innov")) for v in ("T", "P", "RH") for a in [f"{stem}_{v}"]], *[neighbours.neighbour_spread(F.col(f"A_{v}"), F.col("listed")).alias(f"spread_{v}") for v in ("T", "P", "RH")], F.size("A_T").cast("long").alias("nn"), neighbours.array_median(F.col("ts")).alias("nb_ts"))
        want = rows.join(found, ["station", "minute"], "left").fillna(0, ["nn", "nb_ts", "spread_T", "spread_P", "spread_RH"]).select(*rows.columns, *neighbours.SUPPORT)
        for most in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            try:
                made = neighbours.neighbour_support(rows, edges, hidden)
                plan = made._jdf.queryExecution().executedPlan().toString()
                assert not re.search(r"Join \[station#\d+L?, minute", plan)
                got = sorted(map(repr, made.select(*want.columns).collect()))
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert got == sorted(map(repr, want.collect()))


def test_neighbours_equal_all_pairs_even_across_the_date_line(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(rng.uniform(-180, 180)), float(rng.uniform(-80, 80))) for i in range(150)] + [(200, 179.9, 60.0), (201, -179.9, 60.1), (202, 179.5, 60.0), (203, 10.0, 89.5), (204, -170.0, 89.6)]
    pts += [(300 + i, 77 + 0.05 * i, 28.6) for i in range(12)]
    got = {(r.station, r.nb) for r in neighbours.build_neighbours(spark.createDataFrame(pts, "station long, lon double, lat double")).collect()}

    def km(a, b):
        r = math.pi / 180
        h = math.sin((b[2] - a[2]) * r / 2) ** 2 + math.cos(a[2] * r) * math.cos(b[2] * r) * math.sin((b[1] - a[1]) * r / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = set()
    for a in pts:
        near = sorted((km(a, b), b[0]) for b in pts if b[0] != a[0] and km(a, b) <= 100)[:6]
        want |= {(a[0], b) for _, b in near}
    assert got == want


def test_densify_and_first_per_minute(spark):
    obs = spark.createDataFrame([("a", "2024-01-01 00:00:10", 1.0, 5), ("a", "2024-01-01 00:00:40", 2.0, 2), ("a", "2024-01-01 00:02:00", 3.0, 7), ("x", "2024-01-01 00:01:00", 9.0, 8)], "station string, time string, T_raw double, ingest long")
    first = tables.first_per_minute(obs.withColumn("time", F.to_timestamp("time")))
    dense = tables.densify(first.select("station", "minute", "T_raw"), spark.createDataFrame([("a",), ("b",)], "station string"))
    rows = sorted((r.station, r.minute - 28401120, r.T_raw) for r in dense.collect())
    assert [r[0] for r in rows] == ["a"] * 3 + ["b"] * 3 and [r[2] for r in rows] == [2.0, None, 3.0, None, None, None]


def test_alias_error():
    try:
        tables.known_columns(["foo"], {"time": ("time", "timestamp")})
    except ValueError as e:
        assert "timestamp" in str(e)
    else:
        raise AssertionError


def test_injection(spark):
    obs = panel(spark, [(20.0, 1000.0, 50.0)] * 30)
    plan = spark.createDataFrame([("a", "level_shift", "T", 5, 10, 1, 4.0, None), ("a", "comm_error", "all", 15, 18, 1, 0.0, "dropout"), ("a", "noise_burst", "P", 20, 25, 1, 2.0, None)], "station string, kind string, var string, start long, end long, sign int, mag double, form string")
    got = {r.minute: r for r in inject.inject(obs, plan).collect()}
    assert [got[m].T_raw for m in range(4, 11)] == [20, 22, 24, 24, 24, 24, 20]
    assert got[16].T_raw is None and got[16].anom == "comm_error" and got[18].T_raw == 20
    again = {r.minute: r.P_raw for r in inject.inject(obs.repartition(3), plan).collect()}
    assert all(got[m].P_raw == again[m] for m in got) and len({got[m].P_raw for m in range(20, 25)}) == 5


def test_auc_and_ap(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(400), 2), rng.random(400) < 0.3
    row = evaluate.auc_and_ap(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "prob double, y boolean")).first()
    pos, neg = p[y], p[~y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, seen = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        k = (p >= s).sum()
        ap += (y & (p == s)).sum() * (y & (p >= s)).sum() / k
    assert abs(row.auc - auc) < 1e-9 and abs(row.ap - ap / y.sum()) < 1e-9 and not seen


def test_forest_and_autoencoder():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 4)) @ rng.normal(0, 1, (4, 17))
    forest = models.IsolationForest(40, 256).fit(x)
    far = np.full((1, 17), 30.0)
    assert forest.score(far)[0] > np.quantile(forest.score(x), 0.999)
    short, long = models.Autoencoder(epochs=1).fit(x / 4), models.Autoencoder(epochs=15).fit(x / 4)
    assert long.error(x / 4).mean() < short.error(x / 4).mean()
    assert np.array_equal(forest.score(x[:50]), models.IsolationForest(40, 256).fit(x).score(x[:50]))


def test_edge_check_keeps_a_storm_and_finds_faults():
    rng, state, flags = random.Random(4), edge.FRESH, []
    vp = lambda t: 6.112 * math.exp(17.67 * t / (t + 243.5))
    frozen = None
    for m in range(400):
        t, p = 30 + 3 * math.sin(m / 60) + 0.06 * (rng.random() - 0.5), 1000 + 0.6 * math.sin(m / 90) + 0.04 * (rng.random() - 0.5)
        rh = 100 * vp(20) / vp(t) + 0.4 * (rng.random() - 0.5)
        if m >= 150:
            t -= 6 * ((m - 150) / 12 if m < 162 else math.exp(-(m - 162) / 25))
            rh = 100 * vp(21) / vp(t)
        if m == 250:
            t += 17
        if 300 <= m < 330:
            frozen = frozen or (t, p, rh)
            t, p, rh = frozen
        if 350 <= m < 355:
            t, p, rh = -99.9, 0.0, -99.9
        state, f = edge.step(state, (t, p, rh))
        flags.append(f)
    assert flags[250] & 4 and flags[320] & 8 and all(flags[m] & 1 for m in range(350, 355))
    assert not any(flags[m] for m in range(30, 250))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-120, 120)), st.one_of(st.none(), st.floats(0, 1100)), st.one_of(st.none(), st.floats(-100, 130))), max_size=40))
def test_edge_check_never_breaks(rows):
    state = edge.FRESH
    for r in rows:
        state, f = edge.step(state, r)
        assert 0 <= f < 64 and all(math.isfinite(x) for x in state)


def test_edge_check_costs_few_microseconds_a_reading():
    rng = random.Random(6)
    rows = pd.DataFrame({c: [None if rng.random() < 0.02 else mid + rng.random() for _ in range(20_000)] for c, mid in (("T_raw", 25.0), ("P_raw", 1000.0), ("RH_raw", 50.0))})
    began = time.process_time()
    state, flags = edge._fold(edge.FRESH, rows)
    assert time.process_time() - began < 0.6  # arrays of three took over a second
    assert len(flags) == 20_000 and all(math.isfinite(x) for x in state) and [f & 1 for f in flags] == rows.isna().any(axis=1).astype(int).tolist()


def test_history_and_neighbours_meet_as_raw_rows(spark):
    """One exchange of raw rows, cut into days, gives what features over whole histories and neighbours by minute give."""
    rng = np.random.default_rng(11)
    pts = [(i, 77 + float(rng.normal(0, 0.4)), 28.0 + float(rng.normal(0, 0.4))) for i in range(6)] + [(70, 10.0, -40.0)]
    edges = neighbours.build_neighbours(spark.createDataFrame(pts, "station long, lon double, lat double")).persist()
    value = lambda base: None if rng.random() < 0.05 else float(np.round(base + rng.integers(0, 3), 1))
    held = lambda base, m: base if 1400 < m < 1470 else value(base)
    rows = [(p[0], m, held(20.0, m), held(1000.0, m), value(50.0), "x") for p in pts for m in range(1380 + p[0] % 3, 2900)]
    checked = qc.checked(spark.createDataFrame(rows, "station long, minute long, T_raw double, P_raw double, RH_raw double, note string")).persist()
    climate = profile.climate_profile(checked).persist()
    starts = evidence.day_starts(checked, evidence.day_ends(checked)).persist()
    flagged = checked.where("minute % 97 = 0 OR minute = 1439").select("station", "minute")
    own = neighbours.anomalies(features.features(checked, climate)).withColumn("ts", F.least(F.lit(8.0), F.coalesce(F.abs("innov_T") / 0.6, F.lit(0.0))))
    ts = lambda found: np.minimum(8.0, np.nan_to_num(np.abs(found["innov_T"]) / 0.6))
    for some in (None, flagged):
        marked = own.join(flagged.withColumn("f", F.lit(True)), ["station", "minute"], "left").withColumn("excluded", features.recently(F.coalesce("f", F.lit(False))))
        out = [*evidence.HISTORY, *neighbours.SUPPORT, "excluded"]
        want = neighbours.neighbour_support(marked if some is not None else marked.withColumn("excluded", F.lit(False)), edges, F.col("excluded"))
        made = evidence.near_rows(checked, climate, edges, starts, ["station", "minute", "T_raw", "note"], out, ts, some)
        exchanged = [line for line in made._jdf.queryExecution().toString().splitlines() if "Exchange" in line]
        assert exchanged and not any("innov" in line for line in exchanged)
        ordered = lambda df: df.select("station", "minute", "note", *out).toPandas().sort_values(["station", "minute"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(ordered(made), ordered(want), check_dtype=False, atol=1e-9, rtol=1e-9)


def test_layers_store_no_second_copy_of_the_rows(spark):
    made = Layers(spark, "/root/testdata/sf0.001")
    assert {"excluded", "zL_T"} <= set(made.second.columns)
    kept = {p.rsplit("/", 1)[1].split("-")[1]: spark.read.parquet(p).columns for p in made.paths}
    made.release()
    assert kept["flagged"] == ["station", "minute"] and "marked" not in kept


def test_incidents_are_stored_slice_by_slice(spark):
    """Only a slice's evidence is shuffled at a time; all stations are there, and ongoing ones are seen by the whole panel's newest minute."""
    made = Layers(spark, "/root/testdata/sf0.001")
    whole = incidents.incidents(made.expected, made.edges, made.alerts).select("station", "run_onset", "type", "ongoing", "corrected").collect()
    slices = list(made.make_incidents())
    got = made.incidents.select("station", "run_onset", "type", "ongoing", "corrected").collect()
    made.release()
    assert len(slices) > 1 and got and sorted(map(repr, got)) == sorted(map(repr, whole))


def test_a_layer_is_one_table_or_slices(spark):
    made = Layers(spark, "/root/testdata/sf0.001")
    one = made._stored("one", spark.range(3))
    assert one.count() == 3 and made._stored("two", [spark.range(3), spark.range(2)]).count() == 5
    made.release()


def _residuals(spark):
    rng, rows = np.random.default_rng(3), []
    for name, n in (("a", 1500), ("b", 900), ("c", 400), ("d", 700)):
        for m in range(n):
            gone = rng.random(6) < (1.0 if name == "d" else 0.1)
            rows.append((name, m, *[None if g else float(np.round(x, 2)) for g, x in zip(gone, rng.normal(0, 1, 6) * (0.1, 1, 3, 0.1, 1, 3))]))
    return spark.createDataFrame(rows, "station string, minute long, res_T double, res_P double, res_RH double, resI_T double, resI_P double, resI_RH double").repartition(7)


def test_spatial_tables_equal_percentiles(spark):
    rows = _residuals(spark).persist()
    offsets = profile.spatial_offsets(rows)
    want = offsets.join(profile.spatial_sigma(rows, offsets), "station")
    got = profile.spatial_tables(rows)
    assert "percentile" not in got._jdf.queryExecution().toString()
    ordered = lambda df: df.select(*want.columns).orderBy("station").toPandas()
    got, want = ordered(got), ordered(want)
    assert len(got) == 4 and (got.drop(columns=[c for c in got if c.startswith("off")]).round(9).equals(want.drop(columns=[c for c in want if c.startswith("off")]).round(9)))
    for c in ("off_T", "off_P", "off_RH"):
        np.testing.assert_allclose(np.stack(got[c]), np.stack(want[c]), atol=1e-12)


def test_profiles_over_all_rows_are_counts(spark, monkeypatch):
    """Neither the one reference nor the scale gathers values in one aggregate."""
    from stationqc.operators import selection

    plans, keep = [], selection._kept
    monkeypatch.setattr(selection, "_kept", lambda s, df: plans.append(df._jdf.queryExecution().toString()) or keep(s, df))
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(0, 2, (700, len(features.VECTOR))), 1)
    vector = spark.createDataFrame([("a", i, *map(float, r), i % 9 > 0) for i, r in enumerate(values)], f"station string, minute long, {', '.join(f'{c} double' for c in features.VECTOR)}, complete boolean").persist()
    got = {r.feature: r for r in profile.feature_scale(vector).collect()}
    full = pd.DataFrame(values, columns=features.VECTOR)[np.arange(700) % 9 > 0]
    for c in features.VECTOR:
        q = full[c].quantile([0.25, 0.5, 0.75]).tolist()
        assert got[c].med == pytest.approx(q[1], abs=1e-12)
        assert got[c].iqr == pytest.approx(max(q[2] - q[0], (full[c] - q[1]).abs().quantile(0.9) * 0.5 + 1e-3), abs=1e-12)
    ref = profile.dsd_reference(vector).first()
    assert list(ref) == pytest.approx([float(np.median(values[:, features.VECTOR.index(f"dsd_{v}")])) for v in ("T", "P", "RH")])
    assert plans and not any("percentile" in p for p in plans)


def test_health_makes_no_other_pass_over_the_panel(spark):
    from stationqc.plans import more_queries

    made = Layers(spark, "/root/testdata/sf0.001")
    assert more_queries._measured(made).count() and "features" not in made.made
    made.release()
