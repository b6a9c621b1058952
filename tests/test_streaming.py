import datetime
import json

import pytest
from pyspark.sql import functions as F

from stationqc.constants import VARS
from stationqc.operators import incidents
from stationqc.sources.packets import FLAGS, parse_packets
from stationqc.sources.tables import densify, first_per_minute
from stationqc.streaming import edge
from stationqc.streaming.monitor import Monitor

START = datetime.datetime(2024, 1, 1)
ZERO = int((START - datetime.datetime(1970, 1, 1)).total_seconds() // 60)


def score(rows):
    """A plain stand-in: warm is bad."""
    return rows.withColumns({"prob": F.when(F.col("T_raw") > 40, 0.9).otherwise(0.1), "instant": F.coalesce(F.col("T_raw") > 60, F.lit(False))})


def readings(minutes, bad=frozenset(("a", m) for m in range(105, 112))):
    return [(s, START + datetime.timedelta(minutes=m), 70.0 if (s, m) == ("b", 116) else 45.0 if (s, m) in bad else 20.0, 1000.0, 50.0) for m in minutes for s in ("a", "b") if (s, m) != ("b", 50)]


def packets(spark, minutes, **more):
    return spark.createDataFrame(readings(minutes, **more), "station string, time timestamp, T_raw double, P_raw double, RH_raw double")


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([("a",), ("b",)], "station string")


def expected(spark, stations, last, **more):
    whole = densify(first_per_minute(packets(spark, range(last), **more).withColumn("ingest", F.monotonically_increasing_id())), stations)
    return sorted((r.station, r.detect) for r in incidents.detect_runs(score(whole), F.col("prob") >= 0.7, F.col("instant")).collect())


def fresh(live):
    return sorted((r.station, r.detect) for r in live.alerts().where("NOT updated").collect())


def test_stream_gives_the_alerts_of_the_batch_and_a_replay_changes_nothing(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"), catch_up=8)
    batches = [range(0, 95), range(95, 110), range(110, 118)]
    for i, b in enumerate(batches):
        live.process(packets(spark, b), i)
    live.process(packets(spark, batches[-1]), len(batches) - 1)
    assert len(fresh(live)) == 2 and fresh(live) == expected(spark, stations, 118)


def test_many_minutes_at_once_wrong_clocks_and_late_rows(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"))
    live.process(packets(spark, range(0, 108)), 0)  # a first batch with history: one pass
    wrong = packets(spark, [3_000_000]).unionByName(packets(spark, range(108, 112))).unionByName(packets(spark, [108], bad={("b", 108)}))
    live.process(wrong, 1)
    live.process(packets(spark, [1]), 2)  # known long ago: nothing happens
    live.process(packets(spark, range(112, 118)), 3)
    assert fresh(live) == expected(spark, stations, 118)
    held = spark.read.parquet(str(tmp_path / "live/state/batch=3")).agg(F.min("minute"), F.max("minute")).first()
    assert spark.read.parquet(str(tmp_path / "live/waiting/batch=3")).select("minute").distinct().count() == 1  # the wrong clock's
    assert held[1] == ZERO + 117 and held[0] > ZERO + 112 - 151


def test_a_standstill_of_two_days_loses_nothing(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"), catch_up=0)
    back = 100 + 2 * 1440
    bad = {(s, m) for s in "ab" for m in range(back + 100, back + 112)}
    for i, b in enumerate([range(0, 100), range(back, back + 60), range(back + 60, back + 120), range(back + 120, back + 124)]):
        live.process(packets(spark, b, bad=bad), i)
    assert len(fresh(live)) == 2 and {s for s, _ in fresh(live)} == {"a", "b"} and all(back + 100 <= d - ZERO <= back + 106 for _, d in fresh(live))


def test_a_station_that_comes_back_alone_waits_for_others(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"), catch_up=0)
    one = lambda s, minutes: packets(spark, minutes).where(F.col("station") == s)
    live.process(packets(spark, range(0, 100)), 0)
    live.process(one("a", range(5000, 5004)), 1)
    clock = lambda i: spark.read.parquet(str(tmp_path / f"live/clock/batch={i}")).first().minute - ZERO
    assert clock(1) == 99
    live.process(one("b", range(5000, 5004)), 2)
    assert clock(2) == 5003
    held = spark.read.parquet(str(tmp_path / "live/state/batch=2")).where(F.col("minute") >= ZERO + 5000).count()
    assert held == 8  # what waited is there
    alone = Monitor(spark, stations, score, str(tmp_path / "alone"), catch_up=0)
    alone.process(packets(spark, range(0, 100)), 0)
    alone.process(one("a", range(5000, 5029)), 1)
    alone.process(one("a", range(5029, 5040)), 2)
    assert spark.read.parquet(str(tmp_path / "alone/clock/batch=2")).first().minute == ZERO + 5039


def test_a_wrong_clock_in_the_first_batch_and_later(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"), catch_up=0)
    wrong = packets(spark, [3_000_000]).where("station = 'b'")
    live.process(packets(spark, range(0, 108)).unionByName(wrong), 0)
    live.process(packets(spark, range(108, 112)).unionByName(packets(spark, [3_000_001]).where("station = 'b'")), 1)
    live.process(packets(spark, range(112, 118)), 2)
    assert len(fresh(live)) == 2 and fresh(live) == expected(spark, stations, 118)


def test_folders_of_old_batches_go_and_alerts_are_gathered(spark, stations, tmp_path):
    live = Monitor(spark, stations, score, str(tmp_path / "live"), catch_up=0, compact=4)
    for i, b in enumerate([range(0, 95), *[range(95 + 5 * k, 100 + 5 * k) for k in range(5)]]):
        live.process(packets(spark, b), i)
    assert fresh(live) == expected(spark, stations, 120)
    names = lambda of: sorted(p.name for p in (tmp_path / "live" / of).iterdir())
    assert names("state") == names("clock") == names("waiting") == ["batch=4", "batch=5"] and len(names("alerts")) == 4 and names("parts") == ["of=5"]


def test_types_are_looked_at_again_after_15_and_30_minutes(spark, stations, tmp_path):
    bad = {("a", m) for m in range(100, 140)}

    def classify(due, scored):
        newest = scored.agg(F.max("minute").alias("newest"))
        return due.crossJoin(newest).withColumn("type", F.when(F.col("newest") - F.col("detect") < 20, "spike").otherwise("drift")).drop("newest")

    live = Monitor(spark, stations, score, str(tmp_path / "live"), classify=classify)
    for i, b in enumerate([range(0, 104), range(104, 119), range(119, 134), range(134, 140)]):
        live.process(packets(spark, b, bad=bad), i)
    got = sorted((r.at - ZERO, r.detect - ZERO, r.type, r.updated) for r in live.alerts().where("station = 'a'").collect())
    assert got == [(103, 103, "spike", False), (133, 103, "drift", True)]  # at 118 the type was the same
    assert spark.read.parquet(str(tmp_path / "live/emitted/batch=3")).where("station = 'a'").count() == 0  # detected over 30 minutes ago


def test_file_stream_with_late_and_repeated_packets(spark, stations, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    live = Monitor(spark, stations, score, str(tmp_path / "live"))

    def drop(name, rows):
        lines = [json.dumps({"time": t.isoformat(), "value": json.dumps({"id": s, "t": x, "p": p, "rh": h})}) for s, t, x, p, h in rows]
        (folder / name).write_text("\n".join([*lines, '{"time": "2024-01-01T01:00:00", "value": "no packet"}']))

    def run():
        raw = spark.readStream.schema("time timestamp, value string").json(str(folder))
        parsed = parse_packets(raw).where("station IS NOT NULL").drop("flags")
        live.start(parsed, str(tmp_path / "check"), availableNow=True).awaitTermination()

    drop("0.json", readings(range(0, 104)) + readings(range(90, 95)))  # sent twice
    run()
    drop("1.json", readings(range(100, 118), bad={*((("a", m)) for m in range(105, 112))}))  # some again
    run()
    drop("2.json", readings([60], bad={("a", 60), ("b", 60)}))  # after the watermark
    run()
    run()  # nothing new
    assert fresh(live) == expected(spark, stations, 118)


def plain_edge(rows):
    """The device's rules one sensor at a time."""
    n, dew, mean, var, last, run, out = 0, 0.0, {}, {}, {}, dict.fromkeys(VARS, 0), []
    limits = {"T": (-15, 50, 3, 15, 0.08), "P": (500, 1080, 1.5, 15, 0.05), "RH": (0, 100, 20, 20, 0.5)}
    for row in rows:
        got, flags = dict(zip(VARS, row)), set()
        for v, x in got.items():
            low, high, jump, stuck, noise = limits[v]
            if x is None or x <= -90:
                flags.add("missing")
                continue
            flags |= {"range"} if not low <= x <= high else set()
            flags |= {"step"} if n and abs(x - last.get(v, 0.0)) > jump else set()
            run[v] = run[v] + 1 if n and x == last.get(v, 0.0) and not (v == "RH" and x >= 98) else 0
            flags |= {"stuck"} if run[v] + 1 >= stuck else set()
            flags |= {"z_score"} if n >= 30 and abs(x - mean[v]) / (var[v] + noise**2) ** 0.5 > 8 else set()
        if not flags & {"missing", "range"}:
            td = edge._dew(got["T"], got["RH"])
            flags |= {"dew_point"} if n >= 30 and abs(td - dew) > 6 else set()
            if not flags:
                for v, x in got.items():
                    m = mean.get(v, x) if n else x
                    mean[v], var[v] = m + 0.03 * (x - m), 0.97 * ((var[v] if n else 0.0) + 0.03 * (x - m) ** 2)
                dew = dew + 0.03 * (td - dew) if n else td
                n += 1
        if "missing" not in flags:
            last = got
        out.append(sum(FLAGS[f] for f in flags))
    return out


def test_edge_check_against_the_rules_and_as_a_stream(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = []
    for m in range(260):
        t, p, h = 20 + rng.gauss(0, 0.05), 1000 + rng.gauss(0, 0.03), 50 + rng.gauss(0, 0.4)
        if 60 <= m < 90:
            t = 21.0
        rows.append((None if m in (100, 101) else 80.0 if m == 120 else t + 9 * (m == 140), p + 5 * (150 <= m < 160), -99.9 if m == 110 else 99.0 if 170 <= m < 200 else h - 30 * (m == 220)))
    want = plain_edge(rows)
    assert len(set(want)) >= 6
    data = [(s, m, *r) for s in ("a", "b") for m, r in enumerate(rows)]
    df = spark.createDataFrame(data, "station string, minute long, T_raw double, P_raw double, RH_raw double")
    batch = {(r.station, r.minute): r.flags for r in edge.edge_qc(df).collect()}
    assert batch == {(s, m): want[m] for s in ("a", "b") for m in range(260)}
    for k, (a, b) in enumerate(((0, 70), (70, 71), (71, 260))):
        df.where((F.col("minute") >= a) & (F.col("minute") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows"))
        edge.edge_qc_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.station, r.minute): r.flags for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
