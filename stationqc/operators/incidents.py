"""From flagged minutes to incidents: sessions, evidence, type, size, confidence, severity, text and corrected values.

Sessions need no state machine: act rows are cut where the gap exceeds ``close``, and a session opens at its first row
with ``need`` of ``win`` rows active.  That equals the minute-by-minute rule because a window never spans two sessions
(``win <= close``).  Histories may be cut into parts, whose sessions are joined at the cuts.  Everything about an incident is then one interval join, equal on the station, and one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..constants import ACTION, CAUSE, CHECK_TEXT, CHECKS, HARD_P, LABEL, LOGGER, NAMES, NOISE, PROBE, RANGE, SENSORS, SENTENCE, SEVERITIES, SEVERITY, SHARES, STEP, STUCK_TAIL, THRESHOLD, TOLERANCE, UNITS, VARS, WHO
from ..functions.physics import array_median, median_of
from ..functions.text import fill, fixed, plain, signed
from .features import by_minute, by_part, cut_history
from .qc import last_minute, no_false

KEY = ["station", "run_onset"]


#: Minutes of a bucket by which intervals meet rows.
DAY = 1440


def meet(runs: DataFrame, rows: DataFrame, start: Column, stop: Column, run_key: str = "station", row_key: str = "s", minute: str = "m", how: str = "inner") -> DataFrame:
    """Rows (``row_key``, ``minute``) that lie in [start, stop) of the runs of the same ``run_key``: an equi-join on that and the day.

    Runs come again for each day that they touch, so a station's year isn't held against all its runs.
    """
    days = F.when(stop > start, F.sequence(F.floor(start / DAY), F.floor((stop - 1) / DAY)))
    dealt = runs.withColumns({"m_start": start, "m_stop": stop, "m_day": F.explode(days)})
    on = (F.col(run_key) == F.col(row_key)) & (F.col("m_day") == F.floor(F.col(minute) / DAY)) & (F.col(minute) >= F.col("m_start")) & (F.col(minute) < F.col("m_stop"))
    return dealt.join(rows, on, how).drop("m_start", "m_stop", "m_day")


def _sessions(acts: DataFrame, gap: int, over: WindowSpec | None = None) -> DataFrame:
    """Adds session: it grows where the distance from the act row before exceeds ``gap``."""
    over = over or by_minute()
    fresh = F.coalesce(F.col("minute") - F.lag("minute").over(over) > gap, F.lit(True)).cast("long")
    return acts.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def _joined_sessions(acts: DataFrame, gap: int, opened: Column | None = None) -> DataFrame:
    """(station, first, last, opened) of sessions of act rows that have a part: found part by part, then joined across cuts.

    ``opened`` is a column of the rows, of which a session keeps the least.  Only a part's first and last session can go on
    in another part, so a station's scan sees two rows a part, however many rows and sessions there are.
    """
    opened = opened if opened is not None else F.lit(None).cast("long")
    merged = [F.min("first").alias("first"), F.max("last").alias("last"), F.min("opened").alias("opened")]
    local = _sessions(acts.select("station", "part", "minute", opened.alias("opened")), gap, by_part()).groupBy("station", "part", "session")
    local = local.agg(F.min("minute").alias("first"), F.max("minute").alias("last"), F.min("opened").alias("opened"))
    local = local.withColumn("edge", (F.col("session") == 1) | (F.col("session") == F.max("session").over(Window.partitionBy("station", "part"))))
    ordered = Window.partitionBy("station").orderBy("first")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(ordered) > gap, F.lit(True)).cast("long")
    edges = local.where("edge").withColumn("fresh", fresh).withColumn("whole", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    inner = local.where("NOT edge").select("station", "first", "last", "opened")
    return inner.unionByName(edges.groupBy("station", "whole").agg(*merged).drop("whole"))


def group_runs(rows: DataFrame, mask: Column, gap: int, part: int | None = None) -> DataFrame:
    """(station, start, last): true rows whose distance is at most ``gap`` merged.  ``part`` as in :func:`detect_runs`."""
    acts = rows.select("station", "minute", no_false(mask).alias("m")).where("m")
    if part is not None:
        return _joined_sessions(acts.withColumn("part", F.floor(F.col("minute") / part)), gap).select("station", F.col("first").alias("start"), "last")
    return _sessions(acts, gap).groupBy("station", "session").agg(F.min("minute").alias("start"), F.max("minute").alias("last")).drop("session")


def detect_runs(
    rows: DataFrame, act: Column, instant: Column | None = None, need: int = 4, win: int = 6, close: int = 10, panel: DataFrame | None = None, part: int | None = None
) -> DataFrame:
    """(station, onset, detect, end, ongoing) of alerts: opened by ``need`` of ``win`` active rows, or one instant row; ended by ``close`` quiet ones.

    ``end`` is exclusive.  ``panel`` gives the newest minute (default: that of ``rows``), by which an alert is ongoing.
    ``part`` cuts histories to so many minutes (``win`` at least), with the same result: a station is then as many tasks as it has parts.
    """
    if win > close:
        raise ValueError("win must not exceed close")
    one = no_false(act) if instant is None else no_false(act) | no_false(instant)
    base = rows.select("station", "minute", one.alias("act"), (no_false(instant) if instant is not None else F.lit(False)).alias("now"))
    over = by_minute()
    if part is not None:
        base, over = cut_history(base, part, win - 1), by_part()
    window = over.rowsBetween(1 - win, 0)
    seen = F.sum(F.col("act").cast("int")).over(window)
    base = base.withColumn("sm", F.when(F.col("now"), F.greatest(seen, F.lit(need))).otherwise(seen))
    if part is None:
        found = _sessions(base.where("act"), close)
        found = found.withColumn("detect", F.min(F.when(F.col("sm") >= need, F.col("minute"))).over(Window.partitionBy("station", "session")))
        runs = found.where("detect IS NOT NULL").groupBy("station", "session").agg(
            F.min(F.when(F.col("minute") >= F.col("detect") - (win - 1), F.col("minute"))).alias("onset"), F.first("detect").alias("detect"), (F.max("minute") + 1).alias("end")
        )
    else:
        # a window never spans two sessions, so the onset is the first active row of the window that opens
        since = F.min(F.when(F.col("act"), F.col("minute"))).over(window)
        acts = base.withColumn("since", since).where("act AND NOT lead")
        whole = _joined_sessions(acts, close, F.when(F.col("sm") >= need, F.struct("minute", "since"))).where("opened IS NOT NULL")
        runs = whole.select("station", F.col("opened.since").alias("onset"), F.col("opened.minute").alias("detect"), (F.col("last") + 1).alias("end"))
    last = last_minute(panel if panel is not None else rows)
    return runs.crossJoin(F.broadcast(last)).select("station", "onset", "detect", "end", (F.col("last") - F.col("end") + 1 < close).alias("ongoing"))


def fault_minutes(rows: DataFrame, runs: DataFrame, name: str = "in_fault") -> DataFrame:
    """``rows`` plus ``name``: the minute lies in [onset, end) of a run of its station."""
    minutes = runs.select("station", F.explode(F.sequence("onset", F.col("end") - 1)).alias("minute")).distinct().withColumn(name, F.lit(True))
    return rows.join(minutes, ["station", "minute"], "left").withColumn(name, no_false(F.col(name)))


def weather_runs(masked: DataFrame, part: int | None = None) -> DataFrame:
    """(station, start, end) of unusual minutes outside faults: 3 of 5, closed after 15, cut at the first fault.  Needs ts and in_fault."""
    runs = detect_runs(masked, (F.col("ts") >= 1) & ~F.col("in_fault"), need=3, win=5, close=15, part=part).select("station", F.col("detect").alias("start"), "end")
    faults = masked.where("in_fault").select(F.col("station").alias("s"), F.col("minute").alias("m"))
    cut = meet(runs, faults, F.col("start"), F.col("end"), how="left").groupBy("station", "start", "end").agg(F.min("m").alias("cut"))
    return cut.select("station", "start", F.coalesce("cut", "end").alias("end"))


def extreme_runs(masked: DataFrame, edges: DataFrame, part: int | None = None) -> DataFrame:
    """(station, start, last, detect, kind, ongoing): over 30 minutes at 4 degrees or more from the own climate, outside faults.  Needs A_T and in_fault."""
    near = masked.join(edges.select("station").distinct(), "station", "left_semi")
    runs = group_runs(near, (F.abs("A_T") >= 4) & ~F.col("in_fault"), 10, part).where("last - start >= 30")
    rows = near.select(F.col("station").alias("s"), F.col("minute").alias("m"), F.coalesce("A_T", F.lit(0.0)).alias("a"))
    mean = meet(runs, rows, F.col("start"), F.col("last") + 1).groupBy("station", "start", "last").agg(F.avg("a").alias("mean"))
    kind = F.when(F.col("mean") > 0, "Heatwave").otherwise("Cold spell")
    out = mean.crossJoin(F.broadcast(last_minute(masked).withColumnRenamed("last", "newest")))
    return out.select("station", "start", "last", (F.col("start") + 30).alias("detect"), kind.alias("kind"), "mean", (F.col("last") >= F.col("newest") - 1).alias("ongoing"))


def incident_evidence(runs: DataFrame, evidence: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of ``evidence`` within [onset-before, end+after) of each run, with run_onset, detect, end and ongoing."""
    r = runs.select(F.col("station").alias("s"), F.col("onset").alias("run_onset"), "detect", "end", "ongoing")
    return meet(r, evidence, F.col("run_onset") - before, F.greatest(F.col("end"), F.col("run_onset") + 60) + after, "s", "station", "minute").drop("s")


def incident_profile(runs: DataFrame, evidence: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """One row a run: shares, peaks, counts and short series of its evidence.  ``evidence``: scored rows with expected_series and deviation_native.

    ``panel`` gives the newest minute (default: that of ``evidence``).
    """
    rows = incident_evidence(runs, evidence, 90, 10)
    rel, length = F.col("minute") - F.col("run_onset"), F.col("end") - F.col("run_onset")
    seg = (rel >= 0) & (F.col("minute") < F.col("end"))
    whole = Window.partitionBy(*KEY)
    base = (rel >= -90) & (rel < -15)
    new: dict[str, Column] = {}
    for v in VARS:
        new[f"ref_{v}"] = F.percentile(F.when(base, F.col(v)), F.lit(0.5)).over(whole)
        new[f"cl0_{v}"] = F.min(F.when(rel >= -50, F.struct("minute", F.col(f"cl_{v}").alias("c")))).over(whole)["c"]
    new["td_mid"] = median_of(F.collect_list("td").over(whole.orderBy("minute").rowsBetween(-35, -6)))
    rows = rows.withColumns(new | {"seg": seg, "rel": rel, "len": length})
    for v in VARS:
        own = F.col(v) - F.col(f"ref_{v}") - (F.col(f"cl_{v}") - F.col(f"cl0_{v}"))
        near = F.when(F.col("ever_nb"), F.col(f"dev_{v}")).otherwise(own)
        rows = rows.withColumn(f"d_{v}", F.when(F.col(f"rng_{v}") & F.col("has_edges"), F.col(f"{v}_raw") - F.col(f"exp_{v}")).otherwise(near))
    s = lambda c: F.when(F.col("seg"), c)
    share = lambda c: F.avg(s(c.cast("double")))
    some = lambda c: F.max(s(c.cast("int"))) > 0
    count = lambda c: F.coalesce(F.sum(s(no_false(c).cast("long"))), F.lit(0))
    late = F.col("rel") >= F.least(F.col("len") - 1, F.greatest(F.lit(5), F.floor(F.col("len") / 3)))
    aggs = [
        F.first("detect").alias("detect"), F.first("end").alias("end"), F.first("ongoing").alias("ongoing"), F.first("len").alias("len"),
        share(F.col("comm")).alias("comm_share"), F.sum(s(F.col("comm").cast("long"))).alias("n_comm"), share(F.col("stuck_any")).alias("stuck_share"), share(F.col("hard")).alias("hard_share"),
        some(F.col("has_nb")).alias("has_nb"), some(F.col("hard")).alias("any_hard"), some(F.col("step_any")).alias("any_step"),
        F.percentile(F.when((F.col("rel") >= 0) & (F.col("rel") < 10), F.col("p_model")), F.lit(0.5)).alias("p_early"),
        F.coalesce(F.max(s(F.col("ph"))), F.lit(0.0)).alias("ph_max"), F.coalesce(F.max(s(F.col("ts"))), F.lit(0.0)).alias("ts_max"),
        F.max("listed").alias("n_neighbours"), F.max("far_km").alias("far_km"),
        F.min(s(F.struct((-F.col("ph")).alias("o"), "minute", "td", "td_mid"))).alias("dew"),
    ]
    newest = F.when(F.col("ongoing"), F.col("last")).otherwise(F.col("end") - 1)
    for v in VARS:
        d, z = F.col(f"d_{v}"), F.when(F.col(f"rng_{v}"), 99.0).otherwise(F.coalesce(F.abs(f"zL_{v}"), F.lit(0.0)))
        big = 3 * max(4 * NOISE[v], 0.5 * TOLERANCE[v])
        aggs += [
            some(F.col(f"stuck_{v}")).alias(f"stuck_{v}"), some(F.col(f"rng_{v}")).alias(f"rng_{v}"), some(F.col(f"step_{v}")).alias(f"stepped_{v}"),
            F.coalesce(F.max(s(F.abs(d))), F.lit(0.0)).alias(f"peak_{v}"), F.coalesce(F.max(s(F.abs(f"zL_{v}"))), F.lit(0.0)).alias(f"z_{v}"), F.first(f"sig_{v}").alias(f"sig_{v}"),
            share(no_false(F.col(f"dsd_{v}") > 4)).alias(f"elev_{v}"), count(F.abs(f"d1_{v}") > STEP[v] / 2).alias(f"nsp_{v}"), count(F.abs(f"d1_{v}") > 4 * 1.414 * NOISE[v]).alias(f"kbig_{v}"),
            count(d > big).alias(f"up_{v}"), count(d < -big).alias(f"down_{v}"),
            F.percentile(s(F.when(late, z)), F.lit(0.5)).alias(f"latez_{v}"), F.percentile(s(F.when(late, F.coalesce(F.abs(d), F.lit(0.0)) / max(TOLERANCE[v], 0.1))), F.lit(0.5)).alias(f"lated_{v}"),
            F.max(F.when(F.col("rel") == F.col("len") - 1, z)).alias(f"endz_{v}"), F.max(F.when(F.col("rel") == F.col("len") - 1, F.coalesce(F.abs(d), F.lit(0.0)) / max(TOLERANCE[v], 0.1))).alias(f"endd_{v}"),
            F.array_sort(F.collect_list(F.when((F.col("rel") >= -15) & (F.col("minute") < F.greatest(F.col("end"), F.col("run_onset") + 60)), F.struct("minute", F.coalesce(d, F.lit(0.0)).alias("d"), F.col("seg").alias("seg"))))).alias(f"series_{v}"),
            F.max(F.when(F.col("rel") == 0, F.col(f"run_{v}"))).alias(f"run0_{v}"), F.max(s(F.col(f"run_{v}"))).alias(f"runmax_{v}"),
            F.max(F.when(F.col("minute") == newest, F.col(f"{v}_raw"))).alias(f"obs_{v}"), F.max(F.when(F.col("minute") == newest, F.col(f"exp_{v}"))).alias(f"est_{v}"), F.max(F.when(F.col("minute") == newest, F.col(f"cl_{v}"))).alias(f"clk_{v}"),
            F.max(F.when((F.col("rel") >= -60) & (F.col("rel") <= -15) & F.col(v).isNotNull(), F.struct("minute", F.col(v).alias("x")))).getField("x").alias(f"before_{v}"),
            F.min(F.when(F.col("rel") >= -15, F.struct("minute", F.col(f"cl_{v}").alias("c")))).getField("c").alias(f"clj_{v}"),
            F.min(s(F.when(F.col(f"rng_{v}"), F.struct("minute", F.col(f"{v}_raw").alias("x"))))).getField("x").alias(f"badval_{v}"),
            F.min(s(F.when(F.col(f"step_{v}"), F.struct("minute", F.col(f"d1_{v}").alias("x"))))).getField("x").alias(f"stepval_{v}"),
        ]
    found = rows.crossJoin(F.broadcast(last_minute(evidence if panel is None else panel))).groupBy(*KEY).agg(*aggs)
    return found.withColumns({"dew_td": F.col("dew.td"), "dew_moved": F.col("dew.td") - F.col("dew.td_mid")}).drop("dew")


def _pick(by: Column, prefix: str) -> Column:
    return F.when(by == "T", F.col(f"{prefix}_T")).when(by == "P", F.col(f"{prefix}_P")).otherwise(F.col(f"{prefix}_RH"))


def _const(by: Column, values: dict) -> Column:
    return F.when(by == "T", F.lit(values["T"])).when(by == "P", F.lit(values["P"])).otherwise(F.lit(values["RH"]))


def _largest(a: Column, b: Column, c: Column) -> Column:
    return F.when((a >= b) & (a >= c), "T").when(b >= c, "P").otherwise("RH")


def main_variable(profile: DataFrame) -> DataFrame:
    """Adds zpeak per variable and main: the largest spatial z, or without neighbours the largest deviation in tolerances; ties go T, P, RH."""
    new = {}
    for v in VARS:
        lifted = F.when(F.col(f"rng_{v}"), F.greatest(F.col(f"z_{v}"), F.col(f"peak_{v}") / F.greatest(F.col(f"sig_{v}"), F.lit(1e-6)))).otherwise(F.col(f"z_{v}"))
        new[f"zpeak_{v}"] = F.when(F.col("has_nb"), lifted).otherwise(0.0)
    out = profile.withColumns(new)
    with_nb = _largest(*[F.col(f"zpeak_{v}") for v in VARS])
    alone = _largest(*[F.col(f"peak_{v}") / TOLERANCE[v] for v in VARS])
    return out.withColumn("main", F.when(F.col("has_nb"), with_nb).otherwise(alone))


def classify_fault(profile: DataFrame) -> DataFrame:
    """Adds type, and what tells a jump from a drift: pk, the median of the largest deviations, and rise, minutes from a fifth of it to four.  ``profile`` has main."""
    main = F.col("main")
    n_of = lambda cond: sum((F.when(cond(v), 1).otherwise(0) for v in VARS), F.lit(0))
    spiky = (n_of(lambda v: F.col(f"nsp_{v}") >= 2) >= 2) & (n_of(lambda v: F.col(f"elev_{v}") >= 0.35) >= 2)
    k_big, up, down = _pick(main, "kbig"), _pick(main, "up"), _pick(main, "down")
    one_sided = F.when(up + down >= 4, F.greatest(up, down) / (up + down)).otherwise(1.0)
    late = F.when(F.col("has_nb"), _pick(main, "latez") >= 3).otherwise(_pick(main, "lated") >= 1)
    at_end = F.when(F.col("has_nb"), _pick(main, "endz") >= 3).otherwise(_pick(main, "endd") >= 1)
    persist = no_false(F.when(F.col("len") > 5, late).otherwise(F.col("ongoing") & at_end))
    sizes = F.transform(_pick(main, "series"), lambda r: F.abs(r["d"]))
    out = profile.withColumn("sizes", sizes)
    top = F.slice(F.sort_array("sizes", asc=False), 1, F.greatest(F.lit(3), F.floor(F.size("sizes") / 8).cast("int")))
    out = out.withColumn("pk", array_median(F.sort_array(top)))
    first = lambda part: F.when(F.col("pk") > 0, F.coalesce(F.array_min(F.transform("sizes", lambda x, i: F.when(x >= part * F.col("pk"), i))), F.lit(0))).otherwise(0)
    out = out.withColumn("rise", (first(0.8) - first(0.2)).cast("long"))
    kind = (
        F.when(F.col("comm_share") >= 0.5, "comm_error")
        .when((F.col("stuck_T") | F.col("stuck_P") | F.col("stuck_RH")) & (F.col("stuck_share") >= 0.5), "stuck")
        .when(spiky, "power_glitch")
        .when((k_big / F.greatest(F.lit(1), F.col("len")) >= 0.25) & (k_big > 8) & (one_sided < 0.85), "noise_burst")
        .when(persist, F.when(F.col("rise") <= 12, "level_shift").otherwise("drift"))
        .when(k_big <= 8, "spike")
        .otherwise("noise_burst")
    )
    return out.withColumn("type", kind).drop("sizes")


def describe(classified: DataFrame, first_minute: int = 0) -> DataFrame:
    """Adds vars, var, sensor, onset, magnitude, confidence, severity, cause, label, action, unit, corrected, contributions, checks and explanation."""
    kind = F.col("type")
    chosen = F.array_compact(F.array(*[F.when(F.col(f"stuck_{v}"), F.lit(v)) for v in VARS]))
    out = classified.withColumn("vars", F.when(kind.isin("comm_error", "power_glitch"), F.array(*map(F.lit, VARS))).when(kind == "stuck", chosen).otherwise(F.array("main")))
    out = out.withColumn("var", F.get("vars", F.lit(0)))
    var, n = F.col("var"), F.size("vars")
    names = F.transform("vars", lambda x: F.when(x == "T", SENSORS["T"]).when(x == "P", SENSORS["P"]).otherwise(SENSORS["RH"]))
    both = (n == 2) & F.array_contains("vars", "T") & F.array_contains("vars", "RH")
    sensor = F.when(n == 1, F.get(names, F.lit(0))).when(both, PROBE).when(n == 3, LOGGER).otherwise(F.array_join(names, " + "))
    inside = F.filter(_pick(var, "series"), lambda r: r["seg"])
    largest = F.array_max(F.transform(inside, lambda r: F.struct(F.abs(r["d"]).alias("a"), (-r["minute"]).alias("m"), r["d"].alias("d"))))
    run0 = _pick(var, "run0")
    onset = F.when((kind == "stuck") & (run0 > 1), F.greatest(F.lit(first_minute), F.col("run_onset") - (run0 - 1))).otherwise(F.col("run_onset"))
    conf = F.least(F.lit(HARD_P), F.greatest(F.col("p_early"), F.when(F.col("hard_share") > 0.5, HARD_P).otherwise(0.0)))
    out = out.withColumns({"sensor": sensor, "magnitude": F.coalesce(largest["d"], F.lit(0.0)), "onset": onset, "confidence": conf})
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), kind)
    level = level - F.when(kind.isin("spike", "level_shift", "drift") & (F.abs("magnitude") < 1.5 * _const(var, TOLERANCE)), 1).otherwise(0) - F.when(F.col("confidence") < 0.7, 1).otherwise(0)
    text = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind)
    action = F.replace(text(ACTION), F.lit("{s}"), F.when(n == 1, F.lower("sensor")).otherwise("sensors"))
    corrected = F.array(*[F.when(F.array_contains("vars", v), F.struct(F.lit(v).alias("var"), F.when(F.col(f"obs_{v}") > -90, F.col(f"obs_{v}")).alias("observed"), F.coalesce(F.col(f"est_{v}"), F.col(f"before_{v}") + F.col(f"clk_{v}") - F.col(f"clj_{v}")).alias("corrected"))) for v in VARS])
    out = out.withColumns(
        {
            "severity": F.get(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(0), level)),
            "unit": _const(var, UNITS), "label": text(LABEL), "cause": text(CAUSE), "action": action,
            "corrected": F.filter(corrected, lambda c: c["corrected"].isNotNull()),
        }
    )
    a = F.when(F.col("has_nb"), F.least(F.lit(1.0), F.greatest(*[F.col(f"zpeak_{v}") for v in VARS]) / 12.0)).otherwise(0.05)
    b, c = F.least(F.lit(1.0), F.col("ph_max")), F.when(F.col("any_hard") | F.col("any_step"), 1.0).otherwise(0.1)
    d = F.least(F.lit(1.0), F.col("ts_max") / 3.0) * 0.6
    shares = dict(zip(SHARES, (a, b, c, d)))
    out = out.withColumn("contributions", F.array(*[F.struct(F.lit(k).alias("name"), F.bround(100 * x / (a + b + c + d)).cast("long").alias("share")) for k, x in shares.items()]))
    return out.withColumns({"checks": _checks(), "explanation": _sentence()})


def _checks() -> Column:
    own = lambda v: {"name": F.lit(NAMES[v]), "unit": F.lit(UNITS[v])}
    failed, say = F.col("comm_share") > 0.2, []
    say.append(F.when(failed, fill(CHECK_TEXT["packets"], bad=F.col("n_comm"), minutes=F.col("len"))))
    for v in VARS:
        low, high = (F.lit(f"{x:g}") for x in RANGE[v])
        out, step, stuck = (F.col(f"{k}_{v}") for k in ("rng", "stepped", "stuck"))
        say.append(F.when(out, fill(CHECK_TEXT["range"], value=plain(F.col(f"badval_{v}")), low=low, high=high, **own(v))).when(step, fill(CHECK_TEXT["step"], value=plain(F.abs(f"stepval_{v}")), **own(v))))
        say.append(F.when(stuck, fill(CHECK_TEXT["stuck"], name=F.lit(NAMES[v]), count=F.col(f"runmax_{v}") + 1)))
        failed = failed | out | step | stuck
    var, wet, far = F.col("var"), F.col("ph_max") >= 1, fixed(F.col("far_km"), 0)
    near = {"n": F.col("n_neighbours"), "km": far}
    off = _pick(var, "zpeak") >= 5
    texts = {
        "qc": (F.when(failed, "fail").otherwise("pass"), F.when(failed, F.array_join(F.slice(F.array_compact(F.array(*say)), 1, 2), " ")).otherwise(CHECK_TEXT["qc_pass"])),
        "physics": (F.when(wet, "fail").otherwise("pass"), F.when(wet, fill(CHECK_TEXT["physics_fail"], dew=plain(F.col("dew_td")), moved=signed(F.col("dew_moved")))).otherwise(CHECK_TEXT["physics_pass"])),
        "neighbour": (
            F.when(~F.col("has_nb"), "na").when(off, "fail").otherwise("warn"),
            F.when(~F.col("has_nb"), CHECK_TEXT["neighbour_na"]).when(off, fill(CHECK_TEXT["neighbour_fail"], name=_const(var, NAMES), size=signed(F.col("magnitude")), unit=F.col("unit"), **near)).otherwise(fill(CHECK_TEXT["neighbour_warn"], **near)),
        ),
        "ai": (F.when(F.col("ts_max") >= 1, "fail").otherwise("pass"), fill(CHECK_TEXT["ai"], score=fixed(F.col("ts_max"), 2))),
    }
    return F.array(*[F.struct(F.lit(k).alias("id"), *[F.lit(x).alias(n) for x, n in zip(CHECKS[k], ("title", "tag"))], state.alias("state"), text.alias("text")) for k, (state, text) in texts.items()])


def _sentence() -> Column:
    kind, n = F.col("type"), F.col("n_neighbours")
    either = lambda texts: F.when(F.col("has_nb"), fill(texts["near"], n=n)).otherwise(texts["alone"])
    low = lambda x: F.lower(F.when(x == "T", NAMES["T"]).when(x == "P", NAMES["P"]).otherwise(NAMES["RH"]))
    values = {
        "name": low(F.col("var")), "names": F.array_join(F.transform("vars", low), " and "), "minutes": F.col("len"), "size": signed(F.col("magnitude")),
        "unit": F.col("unit"), "who": either(WHO), "tail": either(STUCK_TAIL),
    }
    text = F.when(kind == "comm_error", fill(SENTENCE["comm_error"], **values))
    for k in list(SENTENCE)[1:]:
        text = text.when(kind == k, fill(SENTENCE[k], **values))
    return text


def incidents(scored: DataFrame, edges: DataFrame, runs: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """All faults of ``scored`` rows (with prob, p_model, hard, instant, expected_series and deviation_native), described.

    ``panel`` gives the newest minute (default: that of ``scored``), if ``scored`` and ``runs`` are those of some stations alone.
    """
    runs = detect_runs(scored, F.col("prob") >= THRESHOLD, F.col("instant")) if runs is None else runs
    near = edges.groupBy("station").agg(F.max("listed").alias("listed"), F.max("km").alias("far_km"))
    ever = scored.groupBy("station").agg((F.max(F.col("has_nb").cast("int")) > 0).alias("ever_nb"))
    rows = scored.join(near, "station", "left").join(ever, "station").withColumns({"has_edges": F.col("listed").isNotNull(), "listed": F.coalesce("listed", F.lit(0).cast("long"))})
    return describe(classify_fault(main_variable(incident_profile(runs, rows, panel))))
