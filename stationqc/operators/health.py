"""Sensor health from the deviations of the last days: bias, drift, noise, time in fault, score and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NOTES, SENSORS, TOLERANCE, UNITS, VARS
from ..functions.text import fill, fixed
from .qc import last_minute


def _long(rows: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """Three columns a variable to (station, minute, keep…, var, …)."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), *[F.col(f"{stem}_{v}").alias(name) for name, stem in columns.items()]) for v in VARS]))
    return rows.select("station", "minute", *keep, each.alias("r")).select("station", "minute", *keep, "r.*")


def blocks(rows: DataFrame, hours: int = 72) -> DataFrame:
    """(station, var, block, median): medians of dev over 60-minute blocks counted back from the panel's end; whole blocks only, and variables with over 120 values."""
    ended = rows.crossJoin(F.broadcast(last_minute(rows))).crossJoin(F.broadcast(rows.agg(F.min("minute").alias("first"))))
    back = F.col("last") - F.col("minute")
    width = F.least(F.lit(hours * 60), F.col("last") - F.col("first") + 1)
    dealt = ended.withColumns({"block": F.floor(back / 60), "whole": F.floor(width / 60)}).where(back < width)
    values = _long(dealt, {"dev": "dev"}, "block", "whole")
    enough = values.groupBy("station", "var").agg(F.count("dev").alias("n")).where("n > 120")
    found = values.where("block < whole").groupBy("station", "var", "block").agg(F.percentile("dev", F.lit(0.5)).alias("median"))
    return found.join(enough.select("station", "var"), ["station", "var"], "left_semi")


def bias_and_drift(blocked: DataFrame) -> DataFrame:
    """(station, var, bias, drift): median of the last 12 block medians; slope a day over at least 24."""
    agg = blocked.groupBy("station", "var").agg(
        F.count("median").alias("n"), F.percentile(F.when(F.col("block") < 12, F.col("median")), F.lit(0.5)).alias("b"), F.regr_slope(F.col("median"), -F.col("block") / 24.0).alias("s")
    )
    bias = F.when(F.col("n") >= 6, F.col("b"))
    return agg.select("station", "var", bias.alias("bias"), F.when((F.col("n") >= 24) & bias.isNotNull(), F.col("s")).alias("drift"))


def noise_and_faults(rows: DataFrame, reference: DataFrame, faults: DataFrame, window: int = 1440) -> DataFrame:
    """(station, var, noise, fault_share) over the last day.  ``faults``: station, vars, onset, end; ``reference``: dsd_ref per variable."""
    recent = rows.crossJoin(F.broadcast(last_minute(rows))).where(F.col("minute") > F.col("last") - window).drop("last")
    dsd = _long(recent, {"dsd": "dsd"})
    minutes = faults.select("station", F.explode("vars").alias("var"), F.sequence("onset", F.greatest("onset", F.col("end") - 1)).alias("m"), (F.col("end") > F.col("onset")).alias("some")).where("some")
    hit = minutes.select("station", "var", F.explode("m").alias("minute")).distinct().withColumn("hit", F.lit(1.0))
    joined = dsd.join(hit, ["station", "minute", "var"], "left").groupBy("station", "var").agg(F.percentile("dsd", F.lit(0.5)).alias("dsd"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("fault_share"))
    ref = reference.select(F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(f"dsd_ref_{v}").alias("ref")) for v in VARS])).alias("r")).select("r.*")
    return joined.join(F.broadcast(ref), "var").select("station", "var", (F.col("dsd") / F.greatest("ref", F.lit(1e-6))).alias("noise"), "fault_share")


def _by_var(values: dict) -> Column:
    return F.when(F.col("var") == "T", F.lit(values["T"])).when(F.col("var") == "P", F.lit(values["P"])).otherwise(F.lit(values["RH"]))


def status(score: Column) -> Column:
    return F.when(score >= 80, "ok").when(score >= 55, "watch").otherwise("degraded")


def health_score(measured: DataFrame) -> DataFrame:
    """``measured`` (station, var, bias, drift, noise, fault_share) plus days_to_limit, raw_score, score and status."""
    tol, bias, drift = _by_var(TOLERANCE), F.col("bias"), F.col("drift")
    toward = F.signum(drift) == F.signum(F.when(F.abs(bias) > 0.15 * tol, bias).otherwise(drift))
    days = F.when(bias.isNotNull() & drift.isNotNull() & (F.abs(drift) > 0.03 * tol) & toward, F.greatest(F.lit(0.0), (tol - F.abs(bias)) / F.abs(drift)))
    lost = (
        60 * F.least(F.lit(1.0), F.col("fault_share") * 4) + 25 * F.least(F.lit(1.0), F.abs(F.coalesce(bias, F.lit(0.0))) / tol)
        + 15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("noise", F.lit(0.0)) - 1.5) / 3) + F.when(F.col("days_to_limit") < 7, 10).otherwise(0)
    )
    out = measured.withColumn("days_to_limit", days).withColumn("raw_score", 100 - F.least(F.lit(100.0), lost))
    return out.withColumns({"score": F.bround("raw_score", 0).cast("long"), "status": status(F.col("raw_score"))})


def overall(health: DataFrame) -> DataFrame:
    """(station, var, score, status) of the sensor with the lowest score; T, P, RH on ties."""
    rank = _by_var({"T": 0, "P": 1, "RH": 2})
    worst = health.groupBy("station").agg(F.min(F.struct("score", rank.alias("k"), "var", "status")).alias("w"))
    return worst.select("station", "w.var", "w.score", "w.status")


def maintenance_notes(health: DataFrame) -> DataFrame:
    """(station, notes): advice in the order of the sensors, or that there is none."""
    sensor, unit = _by_var(SENSORS), _by_var(UNITS)
    limit = _by_var({v: f"{TOLERANCE[v]:g}" for v in VARS})
    drifts = fill(NOTES["drift"], sensor=sensor, rate=fixed(F.abs("drift"), 2), unit=unit, limit=limit, days=fixed(F.col("days_to_limit"), 1))
    weak = fill(NOTES["weak"], sensor=sensor, score=F.col("score"))
    note = F.when(F.col("days_to_limit") < 30, drifts).when(F.col("status") != "ok", weak)
    rank = _by_var({"T": 0, "P": 1, "RH": 2})
    found = health.groupBy("station").agg(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct(rank.alias("k"), note.alias("text"))))).alias("n"))
    return found.select("station", F.when(F.size("n") == 0, F.array(F.lit(NOTES["none"]))).otherwise(F.transform("n", lambda x: x["text"])).alias("notes"))


def override_by_alert(worst: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """``worst`` with the score lowered by the most confident open alert of the station (station, confidence)."""
    top = open_alerts.groupBy("station").agg(F.max("confidence").alias("confidence"))
    out = worst.join(top, "station", "left")
    score = F.when(F.col("confidence").isNotNull(), F.least(F.col("score"), F.round(100 - 65 * F.col("confidence"), 0).cast("long"))).otherwise(F.col("score"))
    out = out.withColumn("new_score", score)
    return out.select("station", "var", F.col("new_score").alias("score"), F.when(F.col("confidence").isNotNull(), status(F.col("new_score"))).otherwise(F.col("status")).alias("status"))
