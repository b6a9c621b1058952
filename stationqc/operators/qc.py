"""Row-wise checks.  Input: station, minute, T_raw, P_raw, RH_raw; a row for each station and minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RANGE, VARS


def finite(x: Column) -> Column:
    """NaN and infinities become null: Spark would count NaN as equal to itself and above all numbers."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def no_false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def sentinel() -> Column:
    """One sentinel spoils the row."""
    value = lambda v, default: F.coalesce(finite(F.col(f"{v}_raw")), F.lit(default))
    return (value("T", 0.0) <= -90) | (value("P", 5.0) <= 1) | (value("RH", 0.0) <= -90)


def flag_missing(obs: DataFrame) -> DataFrame:
    """Adds comm: a value is missing, not finite or a sentinel."""
    missing = [finite(F.col(f"{v}_raw")).isNull() for v in VARS]
    return obs.withColumn("comm", missing[0] | missing[1] | missing[2] | sentinel())


def outside(v: str) -> Column:
    low, high = RANGE[v]
    x = finite(F.col(f"{v}_raw"))
    return no_false((x < low) | (x > high))


def flag_range(obs: DataFrame) -> DataFrame:
    """Adds rng_T, rng_P, rng_RH: out of the hard limits on a row that communicates.  Needs comm."""
    return obs.withColumns({f"rng_{v}": outside(v) & ~F.col("comm") for v in VARS})


def clean_values(obs: DataFrame) -> DataFrame:
    """Adds T, P, RH: the raw value, null where it is missing, out of range or beside a sentinel."""
    return obs.withColumns({v: F.when(~sentinel() & ~outside(v), finite(F.col(f"{v}_raw"))) for v in VARS})


def checked(obs: DataFrame) -> DataFrame:
    return clean_values(flag_range(flag_missing(obs)))


def last_minute(obs: DataFrame) -> DataFrame:
    """One row: last, the panel's newest minute, over all stations."""
    return obs.agg(F.max("minute").alias("last"))


def tail(obs: DataFrame, k: int) -> DataFrame:
    """The last ``k`` minutes of the panel."""
    return obs.join(F.broadcast(last_minute(obs)), F.col("minute") > F.col("last") - k).drop("last")


def hard() -> Column:
    return F.col("comm") | F.col("rng_T") | F.col("rng_P") | F.col("rng_RH") | F.col("stuck_any")


def hard_and_instant(evidence: DataFrame) -> DataFrame:
    """Adds hard, instant and prob from the flags and p_model."""
    out = evidence.withColumn("hard", hard())
    out = out.withColumn("instant", F.col("rng_T") | F.col("rng_P") | F.col("rng_RH") | (F.col("step_any") & (F.col("p_model") >= 0.5)))
    return out.withColumn("prob", F.when(F.col("hard"), F.greatest("p_model", F.lit(0.99))).otherwise(F.col("p_model")))


def threshold_mask() -> Column:
    """The baseline that knows limits only."""
    return hard() | F.col("step_any")


def temporal_mask() -> Column:
    """The baseline that knows the station's own pattern only."""
    return no_false(F.col("ts") >= 1)
