"""Tables for people: feed, status board, work queue, timelines, directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import VARS


def alert_feed(incidents: DataFrame, k: int = 25) -> DataFrame:
    """The first ``k`` incidents by detection."""
    return incidents.orderBy("detect", "station", "onset").limit(k)


def status_board(stations: DataFrame, incidents: DataFrame, start: int) -> DataFrame:
    """Each station's current state: the most confident fault seen since an hour before ``start`` and open after it, else the first event, else ok.

    ``incidents``: station, kind, detect, end, severity, confidence, label.
    """
    now = incidents.where((F.col("detect") >= start - 60) & (F.col("end") > start))
    fault = F.col("kind") == "fault"
    best = Window.partitionBy("station").orderBy(F.desc(fault), F.when(fault, -F.col("confidence")).otherwise(F.col("detect")), "detect", "label")
    top = now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    state = F.when(F.col("kind").isNull(), "ok").when(fault, F.col("severity")).otherwise("event")
    return stations.select("station").join(top, "station", "left").select("station", state.alias("status"), "label", "detect", "confidence")


def work_queue(board: DataFrame) -> DataFrame:
    """The board with its rank (high, medium and low, event, ok), in that order."""
    rank = F.when(F.col("status") == "high", 0).when(F.col("status").isin("medium", "low"), 1).when(F.col("status") == "event", 2).otherwise(3)
    return board.withColumn("rank", rank.cast("long")).withColumn("headline", F.coalesce("label", F.lit("All sensors normal"))).orderBy("rank", "station")


def status_counts(board: DataFrame) -> DataFrame:
    group = F.when(F.col("status").isin("high", "medium", "low"), "alert").otherwise(F.col("status"))
    return board.groupBy(group.alias("status")).agg(F.count("*").alias("n"))


def station_timeline(evidence: DataFrame, minutes: int = 120) -> DataFrame:
    """station and points: the last ``minutes`` as an array in order, with bad values null and numbers rounded, the expected value and its band, prob and ts up to 5."""
    last = evidence.agg(F.max("minute").alias("last"))
    rows = evidence.crossJoin(F.broadcast(last)).where(F.col("minute") > F.col("last") - minutes)
    good = {"T": F.col("T_raw") > -90, "P": F.col("P_raw") > 1, "RH": F.col("RH_raw") > -90}
    # the nudge makes decimal halves round up, whatever their last bit
    near = lambda x, n: F.round(x + 1.3e-8, n)
    point = F.struct(
        "minute", *[near(F.when(good[v], F.col(f"{v}_raw")), 2).alias(v) for v in VARS], *[near(F.col(f"{k}_{v}"), 2).alias(f"{k}_{v}") for v in VARS for k in ("exp", "exp_lo", "exp_hi")],
        near(F.col("prob"), 3).alias("prob"), near(F.least("ts", F.lit(5.0)), 2).alias("ts"),
    )
    return rows.groupBy("station").agg(F.array_sort(F.collect_list(point)).alias("points"))


def station_directory(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """station, city, lon, lat and its neighbours (nb, lon, lat, km in whole), nearest first."""
    there = stations.select(F.col("station").alias("nb"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"))
    near = edges.join(there, "nb").groupBy("station").agg(F.array_sort(F.collect_list(F.struct("rank", "nb", F.col("nlon").alias("lon"), F.col("nlat").alias("lat"), F.round("km", 0).alias("km")))).alias("neighbours"))
    return stations.select("station", "city", "lon", "lat").join(near, "station", "left")
