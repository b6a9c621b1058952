"""Live monitoring: the batch job over a rolling window, one micro-batch at a time.

A station's verdict needs its neighbours, so state by station is not enough: the last minutes of all stations are a table,
written anew for each micro-batch under its id.  A batch that is run again reads the table of the batch before and writes
the same rows to the same place, so a replay changes nothing.

The time is what stations agree on, not the newest reading: one wrong clock moves nothing, and after a standstill of any
length the stations that come back move it on.  A reading ahead of the time waits until others reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import THRESHOLD
from ..operators import incidents
from ..sources.scratch import delete
from ..sources.tables import densify, first_per_minute

STATE = "station string, minute long, T_raw double, P_raw double, RH_raw double"


def final_minutes(packets: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of packets without repeats; what comes after the watermark has passed its minute stays a gap."""
    stamped = packets.withColumn("minute_start", F.date_trunc("minute", "time"))
    return stamped.withWatermark("time", late).dropDuplicatesWithinWatermark(["station", "minute_start"]).drop("minute_start")


CLOCK = "minute long"
EMITTED = "station string, onset long, detect long, end long, ongoing boolean, type string, updated boolean, at long"


class Monitor:
    """``score`` turns dense rows (station, minute, T_raw, P_raw, RH_raw) into rows with prob and instant.

    State is bounded: ``window`` minutes of readings, those that wait (as many minutes a station at most), and the alerts that a
    re-check may still ask for.  A batch of up to ``catch_up`` new minutes is scored minute by minute, as if each had come
    alone.  One that brings more (a first batch with history, or after a standstill) is scored in passes of ``span`` minutes.

    The time moves on to a minute that a quarter of the stations that have something new have reached (that is, which have a
    reading there or up to ``ahead`` minutes later); over more than ``ahead`` minutes it takes two stations at least, more
    than go on as before, and readings of ``steady`` minutes, or where one station alone speaks, ``alone`` minutes of its own.  Readings more than ``ahead`` minutes after the time wait; those
    older than the window before it come too late and don't count.
    """

    def __init__(self, spark: SparkSession, stations: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, window: int = 150, warmup: int = 90, recheck: tuple[int, ...] = (15, 30), classify: Callable[[DataFrame, DataFrame], DataFrame] | None = None, catch_up: int = 5, ahead: int = 10, alone: int = 30, steady: int = 3, span: int = 1440, compact: int = 50):
        self.spark, self.stations, self.score, self.folder = spark, stations.select(F.col("station").cast("string").alias("station")), score, folder.rstrip("/")
        self.window, self.warmup, self.recheck, self.classify, self.catch_up, self.ahead, self.alone, self.steady, self.span, self.compact = window, warmup, recheck, classify, catch_up, ahead, alone, steady, span, compact

    def _table(self, name: str, batch: int, schema: str) -> DataFrame:
        """What batch ``batch`` wrote; empty before the first."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={batch}")

    def _write(self, df: DataFrame, name: str, batch: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        return self._table(name, batch, schema)

    def alerts(self) -> DataFrame:
        """All alerts so far."""
        return self.spark.read.schema(EMITTED).parquet(f"{self.folder}/alerts/*").distinct()

    def _agreed(self, new: DataFrame, before: int | None) -> int | None:
        """The latest minute that enough stations have reached; ``new``: station and minute of what came or waits."""
        seen = new.select("station", "minute").distinct()
        near = F.lit(False)
        if before is not None:
            seen, near = seen.where(F.col("minute") > before), F.col("minute") <= before + self.ahead
        seen = seen.withColumn("near", near)
        voices = seen.agg(F.count_distinct("station").alias("all"), F.count_distinct(F.when(F.col("near"), F.col("station"))).alias("near"), F.count_distinct("minute").alias("minutes"), F.count_distinct(F.when(~F.col("near"), F.col("minute"))).alias("far")).first()
        if not voices["all"]:
            return before
        lone = voices["all"] == 1
        # a station has reached a minute if it has a reading there or up to ``ahead`` minutes later; alone, the minutes before count
        who, low, high = ("minute", 0, self.alone - 1) if lone else ("station", -self.ahead, 0)
        reached = seen.select(F.col(who).alias("who"), F.explode(F.sequence(F.col("minute") + low, F.col("minute") + high)).alias("at"), F.col("minute").alias("m"))
        held = reached.groupBy("at").agg(F.count_distinct("who").alias("n"), F.max((F.col("at") == F.col("m")).cast("int")).alias("real"))
        quarter = lambda n: -(-n // 4)
        if lone:
            far = max(1, min(self.alone, voices["minutes"]) // 2) if before is None else self.alone
        else:
            far = max(2, quarter(voices["all"]), voices["near"] + 1)  # who goes on as before outvotes as many that leap
        if before is not None and voices["far"] < self.steady:
            far = 1 << 30
        real = held.where("real = 1")
        leap = real.where(F.col("n") >= far).agg(F.max("at").alias("m")).first().m
        if before is None:
            return leap
        # going on as before: from minute to minute, no two of them more than ``ahead`` apart
        order = Window.orderBy("at")
        steps = real.where(F.col("n") >= (1 if lone else max(1, quarter(voices["near"])))).withColumn("gap", F.col("at") - F.lag("at", 1, before).over(order))
        went = steps.withColumn("broken", F.sum((F.col("gap") > self.ahead).cast("int")).over(order)).where("broken = 0").agg(F.max("at").alias("m")).first().m
        return max(m for m in (before, leap, went) if m is not None)

    def _spans(self, state: DataFrame, begin: int, now: int) -> list[tuple[int, int]]:
        """The passes over ``begin`` to ``now`` that have readings in reach; nothing is said of times when all were silent."""
        ends = F.array(F.col("minute"), F.col("minute") + self.window - 1)
        at = state.where(F.col("minute") <= now).select(F.explode(F.transform(ends, lambda m: F.floor((m - begin) / self.span))).alias("k")).distinct()
        return [(m, min(m + self.span - 1, now)) for m in sorted(begin + self.span * r.k for r in at.collect() if r.k >= 0) if m <= now]

    def _forget(self, batch_id: int) -> None:
        """Folders of batches that no replay reads go; alerts of many batches become one folder."""
        if batch_id < 1:
            return
        delete(self.spark, f"{self.folder}/arrived/batch={batch_id - 1}")
        delete(self.spark, f"{self.folder}/parts/of={batch_id - 1}")
        if batch_id < 2:
            return
        for name in ("state", "waiting", "clock", "emitted"):
            delete(self.spark, f"{self.folder}/{name}/batch={batch_id - 2}")
        if self.compact and batch_id % self.compact == 0:
            upto = range(max(0, batch_id - self.compact - 1), batch_id - 1)
            folders = [f"{self.folder}/alerts/batch={i}" for i in upto]
            self.spark.read.schema(EMITTED).option("ignoreMissingFiles", "true").parquet(*folders).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/alerts/upto={batch_id - 2}")
            for path in folders:
                delete(self.spark, path)

    def process(self, rows: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``.  ``rows``: station, time, T_raw, P_raw, RH_raw.  Batch ids count from 0 without gaps."""
        old, waited, kept = self._table("state", batch_id - 1, STATE), self._table("waiting", batch_id - 1, STATE), self._table("emitted", batch_id - 1, EMITTED)
        clock = self._table("clock", batch_id - 1, CLOCK).first()
        before = clock.minute if clock else None
        arrived = first_per_minute(rows.withColumn("ingest", F.monotonically_increasing_id())).select(F.col("station").cast("string").alias("station"), "minute", "T_raw", "P_raw", "RH_raw")
        # The micro-batch is read once; what waited came first.
        arrived = self._write(arrived, "arrived", batch_id, STATE)
        new = waited.unionByName(arrived.join(waited.select("station", "minute"), ["station", "minute"], "left_anti"))
        now = self._agreed(new, before)
        limit = self.ahead + (now if now is not None else -(1 << 60))
        newest = Window.partitionBy("station").orderBy(F.desc("minute"))
        waiting = new.where(F.col("minute") > limit).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= self.window).drop("n")
        self._write(waiting, "waiting", batch_id, STATE)
        fresh = new.where(F.col("minute") <= limit)
        if before is not None:
            fresh = fresh.where(F.col("minute") > before - self.window)
        merged = old.unionByName(fresh.join(old.select("station", "minute"), ["station", "minute"], "left_anti"))
        first = merged.where(F.col("minute") <= limit - self.ahead).agg(F.min("minute").alias("m")).first().m if now is not None else None
        # one batch may hold several minutes: the window of the oldest new one must still be there
        begin = None if first is None else first if before is None else before + 1
        state = self._write(merged if begin is None else merged.where(F.col("minute") > begin - self.window), "state", batch_id, STATE)
        self._write(self.spark.createDataFrame([(now,)] if now is not None else [], CLOCK), "clock", batch_id, CLOCK)
        found = self._table("emitted", -1, EMITTED)
        if begin is not None and now != before:
            begin = max(begin, first + self.warmup - 1)
            spans = [(m, m) for m in range(begin, now + 1)] if now - begin < self.catch_up else self._spans(state, begin, now)
            for start, last in spans:
                new = self._found(state, kept.unionByName(found), start, last)
                found = found.unionByName(self._write(new, f"parts/of={batch_id}/minute={last}", 0, EMITTED))
        found = self._write(found, "alerts", batch_id, EMITTED)
        earliest = -(1 << 60) if now is None else now - max(self.recheck, default=0)
        self._write(kept.unionByName(found).where(F.col("detect") >= earliest), "emitted", batch_id, EMITTED)
        self._forget(batch_id)

    def _found(self, state: DataFrame, kept: DataFrame, first: int, last: int) -> DataFrame:
        """Alerts that begin in the minutes ``first`` to ``last``, and earlier ones whose type a due re-check changes."""
        inside = state.where((F.col("minute") <= last) & (F.col("minute") > first - self.window))
        scored = self.score(densify(inside, self.stations))
        runs = incidents.detect_runs(scored, F.col("prob") >= THRESHOLD, F.col("instant"), panel=inside)  # the newest minute needs no scores
        asked = F.filter(F.array(*[F.col("detect") + k for k in self.recheck]), lambda m: (m >= first) & (m <= last) & (F.col("end") >= m)) if self.recheck else F.array().cast("array<bigint>")
        due = runs.withColumn("again", F.array_max(asked)).where(F.col("detect").between(first, last) | F.col("again").isNotNull())
        typed = self.classify(due, scored) if self.classify else due.withColumn("type", F.lit("?"))
        new = F.col("detect").between(first, last)
        said = typed.select("station", "onset", "detect", "end", "ongoing", "type", (~new).alias("updated"), F.when(new, F.col("detect")).otherwise(F.col("again")).alias("at"))
        seen = kept.groupBy(F.col("station").alias("s"), F.col("detect").alias("d")).agg(F.max_by("type", "at").alias("last_type"))
        met = said.join(seen, (F.col("station") == F.col("s")) & (F.col("detect") == F.col("d")), "left")
        return met.where("NOT updated OR (last_type IS NOT NULL AND last_type <> type)").drop("s", "d", "last_type")

    def start(self, stream: DataFrame, checkpoint: str, late: str = "10 minutes", **trigger):
        """Runs on a stream of readings; repeated ones and those later than ``late`` don't count."""
        writer = final_minutes(stream, late).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
