"""The layers of evidence over the derived panel, each built on the one before."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import VARS
from ..operators import evidence, features, fusion, incidents, inject, models, neighbours, profile, qc
from ..sources.scratch import delete, scratch_path
from . import fixtures


#: Layers that later ones or several queries read: written once, as Parquet in the scratch folder, and read back, so that
#: plans stay short, readers take the columns they need, and a lost executor costs no layer.  What a row and its station's
#: profile tell is worked out on reading and never stored, and features, one pass over the panel, are made where they are read.
STORED = {"panel", "stations", "climate", "edges", "ends", "starts", "near", "spatial", "flagged", "alerts", "weather", "incidents", "clean", "lesson", "trial", "judged", "vector"}

#: Slices that incidents are worked out in: their evidence is shuffled twice, in wide rows.
SLICES = 3

#: Spark's setting that a query's shuffle files go when it is done: a layer's, as soon as it is written.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Of the panel and of the history, what the layers after the neighbours need.
PANEL, HISTORY = ["station", "minute", "city", "wx", *[f"{v}_raw" for v in VARS], "anom"], [f"{k}_{v}" for k in ("d1", "innov", "dsd", "run") for v in VARS] + ["td_innov"]


def _with_ts(featured: DataFrame) -> DataFrame:
    return featured.withColumn("ts", F.least(F.lit(8.0), F.coalesce(F.abs("innov_T") / 0.6, F.lit(0.0))))


def _ts_of(found: dict[str, np.ndarray]) -> np.ndarray:
    return np.minimum(8.0, np.nan_to_num(np.abs(found["innov_T"]) / 0.6))


class Layers:
    """DataFrames by name, made when first asked for; ``ts`` and ``p_model`` are fixed functions of the evidence here, so that SQL can follow."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        self.made: dict[str, DataFrame] = {}
        self.paths: list[str] = []

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(type(self), f"make_{name}"):
            raise AttributeError(name)
        if name not in self.made:
            made = getattr(self, f"make_{name}")()
            self.made[name] = self._stored(name, made) if name in STORED else made
        return self.made[name]

    def _stored(self, name: str, made: DataFrame | Iterable[DataFrame]) -> DataFrame:
        """``made``, or its slices one after the other, written and read back."""
        slices = [made] if isinstance(made, DataFrame) else made  # a DataFrame could be iterated too: over its columns
        path = scratch_path(self.spark, f"layer-{name}")
        was = self.spark.conf.get(CLEANED, None)
        self.spark.conf.set(CLEANED, "true")
        try:
            for df in slices:
                df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANED) if was is None else self.spark.conf.set(CLEANED, was)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.made.clear()
        self.paths.clear()

    def make_panel(self):
        return fixtures.panel(self.spark, self.sf)

    def make_stations(self):
        return fixtures.stations(self.spark, self.sf)

    def make_checked(self):
        return qc.checked(self.panel)

    def make_climate(self):
        return profile.climate_profile(self.checked)

    def make_features(self):
        return _with_ts(features.features(self.checked, self.climate))

    def make_vector(self):
        """The one table of features that is stored: its scale and its models read it many times."""
        return features.feature_vector(self.features)

    def make_anomaly(self):
        return models.fit_anomaly(self.vector)

    def make_anomalies(self):
        return neighbours.anomalies(self.features)

    def make_edges(self):
        return neighbours.build_neighbours(self.stations)

    def make_ends(self):
        return evidence.day_ends(self.checked)

    def make_starts(self):
        return evidence.day_starts(self.checked, self.ends)

    def make_near(self):
        """The columns that neighbours and history give; all others follow from a row (see ``make_residuals``)."""
        return evidence.near_rows(self.checked, self.climate, self.edges, self.starts, PANEL, [*HISTORY, *neighbours.SUPPORT], _ts_of)

    def make_residuals(self):
        again = features.with_dewpoint(features.with_climate(qc.checked(self.near), self.climate))
        known = neighbours.anomalies(_with_ts(features.flags(again)))
        return neighbours.residuals(known.withColumn("has_nb", F.col("nn") >= 2))

    def make_spatial(self):
        return profile.spatial_profile(self.residuals)

    def make_z(self):
        return neighbours.spatial_z(self.residuals, self.spatial)

    def make_scored(self):
        return qc.hard_and_instant(self.z.withColumn("p_model", F.least(F.lit(1.0), F.coalesce(F.abs("zL_T"), F.lit(0.0)) / 8)))

    def make_flagged(self):
        return self.scored.where("prob >= 0.5").select("station", "minute")

    def make_second(self):
        """The second pass: neighbours that were flagged in the last half hour don't speak."""
        raw = ["station", "minute", *[f"{v}_raw" for v in VARS]]
        rows = evidence.near_rows(self.checked, self.climate, self.edges, self.starts, raw, [*[f"innov_{v}" for v in VARS], *neighbours.SUPPORT, "excluded"], _ts_of, self.flagged)
        again = neighbours.anomalies(features.with_climate(qc.checked(rows), self.climate)).withColumn("has_nb", F.col("nn") >= 2)
        return neighbours.spatial_z(neighbours.residuals(again), self.spatial)

    def make_expected(self):
        return neighbours.deviation_native(neighbours.expected_series(self.scored))

    def make_alerts(self):
        return incidents.detect_runs(self.scored, F.col("prob") >= 0.7, F.col("instant"))

    def make_masked(self):
        return incidents.fault_minutes(self.scored, self.alerts)

    def make_weather(self):
        return incidents.weather_runs(self.masked)

    def make_incidents(self):
        """In slices of stations, one after the other: only one slice's wide rows of evidence are on disk at a time."""
        part = F.pmod(F.xxhash64("station"), F.lit(SLICES))
        return (incidents.incidents(self.expected.where(part == i), self.edges, self.alerts.where(part == i), self.panel) for i in range(SLICES))

    def make_clean(self):
        return fixtures.clean(self.spark, self.sf)

    def make_lesson(self):
        return inject.inject(self.clean, inject.random_plan(self.clean, seed=1), seed=100)

    def make_judge(self):
        """All that is learned: from the clean panel, and from one draw of labelled faults."""
        return fusion.QualityModel.fit(self.clean, self.stations).calibrate(self.lesson)

    def make_trial(self):
        """Another draw of faults, which the judge has not seen."""
        return inject.inject(self.clean, inject.random_plan(self.clean, seed=2), seed=200)

    def make_judged(self):
        return self.judge.score(self.trial)


_last: dict[tuple[str, str], Layers] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The layers over ``sf_dir``; those of the last folder are kept for the next query of this application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _last:
        for old in _last.values():
            if old.spark.sparkContext.applicationId == key[0]:
                old.release()
        _last.clear()
        _last[key] = Layers(spark, sf_dir)
    return _last[key]


def forget() -> None:
    """Deletes the layers that are kept."""
    for old in _last.values():
        old.release()
    _last.clear()
