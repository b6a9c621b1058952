"""The learned weighing of all evidence, in two stages of boosted trees; and the scorer that strings it together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import WARMUP
from ..sources.scratch import delete
from ..sources.scratch import stored as _written
from . import boosting, features, models, neighbours, profile, qc


def training_weights(labels: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """``labels`` (station, minute, anom) plus weight: 0 in the warm-up, in the first third of a drift and in the 8 rows after any fault; else 1."""
    w = Window.partitionBy("station").orderBy("minute")
    run = Window.partitionBy("station", "island")
    fresh = F.coalesce(F.col("anom") != F.lag("anom").over(w), F.lit(True)).cast("long")
    rows = labels.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"at": F.row_number().over(run.orderBy("minute")) - 1, "n": F.count("*").over(run), "row": F.row_number().over(w) - 1, "before": F.lag("anom").over(w)})
    ended = F.max(F.when((F.col("fresh") == 1) & (F.col("before") != ""), F.col("row"))).over(w.rowsBetween(-7, 0))
    drift = (F.col("anom") == "drift") & (F.col("at") < F.floor(F.col("n") / 3))
    weight = F.when((F.col("row") < warmup) | drift | ended.isNotNull(), 0.0).otherwise(1.0)
    return rows.withColumn("weight", weight).drop("fresh", "island", "at", "n", "row", "before")


def training_rows(evidence: DataFrame, seed: int = 0) -> DataFrame:
    """FUSION columns, label, weight and held: every row of some weight as it is, and again with its neighbours hidden at 0.35 of the weight; faults count three times.

    A tenth of the rows, by a hash of their key, is held out of training and tells when to stop; both forms of a row go the same way.
    """
    seen = evidence.where("weight > 0")
    y = (F.col("anom") != "").cast("double")
    held = F.pmod(F.xxhash64("station", "minute", F.lit(seed)), F.lit(10)) == 0
    shown = features.fusion_features(seen).select(*features.FUSION, y.alias("label"), "weight", held.alias("held"))
    hidden = features.fusion_features(seen, isolate=True).select(*features.FUSION, y.alias("label"), (F.col("weight") * 0.35).alias("weight"), held.alias("held"))
    return shown.unionByName(hidden).withColumn("weight", F.when(F.col("label") == 1, F.col("weight") * 3).otherwise(F.col("weight")))


def fit_stage(evidence: DataFrame, rounds: int = 180, depth: int = 5, seed: int = 0) -> boosting.BoostedTrees:
    """Boosted trees on all labelled rows of some weight (station, minute, …): steps of 0.08, an L2 of 1.0, 40 rows a leaf at least."""
    rows, path = _written(training_rows(evidence, seed), "training")
    model = boosting.fit(rows, features.FUSION, rounds=rounds, depth=depth)
    delete(evidence.sparkSession, path)
    return model


def probability(evidence: DataFrame, model: boosting.BoostedTrees) -> DataFrame:
    """``evidence`` plus p_model."""
    scored = features.fusion_features(evidence)
    return scored.withColumn("p_model", model.probability(*[F.col(c) for c in features.FUSION])).drop(*features.FUSION)


@dataclass
class QualityModel:
    """All that was learned: two tables and three small models.  The fusion doesn't know stations, so it fits other networks too."""

    edges: DataFrame
    climate: DataFrame
    spatial: DataFrame
    anomaly: models.AnomalyModel
    first: boosting.BoostedTrees | None = None
    second: boosting.BoostedTrees | None = None

    @classmethod
    def fit(cls, history: DataFrame, stations: DataFrame, sample: int = 70_000, trees: int = 120, epochs: int = 80, least: int = 500) -> QualityModel:
        """From clean, dense history: station, minute, T_raw, P_raw, RH_raw."""
        checked = qc.checked(history)
        climate, _ = _written(profile.climate_profile(checked), "climate")
        featured, path = _written(features.features(checked, climate), "features")
        edges, _ = _written(neighbours.build_neighbours(stations), "edges")
        resid = neighbours.residuals(neighbours.neighbour_support(neighbours.anomalies(featured.withColumn("ts", F.lit(0.0))), edges))
        spatial, _ = _written(profile.spatial_profile(resid, least), "spatial")
        model = cls(edges, climate, spatial, models.fit_anomaly(features.feature_vector(featured), sample, trees, epochs))
        delete(history.sparkSession, path)
        return model

    def evidence(self, obs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Evidence of the first pass.  An empty ``edges`` shows what is lost without neighbours.

        Steps that later ones read more than once are written to the scratch folder, here and in :meth:`second_pass`; they stay as long as it does.
        """
        featured, _ = _written(features.features(qc.checked(obs), self.climate), "features")
        ts = models.anomaly_scores(features.feature_vector(featured), self.anomaly)
        rows, _ = _written(neighbours.anomalies(featured.join(ts, ["station", "minute"])), "anomalies")  # read from both sides of the neighbours
        return self._spatial(rows, self.edges if edges is None else edges)

    def _spatial(self, rows: DataFrame, edges: DataFrame, hidden=None) -> DataFrame:
        return neighbours.spatial_z(neighbours.residuals(neighbours.neighbour_support(rows, edges, hidden)), self.spatial)

    def second_pass(self, evidence: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Evidence again, without neighbours that the first stage flagged within 30 rows."""
        p = F.when(qc.hard(), F.greatest("p_model", F.lit(0.99))).otherwise(F.col("p_model"))
        marked = evidence.withColumn("excluded", features.recently(p >= 0.5))
        spatial = [c for c in marked.columns if c.split("_")[0] in ("med", "medI", "spread", "res", "resI", "offt", "sig", "sigI", "zL", "zI")] + ["nn", "has_nb", "nb_ts", "p_model"]
        rows, _ = _written(marked.drop(*spatial), "marked")
        return self._spatial(rows, self.edges if edges is None else edges, F.col("excluded"))

    def calibrate(self, obs: DataFrame, rounds: int = 180, warmup: int = WARMUP) -> QualityModel:
        """Both stages from observations with labelled faults (anom)."""
        rows = training_weights(obs.select("station", "minute", "anom"), warmup)
        seen, path = _written(self.evidence(obs).join(rows.select("station", "minute", "weight"), ["station", "minute"]), "evidence")
        self.first = fit_stage(seen, rounds)
        self.second = fit_stage(self.second_pass(probability(seen, self.first)), rounds)
        delete(obs.sparkSession, path)
        return self

    def reuse_fusion(self, other: QualityModel) -> QualityModel:
        self.first, self.second = other.first, other.second
        return self

    def score(self, obs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """All evidence with p_model, hard, instant and prob, the expected series and the deviations."""
        seen, _ = _written(probability(self.evidence(obs, edges), self.first), "evidence")
        done = qc.hard_and_instant(probability(self.second_pass(seen, edges), self.second))
        return neighbours.deviation_native(neighbours.expected_series(done))
