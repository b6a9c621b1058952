"""Unusualness of a feature vector: an isolation forest and an autoencoder.

Both are fitted on a bounded sample (``sample_rows``: 70,000 rows of 17 numbers) on the driver and scored in Arrow batches
on all rows.  Scores are 1 at the edge of the ordinary: the 99.9th percentile over all complete rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profile
from .features import VECTOR


def sample_rows(vector: DataFrame, n: int = 70_000, seed: int = 0) -> DataFrame:
    """At most ``n`` complete rows, without replacement, by a hash of their key: the same ones every time."""
    return vector.where("complete").orderBy(F.md5(F.concat_ws("-", F.col("station").cast("string"), F.col("minute").cast("string"), F.lit(str(seed)))), "station", "minute").limit(n)


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    trees: int = 120
    rows: int = 512
    seed: int = 0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        take = min(self.rows, len(x))
        self.top, self.norm = max(1, int(np.ceil(np.log2(max(2, take))))), max(_path(take), 1e-9)
        for _ in range(self.trees):
            feature, cut, depth = (np.full(2 ** (self.top + 1) - 1, fill, kind) for fill, kind in ((-1, np.int64), (np.inf, float), (0.0, float)))
            todo = [(0, 0, x[rng.choice(len(x), take, replace=False)])]
            while todo:
                at, level, part = todo.pop()
                spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
                if level == self.top or not len(spread):
                    depth[at] = level + _path(len(part))
                    continue
                f = int(rng.choice(spread))
                c = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[at], cut[at] = f, c
                right = part[:, f] > c
                todo += [(2 * at + 1, level + 1, part[~right]), (2 * at + 2, level + 1, part[right])]
            self.nodes.append((feature, cut, depth))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: the higher, the fewer cuts isolate a row."""
        total, start, flat = np.zeros(len(x)), np.arange(len(x)) * x.shape[1], x.ravel()
        for feature, cut, depth in self.nodes:
            # a leaf over the last level goes on to the left, to the node that has its depth
            feature, depth, at = np.maximum(feature, 0), depth.copy(), np.zeros(len(x), np.int64)
            for level in range(self.top):
                ended = np.arange(2**level - 1, 2 ** (level + 1) - 1)[cut[2**level - 1 : 2 ** (level + 1) - 1] == np.inf]
                depth[2 * ended + 1] = depth[ended]
            for _ in range(self.top):
                at = 2 * at + 1 + (flat[start + feature[at]] > cut[at])
            total += depth[at]
        return 2.0 ** (-total / max(1, len(self.nodes)) / self.norm)


@dataclass
class Autoencoder:
    sizes: tuple[int, ...] = (14, 5, 14)
    epochs: int = 80
    seed: int = 0
    patience: int = 6
    layers: list[list[np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if k == len(self.layers) - 1 else np.tanh(z))
        return out

    def fit(self, x: np.ndarray, batch: int = 256, rate: float = 2e-3) -> Autoencoder:
        """At most ``epochs`` passes; a tenth of the rows is held out, and after ``patience`` passes without a loss there that is lower by 1e-4 of it, training stops.  The best weights stay."""
        rng, x = np.random.default_rng(self.seed), np.clip(x, -10, 10)
        shuffled = x[rng.permutation(len(x))]
        held, x = shuffled[: len(x) // 10], shuffled[len(x) // 10 :]
        best, idle = None, 0
        widths = [x.shape[1], *self.sizes, x.shape[1]]
        self.layers = [[rng.normal(0, np.sqrt(1 / a), (a, b)), np.zeros(b)] for a, b in zip(widths, widths[1:])]
        moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in self.layers]
        step = 0
        for _ in range(self.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                outs, step = self._forward(x[at]), step + 1
                delta = 2 * (outs[-1] - x[at]) / max(1, len(at))
                for k in range(len(self.layers) - 1, -1, -1):
                    grads = [outs[k].T @ delta, delta.sum(axis=0)]
                    if k:
                        delta = delta @ self.layers[k][0].T * (1 - outs[k] ** 2)
                    for p, g, m in zip(self.layers[k], grads, moments[k]):
                        m[0] = 0.9 * m[0] + 0.1 * g
                        m[1] = 0.999 * m[1] + 0.001 * g * g
                        p -= rate * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            if not len(held):
                continue
            self.losses.append(float(((self._forward(held)[-1] - held) ** 2).mean()))
            idle = 0 if best is None or self.losses[-1] < best[0] * (1 - 1e-4) else idle + 1
            if best is None or self.losses[-1] < best[0]:
                best = (self.losses[-1], [[p.copy() for p in layer] for layer in self.layers])
            if idle >= self.patience:
                break
        if best:
            self.layers = best[1]
        return self

    def error(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -10, 10)
        return ((self._forward(x)[-1] - x) ** 2).mean(axis=1)


@dataclass
class AnomalyModel:
    scale: dict[str, tuple[float, float]]
    forest: IsolationForest
    coder: Autoencoder
    if_base: float = 0.0
    if_ref: float = 1.0
    ae_ref: float = 1.0


def _raw_scores(vector: DataFrame, model: AnomalyModel) -> DataFrame:
    """(station, minute, s_if, s_ae); null on incomplete rows."""
    shared = vector.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows in batches:
            full = rows["complete"].to_numpy(bool)
            out = np.full((2, len(rows)), np.nan)
            if full.any():
                x = rows.loc[full, VECTOR].to_numpy(float)
                out[0, full], out[1, full] = shared.value.forest.score(x), shared.value.coder.error(x)
            yield pd.DataFrame({"station": rows["station"], "minute": rows["minute"], "s_if": out[0], "s_ae": out[1]})

    scaled = profile.robust_scale(vector, model.scale).select("station", "minute", "complete", *VECTOR)
    found = scaled.mapInPandas(run, f"station {vector.schema['station'].dataType.simpleString()}, minute long, s_if double, s_ae double")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("s_if", "s_ae")})


def score_reference(vector: DataFrame, model: AnomalyModel) -> DataFrame:
    """One row: base, the median score of the forest over complete rows, and if_ref and ae_ref, the 99.9th percentiles of both scores; by sketches."""
    sketch = lambda c, at: F.percentile_approx(c, F.lit(at), F.lit(10_000))
    return _raw_scores(vector, model).agg(sketch("s_if", 0.5).alias("base"), sketch("s_if", 0.999).alias("if_ref"), sketch("s_ae", 0.999).alias("ae_ref"))


def fit_anomaly(vector: DataFrame, sample: int = 70_000, trees: int = 120, epochs: int = 80, seed: int = 0) -> AnomalyModel:
    """Scale, both models and their reference percentiles from clean history (see :func:`..features.feature_vector`)."""
    scale = profile.read_scale(vector)
    rows = profile.robust_scale(sample_rows(vector, sample, seed), scale).select(*VECTOR).toPandas().to_numpy(float)
    model = AnomalyModel(scale, IsolationForest(trees, seed=seed).fit(rows), Autoencoder(epochs=epochs, seed=seed).fit(rows))
    ref = score_reference(vector, model).first()
    model.if_base, model.if_ref, model.ae_ref = ref.base, ref.if_ref, ref.ae_ref
    return model


def anomaly_scores(vector: DataFrame, model: AnomalyModel) -> DataFrame:
    """(station, minute, ts_if, ts_ae, ts); 0 on incomplete rows."""
    s = _raw_scores(vector, model)
    ts_if = F.coalesce(F.greatest(F.lit(0.0), (F.col("s_if") - model.if_base) / max(model.if_ref - model.if_base, 1e-12)), F.lit(0.0))
    ts_ae = F.coalesce(F.col("s_ae") / max(model.ae_ref, 1e-12), F.lit(0.0))
    return s.select("station", "minute", ts_if.alias("ts_if"), ts_ae.alias("ts_ae"), F.greatest(ts_if, ts_ae).alias("ts"))
