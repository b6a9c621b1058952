"""Boosted trees on histograms, for a label of 0 or 1 with weights.

Values are cut into at most 255 bins once; after that a tree needs only sums of gradients, Hessians and rows by node, feature and
bin.  Each block of rows gives its own, Spark adds them up, and the driver picks the cuts: it never sees a row.  Of two children,
only the smaller one is summed; the other is what the parent has left.  Rows that all fit one block (a million) are
grown in the one task that holds them, with the same code and the same trees, since a job a level would only add waiting.
More rows, up to ``HELD`` blocks a core, are grown in one barrier stage: each task holds its blocks, and after each level all tasks
exchange their sums and pick the same cuts.  Only beyond that, blocks lie in the scratch folder and a level is a job.
"""

from __future__ import annotations

import base64
import math
import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import delete, scratch_path

#: Rows of a block.
BLOCK_ROWS = 1 << 20
#: Blocks that a task of a barrier stage holds at most, 80 bytes a row.
HELD = 8
#: Bins; the last one is for missing values.
BINS = 256
#: Trees after which blocks are stored anew with their scores, where there are several.
REFRESH = 10


@dataclass
class Tree:
    """A full binary tree in heap order: feature (-1: a leaf), the last bin that goes left, and the value of a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.last, self.value = np.full(n, -1, np.int16), np.full(n, BINS, np.int16), np.zeros(n)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + 1 + (codes[rows, np.maximum(self.feature[at], 0)] > self.last[at]), at)
        return at


@dataclass
class BoostedTrees:
    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values."""
        out = np.empty(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), BINS - 1, np.searchsorted(edges, x[:, f], "left"))
        return out

    def raw(self, codes: np.ndarray) -> np.ndarray:
        total = np.full(len(codes), self.base)
        for tree in self.trees:
            total += tree.value[tree.leaves(codes)]
        return total

    def probability(self, *columns: Column) -> Column:
        """The probability of label 1, from the columns of the features; evaluated in Arrow batches of these columns alone."""
        shared = None

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series(1 / (1 + np.exp(-model.raw(model.codes(np.column_stack([v.to_numpy(float) for v in values]))))))

        from pyspark.sql import SparkSession

        shared = SparkSession.getActiveSession().sparkContext.broadcast(self)
        return score(*columns)


class Block:
    """Rows with their scores so far.  ``held`` rows only tell when to stop."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, raw: np.ndarray):
        self.codes, self.y, self.w, self.held, self.raw = codes, y, w, held, raw
        self.columns = np.ascontiguousarray(codes.T)
        self.tree = None
        self.refresh()

    def nodes(self, tree: Tree) -> np.ndarray:
        """The node of each row, as far as ``tree`` has grown: rows go on from where they were at the last call."""
        if self.tree is not tree:
            self.tree, self.at, self.moving = tree, np.zeros(len(self.y), np.int64), np.arange(len(self.y))
        while True:
            feature = tree.feature[self.at[self.moving]]
            rows = self.moving[feature >= 0]
            if not len(rows):
                return self.at
            at = self.at[rows]
            self.at[rows] = 2 * at + 1 + (self.codes[rows, feature[feature >= 0]] > tree.last[at])
            self.moving = rows  # the others are in leaves

    def refresh(self) -> None:
        p = 1 / (1 + np.exp(-self.raw))
        self.g, self.h = self.w * (p - self.y), self.w * p * (1 - p)

    def loss(self) -> np.ndarray:
        """Sum and weight of the loss over held rows."""
        r, y, w = self.raw[self.held], self.y[self.held], self.w[self.held]
        return np.array([(w * (np.logaddexp(0, r) - y * r)).sum(), w.sum()])

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        """(node, feature, bin, 3): gradient, Hessian and number of rows in training."""
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        at = place[self.nodes(tree)]
        rows = np.flatnonzero((at >= 0) & ~self.held)
        base, g, h = at[rows] * BINS, self.g[rows], self.h[rows]
        out = np.empty((len(nodes), len(self.columns), BINS, 3))
        for f, column in enumerate(self.columns):
            cell, n = base + column[rows], len(nodes) * BINS
            for k, weights in enumerate((g, h, None)):
                out[:, f, :, k] = np.bincount(cell, weights, n).reshape(len(nodes), BINS)
        return out

    def add(self, trees: list[Tree]) -> None:
        for tree in trees:
            self.raw += tree.value[self.nodes(tree)]
        self.refresh()


def _best_cut(sums: np.ndarray, least: int, l2: float) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of one node's (feature, bin, 3), or None."""
    total = sums[0].sum(axis=0)
    left = sums.cumsum(axis=1)[:, :-1]
    right = total - left
    ok = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= 1e-3) & (right[..., 1] >= 1e-3)
    gain = np.where(ok, left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else None


def grow(source, depth: int, rate: float, l2: float, least: int) -> tuple[Tree, np.ndarray]:
    """One tree, level by level, and the loss of held rows before it.  ``source(tree, nodes)`` gives the sums over all rows, and the loss."""
    tree = Tree(depth)
    sums, loss = source(tree, [0])
    have = {0: sums[0]}
    for _ in range(depth):
        smaller, parents = [], {}
        for node, s in have.items():
            cut = _best_cut(s, least, l2)
            total = s[0].sum(axis=0)
            tree.value[node] = -rate * total[0] / (total[1] + l2)
            if cut:
                _, tree.feature[node], tree.last[node] = cut
                left = s[cut[1], : cut[2] + 1].sum(axis=0)
                small = 2 * node + 1 if left[2] <= total[2] - left[2] else 2 * node + 2
                smaller.append(small)
                parents[small] = s
        have = {}
        if not smaller:
            break
        found = source(tree, smaller)[0]
        for small, s in zip(smaller, found):
            have[small] = s
            have[small - 1 if small % 2 == 0 else small + 1] = parents[small] - s
    for node, s in have.items():
        total = s[0].sum(axis=0)
        tree.value[node] = -rate * total[0] / (total[1] + l2)
    return tree, loss


def boost(model: BoostedTrees, source, push, rounds: int, depth: int, rate: float, l2: float, least: int, patience: int) -> None:
    """Trees until ``rounds``, or until the held rows' loss hasn't fallen by 1e-7 in ``patience`` trees (0: no stop)."""
    losses = []
    for _ in range(rounds):
        tree, (total, weight) = grow(source, depth, rate, l2, least)
        if patience and weight:
            losses.append(total / weight)
            if len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - 1e-7:
                return
        model.trees.append(tree)
        push(tree)


def bin_edges(rows: DataFrame, features: list[str], accuracy: int = 10_000) -> tuple[list[np.ndarray], int]:
    """At most 254 edges a feature, by sketches of a fixed size, and the number of rows; one pass."""
    at = [(k + 1) / (BINS - 1) for k in range(BINS - 2)]
    found = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), at, accuracy).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] if found[c] is not None else [], float)) for c in features], found["n"]


def _frames(record: dict, n: int) -> Block:
    y = np.frombuffer(record["y"])
    return Block(np.frombuffer(record["codes"], np.uint8).reshape(len(y), n), y, np.frombuffer(record["w"]), np.frombuffer(record["held"], bool), np.frombuffer(record["raw"]).copy())


def _packed(b: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (b.codes, b.y, b.w, b.held, b.raw)], names=["codes", "y", "w", "held", "raw"])


BLOCK_SCHEMA = "codes binary, y binary, w binary, held binary, raw binary"


def fit(rows: DataFrame, features: list[str], label: str = "label", weight: str = "weight", held: str = "held", rounds: int = 180, depth: int = 5, rate: float = 0.08, l2: float = 1.0, least: int = 40, patience: int = 10, block_rows: int = BLOCK_ROWS) -> BoostedTrees:
    """Trees on all ``rows``: double features (null: missing, greater than any value), label 0 or 1, weight over 0, held: kept out of training.

    With no held row nothing stops the rounds.  Rows of one label alone, or none, give a constant.
    """
    spark, n = rows.sparkSession, len(features)
    rows = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in features], F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    edges, count = bin_edges(rows, features)
    ones = rows.where("NOT held").agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
    share = min(max((ones[0] or 0.0) / (ones[1] or 1.0), 1e-12), 1 - 1e-12)
    model = BoostedTrees(edges, math.log(share / (1 - share)))
    if not count:
        return model
    pieces = -(-count // block_rows)

    def pack(batches):
        held = []
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            x = np.column_stack(values[:n])
            held.append([model.codes(x), *(v.astype(k) for v, k in zip(values[n:], (float, float, bool)))])
            if sum(len(h[1]) for h in held) >= block_rows:
                yield _packed(Block(*map(np.concatenate, zip(*held)), np.full(sum(len(h[1]) for h in held), model.base)))
                held = []
        if held:
            yield _packed(Block(*map(np.concatenate, zip(*held)), np.full(sum(len(h[1]) for h in held), model.base)))

    blocks = rows.repartition(pieces).mapInArrow(pack, BLOCK_SCHEMA)
    settings = {"rounds": rounds, "depth": depth, "rate": rate, "l2": l2, "least": least, "patience": patience}
    slots = spark.sparkContext.defaultParallelism
    elastic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"  # no barrier stages there
    if pieces == 1 or (pieces <= slots * HELD and not elastic):
        tasks = 1 if pieces == 1 else min(slots, 2 * pieces)

        def whole(batches):
            held = [_frames(record, n) for batch in batches for record in batch.to_pylist()]
            context = BarrierTaskContext.get() if tasks > 1 else None

            def source(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
                total = np.zeros(len(nodes) * n * BINS * 3 + 2)
                for b in held:  # the loss is asked for before a tree only
                    total += np.r_[b.sums(tree, nodes).ravel(), b.loss() if nodes == [0] else np.zeros(2)]
                if context:  # in the order of the tasks, so that all add up alike
                    said = context.allGather(base64.b64encode(zlib.compress(total.tobytes(), 1)).decode())
                    total = np.sum([np.frombuffer(zlib.decompress(base64.b64decode(m))) for m in said], axis=0)
                return total[:-2].reshape(len(nodes), n, BINS, 3), total[-2:]

            def push(tree: Tree) -> None:
                for b in held:
                    b.add([tree])

            boost(model, source, push, **settings)
            if context is None or context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        dealt = blocks if tasks == pieces else rows.repartition(tasks).mapInArrow(pack, BLOCK_SCHEMA)
        return pickle.loads(dealt.mapInArrow(whole, "model binary", barrier=tasks > 1).collect()[0][0])

    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "boosting"))
        df.write.parquet(paths[-1])
        for old in paths[:-1]:
            delete(spark, old)
        del paths[:-1]
        return spark.read.schema(BLOCK_SCHEMA).parquet(paths[-1])

    state = {"blocks": keep(blocks), "new": []}

    def source(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        new, size = list(state["new"]), len(nodes) * n * BINS * 3

        def run(batches):
            total = np.zeros(size + 2)
            for batch in batches:
                for record in batch.to_pylist():
                    b = _frames(record, n)
                    b.add(new)
                    total += np.r_[b.sums(tree, nodes).ravel(), b.loss()]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

        got, out = state["blocks"].mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow(), np.zeros(size + 2)
        out[got.column("at").to_numpy()] = got.column("value").to_numpy()
        return out[:-2].reshape(len(nodes), n, BINS, 3), out[-2:]

    def push(tree: Tree) -> None:
        state["new"].append(tree)
        if len(state["new"]) >= REFRESH:
            new = list(state["new"])

            def run(batches):
                for batch in batches:
                    for record in batch.to_pylist():
                        b = _frames(record, n)
                        b.add(new)
                        yield _packed(b)

            state["blocks"], state["new"] = keep(state["blocks"].mapInArrow(run, BLOCK_SCHEMA)), []

    boost(model, source, push, **settings)
    for path in paths:
        delete(spark, path)
    return model
