"""Exact top-k search by inner product with a table of distances to pivots.

Pivots are chosen far apart from a bounded sample.  Every vector's distances to all pivots are computed once and stored with
it, in blocks of like vectors (by nearest pivot; a pivot that holds many is split into parts).  The triangle inequality
turns the table into a lower bound of any distance, the largest over all pivots, and with the norms into an upper bound of
any inner product.  A query is first compared with the sample, which gives it a score to beat; then only those pairs of
query block and candidate block meet whose bound reaches a score to beat, and within a pair candidates are evaluated in the
order of their bounds until the next bound is below it.  Where the bounds exclude little,
the whole pair is evaluated by one matrix product, which is cheaper than to follow the order.  Scores are exact whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, whole_numbers, width

#: Rows of a block of candidates or queries: 4 MB for 64 dimensions.
BLOCK_ROWS = 8192
#: Queries and candidates of a piece that is held at once as a matrix of scores.
PIECE = (256, 4096)
LEAST, LARGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def read_sample(rows: DataFrame, dims: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of at most ``size`` rows, by hash."""
    picked = rows.orderBy(F.xxhash64("x", "row"), "row").limit(size).select("row", "x").toArrow()
    return picked.column("row").to_numpy(), matrix(picked.column("x"), dims)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Up to ``pivots`` distinct vectors, each the farthest of the sample from those before."""
    x = sample.astype(float)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def pivot_table(rows: DataFrame, dims: int, centres: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(row, id, x, asked, far, cell, floor): distances to all pivots as bytes of doubles, the nearest pivot, and for queries the ``k``-th best score within the sample."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            square = (x.astype(float) ** 2).sum(axis=1)[:, None] - 2 * x.astype(float) @ centres.T + (centres * centres).sum(axis=1)
            far, floor = np.sqrt(np.maximum(square, 0)), np.full(len(x), -np.inf)
            at = np.flatnonzero(asked)
            for part in np.array_split(at, -(-len(at) // PIECE[0])) if len(at) and len(sample[0]) > k else []:
                score = np.where(batch.column("row").to_numpy()[part][:, None] == sample[0], LEAST, _product(x[part], sample[1]))
                floor[part] = np.nextafter(np.partition(score, -k, axis=1)[:, -k].astype(float), -np.inf)
            columns = [batch.column("row"), batch.column("id"), batch.column("x"), batch.column("asked"), pa.array([r.tobytes() for r in far], pa.binary()), pa.array(far.argmin(axis=1).astype(np.int64)), pa.array(floor)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "x", "asked", "far", "cell", "floor"])

    return rows.select("row", "id", "x", "asked").mapInArrow(run, "row long, id long, x array<long>, asked boolean, far binary, cell long, floor double")


def _dealing(counts: dict[int, int], cells: int, rows: int) -> list[tuple[int, int]]:
    """For each cell the group of cells that it is blocked with, and into how many parts that group goes."""
    groups, size = [], 0
    for cell in range(cells):
        n = counts.get(cell, 0)
        if not groups or size + n > rows:
            groups.append([])
            size = 0
        groups[-1].append(cell)
        size += n
    return [(g, max(1, -(-sum(counts.get(c, 0) for c in cells_of) // rows))) for g, cells_of in enumerate(groups) for _ in cells_of]


def blocks_of(table: DataFrame, dims: int, pivots: int, rows: int) -> DataFrame:
    """One row a block: its number (its smallest row), the bytes of its rows, ids, vectors, distances and floors, and the range of its distances.

    Blocks hold like vectors: those of one cell, or of several small ones.  A cell of many rows is dealt to parts by a hash of
    the row.  The counts of the cells, at most one a pivot, are all that the driver sees.
    """
    counts = {r[0]: r[1] for r in table.groupBy("cell").count().collect()}
    dealt = F.get(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, p in _dealing(counts, pivots, rows)]), F.col("cell").cast("int"))

    def pack(key, group):
        x = matrix(group.column("x"), dims)
        far = np.frombuffer(b"".join(group.column("far").to_pylist())).reshape(len(x), pivots)
        row, ids, floor = (group.column(c).to_numpy() for c in ("row", "id", "floor"))
        found = {"block": [int(row.min())], "rows": [row.tobytes()], "ids": [ids.tobytes()], "x": [x.tobytes()], "far": [far.tobytes()], "floors": [floor.tobytes()]}
        found |= {"low": [far.min(axis=0).tolist()], "high": [far.max(axis=0).tolist()], "norm": [float((x.astype(float) ** 2).sum(axis=1).max())], "floor": [float(floor.min())]}
        return pa.table(found)

    schema = "block long, rows binary, ids binary, x binary, far binary, floors binary, low array<double>, high array<double>, norm double, floor double"
    parts = table.withColumn("g", dealt["g"]).withColumn("part", F.pmod(F.xxhash64("row"), dealt["p"]))
    return parts.groupBy("g", "part").applyInArrow(pack, schema)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond a long, its limits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, LEAST, LARGEST).astype(np.int64).reshape(len(q), len(x))


class _Best:
    """The ``k`` best candidates so far of each query of a block: score, then smaller id, then smaller row."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score, self.ids, self.row = np.full((queries, k), LEAST), np.full((queries, k), LARGEST), np.full((queries, k), -1)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Candidates (a row each for the queries ``at``; row -1: none)."""
        s, i, r = (np.concatenate([old[at], new], axis=1) for old, new in ((self.score, score), (self.ids, ids), (self.row, row)))
        order = np.lexsort((r, i, ~s, r < 0), axis=1)[:, : self.k]  # ~s falls as s rises, at the limits of a long too
        self.score[at], self.ids[at], self.row[at] = (np.take_along_axis(v, order, axis=1) for v in (s, i, r))
        full = self.row[at][:, -1] >= 0
        self.floor[at] = np.where(full, np.maximum(self.floor[at], np.nextafter(self.score[at][:, -1].astype(float), -np.inf)), self.floor[at])


def _bounds(q_far: np.ndarray, q_norm: np.ndarray, x_far: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products, with room for rounding.  Distances are compared in single precision, one pivot at a time."""
    q32, x32 = q_far.astype(np.float32), np.ascontiguousarray(x_far.T.astype(np.float32))
    lower = np.zeros((len(q32), x32.shape[1]), np.float32)
    gap = np.empty_like(lower)
    for p in range(x32.shape[0]):
        np.subtract(q32[:, p, None], x32[p], out=gap)
        np.maximum(lower, np.abs(gap, out=gap), out=lower)
    # rounding: squares and differences are off by less than 1e-5 of the norms
    lower = np.maximum(lower.astype(float) - 1e-5 * (np.sqrt(q_norm)[:, None] + np.sqrt(x_norm)), 0)
    return (q_norm[:, None] + x_norm - lower**2) / 2 + 1e-6 * (q_norm[:, None] + x_norm) + 1e-3


def search_pair(best: _Best, q: dict, x: dict) -> tuple[int, int]:
    """Compares all queries of ``q`` with all candidates of ``x``; returns how many pairs there were and how many were evaluated."""
    looked = 0
    q_norm, x_norm = ((v["x"].astype(float) ** 2).sum(axis=1) for v in (q, x))
    for a in range(0, len(q["row"]), PIECE[0]):
        at = np.arange(a, min(a + PIECE[0], len(q["row"])))
        for b in range(0, len(x["row"]), PIECE[1]):
            to = slice(b, b + PIECE[1])
            bound = _bounds(q["far"][at], q_norm[at], x["far"][to], x_norm[to])
            bound[q["row"][at][:, None] == x["row"][to]] = -np.inf
            reach = bound >= best.floor[at][:, None]
            if reach.mean() > 0.1:
                looked += bound.size
                score = np.where(bound == -np.inf, LEAST, _product(q["x"][at], x["x"][to]))
                m = min(best.k, score.shape[1])
                good = (score >= np.partition(score, -m, axis=1)[:, -m, None]) & (bound > -np.inf)  # all that tie with the k-th go on
                i, j = np.nonzero(good)
                if len(i):
                    n = good.sum(axis=1)
                    place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    wide = [np.full((len(at), n.max()), fill) for fill in (LEAST, LARGEST, -1)]
                    for grid, values in zip(wide, (score[i, j], x["id"][to][j], x["row"][to][j])):
                        grid[i, place] = values
                    best.add(at, *wide)
                continue
            for i in np.flatnonzero(reach.any(axis=1)):
                order = np.flatnonzero(reach[i])
                order, done, step = order[np.argsort(-bound[i, order], kind="stable")], 0, 4 * best.k
                while done < len(order) and bound[i, order[done]] >= best.floor[at[i]]:
                    part = b + order[done : done + step]
                    looked += len(part)
                    best.add(at[i : i + 1], _product(q["x"][at[i : i + 1]], x["x"][part]), x["id"][part][None], x["row"][part][None])
                    done, step = done + step, 2 * step
    return len(q["row"]) * len(x["row"]), looked


def _unpacked(record: dict, dims: int, pivots: int, prefix: str = "") -> dict:
    row = np.frombuffer(record[prefix + "rows"], np.int64)
    return {"row": row, "id": np.frombuffer(record[prefix + "ids"], np.int64), "x": np.frombuffer(record[prefix + "x"], np.int64).reshape(len(row), dims), "far": np.frombuffer(record[prefix + "far"]).reshape(len(row), pivots)}


def _searched(pairs: DataFrame, dims: int, pivots: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, row, score) of the best ``k`` of each pair of blocks that reach the query's score to beat (``floors``)."""

    def run(batches):
        for batch in batches:
            for record in batch.to_pylist():
                q, x = _unpacked(record, dims, pivots, "q_"), _unpacked(record, dims, pivots)
                best = _Best(len(q["row"]), k, np.frombuffer(record["q_floors"]))
                search_pair(best, q, x)
                at, place = np.nonzero(best.row >= 0)
                columns = [q["row"][at], q["id"][at], best.ids[at, place], best.row[at, place], best.score[at, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "row", "score"])

    return pairs.mapInArrow(run, "query long, query_id long, vec_id long, row long, score long")


def top_k(vectors: DataFrame, queries=None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, pivots: int = 32, sample: int = 4096, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows by the inner product of floor(scale * x).

    ``queries`` is a condition on the rows of ``vectors``; by default ids that 50 divides.  Rows with a null id, which no
    result could name, and vectors that are null or hold an entry that is null, not finite or beyond a long once scaled take
    no part.  A repeated id or vector is a row like any other: only the query's own row is left out.  Ties go to the smaller
    id.  Shorter vectors end in zeros.  Scores beyond a long stop at its limits.  One row, or none, gives no result.
    """
    condition = F.col(f"`{id_col}`") % 50 == 0 if queries is None else queries
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(condition, F.lit(False)).alias("asked"))
    usable = whole_numbers(slim.where("id IS NOT NULL"), "v", scale, 0, "x").select("id", "x", "asked")
    rows = stored(usable.select("*", F.monotonically_increasing_id().alias("row")), "vectors")
    dims = width(rows, "x")
    seen = read_sample(rows, dims, sample)
    if not len(seen[0]):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = choose_pivots(seen[1], pivots)
    n = len(centres)
    table = stored(pivot_table(rows, dims, centres, seen, k), "pivots")
    candidates = stored(blocks_of(table, dims, n, block_rows), "candidates")
    asked = stored(blocks_of(table.where("asked"), dims, n, block_rows // 4), "queries")
    asked = asked.select(*[F.col(c).alias("q_" + c) for c in asked.columns])

    # Pairs of blocks by the ranges of their distances alone: each with each, but no vectors.
    ranges = asked.select("q_block", "q_low", "q_high", "q_norm", "q_floor").crossJoin(candidates.select("block", "low", "high", "norm"))
    apart = lambda low, high: F.array_max(F.zip_with(low, high, lambda a, b: a - b))
    lower = F.greatest(apart("q_low", "high"), apart("low", "q_high"), F.lit(0.0)) * (1 - 1e-6)
    bound = (F.col("q_norm") + F.col("norm")) * (0.5 + 1e-6) - lower * lower / 2 + 1e-3
    reaching = ranges.where(bound >= F.col("q_floor")).select("q_block", "block")
    found = stored(_searched(reaching.join(asked, "q_block").join(candidates, "block"), dims, n, k), "found")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
