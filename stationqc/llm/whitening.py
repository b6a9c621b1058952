"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are stored once, as blocks.  Each step sends one direction v to the tasks and gets back, summed over all
rows in Spark, the products of y = Xv with X, with itself and with the left vectors so far.  A left vector is a known
combination of the columns of X (u = Xa with a on the driver), so tasks make it anew from their rows, and nothing as long as
the table is ever kept: both sides are reorthogonalised in full all the same.  After as many steps as there are dimensions,
the singular value decomposition of the small bidiagonal matrix gives components and deviations.  Fewer steps would not do:
eigenvalues of embeddings lie close together, and equal ones are found only by starting again, which happens when a step
leaves nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused
from .vectors import batches_of, matrix, whole_numbers, width

#: Rows of a block: 2 MB for 64 dimensions.
BLOCK_ROWS = 4096


def _summed(blocks: DataFrame, product, length: int) -> np.ndarray:
    """Sum over all blocks of ``product(matrix) -> length numbers``: added up in each task, then in Spark, by place."""

    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            for raw, dims in zip(batch.column("x"), batch.column("dims")):
                total += product(np.frombuffer(raw.as_py()).reshape(-1, dims.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["at", "value"])

    rows = blocks.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = rows.toPandas().set_index("at")["value"]
    return found.reindex(range(length), fill_value=0.0).to_numpy()


def totals(vectors: DataFrame, name: str, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension."""

    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            m = matrix(batch.column(0), dims)
            n, total = n + len(m), [a + int(b) for a, b in zip(total, m.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims)), pa.array([str(x) for x in [n, *total]])], names=["at", "value"])

    parts = vectors.select(name).mapInArrow(run, "at long, value string")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    return int(found.get(-1, 0)), [int(found.get(d, 0)) for d in range(dims)]


def centred_blocks(vectors: DataFrame, name: str, n: int, sums: list[int]) -> DataFrame:
    """(x, dims): x - S/n of up to :data:`BLOCK_ROWS` rows as the bytes of doubles."""
    dims = len(sums)
    base, rest = np.array([s // n for s in sums]), np.array([(s % n) / n for s in sums])

    def run(batches):
        for table in batches_of(batches, BLOCK_ROWS):
            x = (matrix(table.column(0), dims) - base) - rest
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([dims])], names=["x", "dims"])

    return vectors.select(name).mapInArrow(run, "x binary, dims long")


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``, taken out twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(blocks: DataFrame, dims: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Right vectors V (dims x k), bidiagonal B (k x k) with X V = U B, and the coefficients a of the left vectors u = X a."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=dims)
    right, left, left_x, diagonal, above = [v / np.linalg.norm(v)], [], [], [], []  # left_x: products of the left vectors with X
    scale = 0.0
    for k in range(dims):
        v, a = right[-1], np.array(left).reshape(len(left), dims)

        def product(x, v=v, a=a):
            y = x @ v
            return np.concatenate([x.T @ y, [y @ y], (x @ a.T).T @ y])

        got = _summed(blocks, product, dims + 1 + len(left))
        xy, yy, h = got[:dims], got[dims], got[dims + 1 :]
        coefficients, norm2 = v - h @ a, yy - h @ h
        xu = xy - (h @ np.array(left_x).reshape(len(left), dims))
        if norm2 < 1e-3 * yy:  # little is left, so it is measured, and freed of the left vectors once more, on the rows themselves

            def again(x, b=coefficients, a=a):
                u = x @ b
                return np.concatenate([x.T @ u, [u @ u], (x @ a.T).T @ u])

            got = _summed(blocks, again, dims + 1 + len(left))
            h = got[dims + 1 :]
            coefficients, norm2 = coefficients - h @ a, got[dims] - h @ h
            xu = got[:dims] - (h @ np.array(left_x).reshape(len(left), dims))
        scale = max(scale, yy)
        alpha = np.sqrt(max(norm2, 0.0))
        if norm2 <= 1e-24 * scale or not scale:  # X has no more to give along this direction
            alpha, coefficients, xu = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            coefficients, xu = coefficients / alpha, xu / alpha
        diagonal.append(alpha)
        left.append(coefficients)
        left_x.append(xu)
        if k + 1 == dims:
            break
        raw = xu - alpha * v
        new = _against(raw, right)
        beta = np.linalg.norm(new)
        if beta <= 1e-12 * np.sqrt(scale) or not scale:  # an invariant space: start again, at right angles to it
            new, beta = _against(rng.normal(size=dims), right), 0.0
            new = _against(new / np.linalg.norm(new), right)
        above.append(beta)
        right.append(new / np.linalg.norm(new))
    return np.array(right).T, np.diag(diagonal) + np.diag(above, 1), left


def principal_components(blocks: DataFrame, dims: int, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance as columns, and its eigenvalues, falling."""
    right, b, _ = bidiagonalise(blocks, dims, seed)
    _, s, wt = np.linalg.svd(b)
    return right @ wt.T, s**2 / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, seed: int = 0) -> DataFrame:
    """One row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or holds an entry that is null, not finite or beyond a long once scaled is left out; a null id
    stays null, and repeated rows each count.  Shorter vectors end in zeros (before the shift: ``shift`` itself).  Components
    along which the rows don't differ (eigenvalue below 1e-20 of the largest) aren't returned, so one row, equal rows
    or an empty table give none.  A deviation beyond a long is null.  Of tied eigenvalues any basis of their space is right.
    The whole numbers and the centred blocks are stored, one copy each; beside them a task holds a block and a few columns.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    (x,) = unused(vectors.select(f"`{id_col}`"), "__x")
    usable = whole_numbers(vectors.select(f"`{id_col}`", F.col(f"`{vector_col}`").alias("v_" + x)), "v_" + x, scale, 0, x).select(f"`{id_col}`", x)
    rows = stored(usable, "vectors")
    dims = width(rows, x)
    n, sums = totals(rows, x, dims)
    if not n or not dims:
        return spark.createDataFrame([], schema)
    blocks = stored(centred_blocks(rows, x, n, sums), "centred")  # the shift changes neither differences nor covariances
    axes, values = principal_components(blocks, dims, n, seed)
    trace = float(values.sum())
    kept = min(components, int((values > 1e-20 * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0)
    if not kept:
        return spark.createDataFrame([], schema)
    axes = axes[:, :kept] / np.linalg.norm(axes[:, :kept], axis=0)
    change = axes / np.sqrt(values[:kept])
    mean = _summed(blocks, lambda m: (m @ change).sum(axis=0), kept) / n

    def products(m):
        w = m @ change - mean
        return (w.T @ w).ravel()

    off = float(np.abs(_summed(blocks, products, kept * kept).reshape(kept, kept) / n - np.eye(kept)).max())
    base, rest, total = np.array([s // n for s in sums]), np.array([(s % n) / n for s in sums]), np.array([s % (1 << 64) for s in sums], np.uint64)

    def run(batches):
        for table in batches_of(batches, BLOCK_ROWS):
            m = matrix(table.column(1), dims)
            centred = (m - base) - rest
            d = m.astype(np.uint64) * np.uint64(n % (1 << 64)) - total  # modulo 2^64, so right whenever the sum fits a long
            exact = (d * d).sum(axis=1).astype(np.int64)
            near = ((centred * float(n)) ** 2).sum(axis=1)
            deviation = pa.array(np.repeat(exact, kept), mask=np.repeat(near > 9.2e18, kept))
            size = len(m) * kept
            yield pa.RecordBatch.from_arrays(
                [
                    table.column(0).combine_chunks().take(pa.array(np.repeat(np.arange(len(m)), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(m))), pa.array(np.full(size, n)), deviation,
                    pa.array((centred @ change).ravel()), pa.array(np.tile(values[:kept] / trace, len(m))), pa.array(np.full(size, off)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
