"""Vectors as whole numbers, gathered into blocks that tasks read as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this, scaled components have no exact whole number in a double's neighbourhood of a long.
LONGEST = float(2**62)


def whole_numbers(vectors: DataFrame, column: str, scale: int, shift: int, name: str) -> DataFrame:
    """``vectors`` plus ``name``: array of floor(scale * component) + shift as long.

    Rows go whose vector is null or holds an entry that is null, not finite or too large for a long once scaled.
    """
    v: Column = F.col(f"`{column}`")
    usable = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LONGEST, F.lit(False)))  # NaN is greater than all numbers
    return vectors.where(usable).withColumn(name, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long")))


def width(vectors: DataFrame, name: str) -> int:
    """The longest vector's length, 0 for an empty table."""
    return vectors.agg(F.coalesce(F.max(F.size(name)), F.lit(0))).first()[0]


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of ``lists`` (no nulls) as an int64 matrix; vectors that are shorter than ``dims`` end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets, values = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), dims).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(dims)[None, :] < sizes[:, None]
    out[at] = values[offsets[0] : offsets[-1]]
    return out


def batches_of(batches, rows: int):
    """Arrow batches gathered until they hold ``rows`` rows, and cut there."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
