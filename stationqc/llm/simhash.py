"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from whole texts, one pass.  Distinct fingerprints are range-partitioned by their population counts
(of the whole and of its four 16-bit quarters) and cut into blocks.  A join in Spark pairs the blocks whose counts can lie
within the radius; each pair is compared in tiles: numpy exclusive-or and bit counts, after skipping tile pairs whose
counts differ by more than the radius.  A task returns a spanning forest of the links it found, never the links: k near
copies give fewer than k rows.  The forests are joined to components in Spark.

Blocks grow with the table, so that a fingerprint is sent to a bounded number of partners; the comparison itself is
quadratic in distinct fingerprints, as it is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, keep_first, numbered, stored

SEED = 42
#: Shingle hashes whose bits are counted at once; bounds memory for texts of any length.
STEP = 1 << 18
TILE = 512


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: one where over half of the shingles' XXH64 have it; zero for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered and only ASCII space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(h), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row."""

    def each(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts: whole, then the four quarters; one row per fingerprint."""
    quarters = np.bitwise_count(fps.view(np.uint16).reshape(len(fps), 4)).astype(np.int16)
    return np.column_stack([quarters.sum(axis=1), quarters])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest known companion) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def local_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that connect what links within ``left``, or between ``left`` and ``right``."""
    alone = right is None
    both = left if alone else np.concatenate([left, right])
    counts = _counts(both)
    order = np.lexsort(counts.T[::-1]) if alone else np.concatenate([np.lexsort(counts[: len(left)].T[::-1]), len(left) + np.lexsort(counts[len(left) :].T[::-1])])
    both, counts = both[order], counts[order]
    cut = len(both) if alone else len(left)
    spans = [(at, min(at + TILE, end)) for first, end in ((0, cut), (cut, len(both))) for at in range(first, end, TILE)]
    low, high = (np.array([f(counts[a:b], axis=0) for a, b in spans]) for f in (np.min, np.max))
    label, held, size = np.arange(len(both)), [], 0
    for i, (a, b) in enumerate(spans):
        if not alone and a >= cut:
            break
        gap = np.maximum(0, np.maximum(low - high[i], low[i] - high))
        near = (gap[:, 0] <= radius) & (gap[:, 1:].sum(axis=1) <= radius)
        for j in np.flatnonzero(near):
            c, d = spans[j]
            if (j < i) if alone else (c < cut):
                continue
            x, y = np.nonzero(np.bitwise_count(both[a:b, None] ^ both[None, c:d]) <= radius)
            x, y = x + a, y + c
            if alone:
                x, y = x[x < y], y[x < y]
            if len(x):
                held.append((x, y))
                size += len(x)
            if size > 1 << 20:
                label, held, size = _merge(label, *map(np.concatenate, zip(*held))), [], 0
    if held:
        label = _merge(label, *map(np.concatenate, zip(*held)))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return both[linked], both[label[linked]]


#: Fingerprints of a block: at least and at most, and blocks that a table is cut into meanwhile.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 15, 1 << 20, 512


def _blocks(size: int):
    def cut(batches):
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]  # one range partition: about ``size`` numbers
        fps = np.concatenate(parts or [np.empty(0, np.int64)]).view(np.uint64)
        for at in range(0, len(fps), 2 * size):
            part = fps[at : at + 2 * size]
            counts = _counts(part)
            made = [[counts.min(axis=0).tolist()], [counts.max(axis=0).tolist()], [len(part)], [part.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=["low", "high", "size", "fps"])

    return cut


def grouped(blocks: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``blocks`` (block, size, …) plus g: neighbours in ``order`` that together have about ``size`` items are one group.

    A window over one row a block: a few numbers for each thousands of items.
    """
    before = F.sum("size").over(Window.orderBy(*order, "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return blocks.withColumn("g", F.floor(before / size))


def meeting(groups: DataFrame, reach: int) -> DataFrame:
    """(i, j), i <= j: groups (g, first, last) whose ranges of whole numbers come within ``reach``; an equi-join on those numbers."""
    a = groups.select(F.col("g").alias("i"), F.explode(F.sequence(F.col("first") - reach, F.col("last") + reach)).alias("at"))
    b = groups.select(F.col("g").alias("j"), F.explode(F.sequence("first", "last")).alias("at"))
    return a.join(b, "at").where("i <= j").select("i", "j").distinct()


def sides(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``blocks`` (g, …) for each of ``pairs`` (i, j), with side: false for those of i, true for those of another j."""
    own, other = F.struct(F.col("i").alias("g"), F.lit(False).alias("side")), F.struct(F.col("j").alias("g"), F.lit(True).alias("side"))
    dealt = pairs.select("i", "j", F.inline(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, other))))
    return dealt.join(blocks, "g").drop("g")


def forest(distinct: DataFrame, radius: int = 2, block: int | None = None) -> DataFrame:
    """(src, dst) links that connect all fingerprints of the column ``fp`` (distinct, stored) as the full set of links would."""
    n = distinct.count()
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"q{k}") for k in range(4)]
    ranked = distinct.select("fp", F.bit_count("fp").alias("pop"), *quarters).repartitionByRange(max(1, -(-n // block)), "pop", "q0", "q1", "q2", "q3", "fp").select("fp")
    made = stored(ranked.mapInArrow(_blocks(block), "low array<long>, high array<long>, size long, fps binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    place = grouped(made.drop("fps"), [F.col("low"), F.col("high")], block)
    blocks = made.select("block", "fps").join(place.select("block", "g"), "block").drop("block")
    span = [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(5)]
    groups = place.groupBy("g").agg(*span)
    pairs = meeting(groups.select("g", F.col("low0").alias("first"), F.col("high0").alias("last")), radius)
    a, b = (groups.select(*[F.col(c).alias(f"{s}{c}") for c in groups.columns]) for s in "ab")
    gap = [F.greatest(F.lit(0), F.col(f"alow{k}") - F.col(f"bhigh{k}"), F.col(f"blow{k}") - F.col(f"ahigh{k}")) for k in range(1, 5)]
    pairs = pairs.join(a, F.col("i") == F.col("ag")).join(b, F.col("j") == F.col("bg")).where(gap[0] + gap[1] + gap[2] + gap[3] <= radius).select("i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.frombuffer(x, np.uint64) for x in rows["fps"][rows["side"] == side]] for side in (False, True)]
        src, dst = local_forest(np.concatenate(parts[0]), np.concatenate(parts[1]) if parts[1] else None, radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return sides(blocks, pairs).groupBy("i", "j").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id among rows linked, directly or through others.

    Rows link if their fingerprints differ in ``radius`` bits at most, so rows with equal fingerprints always do; a null
    or wordless text has fingerprint zero.  Null ids never name a component unless it has no other id (then null).
    Repeated rows get the same answer.  Texts of any length count whole, in steps of ``STEP`` shingles.  An empty table
    gives an empty result.  Other columns, whatever their names, play no part.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fps")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    parts = connected_components(forest(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = stored(distinct.join(parts, "fp"), "linked")
    name = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = stored(distinct.join(linked.join(name, "component").select("fp", "name"), "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "named")
    return rows.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with exactly one row of each component, that with its smallest id (null ids last); same columns.

    Rows are known by a stored number, so repeated ids do no harm.
    """
    rows, number = numbered(docs)
    prints = stored(fingerprints(rows, number, text_col), "fps")
    distinct = stored(prints.select("fp").distinct(), "distinct")
    parts = stored(connected_components(forest(distinct, radius)).withColumnRenamed("node", "fp"), "parts")
    named = prints.join(parts, "fp", "left").select(F.col("id").alias("row"), F.coalesce("component", "fp").alias("component"))
    several = named.groupBy("component").count().where("count > 1").select("component")
    ids = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"))
    members = stored(named.join(several, "component", "left_semi").join(ids, "row").select("row", "id", "component"), "members")
    return keep_first(rows, number, members)
