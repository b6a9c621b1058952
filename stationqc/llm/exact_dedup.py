"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition sorts the 64-bit fingerprints of its texts and sends them, cut by owner and Golomb-Rice coded, to the
   owners of the fingerprint ranges (a few bytes a row; a fingerprint goes once per sender, however often it occurs).
2. Each owner finds fingerprints that occur twice or more and answers with the pieces of a bitmap over its share of the
   slots.  Slots are some 16 a row, so the answers take 2 bytes a row at most, up to ``MOST_BITS``.
3. Partitions test their rows against the bitmap.  Only suspects are shuffled, and only suspects are compared byte by
   byte.  Two fingerprints in one slot merely make an extra suspect; nothing is lost and nothing is merged wrongly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, in_slots, shuffle_partitions, stored, without

#: Fingerprints that one sender codes at once: bounds a task's memory at some tens of MB.
CHUNK = 1 << 20
#: Slots of the bitmap, as a power of two: it follows the rows between these bounds (at most 256 MB of 4 KB pieces).
LEAST_BITS, MOST_BITS = 20, 31
#: Slots of one piece.
PIECE = 1 << 15


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary stream and remainder stream of the gaps of sorted unsigned 64-bit ``values``."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / len(values) if len(values) else 1.0
    k = max(0, int(np.log2(max(mean, 1.0))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotient << np.uint64(k)) | low, dtype=np.uint64)


def _messages(owner_bits: int):
    schema = pa.schema([("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("again", pa.binary())])

    def coded(parts: list[np.ndarray], sender: int):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owners = (values >> np.uint64(64 - owner_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(values))):
            base = np.uint64(int(owners[a]) << (64 - owner_bits))
            yield int(owners[a]), sender, int(b - a), *golomb_encode(values[a:b] - base), np.packbits(counts[a:b] > 1).tobytes()

    def send(batches):
        sender, parts, held = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(parts[-1])
            if held >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*coded(parts, sender)), schema.types)], schema=schema)
                parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*coded(parts, sender)), schema.types)], schema=schema)

    return send, "owner int, sender long, n int, k int, unary binary, rest binary, again binary"


def _answers(owner_bits: int, slot_bits: int):
    def reconcile(rows: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(rows["owner"].iloc[0]) << (64 - owner_bits))
        lists = [golomb_decode(r.n, r.k, r.unary, r.rest) for r in rows.itertuples()]
        flagged = [v[np.unpackbits(np.frombuffer(r.again, np.uint8))[: r.n].astype(bool)] for v, r in zip(lists, rows.itertuples())]
        values = np.sort(np.concatenate(lists))
        twice = np.concatenate([values[1:][values[1:] == values[:-1]], *flagged]) + base
        slots = np.unique(twice >> np.uint64(64 - slot_bits)).astype(np.int64)
        buckets, starts = np.unique(slots // PIECE, return_index=True)
        pieces = []
        for part in np.split(slots % PIECE, starts[1:]) if len(slots) else ():
            piece = np.zeros(PIECE, bool)
            piece[part] = True
            pieces.append(np.packbits(piece, bitorder="little").tobytes())
        return pd.DataFrame({"bucket": buckets.astype(np.int64), "bitmap": pieces})

    return reconcile


def slots_for(rows: int) -> int:
    """Sixteen slots a row, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * rows).bit_length()))


def duplicate_bitmap(fingerprints: DataFrame, slot_bits: int, owner_bits: int | None = None) -> DataFrame:
    """(bucket, bitmap): the answers of all owners, a bit for each slot with a fingerprint (of the one column) that occurs twice or more."""
    if owner_bits is None:
        owner_bits = min(16, max(3, (4 * shuffle_partitions(fingerprints.sparkSession) - 1).bit_length()))
    owner_bits = min(owner_bits, slot_bits - 15)  # a piece has one owner
    send, schema = _messages(owner_bits)
    return fingerprints.mapInArrow(send, schema).groupBy("owner").applyInPandas(_answers(owner_bits, slot_bits), "bucket long, bitmap binary")


def _split(docs: DataFrame, id_col: str, text_col: str, slot_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows that surely have no copy, stored suspects); both with row (all columns), id, norm and fp, and suspects with rid."""
    norm = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE, " ")
    bits = slots_for(docs.count()) if slot_bits is None else slot_bits
    slots = stored(duplicate_bitmap(docs.select(F.xxhash64(norm).alias("fp")), bits), "answers")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(norm).alias("fp"))
    again = F.regexp_replace(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), SPACE, " ")
    marked = in_slots(named, F.col("fp"), slots, "suspect", bits)
    suspects = stored(marked.where("suspect").drop("suspect").withColumn("rid", F.monotonically_increasing_id()), "suspects")
    return marked.where("NOT suspect").drop("suspect").withColumn("norm", again), suspects.withColumn("norm", again)


def _groups(suspects: DataFrame) -> DataFrame:
    """One row per distinct normalised text of the suspects.  The grouping key holds the text: equality is that of all bytes.

    Copies are combined before the shuffle, so a text that a third of all rows share arrives once per task.
    """
    return suspects.groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("keep_rid"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int | None = None) -> DataFrame:
    """``docs`` plus keep_id, group_size, kept and text_sha256; equal means identical after each run of white space is one space.

    Null texts count as empty, and empty texts equal each other.  The row with the smallest id stays; null ids come
    after all others.  Rows that repeat an id and a text are copies like any other: exactly one of a group has ``kept``.
    Texts of any length are compared whole.  In an empty table nothing is marked.  Input columns named like an output
    give way; all others, whatever their names, pass through.
    """
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256")
    single, suspects = _split(docs, id_col, text_col, slot_bits)
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    groups = _groups(suspects).withColumn("text_sha256", sha).drop("norm")
    found = suspects.withColumn("text_sha256", sha).join(groups, ["fp", "text_sha256"])
    return single.select("row.*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256")).unionByName(
        found.select("row.*", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int | None = None) -> DataFrame:
    """``docs`` without the rows that :func:`mark_copies` doesn't keep; same columns.  The texts of dropped rows are not joined."""
    single, suspects = _split(docs, id_col, text_col, slot_bits)
    keep = _groups(suspects).select(F.col("keep_rid").alias("rid"))
    return single.select("row.*").unionByName(suspects.join(keep, "rid", "left_semi").select("row.*"))
