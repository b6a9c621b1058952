"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards of about ``shard_rows`` rows by a hash of what they are, so the result doesn't depend on how
the table is partitioned or read.  A shard packs on its own: bins never cross shards and any number of machines can work.
:func:`pack` places numbers of tokens; :func:`sequences` packs the token ids themselves and returns the filled bins.

In a shard, items come longest first.  Open bins are kept ordered by residual room.  The
search starts at the successor of the item's length, the tightest room that holds it, and goes on to wider bins until the
bitmaps agree: a bin's cluster bitmap must lack the item's duplicate cluster, and its last source plane the item's source
(plane k has the sources seen k+1 times).  The first that agrees is the tightest compatible bin.  If none does, a bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, words


def best_fit(lengths, sources, clusters, capacity: int, max_per_source: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in the bin, fill of the bin) of each item; items in the given order, lengths from 1 to ``capacity``.

    ``sources`` and ``clusters`` are small whole numbers, negative for what cannot conflict.
    """
    rooms: list[tuple[int, int]] = []  # (residual, bin), sorted
    cluster_bits: list[int] = []
    planes: list[list[int]] = []
    bins, offsets, fill = [], [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        own = 1 << cluster if cluster >= 0 else 0
        src = 1 << source if source >= 0 else 0
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (cluster_bits[rooms[at][1]] & own or planes[rooms[at][1]][-1] & src):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(fill)
            cluster_bits.append(0)
            planes.append([0] * max_per_source)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += length
        cluster_bits[b] |= own
        carry = src
        for k, plane in enumerate(planes[b]):
            planes[b][k], carry = plane | carry, plane & carry
        if room > length:
            insort(rooms, (room - length, b))
    return bins, offsets, [fill[b] for b in bins]


def _ids(values: pd.Series) -> np.ndarray:
    """Dense numbers for the values that occur twice or more; -1 for null and for those that can't conflict."""
    counts = values.value_counts()
    return values.map({v: i for i, v in enumerate(counts.index[counts > 1])}).fillna(-1).astype(int).to_numpy()


KEY = ["doc_id", "n_tokens", "source", "cluster"]


def pack(items: DataFrame, capacity: int = 4096, max_per_source: int = 4, shard_rows: int = 8192) -> DataFrame:
    """Places every token of ``items`` (doc_id, n_tokens, source, cluster; others are ignored) in bins of ``capacity`` tokens.

    Returns doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_fill: a document longer than a bin is cut into full
    bins and a rest, numbered from 0.  No bin holds two documents of one cluster, or more than ``max_per_source`` of one
    source; null sources and clusters never conflict.  Items of null or less than one token take no room and give no
    row.  Ties in length go by document id (null first), source and cluster.  Repeated rows are items of their own: they
    are counted, then numbered and dealt apart, so that many of them are no hot shard.  An empty table gives no bins.
    """
    rows = items.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    rows = rows.groupBy(*KEY).agg(F.count("*").alias("times")).select(*KEY, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    rows = stored(rows, "items")
    shards = max(1, -(-rows.count() // shard_rows))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([*KEY, "copy"], na_position="first", ignore_index=True)
        full, rest = np.divmod(shard["n_tokens"].to_numpy(np.int64), capacity)
        # full pieces have a bin each
        row = np.repeat(np.arange(len(shard)), full)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        head = pd.DataFrame({"row": row, "piece": piece, "n_tokens": capacity, "bin": np.arange(len(row)), "bin_offset": 0, "bin_fill": capacity})
        left = shard.assign(row=np.arange(len(shard)), piece=full, rest=rest)[rest > 0].sort_values("rest", ascending=False, kind="stable")
        bins, offsets, fill = best_fit(left["rest"].tolist(), _ids(left["source"]).tolist(), _ids(left["cluster"]).tolist(), capacity, max_per_source)
        tail = pd.DataFrame({"row": left["row"], "piece": left["piece"], "n_tokens": left["rest"], "bin": np.array(bins, np.int64) + len(row), "bin_offset": offsets, "bin_fill": fill})
        out = pd.concat([head, tail], ignore_index=True)
        base = int(shard["shard"].iloc[0]) << 32
        return pd.DataFrame(
            {"doc_id": shard["doc_id"].to_numpy()[out["row"]], "piece": out["piece"], "start": out["piece"] * capacity, "n_tokens": out["n_tokens"], "bin_id": out["bin"] + base, "bin_offset": out["bin_offset"], "bin_fill": out["bin_fill"]}
        )

    schema = f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_fill long"
    return rows.withColumn("shard", F.pmod(F.xxhash64(*KEY, "copy"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)


def items_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, n_tokens, source, cluster) of documents: words and one end token; a cluster is one text, letter case and white space aside."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), SPACE, " "))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.size(words(text)) + 1).alias("n_tokens"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(plain).alias("cluster"))


def sequences(tokens: DataFrame, capacity: int = 4096, max_per_source: int = 4, shard_rows: int = 4096) -> DataFrame:
    """Filled bins from ``tokens`` (doc_id, ids, source, cluster): bin_id, n_tokens, ids, doc_ids, pieces, offsets.

    ``ids`` are the token ids of the whole bin; document ``doc_ids[k]`` begins at ``offsets[k]`` with its piece
    ``pieces[k]``, so boundaries are known to an attention mask.  Rules and ties are those of :func:`pack`; a rest keeps
    to its shard.  Full pieces of long documents are bins as they are and are never shuffled: a shard is packed by the
    lengths of about ``shard_rows`` rests, and ids meet only in their bin, ``capacity`` of them at most.  Null or empty ids give no row.  Repeated rows are packed each; full pieces
    of such rows share a bin_id.
    """
    rows = tokens.select("doc_id", "ids", F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster")).where(F.size("ids") > 0)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")
    full = F.floor(F.size("ids") / capacity).cast("int")
    part = rows.where(full > 0).select("doc_id", "ids", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    cut = part.select("doc_id", "piece", F.slice("ids", F.col("piece") * capacity + 1, F.lit(capacity)).alias("ids"))
    name = F.concat(F.lit("f"), F.lower(F.hex(F.xxhash64("doc_id", "piece", "ids"))), F.lower(F.hex(F.hash("ids", "doc_id"))))
    whole = cut.select(name.alias("bin_id"), F.lit(capacity).alias("n_tokens"), "ids", F.array("doc_id").alias("doc_ids"), F.array("piece").alias("pieces"), F.array(F.lit(0)).alias("offsets"))
    rest = rows.where(F.size("ids") % capacity > 0).select("row", "doc_id", "source", "cluster", full.alias("piece"), F.slice("ids", full * capacity + 1, F.lit(capacity)).alias("ids"))
    shards = max(1, -(-rows.count() // shard_rows))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        left = shard.sort_values(["n", "doc_id", "source", "cluster", "own"], ascending=[False, True, True, True, True], na_position="first")
        bins, offsets, _ = best_fit(left["n"].tolist(), _ids(left["source"]).tolist(), _ids(left["cluster"]).tolist(), capacity, max_per_source)
        base = int(shard["shard"].iloc[0])
        return pd.DataFrame({"row": left["row"], "bin_id": [f"{base}-{b}" for b in bins], "offset": offsets})

    # a shard is packed by its lengths; its ids meet bin by bin
    sized = rest.select("row", "doc_id", "source", "cluster", F.size("ids").alias("n"), F.xxhash64("ids").alias("own"))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "own", "source", "cluster"), F.lit(shards)))
    places = stored(dealt.groupBy("shard").applyInPandas(run, "row long, bin_id string, offset int"), "places")
    filled = rest.join(places, "row").groupBy("bin_id").agg(F.sum(F.size("ids")).cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("items"))
    return whole.unionByName(filled.select("bin_id", "n_tokens", F.flatten("items.ids").alias("ids"), F.col("items.doc_id").alias("doc_ids"), F.col("items.piece").alias("pieces"), F.col("items.offset").alias("offsets")))
