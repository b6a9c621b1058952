"""Near copies by shingle similarity: wide SimHash candidates, each linked pair verified on its whole shingle sets.

Rows with equal sets of shingles are one item.  Items are range-partitioned by the size of their set and compared in the
tiles of :mod:`simhash`, here with a wide radius; tile pairs whose sizes alone rule the similarity out are skipped, which
loses nothing.  A task returns three edge-disjoint spanning forests of its candidates, the likeliest first by a sketch of
64 bytes an item, so k near copies give fewer than 3 k links.  Every link is verified on both texts before components are built.
Then all candidates whose items these links leave in different components are verified as well, so no candidate is lost for
being one of many.  They may be all pairs of a group that is nearly similar, so they never become rows: a first pass returns the
items that have such a candidate, a second one meets again those items alone, with their whole sets of shingles, and returns a
forest of true links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, keep_first, numbered, stored
from .simhash import SEED, STEP, TILE, _merge, grouped, meeting, sides

#: Bytes of an item's sketch: eight bits of a minimum under each of so many hash functions.
PERMS = 64
_RNG = np.random.default_rng(SEED)
_MULTIPLY, _ADD = _RNG.integers(0, 2**63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, PERMS, np.uint64)
#: Sketch similarities: this far below ``least`` (three deviations) a pair is no candidate, from SURE on it is no doubt one.
SLACK, SURE = 0.15, 0.95
#: Candidate pairs whose sketches are compared at once, and links held before they are thinned to a forest.
CHUNK, HELD = 1 << 15, 1 << 18
#: Edge-disjoint forests that a task returns at first: a link that fails its verification then seldom takes a true one's place.
FORESTS = 3
#: Sets of shingles held at once.
SETS = 512
#: Shingles (8 bytes) of a block of items that come with their sets, at least and at most.
LEAST_VOLUME, MOST_VOLUME = 1 << 20, 1 << 21
#: Items of a block, at least and at most (96 bytes each), and blocks that a table is cut into meanwhile: each is sent to the blocks of like sizes.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 14, 1 << 18, 64


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the ``width``-word shingles; of all words where there are fewer, and none without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of :func:`shingles`; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def summary(h: np.ndarray) -> tuple[int, bytes]:
    """(SimHash, sketch) of a set of shingles."""
    ones, least = np.zeros(64, np.int64), np.full(PERMS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), STEP >> 6):
        part = np.ascontiguousarray(h[at : at + (STEP >> 6)])
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
        mixed = part[:, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]), (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _facts(width: int):
    def each(batches):
        for whole in batches:
            for at in range(0, len(whole), SETS):
                batch = whole.slice(at, SETS)
                sets = [shingles(x, width) for x in batch.column(2).to_pylist()]
                both = [summary(h) for h in sets]
                # two sums know an item's set: 128 bits, and its size
                sums = np.array([(h.sum(dtype=np.uint64), (h * (h >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
                fps = np.array([x for x, _ in both], np.uint64).view(np.int64)
                made = [pa.array([len(h) for h in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(fps), pa.array([x for _, x in both], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["row", "id", "n", "s1", "s2", "fp", "sketch"])

    return each


def _forest(est: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest, the likeliest links first."""
    up, kept = {}, []

    def root(a):
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    order = np.argsort(-est, kind="stable")
    for k, a, b in zip(order.tolist(), x[order].tolist(), y[order].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)


def _met(n: np.ndarray, fps: np.ndarray, sketches: np.ndarray, cut: int, radius: int, least: float, apart):
    """(est, x, y) of candidate pairs, ``CHUNK`` at most at once, that ``apart`` lets through; rows by (n, fps), those from ``cut`` on are another side."""
    alone = cut == len(n)
    spans = [(at, min(at + TILE, end)) for first, end in ((0, cut), (cut, len(n))) for at in range(first, end, TILE)]
    for i, (a, b) in enumerate(spans):
        for c, d in spans[i:]:
            if (not alone and (a >= cut or c < cut)) or n[c] * least > n[b - 1] or n[a] * least > n[d - 1]:
                continue
            x, y = np.nonzero(np.bitwise_count(fps[a:b, None] ^ fps[None, c:d]) <= radius)
            x, y = x + a, y + c
            if a == c:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), CHUNK) if len(x) else ():
                p, q = x[at : at + CHUNK], y[at : at + CHUNK]
                open_ = apart(p, q)
                p, q = p[open_], q[open_]
                est = (sketches[p] == sketches[q]).mean(axis=1) if len(p) else np.empty(0)
                near = est >= least - SLACK
                if near.any():
                    yield est[near], p[near], q[near]


def _ordered(n: np.ndarray, fps: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, int]:
    side = np.zeros(len(n), bool) if side is None else side
    return np.lexsort((fps, n, side)), len(n) - int(side.sum())


def likely_links(items: np.ndarray, n: np.ndarray, fps: np.ndarray, sketches: np.ndarray, side: np.ndarray | None, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``items`` to verify first; with ``side`` (false, true) only tiles of different sides are compared.

    Not all: what these don't connect once they are verified, :func:`open_links` finds.
    """
    order, cut = _ordered(n, fps, side)
    items, n, fps, sketches = items[order], n[order], fps[order], sketches[order]
    label, held, size = np.arange(len(n)), [], 0

    def thinned():
        est, x, y = map(np.concatenate, zip(*held))
        left, kept = np.arange(len(x)), []
        for _ in range(FORESTS):
            kept.append(left[_forest(est[left], x[left], y[left])])
            left = np.setdiff1d(left, kept[-1], assume_unique=True)
        kept = np.concatenate(kept)
        return [(est[kept], x[kept], y[kept])]

    for est, p, q in _met(n, fps, sketches, cut, radius, least, lambda p, q: label[p] != label[q]):
        held.append((est, p, q))
        size += len(p)
        label = _merge(label, p[est >= SURE], q[est >= SURE])
        if size > HELD:
            held = thinned()
            size = len(held[0][0]) - FORESTS * len(n)  # a forest has fewer links than nodes: room for HELD new ones
    if not held:
        return items[:0], items[:0]
    _, x, y = thinned()[0]
    return items[x], items[y]


def open_items(items: np.ndarray, n: np.ndarray, fps: np.ndarray, sketches: np.ndarray, side: np.ndarray | None, part: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Those of ``items`` with a candidate of another ``part``."""
    order, cut = _ordered(n, fps, side)
    part, seen = part[order], np.zeros(len(order), bool)
    for _, x, y in _met(n[order], fps[order], sketches[order], cut, radius, least, lambda p, q: (part[p] != part[q]) & ~(seen[p] & seen[q])):
        seen[x] = seen[y] = True
    return items[order[seen]]


def true_links(items: np.ndarray, n: np.ndarray, fps: np.ndarray, sketches: np.ndarray, side: np.ndarray | None, part: np.ndarray, sets: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the ``part`` of ``items`` as all similar candidates would: every candidate of parts not yet connected is verified.  ``sets``: their shingles, one item after the other."""
    order, cut = _ordered(n, fps, side)
    code, first = np.unique(sets, return_inverse=True)[1].astype(np.int32), (np.cumsum(n) - n)[order]
    n, part = n[order], np.unique(part[order], return_inverse=True)[1]
    label, mark, src, dst = np.arange(part.max(initial=-1) + 1), np.zeros(code.max(initial=-1) + 1, bool), [], []
    for _, xs, ys in _met(n, fps[order], sketches[order], cut, radius, least, lambda p, q: label[part[p]] != label[part[q]]):
        cuts = [0, *(np.flatnonzero(np.diff(xs)) + 1).tolist(), len(xs)]
        for at, end in zip(cuts, cuts[1:]):
            x, y = xs[at], ys[at:end]
            y = y[label[part[y]] != label[part[x]]]
            own = code[first[x] : first[x] + n[x]]
            mark[own] = True
            for y in np.split(y, np.flatnonzero(np.diff(np.cumsum(n[y]) // LEAST_VOLUME)) + 1) if len(y) else ():
                before = np.cumsum(n[y]) - n[y]
                both = np.add.reduceat(mark[code[np.repeat(first[y] - before, n[y]) + np.arange(n[y].sum())]], before, dtype=np.int64)
                y = y[both / (n[x] + n[y] - both) >= least]
                y = y[np.unique(label[part[y]], return_index=True)[1]]
                y = y[label[part[y]] != label[part[x]]]
                if len(y):
                    src += [items[order[x]]] * len(y)
                    dst += items[order[y]].tolist()
                    label = _merge(label, np.full(len(y), part[x]), part[y])
            mark[own] = False
    return np.array(src, np.int64), np.array(dst, np.int64)


#: Columns of a block that are joined bytes, and their type.
BYTES = {"item": np.int64, "n": np.int64, "fp": np.uint64, "part": np.int64, "sketch": np.uint8, "shingles": np.uint64}


def _packed(size: int, columns: list[str]):
    """Batches of items to blocks of about ``size`` items, or of as many shingles if they are among ``columns``; a block is held, no partition."""

    def cut(batches):
        held, weight = [], 0

        def made():
            t = pa.Table.from_batches(held)
            n = t.column("n").to_numpy()
            joined = [b"".join(t.column(c).to_pylist()) if c in ("sketch", "shingles") else t.column(c).to_numpy().tobytes() for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in [int(n.min()), int(n.max()), weight]] + [pa.array([x], pa.binary()) for x in joined], names=["low", "high", "size", *columns])

        for batch in batches:
            each = batch.column(batch.schema.get_field_index("n")).to_numpy() if "shingles" in columns else np.ones(len(batch), np.int64)
            sums, at = np.concatenate([[0], np.cumsum(each)]), 0
            while at < len(batch):
                end = min(len(batch), max(at + 1, int(np.searchsorted(sums, sums[at] + size - weight, "right")) - 1))
                held.append(batch.slice(at, end - at))
                weight, at = weight + int(sums[end] - sums[at]), end
                if weight >= size:
                    yield made()
                    held, weight = [], 0
        if held:
            yield made()

    return cut


def candidates(items: DataFrame, radius: int, least: float, block: int | None = None) -> DataFrame:
    """(src, dst) pairs of ``items`` (item, n, fp, sketch; stored, with words) to verify, the likeliest.

    With a column part instead (item) of :func:`open_items`, and with part and shingles the (src, dst) of :func:`true_links`.
    """
    parted, whole = "part" in items.columns, "shingles" in items.columns
    columns = [c for c in BYTES if c in items.columns]
    count = (items.agg(F.sum("n")).first()[0] or 0) if whole else items.count()
    block = block or (min(MOST_VOLUME, max(LEAST_VOLUME, count // BLOCKS)) if whole else min(MOST_BLOCK, max(LEAST_BLOCK, count // BLOCKS)))
    ranked = items.select(*columns).repartitionByRange(max(1, -(-count // block)), "n", "item")
    made = ranked.mapInArrow(_packed(block, columns), "low long, high long, size long, " + ", ".join(f"{c} binary" for c in columns))
    made = stored(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    place = grouped(made.select("block", "low", "high", "size"), [F.col("low"), F.col("high")], block)
    blocks = made.drop("low", "high", "size").join(place.select("block", "g"), "block").drop("block")
    # sizes of a similarity of ``least`` lie at most one step of this logarithm apart
    step = lambda n: F.floor(F.ln(n) / -math.log(least)).cast("int")
    groups = place.groupBy("g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = meeting(groups.select("g", step(F.col("low")).alias("first"), step(F.col("high")).alias("last")), 1)
    low, high = groups.select(F.col("g").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j")), groups.select(F.col("g").alias("i"), "low", "high")
    pairs = near.join(low, "j").join(high, "i").where((F.col("low_j") * least <= F.col("high")) & (F.col("low") * least <= F.col("high_j"))).select("i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches])
        x = {c: np.concatenate([np.frombuffer(y.as_buffer(), BYTES[c]) for y in rows.column(c)]) for c in columns}
        side = np.repeat(rows.column("side").to_numpy(), [len(y.as_buffer()) // 8 for y in rows.column("item")])
        given = x["item"], x["n"], x["fp"], x["sketch"].reshape(-1, PERMS), side
        if not parted:
            found = likely_links(*given, radius, least)
        elif whole:
            found = true_links(*given, x["part"], x["shingles"], radius, least)
        else:
            found = [open_items(*given, x["part"], radius, least)]
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in found], names=["item"] if len(found) == 1 else ["src", "dst"])

    return sides(blocks, pairs).groupBy("i", "j").applyInArrow(compare, "item long" if parted and not whole else "src long, dst long")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 18, least: float = 0.8) -> DataFrame:
    """``docs`` with exactly one row of each component of near copies, that with its smallest id; same columns.

    Two rows link if the Jaccard similarity of their sets of ``width``-word shingles is ``least`` or more; words are split
    at ASCII white space and A-Z lowered.  Fingerprints of the two may differ in ``radius`` of 64 bits (expected at 0.8:
    ten, with a deviation of three), so nearly all such pairs are met.  Rows are known by a stored number, so repeated ids
    do no harm; null ids come last.  Texts without words are copies of each other.  Texts of any length count whole, an
    empty table stays empty, and columns of any name pass through.
    """
    rows, number = numbered(docs)
    given = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    facts = stored(given.mapInArrow(_facts(width), f"row long, id {given.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, fp long, sketch binary"), "facts")
    same = ["n", "s1", "s2"]
    groups = stored(facts.groupBy(*same).agg(F.min("row").alias("item"), F.count("*").alias("rows")), "groups")
    items = stored(facts.select(F.col("row").alias("item"), "n", "fp", "sketch").join(groups.where("n > 0").select("item"), "item"), "items")
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    likely = stored(candidates(items, radius, least).select(*pair).distinct(), "likely")

    texts = given.select(F.col("row").alias("item"), "text")

    def verified(batches):
        for whole in batches:
            for at in range(0, len(whole), SETS):
                batch = whole.slice(at, SETS)
                a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                keep = pa.array([similarity(shingles(x, width), shingles(y, width)) >= least for x, y in zip(a, b)], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

    both = likely.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    links = stored(both.mapInArrow(verified, "src long, dst long"), "links")
    parts = stored(connected_components(links).withColumnRenamed("node", "item"), "parts")
    # The likeliest links connect most; of all other candidates, those that would still connect something are verified too.
    parted = stored(items.join(parts, "item", "left").select(*items.columns, F.coalesce("component", "item").alias("part")), "parted")
    left = stored(candidates(parted, radius, least).distinct(), "open")
    if not left.isEmpty():

        def sets(batches):
            for whole in batches:
                for at in range(0, len(whole), SETS):
                    batch = whole.slice(at, SETS)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, width).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["item", "shingles"])

        known = texts.join(left, "item").mapInArrow(sets, "item long, shingles binary")
        rest = stored(candidates(stored(known.join(parted, "item"), "sets"), radius, least), "rest")
        if not rest.isEmpty():
            parts = stored(connected_components(links.unionByName(rest)).withColumnRenamed("node", "item"), "parts")

    # Only rows of items that have a companion, or several rows, are looked at again.
    several = groups.join(parts, "item", "left").where("component IS NOT NULL OR rows > 1").select(*same, F.coalesce("component", "item").alias("component"))
    members = stored(facts.select("row", "id", *same).join(several, same).select("row", "id", "component"), "members")
    return keep_first(rows, number, members)
