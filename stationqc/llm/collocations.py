"""Phrases of two to four words that occur together more often than their parts let expect, a language.

Texts become chunks of local word codes with a dictionary of their own, so words are split once and no vocabulary is ever
held whole: dictionaries meet the frequent words in a join.  Frequent words, of all languages together, are numbered by falling
frequency.  Then neighbours are counted in square tiles of word numbers: a tile that a chunk fills well is a dense array, filled by
``numpy.bincount`` at the address that the two numbers give; what falls into sparse tiles is a sorted list of coordinates.  Tasks add up
their own chunks, and Spark the tasks', by coordinate, so no tile meets in one task.  Frequent pairs are numbered by frequency
in their turn and counted with the next word in the same way, and frequent triples once more.

A triple can be frequent only if both its pairs are.  That thins the rows out, but the counts decide: numbers are
broadcast for the ``head`` most frequent grams only, and a bitmap of a fixed size stands for all others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slot_bitmap, small_batches, stored

#: Bytes of text of a chunk.
CHUNK = 1 << 22
#: Numbers along the side of a tile, and tiles along the side of the square in which tiles may be dense: the 8,192 most frequent.
SIDE_BITS, GRID = 9, 16
#: Dense tiles (1 MB) and coordinates (24 bytes) that a task holds.
DENSE, HELD = 32, 1_000_000
#: Bits of the bitmap that stands for grams beyond the head: 16 MB.
TAIL_BITS = 27
#: Piece separators become full stops, tabs spaces.
FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def _encoded(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of ``data`` (-1: a piece ends), the words by code, and how often each occurs."""
    tokens = pc.ascii_split_whitespace(pa.array([data], pa.large_string())).values.dictionary_encode()
    names, codes = tokens.dictionary, tokens.indices.to_numpy()
    real = np.asarray(pc.invert(pc.is_in(names, pa.array(["", "."], names.type))))
    number = np.where(real, np.cumsum(real) - 1, np.where(np.asarray(pc.equal(names, "")), -2, -1)).astype(np.int32)
    codes = number[codes] if len(codes) else np.zeros(0, np.int32)
    codes = codes[codes > -2]
    return codes, names.filter(pa.array(real)), np.bincount(codes[codes >= 0], minlength=int(real.sum()))


def chunks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, codes, words, counts): texts of one language, about :data:`CHUNK` bytes together; longer ones are cut where a piece ends."""

    def packed(lang, texts):
        data = b".".join(texts).lower().translate(FOLD)  # bytes.lower changes A to Z only
        at = 0
        while at < len(data):
            end = data.find(b".", at + CHUNK) if len(data) - at > 2 * CHUNK else -1
            part, at = (data[at:], len(data)) if end < 0 else (data[at:end], end)
            codes, names, counts = _encoded(part.replace(b".", b" . "))
            if len(names):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                    names=["lang", "codes", "words", "counts"],
                )

    def run(batches):
        held, size = {}, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= CHUNK or sum(size.values()) >= 8 * CHUNK:
                    for full in [lang] if size[lang] >= CHUNK else list(held):
                        yield from packed(full, held.pop(full))
                        del size[full]
        for lang, texts in held.items():
            yield from packed(lang, texts)

    slim = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "lang string, codes binary, words array<string>, counts array<long>")


def numbered_by(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` (stored) plus ``name``: its place from 0 in the given order.  Rows are sorted across tasks; only the tasks' counts reach the driver."""
    n = shuffle_partitions(df.sparkSession)
    at = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    at = stored(at, "places")
    counts = dict(at.groupBy("_task").count().collect())
    before, total = [], 0
    for task in range(max(counts, default=-1) + 1):
        before.append(F.lit(total).cast("long"))
        total += counts.get(task, 0)
    return at.withColumn(name, F.col("_place") + F.get(F.array(*(before or [F.lit(0).cast("long")])), F.col("_task"))).drop("_task", "_place")


def _merged(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of equal keys (all columns but the last) as one, the last column added up."""
    *keys, n = columns
    if not len(n):
        return list(columns)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    starts = np.flatnonzero(new)
    return [*(k[starts] for k in keys), np.add.reduceat(n[order], starts)]


class Tiles:
    """Counts of pairs of numbers: dense tiles and sorted coordinates."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ta, tb = a >> SIDE_BITS, b >> SIDE_BITS
        tile = np.where((ta < GRID) & (tb < GRID), ta * GRID + tb, GRID * GRID)
        filled = np.bincount(tile, minlength=GRID * GRID + 1)[:-1]
        for t in np.argsort(-filled):
            if len(self.dense) < DENSE and filled[t] >= (1 << 2 * SIDE_BITS) // 8 and t not in self.dense:
                self.dense[int(t)] = np.zeros(1 << 2 * SIDE_BITS, np.int32)
        is_dense = np.zeros(GRID * GRID + 1, bool)
        is_dense[list(self.dense)] = True
        inside = is_dense[tile]
        order = np.flatnonzero(inside)
        order = order[np.argsort(tile[order].astype(np.int16), kind="stable")]
        cut = np.searchsorted(tile[order], sorted(self.dense))
        for t, part in zip(sorted(self.dense), np.split(order, cut[1:]) if len(cut) else []):
            mask = (1 << SIDE_BITS) - 1
            self.dense[t] += np.bincount((a[part] & mask) << SIDE_BITS | (b[part] & mask), minlength=1 << 2 * SIDE_BITS).astype(np.int32)
        key, n = np.unique(a[~inside] << 32 | b[~inside], return_counts=True)
        self.sparse.append([key, n])
        self.size += len(key)
        if self.size > HELD:
            self.sparse = [_merged(*map(np.concatenate, zip(*self.sparse)))]
            self.size = len(self.sparse[0][0])

    def take(self):
        """All counts as (a, b, n); the tiles are empty afterwards."""
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (t // GRID << SIDE_BITS) + (at >> SIDE_BITS), (t % GRID << SIDE_BITS) + (at & ((1 << SIDE_BITS) - 1)), cells[at].astype(np.int64)
        if self.sparse:
            key, n = _merged(*map(np.concatenate, zip(*self.sparse)))
            yield key >> 32, key & 0xFFFFFFFF, n
        self.__init__()


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two longs, modulo 2^64."""
    h = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Known:
    """Which grams are frequent: numbers of the most frequent, found by a sorted key, and a bitmap for the others (None: there are none)."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, key: np.ndarray, bitmap: np.ndarray | None):
        order = np.argsort(key, kind="stable")
        self.hi, self.lo, self.keys, self.rank, self.bitmap = hi, lo, key[order], order.astype(np.int64), bitmap

    def find(self, key: np.ndarray) -> np.ndarray:
        """The numbers of ``key``; -1: not among the numbered."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def maybe(self, rank: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """False: not frequent."""
        found = rank >= 0
        if self.bitmap is not None:
            slot = _mixed(hi, lo) >> np.uint64(64 - TAIL_BITS)
            found |= (self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _windows(s: np.ndarray, size: int, known: list[Known]) -> tuple[np.ndarray, ...]:
    """Of all windows of ``size`` words whose two shorter windows may be frequent: number of the first, its key, the word after it, and the whole key."""
    if size == 2:
        at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
        zero = np.zeros(len(at), np.int64)
        return s[at], zero, s[at + 1], s[at] << 32 | s[at + 1], zero
    ok = (s[:-1] > 0) & (s[1:] > 0)
    pair = s[:-1] << 32 | s[1:]
    rank = np.where(ok, known[0].find(pair), -1)
    ok &= known[0].maybe(rank, pair, np.zeros_like(pair))
    if size == 3:
        at = np.flatnonzero(ok[:-1] & ok[1:])
        return rank[at], pair[at], s[at + 2], pair[at], s[at + 2]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    third = np.full(len(s), -1)
    third[at] = np.where(rank[at] >= 0, known[1].find(rank[at] << 32 | s[at + 2]), -1)
    good = np.zeros(len(s), bool)
    good[at] = known[1].maybe(third[at], pair[at], s[at + 2])
    at = np.flatnonzero(good[:-1] & good[1:])
    return third[at], pair[at], s[at + 3], pair[at], s[at + 2] << 32 | s[at + 3]


def count_grams(encoded: DataFrame, size: int, known: list[Known], least: int) -> DataFrame:
    """(hi, lo, a) of the grams of ``size`` words that occur ``least`` times or more in ``encoded`` (ids: bytes of word numbers, 0 between pieces)."""
    shared = encoded.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        tiles, loose, n_loose = Tiles(), [], 0
        known = shared.value

        def found():
            for a, b, n in tiles.take():
                if size == 2:
                    yield a << 32 | b, np.zeros_like(a), n
                else:
                    last = known[size - 3]
                    yield last.hi[a], b if size == 3 else last.lo[a] << 32 | b, n
            if loose:
                yield tuple(_merged(*map(np.concatenate, zip(*loose))))
                loose.clear()

        def batches_out():
            for hi, lo, n in found():
                for at in range(0, len(n), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 200_000].astype(np.int64)) for v in (hi, lo, n)], names=["hi", "lo", "n"])

        for batch in batches:
            for raw in batch.column("ids"):
                s = np.frombuffer(raw.as_py(), np.int32).astype(np.int64)
                if len(s) < size:
                    continue
                rank, _, word, hi, lo = _windows(s, size, known)
                head = rank >= 0
                tiles.add(rank[head], word[head])
                if not head.all():
                    loose.append(_merged(hi[~head], lo[~head], np.ones((~head).sum(), np.int64)))
                    n_loose += len(loose[-1][0])
                if tiles.size + n_loose > HELD:
                    yield from batches_out()
                    n_loose = 0
        yield from batches_out()

    rows = encoded.select("ids").mapInArrow(run, "hi long, lo long, n long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _known(grams: DataFrame, size: int, head: int, shorter: Known | None) -> Known:
    """The ``head`` most frequent grams (a bounded table) and the bitmap of all, if more than those are frequent or some start with a pair beyond the head."""
    ranked = numbered_by(grams, "at", F.desc("a"), F.col("hi"), F.col("lo"))
    top = ranked.where(F.col("at") < head).select("at", "hi", "lo").toArrow()
    order = np.argsort(top.column("at").to_numpy())
    hi, lo = (top.column(c).to_numpy()[order] for c in ("hi", "lo"))
    if size == 2:
        key, beyond = hi, False
    else:
        first = shorter.find(hi)
        key, beyond = np.where(first >= 0, first << 32 | lo, -1 - np.arange(len(hi))), bool((first < 0).any()) or shorter.bitmap is not None
    bitmap = None
    if beyond or ranked.where(F.col("at") >= head).limit(1).count():

        def hashes(batches):
            for batch in batches:
                h = _mixed(*(batch.column(c).to_numpy() for c in ("hi", "lo")))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

        bitmap = np.zeros(1 << (TAIL_BITS - 3), np.uint8)
        for bucket, bits in slot_bitmap(grams.select("hi", "lo").mapInArrow(hashes, "h long"), TAIL_BITS).collect():  # at most 4,096 rows of 4 KB
            bitmap[bucket * 4096 : bucket * 4096 + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return Known(hi, lo, key, bitmap)


def _with_numbers(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(ids) of each chunk: numbers of frequent words, 0 where a piece ends or a word is rare; words with no frequent neighbour are left out."""
    local = parts.select("chunk", "lang", F.posexplode("words").alias("code", "word"))
    numbers = local.join(vocabulary.select("lang", "word", "number"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list("code").alias("code"), F.collect_list("number").alias("number"))

    def run(batches):
        for batch in batches:
            for raw, code, number in zip(batch.column("codes"), batch.column("code"), batch.column("number")):
                s, code = np.frombuffer(raw.as_py(), np.int32), code.values.to_numpy()
                table = np.zeros(max(int(s.max(initial=0)), int(code.max(initial=0))) + 2, np.int32)  # the last one is for -1
                table[code] = number.values.to_numpy()
                s = np.r_[np.int32(0), table[s], np.int32(0)]
                alone = np.zeros(len(s), bool)
                alone[1:-1] = (s[:-2] == 0) & (s[2:] == 0)
                s[alone] = 0
                s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]
                yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["ids"])

    return parts.select("chunk", "codes").join(numbers, "chunk").select("codes", "code", "number").mapInArrow(run, "ids binary")


def _word(hi: Column, lo: Column, at: int) -> Column:
    """Number of the word ``at`` (0 to 3) of a gram."""
    return F.shiftright(hi, 32) if at == 0 else hi.bitwiseAND(F.lit(0xFFFFFFFF)) if at == 1 else lo if at == 2 else lo.bitwiseAND(F.lit(0xFFFFFFFF))


def _gram(numbers: list[Column]) -> Column:
    """Struct (hi, lo) of a gram of one to four words: one word is (number, 0)."""
    two = lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)
    hi = numbers[0] if len(numbers) == 1 else two(*numbers[:2])
    lo = F.lit(0).cast("long") if len(numbers) < 3 else numbers[2] if len(numbers) == 3 else two(*numbers[2:])
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _numbers(size: int) -> list[Column]:
    last = [F.shiftright("lo", 32) if k == 2 and size == 4 else _word(F.col("hi"), F.col("lo"), k) for k in range(2, size)]
    return [_word(F.col("hi"), F.col("lo"), k) for k in range(min(size, 2))] + last


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, head: int = 1 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    A null language is ``und``, and so is the language of that name; an empty one is its own.  Null and empty texts have no
    words, and repeated rows count each.  ``n`` counts all words of the language, rare ones too.  Counts are longs; products
    and quotients decimals of 38 digits, so scores are exact.  Ties of score and count go by the phrase's bytes.  Texts of any
    length are read whole, cut where pieces end.  Other columns of ``docs`` are not read.  An empty table has no phrases.
    """
    with small_batches(docs.sparkSession):  # a chunk is a row of megabytes
        return _mined(docs, lang_col, text_col, least, top, head)


def _mined(docs: DataFrame, lang_col: str, text_col: str, least: int, top: int, head: int) -> DataFrame:
    """See :func:`mine`; all that goes through Python is stored here."""
    big = lambda c: c.cast("decimal(19,0)")
    parts = stored(chunks(docs, lang_col, text_col).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    single = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("a"))
    frequent = stored(single.where(F.col("a") >= least), "words")
    vocabulary = stored(numbered_by(frequent, "at", F.desc("a"), F.col("lang"), F.col("word")).select("lang", "word", "a", (F.col("at") + 1).alias("number")), "vocabulary")
    encoded = stored(_with_numbers(parts, vocabulary), "encoded")
    totals = parts.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))

    grams, known = [], []
    for size in (2, 3, 4):
        grams.append(stored(count_grams(encoded, size, known, least), f"grams{size}"))
        if size < 4:
            known.append(_known(grams[-1], size, head, known[-1] if known else None))

    # Parts of both sides of every cut, all looked up in one join.
    counts = reduce(DataFrame.unionByName, [vocabulary.select(F.col("number").alias("hi"), F.lit(0).cast("long").alias("lo"), "a"), *grams[:2]])
    cuts, inside, spelled = [], [], []
    for size, found in zip((2, 3, 4), grams):
        w = _numbers(size)
        sides = [F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), _gram(w[:k] if left else w[k:]).alias("part")) for k in range(1, size) for left in (True, False)]
        cuts.append(found.select("hi", "lo", "a", F.explode(F.array(*sides)).alias("s")))
        spelled.append(found.select("hi", "lo", F.posexplode(F.array(*w)).alias("at", "number")))
        if size > 2:
            inside.append(found.select("a", F.explode(F.array(*[_gram(w[i : i + m]) for m in range(2, size) for i in range(size - m + 1)])).alias("g")))
    cut = reduce(DataFrame.unionByName, cuts).select("hi", "lo", "a", "s.k", "s.left", F.col("s.part.hi").alias("p_hi"), F.col("s.part.lo").alias("p_lo"))
    met = cut.join(counts.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("a").alias("m")), ["p_hi", "p_lo"])
    sides = met.groupBy("hi", "lo", "a", "k").agg(F.sum(F.when(F.col("left"), F.col("m"))).alias("l"), F.sum(F.when(~F.col("left"), F.col("m"))).alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = sides.withColumn("score", score).groupBy("hi", "lo", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("hi", "lo", "a", "c.score", "c.l", "c.r")
    longer = reduce(DataFrame.unionByName, inside).groupBy(F.col("g.hi").alias("hi"), F.col("g.lo").alias("lo")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["hi", "lo"], "left").where(F.col("longer").isNull() | (big(F.col("longer")) * 100 < big(F.col("a")) * 80)).drop("longer")

    letters = reduce(DataFrame.unionByName, spelled).join(kept, ["hi", "lo"], "left_semi").join(vocabulary.select("number", "lang", "word"), "number")
    phrases = letters.groupBy("hi", "lo").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws")).select("hi", "lo", "lang", F.array_join("ws.word", " ").alias("phrase"))
    rows = stored(kept.join(phrases, ["hi", "lo"]).drop("hi", "lo"), "phrases")
    placed = numbered_by(rows, "at", F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase"))
    first = placed.groupBy("lang").agg(F.min("at").alias("first"))
    return placed.join(first, "lang").join(totals, "lang").withColumn("rank", F.col("at") - F.col("first") + 1).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
