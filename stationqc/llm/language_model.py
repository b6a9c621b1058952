"""Language-model scoring with a hashed maximum-entropy model.

Every word has a symbol: the most frequent words their own, all others that of their ending.  The model gives the next
symbol by a softmax factored into classes (class given context, symbol given class and context) over features of the
context: the word before (n-gram), the one before that (skip) and the pair of both, hashed.  A word that shares its symbol
takes its smoothed share of the symbol's training tokens.

All training texts count.  One pass counts words; a second counts (context, symbol) triples, which are all that the
gradient needs: contexts have their features in common.  Gradient steps run over those counts, dealt to blocks, and add up
in Spark.  Scoring reads each text once, in sparse numpy batches: only the contexts of a batch are worked out.  Words
outside the bounded dictionary of frequent words look up their counts by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words with a symbol of their own, symbols of endings, and the end of a text: OWN + ENDINGS + 1 symbols in classes of WIDE.
OWN, ENDINGS, WIDE = 255, 128, 16
SYMBOLS = OWN + ENDINGS + 1
CLASSES = SYMBOLS // WIDE
END, START = SYMBOLS - 1, SYMBOLS
CONTEXTS = (SYMBOLS + 1) ** 2
#: Rows of the weight table: two for each symbol by place, one for all, and the hashed pairs.
ROWS = 4096
#: Words that every task may hold with their counts; rarer ones are joined.
DICTIONARY = 200_000
BLOCKS, SLICES = 64, 16
FLUSH_TOKENS, FLUSH_WORDS = 2_000_000, 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def split_words(text: str | None) -> list[bytes]:
    """ASCII capitals lowered, split at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def ending(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Dictionary:
    """The most frequent training words: at most DICTIONARY."""

    place: dict[bytes, int]
    count: np.ndarray
    symbol: np.ndarray

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols of the words and the end, places in the dictionary (-1: not in it), and the words that aren't in it."""
        words = split_words(text)
        get = self.place.get
        places = np.array([get(w, -1) for w in words], np.int64)
        symbols = np.empty(len(words) + 1, np.int64)
        symbols[:-1] = self.symbol[places] if len(self.symbol) else END
        rare = np.flatnonzero(places < 0).tolist()
        for i in rare:
            symbols[i] = ending(words[i])
        symbols[-1] = END
        return symbols, places, [words[i] for i in rare]


def contexts(symbols: np.ndarray) -> np.ndarray:
    """Context number of each token: the symbol two before, then the one before."""
    padded = np.concatenate([[START, START], symbols])
    return padded[:-2] * (SYMBOLS + 1) + padded[1:-1]


def active(ctx: np.ndarray) -> np.ndarray:
    """The rows of the weight table that a context turns on."""
    two, one = np.divmod(ctx, SYMBOLS + 1)
    first = 1 + 2 * (SYMBOLS + 1)
    pair = first + ((ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (ROWS - first)
    return np.stack([np.zeros(len(ctx), np.int64), 1 + one, 1 + SYMBOLS + 1 + two, pair], axis=1)


def log_probabilities(weights: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs for each context: of the classes, and of the symbols given their class."""
    rows = active(ctx)
    total = weights[rows[:, 0]].astype(np.float32)
    for k in range(1, rows.shape[1]):
        total += weights[rows[:, k]]
    cls, sym = total[:, :CLASSES], total[:, CLASSES:].reshape(len(ctx), CLASSES, WIDE)
    norm = lambda a: a - a.max(axis=-1, keepdims=True) - np.log(np.exp(a - a.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True))
    return norm(cls), norm(sym)


def _counted(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs`` (text), ends left out."""

    def count(batches):
        held: Counter = Counter()
        names = ["word", "c"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=names)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(split_words(text))
                if len(held) > FLUSH_WORDS:
                    yield pack()
                    held.clear()
        yield pack()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _dictionary(counts: DataFrame, most: int) -> tuple[Dictionary, int]:
    """The words that occur at least so often that ``most`` suffice, and that count."""
    level = F.floor(F.log2("c") * 4).cast("int")
    seen, least = 0, None
    for row in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("l")).toLocalIterator():
        if seen + row.n > most:
            break
        seen, least = seen + row.n, row.c
    rows = [] if least is None else counts.where(F.col("c") >= least).toLocalIterator()
    found = sorted(((r.c, bytes(r.word)) for r in rows), key=lambda x: (-x[0], x[1]))
    symbols = np.array([i if i < OWN else ending(w) for i, (_, w) in enumerate(found)], np.int64)
    return Dictionary({w: i for i, (_, w) in enumerate(found)}, np.array([c for c, _ in found], np.int64), symbols), least or 1 << 62


def _triples(docs: DataFrame, shared) -> DataFrame:
    """(block, codes, counts): how often each symbol follows each context, over all rows; a context is in one block."""

    def flush(held: list[np.ndarray]):
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        block = codes // SYMBOLS % BLOCKS
        order = np.argsort(block, kind="stable")
        codes, n, cuts = codes[order], n[order], np.searchsorted(block[order], np.arange(BLOCKS + 1))
        full = [b for b in range(BLOCKS) if cuts[b] < cuts[b + 1]]
        columns = [full, [codes[cuts[b] : cuts[b + 1]].tobytes() for b in full], [n[cuts[b] : cuts[b + 1]].tobytes() for b in full]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "codes", "counts"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                symbols, _, _ = shared.value.read(text)
                held.append(contexts(symbols) * SYMBOLS + symbols)
                size += len(symbols)
                if size > FLUSH_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.frombuffer(x, np.int64) for x in rows["codes"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
        codes, at = np.unique(codes, return_inverse=True)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "codes": [codes.tobytes()], "counts": [np.bincount(at, n).astype(np.int64).tobytes()]})

    schema = "block int, codes binary, counts binary"
    return docs.select("text").mapInArrow(count, schema).groupBy("block").applyInPandas(merge, schema)


def _sums(blocks: DataFrame, weights: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Expected counts of each (feature, output) under ``weights`` and the log-likelihood, or the observed counts if there are none yet.

    Tasks add up their blocks, and slices of the tables are added up by a second stage: the driver gets one table.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    per = ROWS // SLICES

    def work(batches):
        total, fit = np.zeros((ROWS, CLASSES + SYMBOLS), np.float32), 0.0
        for batch in batches:
            for codes, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ctx, symbol = np.divmod(np.frombuffer(codes, np.int64), SYMBOLS)
                n = np.frombuffer(n, np.int64)
                every, at = np.unique(ctx, return_inverse=True)
                for start in range(0, len(every), 2048):
                    part, own = every[start : start + 2048], (at >= start) & (at < start + 2048)
                    seen = np.bincount((at[own] - start) * SYMBOLS + symbol[own], n[own], len(part) * SYMBOLS).reshape(len(part), CLASSES, WIDE)
                    of_class = seen.sum(axis=2)
                    out = seen
                    if shared.value is not None:
                        cls, sym = log_probabilities(shared.value, part)
                        fit += float((seen * sym).sum() + (of_class * cls).sum())
                        out = of_class[:, :, None] * np.exp(sym)
                        of_class = of_class.sum(axis=1, keepdims=True) * np.exp(cls)
                    both = np.concatenate([of_class, out.reshape(len(part), SYMBOLS)], axis=1).astype(np.float32)
                    rows = active(part)
                    total[0] += both.sum(axis=0)
                    for k in range(1, rows.shape[1]):
                        order = np.argsort(rows[:, k], kind="stable")
                        ids, cuts = np.unique(rows[order, k], return_index=True)
                        total[ids] += np.add.reduceat(both[order], cuts, axis=0)
        names = ["slice", "part", "fit"]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * per : (i + 1) * per].tobytes() for i in range(SLICES)], pa.binary()), pa.array([fit / SLICES] * SLICES)], names=names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows["part"])
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "part": [total.astype(np.float32).tobytes()], "fit": [rows["fit"].sum()]})

    schema, whole, fit = "slice int, part binary, fit double", np.zeros((ROWS, CLASSES + SYMBOLS), np.float32), 0.0
    for row in blocks.mapInArrow(work, schema).groupBy("slice").applyInPandas(add, schema).toLocalIterator():
        whole[row.slice * per : (row.slice + 1) * per] = np.frombuffer(row.part, np.float32).reshape(per, -1)
        fit += row.fit
    shared.destroy()
    return whole, fit


def fit(blocks: DataFrame, steps: int = 12, rate: float = 0.3, prior: float = 3.0) -> tuple[np.ndarray, list[float]]:
    """The weights after ``steps`` gradient steps over all triples, and the log-likelihood before each.

    The gradient is observed minus expected count minus ``prior`` times the weight (a Gaussian prior).  It is divided by
    the expected count, which bounds the curvature, and shortened by ``rate``, as four features act at once.  It starts at
    the smoothed overall frequencies.
    """
    observed, _ = _sums(blocks, None)
    weights = np.zeros_like(observed)
    weights[0] = np.log(observed[0] + 0.5)
    history = []
    for _ in range(steps):
        expected, value = _sums(blocks, weights)
        history.append(value)
        pull = prior * weights
        pull[0] = 0
        move = (observed - expected - pull) / (np.maximum(expected, 0.2 * observed) + prior)
        weights += np.clip(rate * move, -1, 1).astype(np.float32)
    return weights, history


@dataclass
class Model:
    dictionary: Dictionary
    weights: np.ndarray
    #: log10 of the training tokens, distinct words and one, for each ending's symbol
    shares: np.ndarray
    log_all: float


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Rows whose crc32 of the id is 2 modulo 7 are held out; all others, those without an id too, are learned from.  Null
    and empty texts are one end token.  Repeated rows count as often as they occur and are scored each.  Without training
    rows every count is zero and the model stays uniform.  Texts of any length are read whole.  Words of one count are
    ordered by their bytes where the dictionary ends.  Other columns, whatever their names, are not read.  Scores are log10.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    learned = rows.where("NOT held_out").select("text")
    counts = stored(_counted(learned), "words")
    n_docs = learned.count()
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n_all, v_all = totals.n + n_docs, totals.v + (n_docs > 0)
    words, least = _dictionary(counts, DICTIONARY)
    shared_words = spark.sparkContext.broadcast(words)
    blocks = stored(_triples(learned, shared_words), "triples")
    shared_words.destroy()
    weights, _ = fit(blocks, steps)

    # tokens and distinct words of each ending, over the words without a symbol of their own
    by_ending = F.crc32(F.substring("word", -2, 2)) % ENDINGS
    tokens, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy(by_ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toLocalIterator():
        tokens[r.e], kinds[r.e] = r.n, r.v
    for w, i in words.place.items():
        if i < OWN:
            tokens[ending(w) - OWN] -= words.count[i]
            kinds[ending(w) - OWN] -= 1
    model = spark.sparkContext.broadcast(Model(words, weights, np.log10(tokens + kinds + 1), float(np.log10(n_all + v_all + 1))))

    def run(batches):
        m, own = model.value, TaskContext.get().partitionId() << 33
        end = float(np.log10(n_docs + 1))
        logs = np.log10(np.append(m.dictionary.count, 0) + 1.0)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 512):
                read = [m.dictionary.read(x) for x in batch.column(1).slice(at, 512).to_pylist()]
                ctx = np.concatenate([contexts(s) for s, _, _ in read])
                symbols = np.concatenate([s for s, _, _ in read])
                picked = np.empty(len(symbols))
                mark = np.zeros(CONTEXTS, bool)
                mark[ctx] = True
                every = np.flatnonzero(mark)
                where = np.zeros(CONTEXTS, np.int64)
                for start in range(0, len(every), 8192):
                    part = every[start : start + 8192]
                    where[:] = -1
                    where[part] = np.arange(len(part))
                    hit = np.flatnonzero(where[ctx] >= 0) if len(every) > 8192 else slice(None)
                    cls, sym = log_probabilities(m.weights, part)
                    line, s = where[ctx[hit]], symbols[hit]
                    picked[hit] = (cls[line, s // WIDE].astype(np.float64) + sym[line, s // WIDE, s % WIDE]) / np.log(10)
                cut = 0
                for s, places, rare in read:
                    known = logs[places].sum() + end
                    several = (s >= OWN) & (s != END)
                    tail = logs[places[several[:-1]]].sum() - m.shares[s[several] - OWN].sum()
                    out.append((len(s), int((places >= 0).sum()) + (n_docs > 0), known - len(s) * m.log_all, picked[cut : cut + len(s)].sum() + tail, list(Counter(rare).items())))
                    cut += len(s)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)]
            rid = pa.array(np.arange(own, own + len(batch)))
            own += len(batch)
            yield pa.RecordBatch.from_arrays([rid, batch.column(0), batch.column(2), *columns], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = stored(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<struct<word:binary,n:long>>"), "scored")
    rare = read.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    found = rare.join(counts.where(F.col("c") < least), "word")  # words that were never learned add nothing
    more = found.groupBy("rid").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    zero = F.coalesce(F.col("logs"), F.lit(0.0))
    return read.drop("rare").join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero).alias("base_score"),
        (F.col("own") + zero).alias("score"),
    )
