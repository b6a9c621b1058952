"""Whitening, exact search and phrases against plain versions, and their odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationqc.llm import collocations, common, top_search, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [None, [None, 1.0, 2.0, 3.0], [math.nan, 1.0, 2.0, 3.0], [math.inf, 0.0, 0.0, 0.0], [1.0, -math.inf, 0.0, 0.0], [3e38, 0.0, 0.0, 0.0]]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], VECTORS)


def plain_whitening(rows, most=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1][:, :most]
    return ((n * x - s) ** 2).sum(axis=1), c @ v / np.sqrt(e[:most]), e[:most] / e.sum()


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12)) * np.linspace(1, 3, 12) + 5
    rows = [*enumerate(x.tolist()), (None, x[0].tolist()), (7, x[7].tolist())]
    df = vectors(spark, [*rows, *((9000 + i, v) for i, v in enumerate(ODD))]).selectExpr("*", "1 AS component", "2 AS whitened", "3 AS __x", "4 AS n", "5 AS at")
    got = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        got[r.vec_id].setdefault(r.component, []).append(r)
    assert set(got) == {i for i, _ in rows} and all(set(g) == set(range(1, 9)) for g in got.values()) and len(got[7][1]) == 2
    deviation, white, explained = plain_whitening([v for _, v in rows])
    signs = [math.copysign(1, white[0, k] * got[0][k + 1][0].whitened) for k in range(8)]
    for at, (i, _) in enumerate(rows):
        for k in range(8):
            r = got[i][k + 1][0]
            assert r.n == 402 and r.deviation == deviation[at] and abs(r.whitened * signs[k] - white[at, k]) < 1e-9
            assert abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_equal_eigenvalues_few_rows_and_none(spark):
    axes = [[s * 4.0 * (k == d) for k in range(5)] for d in range(5) for s in (1, -1)]  # one eigenvalue, five times
    got = whitening.whiten(vectors(spark, list(enumerate(axes)))).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and all(r.identity_error < 1e-9 and abs(r.explained - 0.2) < 1e-9 for r in got)
    line = whitening.whiten(vectors(spark, [(i, [i, 2 * i, 0]) for i in range(6)])).collect()  # rank one
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-9 for r in line)
    for rows in ([], [(1, None)], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(1, [])]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []
    mixed = whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [3]), (3, [0, 5])])).collect()  # the short one ends in zeros
    assert {r.vec_id for r in mixed} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in mixed)


def plain_top(rows, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e16 for c in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for other, (j, x) in enumerate(usable) if other != at)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_top_search_against_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    if kind == "random":
        x = rng.normal(size=(700, 8))
    elif kind == "clusters":
        x = rng.normal(size=(9, 8))[rng.integers(0, 9, 700)] * 4 + rng.normal(size=(700, 8)) * 0.02
    else:
        x = rng.integers(0, 2, size=(700, 4))
    monkeypatch.setattr(top_search, "PIECE", (16, 64))
    ids = rng.permutation(3000)[:700].tolist()
    rows = [*zip(ids, x.tolist()), (50, x[0].tolist()), (50, x[0].tolist()), (100, x[1].tolist()[:2]), (None, x[2].tolist()), *((150 + 50 * i, v) for i, v in enumerate(ODD))]
    df = vectors(spark, rows).selectExpr("*", "1 AS row", "2 AS id", "3 AS rank", "4 AS x", "5 AS q_block")
    got = sorted(map(tuple, top_search.top_k(df, block_rows=100, pivots=6, sample=90).collect()))
    assert got == plain_top(rows)


def test_top_search_follows_the_bounds(monkeypatch):
    """Within distant clusters only like candidates are evaluated, and none is lost."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 2000 + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    centres = top_search.choose_pivots(x, 32)
    far = np.sqrt(((x[:, None, :].astype(float) - centres) ** 2).sum(axis=2))
    block = lambda at: {"row": np.arange(4000)[at], "id": np.arange(4000)[at], "x": x[at], "far": far[at]}
    best = top_search._Best(20, 5, np.full(20, -np.inf))
    top_search.search_pair(best, block(slice(0, 20)), block(slice(0, 600)))
    pairs, looked = top_search.search_pair(best, block(slice(0, 20)), block(slice(600, 4000)))
    assert looked < 0.2 * pairs
    want = [sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5] for i in range(20)]
    assert [[(-s, j) for s, j in zip(a, b)] for a, b in zip(best.score.tolist(), best.ids.tolist())] == want


def test_top_search_of_few_none_and_large(spark):
    found = lambda rows: sorted(map(tuple, top_search.top_k(vectors(spark, rows)).collect()))
    assert found([]) == found([(0, None)]) == found([(0, [1, 2])]) == []
    assert found([(0, [1, 0]), (1, [2, 0])]) == [(0, 1, 1, 256 * 512)]
    assert found([(0, []), (1, [])]) == [(0, 1, 1, 0)]
    large = [(0, [2**41, 1]), (1, [2**41, -1]), (2, [-(2**41), 1]), (3, [2**20, 0])]  # 2^49 each: products pass a long
    assert found(large) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def plain_phrases(rows, least, top):
    words, pieces = defaultdict(int), defaultdict(list)
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            if ws := re.findall("[^\x20\x09]+", piece):
                words[lang] += len(ws)
                pieces[lang].append(ws)
    out = []
    for lang, all_pieces in pieces.items():
        f = Counter(tuple(ws[i : i + m]) for ws in all_pieces for m in (1, 2, 3, 4) for i in range(len(ws) - m + 1))
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            s, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not 100 * longer[p] >= 80 * a:
                kept.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, words[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("head,dense", [(1 << 20, True), (1 << 20, False), (15, True), (0, False)])
def test_phrases_against_brute_force(spark, monkeypatch, head, dense):
    """With all numbers, with a head that most pairs and triples are beyond, and with none; tiles dense and sparse; chunks cut small."""
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    monkeypatch.setattr(collocations, "HELD", 50)
    if dense:
        monkeypatch.setattr(collocations, "SIDE_BITS", 2)
    rng = random.Random(8)
    vocabulary = ["a", "B", "see", "été", "ÉTÉ", "x y", "1\x1f2", "the", "quick", "fox", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.randint(3, 11)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), text(rng.randint(0, 60))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("en", " \t "), ("en", "..,"), ("de", "the quick fox " * 4000), ("fr", "one, " * 100)] + [("en", "New York City, New York City")] * 40
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("text", "lang", "1 AS a", "2 AS n", "'x' AS words", "3 AS chunk")
    assert sorted(map(tuple, collocations.mine(df, least=9, top=40, head=head).collect())) == plain_phrases(rows, 9, 40)


def test_phrases_of_nothing_and_of_large_counts(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "word")], "lang string, text string")).collect() == []
    hi = spark.range(1).select(F.lit(10**15).alias("a"), F.lit(2 * 10**15).cast("long").alias("l"), F.lit(10**15).alias("r"))
    quotient = F.expr("(CAST(2000000 AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    assert hi.select(quotient).first()[0] == 666_666


def test_chunks_go_to_python_in_small_batches(spark, monkeypatch):
    seen, write = [], collocations.stored

    def sized(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    def stored(df, tag):
        big = spark.range(0, 20, 1, 1).select(F.repeat(F.lit("abcdefghij"), 300_000).cast("binary").alias("x"))
        seen.append(max(r.size for r in big.mapInArrow(sized, "size long").collect()))
        return write(df, tag)

    monkeypatch.setattr(collocations, "stored", stored)
    collocations.mine(spark.createDataFrame([("en", "a b")] * 40, "lang string, text string")).collect()
    assert seen and max(seen) < 13_000_000  # the row that passes 8 MB is the last
    assert spark.conf.get(common.BATCH_BYTES, None) is None
