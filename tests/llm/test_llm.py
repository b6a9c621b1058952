import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash

from stationqc.llm import chat_format, exact_dedup, html_extract, language_id, language_model, line_dedup, near_copies, packing, quality_rules, sentencepieces, simhash
from stationqc.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string"
TEXTS = [None, "", "   ", "one", "a b c d e", "A  b\tc d e", "a b c d e", "word " * 70, "x\n" * 9, "ünï cödé \n\n text", "the quick brown fox jumps over the lazy dog " * 900]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, and a column named like an output."""
    df = docs(spark, TEXTS)
    return df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(None, "a b c d e", None, None)], DOCS)).selectExpr("*", "1 AS kept", "'x' AS keep_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def squeeze(t):
    return " ".join(x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "|" + (t or "") + "|"))[1:-1]


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.mark_copies(odd).collect()
    groups = {}
    for r in odd.collect():
        groups.setdefault(squeeze(r.text), []).append(r.doc_id)
    assert len(got) == odd.count()
    for r in got:
        ids = groups[squeeze(r.text)]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
        assert r.text_sha256 == hashlib.sha256(squeeze(r.text).encode()).hexdigest()
    kept = [squeeze(r.text) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and sorted(squeeze(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.mark_copies(none).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        values = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)), values)
    values = np.arange(5, dtype=np.uint64)
    assert np.array_equal(exact_dedup.golomb_decode(5, *exact_dedup.golomb_encode(values)), values)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, none):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(40)]
    near = [t.replace(t.split()[30], t.split()[30] + "x", 1) for t in base[:20]]
    texts = [None, "", " ", "one", "One", "a b", *base, *near, *base[:5]]
    fps = [plain_fingerprint(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert {i: v[0] % 2**64 for i, v in got.items()} == dict(enumerate(fps))
    assert {i: v[1] for i, v in got.items()} == {i: root(i) for i in range(len(texts))}
    left = simhash.drop_near_duplicates(docs(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted({root(i) for i in range(len(texts))})
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies_of_wider_distance_go(spark, none):
    """Copies with changed words, which differ in more than two bits: a chain, a family, a repeated id, a null id."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 300))) for _ in range(60)]

    def changed(t, k):
        w = t.split()
        for at in rng.sample(range(len(w)), k):
            w[at] = "changed"
        return " ".join(w)

    near = [changed(t, 1 + len(t.split()) // 150) for t in base[:30]] + [changed(base[0], 1) for _ in range(20)]
    half = [changed(t, 12) for t in base[30:40]]  # candidates at most, but under the similarity
    texts = [*base, *near, *half, "", None, "a b", "A  b"]
    sets = [near_copies.shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near_copies.similarity(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    assert sum(bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 2 for i, j in pairs) > 30
    got = near_copies.drop_similar(docs(spark, texts))
    assert got.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({root(i) for i in range(len(texts))})
    rows = [(1, base[0], "en", "s"), (2, near[0], "en", "s"), (2, base[1], "en", "s"), (None, base[2], "en", "s"), (3, near[2], "en", "s"), (3, near[2], "en", "s")]
    left = near_copies.drop_similar(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, base[0]), (2, base[1]), (3, near[2])])
    assert near_copies.drop_similar(none).count() == 0


def test_local_forest_links_everything_across_tiles():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = np.unique(np.concatenate([centre, *[centre ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 60)]]))
    for left, right in ((fps, None), (fps[::2], fps[1::2])):
        src, dst = simhash.local_forest(left, right, 2)
        up = {int(x): int(x) for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in zip(src.tolist(), dst.tolist()):
            up[root(a)] = root(b)
        pairs = [(a, b) for a in left.tolist() for b in (left if right is None else right).tolist() if bin(a ^ b).count("1") <= 2]
        assert all(root(a) == root(b) for a, b in pairs) and pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90 + k) for k in range(9)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{90 + k: 90 for k in range(9)}, 100: 90}


def test_quality_rules(spark, odd, none):
    junk = ["".join(f"word{i}*** " for i in range(80)), "".join(f"WORD{i}!! " for i in range(80)), " ".join(f"clean{i} word{i} number{i}" for i in range(40))]
    plain = " ".join(f"clean{i} word{i}" for i in range(30))
    junk += [f"said twice\n{plain}\nsaid twice", f"{plain}\nx\nx\nx\nx\nx"]  # one repeated line is no defect, many are
    df = docs(spark, [*TEXTS, *junk])
    got = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(df)).collect()}
    for i, t in enumerate([*TEXTS, *junk]):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(hit), sum(map(len, w)))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    n = len(TEXTS)
    assert [got[n + k].kept for k in range(5)] == [False, False, True, True, False] and not got[n + 4].base_failed
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df).count() == sum(r.kept for r in got.values())
    regained = {r.rule: r.n_regained for r in quality_rules.ablation(quality_rules.ledger(df)).collect()}
    assert regained["symbols"] == 1
    assert quality_rules.ledger(odd).count() == odd.count() and quality_rules.ledger(none).count() == 0


def test_line_dedup(spark, odd, none):
    a, b, long = "first line here\nsecond line here\nthird one", "other start\nand more", " ".join(f"w{i}" for i in range(60))
    df = docs(spark, [f"{a}\n{long}\n{b}", f"new head\n{long}\ntail", f"x\ny\nz\n{a}", f"{a}", None, "", long])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, divisor=1_000_000_007).collect()}  # documents are chunks
    assert got[0].n_removed_lines == 0 and got[1].text == "new head\ntail" and got[6].text == "" and got[4].text is None and got[5].text == ""
    assert got[3].text == "" and got[2].text == "x\ny\nz"  # not the same chunks, but the run is followed to its ends
    again = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, [a, a, f"{a}\n{long}", long, f"{a}\n{long}"]), divisor=1_000_000_007).collect()}
    assert [(again[i].text, again[i].n_removed_lines, again[i].n_removed_chunks) for i in range(5)] == [(a, 0, 0), ("", 3, 1), (long, 3, 1), ("", 1, 1), ("", 4, 1)]
    shifted = [f"line {i} of a passage" for i in range(40)]
    moved = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, ["\n".join(["own start", *shifted, "own end"]), "\n".join(["one", "two", *shifted, "three"])])).collect()}
    assert moved[0].n_removed_lines == 0 and moved[1].text == "one\ntwo\nthree"  # boundaries move along
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def test_chat_windows(spark):
    rng, rows, want = random.Random(2), [], {}
    for c in range(12):
        turns = [("system", "be good")] if c % 3 == 0 else []
        for t in range(rng.randint(0, 30)):
            turns.append((("user", "assistant")[t % 2], rng.choice(["", "<|im_end|>\n", "a <\\| b [INST] </s>", "word " * rng.randint(1, 40), "<", "\n"]) + rng.choice(["", "<", "\\"])))
        rows += [(c, i, r, t or None) for i, (r, t) in enumerate(turns)]
        if turns:
            want[c] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.windows(df, budget=120, context=40)
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert all(r.formatted.count("be good") == 1 for r in out.where("conv_id % 3 = 0").collect() if r.conv_id in want)
    assert chat_format.windows(df.limit(0)).count() == 0


def test_sentencepieces(spark, odd, none):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    got = sentencepieces.encode(odd, file).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is None:
            continue
        text = by_id[r.doc_id] or ""
        assert r.ids == sp.encode(text, add_eos=True) and r.decoded == sp.decode(r.ids)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data
    assert sentencepieces.encode_digests(none, file).count() == 0


def test_compiled_map_takes_the_longest_source():
    """A double array made by hand: 'a' becomes X, 'ab' becomes YZ."""
    units = [0] * 1024
    texts = b"X\0YZ\0"

    def put(at, label, leaf, offset):
        units[at] = label | leaf << 8 | offset << 10

    put(0, 0, 0, 256)
    a = 256 ^ ord("a")
    put(a, ord("a"), 1, a ^ 700)
    units[700] = 0x80000000 | 0
    b = 700 ^ ord("b")
    put(b, ord("b"), 1, b ^ 900)
    units[900] = 0x80000000 | 2
    blob = (len(units) * 4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts
    m = sentencepieces.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"c", 0) is None


def test_packing(spark, none):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 300), f"s{rng.randint(0, 6)}", f"c{rng.randint(0, 120)}") for i in range(300)] + [(900, 0, "s", "c"), (901, None, "s", "c"), (902, 100, None, None), (None, 7, "s1", "c1")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(df, capacity=128, max_per_source=2, shard_rows=100).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    size, src, cl = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    assert Counter({d: sum(r.n_tokens for r in got if r.doc_id == d) for d in {r.doc_id for r in got}}) == Counter({d: n for d, n in size.items() if n})
    for items in bins.values():
        at = 0
        for r in sorted(items, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == items[0].bin_fill <= 128
        assert max(Counter(src[r.doc_id] for r in items if src[r.doc_id]).values(), default=0) <= 2
        assert max(Counter(cl[r.doc_id] for r in items if cl[r.doc_id]).values(), default=0) <= 1
    assert packing.pack(packing.items_of(none)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, offsets, fill = packing.best_fit([60, 50, 40, 38], [0, 1, 0, -1], [-1, -1, 3, 3], 100, 1)
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 50, 60] and fill == [98, 90, 90, 98]


def test_html():
    trees = html_extract.Trees()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(30)) for _ in range(20)]
    made = [html_extract.parse(html_extract.layout(rng, rng.sample(texts, 8))) for _ in range(250)]
    trees.fit(np.concatenate([html_extract.features(p) for p in made]), np.concatenate([html_extract.labels(p, False) for p in made]))
    wrong = 0
    for _ in range(60):
        p = html_extract.parse(html_extract.layout(rng, rng.sample(texts, 8)))
        kept = html_extract.decode(p.parents, trees.score(html_extract.features(p)))
        wrong += [p.marks[n] for n, _, _ in p.runs] != [kept[n] for n, _, _ in p.runs]
    assert wrong <= 6
    page = html_extract.parse("<body><p>a &lt;b&gt;\n c<p>two<br>lines <i>x</i>y<script>var a='</p>'</script></p><!-- no --> tail &am")
    assert [t for _, t, _ in page.runs] == ["a <b> c", "two lines xy", "tail &am"]
    assert html_extract.parse("").runs == [] and html_extract.main_text(html_extract.parse("<p"), [True]) == ""
    assert html_extract.decode([-1, 0, 1, 1], [0, -1.0, 3.0, -2.0]) == [True, True, True, False]


def test_html_in_spark(spark):
    rows = [(1, "u", "<html><body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>Head</h1><p>Body text is here, and long enough to be read.</p></article><footer>foot</footer></body></html>"), (2, "u", None), (3, None, "")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string")
    got = html_extract.extract(df, html_extract.train(df, synthetic=200)).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, "Head\n\nBody text is here, and long enough to be read."), (2, ""), (3, "")} and len(got) == 6


def test_language_id(spark, none):
    en, fr = "the cat and the dog are in the house with us and we like that", "le chat et le chien sont dans la maison avec nous et nous aimons cela"
    rows = [(i, (en, fr)[i % 2] * (1 + i % 3), ("en", "fr")[i % 2], f"{('a.example.com', 'b.example.fr')[i % 2]}") for i in range(60)]
    rows += [(100, None, "en", "a.example.com"), (101, "12 34 !!", None, None), (102, fr, "en", None), (103, "ok", "fr", "b.example.fr")]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(df.where("doc_id < 60").selectExpr("text", "lang AS language"))
    got = {r.id: r for r in language_id.identify(df.selectExpr("doc_id AS id", "text", "lang AS declared", "source AS host"), model).collect()}
    assert all(got[i].language == ("en", "fr")[i % 2] and got[i].accepted for i in range(60))
    assert got[100].language is None and not got[100].accepted and not got[101].accepted and got[102].language == "fr" and got[103].language == "fr"
    left = language_id.keep_identified(df, model=model)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [*range(60), 102, 103]
    assert language_id.keep_identified(none).count() == 0


def test_language_id_knows_what_it_does_not_know(spark):
    """Texts of a language without labels, and of random letters, whatever they are declared as, are not accepted."""
    rng = random.Random(4)
    en, fr = "the cat and the dog are in the house with us and we like that they sat there then", "le chat et le chien sont dans la maison avec nous et nous aimons cela quand elle est la"
    said = lambda t: " ".join(rng.choice(t.split()) for _ in range(60))
    rows = [(i, said((en, fr)[i % 2]), ("en", "fr")[i % 2], "a.example.com") for i in range(200)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах"
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(8)]
    rows += [(1000 + i, t, d, "a.example.com") for i, t in enumerate([polish, russian, *letters]) for d in (None, "fr", "pl")]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(df.where("doc_id < 200").selectExpr("text", "lang AS language"))
    got = language_id.identify(df.selectExpr("doc_id AS id", "text", "lang AS declared", "source AS host"), model).collect()
    assert {r.id for r in got if r.accepted} == set(range(200)) and all(r.language and r.posterior < 0.6 for r in got if r.id >= 1000)
    assert {r.doc_id for r in language_id.keep_identified(df, model=model).collect()} == set(range(200))


def test_language_model(spark, none):
    rng = random.Random(3)
    texts = [" ".join(rng.choice((["the", "of", "and", "cat"], ["le", "de", "et", "chat"])[i % 2]) for _ in range(40)) + f" rare{i}" for i in range(120)] + [None, ""]
    got = {r.doc_id: r for r in language_model.score(docs(spark, texts), steps=8).collect()}
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        assert got[i].held_out == held[i] and got[i].n_tokens == len(t) and got[i].n_known == sum(c[w] > 0 for w in t) and got[i].train_tokens == n
        assert abs(got[i].base_score - sum(log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-8
    out = [i for i, h in enumerate(held) if h]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)
    assert language_model.score(none).count() == 0


def test_factored_softmax_adds_up_to_one():
    weights = np.random.default_rng(0).normal(0, 1, (language_model.ROWS, language_model.CLASSES + language_model.SYMBOLS)).astype(np.float32)
    cls, sym = language_model.log_probabilities(weights, np.array([0, 5, language_model.CONTEXTS - 1]))
    assert np.allclose((np.exp(cls)[:, :, None] * np.exp(sym)).sum(axis=(1, 2)), 1, atol=1e-4)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "dog", "ran", "far", "away", "home", "tree"]) + rng.choice(["", "s", "ed"]) for _ in range(120)) for _ in range(30)]
    near = [t + " and so on" for t in good[:6]] + ["again " + t for t in good[4:8]]  # four of five-word shingles are shared, and more
    half = [" ".join(good[k].split()[:60] + good[k + 1].split()[60:]) for k in range(10, 14)]
    texts = [*good, *good[:5], *near, *half, "short", None, "12 34", "word " * 80]
    docs(spark, texts).selectExpr("*", "coalesce(length(text), 0) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    body = [*good, *good[:5], *near, *half]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in body)]
    first = list(range(len(body)))  # the smallest document that links of 0.8 or more lead to
    for _ in body:
        for i, a in enumerate(shingles):
            for j, b in enumerate(shingles[:i]):
                if len(a & b) >= 0.8 * len(a | b):
                    first[i] = first[j] = min(first[i], first[j])
    keep = [i for i, f in enumerate(first) if i == f]
    assert len(keep) == len(good) + len(half)
    from sentencepiece import SentencePieceProcessor

    P = pytest.importorskip("public_tokenizers")
    sp, got = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), {}
    for r in rows:
        for d, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], r.n_tokens]):
            got[d] = r.ids[a:b]
    assert got == {i: sp.encode(body[i], add_eos=True) for i in keep}


