"""Cases that break things: clashing names, order of reading, odd markup, nulls and ties; and brute-force versions."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationqc.llm import chat_format, exact_dedup, html_extract, language_id, language_model, line_dedup, near_copies, packing, quality_rules, sentencepieces, simhash

DOCS = "doc_id long, text string, lang string, source string"
HELPERS = ["bucket", "bitmap", "__slot", "__bucket", "__bitmap", "__maybe", "__k0", "__row", "__fp", "__rid", "__norm", "__text", "__w", "__lines", "__m", "__id", "__key", "__gone", "row", "id", "fp", "norm", "rid", "suspect", "n", "item"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(6)
    body = [" ".join(rng.choice(["the", "cat", "and", "dog", "sat", "on", "a", "mat", "there"]) + rng.choice(["", "s", "ly"]) for _ in range(90)) for _ in range(8)]
    texts = [*body, body[0], body[1] + " end", None, "", f"{body[2]}\nsame line one\nsame line two\n{body[3]}", f"{body[4]}\nsame line one\nsame line two\n{body[3]}"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in HELPERS])


@pytest.mark.parametrize(
    "name,run",
    [
        ("mark_copies", exact_dedup.mark_copies), ("drop_copies", exact_dedup.drop_copies), ("drop_near", simhash.drop_near_duplicates), ("drop_similar", near_copies.drop_similar),
        ("lines", line_dedup.dedup_lines), ("ledger", quality_rules.ledger), ("good", quality_rules.keep_good), ("language", language_id.keep_identified),
    ],
)
def test_columns_of_any_name_pass_through(clashing, name, run):
    got = run(clashing)
    assert [c for c in got.columns if c in HELPERS] == HELPERS
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)


def test_other_operators_ignore_clashing_columns(clashing):
    assert simhash.near_duplicates(clashing).count() == language_model.score(clashing, steps=1).count() == 14
    assert packing.pack(packing.items_of(clashing)).select("doc_id").distinct().count() == 14


def test_packing_depends_on_the_rows_alone(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i]), rng.randint(1, 300), f"s{rng.randint(0, 6)}", rng.choice([None, f"c{i % 90}"])) for i in range(400)] + [(7, 50, "s1", "c1")] * 30
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    one, three = (Counter(map(tuple, packing.pack(df.repartition(n, F.rand(n)), 128, 2, 100).collect())) for n in (1, 3))
    assert one == three and sum(r[3] for r in one.elements()) == sum(r[1] for r in rows)
    tokens = df.select("doc_id", F.sequence(F.lit(1), F.col("n_tokens").cast("int")).alias("ids"), "source", "cluster")
    some = [sorted(packing.sequences(tokens.repartition(n, F.rand(n)), 128, 2, 100).collect(), key=str) for n in (1, 3)]
    assert some[0] == some[1]


def naive_best_fit(items, capacity, most):
    """Every bin is looked at for every item."""
    bins = []
    for length, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + length <= capacity and sum(x[1] == source and source >= 0 for x in b) < most and not any(x[2] == cluster and cluster >= 0 for x in b)]
        if fits:
            bins[min(fits)[1]].append((length, source, cluster))
        else:
            bins.append([(length, source, cluster)])
    return bins


def test_best_fit_bin_by_bin():
    rng = random.Random(2)
    for most in (1, 2, 4):
        items = sorted(((rng.randint(1, 100), rng.randint(-1, 3), rng.randint(-1, 12)) for _ in range(300)), key=lambda x: -x[0])
        at, _, _ = packing.best_fit(*map(list, zip(*items)), 100, most)
        bins = [[] for _ in range(max(at) + 1)]
        for b, item in zip(at, items):
            bins[b].append(item)
        assert bins == naive_best_fit(items, 100, most)


def test_sequences_hold_every_token_once(spark):
    rng = random.Random(1)
    texts = {i: [rng.randint(0, 999) for _ in range(rng.choice([0, 1, 5, 64, 65, 128, 200, 1000]))] for i in range(60)} | {100: None}
    df = spark.createDataFrame([(i, t, f"s{i % 3}", f"c{i % 20}", "x") for i, t in texts.items()], "doc_id long, ids array<int>, source string, cluster string, bin_id string")
    got = packing.sequences(df, 64, 2, 16).collect()
    back = {}
    for r in got:
        assert len(r.ids) == r.n_tokens <= 64 and len(set(r.doc_ids)) == len(r.doc_ids)
        assert max(Counter(d % 3 for d in r.doc_ids).values()) <= 2 and max(Counter(d % 20 for d in r.doc_ids).values()) == 1
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.offsets, [*r.offsets[1:], r.n_tokens]):
            back.setdefault(d, {})[p] = r.ids[a:b]
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in back.items()} == {i: t for i, t in texts.items() if t}
    assert packing.sequences(df.limit(0)).count() == 0


PAGES = [
    ("<html><head><title>T</title><script src='a.js' />var leak=1;</script><style media=x/>p{color:red}</style></head><body><div class='site-header'><p>My Blog</p></div><ul class='menu'><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><div class='post'><h1>Bread at home</h1><p>Mix flour, water and salt, then wait for a long while.</p><noscript>It rises &amp; rests.</noscript><p>Bake it hot, let it cool and eat it with butter.</p></div><div class='comments'><p>I tried this recipe and it was great, thanks a lot!</p></div><div class='footer'><p>Copyright 2020 My Blog, all rights reserved.</p></div></body></html>",
     ["Bread at home", "Mix flour, water and salt, then wait for a long while.", "It rises & rests.", "Bake it hot, let it cool and eat it with butter."], 6),
    ("<body><nav><a href=x>News</a> <a href=y>Sport</a></nav><main><article><h1>Rain is coming</h1><p>Clouds move in from the west, and by noon it will rain.</p><aside class=promo><p>Subscribe to our newsletter for more weather, every day.</p></aside><p>Take an umbrella, since E = <math><mi>m</mi><mi>c</mi></math> holds in the rain, too.</p></article></main><form action=x><p>Tell us what you think, please.</p><input><button>Send</button></form><footer>&copy; News</footer></body>",
     ["Rain is coming", "Clouds move in from the west, and by noon it will rain.", "Take an umbrella, since E = mc holds in the rain, too."], 6),
    ("<html><body><div id=cookie-notice><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class=wrapper><div class=content><h2>How trees grow</h2><p>A tree adds one ring a year, wide in good years.</p><ul><li>Water helps, of course.</li><li>Light helps even more.</li></ul></div><div class=sidebar><h3>Related</h3><ul><li><a href=1>Moss</a></li><li><a href=2>Ferns</a></li></ul></div></div><div class='footer'><p>Made with care, in a small shed.</p></div></body></html>",
     ["How trees grow", "A tree adds one ring a year, wide in good years.", "Water helps, of course.", "Light helps even more."], 8),
    ("<div class=topbar><ul><li><a href=/>Start</a></li></ul></div><section class=story><h1>Old bridges</h1><p>Stone lasts, if the water below is calm and low.<p>Iron rusts, and must be painted again and again.<blockquote><p>A bridge is a promise, said the builder once.</p></blockquote></section><div class=ad-slot><p>Buy our paint today, it is the best for iron.</p></div><div class=discussion><p>My uncle built one of those bridges, long ago.</p></div>",
     ["Old bridges", "Stone lasts, if the water below is calm and low.", "Iron rusts, and must be painted again and again.", "A bridge is a promise, said the builder once."], 8),
]


def test_no_similar_pair_is_lost_among_likelier_ones(spark, monkeypatch):
    # to the sketches all texts look alike, so forests hold the links of the shortest ones; only the two longest are similar
    monkeypatch.setattr(near_copies, "summary", lambda h: (0, bytes(near_copies.PERMS)))
    texts = [" ".join(f"w{i}x{j}" for j in range(60 + min(i, 10))) for i in range(12)]
    texts[11] = texts[10] + " more"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_similar(rows).collect()) == list(range(11))


def test_nearly_similar_pairs_are_verified_without_becoming_rows(spark, monkeypatch):
    # all of the 60 texts are candidates of each other, at 0.69; two are copies of 0.9 of the last and of each other
    monkeypatch.setattr(near_copies, "summary", lambda h: (0, bytes(near_copies.PERMS)))
    common = " ".join(f"c{j}" for j in range(200))
    texts = [f"{common} " + " ".join(f"w{i}x{j}" for j in range(40 + min(i, 20))) for i in range(60)]
    texts += [texts[-1] + f" more{i} words" for i in range(2)]
    sizes, write = [], near_copies.stored

    def counted(df, tag):
        sizes.append((write(df, tag), tag))
        return sizes[-1][0]

    monkeypatch.setattr(near_copies, "stored", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_similar(rows).collect()) == list(range(60))
    assert max(df.count() for df, _ in sizes) <= near_copies.FORESTS * len(texts)


def test_true_links_connect_as_all_similar_pairs_do():
    rng = random.Random(5)
    base = [[rng.randint(0, 10**9) for _ in range(rng.randint(20, 60))] for _ in range(12)]
    sets = [np.unique(np.array([rng.choice([x, x, x, x, x, x, x, x, x, rng.randint(0, 10**9)]) for x in base[i % 12]], np.uint64)) for i in range(90)]
    n, zero = np.array([len(h) for h in sets]), np.zeros(90, np.uint64)
    items, part, sketch = np.arange(90) + 1000, np.arange(90) // 2 * 2, np.zeros((90, near_copies.PERMS), np.uint8)
    for side in (None, np.arange(90) % 5 == 0):
        pairs = [(i, j) for i in range(90) for j in range(i) if near_copies.similarity(sets[i], sets[j]) >= 0.6 and (side is None or side[i] != side[j])]

        def groups(links):
            up = part.tolist()
            for _ in range(90):
                for i, j in links:
                    up[i] = up[j] = min(up[i], up[j])
                for i, p in enumerate(part.tolist()):
                    up[i] = up[p] = min(up[i], up[p])
            return up

        src, dst = near_copies.true_links(items, n, zero, sketch, side, part, np.concatenate(sets), 64, 0.6)
        assert groups(zip((src - 1000).tolist(), (dst - 1000).tolist())) != part.tolist()
        assert len(src) < 45 and {(max(a, b), min(a, b)) for a, b in zip((src - 1000).tolist(), (dst - 1000).tolist())} <= set(pairs)
        assert groups(list(zip((src - 1000).tolist(), (dst - 1000).tolist()))) == groups(pairs)


def test_ids_meet_in_their_bin_alone(spark):
    rows = spark.createDataFrame([(i, [i] * (1 + i % 7), None, None) for i in range(200)], "doc_id long, ids array<int>, source string, cluster string")
    made = packing.sequences(rows, capacity=16, shard_rows=50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan  # a whole shard's ids were one Arrow batch
    assert sum(r.n_tokens for r in made.collect()) == sum(1 + i % 7 for i in range(200))


def test_html_on_pages_labelled_by_hand():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "of", "the"]) for _ in range(rng.randint(8, 40))) for _ in range(40)]
    made = [html_extract.parse(html_extract.layout(rng, rng.sample(texts, 8))) for _ in range(600)]
    trees = html_extract.Trees().fit(np.concatenate([html_extract.features(p) for p in made]), np.concatenate([html_extract.labels(p, False) for p in made]))
    hit = found = want = 0
    for source, blocks, _ in PAGES:
        page = html_extract.parse(source)
        got = html_extract.main_text(page, html_extract.decode(page.parents, trees.score(html_extract.features(page)))).split("\n\n")
        hit += len(set(got) & set(blocks))
        found += len(got)
        want += len(blocks)
        assert "leak" not in " ".join(t for _, t, _ in page.runs) and "color" not in " ".join(t for _, t, _ in page.runs)
    assert hit / found >= 0.9 and hit / want >= 0.9, (hit, found, want)


def test_html_elements_in_a_line():
    """An advert's class on an inline element sets it apart for the trees, but doesn't tear the paragraph."""

    def texts(source, dropped=()):
        page = html_extract.parse(source)
        return html_extract.blocks(page, [not set(t) & set(dropped) for t in page.tokens])

    assert texts("<p>Hello <a class='related'>world</a> again</p><p>b") == ["Hello world again", "b"]
    assert texts("<p>Hello <a class='related'>world</a>, again</p>") == ["Hello world, again"]
    assert texts("<p>a<span class='share-text'>b</span>c<b class=ad> d</b> e") == ["abc d e"]
    assert texts("<p>Hello <a class='related'>world</a> again</p>", {"related"}) == ["Hello again"]
    assert texts("<p><a class='related'>world</a> again</p>", {"related"}) == ["again"]
    assert texts("<p>a <span class=ad>b</span></p><p>c", {"ad"}) == ["a", "c"]
    assert texts("<p>a <span class=ad>b<div>c</div>d</span> e</p>") == ["a b", "c", "d e"]
    assert texts("<div>a<span class=ad>b<div>c</span>d</div>") == ["ab", "c", "d"]
    assert texts("<div><a class=nav>x</a>\n<a class=nav>y</a></div>") == ["x y"]


def test_html_odd_markup():
    runs = lambda s: [t for _, t, _ in html_extract.parse(s).runs]
    assert runs('<article><script src="a.js" />var x=1;</script><p>a</p><style media=x/>p{}</style></article>') == ["a"]
    assert runs("<p>E = <math>m</math> c") == ["E = m c"] and runs("<p>a <object>b</object> c") == ["a b c"] and runs("<p>a<noscript> b</noscript>") == ["a b"]
    assert runs("<select><option>x</select><p>rest stays") == ["x", "rest stays"] and runs("<svg><script/>a</svg><p>b") == ["a", "b"]

    def took(n):
        source = "<div>" * n + "x" + "</b></div>" * n
        began = time.process_time()
        html_extract.parse(source)
        return time.process_time() - began

    assert took(40_000) < 40 * max(took(4_000), 0.01)  # in proportion, not squared


def test_normalise_like_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    letters = ["a", "B", " ", "  ", "ﬁ", "①", "Å", "é", "é", "㍿", "　", "ｶﾞ", "…", "½", "\t", "\n", "ß", "한", "x ", " ", "🙂"]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        for prefix, escape, strip in ((False, False, False), (True, True, True), (True, True, False), (False, True, True)):
            lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=strip)
            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(lib.serialized_model_proto())
            own = sentencepieces.Normaliser(proto.normalizer_spec)
            for _ in range(150):
                text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
                want, offsets = lib.normalize(text, with_offsets=True)
                got, source = own(text.encode())
                ends = np.cumsum([0, *[len(c.encode()) for c in want]])
                assert got.decode() == want and [len(text.encode()[: source[e]].decode()) for e in ends] == list(offsets)


def test_user_symbols_pass_as_they_are():
    class Spec:
        precompiled_charsmap, escape_whitespaces, remove_extra_whitespaces, add_dummy_prefix = b"", True, False, True

    got, source = sentencepieces.Normaliser(Spec, (b"<xy>", b"<x"))(b"a <xy>b")
    assert got == "▁a▁<xy>b".encode() and source.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 6, 7]
    back, source = sentencepieces.Normaliser(Spec, (), True)(b"a b")
    assert back == "a▁b▁".encode() and source.tolist() == [0, 1, 1, 1, 2, 3, 3, 3, 3]


def test_only_the_commonest_languages_are_learned(spark):
    rows = [(f"word{i} in tongue {k}", f"l{k:02d}") for k in range(12) for i in range(k + 3)]
    df = spark.createDataFrame(rows, "text string, language string")
    for n in (1, 5):
        assert language_id.train(df.repartition(n), most_languages=4).languages == ["l08", "l09", "l10", "l11"]


def test_posteriors_by_hand(spark):
    """The fusion in plain Python, over texts, declarations, hosts and suffixes, with nulls and ties."""
    rng = random.Random(9)
    en, fr = "the cat and the dog are in the house".split(), "le chat et le chien sont dans la maison".split()
    rows = []
    for i in range(80):
        words = rng.choices(en if i % 2 else fr, k=rng.randint(1, 12))
        rows.append((i, " ".join(words), rng.choice(["en", "fr", "en-GB", "xx", None, ""]), rng.choice(["a.site.fr", "b.site.fr", "www.site.uk", "host", None])))
    rows += [(90, None, "en", "host"), (91, "77", "fr", None), (92, "the cat", "en", "a.site.fr"), (92, "the cat", "en", "a.site.fr")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    train = spark.createDataFrame([(" ".join(en), "en"), (" ".join(fr), "fr")], "text string, language string")
    model = language_id.train(train)
    assert model.languages == ["en", "fr"]
    weight, strength, unknown = 40.0, 20.0, math.log(language_id.UNKNOWN / (1 - language_id.UNKNOWN))
    flat = -math.log(len(model.table))

    def shares(logs, none):
        e = [math.exp(x - max(*logs, none)) for x in logs]
        return [x / (sum(e) + math.exp(none - max(*logs, none))) for x in e]

    facts = []
    for i, text, said, host in rows:
        mean, n = model.score(text)
        ll, none = [m * min(n, weight) for m in mean], flat * min(n, weight) + unknown
        said = said.split("-")[0] if said is not None else None
        said = "-" if not said else said if said in ("en", "fr") else "other"
        facts.append((i, said, host, ll, none, n, shares(ll, none + math.log(2)) if n else [0, 0]))
    total = lambda keep: [sum(f[6][k] for f in facts if keep(f)) for k in (0, 1)]
    every = [x + 1 for x in total(lambda f: True)]
    prior = [x / sum(every) for x in every]
    said_by = {v: [x + 0.5 for x in total(lambda f, v=v: f[1] == v)] for v in ("en", "fr", "other")}
    columns = [sum(said_by[v][k] for v in said_by) for k in (0, 1)]
    level = lambda sums, up: [(s + strength * u) / (sum(sums) + strength) for s, u in zip(sums, up)]
    domain = lambda h: ".".join(h.split(".")[-2:])
    got = {r.id: r for r in language_id.identify(df, model).collect()}
    assert len(language_id.identify(df, model).collect()) == len(rows)
    for i, said, host, ll, none, n, _ in facts:
        if not n:
            assert got[i].language is None and not got[i].accepted
            continue
        up = prior if host is None else level(total(lambda f: f[2] == host), level(total(lambda f: f[2] and domain(f[2]) == domain(host)), prior))
        logs = [a + math.log(p) for a, p in zip(ll, up)]
        if said != "-":
            logs = [a + math.log(said_by[said][k] / columns[k]) for k, a in enumerate(logs)]
            none -= math.log(3)
        speaks = language_id.SUFFIXES.get(host.split(".")[-1]) if host and "." in host else None
        if speaks in ("en", "fr"):
            logs = [a + math.log(0.8 if x == speaks else 0.2) for a, x in zip(logs, ("en", "fr"))]
            none -= math.log(2)
        want = shares(logs, none)
        assert abs(got[i].posterior - max(want)) < 1e-5 and got[i].language == ("en", "fr")[want.index(max(want))]


def test_chat_nulls_ties_repeats_and_long_turns(spark):
    rows = [(None, 0, "user", "of no conversation"), (1, 1, "user", "b"), (1, 1, "assistant", "tie"), (1, None, "user", "last"), (1, 0, None, None), (2, 0, "assistant", "again"), (2, 0, "assistant", "again"), (3, 0, "user", "w " * 30_000), (3, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS span", "2 AS pos", "'x' AS formatted", "3 AS tokens")
    read = chat_format.read_back(chat_format.windows(df))
    got = {}
    for r in read.orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert got == {None: [("user", "of no conversation")], 1: [("", ""), ("assistant", "tie"), ("user", "b"), ("user", "last")], 2: [("assistant", "again")] * 2, 3: [("user", "w " * 30_000), ("assistant", "x" * 100_000)]}
    ends = {r.conv_id: r for r in chat_format.digests(chat_format.windows(df)).collect()}
    assert ends[2].loss_chars == 10 and ends[3].loss_chars == 100_000 and ends[1].n_turns == 4


def _repeated_passages(texts: list[str | None], most: int = 50) -> int:
    """Stretches of whole lines with more than ``most`` words, shortest from each line on, that an earlier text or place has too."""
    seen, again = set(), 0
    for text in texts:
        lines = (text or "").split("\n")
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j].split())
                if words > most:
                    again += (stretch := "\n".join(lines[i : j + 1])) in seen
                    seen.add(stretch)
                    break
    return again


def test_no_passage_of_several_lines_stays_twice(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    passages = ["\n".join(own(k) for k in sizes) for sizes in ([26, 26], [20, 20, 20], [5] * 11, [1, 60, 3], [17, 17, 17, 17])]
    passages.append("\n".join([own(30), "", "   ", own(30)]))
    texts = ["\n".join([own(rng.randrange(1, 30)), rng.choice(passages), own(rng.randrange(1, 30)), rng.choice(passages)]) for _ in range(60)] + ["\n".join(own(1) for _ in range(3000))] * 2
    got = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert _repeated_passages(texts) > 100 and _repeated_passages(got) == 0
    assert {x for t in texts for x in t.split("\n")} == {x for t in got for x in t.split("\n")} | {""}  # one of each line stays
    assert all(t.split("\n")[0] == g.split("\n")[0] for t, g in zip(texts[:60], got))  # lines of their own stay


def test_lines_of_one_digest_are_told_apart_by_their_bytes(spark, monkeypatch):
    twice = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(0, twice), (1, twice + " other"), (2, twice), (3, twice + " other"), (4, twice + " once")], "doc_id long, text string")
    assert [r.n_removed_lines for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()] == [0, 0, 1, 1, 0]
    monkeypatch.setattr(line_dedup, "line_digest", lambda line: F.substring(F.md5(line.cast("binary")), 1, 0))
    assert [r.n_removed_lines for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()] == [0, 0, 0, 0, 0]


@pytest.mark.parametrize("slots", [1 << 24, 0])
def test_every_repeated_run_of_lines_goes(spark, monkeypatch, slots):
    """Against a plain version: pairs of neighbouring lines with words, and long lines, beyond their first occurrence; by bitmap and by join."""
    monkeypatch.setattr(line_dedup, "MOST_SLOTS", slots)
    rng = random.Random(11)
    pool = [f"line {i}" for i in range(40)] + ["", " \t", "w " * 51 + "end", "x " * 50]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "\n", "same\nsame\nsame\nsame", "a b\nc d\n1", "2\na b\nc d", "3\na b\n\nc d\n4"]
    first, gone = {}, [set() for _ in texts]
    for run in (True, False):
        for d, t in enumerate(texts):
            kept = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()]
            found = [(i, j, (x, y)) for (i, x), (j, y) in zip(kept, kept[1:])] + [(i, i, (x,)) for i, x in kept if len(x.split()) > 50]
            for i, j, s in found:
                if run:
                    first[s] = min(first.get(s, (d, i)), (d, i))
                elif first[s] != (d, i):
                    gone[d] |= set(range(i, j + 1))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        want = t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert got[d].text == want and got[d].n_removed_lines == len(gone[d]) and got[d].n_removed_chunks == sum(i - 1 not in gone[d] for i in gone[d])


def test_spans_are_told_by_their_cuts(spark):
    import hashlib

    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = sentencepieces.SpanEncoder(path)
    texts = ["", " a  b", "naïve 日本語 \u0001 x", "word " * 300, "\n\n"]
    got = {r.doc_id: r for r in sentencepieces.encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for k, text in enumerate(texts):
        (ids,) = coder.encode([text])
        cuts = coder.cuts(text, ids)
        starts, ends = coder.spans(text, ids)
        assert len(cuts) == len(ids) + 1 and (starts == cuts[:-1]).all() and (ends == cuts[1:]).all() and (np.diff(cuts) >= 0).all()
        both = " ".join(f"{a} {b}" for a, b in zip(starts, ends))
        assert got[k].spans_sha256 == hashlib.sha256(both.encode()).hexdigest() and got[k].n_span_bytes == cuts[-1] - cuts[0]
