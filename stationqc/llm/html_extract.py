"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A tolerant parser makes block-level nodes and the text runs between their tags.  Each node gets features: subtree density,
attribute tokens, depth, ancestors and siblings.  Boosted trees, trained here, score every node.  Decoding picks the set of
nodes with the best total score among sets that are closed towards the root, so nothing is kept below a node that is
dropped and no node is dropped above one that is kept.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by role, and words of class, id and role attributes that speak for or against an element.
RAW = {"script", "style", "title", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msqrt", "mover", "munder", "object", "noscript"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "body", "html"}
ROLES = [{"article", "main"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre", "figcaption"}, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"table", "tbody", "tr", "td", "th", "thead"}, {"nav", "aside", "form", "button", "fieldset", "dialog", "menu", "select", "svg", "template"}, {"footer"}, {"header"}, {"html", "body"}]
ROLE_OF = {t: k for k, r in enumerate(ROLES) for t in r}
AGAINST = set(
    "ad ads advert advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer form header legal "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promotion recommended related replies reply response responses search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
FOR = set("article body content entry main page post prose story text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"(class|id|role|itemprop|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
BUCKETS = 8


@dataclass
class Page:
    """Nodes in page order (a parent before its children) and text runs in page order."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    tokens: list[list[str]] = field(default_factory=lambda: [[]])
    marks: list[bool] = field(default_factory=lambda: [False])
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links
    places: list[tuple[int, bool, bool]] = field(default_factory=list)  # of each run: its block, white space before and after


def parse(source: str) -> Page:
    page, stack = Page(), [0]
    names, open_ = ["html"], Counter(["html"])
    text: list[str] = []
    linked, link_chars, at, block = False, 0, 0, 0

    def flush(ends: bool = True) -> None:
        """Ends the run; and the block, unless an element that stands in a line of text begins or ends here."""
        nonlocal link_chars, block
        if text:
            raw = "".join(text)
            joined = " ".join(raw.split())
            if joined:
                page.runs.append((stack[-1], joined, link_chars))
                page.places.append((block, raw[0].isspace(), raw[-1].isspace()))
            elif page.places:  # white space alone parts its neighbours
                page.places[-1] = (*page.places[-1][:2], True)
            text.clear()
            link_chars = 0
        block += ends

    def close(upto: int) -> None:
        open_.subtract(names[upto:])
        del stack[upto:], names[upto:]

    def last(name: str) -> int:
        """Place of the innermost open ``name``; what is passed on the way is about to be closed."""
        at = len(names) - 1
        while names[at] != name:
            at -= 1
        return at

    def put(piece: str) -> None:
        nonlocal link_chars
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)
            if linked:
                link_chars += len(piece)

    find = TAG.search
    while m := find(source, at):
        put(source[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        attrs = m[3]
        if m[1]:
            if name in INLINE and not open_[name]:
                if name == "a":
                    linked = False
                continue
            if name != "html" and open_[name]:
                begins = last(name)
                flush(not INLINE.issuperset(names[begins:]))
                close(begins)
                linked = linked and name != "a"
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not (attrs.endswith("/") and open_["svg"]):  # HTML has no empty script; SVG has
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        found = ATTR.findall(attrs) if attrs.strip() else ()
        tokens = [t for k, v in found if k.lower() != "data-y" for t in re.split(r"[^a-z0-9]+", v.lower()) if t]
        if name in INLINE and AGAINST.isdisjoint(tokens):
            linked = linked or name == "a"
            continue
        flush(name not in INLINE)
        linked = False
        if name in ("html", "body") and (name == "html" or open_["body"]):
            continue
        if name in ENDS_P and open_["p"]:
            close(last("p"))
        if same := SAME.get(name):
            for i in range(len(names) - 1, 0, -1):
                if names[i] in same:
                    close(i)
                    break
                if names[i] in SCOPE:
                    break
        page.parents.append(stack[-1])
        page.tags.append(name)
        page.tokens.append(tokens)
        page.marks.append(any(k.lower() == "data-y" for k, _ in found))
        stack.append(len(page.tags) - 1)
        names.append(name)
        open_[name] += 1
    put(source[at:])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    out = np.zeros((n, 30 + BUCKETS + len(ROLES)), np.float32)
    own, links, ends, first, blocks = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n
    total = 0
    for node, text, link in page.runs:
        own[node] += len(text)
        links[node] += min(link, len(text))
        ends[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        blocks[node] += 1
        if first[node] < 0:
            first[node] = total
        total += len(text)
    chars, nodes, paras, linked, marks, inner_for, inner_against = own[:], [1] * n, [t == "p" for t in page.tags], links[:], ends[:], [0] * n, [0] * n
    against = [len(AGAINST.intersection(t)) for t in page.tokens]
    good = [len(FOR.intersection(t)) for t in page.tokens]
    roles = [ROLE_OF.get(t, -1) for t in page.tags]
    depth, above_for, above_against, above_tag = [0] * n, [0] * n, [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    place, around = [0] * n, [0] * n
    for i in range(1, n):
        p = page.parents[i]
        place[i] = len(children[p])
        children[p].append(i)
        depth[i] = depth[p] + 1
        above_for[i] = above_for[p] + good[p] + (roles[p] == 0)
        above_against[i] = above_against[p] + against[p]
        above_tag[i] = above_tag[p] + (roles[p] in (6, 7, 8))
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        for values in (chars, nodes, paras, linked, marks):
            values[p] += values[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
        around[p] += chars[i]
        inner_for[p] += inner_for[i] + (roles[i] == 0)
        inner_against[p] += inner_against[i] + against[i] + (roles[i] in (6, 7, 8))
    rows = []
    for i in range(n):
        p, c = page.parents[i], chars[i]
        sibs = children[p] if p >= 0 else [0]
        at = place[i]
        before, after = (sibs[at - 1] if at else -1), (sibs[at + 1] if at + 1 < len(sibs) else -1)
        rows.append((
            inner_against[i], c, own[i], paras[i], nodes[i], c / nodes[i], around[p] / len(sibs) if p >= 0 else c, chars[before] if before >= 0 else 0, chars[after] if after >= 0 else 0,
            against[i], good[i], above_against[i], above_for[i], above_tag[i], inner_for[i] > 0, depth[i], linked[i] / c if c else 0, marks[i] / c if c else 0, c / total if total else 0,
            first[i] / total if total and first[i] > 0 else 0, at, len(sibs), before >= 0 and roles[before] == 1, len(children[i]), roles[p] if p >= 0 else -2, good[p] if p >= 0 else 0, blocks[i],
            c == 0, len(page.tokens[i]), above_against[i] + above_tag[i] + against[i] > 0,
        ))
    out[:, :30] = rows
    out[:, :9] = np.log1p(out[:, :9])
    for i, tokens in enumerate(page.tokens):
        for t in tokens:
            out[i, 30 + zlib.crc32(t.encode()) % BUCKETS] += 1
        if roles[i] >= 0:
            out[i, 30 + BUCKETS + roles[i]] = 1
    return out


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss; all of one depth, stored level by level."""

    depth: int = 4
    rate: float = 0.2
    base: float = 0.0
    split: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, bins: int = 32, ridge: float = 1.0) -> Trees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        for _ in range(rounds if n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            split, cut, at = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf), np.zeros(n, np.int64)
            for level in range(self.depth):
                start, count = 2**level - 1, 2**level
                best = np.zeros(count)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    key = (at - start) * bins + codes[:, f]
                    left_g = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                    left_h = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                    gain = gain[:, : len(edges[f])]
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(count), top] > best + 1e-9
                    best[better] = gain[np.arange(count), top][better]
                    split[start : start + count][better] = f
                    cut[start : start + count][better] = edges[f][top[better]]
                at = 2 * at + 1 + (x[np.arange(n), split[at]] > cut[at])
            leaf_of = at - (2**self.depth - 1)
            leaf = self.rate * np.bincount(leaf_of, g, 2**self.depth) / (np.bincount(leaf_of, h, 2**self.depth) + ridge)
            score += leaf[leaf_of]
            self.split.append(split), self.cut.append(cut), self.leaf.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, split[at]] > cut[at])
            total += leaf[at - (2**self.depth - 1)]
        return total


def decode(parents: list[int], scores) -> list[bool]:
    """The set of nodes, closed towards the root, whose scores sum highest; the root is always in it."""
    best = [float(s) for s in scores]
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    kept = [True] * len(best)
    for i in range(1, len(best)):
        kept[i] = kept[parents[i]] and best[i] > 0
    return kept


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """Texts of the kept blocks in page order; a block is what is kept of its runs, so dropping an element in a line leaves the line whole."""
    out, last, apart = [], -1, True
    for (node, text, _), (block, before, after) in zip(page.runs, page.places):
        if block != last:
            apart = True
        if not kept[node]:
            apart = True
        elif block == last and out:
            out[-1].append(" " + text if apart or before else text)
            apart = after
        else:
            out.append([text])
            last, apart = block, after
    return ["".join(pieces) for pieces in out]


def main_text(page: Page, kept: list[bool]) -> str:
    return "\n\n".join(blocks(page, kept))


def labels(page: Page, semantic: bool) -> np.ndarray:
    """1 for nodes that hold wanted text.  ``semantic``: inside an article, and in nothing that its name or tokens speak against; else: as marked."""
    want = []
    for i, p in enumerate(page.parents):
        if semantic:
            bad = i > 0 and (page.tags[i] in ROLES[6] | ROLES[7] | ROLES[8] or not AGAINST.isdisjoint(page.tokens[i]))
            state = -1 if p >= 0 and want[p] < 0 or bad else 1 if page.tags[i] in ROLES[0] or p >= 0 and want[p] > 0 else 0
        else:
            state = 1 if page.marks[i] else 0
        want.append(state)
    hold = [w > 0 for w in want]
    for i in range(len(hold) - 1, 0, -1):
        hold[page.parents[i]] |= hold[i]
    return np.array(hold, float)


def layout(rng: random.Random, paragraphs: list[str]) -> str:
    """A page of known truth (attribute data-y) from given texts: the usual furniture around and inside an article."""
    pick = rng.choice
    say = lambda n: " ".join(pick(paragraphs).split()[: rng.randint(1, n)]) or "x"
    para = lambda: pick(paragraphs)
    some = lambda chance, f: f() if rng.random() < chance else ""
    items = lambda n, link=True: "".join(f'<li>{"<a href=x>" if link else ""}{say(3)}{"</a>" if link else ""}</li>' for _ in range(rng.randint(3, n)))
    box = lambda tag, tokens, body: f'<{tag} {pick(["class", "id"])}="{pick(tokens)}">{body}</{tag}>'
    menu = lambda: pick([f"<nav><ul>{items(8)}</ul></nav>", box("div", ["menu", "nav", "navbar", "topbar"], f"<ul>{items(8)}</ul>"), box("ul", ["menu", "nav-list", "breadcrumbs"], items(6))])
    head = lambda: pick([f"<header><h1>{say(4)}</h1>{some(0.5, menu)}</header>", box("div", ["header", "masthead", "site-header"], f"<p>{say(6)}</p>")])
    advert = lambda: box(pick(["div", "aside", "section"]), ["ad", "advert", "banner", "sponsored", "promo", "ad-slot"], pick([para(), say(20), f"<p>{para()}</p>"]))
    notice = lambda: box(pick(["div", "section", "aside"]), ["cookie", "cookie-notice", "consent", "notice", "popup", "newsletter", "subscribe"], f"<p>{say(30)}</p><button>{say(2)}</button>")
    form = lambda: f'<form action="x">{pick([f"<p>{say(12)}</p>", f"<label>{say(3)}</label>", say(8)])}<input><button>{say(2)}</button></form>'
    side = lambda: pick([f"<aside>{pick([f'<h3>{say(3)}</h3><ul>{items(6)}</ul>', f'<p>{para()}</p>'])}</aside>", box("div", ["sidebar", "related", "widget", "recommended"], f"<h3>{say(3)}</h3>{pick([f'<ul>{items(6)}</ul>', f'<p>{para()}</p><p>{para()}</p>'])}")])
    talk = lambda: box(pick(["div", "section", "ol"]), ["comments", "comment-list", "replies", "discussion"], f"<h3>{say(3)}</h3>" + "".join(pick([f'<div class="comment"><p>{para()}</p></div>', f"<li><p>{para()}</p></li>", f"<p>{say(40)}</p>"]) for _ in range(rng.randint(1, 4))))
    foot = lambda: pick([f"<footer>&copy; {say(10)}{some(0.3, lambda: f'<p>{para()}</p>')}</footer>", box("div", ["footer", "site-footer", "copyright"], f"<p>{say(12)}</p>")])
    y = "data-y=1"
    block = lambda: pick([f"<p {y}>{para()}</p>"] * 7 + [f"<p {y}><b>{say(30)}<br>", f"<h2 {y}>{say(6)}</h2><p {y}>{para()}</p>", f"<ul {y}>" + "".join(f"<li {y}>{say(15)}</li>" for _ in range(3)) + "</ul>", f"<blockquote {y}><p {y}>{say(40)}</p></blockquote>", f"<div {y}>{para()}</div>", f"<pre {y}>{say(15)}</pre>", f"<table {y}><tr {y}><td {y}>{say(4)}</td><td {y}>{say(4)}</td></tr></table>"])
    inside = lambda: some(0.12, advert) + some(0.05, notice) + some(0.05, side) + some(0.04, form)
    body = some(0.85, lambda: f"<h1 {y}>{say(9)}</h1>") + "".join(block() + inside() for _ in range(rng.randint(1, 9))) + some(0.2, talk) + some(0.1, menu)
    shell = rng.randint(0, 5)
    tokens = pick(["content", "main", "post", "entry-content", "article-body", "story", "page-content", "text"])
    body = [f"<article {y}>{body}</article>", f"<main {y}><article {y}>{body}</article></main>", f'<div class="{tokens}" {y}>{body}</div>', f'<div id="main" {y}><div class="{tokens}" {y}>{body}</div></div>', f'<section class="{tokens}" {y}>{body}</section>', f"<main {y}>{body}</main>"][shell]
    before = [menu(), some(0.6, head), some(0.5, notice), some(0.6, advert), some(0.2, side)]
    after = [some(0.4, talk), some(0.4, side), some(0.3, form), some(0.3, advert), some(0.8, foot), some(0.2, notice)]
    rng.shuffle(before), rng.shuffle(after)
    whole = f"<html><head><title>{say(5)}</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>"
    return f'<html><body><div class="{pick(["page", "wrapper", "site", "container"])}" {y}>' + whole[whole.index("<body>") + 6 :] if rng.random() < 0.3 else whole


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = 300, synthetic: int = 900, seed: int = 7, most_chars: int = 100_000, most_texts: int = 5000) -> Trees:
    """Trees from at most ``sample_pages`` pages with an article element, as their markup says, and ``synthetic`` pages of known truth made of their texts.

    Both numbers, and ``most_chars`` a page and ``most_texts`` paragraphs, bound what reaches the driver, at any size of the
    table; extraction itself knows no such bounds.  Pages are taken by a hash of their content.
    """
    col = F.col(f"`{html_col}`")
    every = max(1, pages.count() // (4 * sample_pages))
    rows = pages.select(col.alias("html")).where(col.isNotNull() & (F.length(col) <= most_chars) & F.lower(col).contains("<article") & (F.pmod(F.xxhash64(col), F.lit(every)) == 0))
    found = [r.html for r in rows.orderBy(F.xxhash64("html", F.lit(1)), "html").limit(sample_pages).collect()]
    parsed = [parse(x) for x in found]
    texts = [t for page in parsed for _, t, _ in page.runs if len(t) > 40][:most_texts] or ["words of a page that has no text"]
    rng = random.Random(seed)
    made = [parse(layout(rng, [entities.escape(t, quote=False) for t in rng.sample(texts, min(12, len(texts)))])) for _ in range(synthetic)]
    x = np.concatenate([features(p) for p in parsed + made])
    y = np.concatenate([labels(p, True) for p in parsed] + [labels(p, False) for p in made])
    return Trees().fit(x, y)


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page, with n_blocks and n_nodes.

    A null or empty page, or one without text, gives an empty text.  Pages are read whole, cut-off ones as far as they go.
    A node whose score is exactly zero is dropped.  Pages of any length and depth take time in proportion to their size.
    Repeated rows give repeated results; columns other than the three, whatever their names, are not read.  An empty table
    gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            out = []
            sources = batch.column(2).to_pylist()
            for at in range(0, len(sources), 64):
                some = [parse(x or "") for x in sources[at : at + 64]]
                scores = np.split(shared.value.score(np.concatenate([features(p) for p in some])), np.cumsum([len(p.tags) for p in some])[:-1])
                for page, s in zip(some, scores):
                    kept = decode(page.parents, s)
                    texts = blocks(page, kept)
                    out.append(("\n\n".join(texts), len(texts), len(page.tags)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))]], names=["page_id", "url", "text", "n_blocks", "n_nodes"])

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_blocks long, n_nodes long")
