"""HTML extraction: gradient-boosted trees over DOM-node features, decoded hierarchically.

A page becomes a tree of block elements and text runs (inline tags belong to the run). Features: tag, attribute tokens of
the node and its ancestors, depth, subtree text, link and punctuation density, sibling and page statistics. Boosted trees
give each node the probability that its subtree holds main text. Decoding picks the most likely set of nodes in which a
kept node has kept ancestors and a dropped node no kept descendant, so decisions never contradict each other.

Training uses a bounded sample (FIT_PAGES pages of smallest digest): the pages with an article or main element, labelled
by it, and for each a second layout made from its text with other containers, menus, side bars, notices, adverts, forms
and comments, so that the trees rest on more than one site's tags.

The text keeps every block of the kept nodes: character references decoded, white space made one space, joined by line
feeds in page order. Defined cases: null or empty html gives the empty text; unclosed, stray and unknown tags never fail
and lose no text but that of a script or style sheet; work grows with the length of a page, whatever its markup;
rows are extracted one by one, whatever their ids; without a page to learn from, the labelling rule itself decides. Extra
columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import digest_sample, small_batches

FIT_PAGES = 300
TREES, DEPTH, RATE, BINS = 60, 4, 0.3, 32

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")  # attributes up to the end of the tag
TRIES = 8  # tags whose quotes run to the end of the page; beyond that many, its quotes don't count
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements by how they lay out. Inner elements of formulas and drawings belong to the run around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input "
                   "noscript object iframe math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover semantics annotation "
                   "svg g path rect circle ellipse line polyline polygon text tspan defs use symbol desc".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title template textarea".split())  # what stands in them is no text of the page
ENDLESS = frozenset("script style".split())  # these run to the end of the page if they aren't closed; others are passed over
NO_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Kinds of tags and of attribute tokens: a bit for each.
TAGS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "button", "select", "option", "legend", "dialog"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("div", "section"), ("blockquote", "pre", "figure", "figcaption"), ("table", "tbody", "thead", "tr", "td", "th"), ("#text",)]
WORDS = [
    ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion"),
    ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"),
    ("header", "masthead", "topbar", "logo", "branding"),
    ("footer", "copyright", "colophon", "bottom", "legal"),
    ("sidebar", "side", "aside", "widget", "rail", "widgets"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"),
    ("cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "gdpr", "overlay", "dialog", "warning", "message"),
    ("form", "search", "login", "signup", "subscribe", "newsletter", "register"),
    ("share", "social", "related", "recommended", "more", "tags", "meta", "byline", "author"),
    ("article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "page"),
]
TAG_BIT = {t: 1 << k for k, tags in enumerate(TAGS) for t in tags}
WORD_BIT = {w: 1 << (len(TAGS) + k) for k, words in enumerate(WORDS) for w in words}
N_BITS = len(TAGS) + len(WORDS)
MAIN = TAG_BIT["article"]
BOILER = TAG_BIT["nav"] | TAG_BIT["footer"] | TAG_BIT["aside"] | TAG_BIT["form"] | sum(1 << (len(TAGS) + k) for k in (0, 1, 3, 4, 5, 6, 7))
MARK = ""  # opens main text in the pages made for training


class Nodes:
    """Trees of a batch of pages in document order: a subtree is a run of rows."""

    def __init__(self) -> None:
        self.page, self.parent, self.end, self.depth, self.bits, self.above = [], [], [], [], [], []
        self.chars, self.linked, self.stops, self.texts, self.pages = [], [], [], [], 0

    def _open(self, parent: int, depth: int, bits: int) -> int:
        at = len(self.parent)
        self.page.append(self.pages)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.depth.append(depth)
        self.bits.append(bits)
        self.above.append(0 if parent == at else self.above[parent] | self.bits[parent])
        self.chars.append(0)
        self.linked.append(0)
        self.stops.append(0)
        self.texts.append(None)
        return at

    def add(self, html: str | None) -> None:
        html = html or ""
        first = len(self.parent)
        stack = [("", self._open(first, 0, 0))]
        run: list[str] = []
        in_link = linked = at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                run.clear()
                if text:
                    k = self._open(stack[-1][1], len(stack), TAG_BIT["#text"])
                    self.texts[k] = text
                    self.chars[k], self.linked[k] = len(text), min(linked, len(text))
                    self.stops[k] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
                linked = 0

        def close(n: int) -> None:
            for _, k in stack[n:]:
                self.end[k] = len(self.parent)
            del stack[n:]

        size, tries, open_of, unclosed = len(html), TRIES, Counter(), set()

        def text(frm: int, to: int) -> None:
            nonlocal linked
            if to > frm:
                run.append(html[frm:to])
                if in_link:
                    linked += to - frm

        def pop(n: int) -> None:
            for x, _ in stack[n:]:
                open_of[x] -= 1
            close(n)

        while at < size:
            lt = html.find("<", at)
            if lt < 0 or (gt := html.find(">", lt)) < 0:
                text(at, size)
                break
            text(at, lt)
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
                continue
            if html[lt + 1] in "!?":
                at = gt + 1
                continue
            m = NAME.match(html, lt, gt)
            if not m:
                text(lt, lt + 1)
                at = lt + 1
                continue
            if html.find('"', m.end(), gt) >= 0 or html.find("'", m.end(), gt) >= 0:
                if tries and (q := QUOTED.match(html, m.end())):
                    gt = q.end()
                elif tries:
                    tries -= 1
            at, ends, name, attributes = gt + 1, m[1], m[2].lower(), html[m.end() : gt]
            if name == "a":
                in_link = 0 if ends else 1
            if name == "br":
                run.append(" ")
            elif name in RAW:
                if not ends and not attributes.endswith("/") and name not in unclosed:
                    done = re.compile(f"</{name}", re.I).search(html, at)
                    end = html.find(">", done.end()) if done else -1
                    if end >= 0:
                        at = end + 1
                    elif name in ENDLESS:
                        at = size
                    else:
                        unclosed.add(name)
            elif name in INLINE:
                pass
            elif ends:
                flush()
                if open_of[name] > 0:
                    pop(next(n for n in range(len(stack) - 1, 0, -1) if stack[n][0] == name))
                    in_link = 0
            else:
                flush()
                in_link = 0
                if name in VOID:
                    continue
                if name in NO_P and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                elif name in CLOSES:
                    while stack[-1][0] in CLOSES[name] or stack[-1][0] == "p":
                        pop(len(stack) - 1)
                bits = TAG_BIT.get(name, 0)
                if attributes:
                    for x in ATTRIBUTE.finditer(attributes):
                        for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x[1] or x[2] or x[3] or "").lower()):
                            bits |= WORD_BIT.get(w, 0)
                stack.append((name, self._open(stack[-1][1], len(stack), bits)))
                open_of[name] += 1
        flush()
        close(0)
        self.pages += 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {c: np.array(getattr(self, c), dtype=np.int64) for c in ("page", "parent", "end", "depth", "bits", "above", "chars", "linked", "stops")}


def features(a: dict[str, np.ndarray]) -> np.ndarray:
    """A row of numbers for each node."""
    n = len(a["page"])
    at, end, parent = np.arange(n), a["end"], a["parent"]
    within = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[at]
    text, link, stop, nodes = within(a["chars"]), within(a["linked"]), within(a["stops"]), end - at
    paragraphs = within((a["bits"] & TAG_BIT["p"]) > 0)
    articles = within((a["bits"] & MAIN) > 0)
    first = np.searchsorted(a["page"], a["page"])
    page_text, page_nodes, page_articles = text[first], nodes[first], articles[first]
    inner = at != parent
    children = np.bincount(parent[inner], minlength=n)
    sibling_text = np.bincount(parent[inner], text[inner], n)[parent] / np.maximum(1, children[parent])
    order = np.bincount(a["page"], minlength=1)
    bit = [(a[c] >> k) & 1 for c in ("bits", "above") for k in range(N_BITS)]
    parent_bits = a["bits"][parent]
    numbers = [
        a["depth"], np.log1p(text), link / np.maximum(1, text), stop / np.maximum(1, text), text / np.maximum(1, nodes), np.log1p(nodes), children, np.log1p(sibling_text),
        text / np.maximum(1, text[parent]), text / np.maximum(1, page_text), (at - first) / np.maximum(1, page_nodes), paragraphs / np.maximum(1, nodes),
        children[parent], link[parent] / np.maximum(1, text[parent]), np.minimum(articles, 3), np.minimum(page_articles, 3), ((parent_bits & TAG_BIT["p"]) > 0).astype(int), np.log1p(order[a["page"]]),
    ]
    return np.stack([*numbers, *bit], axis=1).astype(np.float32)


class Trees:
    """Boosted complete trees on binned features, logistic loss, second order; plain numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        z, inner = np.full(len(y), self.base), 2**DEPTH - 1
        self.feature, self.limit, self.leaf = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, feature, limit = np.zeros(len(y), int), np.zeros(inner, int), np.full(inner, np.inf, dtype=np.float32)
            for level in range(DEPTH):
                low, wide = 2**level - 1, 2**level
                gain, choice = np.full(wide, 1e-6), [(0, -1)] * wide
                total = np.bincount(node - low, g, wide), np.bincount(node - low, h, wide)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (node - low) * (BINS + 1) + bins[:, f]
                    gl, hl = (np.bincount(key, v, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)[:, : len(e)] for v in (g, h))
                    gr, hr = total[0][:, None] - gl, total[1][:, None] - hl
                    better = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (total[0] ** 2 / (total[1] + 1))[:, None]
                    best = better.argmax(1)
                    value = better[np.arange(wide), best]
                    for k in np.flatnonzero(value > gain):
                        gain[k], choice[k] = value[k], (f, best[k])
                right = np.zeros(len(y), int)
                for k, (f, b) in enumerate(choice):
                    if b >= 0:
                        feature[low + k], limit[low + k] = f, edges[f][b]
                        own = node == low + k
                        right[own] = bins[own, f] > b
                node = 2 * node + 1 + right
            leaf = RATE * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1)
            z += leaf[node - inner]
            self.feature.append(feature)
            self.limit.append(limit)
            self.leaf.append(leaf)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            z += leaf[node - len(feature)]
        return z


def decode(a: dict[str, np.ndarray], z: np.ndarray) -> np.ndarray:
    """The most likely set of nodes that is closed under ancestors; the page's root is always in it."""
    n, at, parent = len(z), np.arange(len(z)), a["parent"]
    yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    run = np.concatenate([[0], np.cumsum(no)])
    drop, keep = run[a["end"]] - run[at], yes.copy()
    by_depth = np.argsort(a["depth"], kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(a["depth"], minlength=1))[:-1])
    for rows in levels[:0:-1]:
        np.add.at(keep, parent[rows], np.maximum(keep[rows], drop[rows]))
    kept = np.zeros(n, dtype=bool)
    kept[levels[0]] = True
    for rows in levels[1:]:
        kept[rows] = kept[parent[rows]] & (keep[rows] > drop[rows])
    return kept


def labelled(nodes: Nodes, a: dict[str, np.ndarray]) -> np.ndarray:
    """Main text by the element that holds it: inside an article or main, under no boilerplate."""
    leaf = np.array([t is not None for t in nodes.texts], dtype=bool)
    return leaf & ((a["above"] & MAIN) > 0) & ((a["above"] & BOILER) == 0)


def holds(a: dict[str, np.ndarray], leaf: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(leaf)])
    return run[a["end"]] > run[np.arange(len(leaf))]


def layout(blocks: list[str], other: list[str], pick: random.Random) -> str:
    """A page of another make around the text blocks; what is main text begins with MARK."""
    one = lambda *x: pick.choice(x)
    words = lambda n: " ".join(pick.choice(other).split()[:n])
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(n)) + "</ul>"
    para = lambda n: f"<p>{words(n)}</p>"
    named = lambda kind: f'<div {one("class", "id")}="{one(*kind)}{one("", "-box", " wide", "_1")}">'
    body = [f"<h1>{MARK}{blocks[0]}</h1>"]
    for b in blocks[1:]:
        tag = one("p", "p", "p", "p", "p", "h2", "blockquote", "li")
        body.append(f"<ul><li>{MARK}{b}</li></ul>" if tag == "li" else f"<{tag}>{MARK}{b}</{tag}>")
        if pick.random() < 0.06:
            body.append(named(WORDS[5]) + para(12) + "</div>")
    comments = f'<section {one("id", "class")}="{one("comments", "comment-list", "discussion", "replies")}"><h2>{words(1)}</h2>' + "".join(f'<div class="{one("comment", "reply")}"><p>{words(pick.randint(3, 40))}</p></div>' for _ in range(pick.randint(1, 4))) + "</section>"
    inside = comments if pick.random() < 0.3 else ""
    hold = one("article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'section class="story"', 'div class="entry-content"', "article", "div")
    extra = lambda x, p: x if pick.random() < p else ""
    top = one("<header><h2>{}</h2><nav>{}</nav></header>", '<div class="header"><p>{}</p><div class="menu">{}</div></div>', "<div>{}</div><nav>{}</nav>").format(words(3), links(pick.randint(2, 8)))
    form = f'<form action="/s"><label>{words(2)}</label><input name="q"><p>{words(8)}</p><button>{words(1)}</button></form>'
    side = one("<aside>", '<div class="sidebar">', '<div id="side" class="widget">') + f"<h3>{words(2)}</h3>" + links(3) + para(15) + one("</aside>", "</div>")
    foot = one("<footer>&copy; {}</footer>", "<footer><p>&copy; {}</p></footer>", '<div class="footer"><p>{}</p></div>').format(words(12))
    notice = named(WORDS[6]) + para(pick.randint(5, 25)) + "<button>OK</button></div>"
    main = f"<{hold}>" + "".join(body) + inside + f"</{hold.split()[0]}>"
    parts = [top, extra(notice, 0.5), extra(named(WORDS[5]) + words(10) + "</div>", 0.6), extra(side, 0.4), main, extra(comments, 0.5), extra(side, 0.4), extra(form, 0.5), extra(named(WORDS[8]) + links(4) + "</div>", 0.3), foot, extra(notice, 0.2)]
    return f"<html><head><title>{words(5)}</title></head><body>{''.join(parts)}</body></html>"


def short_layout(blocks: list[str], pick: random.Random) -> str:
    """A page of a few short blocks and little else, its main element not always closed."""
    hold = pick.choice(["article", "main", 'div class="content"', "article"])
    some = [" ".join(b.split()[: pick.randint(1, 8)]) for b in blocks[: pick.randint(1, 4)]]
    body = f"<h1>{MARK}{some[0]}</h1>" + "".join(f"<p>{MARK}{b}" + pick.choice(["</p>", ""]) for b in some[1:])
    end = pick.choice([f"</{hold.split()[0]}>", f"</{hold.split()[0]}><footer>{some[0]}</footer>", ""])
    return pick.choice(["", "<nav><a href='/'>x</a></nav>"]) + f"<{hold}>{body}{end}"


def fit(pages: list[str]) -> Trees | None:
    """Boosted trees from pages with an article or main element and a second layout of each."""
    real = Nodes()
    for html in pages:
        real.add(html)
    a = real.arrays()
    leaf = labelled(real, a) if len(a["page"]) else np.zeros(0, bool)
    blocks: dict[int, list[str]] = {}
    for k in np.flatnonzero(leaf):
        blocks.setdefault(int(a["page"][k]), []).append(real.texts[k])
    if not blocks:
        return None
    pick, made = random.Random(7), Nodes()
    everything = [b for x in blocks.values() for b in x]
    for x in blocks.values():
        made.add(layout(x[:40], everything, pick))
        if pick.random() < 0.5:
            made.add(short_layout(x, pick))
    b = made.arrays()
    made_leaf = np.array([t is not None and t.startswith(MARK) for t in made.texts], dtype=bool)
    b["chars"] = b["chars"] - made_leaf
    known = np.isin(a["page"], list(blocks))
    x = np.concatenate([features(a)[known], features(b)])
    return Trees(x, np.concatenate([holds(a, leaf)[known], holds(b, made_leaf)]).astype(float))


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    nodes = Nodes()
    for html in pages:
        nodes.add(html)
    a = nodes.arrays()
    kept = decode(a, trees.log_odds(features(a))) if trees else holds(a, labelled(nodes, a))
    out: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(kept):
        if nodes.texts[k] is not None:
            out[nodes.page[k]].append(nodes.texts[k])
    return ["\n".join(x) for x in out]


def train(pages: DataFrame, html_col: str = "html", rows: int = FIT_PAGES) -> Trees | None:
    """Fit on at most `rows` pages, those of smallest digest; only these reach the driver."""
    digests = pages.where(F.col(html_col) != "").select(F.xxhash64(html_col).alias("h")).distinct()
    chosen = digest_sample(digests, F.col("h"), rows)  # at most `rows` longs: broadcast
    sample = pages.select(F.col(html_col).alias("html")).withColumn("h", F.xxhash64("html")).join(F.broadcast(chosen), "h")
    return fit([r.html for r in sample.dropDuplicates(["h"]).orderBy("h").collect()])


def extract(pages: DataFrame, trees: Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_texts(part.column(2).to_pylist(), trees)
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
