"""Main text of web pages, by gradient-boosted trees over DOM-node features.

Every block element gets features of its subtree (text density, link density, controls), its attributes' tokens, its
depth, its siblings and its ancestors. Boosted trees give its log-odds of holding main text. Decoding is hierarchical: of
all sets of nodes that hold a node only together with its ancestors, the one with the greatest sum of log-odds is kept (by
one pass from the leaves up), so a paragraph is never kept under a dropped ancestor, and a kept ancestor's dropped parts
are dropped whole.

The trees are trained on the driver, on TRAINING_PAGES pages that a seeded generator writes with known labels; that
sample's size is a parameter and does not grow with the data. The pages themselves are read in one narrow stage, without
a shuffle, whole, whatever their size.

Defined results: null or empty html, and pages without main text, give the empty text and n_chars 0; null ids and urls
pass through; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty table. A page
that breaks off inside a tag ends before that tag. <br> is white space inside its block. Text outside every block element
is a block of its own, judged like any other; a page without any block element is main text as a whole. Pages of any length
are judged alike: some training pages have up to some thousand blocks (LONG).
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.boosting import Boosted
from quillspark.llm.common import map_slices
from quillspark.llm.dom import Node, block_text, read

TRAINING_PAGES = 700
#: Blocks of the long pages that are written besides, and how many main paragraphs of such a page are learnt from.
LONG, LEARNT = [60, 120, 250, 600, 1500, 4000] * 4, 300

#: Attribute tokens by what they tell of a node.
LEXICON = {
    "content": "article content post entry story main body text prose copy read blog news page".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip links".split(),
    "edge": "header footer masthead foot head top bottom copyright legal branding logo colophon".split(),
    "side": "sidebar side aside widget rail related recommended popular trending more teaser promo recent".split(),
    "advert": "ad ads advert advertisement adslot sponsor sponsored banner promoted dfp outbrain taboola".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall subscribe newsletter warning message toast".split(),
    "form": "form search login signup register contact input field subscribe checkout".split(),
    "talk": "comment comments reply replies discussion respond disqus thread feedback reviews share social sharing follow tweet".split(),
}
TOKENS = {t: k for k, (_, words) in enumerate(LEXICON.items()) for t in words}
GROUPS = len(LEXICON)
TAGS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("div", "section"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog", "search"), ("article", "main"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption")]
TAG_OF = {t: k for k, group in enumerate(TAGS) for t in group}
BOILER_TAGS = frozenset("nav header footer aside form dialog menu".split())
NAMED = frozenset("class id role itemprop aria-label hidden style aria-hidden".split())
#: One attribute after another, so that neither a part of a name nor a value is taken for an attribute.
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
N_FEATURES = len(TAGS) + 2 * GROUPS + 20


@lru_cache(maxsize=20000)
def _tokens(attrs: str) -> tuple[tuple[int, ...], int]:
    """Lexicon groups of the tokens in an element's attributes; whether it is hidden."""
    groups, hidden = [0] * GROUPS, 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in NAMED:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = 1
        elif name != "style":
            for word in _WORD.findall(value):
                k = TOKENS.get(word.lower())
                if k is not None:
                    groups[k] = 1
    return tuple(groups), hidden


def features(nodes: list[Node], blocks: list[list], length: int) -> list[list[float]]:
    """A row for each node but the root."""
    n = len(nodes)
    text, link, tags, controls, stops, n_blocks = ([0] * n for _ in range(6))
    for node, pieces in blocks:
        joined = "".join(pieces)
        stops[node] += joined.count(".") + joined.count(",") + joined.count("!") + joined.count("?")
        n_blocks[node] += 1
    for i, x in enumerate(nodes):
        text[i], link[i], tags[i], controls[i] = x.own, x.links, x.tags, x.controls
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        link[p] += link[i]
        tags[p] += tags[i] + 1
        controls[p] += controls[i]
        stops[p] += stops[i]
        n_blocks[p] += n_blocks[i]
    log = math.log1p
    above: list[tuple] = [((0,) * GROUPS, 0, 0, 0)] * n  # lexicon groups, in article or main, in boilerplate elements, hidden
    rows = []
    page = max(1, text[0])
    ranks = [0] * n
    for x in nodes:
        for k, child in enumerate(x.children):
            ranks[child] = k
    for i in range(1, n):
        x = nodes[i]
        groups, hidden = _tokens(x.attrs) if x.attrs else ((0,) * GROUPS, 0)
        up = above[x.parent]
        above[i] = (tuple(map(max, groups, up[0])) if any(groups) else up[0], up[1] or x.tag in ("article", "main"), up[2] or x.tag in BOILER_TAGS, up[3] or hidden)
        m, rank = len(nodes[x.parent].children), ranks[i]
        parent = nodes[x.parent]
        kind = [0.0] * len(TAGS)
        k = TAG_OF.get(x.tag)
        if k is not None:
            kind[k] = 1.0
        rows.append(
            [*kind, *groups, *up[0], x.depth, log(x.own), log(text[i]), log(tags[i]), log(text[i] / (tags[i] + 1)), link[i] / max(1, text[i]), x.links / max(1, x.own), stops[i] / max(1, text[i]), log(len(x.children)), rank / m, log(m), text[i] / max(1, text[x.parent]), log((text[x.parent] - text[i]) / max(1, m - 1)), x.at / max(1, length), float(up[1]), float(up[2]), float(above[i][3]), log(controls[i]), text[i] / page, float(TAG_OF.get(parent.tag, -1))]
        )
    return rows


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Kept nodes: the best set that holds a node only with all its ancestors; odds are of nodes 1 and on."""
    n = len(nodes)
    best = [0.0] * n
    for i in range(n - 1, 0, -1):
        best[i] = max(0.0, best[i] + float(odds[i - 1]))
        best[nodes[i].parent] += best[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    read_pages = [read(p) for p in pages]
    rows: list[list[float]] = []
    for (nodes, blocks), page in zip(read_pages, pages):
        rows += features(nodes, blocks, len(page))
    odds = model.log_odds(np.array(rows, np.float64).reshape(-1, N_FEATURES))
    out, at = [], 0
    for nodes, blocks in read_pages:
        kept = decode(nodes, odds[at : at + len(nodes) - 1])
        at += len(nodes) - 1
        bare = all(not x.tag for x in nodes)  # no block element at all
        texts = [block_text(pieces) for node, pieces in blocks if bare or kept[node]]
        out.append("\n".join(t for t in texts if t))
    return out


# --- training pages ------------------------------------------------------------------------------------------------


class Writer:
    """Writes pages with known labels: data-y="1" stands at elements whose own text is main text."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.syllables = ["".join(rng.choices("bcdfghlmnprstvwé", k=1) + rng.choices("aeiou", k=1) + rng.choices(["", "n", "r", "s", "nd", "st"], k=1)) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.syllables, k=r.randint(1, 3))) + r.choices(["", ",", ".", "!", "***", " |"], [80, 8, 9, 1, 1, 1])[0] for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice([".", ".", ""])

    def el(self, tag: str, inner: str, cls: str | None = None, y: int = 0) -> str:
        r = self.r
        attrs = f' {r.choice(["class", "class", "id"])}="{cls}{r.choice(["", "", "-1", " x" + str(r.randint(0, 99))])}"' if cls else ""
        end = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{attrs}{' data-y=1' if y else ''}>{inner}{end}{r.choice(['', '', chr(10)])}"

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>'

    def links(self, low: int, high: int, tag: str = "ul", cls: str | None = None) -> str:
        return self.el(tag, "".join(self.el("li", self.link()) for _ in range(self.r.randint(low, high))), cls)

    def inline(self, text: str) -> str:
        r = self.r
        for tag in ("b", "a", "em", "br"):
            if r.random() < 0.25:
                w = text.split(" ")
                k = r.randrange(len(w))
                w[k] = "<br>" + w[k] if tag == "br" else (f'<a href="#">{w[k]}</a>' if tag == "a" else f"<{tag}>{w[k]}" + (f"</{tag}>" if r.random() < 0.8 else ""))
                text = " ".join(w)
        return text

    def boiler(self) -> str:
        r, w, el = self.r, self.words, self.el
        kind = r.randrange(16)
        if kind == 0:
            return el(r.choice(["nav", "div"]), self.links(2, 9), r.choice(["nav", "menu", "main-nav", "breadcrumb", "pagination"]))
        if kind == 1:
            return el("nav", self.links(1, 12))
        if kind == 2:
            return el(r.choice(["div", "div", "aside", "section"]), w(2, 40) if r.random() < 0.6 else el("p", w(3, 40)), r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "banner", "promo"]))
        if kind == 3:
            return el(r.choice(["aside", "div"]), el("h3", w(1, 3)) + (self.links(2, 8) if r.random() < 0.6 else el("p", w(5, 40))), r.choice(["sidebar", "side", "widget", "related", "recommended", None if r.random() < 0 else "trending"]))
        if kind == 4:
            return el("aside", el("h4", w(1, 4)) + el("p", w(5, 60)))
        if kind == 5:
            return el(r.choice(["div", "section"]), el("p", w(5, 40)) + "<button>" + w(1, 2) + "</button>", r.choice(["cookie-notice", "notice", "alert", "cookie-consent", "newsletter", "popup", "paywall", "message"]))
        if kind == 6:
            return el("form", "<label>" + w(1, 2) + "</label><input name=q><button>" + w(1, 1) + "</button>" + (el("p", w(3, 20)) if r.random() < 0.5 else ""), r.choice([None, "search", "login", "contact", "subscribe-form"]))
        if kind in (7, 8):
            comment = lambda: el(r.choice(["li", "div", "article"]), el("p", w(3, 60)) if r.random() < 0.8 else w(3, 40), r.choice(["comment", "reply", "comment-body"]))
            return el(r.choice(["section", "div", "ol"]), (el("h3", w(1, 3)) if r.random() < 0.5 else "") + "".join(comment() for _ in range(r.randint(1, 6))), r.choice(["comments", "discussion", "comment-list", "respond"]))
        if kind == 9:
            return self.links(2, 6, cls=r.choice(["share", "social", "follow"]))
        if kind == 10:
            return el("div", w(2, 30), r.choice(["notice", "alert", "warning", "gdpr"]))
        if kind == 11:
            return el("header", r.choice([el("h1", self.link()), el("div", w(1, 4), "logo"), w(1, 6)]) + (el("nav", self.links(2, 7)) if r.random() < 0.5 else ""))
        if kind == 12:
            return el("footer", r.choice(["&copy; 2024 ", ""]) + w(2, 30) + (self.links(1, 5) if r.random() < 0.3 else ""))
        if kind == 13:
            return el("footer", el("p", "&copy; " + w(2, 25)))
        if kind == 14:
            return el("div", r.choice([w(2, 20), el("p", w(2, 20)), self.links(2, 6)]), r.choice(["footer", "header", "copyright", "masthead", "site-footer"]))
        return f"<!-- {w(1, 4)} --><script>var a = '</p>{w(1, 3)}';</script>"

    def main(self, blocks: int | None = None) -> str:
        r, w, el = self.r, self.words, self.el
        out = [el(r.choice(["h1", "h1", "h2"]), self.inline(w(1, 12)), None, 1)] if r.random() < 0.85 else []
        for _ in range(blocks or r.choice([0, 1, 1, 2, 3, 5, 8, 15, 30])):
            kind = r.random()
            if kind < 0.80:
                out.append(el("p", self.inline(w(1, 5) if r.random() < 0.2 else w(5, 90)), None, 1))
            elif kind < 0.84:
                out.append(el(r.choice(["h2", "h3"]), w(1, 8), None, 1))
            elif kind < 0.89:
                out.append(el(r.choice(["ul", "ol"]), "".join(el("li", self.inline(w(1, 25)), None, 1) for _ in range(r.randint(1, 7)))))
            elif kind < 0.92:
                out.append(el("blockquote", w(5, 40), None, 1) if r.random() < 0.5 else el("blockquote", el("p", w(5, 40), None, 1)))
            elif kind < 0.94:
                out.append(el(r.choice(["pre", "figcaption"]), w(3, 30), None, 1))
            elif kind < 0.96:
                out.append(el("table", "".join(el("tr", "".join(el("td", w(1, 4), None, 1) for _ in range(3))) for _ in range(r.randint(1, 5)))))
            elif kind < 0.98:
                out.append(el("div", w(5, 60), None, 1))
            else:
                out.append(el(r.choice(["section", "div"]), el("h2", w(1, 6), None, 1) + el("p", w(5, 60), None, 1)))
            if r.random() < (0.04 if blocks is None else 2 / blocks):
                out.append(self.boiler())
        if r.random() < 0.15:
            out.append(self.boiler())
        inner = "".join(out)
        if r.random() < 0.2:
            inner = el("div", inner, r.choice([None, "content", "body", "text", "entry-content"]))
        tag, cls = r.choice([("article", None), ("article", None), ("article", None), ("article", "post"), ("main", None), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "article-body"), ("div", "entry"), ("section", "story"), ("div", None)])
        inner = el(tag, inner, cls)
        return el(r.choice(["main", "div"]), inner + (self.boiler() if r.random() < 0.3 else ""), r.choice([None, "container", "page", "main"])) if r.random() < 0.25 else inner

    def page(self, blocks: int | None = None) -> str:
        r = self.r
        before = "".join(self.boiler() for _ in range(r.choice([0, 1, 2, 2, 3, 5])))
        after = "".join(self.boiler() for _ in range(r.choice([0, 1, 1, 2, 3, 4])))
        wrap = lambda x: self.el("div", x, r.choice([None, "page", "wrapper"])) if r.random() < 0.3 else x
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{wrap(before + self.main(blocks) + after)}</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 and blocks is None else page


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 5) -> Boosted:
    """The model, from pages of the generator; a node is positive if main text lies in its subtree."""
    writer = Writer(random.Random(seed))
    xs, ys = [], []
    for blocks in [None] * pages + LONG:
        page = writer.page(blocks)
        nodes, found = read(page)
        y = [0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            y[i] |= int("data-y=1" in nodes[i].attrs and nodes[i].own > 0)
            y[nodes[i].parent] |= y[i]
        rows = features(nodes, found, len(page))
        leaves = [i for i in range(1, len(nodes)) if y[i] and not nodes[i].children]
        left = set(writer.r.sample(leaves, len(leaves) - LEARNT)) if len(leaves) > LEARNT else ()
        xs += [x for i, x in enumerate(rows, 1) if i not in left]
        ys += [v for i, v in enumerate(y) if i and i not in left]
    return Boosted().fit(np.array(xs, np.float64), np.array(ys, np.float64))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or trained()  # of bounded size, so it goes to the tasks with the code

    def rows(batch):
        texts = main_texts([x or "" for x in batch.column("html").to_pylist()], model)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_slices(own, "html", EXTRACTED, rows)
