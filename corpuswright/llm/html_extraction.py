"""Main-text extraction: boosted trees over DOM nodes, decoded so that ancestors and descendants agree."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import columns_of, text_of
from .dom import NAMES, Node, features, read

#: Made pages that the trees are fitted on; one in four calibrates. Nothing of the input is learned from.
PAGES, TREES = 1200, 100
#: What an element pays, in log-odds, if its children part ways; evidence of one node counts up to LIMIT.
PART, LIMIT = 1.0, 6.0
#: The part of an element's evidence for main text that stands if its children part ways: most of it may still be.
KEPT = 0.7
SCHEMA = "page_id long, url string, text string, n_chars long"


#: Names that made pages use besides those that the features group, by what the element is; some say nothing.
MORE_NAMES = {
    "menu": "subnav crumbs hamburger drawer mainmenu quicklinks", "foot": "colophonbar imprint siteinfo bottombar", "advert": "skyscraper billboard adslot outbrain taboola leaderboard partnerlink",
    "side": "sidecolumn rightrail readmore alsoread recirculation", "notice": "banneralert gdprbox toast announcement", "form": "signupbox optin searchbox", "reader": "commentary guestbook threads ugc",
    "header": "branding hero pagehead", "share": "sharebar followus socialicons", "main": "storybody copytext richtext chapter bodytext articletext",
}
NEUTRAL = "block box module col row inner wrapper panel unit grid cell".split()


class _Maker:
    """Makes pages whose elements are known to be main text or not (attribute data-main); kinds in `without` aren't made."""

    def __init__(self, seed: int, without: frozenset = frozenset()):
        self.r = random.Random(seed)
        self.kinds = [k for k in range(9) if k not in without]

    def name(self, kind: str, *known: str | None) -> str | None:
        """A name for an element of that kind: a known one, another one, or one that says nothing, alone or together."""
        r = self.r
        chosen = r.choice(known) if r.random() < 0.7 else r.choice(MORE_NAMES[kind].split())
        if r.random() < 0.2:
            chosen = f"{chosen or ''} {r.choice(NEUTRAL)}".strip()
        return chosen

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices("etaoinshrdlucmfwy", k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
        for i in range(r.randint(5, 14), len(out), r.randint(6, 14)):
            out[i] += r.choice(".,")
        return " ".join(out).capitalize() + r.choice([".", ".", ".", ""])

    def el(self, tag: str, inside: str, name: str | None = None, main: bool | None = None) -> str:
        key = self.r.choice(["class", "id", "class"])
        return f"<{tag}{f' {key}="{name}"' if name else ''}{'' if main is None else f' data-main="{int(main)}"'}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        many = range(self.r.randint(low, high))
        if self.r.random() < 0.7:
            return self.el("ul", "".join(f"<li><a href='/x'>{self.words(1, 4)}</a></li>" for _ in many))
        return " ".join(f"<a href='/x'>{self.words(1, 3)}</a>" for _ in many)

    def boiler(self) -> str:
        r = self.r
        kind = r.choice(self.kinds)
        if kind == 0:
            return r.choice([self.el("nav", self.links(3, 9), main=False), self.el("div", self.links(3, 9), self.name("menu", "menu", "nav-main", "topbar", "breadcrumb"), False)])
        if kind == 1:
            return self.el(*r.choice([("footer", None), ("div", "footer"), ("div", "copyright")])[:1], "&copy; " + self.words(2, 20), self.name("foot", None, "footer", "page-footer"), False)
        if kind == 2:
            return self.el(r.choice(["div", "div", "section", "p", "aside"]), self.words(2, 60), self.name("advert", "ad", "ads", "advert", "banner-top", "sponsor", "promo-box"), False)
        if kind == 3:
            tag = r.choice(["aside", "div"])
            title = self.el(r.choice(["h3", "h4"]), self.words(1, 4)) if r.random() < 0.6 else ""
            body = r.choice([self.links(3, 8), f"<p>{self.words(5, 60)}</p>", self.words(3, 60), f"<p>{self.words(20, 120)}</p>" * 2])
            return self.el(tag, title + body, self.name("side", "sidebar", "related", "widget", *[None] * (tag == "aside")), False)
        if kind == 4:
            return self.el(r.choice(["div", "section", "p"]), self.words(4, 50) + r.choice(["", "<button>OK</button>"]), self.name("notice", "cookie-notice", "consent", "notice", "alert", "gdpr"), False)
        if kind == 5:
            return self.el("form", f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.words(3, 20)}</p>"]), self.name("form", None, "search", "login", "newsletter"), False)
        if kind == 6:
            each = "".join(self.el(r.choice(["div", "li", "article"]), f"<p>{self.words(3, 80)}</p>", r.choice(["comment", "comment-body", "reply"])) for _ in range(r.randint(1, 6)))
            return self.el(r.choice(["section", "div", "ol"]), f"<h3>{self.words(1, 3)}</h3>" + each, self.name("reader", "comments", "comment-list", "discussion"), False)
        if kind == 7:
            return self.el("header", r.choice([self.words(1, 6), self.links(2, 6), f"<h2>{self.words(1, 5)}</h2>"]), self.name("header", None, "header", "masthead"), False)
        return self.el("div", self.links(2, 5), self.name("share", "share", "social"), False)

    def article(self) -> str:
        r = self.r
        parts = [f"<{h}>{self.words(2, 14)}</{h}>" for h in ["h1"] * (r.random() < 0.8)]
        for _ in range(r.choice([1, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14)])):
            body = self.words(*r.choice([(1, 3), (5, 40), (20, 120), (60, 300)]))
            if r.random() < 0.15:
                body = body.replace(" ", " <a href='/y'>link</a> ", 1)
            form = r.random()
            parts.append(f"<p><b>{body}<br>" if form < 0.1 else f"<p>{body}</p>" if form < 0.8 else f"<ul><li>{body}</li><li>{self.words(3, 20)}</li></ul>" if form < 0.87 else f"<blockquote>{body}</blockquote>" if form < 0.93 else f"<h2>{self.words(1, 6)}</h2>")
        if len(parts) > 3 and r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), self.boiler())
        tag, name = r.choice([("article", None), ("article", None), ("article", "post"), ("main", None), ("div", "content"), ("div", "article-body"), ("div", "post"), ("section", "entry"), ("div", "main"), ("div", None), ("div", "x1")])
        inner = self.el(tag, "".join(parts), self.name("main", name), True)
        for _ in range(r.choice([0, 0, 1])):
            inner = self.el(r.choice(["div", "main", "section"]), inner + (self.boiler() if r.random() < 0.3 else ""), r.choice([None, "wrap", "container", "page"]))
        return inner

    def page(self) -> str:
        r = self.r
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body data-main=\"0\">"
        return head + "".join(self.boiler() for _ in range(r.randint(0, 4))) + self.article() + "".join(self.boiler() for _ in range(r.randint(0, 4))) + "</body></html>"


@functools.cache
def fit(pages: int = PAGES, seed: int = 1, without: frozenset = frozenset()) -> boosting.Trees:
    """Calibrated trees from made pages; an element counts as main text if more of its characters are than aren't."""
    maker = _Maker(seed, without)
    x, y, aside = [], [], []
    for k in range(pages):
        nodes, _ = read(maker.page())
        main = [n.own if n.main else 0 for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] += main[i]
        for node, row, good in zip(nodes, features(nodes), main, strict=True):
            if node.chars:
                x.append(row)
                y.append(2 * good > node.chars)
                aside.append(k % 4 == 0)
    x, y, aside = np.array(x), np.array(y, float), np.array(aside)
    return boosting.calibrate(boosting.fit(x[~aside], y[~aside], NAMES, trees=TREES), x[aside], y[aside])


def decode(nodes: list[Node], margins: list[float]) -> list[bool]:
    """For each element, whether its own text is main text.

    An element is all in, all out, or parted, and below one that is in (out) everything is in (out). In and out score the
    evidence of the whole subtree for and against; parted scores the best of each child and of the element's own text,
    less PART, and KEPT of the element's evidence for. So a short paragraph isn't torn from its article, nor an advert's sentence kept without the advert.
    """
    n = len(nodes)
    held = [max(-LIMIT, min(LIMIT, m)) if node.chars else 0.0 for node, m in zip(nodes, margins, strict=True)]
    total = list(held)
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    best, parted = [0.0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        several = sum(nodes[c].chars > 0 for c in nodes[i].children) + (nodes[i].own > 0) > 1
        apart = sum(best[c] for c in nodes[i].children) + (abs(held[i]) if nodes[i].own else KEPT * max(held[i], 0.0)) - PART * several
        parted[i] = bool(nodes[i].children) and apart > abs(total[i])
        best[i] = max(apart, abs(total[i])) if nodes[i].children else abs(total[i])
    out: list[bool | None] = [None] * n
    whole: list[bool | None] = [None] * n  # what an ancestor has decided
    for i in range(n):
        if i and whole[nodes[i].parent] is not None:
            whole[i] = whole[nodes[i].parent]
        elif not parted[i]:
            whole[i] = total[i] > 0
        out[i] = held[i] > 0 if whole[i] is None else whole[i]
    return out


def extract(pages: list[str], model: boosting.Trees) -> list[str]:
    """The main text of each page: its blocks in page order, joined by one space."""
    read_all = [read(html) for html in pages]
    rows = [row for nodes, _ in read_all for row in features(nodes)]
    margins = model.margins(np.array(rows)).tolist() if rows else []
    out, at = [], 0
    for nodes, runs in read_all:
        keep = decode(nodes, margins[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(text for i, text in runs if keep[i]))
    return out


def main_text(pages: DataFrame, model: boosting.Trees | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    html is read whole; null counts as empty, and a page without main text gives an empty text. Extra columns are
    ignored; rows that repeat are extracted each. The model (see `fit`) has a fixed size and is broadcast.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit())

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = extract(some.column(2).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = columns_of(pages, ["page_id", "url", "html"], "HTML extraction").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(work, SCHEMA)
