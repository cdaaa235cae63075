"""A forgiving HTML reader: block elements with their text runs and features."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

# Fixed values of HTML: element kinds by name.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label"
    " legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|title|iframe|svg|canvas|noembed|noframes|xmp"
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table select body html menu".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - {"button", "label", "option", "select", "legend", "summary"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: The start and end of an xmp element, whose content is text as it stands.
_XMP = re.compile(r"\A<xmp(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|</xmp\s*+>\Z", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-main)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[a-z]+")

# Parts of class, id and role names, by what they tell.
GROUPS = {
    "main": "article articlebody content entry main post story text prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar pagination tabs",
    "foot": "footer foot copyright legal bottom colophon",
    "side": "sidebar aside related recommended widget rail more popular trending teaser",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense dfp",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay warning disclaimer privacy",
    "form": "form search login signup subscribe newsletter contact",
    "reader": "comment comments reply replies respond discussion disqus feedback reviews",
    "social": "share sharing social follow tweet facebook",
}
_GROUP = {part: g for g, parts in GROUPS.items() for part in parts.split()}
TAGS = {
    "main": "article main",
    "menu": "nav header menu",
    "foot": "footer",
    "side": "aside",
    "form": "form button select option textarea label fieldset legend",
}
#: Parts of names of three letters or more are hashed into so many features, whether GROUPS has them or not.
BUCKETS = 48
_TAG_GROUP = {tag: g for g, tags in TAGS.items() for tag in tags.split()}
NAMES = [
    *(f"own_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS), "is_p", "is_heading", "is_list", "is_table", "depth",
    *(f"name_{i}" for i in range(BUCKETS)), "chars", "own_chars", "link_share", "tags_per_char", "words_per_run", "stops_per_word", "children", "siblings", "sibling_p", "place", "share_of_page", "share_of_parent",
]


_NO_NAMES = (0.0,) * BUCKETS


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset
    above: frozenset
    names: frozenset = frozenset()
    main: bool | None = None
    own: int = 0  # characters of its own runs
    chars: int = 0  # of all below too
    linked: int = 0
    tags: int = 1
    runs: int = 0
    words: int = 0
    stops: int = 0
    children: list[int] = field(default_factory=list)


def read(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements, the first of which is the root, and the text runs in page order with their element.

    A run ends wherever a block begins or ends; inline elements add to it and br parts its words. Character references
    are decoded, none of them over a tag, and white space is one space. Scripts, styles, comments, the head's title and the like are no text;
    formulas and an object's fallback are, and an xmp element's content as it stands.
    """
    none: frozenset = frozenset()
    nodes = [Node("#root", -1, 0, none, none)]
    stack = [0]
    runs: list[tuple[int, str]] = []
    held: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                node = nodes[stack[-1]]
                runs.append((stack[-1], text))
                n = len(text)
                node.own += n
                node.linked += min(linked, n)
                node.runs += 1
                node.words += text.count(" ") + 1
                node.stops += text.count(".") + text.count(",")
            held.clear()
        linked = 0

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            held.append(unescape(piece))
            if links:
                linked += len(piece.strip())
        at = m.end()
        if m[1] and m[1].lower() == "xmp":
            held.append(f" {_XMP.sub('', m[0])} ")
            continue
        if m[3] is None and m[6] is None:
            continue
        end, tag, rest = (m[2], m[3], m[4]) if m[3] is not None else (m[5], m[6], m[7])
        tag = tag.lower()
        if tag == "a":
            links = 0 if end else 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in BLOCKS:
            nodes[stack[-1]].tags += not end
            continue
        if end:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close_to(depth)
                    break
            else:
                flush()
            continue
        if tag in ("html", "body") and any(nodes[i].tag == tag for i in stack):
            continue
        flush()
        if tag in ENDS_P and nodes[stack[-1]].tag == "p":
            close_to(len(stack) - 1)
        if closes := CLOSED_BY.get(tag):
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in closes.split():
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in SCOPES and not (tag in ("td", "th") and nodes[stack[depth]].tag == "tr"):
                    break
        groups, names, main = set(), set(), None
        if rest:
            for key, value in _ATTRIBUTE.findall(rest):
                if key.lower() == "data-main":
                    main = "1" in value
                else:
                    parts = _PART.findall(value.lower())
                    groups.update(_GROUP[p] for p in parts if p in _GROUP)
                    names.update(crc32(p.encode()) % BUCKETS for p in parts if len(p) > 2)
        if g := _TAG_GROUP.get(tag):
            groups.add(g)
        up = nodes[stack[-1]]
        up.children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], up.depth + 1, frozenset(groups), up.above | up.groups, frozenset(names), main if main is not None else up.main))
        if tag not in VOID:
            stack.append(len(nodes) - 1)
    if at < len(html):
        held.append(unescape(html[at:]))
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.chars += node.own
        if node.parent >= 0:
            up = nodes[node.parent]
            up.chars += node.chars
            up.linked += node.linked
            up.tags += node.tags
            up.runs += node.runs
            up.words += node.words
            up.stops += node.stops
    return nodes, runs


def features(nodes: list[Node]) -> list[list[float]]:
    """A row of NAMES for each element."""
    page = max(nodes[0].chars, 1)
    out, before = [], 0
    paragraphs = [sum(nodes[c].tag == "p" for c in node.children) for node in nodes]
    for node in nodes:
        up = nodes[max(node.parent, 0)]
        chars = max(node.chars, 1)
        out.append(
            [
                *[float(g in node.groups) for g in GROUPS], *[float(g in node.above) for g in GROUPS],
                float(node.tag == "p"), float(node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(node.tag in ("ul", "ol", "li", "dl", "dd", "dt")), float(node.tag in ("table", "tr", "td", "th", "tbody", "thead")), float(node.depth),
                *(map(float, map(node.names.__contains__, range(BUCKETS))) if node.names else _NO_NAMES),
                float(node.chars), float(node.own), node.linked / chars, node.tags / chars, node.words / max(node.runs, 1), node.stops / max(node.words, 1),
                float(len(node.children)), float(len(up.children)), float(paragraphs[max(node.parent, 0)]), before / page, node.chars / page, node.chars / max(up.chars, 1),
            ]
        )
        before += node.own
    return out
