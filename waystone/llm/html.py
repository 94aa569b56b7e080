"""Operator 8: main text of web pages, by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_fields

#: Nodes of pages that are judged at once, if no single page has more.
RUN_NODES = 20_000
#: Attributes up to a tag's end: a quote right after = runs to its fellow, whatever stands inside; elsewhere quotes say nothing.
_ATTR = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)[^>=]*+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)({_ATTR}|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NO_TEXT = re.compile(r"(?:\s|<[^>]*>)*+")

#: Elements by how the parser treats them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr output picture q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var label "
    "svg g path circle ellipse line polygon polyline rect text tspan textpath defs desc use symbol clippath mask marker pattern lineargradient radialgradient stop filter math mi mn mo mrow mfrac msup msub msqrt".split()
)
#: Elements with a fallback or inert inside; those without a word leave no trace in the block around them.
EMBEDS = frozenset("noscript object template select video audio canvas".split())
CLOSES_ITSELF = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table thead tbody tfoot", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
SAME_GROUP = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
PARTS = frozenset("li dt dd tr td th thead tbody tfoot figcaption option".split())

_ENDS = re.compile(rf"</({'|'.join(sorted(RAW | EMBEDS))})(?=[\s/>])", re.I)

#: Element names and parts of class, id and role that are features of a node.
TAGS = "text html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside form ul ol li dl table tr td figure figcaption blockquote pre button fieldset dialog address details center menu noscript object template select video xmp".split()
FRAME_WORDS = (
    "nav menu header footer side sidebar ad ads advert sponsor promo banner cookie consent notice privacy popup modal overlay newsletter subscribe "
    "signup share social comment reply discuss respond related recommend more breadcrumb pag login search form widget copyright legal tag toolbar "
    "alert hidden skip toc rating user avatar"
).split()
WORDS = FRAME_WORDS + "article content post entry main body story text page wrapper container title headline lead summary".split()
#: Parts of names that tell of a page's state (has-sidebar, no-comments), not of what the element holds.
STATES = frozenset("has have no not non with without is are allow allows enable enabled disable disabled hide hides show shows on off open closed".split())
#: An element with more than this share of a page's text wraps the page; what its names say of parts around the text is not said of it.
WRAPS = 0.97
SIGNS = ("©", "|", "»", "→", "•", "·")
NAMES = len(TAGS) + len(WORDS)
KINDS = 9  #: features of a text's shape, lengths in UTF-8 bytes, so that scripts without spaces count alike
SHAPES = 8  #: features of what a node holds: its length and share of links
FEATURES = 2 * NAMES + len(SIGNS) + KINDS + 4 * SHAPES + 3  #: the last: the node wraps the page, the page is bare, always


@dataclass
class Page:
    """Nodes of a page in document order; text is None but for leaves that hold a block of text."""

    parent: list[int]
    tag: list[str]
    name: list[str]
    text: list[str | None]
    linked: list[int]


def parse_page(source: str | None) -> Page:
    """The block structure of a page: an element a node, a run of inline content a leaf with its decoded text.

    Void and raw elements (scripts, styles, text fields, frames) leave nothing, a raw one without its end tag takes the
    rest as in browsers; xmp leaves its text as it is. Inline elements are part of the run that they stand in, br is
    white space in it. What stands in noscript, object, template, select and the like is parsed as any other; without
    their end tags they go on like other blocks. Wrong nesting is mended as browsers do in the main: blocks end an open
    paragraph, list items and cells their like, stray end tags nothing.
    """
    page = Page([-1], ["html"], [""], [None], [0])
    stack: list[tuple[str, int]] = [("html", 0)]
    run: list[str] = []
    ends: dict[str, list[int]] = {}
    empty = (0, -1)  # from the first of these places to the second there are tags and white space alone
    links = [0, 0]  # open anchors, characters in them

    def add(tag: str, name: str, text: str | None = None, linked: int = 0) -> None:
        page.parent.append(next(n for _, n in reversed(stack) if n >= 0))
        for column, value in ((page.tag, tag), (page.name, name), (page.text, text), (page.linked, linked)):
            column.append(value)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                add("text", "", text, min(links[1], len(text)))
            links[1] = 0

    def leave(k: int) -> None:
        """Closes the open elements from place k on."""
        for name, n in stack[k:]:
            if n >= 0:
                flush()
            if name == "a" and links[0]:
                links[0] -= 1
        del stack[k:]

    def say(raw: str) -> None:
        if raw:
            t = _html.unescape(raw) if "&" in raw else raw
            run.append(t)
            if links[0]:
                links[1] += len(t)

    source = source or ""
    for m in _ENDS.finditer(source):  # all in one pass, whatever stays open
        ends.setdefault(m[1].lower(), []).append(m.start())
    at = 0
    while m := _TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if k and (name not in INLINE or all(n < 0 for _, n in stack[k:])):
                leave(k)
            elif name == "br":
                run.append("\n")
            continue
        end = -1
        if name in RAW or name in EMBEDS:
            places = ends.get(name, [])
            k = bisect_left(places, at)
            end = places[k] if k < len(places) else -1
        if name in RAW:
            stop = end if end >= 0 else len(source)
            if name == "xmp":
                flush()
                add("xmp", "")
                stack.append(("xmp", len(page.parent) - 1))
                run.append(source[at:stop])
                flush()
                stack.pop()
            at = stop
            continue
        if end >= 0:
            if not empty[0] <= at <= empty[1]:
                empty = (at, _NO_TEXT.match(source, at).end())
            if empty[1] >= end:
                at = end
                continue
        if name in VOID:
            if name == "br":
                run.append("\n")
            elif name == "hr":
                flush()
            continue
        if name in INLINE:
            if name in ("svg", "path", "circle", "rect", "line", "use") and attrs.endswith("/"):
                continue
            stack.append((name, -1))
            links[0] += name == "a"
            continue
        flush()
        if name in CLOSES_ITSELF:
            stop, like = CLOSES_ITSELF[name].split(), SAME_GROUP.get(name, (name,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in like:
                    leave(i)
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                leave(i)
                break
            if stack[i][1] >= 0:
                break
        if name in ("html", "head"):
            continue
        found = " ".join(x.strip("\"'") for x in _NAMED.findall(attrs)).lower() if attrs else ""
        if attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*.?true", attrs, re.I):
            found += " hidden"
        add(name, found)
        stack.append((name, len(page.parent) - 1))
    say(source[at:])
    flush()
    return page


_TAG_NO = {t: i for i, t in enumerate(TAGS)}
_WORD_NO = {w: i for i, w in enumerate(WORDS)}
_SPLIT = re.compile(r"[^a-z]+")
_LONG_WORDS = [w for w in WORDS if len(w) > 3]


def _words_of(name: str) -> set[int]:
    """Numbers of the words that a node's class, id and role hold: as a part between hyphens, or at either end of one."""
    out: set[int] = set()
    for token in name.split():
        parts = [x for x in _SPLIT.split(token) if x]
        if STATES.isdisjoint(parts):
            out |= {_WORD_NO[x] for x in parts if x in _WORD_NO} | {_WORD_NO[x[:-1]] for x in parts if x[-1] == "s" and x[:-1] in _WORD_NO}
            out |= {_WORD_NO[w] for w in _LONG_WORDS if any(x.startswith(w) or x.endswith(w) for x in parts)}
    return out


class _Trees:
    """Nodes of pages end to end: parent (-1: none) by number, and levels of nodes by depth."""

    def __init__(self, pages: list[Page]):
        size = [len(p.tag) for p in pages]
        first = np.repeat(np.cumsum([0, *size[:-1]]), size)
        parent = np.concatenate([p.parent for p in pages]).astype(np.int64)
        self.parent = np.where(parent < 0, -1, parent + first)
        levels, nodes = [], np.flatnonzero(parent < 0)
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while len(nodes):
            levels.append(nodes)
            lo, hi = np.searchsorted(sorted_parent, nodes, "left"), np.searchsorted(sorted_parent, nodes, "right")
            nodes = order[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())]
        self.levels = levels


_FRAME_BITS = sum(1 << (len(TAGS) + _WORD_NO[w]) for w in FRAME_WORDS)
_NAME_BITS = ((1 << len(WORDS)) - 1) << len(TAGS)
#: What no page without parts around its text has.
_PART_BITS = _FRAME_BITS | sum(1 << _TAG_NO[t] for t in "header footer nav aside form button fieldset dialog address menu".split())


@dataclass
class _Marks:
    """Features of the nodes of pages, packed: names as bits, own and of all that a node stands in, shapes as codes."""

    own: list[int]
    around: list[int]
    code: np.ndarray
    texts: np.ndarray
    said: np.ndarray
    whole: np.ndarray


def _marks(pages: list[Page], trees: _Trees) -> _Marks:
    parent = trees.parent
    n = len(parent)
    own, names = [], {}
    length, linked, page_of = np.zeros(n), np.zeros(n), np.repeat(np.arange(len(pages)), [len(p.tag) for p in pages])
    texts, said, i = [], [], 0
    for p in pages:
        for tag, name, text, own_linked in zip(p.tag, p.name, p.text, p.linked, strict=True):
            bits = 1 << _TAG_NO.get(tag, _TAG_NO["div"])
            if name and tag not in ("html", "body"):  # their names tell of the page
                if name not in names:
                    names[name] = sum(1 << (len(TAGS) + k) for k in _words_of(name))
                bits |= names[name]
            own.append(bits)
            if text is not None:
                wide = len(text.encode("utf-8", "surrogatepass"))
                share = own_linked / len(text)
                length[i], linked[i] = wide, wide * share
                texts.append(i)
                commas = sum(map(text.count, ",、，،"))
                said.append([*(s in text for s in SIGNS), wide < 12, 12 <= wide < 25, 25 <= wide < 80, 80 <= wide < 250, wide >= 250, share > 0.9, 0.3 < share <= 0.9, text[-1] in ".!?:;\"'”»。！？：」؟", min(3, commas * 100 / wide)])
            i += 1
    for nodes in reversed(trees.levels[1:]):
        np.add.at(length, parent[nodes], length[nodes])
        np.add.at(linked, parent[nodes], linked[nodes])
    whole = length[np.flatnonzero(parent < 0)][page_of] if n else length
    wraps = (length >= WRAPS * whole) & (whole > 0)
    for i in np.flatnonzero(wraps):
        own[i] &= ~_FRAME_BITS if own[i] & _NAME_BITS else -1
    around = [0] * n
    for i, up in enumerate(parent.tolist()):  # parents come before their children
        if up >= 0:
            around[i] = around[up] | own[up]
    parts = np.bincount(page_of, np.fromiter((bits & _PART_BITS != 0 for bits in own), bool, n), len(pages)) > 0
    share = linked / np.maximum(length, 1)
    bare = ~parts & (share[np.flatnonzero(parent < 0)] <= 0.05) if n else parts
    code = np.digitize(share, [0.05, 0.2, 0.5, 0.9], right=True) * 4 + np.digitize(length, [60, 300, 1500])
    return _Marks(own, around, code.astype(np.uint8), np.array(texts, np.int64), np.array(said, np.float32).reshape(-1, len(SIGNS) + KINDS), np.stack([wraps, bare[page_of]], axis=1).astype(np.float32))


def _shape(code: np.ndarray) -> np.ndarray:
    """SHAPES features of each code: share of links above 0.9, 0.5, 0.2, at most 0.05; length below 60, 300, 1500 and above."""
    share, size = code // 4, code % 4
    return np.stack([share == 4, share == 3, share == 2, share == 0, *(size == k for k in range(4))], axis=-1).astype(np.float32)


def _ancestors(parent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(steps up, nodes, the node so many steps above each) for 0 to 3 steps."""
    nodes, up = np.arange(len(parent)), np.arange(len(parent))
    for k in range(4):
        yield k, nodes, up
        some = parent[up] >= 0
        nodes, up = nodes[some], parent[up[some]]


def node_features(pages: list[Page], trees: _Trees | None = None) -> np.ndarray:
    """A row of FEATURES for each node of the pages: element and words of its names, those of all that it stands in,
    a text's shape, and how long and how linked the node is, and each of the three next around it. For training."""
    trees = trees or _Trees(pages)
    m, x = _marks(pages, trees), np.zeros((len(trees.parent), FEATURES), np.float32)
    for at, masks in ((0, m.own), (NAMES, m.around)):
        for i, bits in enumerate(masks):
            x[i, [at + k for k in range(NAMES) if bits >> k & 1]] = 1
    t0 = 2 * NAMES
    f = t0 + len(SIGNS) + KINDS
    x[m.texts, t0:f] = m.said
    for k, nodes, up in _ancestors(trees.parent):
        x[nodes, f + k * SHAPES : f + (k + 1) * SHAPES] = _shape(m.code[up])
    x[:, -3:-1] = m.whole
    x[:, -1] = 1
    return x


def node_scores(pages: list[Page], trees: _Trees, weight: np.ndarray) -> np.ndarray:
    """node_features @ weight without the rows: names are summed once for each set of them, shapes looked up by code."""
    m, t0 = _marks(pages, trees), 2 * NAMES
    f = t0 + len(SIGNS) + KINDS
    out = m.whole @ weight[-3:-1] + float(weight[-1])
    for at, masks in ((0, m.own), (NAMES, m.around)):
        sums: dict[int, float] = {}
        for bits in set(masks):
            sums[bits] = sum(float(weight[at + k]) for k in range(bits.bit_length()) if bits >> k & 1)
        out += np.fromiter(map(sums.__getitem__, masks), float, len(masks))
    np.add.at(out, m.texts, m.said @ weight[t0:f])
    for k, nodes, up in _ancestors(trees.parent):
        out[nodes] += (_shape(np.arange(20)) @ weight[f + k * SHAPES : f + (k + 1) * SHAPES])[m.code[up]]
    return out


def _kinds(page: Page) -> np.ndarray:
    return np.array([1 if t is not None else 2 if tag in PARTS else 0 for t, tag in zip(page.text, page.tag, strict=True)], np.int64)


@dataclass
class TreeModel:
    """Node weights of a logistic potential, and log potentials edge[kind, parent, child] of neighbouring labels.

    Kinds of child: elements, texts, and elements that are part of their parent (list items, cells and the like).
    """

    weight: np.ndarray
    edge: np.ndarray

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Probability that each node is content: sums of products passed up and down all trees at once, by depth."""
        if not pages:
            return np.zeros(0)
        trees = _Trees(pages)
        parent, levels = trees.parent, trees.levels
        kind = np.concatenate([_kinds(p) for p in pages])
        score = np.clip(node_scores(pages, trees, self.weight), -30, 30)
        own = np.stack([-np.logaddexp(0, score), -np.logaddexp(0, -score)], axis=1)
        up, sent = own.copy(), np.zeros_like(own)
        for nodes in reversed(levels[1:]):
            sent[nodes] = np.logaddexp(self.edge[kind[nodes], :, 0] + up[nodes, :1], self.edge[kind[nodes], :, 1] + up[nodes, 1:])
            np.add.at(up, parent[nodes], sent[nodes])
        full = up.copy()
        for nodes in levels[1:]:
            rest = full[parent[nodes]] - sent[nodes]
            full[nodes] += np.logaddexp(self.edge[kind[nodes], 0] + rest[:, :1], self.edge[kind[nodes], 1] + rest[:, 1:])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60)))

    def extract(self, pages: list[Page]) -> list[str]:
        p, out, at = self.marginals(pages), [], 0
        for page in pages:
            out.append("\n".join(t for i, t in enumerate(page.text) if t is not None and p[at + i] >= 0.5))
            at += len(page.tag)
        return out


class _Layouts:
    """Pages made up in seven layouts that share no structure; \x01 marks what is content."""

    def __init__(self, r: random.Random):
        self.r = r
        part = lambda: r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"])
        self.words = ["".join(part() for _ in range(r.randint(1, 4))) for _ in range(3000)]

    def prose(self, low: int, high: int) -> str:
        r = self.r
        words, comma = r.choices(self.words, k=r.randint(low, high)), r.choice([0.0, 0.05, 0.12])
        if comma:
            words = [w + "," if r.random() < comma else w for w in words[:-1]] + words[-1:]
        body = " ".join(words)
        return body.capitalize() + r.choice([".", ".", ".", "", "", "!", "?", ":"])

    def many(self, low: int, high: int, make) -> str:
        return "".join(make() for _ in range(self.r.randint(low, high)))

    def named(self, tag: str, inner: str, *names: str, bare: float = 0.0) -> str:
        if not names or self.r.random() < bare:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}">{inner}</{tag}>'

    def link(self, low: int = 1, high: int = 4) -> str:
        return f"<a href='/{self.r.randint(1, 99)}'>{self.prose(low, high)}</a>"

    def links(self, low: int = 3, high: int = 8) -> str:
        wrap = self.r.choice(["<li>{}</li>", "<li>{}</li>", "<li>{}", "<span>{}</span> | ", "{} &middot; ", "<div>{}</div>"])
        inner = self.many(low, high, lambda: wrap.format(self.link(1, 3)))
        return f"<ul>{inner}</ul>" if "li" in wrap else inner

    def mark(self, low: int, high: int) -> str:
        return f"\x01{self.prose(low, high)}\x01"

    def sentence(self) -> str:
        return self.mark(*self.r.choice([(1, 4), (4, 20), (10, 60), (30, 150)]))

    def block(self) -> str:
        """A block of an article: paragraphs, headings, lists (of links too), quotes, tables, figures, fallbacks."""
        t, r = self.sentence, self.r
        return r.choice([
            lambda: f"<p>{t()}</p>", lambda: f"<p>{t()}</p>", lambda: f"<p>{t()}</p>", lambda: f"<p>{t()}</p>", lambda: f"<p>{t()}<p>{t()}", lambda: f"<p><strong>{t()}</strong></p>",
            lambda: f"<p><em>{t()}<br>{t()}</em><p>{t()}</p>", lambda: f"<h{(k := r.randint(2, 4))}>{self.mark(1, 9)}</h{k}>", lambda: f"<p>{t()} <a href='z'>{self.mark(1, 5)}</a> {t()}</p>",
            lambda: f"<p><a href='z'>{t()}</a></p>", lambda: f"<a href='z'>{r.choice([f'<div>{t()}</div>', f'<p>{t()}</p>'])}</a>", lambda: f"<div><span>{t()}</span></div>", lambda: f"<ul>{self.many(2, 6, lambda: f'<li>{t()}</li>')}</ul>", lambda: f"<ol>{self.many(2, 6, lambda: f'<li>{self.mark(2, 25)}')}</ol>",
            lambda: f"<ul>{self.many(2, 5, lambda: f'<li><a href=y>{self.mark(1, 6)}</a>')}</ul>", lambda: f"<p>{self.mark(2, 9)}</p><ul>{self.many(2, 5, lambda: f'<li><a href=y>{self.mark(1, 6)}</a></li>')}</ul>",
            lambda: f"<blockquote>{r.choice([t(), f'<p>{t()}</p>'])}</blockquote>", lambda: f"<div>{t()}</div>", lambda: f"<pre>{t()}</pre>", lambda: f"<xmp>{t()}</xmp>",
            lambda: f"<table>{self.many(1, 4, lambda: f'<tr><td>{self.mark(1, 6)}</td><td>{self.mark(1, 12)}</td></tr>')}</table>", lambda: f"<figure><img src=i><figcaption>{self.mark(2, 20)}</figcaption></figure>",
            lambda: f"<dl><dt>{self.mark(1, 3)}<dd>{t()}</dl>", lambda: f"<section><h3>{self.mark(1, 6)}</h3>{self.many(1, 3, lambda: f'<p>{t()}</p>')}</section>", lambda: f"<noscript><p>{t()}</p></noscript>",
            lambda: f"<object data=x><p>{t()}</p></object>", lambda: f"<details><summary>{self.mark(1, 6)}</summary><p>{t()}</p></details>", t,
        ])()

    def blocks(self, low: int = 1, high: int = 10) -> str:
        return self.many(low, high, lambda: self.block() + (self.inset() if self.r.random() < 0.1 else ""))

    def title(self) -> str:
        return self.r.choice([f"<h1>{self.mark(2, 12)}</h1>", f"<h1>{self.mark(2, 12)}</h1>", f"<header><h1>{self.mark(2, 10)}</h1></header>", f"<h2>{self.mark(2, 10)}</h2>", ""])

    def inset(self) -> str:
        """What stands in the way inside an article."""
        p = self.prose
        return self.r.choice([
            lambda: self.named(self.r.choice(["div", "aside", "ins"]), self.r.choice([p(2, 30), f"<p>{p(2, 30)}</p>", self.link(2, 9)]), "ad", "ads", "ad-slot", "advertisement", "sponsored", "promo", "banner"),
            lambda: f"<aside>{self.r.choice([p(3, 40), f'<h3>{p(1, 4)}</h3>{self.links()}'])}</aside>", lambda: self.named("div", self.links(2, 5), "share", "social", "share-buttons", "toolbar", "tags"),
            lambda: self.named("div", f"<h4>{p(1, 4)}</h4>{self.links(2, 5)}", "related", "more-links", "recommended", "related-posts"),
            lambda: self.named("div", f"<p>{p(3, 25)}</p><form><input name=e><button>{p(1, 2)}</button></form>", "newsletter", "signup", "subscribe"), lambda: f"<form><label>{p(1, 3)}</label><select><option>{p(1, 2)}<option>{p(1, 2)}</select><button>{p(1, 2)}</button></form>",
            lambda: f"<template><p>{p(2, 12)}</p></template>", lambda: f"<video controls>{p(4, 9)}</video>", lambda: f"<script>var x = '<p>{p(2, 5)}</p>';</script>", lambda: f"<button>{p(1, 3)}</button>",
        ])()

    def notice(self) -> str:
        p = self.prose
        return self.r.choice([
            lambda: self.named(self.r.choice(["div", "section", "aside", "dialog"]), f"<p>{p(3, 50)}</p>" + self.r.choice(["", f"<button>{p(1, 2)}</button>"]), "cookie", "cookie-banner", "cookie-notice", "consent", "gdpr-notice", "privacy-notice", "alert", "popup", "modal", "overlay"),
            lambda: f"<noscript>{p(4, 14)}</noscript>", lambda: f"<a class='skip-link' href='#c'>{p(2, 4)}</a>", lambda: "",
        ])()

    def comments(self) -> str:
        p = self.prose
        one = self.r.choice(["<div class='comment'><p>{}</p></div>", "<article class='comment'><b>{}</b><p>{}</p></article>", "<p>{}</p>", "<li class='comment'>{}</li>", "<div><span>{}</span><p>{}</p></div>"])
        inner = self.r.choice(["", f"<h3>{p(1, 3)}</h3>"]) + self.many(1, 6, lambda: one.format(p(1, 60), p(3, 60)))
        return self.named(self.r.choice(["section", "div", "div", "ol", "ul"]), inner, "comments", "comment-list", "reader-comments", "replies", "discussion", "responses", "respond")

    def end(self) -> str:
        p = self.prose
        return self.r.choice([f"&copy; {p(1, 4)} &middot; {p(2, 12)}", self.links() + p(2, 12), f"<p>{p(3, 40)}</p>", f"<p>&copy; {p(2, 30)}</p>", p(2, 25)])

    def semantic(self) -> str:
        p, pick = self.prose, self.r.choice
        head = pick([f"<header><a href='/'>{p(1, 3)}</a>{pick(['', self.links(), f'<p>{p(2, 9)}</p>'])}</header>", "", f"<header>{p(1, 6)}</header>"])
        nav = pick([f"<nav>{self.links()}</nav>", f"<nav>{p(1, 8)}</nav>", ""])
        inner = f"<article>{self.title()}{self.blocks()}</article>"
        inner = pick([inner, f"<main>{inner}{pick(['', f'<aside>{self.links()}</aside>'])}</main>", f"<main>{self.title()}{self.blocks()}</main>"])
        return head + nav + self.notice() + pick(["", self.inset()]) + inner + pick(["", f"<aside>{p(3, 40)}</aside>", f"<aside><h3>{p(1, 3)}</h3>{self.links()}</aside>"]) + pick(["", self.comments()]) + f"<footer>{self.end()}</footer>"

    def blog(self) -> str:
        p, pick, n = self.prose, self.r.choice, self.named
        head = n("div", f"<h1><a href='/'>{p(1, 4)}</a></h1><p>{p(2, 9)}</p>", "header", "masthead", "site-header") + n("div", self.links(), "menu", "nav", "main-menu", "navbar")
        post = n("div", self.title() + pick(["", n("div", p(1, 6), "user", "avatar")]) + n("div", self.blocks(), "entry-content", "post-body", "entry", bare=0.1), "post", "entry", "content", "hentry post")
        side = n("div", self.many(1, 4, lambda: n("div", f"<h3>{p(1, 3)}</h3>" + pick([self.links(), f"<p>{p(5, 60)}</p>"]), "widget", bare=0.2)), "sidebar", "side", "right-side")
        body = pick([post + self.comments() + side, side + post, post + side + self.comments()])
        return head + n("div", body, "wrapper", "container", "page", bare=0.3) + self.notice() + n("div", self.end(), "footer", "site-footer", "copyright")

    def news(self) -> str:
        p, pick, n = self.prose, self.r.choice, self.named
        top = n("section", self.links(), "top-nav", "topbar nav", "breadcrumbs") + n("div", f"<form><input name=q><button>{p(1, 1)}</button></form>", "search")
        story = n("section", f"<h1>{self.mark(3, 14)}</h1>" + n("p", self.mark(6, 30), "lead", "summary", bare=0.5) + n("div", self.blocks(2, 12), "article-body", "story-text", "body-text", "text"), "story", "article", "article-wrapper")
        rest = self.many(0, 3, lambda: pick([self.inset, self.comments, lambda: n("section", f"<h2>{p(1, 4)}</h2>" + self.many(2, 5, lambda: f"<div>{self.link(3, 12)}<p>{p(4, 25)}</p></div>"), "related", "recommended", "more-stories")])())
        return self.notice() + top + pick(["", self.inset()]) + pick([story, n("div", story, "page", "container")]) + rest + n("section", self.end(), "footer", "legal", "copyright")

    def tables(self) -> str:
        p, pick = self.prose, self.r.choice
        text = self.many(2, 7, lambda: pick([f"<font size=2>{self.sentence()}</font><br><br>", f"<p>{self.sentence()}", f"<b>{self.mark(1, 6)}</b><p>{self.sentence()}</p>", f"<center><h2>{self.mark(1, 7)}</h2></center>", f"<div align=left>{self.sentence()}</div>"]))
        nav = self.many(3, 9, lambda: pick([f"{self.link(1, 3)}<br>", f"<tr><td>{self.link(1, 3)}</td></tr>"]))
        nav = f"<table>{nav}</table>" if "<tr>" in nav else nav
        bar = pick([f"<tr><td colspan=2>{self.links(3, 6)}</td></tr>", f"<tr><td><a href=/>{p(1, 3)}</a></td></tr>", ""])
        return f"<table width=100%>{bar}<tr><td valign=top>{nav}</td><td>{text}</td></tr><tr><td colspan=2>&copy; {p(1, 6)}{pick(['', ' | ' + self.link()])}</td></tr></table>"

    def docs(self) -> str:
        p, pick, n = self.prose, self.r.choice, self.named
        tree = "<ul>" + self.many(2, 4, lambda: f"<li>{self.link(1, 3)}<ul>{self.many(1, 4, lambda: f'<li>{self.link(1, 3)}</li>')}</ul></li>") + "</ul>"
        main = n(pick(["div", "main"]), n("div", self.links(2, 4), "breadcrumb", "breadcrumbs") + self.title() + n("div", self.links(2, 6), "toc", "page-toc") + self.blocks(2, 12) + n("div", self.link() + self.link(), "pagination", "pager"), "content", "main-content", "main", "document body", bare=0.1)
        return n(pick(["div", "nav", "aside"]), f"<form><input name=q></form>{tree}", "sidebar", "side-nav", "menu") + main + n(pick(["div", "footer"]), self.end(), "footer", bare=0.1)

    def plain(self) -> str:
        p, pick, n = self.prose, self.r.choice, self.named
        core = n("div", self.title() + self.blocks(1, 6), "main", "content", "text", "page", bare=0.4)
        core = pick([core, f"<div>{core}</div>", f"<object>{core}</object>", f"<center>{core}</center>"])
        return pick(["", f"<ul>{self.many(3, 6, lambda: f'<li>{self.link(1, 2)}')}</ul>", n("div", self.links(), "nav", "menu")]) + pick(["", self.notice()]) + core + pick(["", self.comments()]) + pick(["", f"<hr><address>{p(2, 12)}</address>", f"<footer>{self.end()}</footer>", n("p", f"&copy; {p(1, 9)}", "copyright", "footer", bare=0.3)])

    def bare(self) -> str:
        """An article with little or nothing around it, short ones above all."""
        p, pick, n = self.prose, self.r.choice, self.named
        size = pick([(1, 3), (2, 9), (6, 30), (6, 30), (20, 90)])
        block = pick(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<div><span>{}</span></div>", "<p>{}", "{}<br><br>", "<blockquote>{}</blockquote>"])
        inner = pick(["", "", f"<h1>{self.mark(1, 8)}</h1>"]) + self.many(1, 6, lambda: block.format(self.mark(*size)))
        for _ in range(self.r.randint(0, 3)):
            inner = f"<{(t := pick(['div', 'div', 'section', 'article', 'main']))}>{inner}</{t}>"
        return pick(["", "", "", f"<nav>{self.links()}</nav>"]) + inner + pick(["", "", "", f"<footer>{self.end()}</footer>", self.notice()])

    def page(self, layout: str) -> str:
        """A whole page; names on body and on what wraps it tell of the page's state, not of its text."""
        r, body = self.r, getattr(self, layout)()
        states = ["has-sidebar", "right-sidebar", "no-comments", "header-sticky", "footer-dark", "nav-open", "single-post", "page-template", "with-banner", "cookie-accepted", "social-enabled", "search-results-off", "home"]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = f'<div class="{" ".join(r.sample(states, r.randint(1, 2)))}">{body}</div>'
        own = f' class="{" ".join(r.sample(states, r.randint(1, 4)))}"' if r.random() < 0.5 else ""
        return f"<html><head><title>{self.prose(1, 6)}</title></head><body{own}>{body}</body></html>"


LAYOUTS = ("semantic", "blog", "news", "tables", "docs", "plain", "bare")


def labelled_pages(count: int = 980, seed: int = 8, layouts: tuple[str, ...] = LAYOUTS) -> list[tuple[Page, list[int]]]:
    """Pages made up in these layouts in turn, each node labelled: 1 content, 0 not. The same ones for each seed.

    Labels come from how a page is put together: what stands between private marks in its blocks' text is content,
    and so is an element that holds more content than other blocks.
    """
    make, out = _Layouts(random.Random(seed)), []
    for k in range(count):
        page = parse_page(make.page(layouts[k % len(layouts)]))
        gain = [0] * len(page.tag)
        for i in range(len(gain) - 1, -1, -1):
            if page.text[i] is not None:
                gain[i] = 1 if "\x01" in page.text[i] else -1
                page.text[i] = page.text[i].replace("\x01", "") or "x"
                page.linked[i] = min(page.linked[i], len(page.text[i]))
            if page.parent[i] >= 0:
                gain[page.parent[i]] += gain[i]
        out.append((page, [int(g > 0) for g in gain]))
    return out


@cache
def default_model() -> TreeModel:
    """The model of labelled_pages' pages, trained once in a process."""
    return train_tree_model(labelled_pages())


def train_tree_model(pages: list[tuple[Page, list[int]]], steps: int = 25, ridge: float = 2.0, trust: float = 0.5) -> TreeModel:
    """Potentials learnt from labelled pages: node weights by regularised logistic regression (Newton steps), edge
    potentials by counting label pairs, over what the labels' own frequencies give. Nodes see their surroundings too, so
    the edges' potentials are trusted by half, lest the same evidence count twice."""
    x = node_features([p for p, _ in pages]).astype(np.float64)
    y = np.array([v for _, label in pages for v in label], np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    edge = np.ones((3, 2, 2))
    for page, label in pages:
        for k, up, own in zip(_kinds(page), page.parent, label, strict=True):
            if up >= 0:
                edge[k, label[up], own] += 1
    edge /= edge.sum(axis=2, keepdims=True)
    kinds = np.concatenate([_kinds(p) for p, _ in pages])
    prior = np.array([[1 - (m := y[kinds == k].mean()), m] for k in range(3)])
    return TreeModel(w, trust * (np.log(edge) - np.log(prior)[:, None, :]))


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """pages (html and others) with text, the main text of each page, and n_chars, its code points; no shuffle.

    Null and empty pages, and pages without content, give the empty text; columns of these names are replaced;
    repeated rows are read each on its own; an empty table stays empty.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    d = pages.select(*keep)
    shared = d.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            few: list[Page] = []
            for i in range(b.num_rows):  # runs of pages by nodes, so that pages of any size pass
                few.append(parse_page(b.column("html")[i].as_py()))
                if i + 1 == b.num_rows or sum(len(p.tag) for p in few) >= RUN_NODES:
                    out += shared.value.extract(few)
                    few = []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, "text", "n_chars"])

    return d.mapInArrow(run, with_fields(d.schema, text="string", n_chars="bigint"))


def op8_html_extraction(pages: DataFrame) -> DataFrame:
    """The digest of extract_text: one row per page."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
