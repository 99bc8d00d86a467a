"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each element of a page has a hidden label, content or not. Its own features (tag, class and id words, text length and share
of the page, link share, punctuation, the part of the page that it lies in) give node potentials; each parent-child edge has a potential that depends on both labels and on the
child's kind of tag. Sum-product messages, upward from the leaves and downward from the root, give each element's
content marginal exactly, as the graph is a tree. An element's own text is kept if its marginal is 0.5 or more.

The model is trained from labelled pages by gradient steps on the conditional likelihood, whose gradient is the
features' observed minus expected counts under the same messages. The labelled pages are made by
:func:`labelled_pages`: a fixed number of random layouts, with semantic tags or with plain blocks named by class,
whose parts are known. The model has a few hundred weights and is broadcast. Pages are handled one by one, each whole,
in the task that reads them; nothing is shuffled.

Defined cases: null and empty html give an empty text; unclosed and stray tags are repaired as browsers do; a tag that the
page's end cuts off, and an unclosed comment or script, go; a quote without a second one belongs to a value that ends with its
tag; pages of any length or depth take time in proportion to their length; text outside any tag counts as the body's own;
formulas and titles inside the body are text like other text; repeated rows are handled each; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME_WORD = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without an end tag, with raw text, and those that make blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_KINDS = {t: k for k, tags in enumerate(("nav menu", "header", "footer", "aside", "form button select fieldset", "article main", "div section", "ul ol li dl dt dd", "a"), 1) for t in tags.split()}


class Page(NamedTuple):
    """Elements in document order: tag, parent, names (class, id and role words), and the texts with the element and block of each."""

    tags: list[str]
    parents: list[int]
    names: list[tuple[str, ...]]
    texts: list[tuple[int, int, str]]


#: Elements that make parts of a page; what lies in one has it as its part.
PARTS = frozenset("article main nav aside header footer form".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_BEFORE_ATTRIBUTE = re.compile(r"[\s/]*+")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_UNQUOTED = re.compile(r"[^\s>]++")


class _Scanner:
    """Tokens of a page, each character passed over a fixed number of times, whatever the page."""

    def __init__(self, html: str):
        self.html, self.end, self.none = html, len(html), set()

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, or -1; what isn't found once is not looked for again."""
        if what in self.none:
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.none.add(what)
        return found

    def past(self, what: str, at: int) -> int:
        return self.end if (found := self.find(what, at)) < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str | None]], bool]:
        """From behind a tag's name: (where the tag ends, or -1, its attributes, whether a slash ends it). A quote opens a value only after an equals sign; without a second one the value ends where the tag does."""
        html, found = self.html, []
        while True:
            begin, at = at, _BEFORE_ATTRIBUTE.match(html, at).end()
            if at >= self.end:
                return -1, found, False
            if html[at] == ">":
                return at + 1, found, html[at - 1] == "/" and at > begin
            m = _ATTRIBUTE_NAME.match(html, at)
            name, at, value = m[0].lower(), m.end(), None
            if eq := _EQUALS.match(html, at):
                at = eq.end()
                quote = html[at : at + 1]
                if quote and quote in "\"'" and (shut := self.find(quote, at + 1)) >= 0:
                    value, at = html[at + 1 : shut], shut + 1
                elif m := _UNQUOTED.match(html, at):
                    value, at = m[0], m.end()
            found.append((name, value))


def _words_of(attributes: list[tuple[str, str | None]]) -> tuple[str, ...]:
    """The words of class, id and role, and ``hidden`` if the attributes hide the element."""
    words: list[str] = []
    for key, value in attributes:
        if key == "hidden":
            words.append("hidden")
        elif not value:
            continue
        elif key in ("class", "id", "role"):
            words += _NAME_WORD.findall(value.lower())
        elif key == "style" and re.search(r"display\s*:\s*none", value) or key == "aria-hidden" and value.lower() == "true":
            words.append("hidden")
    return tuple(dict.fromkeys(words))


class _Tree:
    """The elements so far and those that are open, by depth and by tag."""

    def __init__(self):
        self.tags, self.parents, self.names, self.texts = ["html"], [-1], [()], []
        self.stack, self.depths, self.block = [0], {}, 0

    def text(self, part: str) -> None:
        if part and not (part.isspace() and not self.texts):
            self.texts.append((self.stack[-1], self.block, part))

    def add(self, tag: str, words: tuple[str, ...], stays: bool) -> None:
        self.tags.append(tag), self.parents.append(self.stack[-1]), self.names.append(words)
        if stays:
            self.depths.setdefault(tag, []).append(len(self.stack))
            self.stack.append(len(self.tags) - 1)

    def depth(self, tags) -> int:
        """The depth of the innermost open element of these tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close(self, depth: int) -> None:
        """End the open elements from this depth on."""
        for element in self.stack[depth:]:
            self.depths[self.tags[element]].pop()
        del self.stack[depth:]

    def close_implied(self, tag: str) -> None:
        """Ends that a block's start implies: of an open paragraph, or of the item before."""
        ends, within = CLOSES.get(tag, _PARAGRAPH)
        if (depth := self.depth(ends)) > self.depth(within):
            self.close(depth)


_PARAGRAPH = (("p",), ("td", "th", "li", "div", "article", "section", "body", "blockquote", "button", "aside", "nav", "header", "footer", "main", "form"))


def parse(html: str) -> Page:
    """The tree of a page, in time linear in its length."""
    scan, tree, at = _Scanner(html), _Tree(), 0
    while at < scan.end:
        if (lt := scan.find("<", at)) < 0:
            tree.text(html[at:])
            break
        closing = html.startswith("</", lt)
        m = _TAG_NAME.match(html, lt + 1 + closing)
        if not m:
            mark = html[lt + 1 : lt + 2]
            if not (closing or mark and mark in "!?"):
                tree.text(html[at : lt + 1])
                at = lt + 1
                continue
            tree.text(html[at:lt])
            if html.startswith("<!--", lt):
                at = scan.past("-->", lt + 2)
            elif html.startswith("<![CDATA[", lt) and (shut := scan.find("]]>", lt)) >= 0:
                tree.text(html[lt + 9 : shut])
                at = shut + 3
            else:
                at = scan.past(">", lt)
            continue
        tree.text(html[at:lt])
        at, attributes, slash = scan.attributes(m.end())
        if at < 0:  # the page ends within a tag
            break
        tag = m[0].lower()
        if closing:
            tree.block += tag in BLOCK
            if depth := tree.depth((tag,)):
                tree.close(depth)
        elif tag in RAW and not (tag == "title" and len(tree.stack) > 1):
            at = at if slash else _behind(scan, tag, at)
        elif tag == "br":
            tree.text(" ")
        else:
            if tag in BLOCK:
                tree.block += 1
                if tag not in ("html", "body"):
                    tree.close_implied(tag)
            if tag not in VOID and tag not in ("html", "head"):
                tree.add(tag, _words_of(attributes), not slash or tag in BLOCK)
    return Page(tree.tags, tree.parents, tree.names, tree.texts)


_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)


def _behind(scan: _Scanner, tag: str, at: int) -> int:
    """Where the raw text of an element ends, its end tag included. In a script's comment, scripts nest once."""
    if tag != "script":
        shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(scan.html, at)
        return scan.past(">", shut.end()) if shut else scan.end
    comment = inner = False
    while m := _SCRIPT.search(scan.html, at):
        at = m.end()
        if m[0] == "<!--":
            comment, at = True, at - 2  # its dashes may end it, too
        elif m[0] == "-->":
            comment = inner = False
        elif not m[1]:
            inner = comment
        elif inner:
            inner = False
        else:
            return scan.past(">", at)
    return scan.end


def _bucket(x: float) -> int:
    return min(int(math.log2(1 + x)), 12)


def features(page: Page) -> list[list[str]]:
    """The feature names of each element."""
    n = len(page.tags)
    size, linked, stops, own = [0] * n, [0] * n, [0] * n, [0] * n
    for e, _, t in page.texts:
        k = len(t) - t.count(" ")
        size[e] += k
        own[e] += k
        stops[e] += t.count(".") + t.count(",")
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        size[p] += size[i]
        linked[p] += size[i] if page.tags[i] == "a" else linked[i]
        stops[p] += stops[i]
    out, whole, part = [], max(1, size[0]), ["page"] * n
    # Among the children of an element, the one with the most text outside of links.
    told, most = [a - b for a, b in zip(size, linked)], {}
    for i in range(n - 1, 0, -1):
        if told[i] >= told[most.get(page.parents[i], i)]:
            most[page.parents[i]] = i
    for i, tag in enumerate(page.tags):
        s = size[i]
        if i:
            above = page.parents[i]
            part[i] = page.tags[above] if page.tags[above] in PARTS else part[above]
        found = ["bias", f"tag={tag}", f"size={_bucket(s)}", f"own={_bucket(own[i])}", f"links={int(4 * linked[i] / s) if s else 5}", f"stops={_bucket(100 * stops[i] / s) if s else 9}"]
        share = int(5 * s / whole)
        found += [f"share={share}", f"tag={tag} {'most' if share > 2 else 'some' if share else 'little'}", *(f"name={w}" for w in page.names[i])]
        all_links = 2 * linked[i] > s
        first = "first" if not i or most[page.parents[i]] == i else "other"
        found += [f"{first} told={int(5 * told[i] / max(1, told[0]))}", f"tag={tag} {first}"]
        found += [f"tag={tag} in={part[i]}", f"in={part[i]} {'links' if all_links else 'text'}", f"tag={tag} {'links' if all_links else 'text'} {_bucket(s)}"]
        out.append(found)
    return out


class Model(NamedTuple):
    """Weights of the features, and log potentials [kind of the child, parent's label, child's label]."""

    weights: dict[str, float]
    edges: list[list[list[float]]]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def messages(parents: list[int], kinds: list[int], unary: list[float], edges) -> tuple[list[float], list[list[list[float]]]]:
    """Content marginals of all nodes, and the pair marginals [parent's label][child's label] of each node with its parent.

    ``unary`` is the log odds of a node by itself. Parents precede their children.
    """
    n = len(parents)
    up0, up1 = [0.0] * n, list(unary)  # log weight of a node's subtree, by its label
    to0, to1 = [0.0] * n, [0.0] * n  # message of a node to its parent
    for i in range(n - 1, 0, -1):
        e = edges[kinds[i]]
        to0[i] = _log_add(e[0][0] + up0[i], e[0][1] + up1[i])
        to1[i] = _log_add(e[1][0] + up0[i], e[1][1] + up1[i])
        p = parents[i]
        up0[p] += to0[i]
        up1[p] += to1[i]
    down0, down1 = [0.0] * n, [0.0] * n  # message from the parent
    marginal, pairs = [0.0] * n, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
    for i in range(n):
        if i:
            p, e = parents[i], edges[kinds[i]]
            a0 = up0[p] + down0[p] - to0[i]
            a1 = up1[p] + down1[p] - to1[i]
            down0[i], down1[i] = _log_add(a0 + e[0][0], a1 + e[1][0]), _log_add(a0 + e[0][1], a1 + e[1][1])
            cells = [[a0 + e[0][0] + up0[i], a0 + e[0][1] + up1[i]], [a1 + e[1][0] + up0[i], a1 + e[1][1] + up1[i]]]
            top = max(max(c) for c in cells)
            weights = [[math.exp(x - top) for x in c] for c in cells]
            total = sum(map(sum, weights))
            pairs[i] = [[x / total for x in c] for c in weights]
        gap = up1[i] + down1[i] - up0[i] - down0[i]
        marginal[i] = 1.0 / (1.0 + math.exp(-gap)) if gap > -700 else 0.0
        shift = max(down0[i], down1[i])
        down0[i] -= shift
        down1[i] -= shift
    return marginal, pairs


def _unary(found: list[list[str]], weights: dict[str, float]) -> list[float]:
    get = weights.get
    return [sum([get(f, 0.0) for f in fs]) for fs in found]


def forest_messages(parents: np.ndarray, levels: list[np.ndarray], kinds: np.ndarray, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`messages` gives, for many trees at once: ``levels`` has the nodes by depth, roots first."""
    up0, up1 = np.zeros(len(unary)), unary.copy()
    to0, to1 = np.zeros(len(unary)), np.zeros(len(unary))
    e = edges[kinds]
    for nodes in reversed(levels[1:]):
        to0[nodes] = np.logaddexp(e[nodes, 0, 0] + up0[nodes], e[nodes, 0, 1] + up1[nodes])
        to1[nodes] = np.logaddexp(e[nodes, 1, 0] + up0[nodes], e[nodes, 1, 1] + up1[nodes])
        np.add.at(up0, parents[nodes], to0[nodes])
        np.add.at(up1, parents[nodes], to1[nodes])
    down0, down1, pairs = np.zeros(len(unary)), np.zeros(len(unary)), np.zeros((len(unary), 2, 2))
    for nodes in levels[1:]:
        p = parents[nodes]
        a = np.stack([up0[p] + down0[p] - to0[nodes], up1[p] + down1[p] - to1[nodes]], axis=1)
        sent = a[:, :, None] + e[nodes]
        cells = sent + np.stack([up0[nodes], up1[nodes]], axis=1)[:, None, :]
        weights = np.exp(cells - cells.max(axis=(1, 2), keepdims=True))
        pairs[nodes] = weights / weights.sum(axis=(1, 2), keepdims=True)
        both = np.logaddexp(sent[:, 0, :], sent[:, 1, :])
        both -= both.max(axis=1, keepdims=True)
        down0[nodes], down1[nodes] = both[:, 0], both[:, 1]
    return 1 / (1 + np.exp(-np.clip(up1 + down1 - up0 - down0, -700, 700))), pairs


def train(pages: list[tuple[str, list[int]]], epochs: int = 250, rate: float = 0.3, penalty: float = 3e-4) -> Model:
    """Fit to pages with the label of each element."""
    names: dict[str, int] = {}
    parents, depths, kinds, labels, ids, sizes = [], [], [], [], [], []
    for html, page_labels in pages:
        page, base = parse(html), len(parents)
        for i, found in enumerate(features(page)):
            above = page.parents[i]
            parents.append(above + base if i else -1)
            depths.append(depths[above + base] + 1 if i else 0)
            ids += [names.setdefault(f, len(names)) for f in found]
            sizes.append(len(found))
        kinds += [_KINDS.get(t, 0) for t in page.tags]
        labels += page_labels
    parents, depths, kinds, labels, ids, sizes = (np.array(x) for x in (parents, depths, kinds, labels, ids, sizes))
    levels = [np.flatnonzero(depths == d) for d in range(depths.max() + 1)]
    inner, starts = depths > 0, np.cumsum(sizes) - sizes
    weights, edges = np.zeros(len(names)), np.zeros((len(set(_KINDS.values())) + 1, 2, 2))
    squares, edge_squares, seen = np.full(len(names), 1e-3), np.full(edges.shape, 1e-3), np.zeros(edges.shape)
    np.add.at(seen, (kinds[inner], labels[parents[inner]], labels[inner]), 1)
    for _ in range(epochs):
        marginal, pairs = forest_messages(parents, levels, kinds, np.add.reduceat(weights[ids], starts), edges)
        g = np.bincount(ids, np.repeat(labels - marginal, sizes), len(names)) / len(pages) - penalty * weights
        expected = np.zeros(edges.shape)
        np.add.at(expected, kinds[inner], pairs[inner])
        edge_g = (seen - expected) / len(pages) - penalty * edges
        squares += g * g
        edge_squares += edge_g * edge_g
        weights += rate * g / np.sqrt(squares)
        edges += rate * edge_g / np.sqrt(edge_squares)
    return Model(dict(zip(names, weights.tolist())), edges.tolist())


def labelled_pages(n: int = 480, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of random layouts with a label for each element that :func:`parse` finds."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(2, 14).capitalize() + rng.choice((".", ".", ", " + words(2, 6) + ".")) for _ in range(rng.randint(a, b)))

    def el(tag: str, label: int, *inner, name: str = "") -> tuple:
        return tag, label, name, inner

    def links(k: int) -> list:
        return [el("li", 0, el("a", 0, words(1, 3))) for _ in range(k)]

    plain = [False]  # whether this page's blocks have names that tell nothing, or none

    def named(tag: str, choices: str) -> dict:
        if plain[0]:
            return {"name": words(1, 1)} if rng.random() < 0.4 else {}
        return {"name": rng.choice(choices.split())} if tag == "div" or rng.random() < 0.4 else {}

    def boiler(kind: str) -> tuple:
        some = rng.randint(2, 8)
        if kind == "nav":
            t = rng.choice(("nav", "div", "nav"))
            return el(t, 0, el("ul", 0, *links(some)), **named(t, "nav menu navbar navigation breadcrumb"))
        if kind == "header":
            t = rng.choice(("header", "div"))
            return el(t, 0, el(rng.choice(("h1", "p", "span", "a")), 0, words(1, 4)), *([el("nav", 0, el("ul", 0, *links(3)))] if rng.random() < 0.5 else []), **named(t, "header masthead topbar banner"))
        if kind == "footer":
            t = rng.choice(("footer", "footer", "div"))
            body = rng.choice((["&copy; " + words(1, 3) + " &middot; " + prose(0, 1)], [el("p", 0, words(2, 8))], [el("a", 0, words(1, 2)), el("a", 0, words(1, 2))]))
            return el(t, 0, *body, **named(t, "footer bottom copyright legal"))
        if kind == "aside":
            t = rng.choice(("aside", "div"))
            inner = rng.choice(([el("h3", 0, words(1, 3)), el("ul", 0, *links(some))], [el("p", 0, prose(1, 3))], [el("p", 0, el("a", 0, words(2, 5)))]))
            return el(t, 0, *inner, **named(t, "sidebar aside related widget rail recommended"))
        if kind == "ad":
            return el(rng.choice(("div", "div", "section", "aside")), 0, rng.choice((prose(1, 2), el("p", 0, prose(1, 2)), el("a", 0, words(2, 6)))), name=rng.choice("ad ads advert advertisement sponsored promo banner".split()))
        if kind == "notice":
            return el("div", 0, rng.choice((prose(1, 2), el("p", 0, prose(1, 2)))), *([el("button", 0, words(1, 2))] if rng.random() < 0.5 else []), name=rng.choice("cookie notice consent popup alert newsletter gdpr modal".split()))
        if kind == "hidden":
            return el("div", 0, rng.choice((prose(1, 3), el("p", 0, prose(1, 4)))), name="hidden")
        if kind == "form":
            return el("form", 0, el("label", 0, words(1, 3)), el("button", 0, words(1, 2)), *([el("p", 0, prose(1, 1))] if rng.random() < 0.5 else []))
        if kind == "share":
            return el("div", 0, *[el("a", 0, words(1, 1)) for _ in range(3)], name=rng.choice("share social tools tags".split()))
        t = rng.choice(("section", "div"))
        shape = rng.choice(("div", "li", "article"))
        each = [el(shape, 0, el("p", 0, prose(1, 4)), **({"name": "comment"} if rng.random() < 0.7 else {})) for _ in range(rng.randint(1, 5))]
        return el(t, 0, el(rng.choice(("h2", "h3")), 0, words(1, 2)), *([el("ul", 0, *each)] if shape == "li" else each), name=rng.choice("comments discussion responses replies".split()))

    def article() -> tuple:
        # Poor prose is content too: shouted, without stops, or one word again and again.
        style = rng.choice(("plain",) * 5 + ("shout", "bare", "repeat"))

        def styled(a: int, b: int) -> str:
            if style == "plain":
                return prose(a, b)
            if style == "repeat":
                return " ".join([words(1, 1)] * rng.randint(5, 60))
            return words(5 * a, 14 * b).upper().replace(" ", "!! ") if style == "shout" else words(5 * a, 14 * b)

        short = rng.random() < 0.35
        inner = [el(rng.choice(("h1", "h1", "h2")), 1, words(1, 10))] if rng.random() < 0.9 else []
        if inner and rng.random() < 0.2:  # a header of the article's own
            inner = [el("header", 1, *inner, *([el("p", 1, prose(1, 1))] if rng.random() < 0.3 else []))]
        block = rng.choice(("p",) * 5 + ("div",) * (4 if plain[0] else 1))
        for _ in range(rng.choice((1, 2, 3) if short else (1, 2, 4, 8, 14))):
            k = rng.random()
            if k < 0.66:
                inline = [styled(1, 1 if short else 7)]
                while rng.random() < 0.3:
                    inline.insert(rng.randint(0, len(inline)), el(rng.choice(("b", "i", "em", "strong", "a", "span", "code", "sub", "q")), 1, words(1, 8) + rng.choice(("", "."))))
                if rng.random() < 0.05:
                    inline.append(el("math", 1, el("mi", 1, words(1, 1)), "=", el("mi", 1, words(1, 1))))
                if rng.random() < 0.07:  # all of it is a link or a span
                    inline = [el(rng.choice(("a", "span")), 1, prose(1, 1) if rng.random() < 0.7 else words(5, 12))]
                inner.append(el(block, 1, *inline, **({"name": words(1, 1)} if block == "div" and rng.random() < 0.2 else {})))
            elif k < 0.74:
                inner.append(el(rng.choice(("h2", "h3", "h4")), 1, words(1, 7)))
            elif k < 0.79:
                inner.append(el("blockquote", 1, el("p", 1, styled(1, 3))))
            elif k < 0.86:
                inner.append(el(rng.choice(("ul", "ol")), 1, *[el("li", 1, words(2, 12)) for _ in range(rng.randint(2, 5))]))
            elif k < 0.88:
                inner.append(el("figure", 1, el("figcaption", 1, words(2, 12))))
            elif k < 0.9:
                inner.append(el("table", 1, *[el("tr", 1, *[el("td", 1, words(1, 4)) for _ in range(3)]) for _ in range(2)]))
            elif k < 0.98:
                inner.append(boiler(rng.choice(("ad", "ad", "share", "aside", "form"))))
            else:
                inner.append(el("pre", 1, words(4, 20)))
        if rng.random() < 0.06:
            inner.append(el("footer", 0, el("p", 0, words(1, 4)), el("a", 0, words(1, 2))))
        if rng.random() < 0.12 and len(inner) > 2:  # sections inside
            at = rng.randint(1, len(inner) - 1)
            inner = [*inner[:at], el(rng.choice(("div", "section")), 1, *inner[at:])]
        t = rng.choice(("div", "div", "section", "article", "main") if plain[0] else ("article", "article", "main", "div", "div", "section"))
        return el(t, 1, *inner, **named(t, "content article post entry story main body text page main content"))

    def build(node, out: list[str], labels: list[int]) -> None:
        if isinstance(node, str):
            out.append(node)
            return
        tag, label, name, inner = node
        labels.append(label)
        out.append(f'<{tag} {"id" if len(name) % 2 else "class"}="{name}">' if name else f"<{tag}>")
        for child in inner:
            build(child, out, labels)
        out.append(f"</{tag}>")

    pages = []
    for _ in range(n):
        plain[0] = rng.random() < 0.3
        before = [boiler(k) for k in ("header", "nav", "ad", "notice", "aside", "hidden") if rng.random() < (0.12 if k in ("aside", "hidden") else 0.5)]
        after = [boiler(k) for k in ("comments", "aside", "share", "form", "ad", "footer") if rng.random() < 0.5]
        if rng.random() < 0.5:
            rng.shuffle(before)
        middle = [*before, article(), *after]
        if rng.random() < 0.4:
            side = [boiler("aside")] if rng.random() < 0.3 else []
            middle = [*before, el("div", 1, *side, article(), *after[:2], **({"name": words(1, 1) if plain[0] else rng.choice("wrapper container page layout row".split())} if rng.random() < 0.7 else {})), *after[2:]]
        out, labels = [], [1]
        if rng.random() < 0.1:  # a fragment
            for part in middle:
                build(part, out, labels)
            pages.append(("".join(out), labels))
            continue
        build(el("body", 1, *middle), out, labels)
        pages.append(("<!DOCTYPE html><html><head><title>" + words(2, 8) + "</title></head>" + "".join(out) + "</html>", labels))
    return pages


def resolved(text: str) -> str:
    """Character references decoded. Numbers of any length: leading zeros don't count, and what is no code point is U+FFFD."""
    if "&#" in text:
        text = re.sub(r"&#([xX]?)0++(?=[0-9a-fA-F])", r"&#\1", text)
        text = re.sub(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?", "\ufffd", text)
    return unescape(text)


def extract(html: str, model: Model) -> str:
    """The content blocks of a page, joined by line ends."""
    page = parse(html)
    if not page.texts:
        return ""
    marginal, _ = messages(page.parents, [_KINDS.get(t, 0) for t in page.tags], _unary(features(page), model.weights), model.edges)
    parts, last, out = [], None, []
    for e, block, t in page.texts:
        if marginal[e] < 0.5:
            continue
        if block != last and parts:
            out.append(parts)
            parts = []
        last = block
        parts.append(resolved(t))  # a reference ends where its piece of text does
    out.append(parts)
    lines = (" ".join("".join(p).split()) for p in out)
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, labelled: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; trained on ``labelled``, or on :func:`labelled_pages`."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_pages()))

    def run(frames):
        model = shared.value
        for frame in frames:
            texts = [extract(h, model) for h in frame["html"].fillna("")]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # Ids travel as strings: pandas would turn integers among nulls into floating point.
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
