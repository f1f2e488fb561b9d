"""Main text of web pages by a tree-structured graphical model over their elements.

An element is content or not. Its own features (kind of tag, words of class and id, length of text, links, stops, place)
give a unary potential, and every parent and child share one potential for each kind of child. Sum-product messages go
upward and then downward, level by level for all pages of a block at once, and yield the exact probability that an
element is content; text whose element is more likely content than not stays. The weights maximise the likelihood of
labelled pages: their gradient is what the labels count less what the messages expect.

Labelled pages are `labelled_pages` (made by rule in many layouts, with and without telling tags) and at most `SAMPLE`
pages of the table that mark exactly one article or main element, taken by the hash of their ids; any other table of
(html, text) can be given instead.

Scale: learning reads a bounded sample in one task; extraction is one pass without a shuffle, a block of pages at a time,
in time proportional to their length (open elements are found by position, so unclosed and deep pages cost no more).

Defined cases: a null html is empty; a page without content has the empty text; character references are decoded once;
white space is what Unicode calls so; a line break inside a block is white space; unclosed comments, scripts and styles
reach to the end; what is not well formed is closed as browsers do, without reopening formatting; ties stay out; repeated
rows are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

SAMPLE, SAMPLE_CHARS = 200, 60_000
STEPS, RATE, STRENGTH = 250, 0.08, 2e-4

# --- fixed values: tags of HTML -----------------------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
NEVER = {"head", "noscript", "template", "svg", "math", "select", "datalist", "object", "canvas", "audio", "video"}
IN_HEAD = {"meta", "link", "base", "script", "style", "title", "noscript", "template"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
            "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "li", "dt", "dd"}
# start tag: (open tags it closes, tags it does not look behind)
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "table", "td", "th")), "dt": (("dt", "dd"), ("dl", "table", "td", "th")), "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
           "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
TABLE_PARTS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}

# Words of class, id and role, by what they tell
TELLING = {
    "content": "article body content entry main post story text page prose".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "head": "header masthead banner top topbar logo branding".split(),
    "foot": "footer foot bottom copyright colophon legal imprint".split(),
    "side": "sidebar aside side rail widget complementary secondary".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsbygoogle".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast".split(),
    "comment": "comment comments reply replies discussion disqus respond reader feedback reviews".split(),
    "share": "share sharing social follow tweet like".split(),
    "form": "form search login signup register input contact".split(),
    "teaser": "related recommended recommendation popular trending latest more teaser teasers links list".split(),
    "hidden": "hidden invisible sr-only offscreen".split(),
}
_GROUP = {word: i for i, words in enumerate(TELLING.values()) for word in words}
_HIDDEN = list(TELLING).index("hidden")

TAGS = ["p", "h1", "h2", "h3", "li", "td", "blockquote", "pre", "figcaption", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "button",
        "figure", "body", "span", "a", "other"]
_SAME = {"h4": "h3", "h5": "h3", "h6": "h3", "ol": "ul", "menu": "ul", "dl": "ul", "dd": "li", "dt": "li", "th": "td", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table",
         "fieldset": "form", "label": "form", "#page": "body"}
_TAG = {tag: i for i, tag in enumerate(TAGS)}
# Kinds of children that share a potential with their parents
_KIND = {**dict.fromkeys(("p", "blockquote", "pre", "figcaption"), 1), **dict.fromkeys(("h1", "h2", "h3"), 2), **dict.fromkeys(("li", "td", "ul", "table", "figure"), 3), **dict.fromkeys(("span", "a"), 4)}
KINDS = 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?。！？](?=[\s\"')\]]|$)")


# --- pages as trees -----------------------------------------------------------------------------------------------


class Page:
    """Elements of a page: parent, tag, told groups; and pieces of text in order: (block, element, text, in a link)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.told = [-1], ["#page"], [()]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._stack: list[tuple[str, int]] = [("#page", 0)]
        self._at: dict[str, list[int]] = defaultdict(list, {"#page": [0]})  # places of open elements by tag
        self._blocks = [0]  # places of open blocks
        self._block = 0
        self._read(html)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._block, self._stack[-1][1], entities.unescape(text) if "&" in text else text, bool(self._at["a"])))

    def _close(self, place: int) -> None:
        while len(self._stack) > place:
            name, _ = self._stack.pop()
            self._at[name].pop()
            if self._blocks[-1] == len(self._stack):
                self._blocks.pop()
                self._block += 1

    def _last(self, names) -> int:
        return max((self._at[x][-1] for x in names if self._at.get(x)), default=-1)

    def _open(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "br":
                self._text(" ")
            elif name == "hr":
                self._block += 1
            return
        if name == "html" or (name == "body" and self._at["body"]):
            return
        if self._at["head"] and name not in IN_HEAD:
            self._close(self._at["head"][-1])
        if name in CLOSES_P and self._stack[self._blocks[-1]][0] == "p":
            self._close(self._blocks[-1])
        if name in IMPLIED:
            ends, behind = IMPLIED[name]
            place = self._last(ends)
            if place > self._last(behind):
                self._close(place)
        if name == "a" and self._at["a"] and self._at["a"][-1] > self._blocks[-1]:
            self._close(self._at["a"][-1])
        told = self._told(attributes) if attributes else ()
        inline = name in INLINE
        owner = self._stack[-1][1]
        if not inline or told:
            self.parent.append(owner)
            self.tag.append(name)
            self.told.append(told)
            owner = len(self.parent) - 1
        if not inline:
            self._block += 1
            self._blocks.append(len(self._stack))
        self._at[name].append(len(self._stack))
        self._stack.append((name, owner))

    @staticmethod
    def _told(attributes: str) -> tuple[int, ...]:
        found = set()
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    found.add(_HIDDEN)
            elif key in ("hidden", "aria-hidden"):
                if key == "hidden" or value.lower() == "true":
                    found.add(_HIDDEN)
            else:
                found.update(_GROUP[w] for x in (*_WORD.findall(value), value) if (w := x.lower()) in _GROUP)
        return tuple(sorted(found))

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        if not self._at.get(name):
            return
        place = self._at[name][-1]
        if name in INLINE:
            if place < self._blocks[-1]:
                return
        elif place < self._last(("table",) if name in TABLE_PARTS - {"table"} else ("table", "td", "th") if name != "table" else ()):
            return
        self._close(place)

    def _read(self, html: str) -> None:
        at, gone = 0, set()
        while token := _TOKEN.search(html, at):
            self._text(html[at:token.start()])
            at = token.end()
            name = (token[2] or "").lower()
            if not name:
                if token[0].startswith("<![CDATA["):
                    self._text(token[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            elif token[1]:
                self._end(name)
            elif name in RAW:
                end = None if name in gone else re.compile(f"</{name}(?![a-z0-9])[^>]*>?", re.I).search(html, at)
                if end is None:
                    gone.add(name)
                    at = len(html)
                else:
                    at = end.end()
            else:
                self._open(name, token[3])
        self._text(html[at:])

    def blocks(self, stays) -> list[str]:
        """Text of every block, of the pieces whose element stays."""
        out, now = [], None
        for block, element, text, _ in self.pieces:
            if stays[element]:
                if block != now:
                    out.append([])
                    now = block
                out[-1].append(text)
        return [t for t in (" ".join("".join(parts).split()) for parts in out) if t]


# --- features -----------------------------------------------------------------------------------------------------

N_FEATURES = len(TAGS) + len(TELLING) + 20


class Forest:
    """Elements of several pages: features, parents, kinds, and levels from the roots down."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        n = int(self.first[-1])
        page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = np.concatenate([np.array(p.parent, np.int64) + f for p, f in zip(pages, self.first)]) if n else np.zeros(0, np.int64)
        self.parent[self.first[:-1]] = -1
        tags = [_SAME.get(t, t) for p in pages for t in p.tag]
        tag = np.array([_TAG.get(t, _TAG["other"]) for t in tags], np.int64)
        self.kind = np.array([_KIND.get(t, 0) for t in tags], np.int64)
        self.barred = np.array([t in NEVER for p in pages for t in p.tag], bool)
        own = np.zeros((n, 6))  # characters, in links, words, stops, commas, copyright signs
        start = np.full(n, np.inf)
        total = np.zeros(len(pages))
        for i, (p, f) in enumerate(zip(pages, self.first.tolist())):
            at = 0
            for _, element, text, linked in p.pieces:
                clean = text.strip()
                if clean:
                    row = own[f + element]
                    k = len(clean)
                    row += (k, k if linked else 0, clean.count(" ") + 1, len(_STOP.findall(clean)), clean.count(","), clean.count("©"))
                    start[f + element] = min(start[f + element], at)
                    at += k
            total[i] = max(at, 1)
        # elements come before their children, so levels follow from the parents
        depth = np.zeros(n, np.int64)
        for i, up in enumerate(self.parent.tolist()):
            if up >= 0:
                depth[i] = depth[up] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        # within a level the children of one parent stand together, as elements come in page order
        self.runs = [np.flatnonzero(np.diff(self.parent[level], prepend=-2)) for level in self.levels]
        below, children, titles = own.copy(), np.zeros((n, 2)), (tag == _TAG["h1"]).astype(np.float64)
        beside = np.zeros(n, bool)
        for level, run in zip(self.levels[:0:-1], self.runs[:0:-1]):
            up = self.parent[level[run]]
            below[up] += np.add.reduceat(below[level], run)
            start[up] = np.minimum(start[up], np.minimum.reduceat(start[level], run))
            children[up] += np.add.reduceat(np.stack([np.ones(len(level)), tag[level] == _TAG["p"]], 1), run)
            titles[up] += np.add.reduceat(titles[level], run)
            beside[up] |= np.add.reduceat(tag[level] == _TAG["h1"], run) > 0
        all_text = total[page]
        chars, under = own[:, 0], below[:, 0]
        place = np.where(np.isfinite(start), start, 0) / all_text
        ratio = lambda a, b: a / np.maximum(b, 1)
        numbers = [np.ones(n), chars > 0, np.log1p(chars) / 3, ratio(own[:, 1], chars), (chars > 0) & (own[:, 2] < 6), (own[:, 2] >= 20), np.minimum(own[:, 3], 5) / 3, np.minimum(own[:, 4], 5) / 3,
                   own[:, 5] > 0, np.log1p(under) / 3, ratio(below[:, 1], under), under / all_text, (under / all_text) > 0.5, place, place * place, np.log1p(children[:, 1]), np.log1p(children[:, 0]),
                   (chars > 0) & (own[:, 3] > 0), (titles > 0) & (tag != _TAG["h1"]), beside[np.maximum(self.parent, 0)] & (self.parent >= 0)]
        self.x = np.zeros((n, N_FEATURES))
        self.x[np.arange(n), tag] = 1
        flat = [(i, g) for i, told in enumerate(t for p in pages for t in p.told) for g in told]
        if flat:
            rows, groups = zip(*flat)
            self.x[list(rows), len(TAGS) + np.array(groups)] = 1
        self.x[:, len(TAGS) + len(TELLING):] = np.stack(numbers, 1)
        self.own, self.page = own, page


# --- the model ----------------------------------------------------------------------------------------------------


def messages(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of content of every element, of (parent, child) states of every edge, and the log partition sum.

    unary: elements x 2; edge: kinds x parent's state x child's state. Upward, then downward, by level.
    """
    n = len(unary)
    inner, up, down = unary.copy(), np.zeros((n, 2)), np.zeros((n, 2))
    for level, run in zip(forest.levels[:0:-1], forest.runs[:0:-1]):
        up[level] = np.logaddexp.reduce(inner[level][:, None, :] + edge[forest.kind[level]], axis=2)
        inner[forest.parent[level[run]]] += np.add.reduceat(up[level], run)
    for level in forest.levels[1:]:
        parent = forest.parent[level]
        rest = inner[parent] + down[parent] - up[level]  # all but this child's branch
        down[level] = np.logaddexp.reduce(rest[:, :, None] + edge[forest.kind[level]], axis=1)
    score = inner + down
    whole = np.logaddexp.reduce(score, axis=1)
    pairs = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        parent = forest.parent[level]
        rest = inner[parent] + down[parent] - up[level]
        joint = rest[:, :, None] + edge[forest.kind[level]] + inner[level][:, None, :]
        pairs[level] = np.exp(joint - whole[level][:, None, None])
    roots = forest.levels[0] if len(forest.levels) else np.zeros(0, np.int64)
    return np.exp(score[:, 1] - whole), pairs, float(whole[roots].sum())


class Model:
    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def unary(self, forest: Forest) -> np.ndarray:
        content = forest.x @ self.weights
        content[forest.barred] = -40
        return np.stack([np.zeros(len(content)), content], 1)

    def content(self, forest: Forest) -> np.ndarray:
        return messages(forest, self.unary(forest), self.edge)[0]

    def extract(self, pages: list[Page]) -> list[list[str]]:
        forest = Forest(pages)
        stays = (self.content(forest) > 0.5).tolist()
        return [p.blocks(stays[f:f + len(p.parent)]) for p, f in zip(pages, forest.first.tolist())]


def label(pages: list[Page], texts: list[str], forest: Forest) -> np.ndarray:
    """1 for elements of whose text at least half, and some, lies in blocks of the wanted text."""
    good = np.zeros((len(forest.x), 2))
    for p, text, first in zip(pages, texts, forest.first.tolist()):
        wanted = set(text.split("\n"))
        whole: dict[int, list[str]] = defaultdict(list)
        for block, _, piece, _ in p.pieces:
            whole[block].append(piece)
        fits = {b: " ".join("".join(parts).split()) in wanted for b, parts in whole.items()}
        for block, element, piece, _ in p.pieces:
            k = len(piece.strip())
            good[first + element] += (k if fits[block] else 0, k)
    for level, run in zip(forest.levels[:0:-1], forest.runs[:0:-1]):
        good[forest.parent[level[run]]] += np.add.reduceat(good[level], run)
    return ((good[:, 0] * 2 >= good[:, 1]) & (good[:, 0] > 0) & ~forest.barred).astype(np.int64)


def fit(pages: list[Page], texts: list[str], steps: int = STEPS, rate: float = RATE, strength: float = STRENGTH) -> Model:
    """Most likely weights, by gradient steps with momentum and scaling."""
    forest = Forest(pages)
    y = label(pages, texts, forest)
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    free = ~forest.barred
    n, n_features = len(pages), forest.x.shape[1]
    theta = np.zeros(n_features + seen.size)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = Model(theta[:n_features], theta[n_features:].reshape(seen.shape))
        chance, pairs, _ = messages(forest, model.unary(forest), model.edge)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[child], pairs[child])
        gradient = np.concatenate((forest.x[free].T @ (y - chance)[free], (seen - expected).ravel())) / n - strength * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        theta = theta + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Model(theta[:n_features], theta[n_features:].reshape(seen.shape))


# --- labelled pages -----------------------------------------------------------------------------------------------


def labelled_pages(n: int = 360, seed: int = 13) -> list[tuple[str, str]]:
    """Pages made by rule in many layouts, with the text that is their article."""
    rng = random.Random(seed)
    syllables = "an be cor di el fa gor hi ing ja ko lu me nor op pra qui ra sto tu un va wer xi yo zen sch ion lle ña ém ß".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def sentence(k: int) -> str:
        parts = [word() + ("," if rng.random() < 0.08 else "") for _ in range(max(1, k))]
        return " ".join(parts).rstrip(",").capitalize() + rng.choice("...!?")

    def prose(low: int, high: int) -> str:
        return " ".join(sentence(rng.randrange(2, 18)) for _ in range(rng.randrange(low, high)))

    def told(group: str) -> str:
        kind = rng.random()
        words = rng.choice(TELLING[group])
        if kind < 0.2:
            return ""
        words = words if kind < 0.5 else rng.choice((f"{words}-{word()}", f"site-{words}", f"{words} {word()}", f"{word()}_{words}"))
        return f' {rng.choice(("class", "class", "id"))}="{words}"'

    def links(k: int) -> str:
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randrange(1, 4)))}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else rng.choice((" | ", " ", "\n")).join(items)

    def box(tag: str, group: str, inside: str) -> str:
        name = tag if rng.random() < 0.6 else rng.choice(("div", "section"))
        mark = told(group) if name == tag and tag not in ("div", "section") else f' class="{rng.choice(TELLING[group])}"'
        return f"<{name}{mark}>{inside}</{name}>"

    def teasers() -> str:
        one = lambda: f'<div><h3><a href="/{word()}">{sentence(6)}</a></h3>' + (f"<p>{sentence(9)}</p>" if rng.random() < 0.5 else "") + "</div>"
        return f"<h2>{word().capitalize()} {word()}</h2>" + "".join(one() for _ in range(rng.randrange(2, 6)))

    def comments() -> str:
        one = lambda: f"<div{told('comment')}><b>{word()}</b> <span>{rng.randrange(1, 28)}.{rng.randrange(1, 13)}.</span><p>{prose(1, 4)}</p></div>"
        return f"<h2>{rng.randrange(2, 40)} {word()}</h2>" + "".join(one() for _ in range(rng.randrange(1, 6)))

    def article() -> tuple[str, list[str]]:
        title = sentence(rng.randrange(3, 10)).rstrip(".!?")
        out, kept = [f"<h1>{title}</h1>"], [title]
        if rng.random() < 0.15:  # odd texts are articles as well: one line many times, words without stops, symbols
            line = rng.choice((sentence(2), sentence(6), f"{word()}### {word()}%%% $$$", str(rng.randrange(10 ** 6))))
            odd = [line] * rng.choice((1, 4, 12, 25)) + [" ".join([word()] * rng.choice((3, 60, 250)))] * rng.randrange(2)
            return "".join(out + [f"<p>{x}</p>" for x in odd]), kept + odd
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            kind = rng.random()
            if kind < 0.7:
                text = prose(1, rng.choice((2, 6)))
                if rng.random() < 0.2:
                    out.append(f"<p><b>{text}<br>")
                elif rng.random() < 0.3:
                    out.append(f'<p>{text} <a href="/{word()}">{word()}</a> {word()}.</p>')
                    text = re.sub("<[^>]*>", "", out[-1])
                else:
                    out.append(f"<p>{text}</p>")
                kept.append(text)
            elif kind < 0.8:
                text = sentence(4).rstrip(".!?")
                out.append(f"<h2>{text}</h2>")
                kept.append(text)
            elif kind < 0.88:
                items = [sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(2, 5))]
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                kept += items
            elif kind < 0.92:
                text = prose(1, 3)
                out.append(f"<blockquote>{text}</blockquote>")
                kept.append(text)
            elif kind < 0.95:
                text = sentence(7)
                out.append(f'<figure><img src="/x.png"><figcaption>{text}</figcaption></figure>')
                kept.append(text)
            else:
                cells = [word() for _ in range(6)]
                out.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2])) + "</table>")
                kept += cells
            if rng.random() < 0.08:
                out.append(box("aside", "ad", f"<p>{sentence(8)}</p>"))
            if rng.random() < 0.04:
                out.append(box("div", "share", links(3)))
            if rng.random() < 0.04:
                out.append(box("form", "notice", f"<p>{sentence(9)}</p><input><button>{word()}</button>"))
        return "".join(out), kept

    made = []
    for _ in range(n):
        inside, kept = article()
        style = rng.random()
        main = (f"<article>{inside}</article>" if style < 0.3 else f"<main>{inside}</main>" if style < 0.45 else f"<div{told('content')}>{inside}</div>" if style < 0.85
                else f"<div><div>{inside}</div></div>" if style < 0.95 else inside)
        some = lambda chance, make: make() if rng.random() < chance else ""
        brand = lambda: f'<a href="/">{word()}</a>' + some(0.5, lambda: f"<p>{sentence(5)}</p>") + some(0.4, lambda: f"<form><input><button>{word()}</button></form>")
        before = [some(0.3, lambda: box("div", "notice", f"<p>{prose(1, 3)}</p><button>{word()}</button>")), some(0.6, lambda: box("header", "head", brand())),
                  some(0.8, lambda: box("nav", "menu", links(rng.randrange(3, 9)))), some(0.4, lambda: f'<div class="{rng.choice(TELLING["ad"])}">{prose(1, 3)}</div>'),
                  some(0.2, lambda: box("aside", "side", teasers()))]
        after = [some(0.3, lambda: box("section", "teaser", teasers())), some(0.35, lambda: box("section", "comment", comments())),
                 some(0.3, lambda: box("form", "form", f"<label>{word()}</label><textarea></textarea><button>{word()}</button>")), some(0.3, lambda: box("aside", "side", teasers() + links(3))),
                 some(0.2, lambda: f'<div class="{rng.choice(TELLING["ad"])}">{prose(1, 3)}</div>'),
                 some(0.85, lambda: box("footer", "foot", rng.choice((f"&copy; {word()} &middot; {sentence(5)}", f"<p>&copy; {word()} {sentence(4)}</p>" + links(4), f"<p>{prose(1, 4)}</p>"))))]
        middle = "".join(before[3:]) + main + "".join(after[:-1])
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(("wrapper", "container", "row", "page"))}">{middle}</div>'
        head = f"<!DOCTYPE html><html><head><title>{kept[0]}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"
        made.append((head + "".join(before[:3]) + middle + after[-1] + "</body></html>", "\n".join(kept)))
    return made


def marked_text(page: Page) -> str | None:
    """Text of the one article or main element of a page without what its tags or words set apart; None if not just one."""
    marked = [i for i, t in enumerate(page.tag) if t in ("article", "main")]
    if len(marked) != 1:
        return None
    apart = set(range(1, len(TELLING)))
    inside = np.zeros(len(page.parent), bool)
    inside[marked[0]] = True
    for i, up in enumerate(page.parent):
        if up >= 0 and inside[up]:
            inside[i] = page.tag[i] not in NEVER | {"nav", "aside", "footer", "form", "button"} and not apart.intersection(page.told[i])
    return "\n".join(page.blocks(inside))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages, texts = [], []
    for batch in batches:
        for html, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html or "")
            text = marked_text(page) if text is None else text
            if text:
                pages.append(page)
                texts.append(text)
    if pages:
        model = fit(pages, texts)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.edge.tobytes()])], ["weights", "edge"])


def learn(labelled: DataFrame) -> Model:
    """From (html, text), a bounded table; where the text is null, the page's one article or main element is the label."""
    c.ship_package(labelled.sparkSession)
    ordered = labelled.select("html", "text").repartition(1).sortWithinPartitions("html", "text")
    got = ordered.mapInArrow(_fit, "weights binary, edge binary").collect()
    if not got:
        return Model(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    return Model(np.frombuffer(got[0][0]), np.frombuffer(got[0][1]).reshape(KINDS, 2, 2))


def training_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(html, text): pages made by rule, and a sample of those that mark one article or main element."""
    spark = pages.sparkSession
    made = spark.createDataFrame(labelled_pages(), "html string, text string")
    marks = F.regexp_count(F.col(html_col), F.lit(r"(?i)<(article|main)\b"))
    marked = pages.where(F.length(html_col) <= SAMPLE_CHARS).where(marks == 1)
    order = [F.xxhash64(F.lit(5), F.col(id_col)), F.xxhash64(F.col(html_col))]
    return made.unionByName(marked.orderBy(*order).limit(sample).select(F.col(html_col).alias("html"), F.lit(None).cast("string").alias("text")))


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in c.blocks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                found = ["\n".join(x) for x in model.value.extract([Page(h or "") for h in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and n_chars."""
    spark = pages.sparkSession
    c.ship_package(spark)
    known = spark.sparkContext.broadcast(model or learn(training_pages(pages, id_col, html_col)))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind, url = (source.schema[x].dataType.simpleString() for x in ("id", "url"))
    got = source.mapInArrow(_extract(known), f"id {kind}, url {url}, text string, n_chars long")
    return got.withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark, sf_dir: str) -> DataFrame:
    """op13: `extract_text` over whole `pages`."""
    return extract_text(c.table(spark, sf_dir, "pages"))
