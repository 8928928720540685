"""Main-text extraction by a linear-chain CRF over DOM leaf blocks (operator 5).

A page is read leniently (unclosed, misnested and cut-off markup included, with HTML's
implied end tags, and in time that grows with its length) into
leaf blocks: stretches of text between block-level tags, with the tags and
attribute words of all their open ancestors; wrappers without a class, id or role say
nothing, so that they may stand anywhere. Scripts, styles and comments never
become text. Each block is main text or not; a linear-chain conditional random
field over ancestor and text features, and over what share of the page stands in a
block's own element, decides for all blocks of a page at once,
decoded by Viterbi. It is trained by gradient ascent on the exact likelihood
over labelled pages, which ``labelled_pages`` generates with known labels in
many layouts.

Defined cases: null or empty html gives an empty text; text outside any tag is a
block; character references are decoded after the markup is read; repeated rows
are extracted each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's block-level elements, elements without text for readers, and void elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style template noscript textarea svg math iframe object head title".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: HTML's implied end tags. Elements that a start tag ends when one of
#: them is open below no other block than those it looks through.
_CELLS, _HEADINGS = frozenset(["td", "th"]), frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ENDS = {
    "li": (frozenset(["li"]), frozenset(["p", "div", "address"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["p", "div", "address"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["p", "div", "address"])),
    "td": (_CELLS, frozenset(["p"])),
    "th": (_CELLS, frozenset(["p"])),
    "tr": (frozenset(["tr"]), _CELLS | {"p"}),
    "option": (frozenset(["option"]), frozenset()),
} | {h: (_HEADINGS, frozenset()) for h in _HEADINGS}
#: Elements whose content readers do not see only if they are closed, and those that a block's start ends.
CLOSED_ONLY = frozenset("svg math object noscript template".split())
FOREIGN = frozenset(["svg", "math"])
#: What a head may hold.
IN_HEAD = frozenset("head title base link meta style script noscript template html".split())
#: Blocks that hold text rather than other blocks, and wrappers that say
#: nothing where they carry no class, id or role.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre blockquote figcaption caption summary legend option".split())
WRAPPERS = frozenset("div section center table tbody tr td".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A leaf block: its text, the tags and attribute words of its open ancestors, its last
    ancestors that say something, how many of its letters are links, and the number of
    the element that holds it."""

    __slots__ = ("holder", "link", "names", "tail", "text")

    def __init__(self, text: str, names: frozenset, tail: tuple, link: int, holder: int):
        self.text, self.names, self.tail, self.link, self.holder = text, names, tail, link, holder


def _attribute_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    got = _ATTRIBUTE.findall(attributes)
    return tuple(sorted({w for g in got for w in _WORDS.findall(" ".join(g).lower())})) if got else ()


class _Reader:
    """The open elements of a page, its leaf blocks, and what is known of its ends."""

    def __init__(self, page: str, known: frozenset | None = None):
        self.page, self.known = page, known
        self.out: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...], int]] = []
        self.counts: Counter[str] = Counter()  # open elements by name
        self.open: Counter[str] = Counter()  # features of open blocks
        self.at_blocks: list[int] = []  # places of blocks in the stack
        self.solid: list[str] = []  # names of the open blocks that say something
        self.parts: list[str] = []
        self.linked = self.silent = self.serial = 0
        self.last_close: dict[str, int] = {}
        self.find_ends()

    def find_ends(self) -> None:
        """For each quote and ">" of the page, where a tag that is open there, outside quotes,
        ends (-1: nowhere, as a quote is not closed), and the next ">" of all."""
        self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
        n = len(self.places)
        self.ends, self.nearest_end = [-1] * (n + 1), [-1] * (n + 1)
        following: dict[str, int] = {}
        for k in range(n - 1, -1, -1):
            kind = self.page[self.places[k]]
            if kind == ">":
                self.ends[k] = self.nearest_end[k] = self.places[k]
            else:
                self.ends[k] = self.ends[following[kind] + 1] if kind in following else -1
                self.nearest_end[k] = self.nearest_end[k + 1]
                following[kind] = k

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            if "&" in text:
                text = html_lib.unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                held = next((self.stack[k] for k in reversed(self.at_blocks) if self.stack[k][0] not in LEAVES), ("", (), 0))
                leaf = self.nearest() or "-"
                self.out.append(Block(text, frozenset(self.open), (*self.solid[-3:], leaf, min(len(self.solid), 6)), self.linked, held[2]))
            self.parts.clear()
        self.linked = 0

    def features(self, name: str, words: tuple[str, ...]) -> list[str]:
        """What an open block adds; words that no model knows add nothing."""
        return [f for f in ("tag:" + name, *["word:" + w for w in words]) if self.known is None or f in self.known]

    @staticmethod
    def says(name: str, words: tuple[str, ...]) -> bool:
        return name not in ("html", "body") and (name not in WRAPPERS or bool(words))

    def text(self, start: int, end: int) -> None:
        if end <= start:
            return
        if self.counts["head"] and not self.page[start:end].isspace():
            self.end("head")
        if not self.silent:
            self.parts.append(self.page[start:end])
            if self.counts["a"]:
                self.linked += end - start

    def start(self, name: str, attributes: str, at: int) -> None:
        if name in BLOCK_TAGS:
            self.flush()
            if name not in IN_HEAD and self.counts["head"]:
                self.end("head")
            for foreign in FOREIGN:
                if self.counts[foreign]:
                    self.end(foreign)
            if self.nearest() == "p":
                self.cut(self.at_blocks[-1])
        if name in ENDS:
            ended, through = ENDS[name]
            if any(self.counts[e] for e in ended):
                for k in reversed(self.at_blocks):
                    if self.stack[k][0] in ended:
                        self.cut(k)
                        break
                    if self.stack[k][0] not in through:
                        break
        if name in ("br", "hr"):
            if not self.silent:
                self.parts.append(" ")
            return
        if name in VOID_TAGS or (attributes.rstrip().endswith("/") and name not in BLOCK_TAGS):
            return
        hides = name in SILENT_TAGS and (name not in CLOSED_ONLY or self.closes(name, at))
        if name in SILENT_TAGS and not hides:
            name = "-"  # its text is read, as that of an unknown inline element
        words = _attribute_words(attributes)
        self.serial += 1
        self.stack.append((name, words, self.serial))
        self.counts[name] += 1
        self.silent += hides
        if name in BLOCK_TAGS:
            self.at_blocks.append(len(self.stack) - 1)
            if self.says(name, words):
                self.solid.append(name)
                self.open.update(self.features(name, words))

    def closes(self, name: str, at: int) -> bool:
        """Whether an element of this name ends somewhere behind a place."""
        if name not in self.last_close:
            self.last_close[name] = max((m.start() for m in re.finditer(f"</{name}\\b", self.page, re.I)), default=-1)
        return self.last_close[name] >= at

    def nearest(self) -> str:
        return self.stack[self.at_blocks[-1]][0] if self.at_blocks else ""

    def end(self, name: str) -> None:
        if self.counts[name]:
            self.cut(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name))

    def cut(self, k: int) -> None:
        """Close the element at a place of the stack and all in it."""
        for name, words, _ in self.stack[k:]:
            self.counts[name] -= 1
            self.silent -= name in SILENT_TAGS
            if name in BLOCK_TAGS and self.says(name, words):
                self.solid.pop()
                for f in self.features(name, words):
                    self.open[f] -= 1
                    if not self.open[f]:
                        del self.open[f]
        del self.stack[k:]
        while self.at_blocks and self.at_blocks[-1] >= k:
            self.at_blocks.pop()

    def tag_end(self, at: int) -> int:
        """The place of a tag's ">", outside quotes; -1 if it has none. Quotes that are
        not closed are plain characters."""
        k = bisect_left(self.places, at)
        return self.ends[k] if self.ends[k] >= 0 else self.nearest_end[k]


def blocks(page: str | None, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks of a page in order, white space folded, empty ones left out. ``known``:
    the features of ancestors that matter; all if not given."""
    page = page or ""
    reader = _Reader(page, known)
    at = shown = 0  # where to look for the next tag, and the end of what was read
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            stop = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            stop = len(page) if end < 0 else end + 1
        else:
            named = _NAME.match(page, at)
            if named is None:
                at += 1
                continue
            end = reader.tag_end(named.end())
            if end < 0:
                if page.find("<", at + 1) < 0:  # a tag that the page's end cuts off
                    reader.text(shown, at)
                    shown = len(page)
                break
            stop = end + 1
        reader.text(shown, at)
        opened = at
        at = shown = stop
        if page[opened + 1] in "!?":
            continue
        name = named.group(1).lower()
        if page[opened + 1] == "/":
            if name in BLOCK_TAGS:
                reader.flush()
            reader.end(name)
        elif name in RAW_TAGS:
            if name in BLOCK_TAGS:
                reader.flush()
            close = re.compile(f"</{name}\\s*>", re.I).search(page, at) if reader.closes(name, at) else None
            if close or name != "title":
                at = shown = close.end() if close else len(page)
        else:
            reader.start(name, page[named.end() : end], stop)
    reader.text(shown, len(page))
    reader.flush()
    return reader.out


@lru_cache(100_000)
def _path_features(names: frozenset, tail: tuple) -> tuple[str, ...]:
    *tags, leaf, depth = tail
    return (*sorted(names), "tail:" + ">".join(tags), "last:" + ">".join(tags[-2:]), "leaf:" + leaf, f"depth:{depth}")


def page_features(page: list[Block]) -> list[list[str]]:
    """The features of each block: its ancestors, its text, its place, and what share of the
    page's text its holder has."""
    inside: Counter[int] = Counter()
    for block in page:
        inside[block.holder] += len(block.text)
    whole = max(1, sum(inside.values()))
    articles = any("tag:article" in b.names or "tag:main" in b.names for b in page)
    out = []
    for place, block in enumerate(page):
        n, words = len(block.text), block.text.count(" ") + 1
        got = list(_path_features(block.names, block.tail))
        got.append("length:" + str(min(9, n.bit_length())))
        got.append("link:" + str(min(3, int(4 * block.link / max(n, 1)))))
        got.append("words:" + str(min(6, words.bit_length())))
        got.append("end:" + ("stop" if block.text[-1] in ".!?…。" else "open"))
        got.append(f"share:{min(3, int(4 * inside[block.holder] / whole))}")
        got.append(f"article:{articles}:{'tag:article' in block.names or 'tag:main' in block.names}")
        if "©" in block.text:
            got.append("sign:copyright")
        if place == 0:
            got.append("first")
        if place == len(page) - 1:
            got.append("last")
        out.append(got)
    return out


class Tagger:
    """Weights of features (columns: other, main) and of label steps."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        self.known = frozenset(n for n in names if n.startswith(("tag:", "word:")))
        self.cache: dict[tuple, np.ndarray] = {}

    def scores(self, page: list[Block]) -> np.ndarray:
        get, out = self.names.get, np.zeros((len(page), 2))
        for k, features in enumerate(page_features(page)):
            key = tuple(features)
            row = self.cache.get(key)
            if row is None:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                ids = [i for f in key if (i := get(f)) is not None]
                row = self.cache[key] = self.weights[ids].sum(0) if ids else np.zeros(2)
            out[k] = row
        return out

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi's best labelling of a page's blocks."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (t00, t01), (t10, t11) = self.steps.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((a1 > a0, b1 > b0))
            a, b = max(a0, a1) + x, max(b0, b1) + y
        label = b > a
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        got = blocks(page, self.known)
        return "\n".join(b.text for b, keep in zip(got, self.decode(got)) if keep)


def train(pages: list[tuple[str, list[bool]]], steps: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> Tagger:
    """Maximum-likelihood CRF of two labels by Adagrad over all pages at once."""
    read = [blocks(p) for p, _ in pages]
    names: dict[str, int] = {}
    rows, cols, lens = [], [], []
    total = 0
    for page in read:
        lens.append(len(page))
        for features in page_features(page):
            for f in features:
                rows.append(total)
                cols.append(names.setdefault(f, len(names)))
            total += 1
    rows, cols = np.array(rows), np.array(cols)
    gold = np.array([y for _, ys in pages for y in ys], int)
    if len(gold) != total:
        raise ValueError("labels and blocks differ in number")
    width = max(lens)
    at = np.full((len(read), width), total)
    start = 0
    for k, n in enumerate(lens):
        at[k, :n] = np.arange(start, start + n)
        start += n
    real = at < total
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    want_t = np.zeros((2, 2))
    padded = np.append(gold, 0)
    both = real[:, 1:] & real[:, :-1]
    np.add.at(want_t, (padded[at[:, :-1]][both], padded[at[:, 1:]][both]), 1)
    want = np.zeros((total, 2))
    want[np.arange(total), gold] = 1
    for _ in range(steps):
        s = np.zeros((total + 1, 2))
        for c in (0, 1):
            s[:total, c] = np.bincount(rows, w[cols, c], total)
        u = s[at]
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for k in range(1, width):
            nxt = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + u[:, k]
            alpha[:, k] = np.where(real[:, k, None], nxt, alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            nxt = np.logaddexp.reduce(t + (u[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(real[:, k + 1, None], nxt, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        have = np.zeros((total + 1, 2))
        have[at] = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + t + (u + beta)[:, 1:, None, :] - z[:, None, None, None])
        have_t = pair[both].sum(0)
        diff = want - have[:total]
        grad = np.stack([np.bincount(cols, diff[rows, c], len(names)) for c in (0, 1)], 1) / len(read) - ridge * w
        grad_t = (want_t - have_t) / len(read) - ridge * t
        gw += grad**2
        gt += grad_t**2
        w += rate * grad / np.sqrt(gw)
        t += rate * grad_t / np.sqrt(gt)
    return Tagger(names, w, t)


def labelled_pages(n: int = 1500, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """Generated pages with the label of each of their blocks (True: main text)."""
    rnd = random.Random(seed)
    syllables = "the an in er on re ti es or at en ed st al ar le de la ou ver ung ich que ment tion".split()

    def sentence(low: int, high: int) -> str:
        said = " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(low, high)))
        if rnd.random() < 0.08:
            said = said.replace(" ", rnd.choice(["&amp; ", "%%% ", "!! ", " | ", "$$$ ", "*** "]))
        return said.capitalize() + rnd.choice([".", ".", ".", ".", "", "!", "?"])

    def words(k: int) -> str:
        return " ".join(rnd.choice(syllables) + rnd.choice(syllables) for _ in range(k))

    def prose() -> str:
        return " ".join(sentence(3, 18) for _ in range(rnd.randint(1, 6))) if rnd.random() < 0.85 else sentence(1, 3)

    def page() -> tuple[str, list[bool]]:
        out: list[str] = []
        labels: list[bool] = []

        def say(markup: str, *flags: bool) -> None:
            out.append(markup)
            labels.extend(flags)

        def named(tag: str, words_: list[str]) -> str:
            if rnd.random() < 0.15:
                return f"<{tag}>"
            return f'<{tag} {rnd.choice(["class", "class", "id", "role"])}="{rnd.choice(words_)}{rnd.choice(["", "-box", " wide", "_1"])}">'

        def menu() -> None:
            outer = rnd.choice(["nav", "nav", "div", "header", "ul"])
            words_ = ["nav", "menu", "navbar", "breadcrumb", "toolbar", "links", "header"]
            items = [f'<a href="/{words(1)}">{words(rnd.randint(1, 3))}</a>' for _ in range(rnd.randint(2, 7))]
            opened = f"<{outer}>" if outer == "nav" and rnd.random() < 0.6 else f'<{outer} class="{rnd.choice(words_)}">'
            shape = rnd.random()
            if shape < 0.6:
                say(opened + ("" if outer == "ul" else "<ul>") + "".join(f"<li>{i}</li>" for i in items) + ("" if outer == "ul" else "</ul>") + f"</{outer}>", *[False] * len(items))
            else:
                say(opened + " ".join(items) + f"</{outer}>", False)

        def aside() -> None:
            kind = rnd.choice(["ad", "aside", "notice", "form", "comments", "related", "share", "header"])
            if kind == "ad":
                say(f'<div {rnd.choice(["class", "id"])}="{rnd.choice(["ad", "ads", "advert", "sponsor", "promo", "banner", "advertisement", "ad slot"])}">{prose()}</div>', False)
            elif kind == "aside":
                n_items = rnd.randint(1, 4)
                tag = rnd.choice(['aside', 'aside class="sidebar"', 'div class="sidebar"', 'div id="side"', 'section class="sidebar widget"'])
                inner = rnd.choice(["p", "li", "div"])
                say(f"<{tag}>" + "".join(f"<{inner}>{prose()}</{inner}>" for _ in range(n_items)) + f"</{tag.split()[0]}>", *[False] * n_items)
            elif kind == "notice":
                words_ = ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "newsletter", "subscribe", "popup", "modal", "privacy"]
                inner = rnd.choice(["p", "div", "span"])
                button = f"<button>{words(1)}</button>" if rnd.random() < 0.5 else ""
                say(f'<{rnd.choice(["div", "section"])} {rnd.choice(["class", "id"])}="{rnd.choice(words_)}"><{inner}>{prose()}</{inner}>', False)
                if button:
                    say(button) if inner == "span" else say(button, False)
                say("</div></section>")
            elif kind == "form":
                n_items = rnd.randint(1, 3)
                say("<form>" + "".join(f"<p><label>{words(2)}</label><input name=q></p>" for _ in range(n_items)) + "</form>", *[False] * n_items)
            elif kind == "comments":
                n_items = rnd.randint(1, 5)
                outer = rnd.choice(["comments", "comment-list", "responses", "discussion", "reader-comments", "replies"])
                inner = rnd.choice(["p", "li", "div class='comment'", "article class='comment'", "blockquote"])
                tag = rnd.choice(["section", "div", "ol", "aside"])
                say(f'<{tag} {rnd.choice(["class", "id"])}="{outer}">')
                if rnd.random() < 0.5:
                    say(f"<h3>{words(2)}</h3>", False)
                say("".join(f"<{inner}>{prose()}</{inner.split()[0]}>" for _ in range(n_items)) + f"</{tag}>", *[False] * n_items)
            elif kind == "related":
                n_items = rnd.randint(2, 5)
                say(f'<div class="{rnd.choice(["related", "recommended", "more", "trending", "popular"])}"><ul>' + "".join(f'<li><a href="#">{sentence(3, 9)}</a></li>' for _ in range(n_items)) + "</ul></div>", *[False] * n_items)
            elif kind == "share":
                say(f'<div class="{rnd.choice(["share", "social", "toolbar", "tags", "meta", "byline"])}"><a href="#">{words(1)}</a> <a href="#">{words(1)}</a></div>', False)
            else:
                say(f'<header><p>{prose()}</p></header>', False)

        def wrapper() -> tuple[str, str]:
            """An element around others, more often than not without a telling name."""
            k = rnd.random()
            if k < 0.4:
                return "<div>", "</div>"
            if k < 0.5:
                return "<section>", "</section>"
            word = rnd.choice(["wrap", "wrapper", "container", "row", "col", "inner", "outer", "page", "site", "layout", "grid", "block", "column", "box"])
            return f'<div {rnd.choice(["class", "id"])}="{word}">', "</div>"

        title = sentence(3, 9)
        if rnd.random() < 0.04:  # text alone
            for _ in range(rnd.randint(1, 3)):
                say(prose() if not out else f"<p>{prose()}", True)
            return "".join(out), labels
        say(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
        around = [wrapper() for _ in range(rnd.choice([0, 0, 0, 1, 1, 2]))]
        table = rnd.random() < 0.08
        for opened, _ in around:
            say(opened)
        if table:  # a layout table: menu, article and side in cells
            items = [f'<a href="/{words(1)}">{words(1)}</a>' for _ in range(rnd.randint(1, 6))]
            listed = rnd.random() < 0.5
            say("<table><tr><td>" + ("".join(f"<p>{i}</p>" for i in items) if listed else " ".join(items)) + "</td><td>", *[False] * (len(items) if listed else 1))
            if rnd.random() < 0.3:
                say(f"{words(1)}</td><td>", False)
        for _ in range(rnd.randint(0, 2)):
            menu()
        if rnd.random() < 0.4:
            say(f"<header><h1>{words(2)}</h1></header>", False) if rnd.random() < 0.5 else say(f"<header>{words(3)}</header>", False)
        for _ in range(rnd.randint(0, 3)):
            aside()
        columns = [wrapper() for _ in range(rnd.choice([0, 0, 0, 1, 2]))]
        for opened, _ in columns:
            say(opened)
        tag = rnd.choice(["article"] * 6 + ["div", "div", "div class='txt'", "div class='post-body'", "section"] + ["main", "div class='content'", "div id='post'", "section class='article body'", "main class='story'", "div class='entry text'"])
        say(f"<{tag}>")
        if tag != "div class='content'" and rnd.random() < 0.2:  # the article's own head
            say(f"<header><h1>{title}</h1></header>", True)
        elif rnd.random() < 0.85:
            say(f"<h1>{title}</h1>", True)
        nested, shapes = rnd.random() < 0.45, []
        for _ in range(rnd.randint(1, 14)):
            shape = rnd.random()
            if nested and len(shapes) < 3 and rnd.random() < 0.35:  # groups of paragraphs in elements of their own
                opened, closed = rnd.choice([("<div>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ('<div class="text">', "</div>"), ('<div class="body">', "</div>"), ('<div class="hero">', "</div>")])
                say(opened)
                shapes.append(closed)
            elif shapes and rnd.random() < 0.3:
                say(shapes.pop())
            if shape < 0.66:
                say(f"<p>{prose()}</p>", True)
            elif shape < 0.76:
                say(f"<p><b>{prose()}<br>", True)
            elif shape < 0.82:
                say(f"<{rnd.choice(['h2', 'h3'])}>{sentence(1, 6)}</h2></h3>", True)
            elif shape < 0.87:
                n_items, kind = rnd.randint(1, 4), rnd.choice(["ul", "ol"])
                end = rnd.choice(["</li>", "</li>", ""])
                say(f"<{kind}>" + "".join(f"<li>{sentence(2, 12)}{end}" for _ in range(n_items)) + f"</{kind}>", *[True] * n_items)
            elif shape < 0.9:
                say(f"<blockquote>{prose()}</blockquote>", True)
            elif shape < 0.93:
                say(f"<div>{prose()}</div>", True)
            elif shape < 0.95:
                say(f"<pre>{prose()}</pre>", True)
            elif shape < 0.96:
                say(f"<table><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table>", True, True)
            elif shape < 0.98:
                say(f'<p>{prose()} <a href="#">{words(2)}</a> {prose()}</p>', True)
            else:
                aside()
        for closed in reversed(shapes):
            say(closed)
        if rnd.random() < 0.12:  # a list that ends the article
            n_items, kind = rnd.randint(1, 5), rnd.choice(["ul", "ol", "ol"])
            say(f"<{kind}>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(n_items)) + f"</{kind}>", *[True] * n_items)
        say(f"</{tag.split()[0]}>") if rnd.random() < 0.93 or columns or table else None
        if columns and rnd.random() < 0.5:
            aside()
        for _, closed in reversed(columns):
            say(closed)
        for _ in range(rnd.randint(0, 3)):
            aside()
        if table:
            say("</td>")
            if rnd.random() < 0.5:
                say(f'<td><a href="#">{words(2)}</a></td>', False)
            say("</tr></table>")
        for _, closed in reversed(around):
            say(closed)
        if rnd.random() < 0.8:
            tag = rnd.choice(["footer", "footer", "footer", "div class='footer'", "div id='footer'"])
            say(f"<{tag}>{rnd.choice(['&copy; ', '', '(c) '])}{words(2)}.example.com &middot; {sentence(2, 8)}</{tag.split()[0]}></body></html>", False)
        return "".join(out), labels

    made = []
    while len(made) < n:
        markup, labels = page()
        if len(blocks(markup)) == len(labels):  # rare misnesting joins two blocks: such a page has no labels of its own
            made.append((markup, labels))
    return made


def extract(pages: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    tagger = tagger or train(labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast((tagger.names, tagger.weights, tagger.steps))
    made: list[Tagger] = []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Tagger(*sent.value))
        for pdf in frames:
            texts = [made[0].extract(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    thin = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return thin.mapInPandas(run, "page_id long, url string, text string, n_chars long")
