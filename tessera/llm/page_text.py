"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text that no block element interrupts,
with the elements above them. Each block gets binary features of these elements
(names, class and id tokens) and of its text; the field has a weight for each
feature and label and for each pair of neighbouring labels, is trained by
gradient ascent on the conditional likelihood of labelled pages, and labels the
blocks of a page together by Viterbi's algorithm. The text is that of the blocks
labelled as content, white space within a block as one space, joined by one space.

Training takes MAX_PAGES labelled pages at most, a documented bound; extraction
covers every row and the whole html. Null, empty and blank pages have no blocks
and an empty text. Equal pages get equal texts. Markup that isn't closed, or is
closed twice, is read as browsers do in the common cases (p, li, cells). Elements that HTML doesn't
know, as those of formulas, belong to the text around them. Work grows with a page's length, however deep its
elements are: an element knows what it adds to the features above it, and the sum of their weights.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't text of the page; elements without content; elements that interrupt a block.
SILENT = {"script", "style", "template", "title", "iframe", "select", "textarea", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BREAKS = {
    "address", "article", "aside", "audio", "blockquote", "body", "br", "button", "canvas", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "iframe", "input", "legend", "li", "link", "listing", "main", "menu", "meta", "nav", "noscript", "object", "ol", "optgroup", "option", "p",
    "picture", "plaintext", "pre", "script", "search", "section", "select", "source", "style", "summary", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr", "track", "ul", "video", "xmp",
}
#: What an opening element closes, up to what stops the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUT_OF_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"article", "aside", "body", "button", "div", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th"}
MAX_PAGES, EPOCHS, SEED = 400, 6, 7


class Element:
    """An element above blocks: what it adds to the features of those above it."""

    __slots__ = ("above", "added", "block", "score")

    def __init__(self, above: Element | None, added: tuple[str, ...], block: str):
        self.above, self.added, self.block, self.score = above, added, block, None

    def features(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out += at.added
            at = at.above
        return out


class Blocks(HTMLParser):
    """The leaf blocks of a page: (element, text, characters in links)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Element]] = []
        self.places: dict[str, list[int]] = {}  # of open elements, by name
        self.held: dict[str, int] = {}  # features of open elements, and how many have them
        self.blocks: list[tuple[Element | None, str, int]] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.anchors = 0
        self.above: Element | None = None
        self.feed(html)
        self.close()
        self._end()

    def _end(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.above, text, self.linked))
            self.parts, self.linked = [], 0

    def _pop(self, at: int):
        for name, element in self.stack[at:]:
            self.places[name].pop()
            self.silent -= name in SILENT
            self.anchors -= name == "a"
            for f in element.added:
                del self.held[f]
        del self.stack[at:]

    def _close(self, names: set, stop: set):
        """Closes the last open one of names, if none of stop is inside it."""
        last = lambda some: max((self.places[n][-1] for n in some if self.places.get(n)), default=-1)
        if (at := last(names)) >= 0 and at >= last(stop):
            self._pop(at)

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self._end()
        if tag in VOID:
            return
        if tag in OUT_OF_P:
            self._close({"p"}, SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "body":
            self._close({"head"}, {"html"})
        marks = (f"as:{t}" for k, v in attrs if k in ("class", "id", "role") and v for t in re.split(r"[\s_-]+", v.lower()) if t)
        added = tuple(f for f in dict.fromkeys((f"in:{tag}", *marks)) if f not in self.held)
        self.held.update(dict.fromkeys(added, 1))
        above = self.stack[-1][1] if self.stack else None
        block = tag if tag in BREAKS else above.block if above else "-"
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, Element(above, added, block)))
        self.silent += tag in SILENT
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self._end()
        self._close({tag}, set())

    def handle_data(self, data):
        if not self.silent:
            if not self.parts:
                self.above = self.stack[-1][1] if self.stack else None
            self.parts.append(data)
            self.linked += len(data) if self.anchors else 0


def own_features(i: int, n: int, block: tuple[Element | None, str, int]) -> list[str]:
    """The names of the features that a block has beside those of the elements above it."""
    above, text, linked = block
    words = text.count(" ") + 1
    out = ["bias", f"words:{min(words.bit_length(), 7)}", f"links:{4 * linked // (len(text) + 1)}", f"ends:{text[-1] if text[-1] in '.!?:,;' else '-'}"]
    return [*out, *(["copyright"] if "©" in text else []), f"block:{above.block if above else '-'}", f"at:{4 * i // n}"]


def features(blocks: list[tuple[Element | None, str, int]]) -> list[list[str]]:
    """The names of all features of each block."""
    return [[*(b[0].features() if b[0] else []), *own_features(i, len(blocks), b)] for i, b in enumerate(blocks)]


class Field:
    """Weights of the field: features x 2 labels, and 2 x 2 neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, turns: np.ndarray):
        self.names, self.weights, self.turns, self._of_name = names, weights, turns, None

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get, w = self.names.get, self.weights
        return np.array([w[[k for k in map(get, row) if k is not None]].sum(axis=0) for row in rows]).reshape(-1, 2)

    def block_scores(self, blocks: list[tuple[Element | None, str, int]]) -> np.ndarray:
        """scores(features(blocks)): the weights above a block are summed once for each element."""
        get = {f: tuple(self.weights[k].tolist()) for f, k in self.names.items()}.get if self._of_name is None else self._of_name
        self._of_name = get
        zero, out = (0.0, 0.0), np.empty((len(blocks), 2))
        for i, block in enumerate(blocks):
            chain, at = [], block[0]
            while at is not None and at.score is None:
                chain.append(at)
                at = at.above
            x, y = at.score if at is not None else zero
            for element in reversed(chain):
                for f in element.added:
                    w = get(f, zero)
                    x, y = x + w[0], y + w[1]
                element.score = (x, y)
            for f in own_features(i, len(blocks), block):
                w = get(f, zero)
                x, y = x + w[0], y + w[1]
            out[i] = x, y
        return out

    def decoded(self, rows: list[list[str]]) -> list[int]:
        return self.best_path(self.scores(rows))

    def best_path(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the labels of the best path."""
        if not len(scores):
            return []
        (t00, t01), (t10, t11) = self.turns.tolist()
        (a, b), *rest = scores.tolist()
        back = []
        for x, y in rest:
            back.append((int(b + t10 > a + t00), int(b + t11 > a + t01)))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def likelihood(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-likelihood of the labels, by forward and backward sums, and its gradients by weights and turns."""
        s = np.array([self.weights[row].sum(axis=0) for row in rows])
        n = len(s)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = s[0]
        for i in range(1, n):
            fore[i] = s[i] + np.logaddexp(fore[i - 1, 0] + self.turns[0], fore[i - 1, 1] + self.turns[1])
        for i in range(n - 2, -1, -1):
            z = self.turns + s[i + 1] + aft[i + 1]
            aft[i] = np.logaddexp(z[:, 0], z[:, 1])
        whole = np.logaddexp(*fore[-1])
        miss = np.eye(2)[labels] - np.exp(fore + aft - whole)
        pair = np.exp(fore[:-1, :, None] + self.turns + (s + aft)[1:, None, :] - whole).sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:-1], labels[1:]), 1)
        grad = np.zeros_like(self.weights)
        for row, m in zip(rows, miss):
            np.add.at(grad, row, m)
        own = s[np.arange(n), labels].sum() + (seen * self.turns).sum()
        return own - whole, grad, seen - pair

    @classmethod
    def trained(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, seed: int = SEED) -> Field:
        """Stochastic gradient ascent (per-weight rates) on the log-likelihood of the labels."""
        names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
        self = cls(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
        g_w, g_t, rng = np.full_like(self.weights, 1e-8), np.full((2, 2), 1e-8), np.random.default_rng(seed)
        coded = [([np.array([names[f] for f in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
        for _ in range(epochs):
            for k in rng.permutation(len(coded)):
                _, grad, turn = self.likelihood(*coded[k])
                grad -= decay * self.weights
                turn -= decay * self.turns
                g_w += grad**2
                g_t += turn**2
                self.weights += rate * grad / np.sqrt(g_w)
                self.turns += rate * turn / np.sqrt(g_t)
        return self


def labelled_pages(n: int = 240, seed: int = SEED) -> Iterator[tuple[str, list[bool]]]:
    """Made pages (html, whether each leaf block is content) of many layouts:
    the article in different containers, among menus, headers, footers, sidebars,
    notices, adverts, forms and comments, also inside the article's element."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick(["an", "er", "th", "in", "ou", "re", "st", "le", "ch", "ñ", "é", "ung", "ción"]) for _ in range(rng.randint(1, 4)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: text(1, pick([1, 3, 14])).capitalize() + pick([".", ".", ".", "?", "!", ""])
    prose = lambda: " ".join(sentence() for _ in range(pick([1, 1, 2, 4, 6])))
    mark = lambda *names: pick([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(names)} {word()}"'])

    for _ in range(n):
        labels: list[bool] = []

        def say(label: bool, inner: str) -> str:
            labels.append(label)
            return inner

        def menu(tag="nav", attr="") -> str:
            items = "".join("<li><a href='/x'>" + say(False, text(1, 3)) + "</a>" + pick(["</li>", ""]) for _ in range(rng.randint(2, 7)))
            return f"<{tag}{attr}><ul>{items}</ul></{tag}>"

        def box(tag: str, attr: str) -> str:
            inner = "".join(pick(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<p>{}"]).format(say(False, pick([sentence(), prose(), text(1, 4)]))) for _ in range(rng.randint(1, 3)))
            return f"<{tag}{attr}>{inner}</{tag}>"

        def plain(tag: str, attr: str) -> str:
            return f"<{tag}{attr}>" + say(False, pick([sentence(), prose(), text(1, 6)])) + f"</{tag}>"

        def noise(tag_names, marks) -> str:
            tag = pick(tag_names)
            attr = mark(*marks) if tag in ("div", "section", "ul", "p") or rng.random() < 0.4 else ""
            return (plain if tag == "p" else pick([box, plain]))(tag, attr)

        def form() -> str:
            return f"<form action='/s'{pick(['', mark('search', 'subscribe', 'signup', 'newsletter')])}><label>" + say(False, text(1, 4)) + "</label><input name=q><div><button>" + say(False, text(1, 2)) + "</button></div></form>"

        def comments() -> str:
            tag, attr = pick([("section", mark("comments", "discussion", "replies")), ("div", mark("comments", "comment-list", "responses", "disqus_thread")), ("ol", mark("commentlist", "comments"))])
            item = "li" if tag == "ol" else pick(["div", "article"])
            inner = "".join(f"<{item} class='comment'><p>{say(False, prose())}</p></{item}>" for _ in range(rng.randint(1, 4)))
            return f"<{tag}{attr}>{'<h2>' + say(False, text(1, 3)) + '</h2>' if rng.random() < 0.5 and tag != 'ol' else ''}{inner}</{tag}>"

        advert = lambda: noise(["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])
        notice = lambda: noise(["div", "section", "p"], ["notice", "cookie", "cookies", "consent", "alert", "gdpr", "message"])
        side = lambda: pick([lambda: noise(["aside"], ["sidebar"]), lambda: noise(["div"], ["sidebar", "side", "related", "widget", "share", "social", "recommended"]), lambda: menu("aside"), lambda: menu("div", mark("sidebar", "related", "widget", "toc"))])()
        header = lambda: pick([lambda: noise(["header"], ["header"]), lambda: noise(["div"], ["header", "masthead", "site-header", "topbar", "logo"]), menu, lambda: menu("div", mark("menu", "nav", "navbar", "navigation", "breadcrumbs"))])()
        footer = lambda: pick([lambda: plain("footer", ""), lambda: "<footer>" + say(False, "&copy; " + text(1, 4) + " &middot; " + sentence()) + "</footer>", lambda: noise(["footer"], ["footer"]), lambda: noise(["div"], ["footer", "site-footer", "copyright", "legal"]), lambda: menu("footer")])()
        any_noise = lambda: pick([advert, notice, side, form, menu])()

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.6:
                body = prose()
                if rng.random() < 0.3:
                    body = f"<b>{body}</b> {sentence()}" if rng.random() < 0.5 else f"{body} <a href='/y'>{text(1, 3)}</a> {text(1, 4)}."
                return "<p>" + say(True, body) + pick(["</p>", "</p>", ""])
            if kind < 0.7:
                return "<p><b>" + say(True, prose()) + "<br><p>" + say(True, prose()) + "</p>"
            if kind < 0.78:
                return "<ul>" + "".join("<li>" + say(True, sentence()) + "</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            if kind < 0.84:
                return "<blockquote>" + say(True, prose()) + "</blockquote>"
            if kind < 0.9:
                return "<table><tr><td>" + say(True, text(1, 3)) + "</td><td>" + say(True, text(1, 5)) + "</td></tr></table>"
            return "<h2>" + say(True, text(1, 7)) + "</h2>"

        parts = [header() for _ in range(rng.randint(0, 3))]
        parts += [any_noise() for _ in range(rng.randint(0, 2))]
        tag, attr = pick([("article", ""), ("article", ""), ("article", mark("post", "entry")), ("main", ""), ("div", mark("content", "article", "post", "entry-content", "article-body", "story", "main")), ("section", mark("content", "article", "story", "post-body"))])
        inner = []
        if rng.random() < 0.8:
            inner.append("<h1>" + say(True, text(2, 12) + pick(["", "."])) + "</h1>")
        for _ in range(rng.randint(1, 10)):
            inner.append(paragraph())
            if rng.random() < 0.08:
                inner.append(any_noise())
        if rng.random() < 0.12:
            inner.append(comments())
        body = "".join(inner)
        if rng.random() < 0.2:
            body = f"<div>{body}</div>"
        parts.append(f"<{tag}{attr}>{body}</{tag}>")
        if rng.random() < 0.35:
            parts.append(comments())
        parts += [any_noise() for _ in range(rng.randint(0, 2))]
        parts += [footer() for _ in range(rng.randint(0, 2))]
        yield f"<!DOCTYPE html><html><head><title>{text(1, 5)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", labels


def fit(pages: DataFrame | None = None, max_pages: int = MAX_PAGES, seed: int = SEED) -> Field:
    """The field of labelled pages (html string, labels array<boolean>), of
    max_pages of them at most, by a hash of the html; made pages by default. Pages whose blocks and labels differ in number are refused."""
    rows = labelled_pages(seed=seed) if pages is None else ((r["html"], r["labels"]) for r in pages.select("html", "labels").orderBy(F.xxhash64("html"), "html").limit(max_pages).collect())
    data = []
    for html, labels in rows:
        blocks = Blocks(html).blocks
        if len(blocks) != len(labels):
            raise ValueError(f"{len(blocks)} blocks have {len(labels)} labels: {html[:200]}")
        data.append((features(blocks), [int(x) for x in labels]))
    return Field.trained(data, seed=seed)


def extracted(html: str, field: Field) -> str:
    blocks = Blocks(html).blocks
    return " ".join(text for (_, text, _), label in zip(blocks, field.best_path(field.block_scores(blocks))) if label)


def _extracted(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extracted(x.as_py() or "", field) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def page_texts(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted(field or fit()), "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
