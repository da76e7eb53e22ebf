"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between block-level tags.  Every block has features of its ancestor tags and
their class and id words, of its text (length, link share, punctuation) and of its place.  A two-label field (main or
other) is trained by gradient ascent on the log-likelihood, with forward and backward sums, on labelled pages; a page is
decoded by Viterbi.  The main blocks, joined by line feeds, are the text.

Labelled pages: a bounded sample of the table itself, labelled by its landmark tags (``article`` or ``main`` against
menus, headers, footers, asides, forms and boxes named as adverts, notices or comments), and pages of several layouts
made by rule from the sample's own sentences, with and without landmarks.  In part of the training pages the landmark
features are hidden, so that the field also learns from the rest.

Defined results: null, empty and tag-free html: the text without tags is one block and is judged like any other; no
main block gives an empty text; malformed nesting is closed by the next enclosing end tag; unknown character references
stay as they are; equal rows give equal texts; extra columns are ignored; without a page to train on, the made layouts
with stock sentences are used.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.llm.words import bounded_batches
from claimsieve.session import materialize

SAMPLE_PAGES = 400
SAMPLE_CHARS = 200_000  # of a sampled page, so that the sample fits the driver; pages of any length are extracted
MAIN, OTHER = 1, 0

#: HTML element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul button textarea iframe noscript".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title svg math template iframe".split())
DROPPED_RAW = frozenset("script style svg math template iframe".split())
LANDMARKS = frozenset("article main nav header footer aside form title button noscript textarea select".split())
LISTS = frozenset("ul ol table blockquote figure dl pre".split())
NOTED = LANDMARKS | LISTS
#: Words of class and id values that tell what a box is for.
BOX_WORDS = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pager pagination".split(),
    "head": "header masthead logo brand".split(),
    "foot": "footer foot bottom copyright legal imprint".split(),
    "side": "sidebar side aside rail widget related recommended popular trending share social tags".split(),
    "notice": "notice cookie cookies consent alert popup modal newsletter subscribe signup overlay gdpr privacy".split(),
    "comment": "comment comments reply replies respond discussion disqus".split(),
    "form": "form search login subscribe contact".split(),
    "main": "article content post entry story main body text".split(),
}
_BOX = {w: k for k, ws in BOX_WORDS.items() for w in ws}
_NAME = re.compile(r"[a-zA-Z][^\s/<>\"']*")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}


@dataclass
class Block:
    text: str
    leaf: str  # innermost block-level tag
    depth: int  # number of block-level tags
    inside: frozenset[str]  # tags of NOTED around it
    boxes: frozenset[str]
    linked: int
    size: int


def _boxes(attributes: str) -> frozenset[str]:
    found = set()
    for m in _ATTR.finditer(attributes):
        found |= {_BOX[w] for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w in _BOX}
    return frozenset(found)


class _Markup:
    """Markup of one page in order, in time proportional to the page: whatever is looked for ahead is looked for once."""

    def __init__(self, html: str):
        self.html = html
        self.special = (0, -1)  # the first special character from here on is there
        self.ends: dict[int, int] = {}  # an opening quote outside of others and the end of its tag, -1 if it has none

    def _next_special(self, at: int) -> int:
        since, found = self.special
        if not since <= at <= found:
            m = _SPECIAL.search(self.html, at)
            self.special = at, m.start() if m else len(self.html)
        return self.special[1]

    def tag_end(self, at: int) -> int:
        """Position of the first ``>`` outside quotes, or -1."""
        html, passed = self.html, []
        x = self._next_special(at)
        end = -1
        while x < len(html):
            if html[x] == ">":
                end = x
                break
            if x in self.ends:
                end = self.ends[x]
                break
            passed.append(x)
            close = html.find(html[x], x + 1)
            if close < 0:
                break
            m = _SPECIAL.search(html, close + 1)
            x = m.start() if m else len(html)
        for q in passed:
            self.ends[q] = end
        return end

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """``start, end, slash, name, attributes``; comments and declarations have no name.  ``skip`` moves on."""
        html, find = self.html, self.html.find
        self.at = 0
        closes = True  # a ``>`` lies ahead
        while (lo := find("<", self.at)) >= 0:
            if html.startswith("<!--", lo):
                z = find("-->", lo + 4)
                self.at = z + 3 if z >= 0 else len(html)
                yield lo, self.at, "", "", ""
                continue
            if html.startswith(("<!", "<?"), lo):
                z = find(">", lo + 2) if closes else -1
                closes = z >= 0
                self.at = z + 1 if closes else lo + 2
                if closes:
                    yield lo, self.at, "", "", ""
                continue
            slash = "/" if html.startswith("/", lo + 1) else ""
            m = _NAME.match(html, lo + 1 + len(slash))
            z = self.tag_end(m.end()) if m else -1
            if z < 0:
                self.at = m.end() if m else lo + 1
                continue
            self.at = z + 1
            yield lo, self.at, slash, m[0].lower(), html[m.end() : z]

    def skip(self, at: int) -> None:
        self.at = at


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles and comments are left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    near = [""]  # open block-level tags
    opened: Counter[str] = Counter()  # open tags
    boxed: Counter[str] = Counter()  # kinds of open boxes
    parts: list[str] = []
    linked = 0
    around: list[frozenset[str]] = []  # noted tags and boxes, until one of them opens or closes

    def push(tag: str, boxes: frozenset[str]) -> None:
        stack.append((tag, boxes))
        opened[tag] += 1
        if boxes or tag in NOTED:
            boxed.update(boxes)
            around.clear()
        if tag in BLOCK_TAGS:
            near.append(tag)

    def pop() -> str:
        tag, boxes = stack.pop()
        opened[tag] -= 1
        if boxes or tag in NOTED:
            boxed.subtract(boxes)
            around.clear()
        if tag in BLOCK_TAGS:
            near.pop()
        return tag

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                if not around:
                    around[:] = frozenset(t for t in NOTED if opened[t] > 0), frozenset(k for k, n in boxed.items() if n > 0)
                out.append(Block(text, near[-1], len(near) - 1, *around, min(linked, len(text)), len(text)))
            parts.clear()
        linked = 0

    markup, at = _Markup(html), 0
    for start, end, slash, tag, attributes in markup:
        if start > at:
            parts.append(html[at:start])
            if opened["a"] > 0:
                linked += start - at
        at = end
        if not tag:
            continue
        if not slash:
            if tag == "br":
                parts.append(" ")
            if tag in BLOCK_TAGS:
                flush()
                if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and any(t == tag for t, _ in stack[-3:]):
                    while pop() != tag:  # an element of this kind ends the one before
                        pass
            if tag in RAW_TAGS:
                close = _END[tag].search(html, at)
                inner = html[at : close.start() if close else len(html)]
                if tag not in DROPPED_RAW:
                    push(tag, frozenset())
                    parts.append(inner)
                    flush()
                    pop()
                at = close.end() if close else len(html)
                markup.skip(at)
            elif tag not in VOID_TAGS and not attributes.endswith("/"):
                push(tag, _boxes(attributes) if attributes else frozenset())
        elif opened[tag] > 0:
            if tag in BLOCK_TAGS:
                flush()
            while pop() != tag:
                pass
        elif tag in BLOCK_TAGS:
            flush()
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def features_of(blocks: list[Block], hide: bool = False) -> list[list[str]]:
    """Names of the features that hold for each block; ``hide`` leaves out landmarks and box words."""
    out = []
    last = len(blocks) - 1
    for i, b in enumerate(blocks):
        f = ["bias", f"leaf={b.leaf}", f"depth={min(b.depth, 8)}"]
        if not hide:
            f += [f"in={t}" for t in b.inside & LANDMARKS] + [f"box={x}" for x in b.boxes]
        f += [f"in={t}" for t in b.inside & LISTS]
        words = b.text.count(" ") + 1
        f.append(f"words={min(words.bit_length(), 8)}")
        share = b.linked / max(b.size, 1)
        f.append("links=none" if share == 0 else "links=some" if share < 0.5 else "links=most")
        f.append("ends" if b.text[-1] in ".!?…。\"" else "open")
        if any(c in b.text for c in "©|»·"):
            f.append("mark")
        f.append("first" if i == 0 else "last" if i == last else "inner")
        f.append(f"place={i * 4 // max(last + 1, 1)}")
        f.append(f"before={min(blocks[i - 1].text.count(' ') // 8, 3) if i else 'none'}")
        f.append(f"after={min(blocks[i + 1].text.count(' ') // 8, 3) if i < last else 'none'}")
        out.append(f)
    return out


def landmark_labels(blocks: list[Block]) -> list[int]:
    """Labels of a page by its landmark tags and box names."""
    away = {"nav", "header", "footer", "aside", "form", "title", "button", "noscript", "textarea", "select"}
    boxes = {"ad", "menu", "foot", "side", "notice", "comment", "form"}
    return [MAIN if b.inside & {"article", "main"} and not b.inside & away and not b.boxes & boxes else OTHER for b in blocks]


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        get, w = self.names.get, self.weights
        for i, row in enumerate(rows):
            out[i] = w[[k for k in map(get, row) if k is not None]].sum(axis=0)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Best labels by Viterbi."""
        if not rows:
            return []
        s = self.scores(rows).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 >= b + m11 else (1, b + m11)
            back.append((from0[0], from1[0]))
            a, b = from0[1] + x, from1[1] + y
        label = 0 if a >= b else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train_field(pages: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; pages of equal length go through the forward and backward sums together."""
    names: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                names.setdefault(f, len(names))
    groups: dict[int, list[int]] = {}
    for i, (rows, _) in enumerate(pages):
        if rows:
            groups.setdefault(len(rows), []).append(i)
    blocks = [(i, k) for size, own in sorted(groups.items()) for i in own for k in range(size)]
    lens = np.array([len(pages[i][0][k]) for i, k in blocks], dtype=np.int64)
    cols = np.array([names[f] for i, k in blocks for f in pages[i][0][k]], dtype=np.int64)
    rowof = np.repeat(np.arange(len(blocks)), lens)
    truth = np.array([pages[i][1][k] for i, k in blocks], dtype=np.int64)
    w, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t in range(1, steps + 1):
        s = np.stack([np.bincount(rowof, w[cols, y], minlength=len(blocks)) for y in (0, 1)], axis=1)
        miss, moved = np.zeros_like(s), np.zeros_like(move)
        lo = 0
        for size, own in sorted(groups.items()):
            hi = lo + size * len(own)
            e, y = s[lo:hi].reshape(len(own), size, 2), truth[lo:hi].reshape(len(own), size)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for k in range(1, size):
                fwd[:, k] = e[:, k] + log_sum(fwd[:, k - 1, :, None] + move, 1)
            for k in range(size - 2, -1, -1):
                bwd[:, k] = log_sum(move + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            z = log_sum(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None])
            miss[lo:hi] = (np.eye(2)[y] - p).reshape(-1, 2)
            if size > 1:
                pair = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
                moved += np.bincount((y[:, :-1] * 2 + y[:, 1:]).ravel(), minlength=4).reshape(2, 2) - pair.sum(axis=(0, 1))
            lo = hi
        n = max(len(blocks), 1)
        gw = np.stack([np.bincount(cols, miss[rowof, y], minlength=len(names)) for y in (0, 1)], axis=1) / n - ridge * w
        gm = moved / n - ridge * move
        for k, (x, g) in enumerate(((w, gw), (move, gm))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(names, w, move)


_STOCK = [f"Sentence number {k} tells a little more about the subject, and it is written in plain words." for k in range(40)]


def layout_page(rng: random.Random, sentences: list[str]) -> tuple[str, list[tuple[str, int]]]:
    """A made page: html and its blocks with labels.  Layouts differ in order, tags, class names and landmarks."""
    out: list[str] = []
    truth: list[tuple[str, int]] = []
    clean = lambda x: " ".join(x.split())

    def say(label: int, tag: str, text: str, link: bool = False) -> None:
        text = clean(text)
        safe = text.replace("&", "&amp;").replace("<", "&lt;")
        out.append(f"<{tag}>" + (f'<a href="#">{safe}</a>' if link else safe) + f"</{tag}>")
        if text:
            truth.append((text, label))

    def some(lo: int, hi: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(lo, hi)))

    def short(words: int = 3) -> str:
        return " ".join(rng.choice(sentences).split()[: rng.randint(1, words)]) or "more"

    def box(kinds: list[tuple[str, str]], inside) -> None:
        tag, name = rng.choice(kinds)
        out.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
        inside()
        out.append(f"</{tag}>")

    def menu() -> None:
        out.append("<ul>")
        for _ in range(rng.randint(3, 8)):
            say(OTHER, "li", short(), True)
        out.append("</ul>")

    def comments() -> None:
        say(OTHER, "h3", short())
        for _ in range(rng.randint(1, 4)):
            say(OTHER, "p", some(1, 2))

    def form() -> None:
        say(OTHER, "label", short())
        say(OTHER, "button", short())

    def article() -> None:
        say(MAIN, "h1", short(9))
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.75:
                say(MAIN, "p", some(1, 5))
            elif kind < 0.85:
                say(MAIN, "h2", short(6))
            elif kind < 0.93:
                out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    say(MAIN, "li", some(1, 1))
                out.append("</ul>")
            else:
                say(MAIN, "blockquote", some(1, 2))
        if rng.random() < 0.2:
            box([("aside", ""), ("div", "related"), ("div", "ad"), ("div", "share")], lambda: say(OTHER, "p", short(8), rng.random() < 0.5))
            say(MAIN, "p", some(1, 4))
        if rng.random() < 0.25:
            box([("section", "comments"), ("div", "comment-list"), ("div", "replies")], comments)

    out.append("<html><head>")
    say(OTHER, "title", short(9))
    out.append("</head><body>")
    if rng.random() < 0.5:
        box([("header", ""), ("div", "masthead"), ("div", "header")], lambda: say(OTHER, "p", short(5)))
    if rng.random() < 0.8:
        box([("nav", ""), ("div", "menu"), ("div", "navbar")], menu)
    if rng.random() < 0.5:
        box([("div", "ad"), ("div", "banner"), ("div", "cookie-notice"), ("div", "newsletter"), ("div", "alert"), ("section", "promo")], lambda: say(OTHER, "p", some(1, 1)))
    box([("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry"), ("article", "story")], article)
    for chance, kinds, inside in (
        (0.35, [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related")], menu),
        (0.3, [("section", "comments"), ("div", "comments"), ("div", "discussion")], comments),
        (0.25, [("form", ""), ("div", "search"), ("form", "subscribe")], form),
        (0.9, [("footer", ""), ("div", "footer"), ("div", "copyright")], lambda: say(OTHER, "p", "© " + some(1, 1))),
    ):
        if rng.random() < chance:
            box(kinds, inside)
    out.append("</body></html>")
    return "".join(out), truth


def training_pages(sample: list[str], seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the sample and of as many made pages, a third of them without landmark features."""
    rng = random.Random(seed)
    cut = [blocks_of(h) for h in sample]
    pages = [(b, landmark_labels(b)) for b in cut if b]
    pages = [(b, y) for b, y in pages if MAIN in y]
    texts = [b.text for bs, y in pages for b, k in zip(bs, y) if k == MAIN]
    sentences = [s.strip() + "." for t in texts for s in t.split(".") if 10 <= len(s) <= 300][:4000] or _STOCK
    for _ in range(max(len(pages), 200)):
        html, truth = layout_page(rng, sentences)
        bs = blocks_of(html)
        if [b.text for b in bs] == [t for t, _ in truth]:
            pages.append((bs, [y for _, y in truth]))
    return [(features_of(b, hide=i % 6 == 0), y) for i, (b, y) in enumerate(pages)]


def fit_field(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Field:
    """Train on at most ``rows`` pages shorter than ``chars`` characters, those with the smallest hash of ``page_id`` (of a repeated id the least html), and
    on made pages.  Ids are chosen first, so only the html of chosen pages is moved."""
    usable = pages.filter(F.col("page_id").isNotNull() & F.col("html").isNotNull() & (F.length("html") < chars)).select("page_id", "html")
    chosen = materialize(usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows), "chosen-pages")
    some = usable.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))  # bounded by rows
    return train_field(training_pages([r["html"] for r in some.orderBy(F.xxhash64("page_id"), "page_id").collect()]))  # bounded by rows


def main_text(html: str, field: Field) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features_of(blocks))) if y == MAIN)


def extract_pages(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", sent.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    out = pages.select("page_id", "url", F.col("html").cast("string").alias("_h")).mapInArrow(read, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
