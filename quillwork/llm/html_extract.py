"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, trained on labelled pages and decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow_batches, small_batches, trimmed
from .crf import ChainCRF

_NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
_RAW = set("script style noscript template textarea title svg math select iframe object".split())
_SPECIAL = re.compile("[>\"']")
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_OUTSIDE = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "button": 4, "menu": 0, "dialog": 3}
_KIND = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = (
    re.compile(r"(?<![a-z])(?:nav|navbar|menu|breadcrumbs?|topbar|toolbar|pagination|pager|tabs|masthead)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|aside|widget|related|social|share|newsletter|subscribe|signup|popup|modal|cookies?|consent|notice|alert|gdpr|disclaimer|copyright|footer|header)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:comments?|replies|reply|respond|disqus|discussion)(?![a-z])"),
    re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|body|text)(?![a-z])"),
)
_NAMES = ("nav", "header", "footer", "aside", "form", "article", "main", "list", "heading", "paragraph", "cell", "k_nav", "k_extra", "k_comment", "k_content")
N_FEATURES = len(_NAMES) + 9
_SLICE = 1 << 20


def tags(source: str):
    """(start, end, tag, attributes, whether it closes) of each piece of markup, in order; tag is "" where the piece means nothing.

    One forward scan. A tag ends at the first > outside quotes, or at the first > of all if there is none. Where the quotes of one
    tag lead nowhere is remembered, so that no part of the page is looked through once for every tag before it. Comments and raw
    elements (scripts, styles ...) are one piece, up to their end or the page's.
    """
    special = [m.start() for m in _SPECIAL.finditer(source)]
    closing, last = [-1] * len(special), {}
    for i in range(len(special) - 1, -1, -1):
        c = source[special[i]]
        closing[i] = last.get(c, -1)
        last[c] = i
    dead = bytearray(len(special))
    final = source.rfind(">")
    at = source.find("<")
    while at >= 0:
        end, tag, attributes, closes = -1, "", "", False
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
        elif at > final:
            break
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
        elif m := _NAME.match(source, at):
            tag, closes = m[1].lower(), source[at + 1] == "/"
            first = i = bisect_left(special, m.end())
            while 0 <= i < len(special) and not dead[i] and source[special[i]] != ">":
                i = closing[i] + 1 if closing[i] >= 0 else -1
            if 0 <= i < len(special) and not dead[i]:
                end = special[i] + 1
                attributes = source[m.end() : end - 1]
            else:
                i = first
                while 0 <= i < len(special) and not dead[i]:
                    dead[i] = 1
                    i = closing[i] + 1 if closing[i] >= 0 else -1
                end, tag = source.find(">", at) + 1, ""
            if tag in _RAW and not closes and not (attributes.endswith("/") and tag in ("svg", "math")):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(source, end)
                end, tag = stop.end() if stop else len(source), ""
        if end < 0:
            at = source.find("<", at + 1)
            continue
        yield at, end, tag, attributes, closes
        at = source.find("<", end)


def _marks(tag: str, attributes: str) -> int:
    """What an element says about the blocks in it, as bits in the order of _NAMES."""
    marks = 0
    if tag in _OUTSIDE:
        marks = 1 << _OUTSIDE[tag]
    elif tag in ("article", "main"):
        marks = 1 << (5 if tag == "article" else 6)
    elif tag in ("ul", "ol", "dl", "li"):
        marks = 1 << 7
    elif tag in _HEADINGS:
        marks = 1 << 8
    elif tag in ("p", "blockquote", "pre"):
        marks = 1 << 9
    elif tag in ("td", "th"):
        marks = 1 << 10
    if "=" in attributes:
        names = " ".join(x.lower() for x in _KIND.findall(attributes))
        for k, w in enumerate(_WORDS):
            if names and w.search(names):
                marks |= 1 << 11 + k
    return marks


class _Open:
    """The open elements of a page, with the marks of all of them together, and how many are links."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []  # tag, marks of it and those around it, whether it is a block
        self.blocks: list[int] = []  # where the blocks stand
        self.count: Counter = Counter()  # blocks by tag; inline elements by their block and tag
        self.links = 0

    @property
    def marks(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, tag: str, marks: int) -> None:
        inline = tag in _INLINE
        self.count[(len(self.blocks), tag) if inline else tag] += 1
        if not inline:
            self.blocks.append(len(self.stack))
        self.links += tag == "a"
        self.stack.append((tag, self.marks | marks, not inline))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag, _, block = self.stack.pop()
            if block:
                self.blocks.pop()
            self.count[tag if block else (len(self.blocks), tag)] -= 1
            self.links -= tag == "a"

    def close(self, tag: str) -> None:
        """The innermost open element of this name ends with all in it; an inline one only within its block."""
        if self.count[(len(self.blocks), tag) if tag in _INLINE else tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def begin_block(self, tag: str) -> None:
        """What a block ends by beginning: a paragraph, or a list item, cell or row of its own kind."""
        if self.blocks:
            around = self.stack[self.blocks[-1]][0]
            if around == "p" or around == tag and tag in ("li", "td", "th", "tr", "option", "dt", "dd"):
                self.cut(self.blocks[-1])


def blocks(source: str) -> list[tuple[str, int, float]]:
    """Leaf blocks in page order: text (character references decoded, white space single), ancestor marks, link share.

    A block ends at any tag that is not inline; a paragraph also ends where another block begins. Comments, scripts, styles,
    the head's title and other raw elements hold no text. Unclosed elements last to the end of what encloses them. The work grows
    in proportion to the page.
    """
    out: list[tuple[str, int, float]] = []
    open_ = _Open()
    parts: list[str] = []
    linked = done = 0

    def flush() -> None:
        nonlocal parts, linked
        text = "".join(parts)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            out.append((text, open_.marks, min(1.0, linked / len(text))))
        parts, linked = [], 0

    for start, end, tag, attributes, closes in tags(source):
        if start > done:
            parts.append(source[done:start])
            linked += len(parts[-1].strip()) if open_.links else 0
        done = end
        if not tag:
            continue
        if tag == "br" and not closes:
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if closes:
            open_.close(tag)
            continue
        if tag not in _INLINE:
            open_.begin_block(tag)
        if tag in _VOID or tag in ("html", "body") or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        open_.push(tag, 0 if tag == "head" else _marks(tag, attributes))
    if done < len(source):
        parts.append(source[done:])
        linked += len(parts[-1].strip()) if open_.links else 0
    flush()
    return out


_SHIFTS = np.arange(len(_NAMES))
_AWAY, _WITHIN = sum(1 << k for k in (0, 1, 2, 3, 4, 11, 12, 13)), sum(1 << k for k in (5, 6, 14))


def features(page: list[tuple[str, int, float]]) -> np.ndarray:
    """A row for each block: ancestor marks, and what its text looks like."""
    x = np.zeros((len(page), N_FEATURES))
    for row, (text, marks, link) in zip(x, page):
        row[: len(_NAMES)] = marks >> _SHIFTS & 1
        n = text.count(" ") + 1
        row[-9:] = np.log1p(n), link, text[-1] in ".!?:;\"'”»", "©" in text or "(c)" in text, n < 4, sum(map(str.isdigit, text)) / len(text), text.count(",") / n, bool(marks & _WITHIN) and not marks & _AWAY, bool(marks & _AWAY)
    return x


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """n generated pages with the truth of each leaf block, in page order (True: main text)."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice(["ba", "lo", "ti", "ren", "su", "mo", "kal", "ve", "de", "or", "in"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(4, 18).capitalize() + r.choice([".", ".", ".", "!", "?"])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.randint(1, 5))) if r.random() < 0.9 else words(1, 4)

    out = []
    for _ in range(n):
        page, truth = [], []

        def add(markup: str, *kinds: bool) -> None:
            page.append(markup)
            truth.extend(kinds)

        def links(k: int, tag: str = "li") -> str:
            return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(k))

        if r.random() < 0.3:
            k = r.randint(1, 3)
            add(f'<{r.choice(["header", "div class=header", "div id=masthead"])}>' + "".join(f"<p>{words(1, 6)}</p>" for _ in range(k)) + "</header></div>", *[False] * k)
        if r.random() < 0.8:
            k = r.randint(2, 8)
            add(r.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="navbar">{}</ul>']).format(links(k)), *[False] * k)
        if r.random() < 0.6:
            add(f'<div class="{r.choice(["ad", "ads", "advert", "promo", "sponsored", "cookie-notice", "banner", "alert"])}">{paragraph()}</div>', False)
        opened, closed = r.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="entry">', "</div>")])
        page.append(opened)
        add(f"<h1>{words(2, 10)}</h1>", True)
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                add(f"<p>{paragraph()}" + r.choice(["</p>", "</p>", ""]), True)
            elif kind < 0.8:
                add(f"<h2>{words(1, 6)}</h2>", True)
            elif kind < 0.86:
                k = r.randint(2, 5)
                add("<ul>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(k)) + "</ul>", *[True] * k)
            elif kind < 0.9:
                add(f"<blockquote>{paragraph()}</blockquote>", True)
            elif kind < 0.94:
                add(f'<div class="{r.choice(["ad", "advert", "related", "share", "newsletter"])}">{paragraph()}</div>', False)
            elif kind < 0.97:
                add(f"<aside>{paragraph()}</aside>", False)
            else:
                add(f"<table><tr><td>{words(1, 5)}<td>{words(1, 5)}</table>", True, True)
        page.append(closed)
        if r.random() < 0.4:
            k = r.randint(1, 5)
            add(f'<{r.choice(["section", "div"])} class="{r.choice(["comments", "comment-list", "replies"])}">' + "".join(f"<p>{paragraph()}</p>" for _ in range(k)) + "</section></div>", *[False] * k)
        if r.random() < 0.4:
            k = r.randint(1, 4)
            add(r.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>']).format("".join(f"<p>{words(2, 20)}</p>" for _ in range(k))), *[False] * k)
        if r.random() < 0.3:
            add(f"<form><p>{words(1, 6)}</p><input><button>{words(1, 2)}</button></form>", False, False)
        if r.random() < 0.8:
            add(f'<{r.choice(["footer", "div class=footer"])}>&copy; {words(1, 4)} &middot; {sentence()}</footer></div>', False)
        out.append(("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(page) + "</body></html>", truth))
    return out


def train(pages: list[tuple[str, list[bool]]] | None = None) -> ChainCRF:
    """The CRF fitted on labelled pages (source, truth of each block); by default on labelled_pages()."""
    xs, ys = [], []
    for source, truth in labelled_pages() if pages is None else pages:
        found = blocks(source)
        if len(found) != len(truth):
            raise ValueError("a labelled page needs a label for each leaf block")
        xs.append(features(found))
        ys.append(np.array(truth, int))
    return ChainCRF(N_FEATURES).fit(np.concatenate(xs), np.concatenate(ys), np.append(0, np.cumsum([len(x) for x in xs])))


def extracted(pages: DataFrame, crf: ChainCRF) -> DataFrame:
    """page_id, url, text (content blocks joined by a blank line, empty if none), n_chars, n_blocks for each row of pages.

    Null or empty html has no text. Pages are taken one by one, so repeated rows, ties and null ids change nothing; other columns of
    pages, whatever their names, aren't looked at; a very long page comes alone in its batch; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE, "html"):
                found = [blocks(h or "") for h in batch.column(2).to_pylist()]
                first = np.append(0, np.cumsum([len(f) for f in found]))
                state = crf.decode(np.concatenate([features(f) for f in found]), first)
                texts = ["\n\n".join(b[0] for b, s in zip(f, state[k:]) if s) for f, k in zip(found, first)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(first).astype(np.int64))], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return small_batches(rows).mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long, n_blocks long")
