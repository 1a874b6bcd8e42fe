"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with its root-to-leaf path of block
elements. What says itself that it is no article, by its element, role, class
or id (menus, footers, adverts, forms, notices, comments), is left out first.
Where the page marks an article or a main part, all that is left in it is kept:
linked headlines, tables and lists too.

On other pages blocks are judged by path. For each path the text length outside links and
the punctuation are summed and divided by its number of blocks. Both ratios,
laid out in page order, are smoothed over neighbouring blocks, so that a heading
gains from the paragraphs below it, fused by their geometric mean, averaged over
the blocks of a path again, and lowered by the path's share of link text. Paths at ``THRESHOLD`` of the page's mean or
above are content, and all blocks of such a path are kept, however short.

A null page is empty, and a page without text has the empty string. Unclosed
and stray tags, references without a semicolon and cut-off pages are read
leniently. Pages are independent rows, of any length; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tablewright.llm.common import map_exactly

THRESHOLD = 0.12
NEIGHBOURS = (0.25, 0.5, 0.25)

#: Element names, and words in class, id and role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object", "math")
BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr"
    " td th blockquote pre header footer nav aside form fieldset figure figcaption address details summary hgroup menu"
    " dialog center search legend label button".split()
)
BREAKS = frozenset(("br", "hr", "img", "wbr", "input"))
OUTSIDE = frozenset("head nav footer aside form menu dialog button search fieldset".split())
INSIDE = frozenset(("article", "main"))
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices alert popup modal overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs"
    " pagination pager footer foot copyright legal share sharing social related recommended recommendations newsletter"
    " subscribe subscription signup login search widget widgets comment comments commentlist reply replies respond"
    " disqus complementary contentinfo dialog form toolbar skip masthead".split()
)
HEADER_WORDS = frozenset(("header", "head", "topbar", "banner"))
#: An opening of the first kind ends one of the second that is still open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset(("ul", "ol", "dl", "table", "menu"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


class Page:
    """Blocks of one page: (path, text, length outside links, stands inside an article)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.open: list[tuple[str, str, bool, bool]] = []  # name, path, left out, inside
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.links = 0
        at = 0
        for token in TOKEN.finditer(source):
            if token.start() > at:
                self._text(source[at : token.start()])
            at = token.end()
            name = token[3] or token[6]
            if name:
                close = token[2] if token[3] else token[5]
                self._tag(name.lower(), bool(close), (token[4] if token[3] else token[7]) or "")
        if at < len(source):
            self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.parts.append(raw)
        if self.links:
            self.link_parts.append(raw)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, path, _, inside = self.open[-1] if self.open else ("", "", False, False)
                linked = len(" ".join(html.unescape("".join(self.link_parts)).split())) if self.link_parts else 0
                self.blocks.append((path, text, max(0, len(text) - linked), inside))
            self.parts, self.link_parts = [], []

    def _tag(self, name: str, close: bool, attributes: str) -> None:
        if name in BREAKS:
            self._text(" ")
        elif name not in BLOCKS:
            if name == "a":
                self.links = 0 if close else 1
        elif close:
            names = [o[0] for o in self.open]
            if name in names:
                self._flush()
                del self.open[len(names) - 1 - names[::-1].index(name) :]
                self.links = 0
        else:
            self._flush()
            self.links = 0
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in SCOPES or name not in ENDS:
                    break
                if self.open[i][0] in ENDS[name]:
                    del self.open[i:]
                    break
            _, path, out, inside = self.open[-1] if self.open else ("", "", False, False)
            words, label = self._words(attributes)
            inside = inside or name in INSIDE
            out = (
                out or name in OUTSIDE or name not in ("html", "body", "article", "main") and bool(words & OUTSIDE_WORDS)
                or not inside and (name == "header" or bool(words & HEADER_WORDS) and name not in ("html", "body"))
                or bool(attributes) and HIDDEN.search(attributes) is not None
            )
            self.open.append((name, f"{path}/{name}{label}", out, inside))

    @staticmethod
    def _words(attributes: str) -> tuple[frozenset[str], str]:
        if not attributes:
            return frozenset(), ""
        found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)]
        words = frozenset(w for _, v in found for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if w)
        return words, next((f".{v.split()[0]}" for k, v in found if k == "class" and v.split()), "")


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page: its blocks in order, two line breaks between them."""
    blocks = Page(source or "").blocks
    if any(b[3] for b in blocks):
        return "\n\n".join(text for _, text, _, inside in blocks if inside)
    if not blocks:
        return ""
    length, marks, number, whole = defaultdict(float), defaultdict(float), defaultdict(int), defaultdict(int)
    for path, text, own, _ in blocks:
        length[path] += own
        whole[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text)) * own / len(text)
        number[path] += 1
    lengths = smooth([length[p] / number[p] for p, *_ in blocks])
    points = smooth([(marks[p] + 0.5) / number[p] for p, *_ in blocks])
    fused = [(a * b) ** 0.5 for a, b in zip(lengths, points, strict=True)]
    total = defaultdict(float)
    for (path, *_), value in zip(blocks, fused, strict=True):
        total[path] += value * length[path] / whole[path]
    mean = sum(fused) / len(fused)
    return "\n\n".join(text for path, text, *_ in blocks if total[path] / number[path] >= threshold * mean)


def smooth(values: list[float]) -> list[float]:
    """Each value with its neighbours; the ends stand for what is beyond them."""
    before, own, after = NEIGHBOURS
    padded = [values[0], *values, values[-1]]
    return [before * padded[i] + own * padded[i + 1] + after * padded[i + 2] for i in range(len(values))]


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    kinds = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, threshold) for h in frame["html"]]
            yield pd.DataFrame({
                "page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts],
            })

    return map_exactly(
        pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
