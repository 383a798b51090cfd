"""Main text of web pages: parser events make lines, and text-to-tag ratios choose the regions that are content.

A line is what stands between two block tags. Its ratio is its characters by its tags; the ratios are smoothed with a
Gaussian, and lines at or above one standard deviation of them are the content cluster. The region is the smallest element
that holds the cluster; an article or main element widens or splits it where such elements hold most of the cluster. All
lines of the region are kept, however short.

What is around the text is told by marks. Menus, footers and sidebars that have elements or roles of their own, and
readers' comments, are out for sure. Names (whole words of ids and classes), forms and headers are weak evidence only: where an element
so marked holds half of the cluster or more, and no article or main element is elsewhere, the ratios overrule the mark.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onefold.llm import common

RESULT = "page_id long, url string, text string, n_chars long"

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SILENT = frozenset("script style noscript template head iframe object svg math canvas audio video button select textarea datalist map title".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
LANDMARKS = ("article", "main")
OUT_TAGS = frozenset("nav footer aside menu search".split())
DOUBTFUL_TAGS = frozenset("header form dialog".split())
OUT_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar".split())
DOUBTFUL_ROLES = frozenset("banner form dialog alert alertdialog".split())
#: Start tags that end an open p; start tags that end elements like themselves, up to the list or table around them.
ENDS_P = BLOCKS - frozenset("body caption dd dt frameset head html legend li optgroup option select tbody td tfoot th thead title tr".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",))}
P_SCOPE = ("caption", "table", "td", "th", "template", "object", "button")
#: Words of names for what is around a text, readers' comments by themselves, and words that such names also have.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
FILLING = frozenset("area bar block bottom box buttons container content form global google inner item items left links list main message page posts primary right secondary section site slot thread top unit widget wrapper".split())
#: Elements whose classes are looked at, and those whose ids are: an id elsewhere is where a link leads to.
NAMED = BLOCKS - frozenset(("html", "body", "main", *HEADINGS))
BY_ID = frozenset("article aside div dl fieldset footer form header nav ol section table ul".split())

SIGMA, RADIUS = 1.0, 2
#: A line with more of its characters in links is no text at the edges of a region that is no landmark.
LINKS = 0.6
#: Lines that may stand between a heading and the region that it belongs to.
BYLINES = 3

#: Marks of elements.
FORMS, NAME, OUT = 1, 2, 3

_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_BETWEEN = re.compile(r"[-_]+")


def named(value: str, inner: bool) -> int:
    """The mark that an id or class gives: every part of one of its names must be a word of NAMES, COMMENTS or FILLING, and one none of FILLING."""
    found = 0
    for name in value.lower().split():
        parts = set(_BETWEEN.split(name)) - {""}
        telling = parts - FILLING
        if telling & COMMENTS and telling <= COMMENTS | NAMES:
            return OUT
        if telling and telling <= NAMES and not (inner and telling == {"header"}):
            found = NAME
    return found


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int
    heading: bool
    element: int


class Lines(HTMLParser):
    """Reads a page into lines. Elements are numbered as they open; parent[i] is the element around element i, mark[i] its mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.mark = [0], [0]
        self.landmark: dict[int, str] = {}
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, number, silent, silent as far as the next block
        self.at: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
        self.blocks = [0]
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.in_link = False

    def _depth(self, names: tuple[str, ...]) -> int:
        """Where the innermost open element of these names is; 0 if there is none."""
        return max((self.at[name][-1] for name in names if self.at[name]), default=0)

    def _flush(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.lines.append(Line(text, max(1, self.tags), self.links, any(self.at[h] for h in HEADINGS), self.stack[-1][1]))
        self.parts, self.tags, self.links = [], 0, 0

    def _judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
        """The mark of an element, and whether its text is never shown."""
        inner = bool(self._depth(LANDMARKS))
        mark = OUT if tag in OUT_TAGS else FORMS if tag in DOUBTFUL_TAGS and not (tag == "header" and inner) else 0
        for key, value in attrs:
            value = value or ""
            if key == "role":
                role = value.lower()
                mark = max(mark, OUT if role in OUT_ROLES else FORMS if role in DOUBTFUL_ROLES else 0)
            elif key == "class" and (tag in NAMED or tag not in BLOCKS) or key == "id" and tag in BY_ID:
                mark = max(mark, named(value, inner))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return mark, True
        return mark, tag in SILENT

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag not in IN_HEAD and self.at["head"]:
            self._pop_to(self.at["head"][-1])
        self.tags += 1
        if tag in ENDS_P and (p := self._depth(("p",))) and p > self._depth(P_SCOPE):
            self._pop_to(p)
        if tag in ENDS and (same := self._depth(ENDS[tag][0])) and same > self._depth(ENDS[tag][1]):
            self._pop_to(same)
        if tag in VOID:
            return
        _, around, silent, aside = self.stack[-1]
        mark, gone = self._judged(tag, attrs)
        number = around
        if block:
            number, aside = len(self.parent), False
            self.parent.append(around)
            self.mark.append(mark)
            self.blocks.append(len(self.stack))
            if tag in LANDMARKS:
                self.landmark[number] = tag
        self.in_link |= tag == "a"
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, number, silent or gone, aside or not block and bool(mark)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash says nothing but on void elements

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            self.in_link &= tag != "a"
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
        self.tags += 1
        self.in_link &= tag != "a"
        if (depth := self._depth((tag,))) and (block or depth > self.blocks[-1]):  # bold type doesn't end the blocks in it
            self._pop_to(depth)

    def handle_data(self, data: str) -> None:
        if self.at["head"] and self.stack[-1][0] == "head" and not data.isspace():
            self._pop_to(self.at["head"][-1])
        if self.stack[-1][2] or self.stack[-1][3]:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    weights = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    padded = np.pad(ratios, RADIUS)
    inside = np.pad(np.ones(len(ratios)), RADIUS)
    return np.convolve(padded, weights, "valid") / np.convolve(inside, weights, "valid")


class _Page:
    """The lines of a page, which of them are content by their ratios, and which are shown."""

    def __init__(self, parser: Lines):
        self.lines, self.parent, self.mark, self.landmark = parser.lines, parser.parent, list(parser.mark), parser.landmark
        self.element = [x.element for x in self.lines]
        smooth = smoothed(np.array([len(x.text) / x.tags for x in self.lines]))
        by_ratio = smooth >= smooth.std()
        open_to_doubt = ~self.out({OUT})
        weight = self.weights(by_ratio & open_to_doubt)
        within = self.spread({i: i for i in self.landmark})
        landmarks = self.weights(np.array([within[e] > 0 for e in self.element], bool) & open_to_doubt)
        for i, mark in enumerate(self.mark):
            if mark in (FORMS, NAME) and 2 * weight[i] >= weight[0] > 0 and (within[i] or landmarks[i] == landmarks[0]):
                self.mark[i] = 0
        self.shown = ~self.out({FORMS, NAME, OUT})
        self.content = by_ratio & self.shown if (by_ratio & self.shown).any() else self.shown

    def spread(self, own: dict[int, int] | list[int], undone: bool = False) -> list[int]:
        """For each element the value of `own` that is not 0 of the innermost element around it, itself included."""
        found = [0] * len(self.parent)
        for i in range(len(found)):
            inherited = found[self.parent[i]] if i else 0
            if undone and inherited == FORMS and i in self.landmark:
                inherited = 0
            found[i] = max(own[i], inherited) if undone else (own.get(i, 0) or inherited)
        return found

    def out(self, marks: set[int]) -> np.ndarray:
        """Which lines are in an element with one of these marks. A landmark in a form or header is out of it."""
        state = self.spread([m if m in marks else 0 for m in self.mark], undone=True)
        return np.array([state[e] > 0 for e in self.element], bool)

    def weights(self, lines: np.ndarray) -> list[int]:
        """The characters of these lines in each element."""
        return self._summed([len(x.text) if c else 0 for x, c in zip(self.lines, lines, strict=True)])

    def _summed(self, values: list[int]) -> list[int]:
        found = [0] * len(self.parent)
        for e, value in zip(self.element, values, strict=True):
            found[e] += value
        for i in range(len(found) - 1, 0, -1):
            found[self.parent[i]] += found[i]
        return found

    def regions(self) -> np.ndarray:
        """Which lines are in the regions that the content cluster selects."""
        plain = np.array([self._plain(i) for i in range(len(self.lines))])
        content = self.content & plain if (self.content & plain).any() else self.content
        weight = self.weights(content)
        for kind in LANDMARKS:
            roots = {i: i for i, tag in self.landmark.items() if tag == kind and weight[i]}
            within = self.spread(roots)
            held = np.array([within[e] > 0 for e in self.element], bool)
            if 2 * sum(len(x.text) for x, c in zip(self.lines, held & content, strict=True) if c) >= weight[0]:
                return held
        region = max(i for i, w in enumerate(weight) if w == weight[0])  # the deepest is the last to open
        shown = self._summed([int(s) for s in self.shown])
        while region and shown[region] < 2:  # a block alone is no region: what stands around it may be its heading
            region = self.parent[region]
        within = self.spread({region: region} if region else {0: 1})
        held = np.array([within[e] > 0 for e in self.element], bool)
        lines = np.flatnonzero(held & self.shown)
        before = [i for i in np.flatnonzero(self.shown[: lines[0]])[-BYLINES - 1 :] if plain[i]]
        for k, i in enumerate(before):
            if self.lines[i].heading:
                held[before[k:]] = True
                break
        ends = np.flatnonzero(held & self.shown & plain)
        if len(ends):
            held[: ends[0]] = held[ends[-1] + 1 :] = False
        return held

    def _plain(self, i: int) -> bool:
        return self.lines[i].links <= LINKS * len(self.lines[i].text)


def main_text(page: str) -> str:
    """The main text of one page: blocks in page order, joined by one space; empty if there is none."""
    parser = Lines()
    parser.feed(_CUT_TAG.sub("", page))
    parser.close()
    if not parser.lines:
        return ""
    found = _Page(parser)
    if not found.shown.any():
        return ""
    return " ".join(x.text for x, held, shown in zip(found.lines, found.regions(), found.shown, strict=True) if held and shown)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in common.steps(batches, "html"):
        texts = [main_text(page) for page in step.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([step.column("page_id"), step.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """`RESULT` for every row of `pages` (page_id, url, html), from the whole html.

    Null and empty html give an empty text, as does a page without main text; a null page_id or url stays null; repeated
    rows are read each by itself; other columns are ignored, whatever their names. A tag that the page's end cuts off
    is no text. An empty table gives no rows.
    """
    columns = [pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), common.text_of(pages, "html").alias("html")]
    return pages.select(*columns).mapInArrow(_extracted, RESULT)
