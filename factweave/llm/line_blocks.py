r"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block, and each line weighs its
characters.  What is no article text by its element (menus, footers, asides,
forms, scripts, styles) or by a whole word of its class, id or role leaves one
empty line.  The distribution sums weights over sliding windows of ``WINDOW``
lines.  It surges at the first weighty line, dives where a whole window weighs
nothing, and text lies between.

The sums decide what names can't:

- A menu without a name is two link lines or more side by side, or one line
  of several links; it weighs nothing, so it ends a region or leaves a hole.
  A single link line weighs nothing either, but stays where text around it
  keeps the windows filled.
- An element whose name holds a doubtful word in a compound (``related-work``,
  ``social-history``) stays if its own windows reach ``SURGE`` characters that
  are no links, and goes if they don't.
- A region whose windows never reach ``SURGE`` (or the page's highest sum, if
  that is less) stays only for a paragraph or heading in it; bare scraps such
  as a date or a label between menus go.

If the page has an article or main element with text, lines outside have no
weight.  Without one, an element that holds most of the page's text is not
taken out for its class, id or role (but hidden ones and reader comments are),
nor is such a form.

Defined results: a null or empty page has the empty text; repeated rows
repeat; character references are decoded once; white space inside a block
becomes one space; blocks are joined by one newline.  Null ids stay null.
Malformed tags are text, and any page takes time in proportion to its length.
Only the three columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: Characters of a window in which body text stands: about a line and a half of print.
SURGE = 80
#: A link line is one with at least this share of its characters in links.
LINK_SHARE = 0.5
ENDS = tuple(".!?:;…。！？\"'”’»)")
#: Rounds of opening elements that hold most of a page's text, before names count for nothing.
OPENINGS = 6

#: HTML elements that never hold article text.
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select textarea "
    "dialog menu title option datalist".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input".split()
)
MAIN = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
#: Words that tell boilerplate, alone or in a compound name.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored nav navbar navigation menubar breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal newsletter subscribe signup comments "
    "disqus pagination pager login complementary contentinfo".split()
)
#: Words that tell boilerplate alone; in a compound the distribution decides.
DOUBTFUL = frozenset(
    "promo promotion banner menu header notice overlay subscription share sharing social related recommended comment "
    "respond reply replies widget toolbar search hidden".split()
)
#: Words of layout: beside one that tells boilerplate they leave it alone; any other word makes the name doubtful.
LAYOUT = frozenset(
    "box bar slot unit block wrap wrapper container inner outer area panel section list links item items row col column left right top bottom main site page global "
    "primary secondary mobile desktop sticky fixed content text body form button icon image img card head title link module zone region group set holder frame js u c l".split()
)
#: Words that stay shut where an article begins in them or most text lies in them: comments hold articles of their own in some pages.
_CLOSED = frozenset("comment comments respond disqus reply replies related recommended".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.DOTALL)
_TO_VALUE = re.compile(r"[^=>]*+(?:=\s*+)?+")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?")
_PARTS = re.compile(r"[a-z]+")
#: Class names that tell what a page has or lacks, not what the element is.
_STATE = re.compile(r"(?:has|have|no|not|non|with|without|is|hide|show|enable|disable)[-_]|.*[-_](?:enabled|disabled|open|closed|visible|active|on|off|none)\Z")
_TITLED = frozenset("article entry post story content page title".split())
_UNSEEN = re.compile(r"display\s*:\s*none")


class Line(NamedTuple):
    text: str
    linked: int = 0
    anchors: int = 0
    tag: str = ""
    inside: bool = False
    doubt: int = 0


EMPTY = Line("")


def judged(name: str, attributes: str, in_main: bool) -> tuple[str | None, bool]:
    """(word that speaks against an element, or None; whether it is only doubtful)."""
    if name in DROPPED or (name == "header" and not in_main):
        return name, False
    if not attributes or name in ("html", "body", "article", "main") or name in VOID:
        return None, False
    doubtful = None
    for m in _ATTRIBUTE.finditer(attributes.lower()):
        key, value = m.group(1), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return "hidden", False
        if key not in ("class", "id", "role"):
            continue
        for token in value.split():
            if _STATE.match(token):
                continue
            parts = _PARTS.findall(token)
            for word in parts:
                if word in BOILERPLATE:
                    if all(p in BOILERPLATE or p in DOUBTFUL or p in LAYOUT for p in parts):
                        return word, False
                    doubtful = word
                if word in DOUBTFUL and not (word in ("header", "banner") and (in_main or _TITLED.intersection(parts))):
                    if token == word and (not in_main or word in _CLOSED):
                        return word, False
                    doubtful = word
    return doubtful, True


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    attributes: str


class _Tags:
    """The tags of a page, each found in one walk over its attributes: of any number, with quoted values of any length."""

    def __init__(self, page: str):
        self.page = page
        self.none_from = {'"': len(page), "'": len(page), ">": len(page)}  # behind these places there is no such character

    def find(self, mark: str, at: int) -> int:
        """The next ``mark``, or -1; what once was searched in vain is not searched again."""
        if at >= self.none_from[mark]:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none_from[mark] = at
        return found

    def close_of(self, at: int) -> int:
        """The bracket that ends a tag whose name ends at ``at``: none within a quoted value, which follows an equals sign; -1 if there is none.

        A quote that is never closed begins no value.
        """
        while True:
            at = _TO_VALUE.match(self.page, at).end()
            if at >= len(self.page):
                return -1
            mark = self.page[at]
            if mark == ">" and self.page[at - 1] != "=":
                return at
            if mark in "\"'" and (ended := self.find(mark, at + 1)) >= 0:
                at = ended + 1
            elif mark == ">":
                return at
            else:
                at += mark in "\"'"

    def next(self, at: int) -> Tag | None:
        """The first tag, comment or declaration from ``at`` on; the last two have no name."""
        while m := _TAG.search(self.page, at):
            if not m.group(2):
                return Tag(m.start(), m.end(), False, "", "")
            end = self.close_of(m.end()) if self.find(">", m.end()) >= 0 else -1
            if end >= 0:
                return Tag(m.start(), end + 1, bool(m.group(1)), m.group(2).lower(), self.page[m.end() : end])
            at = m.end()
        return None


class _Page:
    """The lines of a page, and of each element taken out its place, its characters of text and whether it may be opened."""

    def __init__(self, page: str, opened: set[int], by_name: bool):
        self.lines: list[Line] = []
        self.out: list[tuple[int, int, bool]] = []
        self.parts: list[str] = []
        self.tag, self.linked, self.anchors, self.links, self.mains = "", 0, 0, 0, 0
        self.doubts, self.doubt, self.doubt_tag, self.doubt_depth = 0, 0, "", 0
        self.no_end: set[str] = set()
        self.read(page, opened, by_name)

    def close(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.lines.append(Line(text, self.linked, max(self.anchors, int(self.links > 0)), self.tag, self.mains > 0, self.doubt))
            self.parts.clear()
        self.linked = self.anchors = 0
        self.tag = ""

    def gap(self) -> None:
        """One empty line, however many elements are taken out side by side."""
        self.close()
        if self.lines and self.lines[-1].text:
            self.lines.append(EMPTY)

    def after_raw(self, page: str, name: str, at: int) -> int:
        """Behind the end tag of an element without markup, or 0 if there is none."""
        if name in self.no_end:
            return 0
        ended = re.compile(rf"</{name}(?=[\s/>])[^<>]*+>", re.IGNORECASE).search(page, at)
        if not ended:
            self.no_end.add(name)
            return 0
        return ended.end()

    def read(self, page: str, opened: set[int], by_name: bool) -> None:
        skip, depth, reason, at, end = "", 0, "", 0, len(page)
        tags = _Tags(page)
        while at < end:
            m = tags.next(at)
            text = page[at : m.start if m else end]
            if skip:
                place, held, may_open = self.out[-1]
                self.out[-1] = place, held + len(" ".join(text.split())), may_open
            elif text:
                self.parts.append(text)
                if self.links:
                    self.linked += len(text)
            if not m:
                break
            at, closing, name, attributes = m.end, m.closing, m.name, m.attributes
            if not name:
                continue
            whole = name in VOID or attributes.endswith("/")
            if skip:
                if name == skip and not whole:
                    depth += -1 if closing else 1
                    if depth <= 0:
                        skip = ""
                elif name in MAIN and not closing and reason not in _CLOSED:
                    skip = ""  # an element that was never closed ends where the article begins
                elif name == "body" and skip == "head":
                    skip = ""
                elif name in RAW and not closing and not whole:  # what it holds is no text
                    at = self.after_raw(page, name, at) or at
                if skip or name not in MAIN or closing:
                    continue
            if not closing and not whole and m.start not in opened:
                word, doubtful = judged(name, attributes, self.mains > 0)
                if word and not by_name and name not in DROPPED and word != "hidden" and word not in _CLOSED:
                    word = None
                if word and doubtful:
                    if not self.doubt:
                        self.gap()
                        self.doubts += 1
                        self.doubt, self.doubt_tag, self.doubt_depth = self.doubts, name, 0
                elif word:
                    self.gap()
                    skip, depth, reason = name, 1, word
                    may_open = name == "form" or (name not in DROPPED and word not in _CLOSED and word != "hidden")
                    self.out.append((m.start, 0, may_open))
                    if name in RAW:
                        at, skip = self.after_raw(page, name, at) or end, ""
                    continue
            if self.doubt and name == self.doubt_tag and not whole:
                self.doubt_depth += -1 if closing else 1
                if self.doubt_depth <= 0:
                    self.gap()
                    self.doubt = 0
            if name in MAIN:
                self.gap()
                self.mains = max(0, self.mains + (-1 if closing else 1))
            elif name == "a":
                self.links = max(0, self.links + (-1 if closing else 1))
                self.anchors += not closing
            elif name not in INLINE:
                self.close()
                self.tag = "" if closing else name
        self.close()


def lines_of(page: str) -> list[Line]:
    """The lines of a page; elements that hold most of its text are opened."""
    opened: set[int] = set()
    for turn in range(OPENINGS + 1):
        read = _Page(page, opened, turn < OPENINGS)
        if any(line.inside for line in read.lines):
            break
        half = (sum(len(line.text) for line in read.lines) + sum(n for _, n, _ in read.out)) / 2
        most = [at for at, n, may_open in read.out if may_open and n > half]
        if not most:
            break
        opened.update(most)
    return read.lines


def _link_line(line: Line) -> bool:
    """Mostly link text, no sentence, and no paragraph or heading that is one link."""
    return bool(
        line.text and line.linked >= LINK_SHARE * len(line.text) and not line.text.endswith(ENDS)
        and not (line.tag in PROSE and line.anchors == 1)
    )


def menus(lines: list[Line]) -> list[bool]:
    """Lines of menus: link lines of several links, or beside another link line."""
    link = [_link_line(line) for line in lines]
    return [
        own and (lines[i].anchors > 1 or (i > 0 and link[i - 1]) or (i + 1 < len(link) and link[i + 1]))
        for i, own in enumerate(link)
    ]


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """The sum of each line and the ``window`` - 1 after it."""
    sums, total = [], sum(weights[:window])
    for i, w in enumerate(weights):
        sums.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - w
    return sums


def regions(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, end, highest window sum) between each surge and the dive after it."""
    found: list[tuple[int, int, int]] = []
    start = None
    sums = window_sums(weights, window)
    for i, w in enumerate(weights):
        if start is None and w:
            start = i
        elif start is not None and not sums[i]:
            found.append((start, i, max(sums[start:i])))
            start = None
    if start is not None:
        found.append((start, len(weights), max(sums[start:])))
    return found


def outside(lines: list[Line]) -> list[bool]:
    """Menus within main elements that lie before the first surge of plain text or behind the last dive; where nothing surges, none does."""
    menu = menus(lines)
    plain = [0 if m or not line.inside else len(line.text) - min(line.linked, len(line.text)) for line, m in zip(lines, menu)]
    body = [(a, b) for a, b, peak in regions(plain) if peak >= SURGE]
    if not body:
        return [False] * len(lines)
    return [m and not body[0][0] <= i < body[-1][1] for i, m in enumerate(menu)]


def _settled(lines: list[Line]) -> list[Line]:
    """Doubtful elements by their own distribution: those whose windows reach SURGE stay, of others one empty line is left."""
    out: list[Line] = []
    i = 0
    while i < len(lines):
        if not lines[i].doubt:
            out.append(lines[i])
            i += 1
            continue
        j = i
        while j < len(lines) and (lines[j].doubt == lines[i].doubt or not lines[j].text):
            j += 1
        own = lines[i:j]
        weights = [0 if menu else len(line.text) - min(line.linked, len(line.text)) for line, menu in zip(own, menus(own))]
        out += own if max(window_sums(weights)) >= SURGE else [EMPTY]
        i = j
    return out


def main_text(page: str | None) -> str:
    lines = _settled(lines_of(page or ""))
    if any(line.inside for line in lines):
        text, around = [line.inside for line in lines], outside(lines)
        text = [inside and not beyond for inside, beyond in zip(text, around)]
        weights = [len(line.text) if inside else 0 for line, inside in zip(lines, text)]
        prose = text
    else:
        menu = menus(lines)
        text = [bool(line.text) and not m for line, m in zip(lines, menu)]
        weights = [0 if m or _link_line(line) else len(line.text) for line, m in zip(lines, menu)]
        prose = [line.tag in PROSE or line.text.endswith(ENDS) for line in lines]
    found = regions(weights)
    surge = min([SURGE, *([max(peak for _, _, peak in found)] if found else [])])
    return "\n".join(
        lines[i].text for a, b, peak in found if peak >= surge or any(prose[i] and weights[i] for i in range(a, b))
        for i in range(a, b) if text[i]
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
