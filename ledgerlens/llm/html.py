"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. A line is what stands between two block tags; it has the characters of its
text, those inside links and the number of tags met. The ratio of plain characters to tags is smoothed with a Gaussian
over neighbouring lines and split in two clusters; the lines of the upper one are dense.

Evidence. Elements whose tag, role or attributes say that they aren't the article (menus, page headers and footers,
sidebars, forms, hidden parts), and containers whose class or id consists of words for such parts and of neutral ones only
(`ad-box`, not `search-algorithms`), count as having no plain characters. A heading, a paragraph or a list item is never
judged by its class. Evidence is withdrawn from an element that is never closed by its own end tag, and from a form or a
container judged by its words that holds nearly all plain characters of the page; an article or main element inside a menu,
header, footer or form stands for itself.

Region. An article or main element that is the only one, or the only one with a first-level heading, is the region, however
short it is. Else dense lines weigh the page's containers by their plain characters: the region is the article or main
element with most of that weight, or the deepest container that holds nearly all of it.

Selection. In the region, dense lines are text. Lines that aren't dense are text if they aren't mostly links: headings,
short paragraphs and list items. Several lines in a row that are mostly links are a menu; in an article, one or two with text
on both sides are list items. Where the region is the page itself, only lines between the first and the last dense
line or first-level heading, and of containers that hold one, are text. Of an article's header, headings and paragraphs are
text.

Nulls: a null html is an empty page with empty text. Repeated rows are extracted each for itself. An empty table gives
no rows. Broken markup never raises: elements end with their parents. Time is linear in the page, however deeply its
elements nest. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.shared import batched

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br".split()
)
#: Elements without text of the page; controls end at the next block.
SILENT = frozenset("script style template head title".split())
CONTROLS = frozenset("button select option textarea svg math".split())
#: Elements that are never part of an article.
PARTS = frozenset("nav footer aside form noscript iframe object canvas dialog menu audio video map".split())
PART_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split()
)
#: Words of a class or an id that name a part outside the article, and words that say nothing beside them.
PART_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar aside footer masthead topbar toolbar breadcrumb breadcrumbs pagination pager"
    " ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie"
    " cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin"
    " login social share sharing related recommended recommendations comment comments disqus respond replies reply widget"
    " widgets copyright disclaimer alert toast outbrain taboola skip hidden search header".split()
)
_NEUTRAL = frozenset(
    "area bar block bottom box button buttons card column container content global group holder inner item items left link links list"
    " main outer page panel part post posts primary right row secondary section sections site slot thread top unit user wrap wrapper".split()
)
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section article main table tbody tr td ul ol dl blockquote center figure details fieldset".split())
#: Elements that a class or id can name as a part.
_JUDGED = frozenset("div section ul ol dl table figure details fieldset article center span".split())
#: Parts inside which an article or main element stands for itself.
_TRANSPARENT = frozenset("nav header footer form".split())
#: These end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: Groups of elements of which a new one ends the open one, and those that a start tag ends.
_GROUP = {"p": 0, "li": 1, "dd": 2, "dt": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_ENDS = {"li": (1,), "dd": (2,), "dt": (2,), "tr": (3, 4), "td": (4,), "th": (4,), "option": (5,)}
_WALLS = frozenset("ul ol dl table select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_NONE, _SILENT = -1, -2


class _Open:
    """An open element: what holds for everything inside it."""

    __slots__ = ("tag", "mark", "container", "main", "head", "heading", "first", "link", "near", "block")

    def __init__(self, tag: str, parent: _Open | None, at: int) -> None:
        self.tag = tag
        if parent is None:
            self.mark, self.container, self.main, self.block = _NONE, 0, False, 0
            self.head = self.heading = self.first = self.link = False
            self.near = (-1,) * 6
            return
        self.mark, self.container, self.main = parent.mark, parent.container, parent.main or tag in MAIN
        # An article's own header has its title and its standfirst.
        self.head, self.heading = parent.head or tag == "header", parent.heading or tag in _HEADINGS or tag == "p" and parent.head and parent.main
        self.first, self.link = parent.first or tag == "h1", parent.link or tag == "a"
        self.block = parent.block if tag in INLINE or tag in CONTROLS else at
        near = parent.near
        if tag in CONTAINERS:
            near = (-1, *near[1:])
        if tag in _WALLS:
            near = (near[0], -1, -1, -1, -1, -1)
        g = _GROUP.get(tag, -1)
        self.near = near if g < 0 else (*near[:g], at, *near[g + 1 :])


class _Lines(HTMLParser):
    """Collects lines, containers and marks (elements that are evidently no part of the article) from the events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", None, 0)]
        self.where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a tag
        self.parents, self.main, self.kinds = [-1], [False], [""]
        self.outer, self.by, self.closed = [], [], []  # of a mark: the one around it, what says so, whether it has an end tag
        self.own: dict[int, int] = {}  # mark of an open element's place
        self.lines: list[tuple[str, int, int, int, bool, int]] = []  # text, linked characters, tags, container, title, mark
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.open[-1]
                self.lines.append((text, self.linked, self.tags, top.container, top.first, top.mark))
                self.tags = self.linked = 0
            self.parts.clear()

    def _reason(self, tag: str, attrs: list, parent: _Open) -> str:
        """What says that an element is no part of an article: its tag, `words`, `hidden`, or nothing."""
        if tag in PARTS or tag == "header" and not parent.main:
            facts = dict(attrs)
            named = f"{facts.get('class') or ''} {facts.get('id') or ''}".lower()
            return "" if tag == "header" and re.search(r"\b(entry|post|article|story|title)\b", named) else tag
        if parent.head and tag not in _HEADINGS and tag not in INLINE and tag not in ("div", "hgroup") and not (tag == "p" and parent.main):
            return "header"
        for name, value in attrs:
            if name == "role" and (value or "").lower() in PART_ROLES:
                return "role"
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value or ""):
                return "hidden"
            if name in ("class", "id") and tag in _JUDGED:
                for token in (value or "").split():
                    words = {w.lower() for w in _SPLIT.split(token) if w and not w.isdigit()}
                    if words & PART_WORDS and words <= PART_WORDS | _NEUTRAL and not (parent.main and words & {"header"}):
                        return "words"
        return ""

    def _pop(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for i in range(len(self.open) - 1, at - 1, -1):
            self.where[self.open[i].tag].pop()
            self.own.pop(i, None)
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        top = self.open[-1]
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and top.mark != _SILENT:
                self.parts.append(" ")
            return
        if top.tag == "title" or tag == "body" and self.where["head"]:
            self._pop(self.where["title" if top.tag == "title" else "head"][-1])
        if tag in _ENDS_P:
            for other in (*CONTROLS, "head"):
                if self.where[other] and self.open[-1].mark == _SILENT:
                    self._pop(self.where[other][0])
        if tag not in INLINE and tag not in CONTROLS:
            if self.open[-1].mark != _SILENT:
                self.flush()
            for g in ((0,) if tag in _ENDS_P else ()) + _ENDS.get(tag, ()):
                if (at := self.open[-1].near[g]) >= 0:
                    self._pop(at)
        parent, at = self.open[-1], len(self.open)
        made = _Open(tag, parent, at)
        if parent.mark != _SILENT:
            if tag in MAIN and parent.mark >= 0 and self.by[parent.mark] in _TRANSPARENT and self.outer[parent.mark] < 0:
                made.mark, made.head = _NONE, False
            reason = "" if tag in _HEADINGS and not any(n in ("hidden", "style", "aria-hidden") for n, _ in attrs) else self._reason(tag, attrs, parent)
            if tag in SILENT or tag in CONTROLS or tag in INLINE and reason:
                made.mark = _SILENT
            elif reason and not (tag in MAIN and reason != "words" and reason != "hidden"):
                self.outer.append(made.mark)
                self.by.append(reason)
                self.closed.append(False)
                made.mark = self.own[at] = len(self.by) - 1
            if tag in CONTAINERS and made.mark != _SILENT:
                facts = dict(attrs)
                self.parents.append(parent.container)
                self.kinds.append(tag)
                made.container = len(self.parents) - 1
                self.main.append(tag in MAIN or facts.get("role") == "main" or facts.get("itemprop") == "articleBody")
        self.open.append(made)
        self.where[tag].append(at)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag not in INLINE and tag not in CONTROLS
        if block and self.open[-1].mark != _SILENT:
            self.flush()
        if self.where[tag] and (block or self.where[tag][-1] >= self.open[-1].block):
            at = self.where[tag][-1]
            if at in self.own:
                self.closed[self.own[at]] = True
            self._pop(at)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.mark == _SILENT or top.head and not top.heading:
            return
        self.parts.append(data)
        if top.link:
            self.linked += len(data)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Convolution with a normalised Gaussian cut at two sigma, renormalised at the ends."""
    r = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        weights = kernel[lo - i + r : hi - i + r]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters of the values, by the mean of their means until it rests."""
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        if not low or not high:
            break
        after = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(after - t) < 1e-9:
            break
        t = after
    return t


def dense(ratio: list[float], sigma: float = 1.0) -> list[bool]:
    """Whether each line is in the upper cluster of the smoothed ratios."""
    soft = smoothed(ratio, sigma)
    border = threshold(soft)
    return [v >= border and v > 0 for v in soft]


def evident(parser: _Lines) -> list[bool]:
    """For each line, whether it stands in a part whose evidence holds."""
    n = len(parser.by)
    held, total = [0] * n, 0
    for text, linked, _, _, _, mark in parser.lines:
        plain = max(0, len(text) - linked)
        total += plain
        if mark >= 0:
            held[mark] += plain
    for m in range(n - 1, -1, -1):
        if parser.outer[m] >= 0:
            held[parser.outer[m]] += held[m]
    holds: list[bool] = []
    for m in range(n):
        whole = parser.by[m] in ("words", "form") and held[m] > 0.8 * total
        holds.append(parser.closed[m] and not whole or parser.outer[m] >= 0 and holds[parser.outer[m]])
    return [line[5] >= 0 and holds[line[5]] for line in parser.lines]


def chosen_lines(parser: _Lines, sigma: float = 1.0) -> list[int]:
    """Indexes of the lines that are the page's main text."""
    lines, away = parser.lines, evident(parser)
    plain = [0 if gone else max(0, len(line[0]) - line[1]) for line, gone in zip(lines, away)]
    up = dense([p / max(1, line[2]) for p, line in zip(plain, lines)], sigma)
    up = [u and not gone for u, gone in zip(up, away)]
    # Containers are numbered as they open, so those inside one follow it.
    n = len(parser.parents)
    mass, size, heavy = [0] * n, [1] * n, [-1] * n
    for i, line in enumerate(lines):
        if up[i]:
            mass[line[3]] += max(1, plain[i])
    for c in range(n - 1, 0, -1):
        p = parser.parents[c]
        mass[p] += mass[c]
        size[p] += size[c]
        if mass[c] and (heavy[p] < 0 or mass[c] >= mass[heavy[p]]):
            heavy[p] = c
    around, outer = [-1] * n, set()  # the article or main element around each, and those with one nearly as heavy inside
    for c in range(1, n):
        p = parser.parents[c]
        around[c] = p if parser.main[p] else around[p]
        if parser.main[c] and around[c] >= 0 and mass[c] > 0.8 * mass[around[c]]:
            outer.add(around[c])
    best = max((c for c in range(n) if parser.main[c] and mass[c] and c not in outer), key=lambda c: mass[c], default=0)
    if mass[best] < 0.2 * mass[0]:
        best = 0
    best = sole_article(parser, plain, away, around) or best
    region = best
    while not best and heavy[region] >= 0 and mass[heavy[region]] >= 0.9 * mass[0]:
        region = heavy[region]
    own = [i for i, line in enumerate(lines) if region <= line[3] < region + size[region] and not away[i]]
    kept = [(i, 2 * lines[i][1] > len(lines[i][0])) for i in own]
    text = [i for i, gone in zip(own, _links(kept, up, bool(best))) if not gone]
    if best or not text:
        return text
    seeds = [i for i in text if up[i] or lines[i][4]]
    hosts = {lines[i][3] for i in seeds}
    if parser.kinds[region] not in ("", "html", "body"):  # the text has a container of its own: short beginnings and ends are its
        return text if seeds else []
    return [i for i in text if seeds and seeds[0] <= i <= seeds[-1] and lines[i][3] in hosts]


def sole_article(parser: _Lines, plain: list[int], away: list[bool], around: list[int]) -> int:
    """The article or main element that is evidently the page's, however short: the only one with a first-level heading that
    is in it and in none inside it, or the only one there is; else 0."""
    titled, there = set(), set()
    for i, line in enumerate(parser.lines):
        if not away[i] and plain[i]:
            c = line[3] if parser.main[line[3]] else around[line[3]]
            if c > 0:
                there.add(c)
                if line[4]:
                    titled.add(c)
    if len(titled) == 1:
        return titled.pop()
    return there.pop() if len(there) == 1 and not titled else 0


def _links(own: list[tuple[int, bool]], up: list[bool], article: bool) -> list[bool]:
    """For each of the region's lines, whether it goes for its links: lines in a row that are mostly links are a menu, and so
    is a single one that isn't dense; in an article one or two with text on both sides are part of it."""
    gone = [False] * len(own)
    k = 0
    while k < len(own):
        end = k
        while end < len(own) and own[end][1]:
            end += 1
        if end > k:
            inside = article and end - k <= 2 and k > 0 and end < len(own)
            for j in range(k, end):
                gone[j] = not inside and (end - k > 1 or not up[own[j][0]])
        k = end + 1
    return gone


#: An unterminated tag at the end of a page.
_OPEN_TAG = re.compile(r"<[A-Za-z/!?]")


def _parsed(page: str) -> _Lines:
    """The page's events. Behind the last `>` no tag can end, so one that begins there isn't given to the parser, which would
    read on to the end of the page for each."""
    parser = _Lines()
    last = page.rfind(">") + 1
    cut = _OPEN_TAG.search(page, last)
    parser.feed(page[: cut.start()] if cut else page)
    parser.close()
    parser.flush()
    return parser


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks in page order, joined by line feeds."""
    if not html:
        return ""
    parser = _parsed(html)
    return "\n".join(parser.lines[i][0] for i in chosen_lines(parser, sigma)) if parser.lines else ""


def extracted(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars counts code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return batched(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
