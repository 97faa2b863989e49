"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped
from trailweave.llm.texts import sliced

#: Elements whose text is no part of a page's running text; they don't end a line.
UNSEEN = frozenset("head title script style noscript template iframe svg canvas object video audio button label select option datalist textarea".split())
#: Of these, what a following block shows to have been left open.
BROKEN_BY_BLOCKS = frozenset("head title svg label select option datalist".split())
#: Elements that HTML itself sets apart from an article; a header is one outside of it.
APART = frozenset("nav footer aside form fieldset dialog menu".split())
#: Words of class, id or role that set an element apart.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "masthead footer contentinfo complementary search comment comments disqus replies reply respond share sharing social related newsletter subscribe signup login popup modal widget toolbar pagination".split()
)
#: Words beside a mark that make it say something about the page, such as no-sidebar or comments-open.
NEGATED, STATES = frozenset("no not without has with hide show is".split()), frozenset("open closed enabled disabled on off layout".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOMES = frozenset(("article", "main"))
#: Elements that group blocks, and those of them that may be set apart by part of a name.
BOXES = frozenset("html body div section article main".split())
GROUPS = frozenset("div section ul ol dl table header figure details center".split())
#: Elements out of which only their own end tag, or a table's, leads.
FENCES = frozenset("article main table td th caption template object".split())
ROWS = frozenset("table thead tbody tfoot tr td th caption".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAIL = re.compile(r"<[a-zA-Z/!?]")


@dataclass(slots=True)
class Line:
    text: str
    node: int  # innermost block around it
    ratio: float  # characters for each tag since the last line
    linked: int  # characters inside links


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    unseen: bool  # itself or an ancestor
    apart: bool
    closed: bool = False  # by its own end tag


def _marked(tag: str, attrs: Sequence[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.split():
                if token.lower() in MARKS:
                    return True
                if tag in GROUPS:
                    words = [w.lower() for w in _WORD.findall(token)]
                    if words and words[0] not in NEGATED and words[-1] not in STATES and not MARKS.isdisjoint(words):
                        return True
    return False


@dataclass
class _Scope:
    fence: int
    open: dict[str, int] = field(default_factory=dict)


class Page(HTMLParser):
    """Turns the events of one page into lines, one for each block of text, and a tree of blocks.

    Every construct is looked at a bounded number of times, so any markup takes linear time: a
    comment without an end hides the rest, as in a browser; a tag without one at the page's end is
    dropped; after 32 tags with unbalanced quotes, tags end at the next ``>``.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node("", -1, False, False, True)]
        self._open, self._scopes, self._count = [0], [_Scope(0)], {}
        self._text: list[tuple[str, bool]] = []
        self._tags, self._odd, self._link, self._raw = 0, 0, False, False

    def read(self, html: str) -> list[Line]:
        end = html.rfind(">") + 1
        cut = _TAIL.search(html, end)
        self.feed(html[: cut.start()] if cut else html)
        self.close()
        self._end_line()
        return self.lines

    # What the standard parser leaves open or refuses.

    def check_for_whole_start_tag(self, i):
        if self._odd < 32:
            end = super().check_for_whole_start_tag(i)
            if end >= 0:
                return end
            self._odd += 1
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_starttag(self, i):
        self._raw = None
        end = super().parse_starttag(i)
        if self._raw:  # attributes that the parser can't read
            self.handle_starttag(self.lasttag, [])
        self._raw = False
        return end

    def parse_comment(self, i, report=1):
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.find(">", i) + 1
        end = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_marked_section(self, i, report=1):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def unknown_decl(self, data):
        pass

    # Events.

    def _end_line(self) -> None:
        if self._text:
            text = " ".join("".join(x for x, _ in self._text).split())
            if text:
                linked = sum(len(" ".join(x.split())) for x, link in self._text if link)
                self.lines.append(Line(text, self._open[-1], len(text) / max(1, self._tags), linked))
                self._tags = 0
            self._text.clear()
        self._link = False

    def _push(self, tag: str, apart: bool) -> None:
        up = self._open[-1]
        self.nodes.append(Node(tag, up, self.nodes[up].unseen or tag in UNSEEN, apart))
        self._open.append(len(self.nodes) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1
        if tag in FENCES:
            self._scopes.append(_Scope(self._open[-1]))
        else:
            own = self._scopes[-1].open
            own[tag] = own.get(tag, 0) + 1

    def _pop(self) -> str:
        at = self._open.pop()
        tag = self.nodes[at].tag
        self._count[tag] -= 1
        if self._scopes[-1].fence == at:
            self._scopes.pop()
        else:
            self._scopes[-1].open[tag] -= 1
        return tag

    def _pop_to(self, *tags: str) -> None:
        while self._pop() not in tags:
            pass

    def _top(self) -> str:
        return self.nodes[self._open[-1]].tag

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
            while self._top() in BROKEN_BY_BLOCKS:
                self._pop()
            if self._top() == "p" or (tag in HEADINGS and self._top() in HEADINGS):
                self._pop()
            if tag == "li" and self._top() == "li" or tag in ("dt", "dd") and self._top() in ("dt", "dd"):
                self._pop()
            elif tag in ROWS and tag != "table":
                if self.nodes[self._scopes[-1].fence].tag in ("td", "th", "caption"):
                    self._pop_to("td", "th", "caption")
                if tag not in ("td", "th") and self._scopes[-1].open.get("tr"):
                    self._pop_to("tr")
        elif tag == "br":
            self._text.append((" ", False))
        elif tag == "a":
            self._link = True
        self._tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS or tag in UNSEEN:
            inside = self._count.get("article", 0) + self._count.get("main", 0) > 0
            apart = tag in APART or (tag == "header" and not inside)
            self._push(tag, apart or (tag not in ("html", "body", "main") and bool(attrs) and _marked(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML knows no such end: a start tag
        if tag == "svg" or tag == "script":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "br":
            self._text.append((" ", False))
        elif tag == "a":
            self._link = False
        elif tag in ("body", "html"):
            self._end_line()
        elif tag in BLOCKS or tag in UNSEEN:
            if tag in BLOCKS:
                self._end_line()
            known = self._count.get(tag) if tag in FENCES or tag in ROWS else self._scopes[-1].open.get(tag)
            if known:
                while self.nodes[self._open[-1]].tag != tag:
                    self._pop()
                self.nodes[self._open[-1]].closed = True
                self._pop()

    def handle_data(self, data):
        if self._raw is None:
            self._raw = True
        elif not self.nodes[self._open[-1]].unseen:
            self._text.append((data, self._link))

    # Sums over the tree; a node's number is above its parent's.

    def weights(self, lines: Sequence[Line], content: Sequence[bool]) -> list[int]:
        """For each node the characters of content lines in it."""
        out = [0] * len(self.nodes)
        for x, own in zip(lines, content, strict=True):
            if own:
                out[x.node] += len(x.text)
        for k in range(len(out) - 1, 0, -1):
            out[self.nodes[k].parent] += out[k]
        return out

    def set_apart(self, lines: Sequence[Line], sigma: float, spread: float) -> list[bool]:
        """Whether each node is, or lies in, an element that is set apart.

        One with a title or an article in it may be the page's wrapper after all, such as a form
        around everything or a menu that was never closed: it is if it holds half of the cluster
        of the lines outside the others, unless an article outside of all holds some of it.
        """
        nodes = self.nodes
        core = [(n.tag in HOMES or n.tag == "h1") and not n.apart for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            core[nodes[k].parent] |= core[k]
        sure, some, home = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
        for k, n in enumerate(nodes[1:], 1):
            may = core[k] and (n.tag in ("div", "section", "form") or not n.closed)
            sure[k], some[k] = sure[n.parent] or (n.apart and not may), some[n.parent] or n.apart
            home[k] = home[n.parent] or n.tag in HOMES
        if some == sure:
            return sure
        lines = [x for x in lines if not sure[x.node]]
        content = clustered(lines, sigma, spread)
        if any(own and home[x.node] and not some[x.node] for x, own in zip(lines, content, strict=True)):
            return some
        weights, out = self.weights(lines, content), list(sure)
        for k, n in enumerate(nodes[1:], 1):
            out[k] = sure[k] or out[n.parent] or (n.apart and 2 * weights[k] < weights[0])
        return out


def smoothed(ratios: Sequence[float], sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at 2 sigma and weighted anew at both ends."""
    r = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2.0 * sigma * sigma))
    n = len(ratios)
    return np.convolve(ratios, kernel)[r : r + n] / np.convolve(np.ones(n), kernel)[r : r + n]


def clustered(lines: Sequence[Line], sigma: float, spread: float) -> np.ndarray:
    """Which lines form the content cluster: smoothed ratios of ``spread`` standard deviations or more.

    All lines, if none has.
    """
    if not lines:
        return np.zeros(0, bool)
    ratios = smoothed([x.ratio for x in lines], sigma)
    found = ratios >= spread * ratios.std()
    return found if found.any() else ~found


def main_text(html: str | None, sigma: float = 1.0, spread: float = 0.5) -> str:
    """Blocks of the main text, joined by one newline; '' if there are none.

    A line is a block of text with its ratio of characters to tags. Smoothed ratios of at least
    ``spread`` standard deviations are the content cluster of the lines outside menus, notices and
    the like (``Page.set_apart``). It selects:

    * if article or main elements hold half of the cluster, those that have a line of it, else the
      whole body;
    * of these, all lines of an article, and of a main element or body those between the first and
      the last line of the cluster, those in a division with such a line, unless they are mostly
      links, and a heading before.
    """
    if not html:
        return ""
    page = Page()
    lines = page.read(html)
    apart = page.set_apart(lines, sigma, spread)
    lines = [x for x in lines if not apart[x.node]]
    if not lines:
        return ""
    content = clustered(lines, sigma, spread).tolist()
    nodes, weights = page.nodes, page.weights(lines, content)
    home, box, articles = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        home[k] = home[n.parent] or (k if n.tag in HOMES else 0)
        box[k] = k if n.tag in BOXES else box[n.parent]
        articles[k] = articles[n.parent] or n.tag == "article"
    regions: dict[int, list[int]] = {home[x.node]: [] for x, own in zip(lines, content, strict=True) if own and home[x.node]}
    if 2 * sum(weights[h] for h in regions) < weights[0]:
        regions, home = {0: []}, [0] * len(nodes)
    for k, x in enumerate(lines):
        if home[x.node] in regions:
            regions[home[x.node]].append(k)
    kept: list[int] = []
    for own in regions.values():
        seen = [k for k in own if content[k]]
        for k in own:
            x = lines[k]
            inside = articles[x.node] or seen[0] <= k <= seen[-1] or (weights[box[x.node]] > 0 and 3 * x.linked < 2 * len(x.text))
            if inside or (k < seen[0] and nodes[x.node].tag in HEADINGS):
                kept.append(k)
    return "\n".join(lines[k].text for k in sorted(kept))


def extract_pages(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"), sigma: float = 1.0, spread: float = 0.5) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every row; null or empty html: '' and 0.

    Row by row in Arrow batches: no shuffle, memory for one batch, time in proportion to the
    page, whatever its markup. Broken markup (open elements, unknown declarations, a page cut
    short) is read as far as it goes. Repeated rows stay repeated, an empty table gives no rows,
    other columns are left out; a kept column must not be called text or n_chars (ValueError).
    """
    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    shipped(pages.sparkSession)
    rows = pages.select(F.col(html), *keep)
    schema = pages.select(*keep).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def extract(batches):
        for batch in sliced(batches):
            texts = [main_text(x, sigma, spread) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(extract, schema)
