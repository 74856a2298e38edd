"""Main text of HTML pages: flat text blocks and a decision tree.

A page becomes a flat list of text blocks in one pass over its characters. Each
block is described by its word count and link density, those of its neighbours,
marks of prose in it, how much prose lies before and behind it, and the elements
it lies in, and a decision tree says whether it belongs to the article. The tree
is grown from the labelled pages of ``html_pages``. Names of classes are one of
its features, and are not believed of an element that holds the page's heading
or most of its words.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modeloom.llm.html_pages import Page, labelled_pages

#: A whole tag; where none begins at "<" + letter, the page ends inside it.
TAG = re.compile(
    r"<(/?)([a-zA-Z][^\t\n\f\r />]*+)"
    r"((?:[\t\n\f\r /]++|=?+[^\t\n\f\r />=]++(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'>])[^\t\n\f\r >]++)?+)?+|=)*+)>"
)
#: Where markup may begin; any other "<" is text.
MARK, TAG_BEGIN = re.compile(r"<(?=[!?/a-zA-Z])"), re.compile(r"</?[a-zA-Z]")
COMMENT_END = re.compile("---?>|--!>")
NAMED = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=$|[\s=/])|aria-hidden\s*+=\s*+["']?true|style\s*+=\s*+(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none))""", re.IGNORECASE)
# HTML elements by their part in the layout.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class names, ids and roles that mark parts beside the article, readers' comments, and words that say nothing.
BESIDE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice "
    "notices alert modal popup overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related "
    "recommended recommendations share sharing social newsletter subscribe subscription signup login footer masthead topbar toolbar pagination "
    "pager skip tags outbrain taboola disclaimer copyright search complementary contentinfo toc".split()
)
REMARKS = set("comment comments commentlist reply replies discussion disqus responses respond remark remarks".split())
FILLING = set("list lists box boxes wrapper wrap container bar block area section sections inner outer top left right bottom site page global primary secondary header item items link links panel group row col column content form thread reader readers user".split())
HINT = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
LEGAL = re.compile(r"©|\(c\)|copyright|rights reserved|droits réservés|derechos reservados|rechte vorbehalten", re.IGNORECASE)


@dataclass(slots=True)
class Region:
    """An element named as a part beside the article."""

    up: Region | None
    remarks: bool
    words: int = 0
    heading: bool = False
    believed: bool = False


@dataclass(slots=True)
class Block:
    """A run of text between block borders."""

    text: str
    words: int
    density: float
    inside: bool  # an article or main element
    outer: bool  # a navigation, footer, side or form element, or a page's header
    heading: bool
    item: bool  # of a list
    region: Region | None
    upto: int  # where its last text ends in the page
    named: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    inside: bool = False
    outer: bool = False
    item: bool = False
    skipped: bool = False
    heading: bool = False
    region: Region | None = None
    #: The open element that a p and that a li would end, by its place in the stack; -1: none.
    p_at: int = -1
    li_at: int = -1


@dataclass(slots=True)
class _Parts:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    upto: int = 0


@functools.lru_cache(maxsize=4096)
def _kind(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether there is a class, id or role, whether one marks a part beside the article, whether readers' comments, and whether the element is hidden."""
    beside = remarks = named = False
    for m in NAMED.finditer(attributes):
        named = True
        for name in (m[1] or m[2] or m[3] or "").split():
            hints = {h.lower() for h in HINT.findall(name)}
            if hints and hints <= BESIDE | REMARKS | FILLING:
                remarks = remarks or bool(hints & REMARKS)
                beside = beside or bool(hints & BESIDE)
    return named, beside, remarks, bool(HIDDEN.search(attributes))


class Parser:
    """The text blocks of a page in order; character references decoded, white space inside a block one space.

    Every character is looked at a bounded number of times: a tag, comment or
    script that the page's end cuts off ends the page, ends of elements that
    aren't open are known by counts, and elements end in the order of a stack.
    """

    def __init__(self, page: str):
        self.page = page
        self.out: list[Block] = []
        self.regions: list[Region] = []
        self.stack = [_Open("")]
        self.open: dict[str, int] = {}
        self.now = _Parts()
        self.links = 0

    def parse(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            found = MARK.search(page, at)
            mark = found.start() if found else -1
            self._say(page[at:] if mark < 0 else page[at:mark], mark)
            if mark < 0:
                break
            if TAG_BEGIN.match(page, mark):
                m = TAG.match(page, mark)
                if not m:
                    break
                at = m.end()
                tag = m[2].lower()
                if tag in RAW:
                    if not m[1] and not (tag == "svg" and m[3].endswith("/")):
                        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE | re.ASCII).search(page, at)
                        if not end:
                            break
                        at = end.end()
                elif m[1]:
                    self._end(tag)
                else:
                    self._start(tag, m[3])
            elif page.startswith("<!--", mark):
                end = COMMENT_END.match(page, mark + 2) or COMMENT_END.search(page, mark + 4)
                if not end:
                    break
                at = end.end()
            else:
                at = page.find(">", mark) + 1
                if not at:
                    break
        self._close()
        total = sum(b.words for b in self.out)
        for r in reversed(self.regions):  # inner ones come later
            r.believed = not r.heading and r.words < (0.9 if r.remarks else 0.5) * total
            if r.up:
                r.up.words += r.words
                r.up.heading = r.up.heading or r.heading
        for r in self.regions:
            r.believed = r.believed or bool(r.up and r.up.believed)
        for b in self.out:
            b.named = bool(b.region and b.region.believed)
        return self.out

    def _say(self, raw: str, upto: int = 0) -> None:
        top = self.stack[-1]
        if raw and not top.skipped:
            text = html_lib.unescape(raw) if "&" in raw else raw
            self.now.pieces.append(text)
            if not text.isspace():
                if self.links:
                    self.now.linked += len(text)
                self.now.heading = self.now.heading or top.heading
                self.now.upto = upto if upto >= 0 else len(self.page)

    def _close(self) -> None:
        text = " ".join("".join(self.now.pieces).split())
        if text:
            top = self.stack[-1]
            size = max(1, sum(len(p) for p in self.now.pieces if not p.isspace()))
            words = text.count(" ") + 1
            self.out.append(Block(text, words, min(1.0, self.now.linked / size), top.inside, top.outer, self.now.heading or top.heading, top.item, top.region, self.now.upto))
            if top.region:
                top.region.words += words
        if self.now.pieces:
            self.now = _Parts()

    def _pop(self, upto: int) -> None:
        for x in self.stack[upto:]:
            self.open[x.tag] -= 1
        del self.stack[upto:]

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
            return
        if tag in BLOCK:
            self._close()
            self.links = 0
        if not self.open.get(tag):
            return
        top = self.stack[-1]
        if tag not in BLOCK and (top.region or top.skipped):
            self._close()
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self._pop(at)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag == "a":
            self.links = 1
            return
        block = tag in BLOCK
        if block:
            self._close()
            self.links = 0
        named, beside, remarks, hidden = _kind(attributes)
        if tag in VOID or not (block or named or hidden):
            return
        up = self.stack[-1]
        shut = up.li_at if tag == "li" else up.p_at if tag == "p" or tag in HEADINGS else -1
        if shut >= 0:
            self._pop(shut)
            up = self.stack[-1]
        region = up.region
        if (beside or remarks) and tag not in {"article", "main", "body", "html"}:
            region = Region(up.region, remarks)
            self.regions.append(region)
        if tag in ("h1", "main") and region:
            region.heading = True
        place = len(self.stack)
        inline = not block
        new = _Open(
            tag,
            inside=up.inside or tag in ("article", "main"),
            outer=up.outer or tag in OUTER or (tag == "header" and not up.inside),
            item=up.item or tag in ("li", "option", "dd", "dt"),
            skipped=up.skipped or hidden,
            heading=tag in HEADINGS or (up.heading and inline),
            region=region,
            p_at=place if tag == "p" or tag in HEADINGS else up.p_at if inline else -1,
            li_at=place if tag == "li" else up.li_at if inline or tag in ("p", "div", "address") or tag in HEADINGS else -1,
        )
        if inline and (new.region is not up.region or new.skipped != up.skipped):
            self._close()
        self.stack.append(new)
        self.open[tag] = self.open.get(tag, 0) + 1


def blocks(page: str) -> list[Block]:
    return Parser(page).parse()


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "sentence", "prose_before", "prose_after", "legal",
    "heading", "item", "inside", "apart", "outer", "named",
)
MOST_WORDS, MOST_PROSE, LONG = 200, 1_000, 12


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a missing neighbour has no words and no links."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in found], float)
    density = np.array([b.density for b in found])
    x[:, 0], x[:, 1] = np.minimum(words, MOST_WORDS), density
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    x[:, 6] = [b.text[-1] in ".!?…:;*#%$&\"')" for b in found]
    prose = np.cumsum(words * ((words >= LONG) & (density < 0.5)))
    x[1:, 7] = np.minimum(prose[:-1], MOST_PROSE)
    x[:, 8] = np.minimum(prose[-1] - prose, MOST_PROSE)
    x[:, 9] = [b.words < 40 and bool(LEGAL.search(b.text)) for b in found]
    has_inside = any(b.inside for b in found)
    x[:, 10:16] = [(b.heading, b.item, b.inside, has_inside and not b.inside, b.outer, b.named) for b in found]
    return x


#: Depth of the tree, and the fewest blocks on either side of a cut.
DEPTH, FEWEST = 12, 4


def labelled_rows(pages: list[Page] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    rows, labels = [], []
    for page in labelled_pages() if pages is None else pages:
        found = blocks("".join(part for part, _ in page))
        ends = np.cumsum([len(part) for part, _ in page])
        labels += [page[i][1] for i in np.searchsorted(ends, [b.upto for b in found]).tolist()]
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A decision tree by Gini impurity: a share of ones, or (feature, threshold, tree below or at it, tree above). On equal terms the features named first win."""
    ones = int(y.sum())
    if not depth or ones in (0, len(y)):
        return ones / len(y)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, right = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(value[1:] > value[:-1])
        cuts = cuts[(cuts + 1 >= FEWEST) & (cuts + 1 <= len(y) - FEWEST)]
        if not len(cuts):
            continue
        low, high = cuts + 1, len(y) - cuts - 1
        a, b = right[cuts], ones - right[cuts]
        cost = a * (1 - a / low) + b * (1 - b / high)
        k = int(cost.argmin())
        if best is None or cost[k] < best[0] - 1e-9:
            best = (cost[k], f, (value[cuts[k]] + value[cuts[k] + 1]) / 2)
    if best is None:
        return ones / len(y)
    _, f, cut = best
    below = x[:, f] <= cut
    return (f, float(cut), grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1))


@functools.lru_cache(maxsize=1)
def tree():
    return grow(*labelled_rows())


def score(row, node=None) -> float:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None, node=None) -> str:
    """The article's blocks in page order, joined by an empty line; empty for null, empty or text-less pages."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if score(row, node) > 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html, and pages without an article, give an empty text.
    Repeated rows stay, each for itself; nulls in page_id and url pass through;
    an empty table gives no rows; other columns are not read. Broken markup
    costs time in proportion to its length. No shuffle.
    """

    node = tree()  # grown once, by the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), node) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
