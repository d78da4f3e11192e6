"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams over the page; its events become blocks (the lines), each with its text, the tags met since the block before, the share of
its text in links, and the path of open elements. A block's text-to-tag ratio is its text length over its tags plus one. It is weighted by what its path says: elements, roles
and class names of menus, notices and the like take the weight to nothing, `article` and `main` double it, links take their share off. The weighted ratios are smoothed by a
Gaussian and cut at the threshold between two clusters; the blocks of the high cluster hold the content.

The region is chosen by them on every page: it is the `article` (else the `main`) element that holds the greater part (`PART`) of the high blocks' mass; if there is none, the
innermost box with that part, extended to the headings and paragraphs right before and behind
that are not links. Inside the region, blocks in menus, headers, footers, sidebars, notices, adverts, forms and readers' comments go, as do hidden ones.
A class or id is such a mark only as a whole name (`ad-1`, `cookie-notice`), never as a part of it (`has-sidebar`, `social-history`), and never on headings. White space in a block becomes one space; blocks are joined by an empty line.

Null and empty pages give an empty text. Unclosed elements end where the parser meets the next block or the end. Repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

#: Elements, roles and names of the HTML vocabulary.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template svg iframe object canvas button select textarea dialog menu title".split())
UNREAD = frozenset("script style template noscript title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
BOXES = frozenset("div section article span ul ol dl li table tr td aside p center".split())
#: Elements that the search for the region enters.
ENTERED = frozenset("html body main article section div center table tbody tr td form nav header footer".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT = frozenset(("article", "main"))
#: Elements that a new block ends, and those that end at the next one of their kind.
OPEN_ENDED = frozenset(("p", *HEADINGS))
SIBLINGS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comments comment commentlist respond replies disqus dropdown share sharing related recommended trending widget widgets pagination pager hidden".split())
#: Endings and beginnings with which such a name is still one.
AROUND = frozenset("site page main top bottom left right box bar block container wrapper area section list panel links link nav menu global primary secondary popup banner notice form message slot unit inner outer post posts".split())
OUTMOST = frozenset(("html", "body"))
#: Elements of running text.
PROSE = HEADINGS | frozenset("p li blockquote pre dd dt td figcaption".split())
REMARKS = frozenset("comments comment commentlist respond replies disqus".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART, LINKED = 0.7, 0.5


def names_of(value: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether readers' comments: one of its names is made of such words and of words that only place a box."""
    bad = remarks = False
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        hits = [w for w in words if w in NAMES]
        if hits and all(w in NAMES or w in AROUND for w in words):
            bad, remarks = True, remarks or any(w in REMARKS for w in hits)
    return bad, remarks


class Node:
    """An element, with what its path says of it, so that no block has to walk it."""

    __slots__ = ("tag", "parent", "remarks", "mark", "outs", "heads", "depth", "mass", "best", "inside")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, remarks: bool = False):
        self.tag, self.parent, self.mass, self.best, self.inside = tag, parent, 0.0, None, False
        self.depth = 0 if parent is None else parent.depth + 1
        self.remarks = remarks or parent is not None and parent.remarks  # in readers' comments
        self.mark = parent.mark if parent else 0  # the innermost mark: 1 article or main, -1 boilerplate, 0 none
        self.outs = parent.outs if parent else 0  # elements of boilerplate on the path
        self.heads = parent.heads if parent else False  # in the header of an article or main element
        if bad:
            self.heads = tag == "header" and self.mark == 1
            self.mark, self.outs = -1, self.outs + 1
        elif tag in CONTENT:
            self.mark, self.heads = 1, False
        elif tag in HEADINGS and self.heads:  # such headings stay
            self.mark, self.outs = 1, self.outs - 1


class Block:
    __slots__ = ("text", "tags", "linked", "node")

    def __init__(self, text: str, tags: int, linked: float, node: Node):
        self.text, self.tags, self.linked, self.node = text, tags, linked, node


class Lines(HTMLParser):
    """Blocks and elements of a page, parents before their children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.tags = self.links = self.in_links = 0
        self.unread = ""
        self.top = Node("", None)
        self.nodes = [self.top]
        self.open: Counter[str] = Counter()

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.tags, min(1.0, self.in_links / len(text)), self.top))
            self.tags = 0
        self.parts, self.in_links = [], 0

    def opened(self, tag: str, attrs) -> Node:
        bad, remarks = tag in SKIPPED, False
        for k, v in attrs:
            if k == "hidden":
                bad = True
            elif not v:
                continue
            elif k in ("class", "id"):
                if tag in BOXES:
                    named, of_remarks = names_of(v)
                    bad, remarks = bad or named, remarks or of_remarks
            elif k == "role" and v.strip().lower() in ROLES or k == "aria-hidden" and v.strip().lower() == "true" or k == "style" and HIDDEN.search(v):
                bad = True
        return Node(tag, self.top, bad, remarks)

    def close_to(self, tag: str, stop: frozenset[str]) -> None:
        """Closes the innermost open element of this tag and all in it, unless one of stop is met first."""
        if not self.open[tag]:
            return
        x, closed = self.top, []
        while x.tag != tag:
            if x.tag in stop:
                return
            closed.append(x.tag)
            x = x.parent
        self.open.subtract([*closed, tag])
        self.top = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in SKIPPED:
            self.end_block()
        self.tags += 1
        if tag in UNREAD:
            self.unread = tag
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS or tag in SKIPPED:
            if self.top.tag in OPEN_ENDED and tag in BLOCKS:
                self.close_to(self.top.tag, frozenset())
            elif tag in SIBLINGS:
                self.close_to(tag, SIBLINGS[tag])
            if tag not in VOID:
                self.enter(self.opened(tag, attrs))
        elif tag == "span" and (made := self.opened(tag, attrs)).outs > self.top.outs:
            self.end_block()
            self.enter(made)

    def enter(self, node: Node) -> None:
        self.top = node
        self.nodes.append(node)
        self.open[node.tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "article", "main", "section"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in SKIPPED or tag == "span" and self.top.tag == "span":
            self.end_block()
        self.tags += 1
        if tag == self.unread:
            self.unread = ""
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS or tag in SKIPPED or tag == "span" and self.top.tag == "span":
            self.close_to(tag, frozenset() if tag in OUTMOST else CONTENT - {tag})  # a stray end tag doesn't close the article around it

    def handle_data(self, data):
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.in_links += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between two clusters, by Lloyd's rounds from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(over):
            return low
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def weight(block: Block) -> float:
    """0 in boilerplate, 2 in an article or main element, else 1, less the share of links. The innermost mark decides, but nothing inside readers' comments is content."""
    if block.node.remarks or block.node.mark < 0:
        return 0.0
    return 2.0 if block.node.mark > 0 else 1.0 - block.linked


def region_of(lines: Lines) -> tuple[Node, list[int]] | None:
    """The element that the high cluster's blocks choose, and the numbers of the blocks of the region; None if no block has any weight."""
    blocks = lines.blocks
    weights = [weight(b) for b in blocks]
    ratios = np.array([w * len(b.text) / (b.tags + 1) for w, b in zip(weights, blocks, strict=True)])
    if not (ratios > 0).any():
        return None
    level = smooth(ratios).round(9)
    high = (level >= threshold(level)) & (ratios > 0)
    if not high.any():
        high = ratios > 0
    for i in np.flatnonzero(high):
        blocks[i].node.mass += float(ratios[i])
    for x in reversed(lines.nodes[1:]):
        x.parent.mass += x.mass
        if x.mass > 0 and (x.parent.best is None or x.mass >= x.parent.best.mass):
            x.parent.best = x
    region = lines.nodes[0]
    most = PART * region.mass
    marks = [x for x in lines.nodes if x.tag in CONTENT and x.mark > 0 and x.mass >= most]
    if marks:
        region = min(marks, key=lambda x: (x.tag != "article", x.depth))
    while not marks and region.best and region.best.tag in ENTERED and region.best.mass >= most:
        region = region.best
    for x in lines.nodes:
        x.inside = x is region or x.parent is not None and x.parent.inside
    own = [i for i, b in enumerate(blocks) if b.node.inside]
    if region.tag in CONTENT:
        return region, own
    first, last = own[0], own[-1]
    if region.tag in ("", "html", "body"):
        first, last = int(np.flatnonzero(high)[0]), int(np.flatnonzero(high)[-1])
    fits = lambda i: weights[i] > 0 and blocks[i].linked < LINKED and blocks[i].node.tag in PROSE
    while first > 0 and fits(first - 1):
        first -= 1
    while last + 1 < len(blocks) and fits(last + 1):
        last += 1
    return region, list(range(first, last + 1))


def main_text(html: str | None) -> str:
    lines = Lines()
    lines.feed(html or "")
    lines.close()
    lines.end_block()
    found = region_of(lines) if lines.blocks else None
    if found is None:
        return ""
    region, numbers = found
    return "\n\n".join(b.text for b in map(lines.blocks.__getitem__, numbers) if b.node.outs <= region.outs)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def work(batches):
        for b in batches:
            out = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return in_arrow(rows, schema, work)
