"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf path of tags (with
class names).  Over all nodes of one path

    length ratio       code points of text / nodes
    punctuation ratio  punctuation marks / nodes

Both ratios are smoothed along the page (Gaussian weights over neighbouring nodes) and
fused; a path's score is the geometric mean of

    length ratio * (1 + punctuation ratio)

raw and smoothed (mean over its nodes).  Paths whose score reaches ``LEAST`` standard
deviations of the nodes' scores are content paths, their nodes are content nodes.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments that say what they are, by tag, role, class, id or a hidden attribute, leave no
nodes.  The rest is told by the ratios:

* Where article elements hold at least half of the content, the text is what stands in
  them, short paragraphs too; an article with less than ``MINOR`` of the content of the
  greatest one is a teaser.
* Elsewhere the blocks that are mostly content nodes are the text, with what belongs to
  them: headings shortly before one; paragraphs, list items and cells of few links that
  stand between two of them, or beside one in a container smaller than the body.  A main
  element that holds half of the content bounds the search.

Defined results: a null or empty page has empty text; markup that is cut off or never
closed is read as far as it goes; a page without markup is all text; repeated rows have
equal texts; a table without rows gives no rows; a column that has the name of the new one
makes it take another.  Paths are numbers and elements know only their parent, so time and
memory are in proportion to the page, however deep it is.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, free_name

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?:\s[^>]*+(?<=/)|/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)[^>]*+>"
    r"|<[!?][^>]*+>"
    r"|<[a-z/][^>]*+\Z",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_SECTION = frozenset("article body div html main section table tbody td tr center".split())
_CLOSES_P = _BLOCK - frozenset("body head html".split())
_BOILERPLATE_TAGS = frozenset("aside button dialog footer form head header menu nav search".split())
_BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names of an article's own parts; with one of them, header and banner name its heading.
_ARTICLE_NAMES = frozenset("article content entry post story".split())
_HEADING_NAMES = frozenset("banner header masthead".split())
#: Blocks that can be attached to content; an anonymous stretch of text or a bare container cannot.
_TEXT_BLOCKS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INNER_LISTS = frozenset("ul ol dl table select".split())
LEAST, SHARE, MINOR, RADIUS = 1.0, 0.5, 0.2, 2
#: A heading reaches over at most this many blocks to the content below it; a block of more link text than this share is a menu.
REACH, LINKED = 3, 0.5


class _Element:
    """An open or closed element: what is needed of its place, with the number of its tag path."""

    __slots__ = ("article", "block", "boilerplate", "holder", "index", "link", "main", "parent", "path", "section", "tag")

    def __init__(self, index: int, tag: str, path: int, boilerplate: bool, parent: _Element | None):
        self.index, self.tag, self.path, self.parent = index, tag, path, parent
        self.section = tag in _SECTION
        above = parent is not None
        self.boilerplate = boilerplate or (above and parent.boilerplate)
        self.holder = self if self.section or not above else parent.holder  # the container that a block stands in
        self.link = tag == "a" or (above and parent.link)
        self.block = self if tag in _BLOCK or not above else parent.block
        self.article = (parent.article if above else None) or (self if tag == "article" else None)
        self.main = (parent.main if above else None) or (self if tag == "main" else None)


class _Page:
    """Elements and text nodes of a page; a node is (text, element, number of its block)."""

    def __init__(self, page: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.elements: list[_Element] = []
        self.nodes: list[tuple[str, _Element, int]] = []
        self.here = root = self._add("", "", False, None)
        self.open: dict[str, int] = defaultdict(int)  # open elements by tag
        block = at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.nodes.append((page[at : m.start()], self.here, block))
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                block += bool(m["raw"] and m["raw"].lower() in ("title", "textarea", "select"))
                continue
            tag = tag.lower()
            if tag == "br":
                self.nodes.append((" ", self.here, block))
                continue
            block += tag in _BLOCK
            if m["end"] or m["end2"]:
                if self.open[tag]:
                    self._close(tag)
            elif tag not in _VOID:
                self._imply(tag, root)
                self.here = self._opened(tag, m["attributes"] or "")
                self.open[tag] += 1
        if at < len(page):
            self.nodes.append((page[at:], self.here, block))

    def _add(self, tag: str, names: str, boilerplate: bool, parent: _Element | None) -> _Element:
        key = (parent.path if parent else -1, f"{tag}.{names}")
        path = self.paths.setdefault(key, len(self.paths))
        self.elements.append(_Element(len(self.elements), tag, path, boilerplate, parent))
        return self.elements[-1]

    def _pop_to(self, parent: _Element) -> None:
        while self.here is not parent:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def _close(self, tag: str) -> None:
        found = self.here
        while found.tag != tag:
            found = found.parent
        self._pop_to(found.parent)

    def _imply(self, tag: str, root: _Element) -> None:
        """Ends what the start of ``tag`` ends without an end tag: an open paragraph, list item, row or cell."""
        closes = _IMPLIED.get(tag, ("p",) if tag in _CLOSES_P else ())
        if not any(self.open[c] for c in closes):
            return
        found = self.here
        while found is not root and found.tag not in closes and (not found.section or ("tr" in closes and found.tag == "td")) and found.tag not in _INNER_LISTS:
            found = found.parent
        if found is not root and found.tag in closes:
            self._pop_to(found.parent)

    def _opened(self, tag: str, attributes: str) -> _Element:
        parent = self.here
        inside = parent.article is not None or parent.main is not None
        classes, ident, role, hidden = "", "", "", False
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), "".join(values).lower()
            if name == "class":
                classes = value
            elif name == "id":
                ident = value
            elif name == "role":
                role = value
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
        words = set(re.split(r"[^a-z]+", f"{classes} {ident}"))
        if inside or not words.isdisjoint(_ARTICLE_NAMES):
            words -= _HEADING_NAMES
        told = tag in _BOILERPLATE_TAGS and not (inside and tag == "header")
        # the body and the article itself are never boilerplate, whatever they are called
        named = tag not in ("body", "html", "article", "main") and not words.isdisjoint(_BOILERPLATE_NAMES)
        return self._add(tag, classes, told or hidden or named or role in _BOILERPLATE_ROLES, parent)


_IMPLIED = {"li": ("li",), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}


def _smooth(values: np.ndarray) -> np.ndarray:
    weights = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / 2)
    around = np.convolve(np.ones(len(values)), weights, "full")[RADIUS : RADIUS + len(values)]
    return np.convolve(values, weights, "full")[RADIUS : RADIUS + len(values)] / around


def content_paths(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each node whether its path is a content path; from the nodes' path numbers, lengths and punctuation marks, in page order."""
    _, path = np.unique(paths, return_inverse=True)
    n = np.bincount(path)
    length, punctuation = np.bincount(path, lengths) / n, np.bincount(path, marks) / n
    raw = length * (1 + punctuation)
    fused = _smooth(length[path]) * (1 + _smooth(punctuation[path]))
    score = np.sqrt(raw * np.bincount(path, fused) / n)
    return (score >= min(LEAST * score[path].std(), score.max()))[path]


class _Block:
    __slots__ = ("content", "element", "length", "linked", "texts")

    def __init__(self, element: _Element):
        self.element, self.texts, self.length, self.linked, self.content = element, [], 0, 0, 0

    @property
    def chosen(self) -> bool:
        return 2 * self.content >= self.length > 0

    @property
    def plain(self) -> bool:
        return self.length > 0 and self.element.tag in _TEXT_BLOCKS and self.linked <= LINKED * self.length


def _attached(blocks: list[_Block]) -> list[bool]:
    """Which blocks are content or belong to it."""
    keep = [b.chosen for b in blocks]
    at = [i for i, k in enumerate(keep) if k]
    if not at:
        return keep
    beside = {h.index for i in at if (h := blocks[i].element.holder).tag not in ("", "html", "body")}
    for i, b in enumerate(blocks):
        if not keep[i] and b.plain:
            keep[i] = at[0] < i < at[-1] or b.element.holder.index in beside
    reach = -1
    for i in range(len(blocks) - 1, -1, -1):  # headings, with the few plain blocks that part them from the content below
        if keep[i]:
            reach = i
        elif blocks[i].element.tag in _HEADINGS and blocks[i].plain and 0 < reach - i <= REACH and all(blocks[j].plain for j in range(i, reach)):
            keep[i:reach] = [True] * (reach - i)
            reach = i
    return keep


def main_text(page: str) -> str:
    """Blocks of the article in page order, one to a line."""
    nodes = [(html.unescape(text), e, block) for text, e, block in _Page(page).nodes if not e.boilerplate]
    full = [(len(s), len(_PUNCTUATION.findall(s)), e.path) for text, e, _ in nodes if (s := text.strip())]
    if not full:
        return ""
    lengths, marks, paths = np.array(full).T
    good = iter(content_paths(paths, lengths.astype(float), marks.astype(float)).tolist())
    share: dict[_Element | None, int] = defaultdict(int)
    blocks: dict[int, _Block] = {}
    total = 0
    for text, e, block in nodes:
        b = blocks.setdefault(block, _Block(e.block))
        b.texts.append(text)
        if size := len(text.strip()):
            content = size * next(good)
            b.length, b.linked, b.content = b.length + size, b.linked + size * e.link, b.content + content
            total += content
            for region in {e.article, e.main} - {None}:
                share[region] += content
    articles = {e: n for e, n in share.items() if e.tag == "article"}
    if sum(articles.values()) >= SHARE * total:
        least = MINOR * max(articles.values())
        chosen = [b for b in blocks.values() if articles.get(b.element.article, -1) >= least]
    else:
        mains = {e for e, n in share.items() if e.tag == "main" and n >= SHARE * total}
        within = [b for b in blocks.values() if b.length and (not mains or b.element.main in mains)]
        chosen = [b for b, k in zip(within, _attached(within)) if k]
    lines = (" ".join("".join(b.texts).split()) for b in chosen)
    return "\n".join(line for line in lines if line)


def extracted(page: Column) -> Column:
    """The main text of each page as a column."""

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array(map(main_text, as_texts(column).to_pylist()), pa.string())

    return extract(page)


def extract_pages(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` and their main text in a new column; a clash with a column takes a free name."""
    return pages.withColumn(free_name(pages, text), extracted(F.col(html_column)))
