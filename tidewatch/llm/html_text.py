"""The main text of web pages, by composite text density.

For every node of a page's tree: characters per tag, weighed by how the characters outside links relate
to those inside, against the same ratio of the whole body. A node's density sum is that of its
children; the node with the largest sum holds the content. The least density on the way from it to the
body is the threshold: other parts of the tree at or above it give their own largest-sum node too.
Tags that only format words count as part of the block around them, and content inside an ``article`` or
``main`` element is widened to the whole of it, headings included.

Menus, forms, adverts and other parts that name themselves by tag, role or class are left out beforehand,
unless they hold the page's principal ``article`` or ``main`` or, on a page without one, most of its text outside
links: a wrapper often bears the name of something that it only contains.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.DOTALL,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
# Elements whose content is no text of the page.
NO_TEXT = frozenset("select button svg canvas object audio video".split()) | RAW
# Elements that are no part of an article, and those of them that may well be wrapped around one.
LEFT_OUT = frozenset("head nav footer aside dialog menu header form".split())
WRAPPERS = frozenset("head header form".split())
# Names in a class, id or role that say the same.
LEFT_OUT_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "cookie cookies consent disqus disclaimer footer form gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notification paywall pagination popup promo promoted promotion related reply replies respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Tags that format words inside a block.
WORDS = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# A start tag ends these open elements, unless one of the second kind stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P_ENDS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "optgroup", "option", "li", "dt", "dd"}
_P_WALLS = frozenset("td th table caption button object article section div body html li blockquote".split())


# How sure it is that an element is left out.
KEPT, UNSURE, SURE = 0, 1, 2
# Of the text outside links, the share that saves an element on a page without article or main.
MOST, NEARLY_ALL = 0.5, 0.9
_BOXES = frozenset("div section ul ol dl table td center details".split())


def _named(name: str, tag: str, inside_article: bool) -> int:
    """What one name says. A part of a compound name tells what the element is for only where it stands last;
    where it stands first it does for boxes outside articles, whose text is mostly links inside them."""
    if name in LEFT_OUT_NAMES:
        return SURE
    first, *others = re.split(r"[-_]+", name)
    if others and others[-1] in LEFT_OUT_NAMES:
        return UNSURE
    return UNSURE if tag in _BOXES and first in LEFT_OUT_NAMES and not inside_article else KEPT


def _doubt(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in LEFT_OUT and not (tag == "header" and inside_article):
        return UNSURE if tag in WRAPPERS else SURE
    if not attributes:
        return KEPT
    if _HIDDEN.search(attributes):
        return SURE
    if tag in ("body", "html"):
        return KEPT
    names = [n for found in _NAMES.findall(attributes) for n in "".join(found).lower().split()]
    return max((_named(n, tag, inside_article) for n in names), default=KEPT)


def _links_only(tag: str, attributes: str) -> bool:
    """A box inside an article that is left out if it is mostly links: its name starts like a menu's or an advert's."""
    names = (n for found in _NAMES.findall(attributes) for n in "".join(found).lower().split())
    return tag in _BOXES and any(re.split(r"[-_]+", n)[0] in LEFT_OUT_NAMES for n in names)


class Tree:
    """Nodes in page order as parallel lists, and the texts that stand directly in them."""

    def __init__(self, page: str):
        self.tags, self.parents, self.dropped = ["#page"], [-1], [False]
        self.texts: list[tuple[int, str]] = []  # (node, text); an empty text is the edge of a block
        self.ends = [0]  # for each node, the texts before its end
        self.starts = [0]
        self.doubts, self.links_only = [KEPT], [False]
        self.places: dict[str, list[int]] = {}  # where open elements of a tag stand among the open ones
        self._read(page)
        self._drop()

    def _read(self, page: str) -> None:
        opened, at, size, endless = [0], 0, len(page), set()
        while at < size:
            found = _TOKEN.search(page, at)
            if found is None:
                self._text(opened[-1], page[at:])
                break
            if found.start() > at:
                self._text(opened[-1], page[at : found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, attributes = tag.lower(), found[3] or found[6] or ""
            if found[1] or found[4]:
                self._end(opened, tag)
                continue
            self._imply(opened, tag)
            node = self._start(opened, tag, attributes)
            if tag in RAW and tag not in endless:  # what follows is no markup up to the end tag
                end = re.compile(f"</{tag}[^a-zA-Z0-9]", re.IGNORECASE).search(page, at)
                if end is None:
                    endless.add(tag)
                at = end.start() if end else (size if tag != "noscript" else at)
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
                self._close(opened, len(opened) - 1)
        for node in reversed(opened):
            self.ends[node] = len(self.texts)

    def _text(self, node: int, text: str) -> None:
        if not self.dropped[node]:
            self.texts.append((node, html.unescape(text) if "&" in text else text))

    def _start(self, opened: list[int], tag: str, attributes: str) -> int:
        above, node = opened[-1], len(self.tags)
        inside = bool(self.places.get("article") or self.places.get("main"))
        self.tags.append(tag)
        self.parents.append(above)
        self.dropped.append(self.dropped[above] or tag in NO_TEXT)
        self.doubts.append(_doubt(tag, attributes, inside))
        self.links_only.append(inside and bool(attributes) and _links_only(tag, attributes))
        self.starts.append(len(self.texts))
        self.ends.append(len(self.texts))
        if tag in BLOCKS:
            self.texts.append((node, ""))
        elif tag == "br" and not self.dropped[node]:
            self.texts.append((node, " "))
        self.places.setdefault(tag, []).append(len(opened))
        opened.append(node)
        return node

    def _close(self, opened: list[int], place: int) -> None:
        """Ends the open elements from that place on."""
        while len(opened) > place:
            last = opened.pop()
            self.places[self.tags[last]].pop()
            if self.tags[last] in BLOCKS:
                self.texts.append((last, ""))
            self.ends[last] = len(self.texts)

    def _wall(self, walls: frozenset[str] | set[str]) -> int:
        """The innermost place of any of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in walls if self.places.get(t)), default=0)

    def _end(self, opened: list[int], tag: str) -> None:
        places = self.places.get(tag)
        if places and not (tag == "p" and self._wall(_P_WALLS) > places[-1]):
            self._close(opened, places[-1])

    def _imply(self, opened: list[int], tag: str) -> None:
        if tag in BLOCKS and tag != "html" and self.places.get("head"):
            self._close(opened, self.places["head"][0])
        ends, walls = _ENDS.get(tag, (frozenset(), frozenset()))
        if tag in _P_ENDS or tag == "li":
            ends, walls = {*ends, "p"}, walls | _P_WALLS if tag != "li" else walls
        if not any(self.places.get(t) for t in ends):
            return
        wall = self._wall(walls)
        inner = [own[at] for t in ends if (own := self.places.get(t)) and (at := bisect_right(own, wall)) < len(own)]
        if inner:
            self._close(opened, min(inner))

    def _drop(self) -> None:
        """Leaves out what names itself so, but not what the page is about."""
        n = len(self.tags)
        plain, linked = self._sizes()
        below = plain[:]
        links = linked[:]
        for i in range(n - 1, 0, -1):
            below[self.parents[i]] += below[i]
            links[self.parents[i]] += links[i]
        doubt = self.doubts[:]  # the greatest on the way from the page
        for i in range(1, n):
            doubt[i] = max(doubt[i], doubt[self.parents[i]])
        subjects = [i for i in range(n) if self.tags[i] in ("article", "main") and self.doubts[i] == KEPT and below[i]]
        subjects = [i for i in subjects if doubt[i] < SURE] or subjects
        largest = max((below[i] for i in subjects), default=0)
        subjects = [i for i in subjects if doubt[i] == KEPT and 4 * below[i] >= largest] or subjects
        mains = [i for i in subjects if self.tags[i] == "main" and 2 * below[i] >= max(below[j] for j in subjects)]
        saved = [False] * n
        if subjects:
            node = max(mains or subjects, key=lambda i: (below[i], -i))
            while node >= 0:
                saved[node], node = True, self.parents[node]
        for i in range(1, n):
            if not saved[i] and not subjects and self.doubts[i]:
                saved[i] = below[i] > (NEARLY_ALL if self.doubts[i] == SURE else MOST) * below[0]
            named = self.doubts[i] or self.links_only[i] and links[i] >= below[i]
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or bool(named and not saved[i])
        self.texts = [(i, "" if self.dropped[i] and t != "" else t) for i, t in self.texts]

    def _sizes(self) -> tuple[list[int], list[int]]:
        """Characters that stand directly in each node, outside and inside links."""
        n = len(self.tags)
        plain, linked, link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            link[i] = self.tags[i] == "a" or link[self.parents[i]]
        for node, text in self.texts:
            if text:
                (linked if link[node] else plain)[node] += len(" ".join(text.split()))
        return plain, linked

    def densities(self) -> tuple[list[float], list[float]]:
        """Each node's composite density and density sum."""
        n = len(self.tags)
        tags, link_tags = [0] * n, [0] * n
        plain, links = self._sizes()
        chars = [a + b for a, b in zip(plain, links, strict=True)]
        for i in range(n - 1, 0, -1):
            above = self.parents[i]
            if not self.dropped[i]:
                own = self.tags[i] == "a"
                tags[above] += tags[i] + (self.tags[i] not in WORDS)
                link_tags[above] += link_tags[i] + own
                chars[above] += chars[i]
                links[above] += links[i]
        base = links[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.dropped[i] and self.tags[i] not in WORDS:
                c, t, lc, lt = chars[i], max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
                inner = c / max(c - links[i], 1) * links[i] + base * c + math.e
                density[i] = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 1e-9) / math.log(math.log(inner) + math.e - 1)
        for i in range(n - 1, 0, -1):
            sums[self.parents[i]] += density[i]
        return density, sums

    def content(self) -> list[int]:
        """The nodes that hold the main text, in page order, none inside another."""
        density, sums = self.densities()
        n = len(self.tags)
        if not any(density):
            return []
        best, best_sum = list(range(n)), [max(s, d) if d else 0.0 for s, d in zip(sums, density, strict=True)]
        own = best_sum[:]
        for i in range(n - 1, 0, -1):  # the largest density sum below each node
            above = self.parents[i]
            if own[i] and best_sum[i] >= best_sum[above]:
                best[above], best_sum[above] = best[i], best_sum[i]
        top = best[0]
        threshold, node = density[top], top
        while node > 0 and self.tags[node] not in ("body", "html"):
            threshold, node = min(threshold, density[node] or threshold), self.parents[node]
        top = self._widened(top)
        found, inside, last = [], [False] * n, list(range(n))
        for i in range(n - 1, 0, -1):  # the last node below each
            last[self.parents[i]] = max(last[self.parents[i]], last[i])
        for i in range(n):
            if i and inside[self.parents[i]]:
                inside[i] = True
            elif i == top or (best[i] == i and density[i] >= threshold and not i < top <= last[i]):
                inside[i] = True
                found.append(i)
        return found

    def _widened(self, node: int) -> int:
        """The outermost article or main element around a node, else the node."""
        above = node
        while above > 0:
            if self.tags[above] in ("article", "main"):
                node = above
            above = self.parents[above]
        return node

    def blocks(self, node: int) -> list[str]:
        out, line = [], []
        for _, text in self.texts[self.starts[node] : self.ends[node]]:
            if text:
                line.append(text)
            elif line:
                out.append(" ".join("".join(line).split()))
                line = []
        out.append(" ".join("".join(line).split()))
        return [b for b in out if b]


def main_text(page: str) -> str:
    """The main text of one page: its blocks in page order, one to a line; "" if there is none."""
    tree = Tree(page)
    return "\n".join(b for node in tree.content() for b in tree.blocks(node))


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Per row: page_id, url, ``text`` and ``n_chars``. A page that is missing, empty or all menus gives "".

    Every page stands for itself, so repeated rows give repeated results; other columns are left out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).alias("html"),
    )
    types = dict(rows.dtypes)
    return rows.mapInArrow(extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
