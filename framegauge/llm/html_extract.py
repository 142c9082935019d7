"""Main text of HTML pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of tags (block elements carry their class) and
the block it stands in. For each path the text length (link text apart) and the punctuation per node are added up;
both rows of ratios, in page order of the paths, are smoothed with the neighbours and fused into their geometric mean,
times the share of the path's text that is no link. Paths are chosen by two thresholds: those over THRESHOLD of the
best path's value (weighed by the path's size) are content; those over COMPANION of it are content too if they lie in
the innermost element that holds all of the former. So headings and short lines of the article are kept, and lists of
links between two parts of it are not. The headline belongs to the content too: if that has no h1, the last h1 before
it does, beside its element or one level below that. Nodes of all other paths go.

Left out before any counting: head, scripts, styles, controls, comments of the markup, navigation, footers, asides,
headers that are not of an article (by element, by their own class, or by that of the element they are in), and hidden
elements. Forms, and elements whose class, id or role names them as menus, adverts, notices, sidebars, footers or reader
comments, are left out unless they hold most of the page's text (a form around a whole page). Reader comments go however
long they are; an element of that name is kept if it holds most of the page, comments among it, and a fifth of its text
is outside of these. A class that says whether there are comments (`has-comments`, `comments-open`) is no name. A word
of the article in the same class (`post-header`) outweighs a weak name. Character references are decoded once; white space inside a block becomes one space, blocks are joined in
page order by one space, and a line break is white space.

Cases: null and empty html give an empty text; text outside any tag is one block of the root; unclosed tags end with
their parent, head with the first element that can't be in it; an unclosed comment, script or style reaches to the
end of the page, and a tag without its end is dropped; null ids and urls are passed on; rows that repeat stay; other
columns are not looked at; time and memory grow in proportion to a page's length, however it is damaged, and very long
pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches

#: Share of the best path's value from which a path is content, and from which it is inside the content's element.
THRESHOLD, COMPANION = 0.12, 0.01
#: Share of all text from which a form, or an element that its class names as no content, is content all the same.
MOST_TEXT = 0.6
#: Share of the text of an element named as reader comments, outside of such elements in it, from which it is a page's wrapper.
OWN_TEXT = 0.2
# Element names by kind, and words of classes, ids and roles that name what is no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select button option xmp".split())
NO_CONTENT = frozenset("head nav footer aside menu dialog label fieldset".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp img br".split())
ROOTS = frozenset("html body main article".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "dl", "table")
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs cookie cookies consent gdpr footer foot masthead menu menus nav navbar navigation newsletter notice notices alert pager pagination popup modal promotion related recommended recommendations sidebar sidebars sponsor sponsored subscribe signup login skip toolbar complementary contentinfo".split())
WEAK_NAMES = frozenset("header head share sharing social search promo widget feedback".split())
READERS = frozenset("comment comments commentlist respond disqus replies".split())
STATES = frozenset("has have with without no is not on off open opened closed enabled disabled allowed count number link links".split())
ARTICLES = frozenset("article entry hentry post story".split())
OF_ARTICLES = frozenset("article body content copy entry headline main paragraph post story text title".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(>?)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。，、]")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class _Element:
    __slots__ = ("tag", "path", "skip", "soft", "inside", "link", "entry")

    def __init__(self, tag: str, path: int, skip: bool, soft: int | None, inside: bool, link: bool, entry: bool):
        self.tag, self.path, self.skip, self.soft, self.inside, self.link, self.entry = tag, path, skip, soft, inside, link, entry


class _Page:
    """A page's text nodes and its tables of paths and of elements that may be no content; a parent precedes its children."""

    def __init__(self) -> None:
        #: block number, path (-1 for white space alone), text, whether in a link, and the soft element it is in
        self.nodes: list[tuple[int, int, str, bool, int | None]] = []
        self.parents, self.in_article = [-1, 0], [False, False]
        self.tags = ["", ""]
        self.soft_parents: list[int | None] = []
        self.soft_readers: list[bool] = []
        self._path_of: dict[tuple[int, str], int] = {}

    def path(self, parent: int, label: str, inside: bool) -> int:
        key = parent, label
        if key not in self._path_of:
            self._path_of[key] = len(self.parents)
            self.parents.append(parent)
            self.in_article.append(inside)
            self.tags.append(label.partition(".")[0])
        return self._path_of[key]

    def soft(self, parent: int | None, readers: bool) -> int:
        self.soft_parents.append(parent)
        self.soft_readers.append(readers)
        return len(self.soft_parents) - 1


def _attributes(source: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(source)} if source.strip() else {}


def _named(attributes: dict[str, str]) -> str | None:
    """`readers` or `other` if class, id or role name an element as no content."""
    found = None
    for token in " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if words & READERS:
            if words & STATES:
                continue
            return "readers"
        if words & NAMES or (words & WEAK_NAMES and not words & OF_ARTICLES):
            found = "other"
    return found


def _of_article(attributes: dict[str, str], words: frozenset[str]) -> bool:
    return any(words & {w.lower() for w in _WORDS.findall(t)} for t in attributes.get("class", "").split())


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _read(html: str) -> _Page:
    page = _Page()
    found, stack = page.nodes, [_Element("", 1, False, None, False, False, False)]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    blocks = [0]  # places in the stack of the open elements that are not inline
    block = at = 0

    def text(piece: str) -> None:
        if not piece or stack[-1].skip:
            return
        if not piece.isspace():
            top = stack[-1]
            found.append((block, top.path, unescape(piece), top.link, top.soft))
        elif found and found[-1][0] == block:
            found.append((block, -1, " ", False, None))

    def close(upto: int) -> None:
        for e in stack[upto:]:
            open_at[e.tag].pop()
        del stack[upto:]
        while blocks[-1] >= upto:
            blocks.pop()

    def last(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else 0

    while True:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            return page
        follows = html[start + 1 : start + 2]
        if follows in ("!", "?") and follows or (follows == "/" and not html[start + 2 : start + 3].isalpha()):
            text(html[at:start])
            if html.startswith("<!--", start):
                end, size = html.find("-->", start + 2), 3
            elif html.startswith("<![CDATA[", start):
                end, size = html.find("]]>", start), 3
                text(html[start + 9 : end if end >= 0 else len(html)].replace("&", "&amp;"))
            else:
                end, size = html.find(">", start), 1
            at = end + size if end >= 0 else len(html)
            continue
        m = _TAG.match(html, start)
        if not m:  # no tag begins here
            more = start + 1
            text(html[at:more])
            at = more
            continue
        text(html[at:start])
        at = m.end()
        if not m[4]:  # the page ends inside the tag
            return page
        tag = m[2].lower()
        if tag == "br":
            if not stack[-1].skip and found and found[-1][0] == block:
                found.append((block, -1, " ", False, None))
            continue
        inline = tag in INLINE
        if not inline:
            block += 1
        if m[1]:
            k = last(tag)
            if k and (not inline or k > blocks[-1]):
                close(k)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        self_closed = m[3].rstrip().endswith("/")
        if tag in RAW and not self_closed:
            end = _ENDS[tag].search(html, at)
            gone = html.find(">", end.end()) if end else -1
            at = gone + 1 if gone >= 0 else len(html)
            continue
        if tag in VOID:
            continue
        if not inline and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph, and an item the item before it
            close(blocks[-1])
        if tag in ITEMS:
            k = max(last(t) for t in ITEMS[tag])
            if k > max(last(t) for t in LISTS):
                close(k)
        if self_closed and not inline:
            continue
        attributes, above = _attributes(m[3]), stack[-1]
        inside = above.inside or tag in ("article", "main")
        if tag == "header" and not inside:
            inside = above.entry or _of_article(attributes, OF_ARTICLES - {"main", "body"})
        skip = above.skip or tag in NO_CONTENT or (tag == "header" and not inside) or _hidden(attributes)
        soft, path = above.soft, above.path
        if not skip and tag not in ROOTS and not (tag in ("header", "h1", "h2", "h3") and inside):
            name = _named(attributes)
            if name or tag == "form":
                soft = page.soft(above.soft, name == "readers")
        if not inline:
            kind = attributes.get("class", "").split()
            path = page.path(above.path, f"{tag}.{kind[0]}" if kind else tag, inside)
            blocks.append(len(stack))
        open_at.setdefault(tag, []).append(len(stack))
        entry = _of_article(attributes, ARTICLES) if not inline else above.entry
        stack.append(_Element(tag, path, skip, soft, inside, above.link or tag == "a", entry))


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate((x[:1], x, x[-1:]))
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def _without_soft(page: _Page) -> list[tuple[int, int, str, bool, int | None]]:
    """The nodes outside of elements that are named as no content and do not hold most of the page's text."""
    if not page.soft_parents:
        return page.nodes
    sizes, told, total = [0] * len(page.soft_parents), [0] * len(page.soft_parents), 0
    for _, _, text, link, soft in page.nodes:
        size = 0 if link else len(text.strip())
        total += size
        if soft is not None:
            sizes[soft] += size
    for s in range(len(sizes) - 1, -1, -1):
        if page.soft_parents[s] is not None:
            sizes[page.soft_parents[s]] += sizes[s]
            told[page.soft_parents[s]] += sizes[s] if page.soft_readers[s] else told[s]
    kept: list[bool] = []
    for above, readers, size, inner in zip(page.soft_parents, page.soft_readers, sizes, told, strict=True):
        around = not readers or (inner > 0 and size - inner >= OWN_TEXT * size)
        kept.append((above is None or kept[above]) and around and size >= MOST_TEXT * total > 0)
    return [n for n in page.nodes if n[4] is None or kept[n[4]]]


def _chosen(page: _Page, nodes: list[tuple[int, int, str, bool, int | None]]) -> tuple[set[int], int | None]:
    """The paths of the content, and the block of a headline outside of it."""
    sums: dict[int, list[float]] = {}
    for _, path, text, link, _ in nodes:
        if path >= 0:
            own, size = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0]), len(text.strip())
            own[0] += 0 if link else size
            own[1] += len(_MARKS.findall(text))
            own[2] += 1
            own[3] += size
    if not sums:
        return set(), None
    paths, x = list(sums), np.array(list(sums.values()))
    ratios = x[:, :2] / x[:, 2:3]
    smooth = [(_smooth(r) + r) / 2 for r in ratios.T]
    fused = np.sqrt(smooth[0] * (1 + smooth[1])) * (x[:, 0] / np.maximum(x[:, 3], 1))
    # times the root of the nodes' text: long paragraphs and many of them both count
    sized = fused * np.sqrt(np.sqrt(x[:, 0] + 1))
    least, least_inside = THRESHOLD * sized.max(), COMPANION * fused.max()
    if not least > 0:
        return set(paths), None
    good = {p for p, v in zip(paths, sized, strict=True) if v >= least}
    # an article element is where content is, unless it holds next to nothing of the text
    within = {p for p in good if page.in_article[p]}
    if within and sum(sums[p][0] for p in within) >= 0.2 * sum(sums[p][0] for p in good):
        good = within
    # the innermost path that has all of the good ones below it, then all that is inside of it
    below = [0] * len(page.parents)
    for p in range(len(below) - 1, 0, -1):
        below[page.parents[p]] += below[p] + (p in good)
    root = max(p for p in range(len(below)) if below[p] == len(good))
    inside = [False] * len(below)
    for p in range(1, len(below)):
        inside[p] = page.parents[p] == root or inside[page.parents[p]]
    content = good | {p for p, v in zip(paths, fused, strict=True) if inside[p] and v >= least_inside}
    return content, _headline(page, nodes, content, root)


def _headline(page: _Page, nodes: list[tuple[int, int, str, bool, int | None]], content: set[int], root: int) -> int | None:
    """The block of the last h1 before the content that stands beside its element, or one level below that."""
    if any(page.tags[p] == "h1" for p in content):
        return None
    found, beside = None, page.parents[root]
    for block, path, _, link, _ in nodes:
        if path in content:
            break
        if page.tags[path] == "h1" and path > 0 and not link and beside > 0 and beside in (page.parents[path], page.parents[page.parents[path]]):
            found = block
    return found


def main_text(html: str | None) -> str:
    page = _read(html or "")
    nodes = _without_soft(page)
    chosen, headline = _chosen(page, nodes)
    out, last = [], None
    for block, path, text, _, _ in nodes:
        if path < 0 or path in chosen or block == headline:
            out.append(text if block == last else " " + text)
            last = block
    return " ".join("".join(out).split())


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text), a row for each page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
