"""Main text of web pages by tree scoring.

One pass over the markup builds a tree of block elements (inline elements only mark link text). Boilerplate is left
out: by element (menus, forms, scripts, ...), by role, by hidden state, or by words in class and id. Each paragraph
then passes points for its length and commas to its ancestors: all to the parent, half to the next, less further up.
A container's points are discounted by its link density. The best container is kept, an article around it included,
and those of its siblings that score well, hold plain paragraphs, or are headings. All that is left inside goes out.

Inside an article (or main element) forms go, labels and buttons with them, and elements whose class or id names nothing
but boilerplate ("comment-list", "ad box"); a name that only holds such a word ("menu-driven-design"), and a paragraph
that is only called related or the like, stay, as do lists of links. An article's own header stays: title and byline are
part of the text.

A form, and words in class and id, can also mark a wrapper of the whole page. Where neither an article nor a block of PROSE
characters is kept, the outermost element that these rules alone dropped is kept after all, the one with most paragraph text first,
until there is such a text or no such element.

Defined results: a null id or url stays null; no rows: no rows; pages of any length are read whole, in time in proportion to
their length; further columns, whatever their names, are ignored. Null and empty pages, and those with boilerplate by element, role or hidden state only, give the empty
text; markup that is cut off ends at the end of
the page; repeated rows give repeated rows; of containers with equal points the first in the page wins.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, ship, text_slices

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|$)|!--|[!?][^>]*(?:>|$)|(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|$))")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")

# Elements by their role in HTML.
_BLOCKS = set("button datalist label address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_RAW = set("script style noscript template iframe object svg math canvas audio video noembed noframes textarea select title".split())
_DROPPED = set("head nav footer aside dialog menu search fieldset legend button label datalist".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {f"h{k}" for k in range(1, 7)}
_CLOSES = {  # an opening tag ends the nearest open element of these, up to a container
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
_SCOPES = {"ul", "ol", "dl", "table", "menu"}
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_BOILERPLATE = set(
    "ad ads advert advertisement advertising adverts adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup sidebar sidenav widget widgets related recommended recommendations nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer header comment comments commentlist disqus respond replies reply share sharing social login search form skip hidden outbrain taboola".split()
)
_TITLED = {"header", "masthead"}
#: Words that name a place or kind of box: beside them alone a boilerplate word names boilerplate inside an article.
_PLACES = set("box container wrapper wrap list section block area bar left right top bottom inner outer item items link links module thread count title heading content post page site main article js and the rail aside region row col unit slot label text inline".split())
#: Of the words above, those that mark a paragraph inside an article, too.
_INSERTED = set("ad ads advert advertisement advertising adverts adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup popup modal hidden outbrain taboola disqus".split())
_PROSE_TAGS = {"p", "pre", "blockquote"}

#: Characters from which a kept block looks like text of a page.
PROSE = 80
#: Wrappers that are tried one by one; then all are kept at once.
ROUNDS = 8


class _Node:
    __slots__ = ("children", "commas", "drop", "inside", "link", "links", "order", "parent", "pieces", "points", "size", "tag", "weak")

    def __init__(self, tag: str, parent: _Node | None, order: int, drop: bool):
        self.tag, self.parent, self.order, self.drop = tag, parent, order, drop
        self.inside = False  # in an article
        self.weak = False  # dropped by being a form, or by words in class and id, and by nothing else
        self.children: list[_Node | str] = []  # elements, and runs of text between them
        self.pieces: list[tuple[str, bool]] = []
        self.points = 0.0
        self.size = self.link = self.links = self.commas = 0

    def flush(self) -> None:
        """The text since the last element becomes one block."""
        if self.pieces:
            block = " ".join("".join([p for p, _ in self.pieces]).split())
            if block:
                linked = len("".join("".join([p for p, link in self.pieces if link]).split()))
                self.children.append(block)
                self.size += len(block)
                self.link += min(len(block), linked)
                self.links += linked > 0
                self.commas += block.count(",") + block.count("、") + block.count("，")
            self.pieces = []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _is_boilerplate(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the element itself marks what it holds as no part of the text."""
    if tag in _DROPPED or tag == "form" or tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = [{w.lower() for w in _WORDS.findall(name)} for k in ("class", "id") for name in attributes.get(k, "").split()]
    if not inside_article:
        return any(name & _BOILERPLATE for name in names)
    marks = _INSERTED if tag in _PROSE_TAGS or tag in _HEADINGS else _BOILERPLATE - _TITLED
    return any(name & marks and name <= _BOILERPLATE | _PLACES for name in names)


def _tree(source: str) -> _Node:
    """The block elements of a page; `drop` marks boilerplate."""
    top = here = _Node("html", None, 0, False)
    at, order, links = 0, 0, 0
    opened: Counter[str] = Counter()  # open elements by name, so that no tag searches in vain for what isn't open
    while True:
        found = source.find("<", at)
        if found < 0:
            found = len(source)
        if found > at:
            here.pieces.append((html.unescape(source[at:found]) if "&" in source[at:found] else source[at:found], links > 0))
        if found == len(source):
            break
        m = _TAG.match(source, found)
        if not m:
            here.pieces.append(("<", links > 0))
            at = found + 1
            continue
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            if source.startswith("<!--", found):
                end = source.find("-->", found + 4)
                at = end + 3 if end >= 0 else len(source)
            continue
        closing = m[1] or m[5]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCKS and tag != "html" and opened[tag]:
                node = here
                while node and node.tag != tag and not (tag in ("li", "p") and node.tag in _SCOPES):
                    node = node.parent
                if node and node.tag == tag and node.parent:
                    here.flush()
                    links = 0
                    _leave(here, node.parent, opened)
                    here = node.parent
            continue
        if tag in ("svg", "math") and m[0].endswith("/>"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(source, at)
            close = source.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(source)
            continue
        if tag in _VOID:
            here.pieces.append((" ", False))
        if tag == "a":
            links = 1
        if tag not in _BLOCKS:
            continue
        here.flush()
        links = 0
        before = here
        if here.tag == "p" or here.tag in _HEADINGS:  # a block ends an open paragraph or heading
            here = here.parent
        ended = _CLOSES.get(tag)
        if ended and any(opened[t] for t in ended):
            node, last = here, None
            while node and node.tag not in _SCOPES:
                last = node if node.tag in ended else last
                node = node.parent
            here = last.parent if last and last.parent else here
        _leave(before, here, opened)
        inside = opened["article"] + opened["main"] > 0
        if tag in ("hr", "html"):
            continue
        order += 1
        attributes = _attributes(m[3] or "")
        node = _Node(tag, here, order, _is_boilerplate(tag, attributes, inside))
        node.inside = inside
        node.weak = node.drop and not _is_boilerplate("div" if tag == "form" else tag, {k: v for k, v in attributes.items() if k not in ("class", "id")}, inside)
        here.children.append(node)
        opened[tag] += 1
        here = node
    while here:
        here.flush()
        here = here.parent
    return top


def _leave(below: _Node, above: _Node, opened: Counter[str]) -> None:
    """Count off the elements left on the way up."""
    while below is not above and below:
        opened[below.tag] -= 1
        below = below.parent


def _walk(node: _Node) -> Iterator[_Node]:
    """Elements in page order, without recursion."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]


def _blocks(node: _Node) -> Iterator[str]:
    stack: list[_Node | str] = [node]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        elif not node.drop:
            stack += reversed(node.children)


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by one space."""
    if not source:
        return ""
    cleaned = source.replace("\0", "")
    kept: set[int] | None = set()  # orders of dropped wrappers that are kept after all
    while True:
        text, prose, wrapper = _scored_text(cleaned, kept)
        if prose or wrapper is None or kept is None:
            return text
        kept = kept | {wrapper} if len(kept) < ROUNDS else None


def _scored_text(source: str, kept: set[int] | None) -> tuple[str, bool, int | None]:
    """The text, whether a block of PROSE characters is in it, and the order of the wrapper to keep next, if any."""
    top = _tree(source)
    nodes = list(_walk(top))
    for node in nodes:
        node.drop = node.drop and not (node.weak and (kept is None or node.order in kept))
    wrapper = _wrapper(nodes)
    for node in nodes:  # in page order: what is inside a dropped element is dropped
        node.drop = node.drop or bool(node.parent and node.parent.drop)
    own = {id(n): (n.size, n.commas) for n in nodes}
    for node in reversed(nodes):  # sizes of what is kept below
        if node.parent and not node.drop:
            node.parent.size += node.size
            node.parent.link += node.link
            node.parent.links += node.links
    for node in nodes:  # menus that no name gives away
        if node.tag in ("ul", "ol", "dl", "table") and not node.inside and node.links >= 2 and node.link * 3 > node.size * 2 or node.parent and node.parent.drop:
            node.drop = True
    for node in nodes:
        size, commas = own[id(node)]
        if node.drop or not size:
            continue
        points = 1 + commas + min(size / 100, 3)
        # text of its own counts for the element itself unless it is a paragraph, whose points its ancestors get
        above, level = (node.parent, 0) if node.tag not in ("div", "section", "article", "main", "body", "td", "html") else (node, 0)
        if node.tag in _HEADINGS:
            points = 0.1
        while above and level < 5:
            above.points += points / (1, 2, 6, 9, 12)[level]
            above, level = above.parent, level + 1
    scored = [(n.points * (1 - n.link / max(1, n.size)), n) for n in nodes if not n.drop and n.points]
    if not scored:
        return "", False, wrapper
    score = {id(n): s for s, n in scored}
    best = max(scored, key=lambda x: (x[0], -x[1].order))[1]
    node = best
    while node:  # the article around it
        if node.tag == "article":
            best = node
        node = node.parent
    most = score.get(id(best), 0.0)
    while best.parent and best.parent.tag not in ("html", "body", "main") and best.parent.size and score.get(id(best.parent), 0) >= 0.6 * most and best.tag != "article":
        best = best.parent  # a wrapper whose parts share the text
        most = max(most, score.get(id(best), 0.0))
    keep: list[_Node | str] = [best]
    if best.parent and best.tag != "article":
        least = max(3.0, 0.2 * most)
        keep = []
        for c in best.parent.children:
            if c is best:
                keep.append(c)
            elif isinstance(c, str):
                if len(c) > 80:
                    keep.append(c)
            elif not c.drop:
                density = c.link / max(1, c.size)
                plain = c.tag in ("p", "pre", "blockquote") and (density < 0.25 if c.size > 80 else not c.link and c.size > 0 and re.search(r"[.!?。]$", next(_blocks(c), "")))
                if score.get(id(c), 0.0) >= least or plain or c.tag in _HEADINGS and not c.link:
                    keep.append(c)
    elif best.tag == "article" and best.parent:  # further articles beside it that hold text
        keep = [c for c in best.parent.children if c is best or not isinstance(c, str) and not c.drop and c.tag == "article" and score.get(id(c), 0.0) >= max(3.0, 0.2 * most)]
    blocks = [b for k in keep for b in ([k] if isinstance(k, str) else _blocks(k))]
    return " ".join(blocks), best.tag in ("article", "main") or any(len(b) >= PROSE for b in blocks), wrapper


def _wrapper(nodes: list[_Node]) -> int | None:
    """Of the outermost dropped elements, that of most paragraph text (None without any), if it may be kept."""
    outer: dict[int, _Node | None] = {}
    held: dict[int, int] = {}
    for node in nodes:  # in page order
        above = outer[id(node.parent)] if node.parent else None
        outer[id(node)] = above or (node if node.drop else None)
        if (at := outer[id(node)]) and at.weak and (node.tag in _PROSE_TAGS or node.size >= PROSE):
            held[at.order] = held.get(at.order, 0) + node.size
    return max(held, key=lambda k: (held[k], -k), default=None)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (its code points) of each page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kept = pick(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    kinds = [f.dataType.simpleString() for f in kept.schema]
    return kept.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
