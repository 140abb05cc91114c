"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags. A linear classifier gives each
block a cost of being content and of being boilerplate: these are its capacities
to the two terminals. Blocks next to each other are joined by an edge, and the
DOM's containers are nodes too, joined to their blocks and to their parents, so
that near places in the tree hold together. The maximum flow between the terminals
yields the cheapest labelling; blocks on the content side are the text.

Character references are decoded, white space in a block becomes one space, blocks
are trimmed and joined by a line feed; script, style, forms' controls, comments
and markup are never text. Weights are set, not fitted: there are no labelled pages.
A page is read in time linear in its length, broken markup too. Defined results: null
or empty html gives the empty text; a tag that never ends takes the rest of the page
with it, as in browsers; unclosed and stray tags are taken as browsers mostly do; text outside any
tag counts as a block; columns named as the output are replaced; repeated rows are
extracted one by one.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajspark.llm import kernels

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; without an end tag, the raw ones go up to the end of the page, others are ignored.
_RAW = frozenset("script style noscript iframe textarea title template".split())
_SKIP = _RAW | frozenset("object svg math select button canvas audio video datalist".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[a-z]+")
#: An open element that a start tag of this kind ends, looked for up to the named bounds.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_BOILER_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
_CONTENT_TAGS = frozenset(["article", "main"])
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup sidebar sidebars rail nav navbar navigation navigations "
    "menu menus menubar breadcrumb breadcrumbs crumbs footer header masthead topbar toolbar share sharing social related recommended recommendations popular trending comment comments commentlist disqus reply replies respond discussion widget widgets popup modal overlay login search pagination pager paging copyright legal disclaimer skip outbrain taboola teaser".split()
)
#: Those of them that an article beneath never outweighs.
_FIRM_WORDS = frozenset("ad ads advert adverts advertisement comment comments commentlist disqus reply replies respond discussion related recommended recommendations popular trending teaser".split())
_CONTENT_WORDS = frozenset("article content post entry story main maincontent articlebody postbody bodytext".split())

#: Class words of this kind say that something else isn't there: with-sidebar, no-footer.
_ABOUT = ("with-", "has-", "no-", "without-", "with_", "has_", "no_")
#: Tags of single texts: only a class that is a boilerplate word by itself counts there.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt a b i em strong span blockquote pre figcaption caption".split())

#: Log-odds of content by place, and edges between neighbours: of one scale, so that a doubtful block goes with those around it.
INSIDE_CONTENT, INSIDE_BOILER, INSIDE_FORM, BODY_HEADER, ELSEWHERE = 2.0, -3.0, -2.5, -2.5, 0.4
NEXT_SAME, NEXT_OTHER, TO_CONTAINER, TO_PARENT = 0.8, 0.2, 0.4, 0.2
#: Log-odds of a block that is all links.
LINKED = -5.0


class _Element:
    __slots__ = ("tag", "parent", "place", "soft", "depth")

    def __init__(self, tag: str, parent: _Element | None, place: float | None, soft: bool = False):
        self.tag, self.parent, self.place, self.soft = tag, parent, place, soft
        self.depth = parent.depth + 1 if parent else 0


def tags(page: str) -> Iterator[tuple[str, int, int, bool, dict[str, str] | None]]:
    """Of each tag: name ('' for comments and the like), its start and end, whether it ends an element, attributes.

    Every character is looked at a bounded number of times: a search that failed isn't made again.
    """
    at, size = 0, len(page)
    missing: dict[str, bool] = {}

    def find(what: str, start: int) -> int:
        if missing.get(what):
            return -1
        found = page.find(what, start)
        missing[what] = found < 0
        return found

    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if after in ("!", "?") or (after == "/" and not page[start + 2 : start + 3].isalpha()):
            comment = page.startswith("<!--", start)
            end = find("-->", start + 4) if comment else find(">", start)
            at = size if end < 0 else end + (3 if comment else 1)
            yield "", start, at, False, None
            continue
        closing = after == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            continue
        at, found = name.end(), {}
        while at < size:
            m = _ATTRIBUTE_NAME.match(page, at)
            at = m.end()
            if m[1] is None:
                if page[at : at + 1] == "=":
                    at += 1
                    continue
                break
            value, equals = "", _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                end = find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.setdefault(m[1].lower(), value)
        at = min(size, at + 1)
        tag = name[0].lower()
        if not closing and tag in _SKIP:
            end = -1 if missing.get("</" + tag) else next((m.start() for m in _end_of(tag).finditer(page, at)), -1)
            missing["</" + tag] = end < 0
            if end >= 0 or tag in _RAW:
                close = page.find(">", end) if end >= 0 else -1
                at = size if close < 0 else close + 1
            yield "", start, at, False, None
            continue
        yield tag, start, at, closing, found


@lru_cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


def _classes(tag: str, found: dict[str, str]) -> set[str]:
    """Words of class and id."""
    names = [n for n in (found.get("class", "") + " " + found.get("id", "")).lower().split() if not n.startswith(_ABOUT)]
    return set(names) if tag in _TEXT_TAGS else {w for n in names for w in _PARTS.findall(n)}


def _place(tag: str, found: dict[str, str], parent: _Element | None, trust: bool) -> tuple[float | None, bool]:
    """Log-odds that this element gives to what it holds (that of the parent if it says nothing), and whether only class words speak.

    trust: an article counts even if class words above it speak against it.
    """
    above, soft = (parent.place, parent.soft) if parent else (None, False)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").lower().replace(" ", ""):
        return INSIDE_BOILER, False
    role = found.get("role", "").lower()
    if tag == "form":
        return INSIDE_FORM, False
    if tag in _BOILER_TAGS or role in _BOILER_ROLES:
        return INSIDE_BOILER, False
    words = _classes(tag, found)
    if tag == "main" or role == "main":
        return (above, soft) if above is not None and above < 0 and not soft else (INSIDE_CONTENT, False)
    if tag not in ("html", "body", "article") and words & _BOILER_WORDS:
        return INSIDE_BOILER, not words & _FIRM_WORDS and (above is None or above > 0 or soft)
    if tag == "header":
        return (above, soft) if above == INSIDE_CONTENT else (BODY_HEADER, False)
    if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        # An article among reader comments or in a sidebar is none of ours.
        return (above, soft) if above == INSIDE_BOILER and not (soft and trust) else (INSIDE_CONTENT, False)
    if words & _CONTENT_WORDS and tag in ("div", "section", "td"):
        return (INSIDE_CONTENT, False) if above != INSIDE_BOILER else (above, soft)
    return above, soft


class Block:
    __slots__ = ("text", "linked", "holder", "tag")

    def __init__(self, text: str, linked: int, holder: _Element, tag: str):
        self.text, self.linked, self.holder, self.tag = text, linked, holder, tag


def blocks(page: str, trust: bool = False) -> list[Block]:
    """Text blocks in page order."""
    found: list[Block] = []
    root = _Element("", None, None)
    top, links, parts, linked, at = root, 0, [], 0, 0
    by_tag: dict[str, list[_Element]] = {}  # open elements, so that no end tag walks the chain of all of them

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, min(linked, len(text)), top, top.tag))
            parts.clear()
        linked = 0

    def close(element: _Element) -> None:
        nonlocal top, links
        last = False
        while not last:
            last = top is element
            links -= top.tag == "a"
            by_tag[top.tag].pop()
            top = top.parent

    def opened(tags: set[str] | frozenset[str], bounds: set[str]) -> _Element | None:
        """The innermost open element of ``tags`` that no open one of ``bounds`` holds off."""
        inner = lambda names: max((own[-1] for t in names if (own := by_tag.get(t))), key=lambda e: e.depth, default=None)
        x = inner(tags)
        bound = inner(bounds) if x is not None else None
        return x if x is not None and (bound is None or bound.depth < x.depth) else None

    for tag, start, end, closing, attributes in tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if links > 0:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closing:
            if tag in _BLOCK:
                flush()
            if (x := opened({tag}, {"body", "html"} - {tag} if tag != "p" else {"table", "body", "html"})) is not None:
                close(x)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if (p := opened({"p"}, {"table", "article", "section", "div", "body", "html"})) is not None:
                close(p)
            if tag in _ENDS and (x := opened(*_ENDS[tag])) is not None:
                close(x)
        if tag not in _VOID and not page.startswith("/>", end - 2):
            top = _Element(tag, top, *_place(tag, attributes, top, trust))
            by_tag.setdefault(tag, []).append(top)
            links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


def odds(block: Block) -> float:
    """The classifier: log-odds that a block is content."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    density = block.linked / n
    place = block.holder.place
    score = (ELSEWHERE if place is None else place) + (LINKED * density if density > 0.3 else 0.0)
    if place is None:
        score += min(words, 30) / 30
        score += 0.5 if block.text[-1] in ".!?:;\"'”»…。" else 0.0
        score -= 3.0 if "©" in block.text or "rights reserved" in block.text.lower() else 0.0
    return score


def min_cut(source: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    source: capacity from the source, or if negative to the sink; edges: both ways.
    Augments along shortest paths, phase by phase (Dinic).
    """
    n = len(source)
    s, t = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, c in enumerate(source):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in near[x]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                for k, e in enumerate(path):
                    if left[e] <= 1e-9:
                        x = to[e ^ 1]
                        del path[k:]
                        break
                continue
            while nxt[x] < len(near[x]):
                e = near[x][nxt[x]]
                if left[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            else:
                if x == s:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not any(b.holder.place == INSIDE_CONTENT for b in found) and any(b.holder.soft for b in found):
        found = blocks(page or "", trust=True)
    if not found:
        return ""
    capacity = [odds(b) for b in found]
    holders: dict[int, int] = {}
    edges: list[tuple[int, int, float]] = []
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_SAME if found[i - 1].holder.parent is b.holder.parent else NEXT_OTHER))
        child, x, weight = i, b.holder, TO_CONTAINER
        while x is not None:
            new = id(x) not in holders
            if new:
                holders[id(x)] = len(capacity)
                capacity.append(0.0)
            edges.append((child, holders[id(x)], weight))
            if not new:
                break
            child, x, weight = holders[id(x)], x.parent, TO_PARENT
    side = min_cut(capacity, edges)
    return "\n".join(b.text for b, content in zip(found, side, strict=False) if content)


@kernels.any_names
def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text``, the main text of every page."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, column):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([main_text(x) for x in part.column(column).to_pylist()], pa.string())], [*kept, "text"])

    return (df.select(*(f"`{c}`" for c in kept)) if column in kept else df).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("text", T.StringType())]))
