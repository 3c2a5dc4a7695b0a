"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. Each block has a cost for being dropped and one for being
kept, from a linear classifier over its place in the page, its links and its text: the capacities to
the two terminals. Neighbouring blocks are joined by smoothness edges that are stronger the closer
they are in the page's tree. The maximum flow leaves a minimum cut between article and rest.

Most blocks are sure: if a block's preference is larger than all its edges together, every minimum cut
agrees with it. Those are settled first and folded into their neighbours; the flow runs on the rest.

Names of elements (class, id, role) weigh against a block unless the element holds the whole page or article; names
such as ``legal`` or ``notice`` do so outside of an article, and inside of it the text decides.

Defined cases: a null or empty page, or one without text, gives an empty text; markup that is never
closed, closed twice or cut off is read as far as it goes; pages are read whole, in time in proportion to their
length and whatever their depth; repeated rows are extracted alike; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from copperline.llm.columns import add_columns

# a quote delimits a value only right behind the equals sign; elsewhere it is a character like others
_ATTRIBUTES = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]+)?)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "object", "svg", "g", "text", "tspan",
    "math", "mi", "mn", "mo", "mrow", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mstyle", "semantics",
}
# an opening tag ends an open element of these kinds first
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# text of these ends an open paragraph
ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul",
}
MAIN = {"article", "main"}
REST = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
#: Names that mark an element as no part of an article wherever it stands.
REST_NAMES = {
    "ad", "ads", "advert", "advertisement", "sidebar", "nav", "navbar", "navigation", "menu", "footer", "comment", "comments", "reply",
    "replies", "disqus", "cookie", "cookies", "consent", "promo", "sponsored", "sponsor", "related", "share", "sharing", "social",
    "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "signup", "pagination", "pager", "popup", "modal",
}
#: Names that do so outside of an article; inside, the text decides.
OUTER_NAMES = {
    "banner", "header", "masthead", "notice", "notices", "widget", "login", "toolbar", "contentinfo", "complementary", "search", "alert",
    "copyright", "legal", "disclaimer",
}
MAIN_NAMES = {"article", "content", "post", "entry", "story", "main", "articlebody", "body"}
#: First parts of names that say what a page has, not what an element is.
STATES = {"with", "has", "no", "is", "js", "without", "not", "show", "hide", "single", "type", "format", "category", "tag", "status"}
#: Elements that hold the whole page or the whole article: their names say nothing against it.
WHOLE = {"html", "body", "main", "article"}
#: Weights of the classifier: preference for being kept.
IN_MAIN, IN_REST, MAIN_NAME, REST_NAME, OUTER_NAME, HIDDEN = 6.0, -9.0, 1.5, -9.0, -1.5, -12.0
LINKS, WORDS, SENTENCE, LIST, BARE = -3.0, 1.5, 0.5, -0.5, -1.0
#: Capacity between neighbours, and between neighbours of one parent.
NEXT, SIBLING = 0.4, 0.8


#: Room below this is none.
_NOTHING = 1e-12


@dataclass
class Block:
    """A text block: its place is given by numbers of elements, so a deep page costs no more than a flat one."""

    text: str
    preference: float
    parent: int  # number of the element around the block's own
    depth: int  # open elements
    shared: int  # of these, those that were open since the block before


def _names(value: str) -> set[str]:
    """What class, id and role call an element: whole names and their parts, without those that state what a page has."""
    found: set[str] = set()
    for name in value.lower().split():
        parts = [part for part in re.split(r"[^a-z0-9]+", name) if part]
        if parts and not (len(parts) > 1 and parts[0] in STATES):
            found.update(parts)
    return found


def _context(tag: str, attributes: str, in_main: bool) -> float:
    """What an element says about all text below it."""
    value = 0.0
    if tag in MAIN:
        value += IN_MAIN
    elif tag in REST or tag == "header" and not in_main:
        value += IN_REST
    if not attributes or attributes.isspace():
        return value
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, said = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names |= _names(said)
        elif key == "hidden" or key == "aria-hidden" and said.lower() == "true" or key == "style" and _NOT_SHOWN.search(said):
            value += HIDDEN
    if tag in WHOLE:
        return value
    if names & REST_NAMES:
        value += REST_NAME
    elif names & OUTER_NAMES:
        value += OUTER_NAME if in_main else REST_NAME
    elif names & MAIN_NAMES:
        value += MAIN_NAME
    return value


_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_BOUNDARIES = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body")
_TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption")


class _Open:
    """The open elements. Every element is pushed and taken off once; where a tag is open is looked up."""

    def __init__(self):
        self.elements: list[tuple[str, float, int, bool]] = []  # tag, context of all above and itself, number, inside an article
        self.places: dict[str, list[int]] = {}
        self.links: list[int] = []  # how many elements were open where each open link began
        self.serial = 0
        self.least = 0  # the fewest elements open since the last block

    def push(self, tag: str, attributes: str) -> None:
        _, context, _, in_main = self.elements[-1] if self.elements else ("", 0.0, 0, False)
        self.serial += 1
        self.places.setdefault(tag, []).append(len(self.elements))
        self.elements.append((tag, context + _context(tag, attributes, in_main), self.serial, in_main or tag in MAIN))

    def at(self, tag: str) -> int:
        """The innermost place where a tag is open, else -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.elements) > place:
            self.places[self.elements.pop()[0]].pop()
        while self.links and self.links[-1] > place:
            self.links.pop()
        self.least = min(self.least, place)

    def make_way(self, tag: str) -> None:
        """Close what an opening tag ends: the innermost such element, if no container lies in between."""
        ended = max([self.at(name) for name in CLOSES.get(tag, ())] + [self.at("p") if tag in ENDS_P else -1])
        if ended > max(map(self.at, _BOUNDARIES)):
            self.cut(ended)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page with their preferences and places in the tree."""
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    linked = 0
    never_closed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                stack = opened.elements
                n = text.count(" ") + 1
                preference = (stack[-1][1] if stack else 0.0) + LINKS * min(linked / len(text), 1) + WORDS * (min(n, 30) - 8) / 22
                preference += SENTENCE if text[-1] in ".!?…:\"'" else 0
                preference += LIST if opened.at("li") >= 0 else 0
                preference += 0 if stack and stack[-1][0] in _TEXT_TAGS else BARE
                out.append(Block(text, preference, stack[-2][2] if len(stack) > 1 else 0, len(stack), min(opened.least, len(stack))))
                opened.least = len(stack)
            pieces.clear()
        linked = 0

    def skip(tag: str, at: int) -> int | None:
        """Where the next closing tag ends; null if none is left in the page."""
        if tag in never_closed:
            return None
        close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>?", re.I).search(page, at)
        if close is None:
            never_closed.add(tag)
            return None
        return close.end()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                pieces.append(m[0])
                if opened.links:
                    linked += len(m[0].strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                if opened.links:
                    opened.links.pop()
            elif tag not in INLINE:
                flush()
                place = opened.at(tag)
                if place >= 0:
                    opened.cut(place)
        elif tag in RAW:
            if not m[0].endswith("/>"):
                closed = skip(tag, at)
                at = end if closed is None else closed
        elif tag in VOID:
            if tag in INLINE:
                pieces.append(" ")
            else:
                flush()
        elif tag == "a":
            opened.links.append(len(opened.elements))
        elif tag in INLINE:
            if m[3] and _context(tag, m[3], True) <= HIDDEN:
                at = skip(tag, at) or at
        else:
            flush()
            opened.make_way(tag)
            opened.push(tag, m[3])
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next to each other in the page, and nearest of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            depth = max(blocks[i - 1].depth, block.depth, 1)
            edges[i - 1, i] = NEXT * block.shared / depth
        if block.parent in last:
            key = last[block.parent], i
            edges[key] = edges.get(key, 0.0) + SIBLING
        last[block.parent] = i
    return [(a, b, c) for (a, b), c in edges.items() if c > 0]


def minimum_cut(preferences: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the keeping side of a minimum cut; ties go to the dropping side."""
    n = len(preferences)
    want = list(preferences)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    keep: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if keep[i] is None and abs(want[i]) > sum(near[i].values()):
            keep[i] = want[i] > 0
            for j, c in near[i].items():
                want[j] += c if keep[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    open_nodes = [i for i in range(n) if keep[i] is None]
    if open_nodes:
        for i, side in zip(open_nodes, _flow(open_nodes, want, near)):
            keep[i] = side
    return [bool(k) for k in keep]


def _flow(nodes: list[int], want: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow from the keeping to the dropping terminal by blocking flows over levels; the side of each node.

    Arcs are numbers: arc k leads to ``head[k]`` with ``room[k]`` left, and k ^ 1 is its way back.
    """
    place = {node: i for i, node in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    head: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((there, back))

    for node, i in place.items():
        if want[node] > 0:
            arc(source, i, want[node], 0.0)
        elif want[node] < 0:
            arc(i, sink, -want[node], 0.0)
        for other, c in near[node].items():
            if other > node:
                arc(i, place[other], c, c)
    while True:
        # levels from the sink, so that a search from the source never strays
        level = [-1] * len(out)
        level[sink] = 0
        reach = [sink]
        for v in reach:
            for k in out[v]:
                if level[head[k]] < 0 and room[k ^ 1] > _NOTHING:
                    level[head[k]] = level[v] + 1
                    reach.append(head[k])
        if level[source] < 0:
            break
        following = [0] * len(out)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(room[k] for k in path)
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
                # go on from the first arc that is full
                full = next(i for i, k in enumerate(path) if room[k] <= _NOTHING)
                v = head[path[full] ^ 1]
                del path[full:]
                continue
            arcs, i = out[v], following[v]
            while i < len(arcs) and not (room[arcs[i]] > _NOTHING and level[head[arcs[i]]] == level[v] - 1):
                i += 1
            following[v] = i
            if i < len(arcs):
                path.append(arcs[i])
                v = head[arcs[i]]
            elif path:
                v = head[path.pop() ^ 1]
                following[v] += 1
            else:
                break
    seen = [False] * len(out)
    seen[source] = True
    reach = [source]
    for v in reach:
        for k in out[v]:
            if room[k] > _NOTHING and not seen[head[k]]:
                seen[head[k]] = True
                reach.append(head[k])
    return [seen[place[node]] for node in nodes]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    keep = minimum_cut([b.preference for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars; columns of these names, in any case, are replaced."""
    @F.pandas_udf(T.StringType())
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h if isinstance(h, str) else None) for h in html], dtype="object")

    with_text = add_columns(pages, lambda col: {"text": text(col(html_col))})
    return add_columns(with_text, lambda col: {"n_chars": F.length(col("text")).cast("long")})
