"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks in page order.  Each block has a cost for being
called boilerplate or for being called content, from a fixed linear classifier
over its own evidence: length, stops, linked share, element, and the boilerplate
marks (elements, and words in class, id and role) that it lies under.  These
costs become capacities from and to the terminals of a flow network.  Two kinds
of smoothness edges tie blocks together.  Neighbours in page order are tied by
how near their common element is.  And each element with several blocks below is
a node of its own, tied to its blocks and to the next such element around it by
a capacity for each block below; ``article``, ``main`` and elements whose words
speak for content are tied more strongly and have a cost for being boilerplate.
Ties between places with different marks are weak.
So a short heading or list item, boilerplate by its own evidence, goes with what
is around it.  The minimum cut (found by maximum flow) separates content from
boilerplate with the least total cost.

A word of a class or id counts fully where it stands alone, ends a compound
(``site-footer``) or begins one that names a container (``sidebar-left``), and a
little elsewhere (``legal-news``); compounds such as ``content-with-sidebar`` or
``category-ads`` say nothing.  Marks of elements around the page's ``h1`` or ``main`` don't count, but
for those of ``nav``, ``footer`` and ``aside``.

Scripts, styles, templates, forms' controls and comments are never text, nor do
they end a block.  Parsing is tolerant: unclosed and stray tags follow HTML's
rules for optional tags, so ``<p>`` closes an open ``<p>``, an end tag closes
what is open inside its element, and ``html``, ``head`` and ``body`` may be left
out or open.  A quote opens a value only behind ``=``.

Defined cases: a null or empty html gives an empty text; a page without content
blocks gives an empty text; text outside any element is a block of the body;
rows that repeat an id are pages of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.llm.common import ship

# Elements by their role in HTML.
OUTER = frozenset("html head body".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select option title canvas video audio map datalist noembed noframes xmp".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset".split())
CERTAIN = frozenset("nav footer aside".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

# Words in class, id and role that speak against and for content; words for containers; words that only describe; words that begin the name of a kind.
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer foot copyright legal disclaimer sidebar sidebars aside widget widgets related recommend recommended recommendations trending popular share sharing social follow comment comments commentlist disqus replies reply respond discussion tags tag toolbar search skip contentinfo complementary form rating".split()
)
FOR = frozenset("article articles content main bodytext entry post story text prose hentry".split())
CONTAINERS = frozenset("area bar block body bottom box button buttons card cell col column container content count footer form group header holder inner item items label left link links list main outer panel part posts right row section slot stories text title top unit widget wrap wrapper zone".split())
DESCRIBING = frozenset("with without has have no not is show hide and".split())
KINDS = frozenset("category cat topic tag term type format status".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>|</[^A-Za-z>][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def said_marks(said: str) -> tuple[int, int, int]:
    """How many words of a class, id or role speak fully against, a little against, and for content."""
    strong = weak = good = 0
    for token in said.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts or DESCRIBING & set(parts):
            continue
        names = [x for x in parts if not x.isdigit()] or parts
        if names[0] in KINDS and len(names) > 1 and names[-1] not in CONTAINERS:
            continue
        if "".join(names) in AGAINST or names[-1] in AGAINST or names[0] in AGAINST and names[-1] in CONTAINERS:
            strong += 1
        elif AGAINST & set(names):
            weak += 1
        elif "".join(names) in FOR or names[-1] in FOR or names[0] in FOR and names[-1] in CONTAINERS:
            good += 1
    return strong, weak, good


class _Element:
    __slots__ = ("name", "parent", "depth", "marks", "top", "boiler", "weak", "content", "hidden", "linked", "blocks")

    def __init__(self, name: str, parent, attributes: str = ""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.marks, off = (0, 0, 0), False
        if attributes.strip():
            found: dict[str, str] = {}
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), a or b or c)
            said = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if said.strip() and name not in ("main", "article"):
                self.marks = said_marks(said)
            style = found.get("style", "").replace(" ", "").lower()
            off = "hidden" in found or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true"
        #: Whether the page's title or main part lies inside.
        self.top = False
        self.blocks = 0
        self.hidden = (parent.hidden if parent else False) or name in RAW or off
        self.linked = (parent.linked if parent else False) or name in ("a", "button")

    def settle(self) -> None:
        """Marks with those of the elements around; to be called from the outside in, once all is read."""
        up = self.parent
        strong, weak, good = self.marks
        named = self.name in BOILER
        # An article's own header holds its title.
        if self.name == "header" and up is not None and up.content:
            named, strong = False, 0
        if self.top and self.name not in CERTAIN:
            named, strong, weak = False, 0, 0
        self.boiler = (up.boiler if up else 0) + named + strong
        self.weak = (up.weak if up else 0) + (weak if not good else 0)
        self.content = 0 if self.boiler else (up.content if up else 0) + (2 if self.name in ("article", "main") else 1 if good else 0)


class _Block:
    __slots__ = ("element", "parts", "linked")

    def __init__(self, element: _Element):
        self.element, self.parts, self.linked = element, [], 0


def text_blocks(source: str) -> list[tuple[_Element, str, float]]:
    """``(element, text, linked share)`` of each block of text, in page order."""
    root = _Element("body", None)
    stack, blocks, every, now = [root], [], [root], None

    def owner(element: _Element) -> _Element:
        while element.name in INLINE and element.parent is not None:
            element = element.parent
        return element

    def breaks(name: str, parent: _Element) -> bool:
        return name not in INLINE and name not in RAW and not parent.hidden

    def say(text: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.hidden:
            return
        if now is None:
            if not text.strip():
                return
            now = _Block(owner(top))
            blocks.append(now)
        now.parts.append(text)
        if top.linked:
            now.linked += len(text.strip())

    def close(at: int) -> None:
        nonlocal now
        if any(breaks(e.name, e.parent) for e in stack[at:]):
            now = None
        del stack[at:]

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            say(_html.unescape(source[at:]))
            break
        if m.start() > at:
            say(_html.unescape(source[at : m.start()]))
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                # An inline end tag does not close blocks around it.
                if name in INLINE and stack[i].name not in INLINE:
                    break
            continue
        if name in OUTER:
            continue
        if name in VOID:
            if name in ("br", "wbr"):
                say(" ")
            elif name == "hr":
                now = None
            continue
        if name in CLOSED_BY_BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
        elif name in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in SCOPE[name]:
                    break
                if stack[i].name in SAME[name]:
                    close(i)
        # Inline elements left open by a closed block do not reach into the next one; what is never text does not end a block.
        if breaks(name, stack[-1]):
            now = None
        if m[3].rstrip().endswith("/") and (name in INLINE or name in RAW):
            continue
        stack.append(_Element(name, stack[-1], m[3]))
        every.append(stack[-1])
        if name in ("h1", "main") and not stack[-1].hidden:
            up = stack[-1]
            while up is not None and not up.top:
                up.top, up = True, up.parent
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            stack.pop()
    for e in every:
        e.settle()
    out = []
    for b in blocks:
        text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if text:
            out.append((b.element, text, min(1.0, b.linked / len(text))))
    return out


# The classifier's weights, in thousandths.
BARE, LETTER, LETTERS, LINKED, STOP = -1200, 8, 300, -700, 500
MARK, WEAK_MARK, MARKS = -4000, -500, 2
ELEMENT = {"p": 600, "blockquote": 600, "pre": 600, "figcaption": 600, "h1": 500, "h2": 500, "h3": 500, "h4": 500, "h5": 500, "h6": 500, "li": 200, "td": 200, "th": 200, "dt": 200, "dd": 200}
#: Capacities: between neighbours; of any tie where marks differ; what it costs, for each block, to call an element that speaks for content boilerplate, and the page where nothing speaks.
NEIGHBOUR, ACROSS, CONTENT, BODY = 700, 100, 2500, 700
#: Of a block's tie to the element around it: without marks, where words speak for content, in an article or main part.
TIES = 900, 1400, 2000


def block_score(element: _Element, text: str, linked: float) -> int:
    """Evidence of the block alone: above 0 for content, below for boilerplate."""
    size = len(text)
    score = BARE + LETTER * min(size, LETTERS) * (1 - linked) + LINKED * linked
    score += STOP if size >= 25 and text[-1] in ".!?…:\"'”»" else 0
    score += ELEMENT.get(element.name, 0) + MARK * min(element.boiler, MARKS) + WEAK_MARK * min(element.weak, MARKS)
    return round(score)


def _shared_depth(a: _Element, b: _Element) -> int:
    """How many steps lie between two elements and their lowest common one, the longer way."""
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return max(a.depth, b.depth) - x.depth


def cut_problem(blocks: list[tuple[_Element, str, float]]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Scores and edges ``(i, j, capacity)``; the nodes behind the blocks are elements around several of them."""
    scores = [block_score(*b) for b in blocks]
    edges = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1][0], blocks[i][0]
        alike = (a.boiler, a.content) == (b.boiler, b.content)
        edges.append((i - 1, i, (NEIGHBOUR if alike else ACROSS) // (1 + _shared_depth(a, b))))
    below: dict[int, list[int]] = {}
    elements: dict[int, _Element] = {}
    for i, (e, _, _) in enumerate(blocks):
        while e is not None:
            elements[id(e)] = e
            below.setdefault(id(e), []).append(i)
            e = e.parent
    # An element with the same blocks as the one around it is no node of its own, but for its marks.
    nodes: dict[int, int] = {}
    for key in sorted(elements, key=lambda k: elements[k].depth):
        e = elements[key]
        own = e.content > (e.parent.content if e.parent is not None else 0)
        if e.parent is None or own or 1 < len(below[key]) < len(below[id(e.parent)]):
            nodes[key] = len(scores)
            # Of a page without any marks something is content.
            scores.append(CONTENT * len(below[key]) if own else BODY * sum(not (blocks[i][0].boiler or blocks[i][0].content) for i in below[key]) if e.parent is None else 0)

    def around(e):
        while e is not None and id(e) not in nodes:
            e = e.parent
        return e

    def tie(e, up, size: int) -> int:
        if (e.boiler, e.content) != (up.boiler, up.content):
            return ACROSS
        return size * TIES[min(up.content, 2)]

    for i, (e, _, _) in enumerate(blocks):
        up = around(e)
        edges.append((i, nodes[id(up)], tie(e, up, 1)))
    for key, node in nodes.items():
        e, up = elements[key], around(elements[key].parent)
        if up is not None:
            edges.append((node, nodes[id(up)], tie(e, up, len(below[key]))))
    return scores, edges


def minimum_cut(to_source: list[int], to_sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source (Dinic's maximum flow, then reachability)."""
    n = len(to_source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def link(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        # What both terminals would carry flows through at once.
        through = min(to_source[i], to_sink[i])
        if to_source[i] > through:
            link(s, i, to_source[i] - through, 0)
        if to_sink[i] > through:
            link(i, t, to_sink[i] - through, 0)
    for i, j, c in edges:
        link(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for a in queue:
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                at[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def extract_text(source: str) -> str:
    """The main text of a page: its content blocks in page order, two line feeds between them."""
    blocks = text_blocks(source)
    if not blocks:
        return ""
    scores, edges = cut_problem(blocks)
    keep = minimum_cut([max(x, 0) for x in scores], [max(-x, 0) for x in scores], edges)
    return "\n\n".join(text for (_, text, _), k in zip(blocks, keep) if k)


def _extract(batches):
    import pyarrow as pa

    for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
        found = [extract_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


ship(__name__)
