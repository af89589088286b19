"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text, that end a block, and that have no end tag.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea option button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; any other element, or text, ends one whose end tag is left out. Blocks end a control without an end tag.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title object".split())
CONTROLS = {tag: re.compile(rf"<(/?){tag}\b", re.I) for tag in ("button", "option", "select")}
#: Words of class, id and role, and elements, that speak for content or against it, with their weights in nats.
FOR_TAGS = {"article": 4.0, "main": 3.0, "p": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "blockquote": 0.8, "pre": 0.8, "figcaption": 0.3, "td": 0.2}
AGAINST_TAGS = {"nav": 9.0, "footer": 9.0, "header": 5.0, "aside": 8.0, "form": 9.0, "menu": 7.0, "dialog": 7.0, "fieldset": 6.0, "address": 2.0, "li": 0.3}
FOR_NAMES = frozenset("article articles content story post entry main text body articlebody articletext bodytext maincontent".split())
AGAINST_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsors sponsored promo promos promotion nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer header masthead "
    "comment comments commentlist disqus respond response responses reply replies reader readers cookie cookies consent notice notices gdpr newsletter newsletters subscribe subscription signup login share shares sharing sharebar social "
    "related recommend recommended recommendations widget widgets popup modal pagination pager toolbar search searchbox meta tags legal copyright skip skiplink".split()
)
#: Parts of a name, at hyphens, underscores and capitals; and words written apart that make one.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
TOGETHER = frozenset(("side bar", "sign up", "log in", "pop up", "mast head", "bread crumb", "bread crumbs"))
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
MARKS = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in ("script", "style", "textarea", "title")}
#: Costs of separating neighbours: in the page, and by how near they stand in the tree.
NEXT, NEAR = 0.6, 1.2


class Block:
    """A run of text: what the elements around it say, whether it is inside an article, how many block elements are around it, the last two, and how many of them it shares with the block before."""

    __slots__ = ("around", "depth", "inside", "linked", "own", "parent", "parts", "shared")

    def __init__(self, around: float, inside: bool, depth: int, own: int, parent: int, shared: int):
        self.around, self.inside, self.depth, self.own, self.parent, self.shared = around, inside, depth, own, parent, shared
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Around:
    """The open elements: where each kind stands, and what their tags and names say, kept up to date as they come and go."""

    def __init__(self):
        self.tags: list[str] = []
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[tuple[int, int]] = []
        self.said: dict[str, int] = {}
        self.worth: dict[str, float] = {}
        self.score = 0.0
        self.silent = 0

    def name(self, tag: str, names: str) -> float:
        """What the names say, of an article or main element no more against it than a header inside one would."""
        self.worth[names] = max(named(names), -1.0) if tag in ("article", "main") else named(names)
        return self.worth[names]

    def top(self, tag: str) -> int:
        """Where the innermost element of this kind stands, -1 without one."""
        return self.at[tag][-1] if self.at.get(tag) else -1

    def innermost_block(self) -> int:
        return self.blocks[-1][0] if self.blocks else -1

    def push(self, tag: str, number: int, names: str) -> None:
        own = self.at.setdefault(tag, [])
        if not own and tag != "header":
            self.score += FOR_TAGS.get(tag, 0.0) - AGAINST_TAGS.get(tag, 0.0)
        own.append(len(self.tags))
        if names:
            self.said[names] = self.said.get(names, 0) + 1
            if self.said[names] == 1:
                self.score += self.name(tag, names)
        if tag in BLOCKS:
            self.blocks.append((len(self.tags), number))
        self.silent += tag in SILENT
        self.tags.append(tag)
        self.names.append(names)

    def pop(self) -> str:
        tag, names = self.tags.pop(), self.names.pop()
        self.at[tag].pop()
        if not self.at[tag] and tag != "header":
            self.score -= FOR_TAGS.get(tag, 0.0) - AGAINST_TAGS.get(tag, 0.0)
        if names:
            self.said[names] -= 1
            if not self.said[names]:
                del self.said[names]
                self.score -= self.worth.pop(names)
        if tag in BLOCKS:
            self.blocks.pop()
        self.silent -= tag in SILENT
        return tag

    def inside(self) -> bool:
        return bool(self.at.get("article") or self.at.get("main"))

    def leaning(self) -> float:
        """What the elements around say; each tag and each list of names counts once, a header less inside an article."""
        header = AGAINST_TAGS["header"] * (0.2 if self.inside() else 1.0) if self.at.get("header") else 0.0
        return self.score - header


def named(names: str) -> float:
    """What the names of class, id and role say, each by the last of its parts that says something: a social-content is content, a content-sidebar none.

    Only whole parts count: neither research is a search, nor metadata meta. One name against weighs more than all for.
    """
    score = 0.0
    for name in names.split():
        parts = [x.lower() for x in PARTS.findall(name)]
        for k in range(len(parts) - 1, -1, -1):
            if parts[k] in AGAINST_NAMES or " ".join(parts[max(0, k - 1) : k + 1]) in TOGETHER:
                return -7.0
            if parts[k] in FOR_NAMES:
                score = 2.0
                break
    return score


class TagEnds:
    """Where tags end: at the first > outside of quotes. Each quote is looked at once as the first of a pair, however many tags it leaves open."""

    def __init__(self, page: str):
        self.page = page
        self.marks: list[int] | None = None
        self.open: set[int] = set()

    def __call__(self, at: int) -> int:
        """The position of the > that ends a tag whose name ends at `at`; -1 without one."""
        if self.marks is None:
            m = PLAIN.match(self.page, at)
            if m:
                return m.end() - 1
            self.marks = [m.start() for m in MARKS.finditer(self.page)]
        i, passed = bisect_left(self.marks, at), []
        while i < len(self.marks) and (p := self.marks[i]) not in self.open:
            if self.page[p] == ">":
                return p
            passed.append(p)
            q = self.page.find(self.page[p], p + 1)
            i = bisect_left(self.marks, q + 1) if q >= 0 else len(self.marks)
        self.open.update(passed)
        return -1


def tokens(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, name, attributes) of all tags, comments and the like, these without a name; an end tag's name begins with a slash.

    A tag that never ends is text. The caller may send a position from which to go on.
    """
    at, ends = 0, TagEnds(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        m = NAME.match(page, at + 1)
        if m is None:
            for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if page.startswith(begin, at):
                    end = page.find(close, at + len(begin))
                    end = len(page) if end < 0 else end + len(close)
                    yield at, end, "", ""
                    at = end
                    break
            else:
                at += 1
            continue
        end = ends(m.end())
        if end < 0:
            at += 1
            continue
        to = yield at, end + 1, m.group().lower(), page[m.end() : end]
        at = max(end + 1, to or 0)


def blocks(page: str) -> list[Block]:
    """The page's runs of text between block elements, with what is around each; in time linear in the page's length."""
    out: list[Block] = []
    around = Around()
    number = links = 0
    now: Block | None = None
    at = shared = 0
    ends: dict[str, int] = {}

    def leave(k: int) -> None:
        nonlocal links, now, shared
        while len(around.tags) > k:
            tag = around.pop()
            links -= tag == "a"
            if tag in BLOCKS:
                now = None
        shared = min(shared, len(around.blocks))

    def said(raw: str) -> None:
        nonlocal now, shared
        if around.silent and around.tags[-1] == "head" and raw and not raw.isspace():
            leave(len(around.tags) - 1)
        if around.silent or not raw:
            return
        if now is None:
            if raw.isspace():
                return
            own, depth = around.blocks, len(around.blocks)
            now = Block(around.leaning(), around.inside(), depth, own[-1][1] if own else 0, own[-2][1] if depth > 1 else 0, shared)
            shared = depth
            out.append(now)
        text = html.unescape(raw)
        now.parts.append(text)
        if links:
            now.linked += len(text.strip())

    def held(control: str) -> bool:
        """Whether the open control has an end tag before the next one like it begins."""
        if ends.get(control, -1) < at:
            m = CONTROLS[control].search(page, at)
            ends[control] = m.start() if m and m[1] else -1
        return ends[control] >= at

    found = tokens(page)
    token = next(found, None)
    while token is not None:
        begin, end, tag, attributes = token
        said(page[at:begin])
        at = end
        skip = None
        if tag.startswith("/"):
            tag = tag[1:]
            k = around.top(tag)
            if k >= 0 and (tag in BLOCKS or k > around.innermost_block()):
                leave(k)
            if tag in BLOCKS:
                now = None
        elif tag:
            if around.silent:
                head = around.at["head"][0] if around.at.get("head") else -1
                if tag not in IN_HEAD and head >= 0 and max(around.top(t) for t in IN_HEAD) == head:
                    leave(head)
                control = min((around.at[c][0] for c in CONTROLS if around.at.get(c)), default=None)
                if control is not None and tag in BLOCKS and tag != "hr" and not held(around.tags[control]):
                    leave(control)
            if tag in BLOCKS:
                now = None
            if tag == "br" and now is not None and not around.silent:
                now.parts.append(" ")
            if tag not in VOID:
                closes = SELF_CLOSING.get(tag, ())
                k = around.innermost_block()
                if (j := around.top("option")) > k and "option" in closes:
                    leave(j)
                elif k >= 0 and (around.tags[k] in closes or (around.tags[k] == "p" and tag in BLOCKS)):
                    leave(k)
                if tag in RAW and not attributes.endswith("/"):
                    m = RAW[tag].search(page, at)
                    at = skip = m.end() if m else len(page)
                elif not attributes.endswith("/") or tag in BLOCKS:
                    number += 1
                    names = " ".join(next(g for g in x if g) for x in NAMES.findall(attributes) if any(x)) if "=" in attributes else ""
                    around.push(tag, number, names)
                    links += tag == "a"
        try:
            token = found.send(skip)
        except StopIteration:
            token = None
    said(page[at:])
    kept: list[Block] = []
    low = 0
    for b in out:
        low = min(low, b.shared)
        if b.text():
            b.shared, low = low, len(page)
            kept.append(b)
    return kept


def leaning(b: Block, text: str) -> float:
    """The classifier's log-odds for content, from the elements and names around a block, its length, links and sentences."""
    chars = len(text)
    score = 0.4 * min(4.0, math.log1p(chars / 20)) - 0.8
    # Links inside an article are part of it, as long as no name says otherwise.
    score -= (1.0 if b.inside else 4.0) * min(1.0, b.linked / max(1, chars))
    score += 0.5 * min(3, sum(text.count(c) for c in ".!?;")) - (0.7 if chars < 20 else 0.0)
    return score + b.around


def decided(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool | None]:
    """The labels that every cheapest cut has: of nodes whose gain outweighs all their edges, given those decided before; None for the rest."""
    near: list[list[tuple[int, float]]] = [[] for _ in gain]
    for u, v, c in edges:
        near[u].append((v, c))
        near[v].append((u, c))
    lean, free = list(gain), [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * len(gain)
    todo = list(range(len(gain)))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(lean[i]) > free[i] + 1e-9:
            side[i] = lean[i] > 0
            for j, c in near[i]:
                if side[j] is None:
                    lean[j] += c if side[i] else -c
                    free[j] -= c
                    todo.append(j)
    return side


def source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling with the least cost: -gain of each node marked (gain > 0 lost where not), and each edge cut.

    Nodes that no edges can turn are labelled first, and push their neighbours; the maximum flow of
    the others decides the rest.
    """
    side = decided(gain, edges)
    left = [i for i, x in enumerate(side) if x is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        lean = [gain[i] for i in left]
        inner = []
        for u, v, c in edges:
            if u in place and v in place:
                inner.append((place[u], place[v], c))
            elif u in place or v in place:
                i, j = (u, v) if u in place else (v, u)
                lean[place[i]] += c if side[j] else -c
        for i, x in zip(left, maximum_flow(lean, inner), strict=True):
            side[i] = x
    return [bool(x) for x in side]


def maximum_flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether the source still reaches each node after the maximum flow.

    The flow runs from a source, which feeds nodes of positive gain, to a sink, which drains the
    others, along shortest augmenting paths in level graphs.
    """
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(c)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(s, i, g, 0.0)
        elif g < 0:
            join(i, t, -g, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            u = todo.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


def main_text(page: str | None) -> str:
    """The blocks on the content side of the page's minimum cut, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    texts = [b.text() for b in found]
    gain = [leaning(b, t) for b, t in zip(found, texts, strict=True)]
    edges = []
    last_of: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            near = (b.shared + 1) / (max(found[i - 1].depth, b.depth) + 1)
            edges.append((i - 1, i, NEXT * near + NEAR * (near >= 0.999)))
        # The block before under the same parent, where others stand between them.
        j = last_of.get(b.parent)
        if j is not None and j < i - 1:
            same = min(found[j].depth, b.depth) - (found[j].own != b.own and b.depth > 0 and found[j].depth > 0)
            edges.append((j, i, NEAR * (same + 1) / (max(found[j].depth, b.depth) + 1)))
        last_of[b.parent] = i
    side = source_side(gain, edges)
    return "\n".join(t for t, keep in zip(texts, side, strict=True) if keep)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Returns key, url, text (the page's main text, empty if none) and n_chars (its code points) of each row.

    Each block's leaning from the classifier becomes its capacity from the source or to the sink;
    neighbours in the page and blocks under one parent are joined by edges; blocks left on the
    source's side of the minimum cut are content. Character references are decoded, white space in
    a block becomes one space, blocks are joined by line ends.

    Null and empty pages have an empty text, and so do pages without text; markup that breaks off or
    is not closed ends with the page. Repeated rows are extracted alike; null keys and urls stay. An
    empty table gives no rows; other columns are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pages.schema[c].dataType for c in (key, url)]
    schema = pa.schema([*((c, to_arrow_type(k)) for c, k in zip((key, url), kinds, strict=True)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                text = pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], schema=schema)

    sql = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip((key, url), kinds, strict=True))
    out = pages.select(key, url, F.col(body).cast("string").alias("_html")).mapInArrow(run, f"{sql}, text string")
    return out.select(key, url, "text", F.char_length("text").cast("long").alias("n_chars"))
