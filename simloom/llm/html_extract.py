"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each below an element whose tag path
(tag names and first class from the root down, ids left out) it shares with
others. Per path the text outside links, its punctuation marks and the blocks
are added up. The ratios text per block and punctuation per block are smoothed
along the path, each step up counting half as much as the one below, and fused
by multiplication; a block's value is smoothed again over its neighbours in the
page, by how much of their paths they share. Paths whose values lie above the
page's own deviation are content; a path with the same tags as one of those
(classes left out) needs a quarter of that.

The innermost element that holds most of the content text is the container; an
``article`` or ``main`` around it that holds little else is taken instead.
Blocks inside the container are kept with it (headings, captions, short lists),
and content paths outside it too. Where the page has no container but its body,
only what stands between the first and the last content block is kept, and the
headings just before. Blocks
made of link text never are, nor are elements that say by tag, role or class
that they are menus, adverts, forms, notices or reader comments.

Time and memory grow with the length of the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path is content from this share of the deviation of the page's block values on, one with the tags of a content path from this share of that.
DEVIATION, LIKE = 1.0, 0.25
#: The container holds this share of the content text.
MOST = 0.8
#: A path with a larger share of link text is a menu.
LINKS = 0.6
#: Neighbouring blocks on either side and their weights in smoothing.
NEIGHBOURS = (0.6, 0.15)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style textarea title xmp noframes noembed iframe noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROP = frozenset(
    "head nav footer aside form script style textarea title noframes noembed iframe noscript template menu dialog button select option svg math canvas object audio video map fieldset".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BOILER = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|advert\w*|adbox|adsense|banner\w*|breadcrumbs?|byline-share|comments?|comment-?list|cookies?|consent|disqus|discussion|dialog|footer|gdpr|"
    r"hidden|login|masthead|menu\w*|modal|nav\w*|newsletter|notices?|notification\w*|pager|pagination|popup|popover|promo\w*|recommend\w*|related|replies|reply|respond|"
    r"rss|share\w*|sharing|sidebar\w*|signup|skip|skyscraper|social\w*|sponsor\w*|subscribe|subscription|tags|toolbar|widget\w*|user-?comments?|reader-?comments?)(?:$|[-_\s\d])",
    re.I,
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of text; a container is around them.
_LEAVES = _HEADINGS | frozenset("p li dt dd blockquote pre".split())
_PUNCT = re.compile(r"[.,;:!?…、。،؛؟।，：；！？]")
_CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("tr td th", "table"), "tbody": ("thead tbody tr td th", "table"),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_BOUND = frozenset("td th table caption body html button object".split())


class Paths:
    """Tag paths as a tree: each node is a step below its parent, equal paths are one node."""

    def __init__(self) -> None:
        self.parent, self.depth, self.known = [-1], [0], {}

    def below(self, node: int, step: str) -> int:
        found = self.known.get((node, step))
        if found is None:
            found = self.known[node, step] = len(self.parent)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
        return found

    def likeness(self, a: int, b: int) -> float:
        """Share of their steps that two paths have in common; paths of more than 64 further steps count as unlike."""
        if a == b:
            return 1.0
        total = self.depth[a] + self.depth[b]
        for _ in range(64):
            if a == b:
                return 2 * self.depth[a] / total if total else 1.0
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return 0.0


@dataclass
class Element:
    """An open or closed element: flags hold for all that is below it."""

    tag: str
    parent: int
    path: int
    bare: int
    drop: bool
    link: bool
    inside: bool


@dataclass
class Block:
    """Consecutive text under one block element."""

    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _unwanted(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Never content, by the element's own tag, role or style."""
    if tag in _DROP or (tag == "header" and not inside_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in _ROLES


def _named(tag: str, attrs: dict[str, str]) -> bool:
    """Said to be no content by class or id."""
    if tag in ("body", "html", "article", "main"):
        return False
    return any(_BOILER.search(v) for v in (attrs.get("class", ""), attrs.get("id", "")) if v)


class _Reader:
    """Builds blocks and elements from markup; the stack is indexed by tag, so no step looks through it."""

    def __init__(self) -> None:
        self.paths, self.elements, self.blocks = Paths(), [Element("", -1, 0, 0, False, False, False)], []
        self.stack: list[int] = [0]
        self.at: dict[str, list[int]] = {}  # tag -> places in the stack
        self.solid: list[int] = [0]  # places of elements other than inline ones
        self.bound: list[int] = []
        self.named: list[int] = []
        self.current: Block | None = None

    def place(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop(self, to: int) -> None:
        if self.solid[-1] >= to:
            self.current = None
        while len(self.stack) > to:
            i = len(self.stack) - 1
            self.at[self.elements[self.stack.pop()].tag].pop()
            for places in (self.solid, self.bound):
                if places and places[-1] == i:
                    places.pop()

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        up = self.elements[self.stack[-1]]
        inline = tag in _INLINE
        step = tag + "".join(f".{c}" for c in attrs.get("class", "").split()[:1])
        path, bare = (up.path, up.bare) if inline else (self.paths.below(up.path, step), self.paths.below(up.bare, f"<{tag}"))
        e = Element(tag, self.stack[-1], path, bare, up.drop or _unwanted(tag, attrs, up.inside), up.link or tag == "a", up.inside or tag in ("article", "main"))
        if not e.drop and _named(tag, attrs):
            self.named.append(len(self.elements))
        self.at.setdefault(tag, []).append(len(self.stack))
        if not inline:
            self.solid.append(len(self.stack))
            self.current = None
        if tag in _BOUND:
            self.bound.append(len(self.stack))
        self.stack.append(len(self.elements))
        self.elements.append(e)

    def say(self, text: str) -> None:
        if not text or (self.current is None and not text.strip()):
            return
        here = self.elements[self.stack[-1]]
        if self.current is None:
            self.current = Block(self.stack[self.solid[-1]])
            self.blocks.append(self.current)
        if here.drop:
            return
        decoded = html.unescape(text)
        self.current.parts.append(decoded)
        if here.link:
            self.current.linked += len(decoded.strip())

    def read(self, page: str) -> None:
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() < at:
                continue
            self.say(page[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self.say(html.escape(m[1]))
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                to = self.place((tag,))
                if to >= 0 and not ((tag in _INLINE or tag == "p") and self.bound and self.bound[-1] > to):
                    self.pop(to)
                if tag not in _INLINE:
                    self.current = None
                continue
            if tag in ("br", "hr"):
                self.current = None
            if tag in _VOID:
                continue
            if tag in _CLOSES:
                closes, bound = _CLOSES[tag]
                stop = self.place(bound)
                while (to := self.place(closes)) > stop:
                    self.pop(to)
            elif tag not in _INLINE and self.elements[self.stack[self.solid[-1]]].tag == "p":
                self.pop(self.solid[-1])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
                at = end.end()
                if tag not in _INLINE:
                    self.current = None
                continue
            if m[4].endswith("/") and tag in ("svg", "math", "path"):
                continue
            self.push(tag, {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[4])})
        self.say(page[at:])


def _dropped(r: _Reader) -> list[bool]:
    """Whether each element is no content: by its own signs or those above it.

    A class or id says nothing about an element around the page's ``main`` or first heading.
    """
    around = set()
    for i, e in enumerate(r.elements):
        if e.tag in ("main", "h1") and not e.drop:
            while i > 0 and i not in around:
                around.add(i)
                i = r.elements[i].parent
    out, named = [], set(r.named) - around
    for i, e in enumerate(r.elements):
        out.append(e.drop or i in named or (i > 0 and out[e.parent]))
    return out


def _values(paths: Paths, found: list[tuple[int, int, int]]) -> list[float]:
    """Smoothed, fused ratio of each block; ``found`` holds path, text length outside links, and marks."""
    n = len(paths.parent)
    own, below = [[0, 0, 0] for _ in range(n)], [[0, 0, 0] for _ in range(n)]
    for path, length, marks in found:
        for sums in (own[path], below[path]):
            sums[0] += length
            sums[1] += marks
            sums[2] += 1
    for i in range(n - 1, 0, -1):  # parents come before their children
        for k in range(3):
            below[paths.parent[i]][k] += below[i][k]
    ratio = lambda s: (s[0] / s[2], s[1] / s[2]) if s[2] else (0.0, 0.0)
    up: list[tuple[float, float]] = []
    for i in range(n):
        a, b = ratio(below[i]), up[paths.parent[i]] if i else ratio(below[0])
        up.append(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))
    fused = {}
    for path, _, _ in found:
        if path not in fused:
            a, b = ratio(own[path]), up[paths.parent[path]] if path else up[0]
            fused[path] = (a[0] + b[0]) / 2 * (0.1 + (a[1] + b[1]) / 2)
    out = []
    for i, (path, _, _) in enumerate(found):
        total, weight = fused[path], 1.0
        for away, w in enumerate(NEIGHBOURS, 1):
            for j in (i - away, i + away):
                if 0 <= j < len(found):
                    alike = w * paths.likeness(path, found[j][0]) ** 2
                    total, weight = total + alike * fused[found[j][0]], weight + alike
        out.append(total / weight)
    return out


def _container(r: _Reader, content: list[tuple[int, int]]) -> int:
    """The innermost element with most of the text of ``content`` (element, length), or an article or main close around it."""
    held = [0] * len(r.elements)
    for e, length in content:
        held[e] += length
    for i in range(len(r.elements) - 1, 0, -1):
        held[r.elements[i].parent] += held[i]
    best = max((i for i in range(len(held)) if held[i] >= MOST * held[0]), default=0)
    # Elements come in order of their start, so the last that holds most is the innermost.
    while r.elements[best].tag in _LEAVES:
        best = r.elements[best].parent
    i = best
    while i > 0:
        if r.elements[i].tag in ("article", "main"):
            return i
        i = r.elements[i].parent
    return best


def main_text(page: str | None) -> str:
    """The content blocks' texts, one a line; empty for a null, empty or textless page."""
    r = _Reader()
    r.read(page or "")
    dropped = _dropped(r)
    found = [(b, t) for b in r.blocks if not dropped[b.element] and (t := b.text())]
    if not found:
        return ""
    path = [r.elements[b.element].path for b, _ in found]
    linked, total = {}, {}
    for (b, t), p in zip(found, path, strict=True):
        linked[p], total[p] = linked.get(p, 0) + min(b.linked, len(t)), total.get(p, 0) + len(t)
    menu = [linked[p] > LINKS * total[p] for p in path]
    if all(menu):
        menu = [False] * len(found)
    values = _values(r.paths, [(p, max(0, len(t) - b.linked) if not m else 0, len(_PUNCT.findall(t)) if not m else 0) for (b, t), p, m in zip(found, path, menu, strict=True)])
    mean = sum(values) / len(values)
    threshold = DEVIATION * (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    strong: dict[int, list[float]] = {}
    for p, v in zip(path, values, strict=True):
        strong.setdefault(p, []).append(v)
    value = {p: sum(v) / len(v) for p, v in strong.items()}
    bare = [r.elements[b.element].bare for b, _ in found]
    tags = {b for b, p, m in zip(bare, path, menu, strict=True) if value[p] >= threshold and not m}
    content = [i for i, p in enumerate(path) if not menu[i] and (value[p] >= threshold or bare[i] in tags and value[p] >= LIKE * threshold)]
    content = content or [i for i in range(len(found)) if not menu[i]]
    box = _container(r, [(found[i][0].element, len(found[i][1])) for i in content])
    within = [False] * len(r.elements)
    for i, e in enumerate(r.elements):
        within[i] = i == box or (i > 0 and within[e.parent])
    if r.elements[box].tag in ("", "html", "body"):
        first = content[0]
        while first and r.elements[found[first - 1][0].element].tag in _HEADINGS:
            first -= 1
        keep = [first <= i <= content[-1] for i in range(len(found))]
    else:
        keep = [within[b.element] for b, _ in found]
    chosen = set(content)
    return "\n".join(t for i, (b, t) in enumerate(found) if (keep[i] or i in chosen) and not (menu[i] and b.linked >= len(t)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null or empty html gives an empty text, broken markup what can be read
    of it; pages are read whole, however long or deep. Rows are independent:
    repeated rows give repeated results, an empty table an empty one; other
    columns are ignored.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
