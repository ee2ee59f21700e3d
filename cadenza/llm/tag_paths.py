"""Main text of HTML pages by tag-path ratios.

Every text block belongs to the path of tags from the root to it; a block that is mostly link text has a path of its own.
Text length and punctuation are averaged per path over the page, smoothed over similar paths and fused to one score with
the share of text outside links and with the landmarks (``<article>``, ``<main>``). The scores of every page are cut at a
threshold of the page's own spread; a landmark alone keeps nothing. Headings and plain lists, tables and quotations that
stand beside chosen text follow it, with a class of their own or not. Elements that never hold the article (menus, scripts and
the like) score 0. Forms, dialogs, roles such as ``search``, and class names and ids such as ``sidebar`` or ``header`` only lower
the score of the paths below them, and not where the element holds the landmark or most of the page's text.

A path holds its first and last ``ENDS`` labels, so that markup that opens thousands of elements and closes none costs no more a
text than other markup does.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("script style noscript template iframe object svg math head title select option textarea button canvas audio video".split())
OUTSIDE = frozenset("nav footer aside menu".split())
#: Lower the score of what they hold, as a telling name does.
LOWERING = frozenset("form dialog".split())
#: Labels that a path keeps at its beginning and at its end.
ENDS = 24
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text that a class or id does not set apart from it.
TEXT = frozenset("p pre table thead tbody tfoot tr td th caption blockquote figure figcaption".split())
#: Without a class or id of their own, these too follow the text they stand in.
FLOW = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption p".split())
#: What a path outside the landmarks of its page keeps of its score.
OFF_LANDMARK = 0.5
#: A start tag of the left closes an open element of the right, up to the nearest of the third.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset()) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table"})),
    "th": (frozenset({"td", "th"}), frozenset({"table"})),
}
NOT_CONTENT = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|popup|modal|newsletter|subscribe|"
    r"comments?|respond|replies|reply|disqus|reader-?comments?|side-?bar|widgets?|related|recommend(?:ed|ations)?|"
    r"menu|nav(?:bar|igation)?|breadcrumbs?|pagination|pager|toc|footer|copyright|login|hidden)(?:$|[^a-z])"
)
#: Words that the article's own parts carry too.
SELDOM_CONTENT = re.compile(r"(?:^|[^a-z])(?:banner|notices?|alert|share|sharing|social|header|masthead|legal|search|tags)(?:$|[^a-z])")
#: What a path keeps of its score below an element of such a name, by the mark at the end of the element's label.
NAMED = {"!": 0.2, "^": 0.6}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
PUNCT = re.compile(r"[.,;:!?。、，！？；：…]")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "label", "name", "parent", "skip", "out", "main", "link", "size", "inside", "direct", "path")

    def __init__(self, tag, label="", name="", parent=None, skip=False, out=False, main=False, link=False):
        self.tag, self.label, self.name, self.parent = tag, label, name, parent
        self.skip, self.out, self.main, self.link = skip, out, main, link
        self.size = self.inside = self.direct = 0
        self.path = None


class Node:
    __slots__ = ("at", "path", "text", "block", "out", "main", "link")

    def __init__(self, at, text, block):
        self.at, self.text, self.block = at, text, block
        self.out, self.main, self.link = at.out, at.main, at.link


class Reader(HTMLParser):
    """Text nodes of a page in order, each with its tag path, its block and whether it lies outside the article."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        self.open: Counter = Counter()  # tags on the stack
        self.nodes: list[Node] = []
        self.block = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.block += 1
            elif tag == "br" and self.nodes:
                self._add(" ")
            return
        closed, limit = CLOSES.get(tag, ((), ()))
        if any(self.open[t] for t in closed):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in closed:
                    self._cut(k)
                    break
                if self.stack[k].tag in limit or not limit and self.stack[k].tag not in INLINE:
                    break
        marks = {k: (v or "") for k, v in attrs}
        at = self.stack[-1] if self.stack else self.root
        named = f"{marks.get('class', '')} {marks.get('id', '')}".lower().strip()
        main = at.main or tag in MAIN or marks.get("role", "").lower() == "main"
        out = at.out or tag in OUTSIDE or tag == "header" and not main
        name = "!" if tag in LOWERING or marks.get("role", "").lower() in ROLES else ""
        if not name and named and tag not in ("html", "body") and tag not in MAIN:
            name = "!" if NOT_CONTENT.search(named) else "^" if SELDOM_CONTENT.search(named) else ""
        skip = at.skip or tag in SKIP or "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "").lower()
        if tag not in INLINE:
            self.block += 1
        new = Element(tag, tag + ("." + named.split()[0] if named else ""), name, at, skip, out, main, at.link or tag == "a")
        self.stack.append(new)
        self.open[tag] += 1
        self.elements.append(new)

    def _cut(self, k):
        for x in self.stack[k:]:
            self.open[x.tag] -= 1
        del self.stack[k:]

    def handle_endtag(self, tag):
        if not self.open[tag]:
            self.block += tag == "p"
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if tag not in INLINE:
                    self.block += 1
                self._cut(k)
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return  # a stray end tag does not close the block around it

    def handle_data(self, data):
        self._add(data)

    def _add(self, data):
        at = self.stack[-1] if self.stack else self.root
        if not at.skip:
            self.nodes.append(Node(at, data, self.block))

    def close(self):
        super().close()
        self._weigh()
        self.root.path = ()
        for e in self.elements:  # parents come first
            path = e.parent.path
            if e.name or e.tag not in INLINE:
                path = (*path[:ENDS], *path[ENDS + 1 :], e.label + e.name) if len(path) == 2 * ENDS else (*path, e.label + e.name)
            e.path = path
        for x in self.nodes:
            x.path = x.at.path

    def _weigh(self):
        """Take back the names of elements that hold the landmark, or most of the text in blocks below their own."""
        for x in self.nodes:
            if not x.out:
                n = len(x.text.strip())
                x.at.size += n
                x.at.inside += n * x.main
                e = x.at
                while e.tag in INLINE:
                    e = e.parent
                e.direct += n
        for e in reversed(self.elements):  # children stand after their parents
            e.parent.size += e.size
            e.parent.inside += e.inside
        for e in self.elements:
            if e.name and e.tag not in INLINE and (2 * (e.size - e.direct) > self.root.size or not e.parent.main and 2 * e.inside > self.root.inside):
                e.name = ""


def kernel(shared: int, a: int, b: int) -> float:
    """Weight of two paths of ``a`` and ``b`` labels that begin with the same ``shared`` ones."""
    return math.exp(-(((1 - shared / max(a, b, 1)) / 0.2) ** 2))


def smoothed(ratio: dict[tuple[str, ...], tuple[float, float]]) -> dict[tuple[str, ...], tuple[float, float]]:
    """Means of the paths' two ratios, each path weighted by ``kernel``.

    The weight follows from the shared beginning and the two lengths alone, so paths are added up by length at every
    node of the tree of their beginnings, and a path meets the sums at its nodes instead of all other paths.
    """
    tree: dict[tuple[int, str], int] = {}
    sums: list[dict[int, list[float]]] = [{}]
    nodes = {}
    for p, (text, punct) in ratio.items():
        at = [0]
        for label in p:
            at.append(tree.setdefault((at[-1], label), len(sums)))
            if at[-1] == len(sums):
                sums.append({})
        nodes[p] = at
        for k in at:
            held = sums[k].setdefault(len(p), [0.0, 0.0, 0.0])
            held[0] += 1
            held[1] += text
            held[2] += punct

    def added(total: tuple, node: int, below: int | None, shared: int, length: int) -> tuple:
        """``total`` and the paths through ``node`` but not ``below``, by their weight for a path of ``length``."""
        n, text, punct = total
        for other, (m, t, q) in sums[node].items():
            less = sums[below].get(other, (0.0, 0.0, 0.0)) if below is not None else (0.0, 0.0, 0.0)
            w = kernel(shared, length, other)
            n, text, punct = n + w * (m - less[0]), text + w * (t - less[1]), punct + w * (q - less[2])
        return n, text, punct

    known: dict[tuple[int, int], tuple] = {}  # (node, length of the path): sums over all paths that leave it above the node
    out = {}
    for p, at in nodes.items():
        length, k = len(p), len(p)
        while k and (at[k], length) not in known:
            k -= 1
        total = known.get((at[k], length), (0.0, 0.0, 0.0))
        for d in range(k, length):
            total = known[at[d + 1], length] = added(total, at[d], at[d + 1], d, length)
        n, text, punct = added(total, at[length], None, length, length)
        out[p] = text / n, punct / n
    return out


def split_links(nodes: list[Node]) -> None:
    """Give blocks that are mostly link text a path of their own, so that link lists are not averaged with plain ones."""
    size: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for x in nodes:
        if not x.out:
            size[x.block, x.path][x.link] += len(x.text.strip())
    for x in nodes:
        plain, linked = size.get((x.block, x.path), (0, 0))
        if linked > plain:
            x.path = (*x.path, "a")


def scores(nodes: list[Node]) -> dict[tuple[str, ...], float]:
    """Fused ratio of each path: its own and the smoothed one, so that neighbours alone do not lift a short path."""
    chars, linked, marks, inside = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    blocks = defaultdict(set)
    for x in nodes:
        text = x.text.strip()
        if text and not x.out:
            chars[x.path] += len(text)
            linked[x.path] += len(text) * x.link
            inside[x.path] += len(text) * x.main
            marks[x.path] += len(PUNCT.findall(text))
            blocks[x.path].add(x.block)
    ratio = {p: (chars[p] / len(blocks[p]), marks[p] / len(blocks[p])) for p in chars}
    landmark = any(inside.values())
    smooth: dict[tuple[str, ...], float] = {}
    near = smoothed(ratio)
    for p in ratio:
        text, punct = near[p]
        term = OFF_LANDMARK + (1 - OFF_LANDMARK) * inside[p] / chars[p] if landmark else 1.0
        own = ratio[p][0] * (1 + ratio[p][1])
        term *= min((NAMED.get(label[-1:], 1.0) for label in p), default=1.0)
        smooth[p] = math.sqrt(math.sqrt(own * text * (1 + punct))) * (1 - linked[p] / chars[p]) * term
    return smooth


def tag_of(label: str) -> str:
    return label.rstrip("^").split(".")[0]


def flows(label: str) -> bool:
    return label in FLOW or label[-1] not in NAMED and tag_of(label) in TEXT


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of what a heading, list, table, quotation or paragraph stands in; a heading stands beside its header."""
    n, heading = len(path), False
    while n and (flows(path[n - 1]) or path[n - 1][-1] != "!" and tag_of(path[n - 1]) in HEADINGS):
        n -= 1
        heading = heading or not flows(path[n])
    while heading and n and (path[n - 1][-1] == "^" or tag_of(path[n - 1]) in ("header", "hgroup")):
        n -= 1
    return path[:n]


def follows(path: tuple[str, ...], roots: set[tuple[str, ...]]) -> bool:
    """Whether a path stands beside chosen text; a title may also stand in a box beside the box of the text."""
    at = container(path)
    if at == path or path[-1] == "a":
        return False
    if at in roots:
        return True
    boxed = len(at) == len(path) - 1 and tag_of(path[-1]) == "h1" and at and at[-1][-1] not in NAMED
    return bool(boxed) and any(x not in ("html", "body") for x in at[:-1]) and any(r[: len(at) - 1] == at[:-1] for r in roots)


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty for null or where nothing is left."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    nodes = reader.nodes
    split_links(nodes)
    score = scores(nodes)
    if not score:
        return ""
    values = sorted(score.values())
    middle = sum(values) / len(values)
    spread = math.sqrt(sum((v - middle) ** 2 for v in values) / len(values))
    half = 0.5 * values[-1]
    threshold = min(spread, half)
    kept = {p for p, v in score.items() if v >= (half if any(label[-1:] == "!" for label in p) else threshold)}
    roots = {container(p) for p in kept}
    kept |= {p for p in score if follows(p, roots)}
    blocks: dict[int, list[str]] = defaultdict(list)
    for x in nodes:
        if not x.out and (x.path in kept or not x.text.strip()):
            blocks[x.block].append(x.text)
    texts = (SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; null, empty or broken markup gives what text it has. Repeated rows stay.

    Pages of any length and depth are read whole. Paths of equal score are chosen or left together, as the threshold is one number.
    """

    def make():
        def batch(ids, urls, htmls):
            texts = [main_text(h) for h in htmls]
            return ids, urls, texts, [len(t) for t in texts]

        return batch

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return map_arrow(pages, [id_col, url_col, html_col], make, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
