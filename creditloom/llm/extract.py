"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import prepare, slices

#: Elements whose content is no text of the page.
SILENT = "script style noscript template svg math iframe object select textarea button canvas audio video head"
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul "
    "caption option optgroup title".split()
)
SPACED = frozenset("br td th wbr".split())  # white space within a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element of the key's kind is closed by.
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
#: Elements beyond which an end tag or an implied end does not reach.
WALLS = frozenset("article aside nav header footer main section table ul ol div form body".split())

#: Attributes and the tag's end: quotes count after "=" only, one that never closes is a character like any other, and a
#: tag without an end goes on to the end of the page. So every tag start matches at once and no place is tried twice.
MORE = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+"
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?"
    r"|<(?P<silent>" + SILENT.replace(" ", "|") + r")(?=[\s/>])" + MORE + r"(?:>.*?(?:</(?P=silent)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>" + MORE + r")(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Words of class and id names that speak against and for content.
AGAINST = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|foot\w*|masthead|topbar|toolbar|side\w*|widget\w*|"
    r"related|recommend\w*|share\w*|sharing|social\w*|comment\w*|disqus|respond|replies|reply|cookie\w*|consent|gdpr|notice\w*|notification|alert|popup|"
    r"modal|overlay|newsletter|subscri\w*|signup|login|search\w*|pagination|pager|tags?|copyright|legal|disclaimer|skip|header|site-header)(?![a-z])"
)
FOR = re.compile(r"(?<![a-z])(?:article\w*|content|main|post|entry|story|body-?text|text)(?![a-z])")

#: Weights of the block classifier: log odds of being content.
WEIGHTS = {
    "none": -1.2, "article": 4.0, "main": 2.5, "for": 1.5, "against": -7.0, "boilerplate": -8.0, "link_share": -4.0, "words": 0.55,
    "sentence": 0.8, "heading": 0.4, "hidden": -9.0, "notice": -1.5,
}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "header"}
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "form": "form", "dialog": "dialog", "alert": "dialog", "alertdialog": "dialog", "menu": "menu", "menubar": "menu"}
NOTICE = re.compile(r"©|\(c\)\s*\d{4}|cookies|sign up|subscribe|log in", re.I)
BESIDE, SAME_PARENT, SAME_SECTION = 0.25, 0.6, 0.3  # capacities of smoothness edges


@dataclass
class Node:
    """An open element and what its ancestors say."""

    name: str
    number: int
    section: int
    parent: int = -1
    wall: int = 0  # how deep the nearest element lies that end tags do not reach beyond, itself included
    box: Node | None = None  # the nearest element that is a block, itself included
    heading: bool = False
    article: bool = False
    main: bool = False
    good: bool = False
    bad: bool = False
    boilerplate: bool = False
    hidden: bool = False
    link: bool = False


@dataclass
class Block:
    node: Node
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def log_odds(self) -> float:
        n, w, words = self.node, WEIGHTS, len(self.text.split())
        at = w["none"] + w["words"] * log1p(words)
        at += w["article"] * n.article + w["main"] * n.main + w["for"] * n.good + w["against"] * n.bad
        at += w["boilerplate"] * n.boilerplate + w["hidden"] * n.hidden + w["heading"] * self.heading
        at += w["sentence"] * self.text.endswith((".", "!", "?", "…", "。", '."', ".”"))
        at += w["link_share"] * min(1.0, self.linked / max(1, len(self.text)))
        if words < 30 and NOTICE.search(self.text):
            at += w["notice"]
        return at


def _child(parent: Node, name: str, more: str, number: int) -> Node:
    node = Node(
        name, number, parent.section, parent.number, parent.wall, parent.box, parent.heading or name in HEADINGS, parent.article,
        parent.main, parent.good, parent.bad, parent.boilerplate, parent.hidden, parent.link,
    )
    if name in BLOCKS:
        node.box = node
    role = name
    if more and not more.isspace():
        for key, value in NAMES.findall(more):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                node.good |= bool(FOR.search(value))
                node.bad |= bool(AGAINST.search(value)) and name not in ("body", "html", "article", "main")
            elif key == "role":
                role = ROLES.get(value, role)
                node.main |= value == "main"
                node.article |= value == "article"
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                node.hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                node.hidden = True
    node.link |= name == "a"
    node.article |= name == "article"
    node.main |= name == "main"
    # the head of an article holds its title; any other header is the site's
    node.boilerplate |= role in BOILERPLATE and not (role == "header" and parent.article)
    if name in WALLS or role in BOILERPLATE:
        node.section = number
    return node


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with what their ancestors say about them."""
    root = Node("", 0, 0)
    root.box = root
    stack, out, number = [root], [], 0
    now: Block | None = None
    depths: dict[str, list[int]] = {}  # where elements of a name are open

    def deepest(names: Iterable[str]) -> int:
        """Where the innermost open element of these names is; 0 if there is none."""
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def leave(depth: int) -> None:
        for node in stack[depth:]:
            depths[node.name].pop()
        del stack[depth:]

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
            now = None

    def say(text: str) -> None:
        nonlocal now
        if now is None:
            if text.isspace():
                return
            now = Block(stack[-1].box, stack[-1].heading)
        now.parts.append(text)
        if stack[-1].link:
            now.linked += len(text.strip())

    at = 0
    for tag in TAG.finditer(page):
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        elif name in SPACED and now is not None:
            now.parts.append(" ")
        if tag["end"]:
            depth = deepest([name])
            if depth and (name in WALLS or depth > stack[-1].wall):
                leave(depth)
            continue
        if name in BLOCKS:
            depth = deepest(k for k, closers in CLOSED_BY.items() if name in closers)
            if depth > stack[-1].wall:
                leave(depth)
        if name not in VOID and not tag["more"].endswith("/"):
            number += 1
            node = _child(stack[-1], name, tag["more"], number)
            if name in WALLS:
                node.wall = len(stack)
            depths.setdefault(name, []).append(len(stack))
            stack.append(node)
    if at < len(page):
        say(page[at:])
    close()
    return out


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbouring blocks, between those that follow each other among one parent's elements of one kind (the
    same name, with class names that speak alike), and between those that follow each other in one section."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for i, b in enumerate(found):
        n = b.node
        kin, section = (n.parent, n.name, n.good, n.bad, n.hidden, n.boilerplate), (n.section,)
        for j, w in ((i - 1, BESIDE), (last.get(kin, -1), SAME_PARENT), (last.get(section, -1), SAME_SECTION)):
            if j >= 0:
                edges[j, i] = edges.get((j, i), 0) + w
        last[kin] = last[section] = i
    return edges


def minimum_cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the cut: costs[i] > 0 is paid for label False, -costs[i] for True, an edge where labels differ.

    A node whose own cost outweighs all its edges has its label in every minimum cut; it is settled and passes its edges
    on to its neighbours' costs. What is left goes through the maximum flow (augmenting paths from the positive costs to the
    negative ones). Where cuts tie, the one with fewest nodes on the source's side is taken.
    """
    costs, label = list(costs), [None] * len(costs)
    near: list[dict[int, float]] = [{} for _ in costs]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(costs[i]) > sum(near[i].values()):
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                costs[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        for i, x in zip(left, _source_side(left, costs, near)):
            label[i] = x
    return label


def _source_side(nodes: list[int], costs: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Each positive node sends what it has along shortest paths to the nearest nodes that still take something, so that a
    search stays near its node. Where none can be reached, nothing leaves what has been reached: it is on the source's side
    and no later search goes there.
    """
    tiny = 1e-12
    room = {i: dict(near[i]) for i in nodes}
    takes = {i: -costs[i] for i in nodes if costs[i] < 0}
    closed: set[int] = set()
    for start in nodes:
        has = costs[start]
        while has > tiny and start not in closed:
            came, queue, end = {start: start}, deque([start]), None
            while queue and end is None:
                i = queue.popleft()
                for j, r in room[i].items():
                    if r > tiny and j not in came and j not in closed:
                        came[j] = i
                        queue.append(j)
                        if takes.get(j, 0.0) > tiny:
                            end = j
                            break
            if end is None:
                closed.update(came)
                break
            path, j = [], end
            while j != start:
                path.append((came[j], j))
                j = came[j]
            flow = min(has, takes[end], *(room[i][j] for i, j in path))
            for i, j in path:
                room[i][j] -= flow
                room[j][i] += flow
            has -= flow
            takes[end] -= flow
    return [i in closed for i in nodes]


def main_text(page: str | None) -> str:
    """Blocks labelled content, in page order, with an empty line between them."""
    found = blocks(page or "")
    labels = minimum_cut([b.log_odds() for b in found], smoothness(found))
    return "\n\n".join(b.text for b, keep in zip(found, labels) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row's page; the empty text where there is none or no page.

    Every row has its own result, repeated rows and rows without an id too; other columns are left out whatever their names.
    Pages of any length are read whole, in time in proportion to their length, broken markup included.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
