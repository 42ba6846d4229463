"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier gives each block a cost of being content and of being boilerplate; these
are the capacities to the two terminals. Neighbouring blocks, and blocks that follow each other within the same DOM parent
or section, are joined by smoothness edges. The minimum cut is the cheapest labelling, and the blocks on the content side
are the text.

The classifier is a logistic regression over features of a block: its length, link share and last character, the tags
around it, and the blocks beside it. It is trained on a bounded sample of pages, whose own names label part of their
blocks: what stands inside article or main is content, what stands inside nav, footer, aside, form and the like is
boilerplate. What names say is evidence of its own, as strong as it agreed with the cut without names over the sample.

Results for odd rows: null or empty html, and html without content, give an empty text; unclosed and stray tags are
closed as a browser would, and an element whose text is not shown (an unclosed button, select, object) ends at the latest
with the block around it; repeated rows are treated alike; no text is dropped for its length.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import flat_map_rows, map_rows

#: Pages that the classifier is trained on, at most (those with the smallest hash of page_id).
SAMPLE_PAGES = 2_000
#: Different rows of features that the classifier is fitted to, at most, the most frequent first.
FIT_ROWS = 20_000
FIT_STEPS, FIT_RATE, FIT_RIDGE = 400, 0.1, 1e-4
#: Open elements that make up the path of a block.
PATH_TAGS = 3
#: Least and largest smoothness of an edge, in units of log odds.
LEAST_EDGE, LARGEST_EDGE = 0.25, 2.0

#: Elements by their part in a page.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary
table tbody td tfoot th thead tr ul""".split())
UNSEEN = frozenset("script style noscript template title svg math iframe object canvas audio video textarea button select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Markup inside svg and math that a browser takes for the page again, unless it stands in one of the inner elements.
BREAKOUT = BLOCKS - set("article aside details dialog dir fieldset figcaption figure footer form header hgroup legend main option search section select "
                        "summary tfoot".split()) | set("b big br code em embed font i img s small span strike strong sub sup tt u var".split())
FOREIGN = frozenset("svg math".split())
FOREIGN_INNER = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
CONTENT_TAGS = frozenset("article main".split())
PLAIN_TAGS = frozenset("nav footer aside form menu dialog search".split())
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
PLAIN_NAMES = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright disclaimer discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation
newsletter notice notification pager pagination popup promo promotion recommended related reply replies respond search share
sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
LAYOUT_NAMES = frozenset("has no with without".split())
P_CLOSERS = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "select"}

#: Beginnings of comments, declarations and tags; what stands in a tag outside quoted values; a tag without them.
BEGIN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
BARE = re.compile(r"""[^"'<>]*""")
UNQUOTED = re.compile(r"[^<>]*>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A stretch of text, the parent of its DOM element, the nearest section, and what the markup around it says."""

    text: str
    tag: str
    path: str
    parent: int
    section: int
    markup: int
    linked: int = 0


@dataclass
class _Open:
    tag: str
    number: int
    section: int
    markup: int


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Tags, and comments and declarations with an empty name: (start, end, closing, lowered name, attributes).

    A quoted value, however long, ends at its closing quote. Where that is missing, or a bracket opens before the tag
    ends, the tag ends at the next bracket, or is none.
    """
    at, unpaired = 0, set()
    while found := BEGIN.search(page, at):
        start, inside = found.span()
        if found[2] is None:
            close = "-->" if found[0] == "<!--" else ">"
            end = page.find(close, inside)
            at = len(page) if end < 0 else end + len(close)
            yield start, at, False, "", ""
            continue
        end = inside
        while True:
            end = BARE.match(page, end).end()
            mark = page[end:end + 1]
            if mark not in ("'", '"') or mark in unpaired:
                break
            close = page.find(mark, end + 1)
            if close < 0:
                unpaired.add(mark)
                break
            end = close + 1
        if mark != ">":
            plain = UNQUOTED.match(page, inside)
            if plain is None:
                at = start + 1
                continue
            end = plain.end() - 1
        at = end + 1
        yield start, at, bool(found[1]), found[2].lower(), page[inside:end]


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order; ``markup`` is 1 inside content elements, -1 inside boilerplate elements, else 0."""
    if not page:
        return []
    stack, blocks, pieces, opened = [_Open("", 0, 0, 0)], [], [], Counter()
    links = linked = number = at = 0
    end = len(page)
    hidden: str | None = None  # an element whose text is not shown
    inner: list[str] = []  # what is open in it

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html_entities.unescape("".join(pieces))).strip()
        if text:
            top = stack[-1]
            path = ">".join(x.tag for x in stack[-PATH_TAGS:])
            blocks.append(Block(text, top.tag, path, stack[-2].number if len(stack) > 1 else 0, top.section, top.markup, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        while opened[tag]:
            gone = stack.pop().tag
            opened[gone] -= 1
            if gone == tag:
                break

    def skip(tag: str, start: int) -> int:
        """Where an element without markup inside ends."""
        over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, start)
        return over.end() if over else end

    def still_hidden(tag: str, closing: bool, attributes: str) -> bool:
        """Whether a tag inside the hidden element belongs to it; False for one of the page around it."""
        nonlocal hidden, at
        foreign = hidden in FOREIGN
        if closing:
            if tag in inner:
                while inner.pop() != tag:
                    pass
            elif tag == hidden:
                hidden = None
            elif hidden != "template" and tag in BLOCKS and opened[tag]:
                hidden = None
                return False
            return True
        if foreign and tag in BREAKOUT and not FOREIGN_INNER.intersection(inner):
            hidden = None
            return False
        if hidden == "select" and tag in ("input", "textarea"):
            hidden = None
            return False
        if tag == hidden and tag in ("button", "select"):  # the one before ends
            inner.clear()
        elif tag in RAW and not foreign:
            at = skip(tag, at)
        elif tag not in VOID and not attributes.endswith("/") and (tag in BLOCKS or tag == hidden or foreign and tag in FOREIGN_INNER):
            inner.append(tag)
        return True

    def words(text: str) -> None:
        nonlocal linked
        if text and hidden is None:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    for start, stop, closing, tag, attributes in tokens(page):
        if start < at:
            continue
        words(page[at:start])
        at = stop
        if not tag:
            continue
        if hidden is not None and still_hidden(tag, closing, attributes):
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
                close(tag)
            continue
        if tag in UNSEEN:
            flush() if tag in BLOCKS else None
            if not attributes.endswith("/"):
                if tag in RAW:  # no markup inside
                    at = skip(tag, at)
                else:
                    hidden = tag
                    inner.clear()
            pieces.append(" ")
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            links += 1
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if tag in P_CLOSERS and any(x.tag == "p" for x in stack[-3:]):
            close("p")
        if stack[-1].tag == tag and tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            close(tag)
        if tag in VOID:
            continue
        number += 1
        markup = _markup(tag, attributes, stack[-1].markup)
        section = number if tag in ("section", "div", "article", "main", "nav", "aside", "footer", "header", "form") else stack[-1].section
        opened[tag] += 1
        stack.append(_Open(tag, number, section, markup))
    words(page[at:])
    flush()
    return blocks


def _markup(tag: str, attributes: str, around: int) -> int:
    """Boilerplate inside content stays boilerplate; content inside boilerplate does not become content."""
    if around < 0:
        return -1
    if tag in PLAIN_TAGS or (tag == "header" and around == 0):
        return -1
    if tag in CONTENT_TAGS:
        return 1
    if not attributes or tag in ("body", "html"):
        return around
    names = {w for value in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", "".join(value).lower())}
    plain = set() if names & LAYOUT_NAMES else names & PLAIN_NAMES
    if plain - {"header"} or plain and not around and not names & CONTENT_NAMES:
        return -1
    return 1 if names & CONTENT_NAMES else around


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Features of each block besides names: length, link share, last character, tags around it, and the blocks beside it."""
    sizes = [min(6, (b.text.count(" ") + 1).bit_length()) for b in blocks]
    shares = [4 * b.linked // max(1, len(b.text)) for b in blocks]
    out = []
    for i, block in enumerate(blocks):
        ends = block.text[-1] in ".!?…»”\"'"
        beside = [k for k in (i - 1, i + 1) if 0 <= k < len(blocks)]
        out.append([f"words {sizes[i]}", f"linked {shares[i]}", f"ends {ends} {sizes[i] > 3}",
                    f"tag {block.tag if block.tag in ('p', 'li', 'td', 'div', 'h1', 'h2', 'h3', 'pre', 'blockquote') else '-'}",
                    f"path {block.path}", f"words beside {max((sizes[k] for k in beside), default=0)}",
                    f"linked beside {max((shares[k] for k in beside), default=0)}"])
    return out


@dataclass
class Model:
    """Log odds of content by feature and by what names say, and smoothness by kind of edge; untrained, a block leans to content."""

    prior: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    names: dict[int, float] = field(default_factory=lambda: {1: 1.0, -1: -1.0})
    edges: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("neighbour", "parent", "section"), LEAST_EDGE))


def fitted(rows: list[tuple[list[str], bool, int]]) -> dict[str, float]:
    """Weights of a logistic regression over rows (features, is content, how often); weights of rare features stay small."""
    names = {f: i for i, f in enumerate(dict.fromkeys(f for own, _, _ in rows for f in own))}
    places = np.array([[names[f] for f in own] for own, _, _ in rows])
    content, often = np.array([y for _, y, _ in rows], float), np.array([n for _, _, n in rows], float)
    often /= often.sum()
    weights = np.zeros(len(names))
    speed, scale = np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, FIT_STEPS + 1):  # Adam on the whole sample
        likely = 1 / (1 + np.exp(-weights[places].sum(axis=1)))
        slope = np.bincount(places.ravel(), np.repeat(often * (likely - content), places.shape[1]), len(names)) + FIT_RIDGE * weights
        speed, scale = 0.9 * speed + 0.1 * slope, 0.999 * scale + 0.001 * slope ** 2
        weights -= FIT_RATE * speed / (1 - 0.9 ** step) / (np.sqrt(scale / (1 - 0.999 ** step)) + 1e-8)
    return {f: float(weights[i]) for f, i in names.items()}


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """Log odds from at most ``sample_pages`` pages, in two passes.

    First the features are fitted to the blocks that names mark, and each kind of edge weighs as much as it joins blocks
    marked alike. Then the blocks are labelled by minimum cut without names, and what a name says weighs as much as it
    agrees with these labels.
    """
    ids = pages.select(F.xxhash64("page_id").alias("place")).where("page_id IS NOT NULL").distinct()
    last = ids.orderBy("place").limit(sample_pages).agg(F.max("place")).first()[0]
    if last is None:
        return Model()
    sample = pages.where(F.col("page_id").isNotNull() & (F.xxhash64("page_id") <= last)).select("html")

    def counted(count: Callable[[list[Block]], Counter]) -> list[tuple[list[str], int, int]]:
        def make() -> Callable[..., list[tuple]]:
            return lambda page: [(list(own), side, n) for (own, side), n in count(blocks_of(page)).items()]

        rows = flat_map_rows(sample, make, "features array<string>, side int, n long").groupBy("features", "side").agg(F.sum("n").alias("n"))
        return [(r["features"], r["side"], r["n"]) for r in rows.orderBy(F.desc("n"), "features", "side").limit(FIT_ROWS).collect()]

    def marked(blocks: list[Block]) -> Counter:
        seen = Counter((tuple(own), b.markup) for b, own in zip(blocks, features_of(blocks), strict=True) if b.markup)
        return seen + Counter(((kind,), int(blocks[i].markup == blocks[j].markup)) for i, j, kind in edges_of(blocks)
                              if blocks[i].markup and blocks[j].markup)

    rows = counted(marked)
    pairs = Counter({(own[0], side): n for own, side, n in rows if len(own) == 1})
    rows = [(own, side > 0, n) for own, side, n in rows if len(own) > 1]
    if {y for _, y, _ in rows} != {True, False}:
        return Model()
    edges = {kind: min(LARGEST_EDGE, max(LEAST_EDGE, math.log((pairs[kind, 1] + 1) / (pairs[kind, 0] + 1)) / 2))
             for kind in ("neighbour", "parent", "section")}
    unnamed = Model(0.0, fitted(rows), {}, edges)

    def agreed(blocks: list[Block]) -> Counter:
        return Counter(((str(b.markup),), int(keep)) for b, keep in zip(blocks, content_blocks(blocks, unnamed), strict=True) if b.markup)

    by_name = Counter({(int(own[0]), side): n for own, side, n in counted(agreed)})
    return Model(0.0, unnamed.weights, {side: math.log((by_name[side, 1] + 1) / (by_name[side, 0] + 1)) for side in (1, -1)}, edges)


def content_blocks(blocks: list[Block], model: Model) -> list[bool]:
    """The labelling of least cost: True for content."""
    odds = [model.prior + sum(model.weights.get(f, 0.0) for f in own) + model.names.get(b.markup, 0.0)
            for b, own in zip(blocks, features_of(blocks), strict=True)]
    edges: dict[tuple[int, int], float] = {}
    for i, j, kind in edges_of(blocks):
        edges[i, j] = edges.get((i, j), 0.0) + model.edges.get(kind, 0.0)
    return minimum_cut(odds, edges)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, str]]:
    """Pairs of blocks that are joined: neighbours in the page, and a block with the last one of its parent and of its section."""
    edges: list[tuple[int, int, str]] = [(i - 1, i, "neighbour") for i in range(1, len(blocks))]
    for kind, key in (("parent", lambda b: b.parent), ("section", lambda b: b.section)):
        last: dict[int, int] = {}
        for i, block in enumerate(blocks):
            if key(block) in last:
                edges.append((last[key(block)], i, kind))
            last[key(block)] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Minimises the sum of odds of nodes on the wrong side and of the edges that are cut; True where odds > 0 is kept.

    A node whose own odds outweigh all its edges keeps its side in some best labelling; such nodes are settled first,
    their edges become odds of their neighbours, and the rest goes to a maximum flow.
    """
    n = len(odds)
    odds, near = list(odds), [{} for _ in range(n)]
    for (i, j), weight in edges.items():
        near[i][j] = near[i].get(j, 0.0) + weight
        near[j][i] = near[j].get(i, 0.0) + weight
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or abs(odds[i]) < sum(near[i].values()) or odds[i] == 0 and near[i]:
            continue
        side[i] = odds[i] > 0
        for j, weight in near[i].items():
            odds[j] += weight if side[i] else -weight
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:  # without anything left to weigh, a node falls to boilerplate
        for i in _source_side(rest, odds, near):
            side[i] = True
    return [bool(x) for x in side]


def _source_side(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> list[int]:
    """Nodes that the source still reaches after a maximum flow (blocking flows in the graph of levels)."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if odds[i] > 0:
            left[source][i], left[i][source] = odds[i], 0.0
        elif odds[i] < 0:
            left[i][sink], left[sink][i] = -odds[i], 0.0
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for j, free in left[i].items():
                if free > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if sink not in level:
            return [i for i in level if i >= 0]
        turns, at, path = {i: list(left[i]) for i in level}, dict.fromkeys(level, 0), [source]
        while path:
            if path[-1] == sink:
                steps = list(zip(path, path[1:], strict=False))
                amount = min(left[i][j] for i, j in steps)
                for i, j in steps:
                    left[i][j] -= amount
                    left[j][i] = left[j].get(i, 0.0) + amount
                path = path[:next(k for k, (i, j) in enumerate(steps) if left[i][j] <= 1e-9) + 1]
                continue
            i = path[-1]
            while at[i] < len(turns[i]):
                j = turns[i][at[i]]
                if left[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                at[i] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def main_text(page: str | None, model: Model) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, content_blocks(blocks, model), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages))

    def make() -> Callable[..., tuple]:
        model = sent.value

        def row(page_id: int | None, url: str | None, page: str | None) -> tuple:
            text = main_text(page, model)
            return page_id, url, text, len(text)

        return row

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
