"""Main text of web pages by minimum-cut labelling of their blocks.

A page's text is taken apart into blocks, the stretches between block-level tags. A linear classifier gives each block a
cost of calling it content and a cost of calling it boilerplate; these are the capacities to the two terminals. Edges
between a block and the next one, and between it and the next under the same parent, carry what it costs to label
neighbours differently: the more, the nearer the two are in the document tree. The minimum cut (maximum flow along
shortest augmenting paths, Dinic) is the cheapest labelling, and the blocks on the content side are the page's text.

Pages are independent: the work is spread by Spark, nothing is shuffled, and a page's graph has at most two edges per
block. Defined results: a null or empty html gives an empty text; what a page says outside known tags is judged like any
block; broken and unclosed tags are read as browsers do in the main (a new paragraph ends an open one); repeated rows each
get their result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Fixed values of HTML: tags that make a block of their own, tags without an end, tags whose text is never shown.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("head noscript script style template textarea title iframe object svg canvas audio video select option datalist".split())
#: Tags that leave an open head as it is; any other ends it, and so does text.
HEAD_TAGS = frozenset("base basefont bgsound html head link meta noframes noscript script style template title".split())
#: Tags that open elements of the first kind end when a tag of the second kind opens.
ENDED_BY = {"p": BLOCK_TAGS - {"br", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Weights of the classifier: positive speaks for content.
TAG_WEIGHT = {"article": 3.0, "main": 2.5, "h1": 1.5, "h2": 0.5, "h3": 0.5, "h4": 0.3, "p": 1.0, "blockquote": 0.5, "pre": 0.5, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "button": -8.0, "dialog": -8.0, "menu": -8.0, "label": -3.0, "address": -1.0, "header": -4.0}
NAME_WEIGHT = ((re.compile(r"(?:^|[\s_-])(article|articlebody|body|content|entry|hentry|main|page|post|story|text)(?:$|[\s_-])"), 1.5),
               (re.compile(r"(?:^|[\s_-])(ad|ads|advert\w*|banner|breadcrumbs?|combx|comments?|commentlist|respond|reply|replies|discussion|disqus|consent|cookies?|gdpr|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|outbrain|pager|pagination|popup|promo\w*|related|recommend\w*|rss|share\w*|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|taboola|tags|toolbar|topbar|widget)(?:$|[\s_-])"), -8.0))
ROLE_WEIGHT = {"main": 2.5, "article": 3.0, "navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0, "dialog": -8.0, "alert": -8.0, "menu": -8.0}
LEGAL = re.compile(r"(?i)©|\(c\) \d{4}|all rights reserved|privacy policy|terms of (use|service)|cookies? (policy|settings)|we use cookies|subscribe|sign up|log ?in|advertis")
SENTENCE = re.compile(r"[.!?…][\"'”’)]*(\s|$)")
#: What it costs to cut between neighbours under one parent; it halves with every two steps more between them.
SMOOTH = 2.0
STEPS_TO_HALF = 2.0


@dataclass(eq=False)
class Place:
    """A block element of the tree: how deep it lies, and the one around it (the page itself has none)."""
    depth: int
    parent: Place | None


@dataclass
class Block:
    place: Place  # the nearest block element around it
    weight: float  # what the elements around it say
    text: str
    linked: int
    heading: bool


@dataclass
class _Open:
    tag: str
    place: Place
    weight: float
    hidden: bool
    link: bool
    ended: bool = False  # by its end tag, while blocks inside are still open


class _Blocks(HTMLParser):
    """Blocks of a page, each with its place in the tree.

    What is open is counted by tag, so that a tag takes time for what it closes and not for all that is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = [_Open("", Place(0, None), 0.0, False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)  # where in `open` the elements of a tag are that have not ended
        self.blocks_at: list[int] = []  # likewise those of block tags
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.n_open = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.blocks.append(Block(top.place, top.weight, text, self.linked, any(self.at[h] for h in ("h1", "h2", "h3", "h4"))))
        self.parts, self.linked = [], 0

    def end(self, at: int) -> None:
        """The element there ends, and all inside it."""
        for o in reversed(self.open[at:]):
            if not o.ended:
                self.forget(o)
        del self.open[at:]
        while self.open[-1].ended:
            self.open.pop()

    def forget(self, o: _Open) -> None:
        self.at[o.tag].pop()
        self.n_open -= 1
        if o.tag in BLOCK_TAGS:
            self.blocks_at.pop()

    def end_head(self, tag: str = "") -> None:
        """The head ends where something starts that has no place in it; body ends it even in an open noscript."""
        at = len(self.open) - 1
        while self.open[at].ended or tag == "body" and self.open[at].tag in ("noscript", "noframes"):
            at -= 1
        if self.open[at].tag == "head" and tag not in HEAD_TAGS:
            self.flush()
            self.end(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.end_head(tag)
        if tag == "head" and self.n_open > len(self.at["html"]):
            return  # a page has one head, before its body
        if tag in BLOCK_TAGS:
            self.flush()
            while tag in ENDED_BY.get(self.open[-1].tag, ()):
                self.end(len(self.open) - 1)
            if self.open[-1].tag not in BLOCK_TAGS and tag != "br" and self.blocks_at:  # an unclosed inline element ends with its paragraph
                inner = self.blocks_at[-1]
                if tag in ENDED_BY.get(self.open[inner].tag, ()):
                    self.end(inner)
        top = self.open[-1]
        if tag in VOID_TAGS:
            return
        named = {k: (v or "").lower() for k, v in attrs}
        weight = top.weight
        own = TAG_WEIGHT.get(tag, 0.0) + ROLE_WEIGHT.get(named.get("role", ""), 0.0)
        if (names := " ".join((named.get("class", ""), named.get("id", ""))).strip()) and tag not in ("html", "body"):
            own += sum(w for pattern, w in NAME_WEIGHT if pattern.search(names))
        if tag == "header" and (self.at["article"] or self.at["main"]):
            own += 4.0  # an article's own heading
        hidden = top.hidden or tag in HIDDEN_TAGS or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        self.at[tag].append(len(self.open))
        self.n_open += 1
        if tag in BLOCK_TAGS:
            self.blocks_at.append(len(self.open))
        self.open.append(_Open(tag, Place(top.place.depth + 1, top.place) if tag in BLOCK_TAGS else top.place, weight + own, hidden, top.link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.end_head(tag)
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "svg" or self.at["svg"]:
            return  # drawings are of XML, where <svg/> and <path/> are whole
        elif tag not in VOID_TAGS:
            self.handle_starttag(tag, attrs)  # browsers read <b/> as <b>

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.at[tag]:
            return
        at = self.at[tag][-1]
        if self.blocks_at and self.blocks_at[-1] >= at:
            if tag not in BLOCK_TAGS:
                self.forget(self.open[at])
                self.open[at].ended = True  # an inline end tag does not close the blocks inside
                return
            self.flush()
        self.end(at)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        top = self.open[-1]
        if not top.hidden:
            self.parts.append(data)
            if top.link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def score(block: Block) -> float:
    """The classifier's evidence: positive for content, negative for boilerplate."""
    words = block.text.count(" ") + 1
    out = block.weight
    out += min(words, 60) / 20 - 0.75
    out += 0.5 if SENTENCE.search(block.text) else -0.5
    out -= 4.0 * min(1.0, block.linked / max(1, len(block.text)))
    if words < 40 and LEGAL.search(block.text):
        out -= 2.5
    return out + (0.75 if block.heading else 0.0)


def _near(a: Block, b: Block) -> float:
    steps, x, y = 0, a.place, b.place
    while x is not y:
        if x.depth >= y.depth:
            x, up = x.parent, x.depth == y.depth
            y = y.parent if up else y
            steps += 2 if up else 1
        else:
            y, steps = y.parent, steps + 1
    return SMOOTH * 2 ** (-min(max(0, steps - 2) / STEPS_TO_HALF, 1000.0))


class MinCut:
    """Dinic's maximum flow on the blocks' graph; without recursion, as long pages make long paths."""

    def __init__(self, n: int):
        self.first: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.first[a].append(len(self.to))
        self.first[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.first)
        level[source], queue = 0, [source]
        for a in queue:
            for e in self.first[a]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay with the source when the cheapest set of edges is cut."""
        while (level := self._levels(source))[sink] >= 0:
            at, path, node = [0] * len(self.first), [], source
            while True:
                if node == sink:
                    flow = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= flow
                        self.left[e ^ 1] += flow
                    back = next(i for i, e in enumerate(path) if self.left[e] <= 1e-9)
                    node = self.to[path[back] ^ 1]
                    del path[back:]
                elif at[node] < len(self.first[node]):
                    e = self.first[node][at[node]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[node] + 1:
                        path.append(e)
                        node = self.to[e]
                    else:
                        at[node] += 1
                elif path:
                    level[node] = -1
                    node = self.to[path.pop() ^ 1]
                else:
                    break
        return [x >= 0 for x in level]


def label(blocks: list[Block]) -> list[bool]:
    """True for content."""
    n = len(blocks)
    graph, last = MinCut(n + 2), {}
    for i, b in enumerate(blocks):
        s = score(b)
        graph.edge(n, i, max(s, 0.0))
        graph.edge(i, n + 1, max(-s, 0.0))
        joined = {i - 1} if i else set()
        around = b.place.parent or b.place
        if around in last:
            joined.add(last[around])
        for j in joined:
            w = _near(blocks[j], b)
            graph.edge(j, i, w, w)
        last[around] = i
    return graph.source_side(n, n + 1)[:n]


def main_text(html: str | None) -> str:
    found = blocks_of(html or "")
    return " ".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    arrow_rows(pages.sparkSession, 1000)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = None
