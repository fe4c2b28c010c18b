"""HTML extraction: the main text of a page by a minimum cut between content and boilerplate.

A page is split into blocks of text at block-level tags. Two terminals stand for content and boilerplate, and each block
is tied to one of them by a cost:

* a classifier of the text alone (length, links, punctuation, words), logistic and trained in numpy on blocks of a bounded
  sample of pages whose mark-up names their part; its log-odds are bounded by MOST_EVIDENCE;
* what the mark-up around the block says: elements, roles and class or id words of navigation, notices, adverts, forms,
  comments and so on, or of articles;
* what kind of block it is: a heading that the page's title repeats, a paragraph, a list entry.

Blocks are tied to each other by smoothness: to the next block, less the farther apart both are in the element tree, and
to the next block under the same parent, whatever stands between. The maximum flow from content to boilerplate is the
least total cost of ties that are cut, and the cut tells content from boilerplate. Blocks that may stand on either side
are kept. A page's graph has two edges a block, so memory follows the page; pages are independent, nothing is shuffled.

Text: character references are decoded, white space (line breaks too) inside a block becomes one space, blocks stand in
page order, one a line. Nothing is cut or capped.

Defined cases: null and empty pages have an empty text; a page of boilerplate only has an empty text; unclosed, misnested
and unknown tags are read as browsers do, as far as blocks are concerned; an unclosed script or comment hides the rest;
a null id is carried along; repeated rows are each answered; an empty table gives no rows; extra columns are ignored,
whatever their names. Without any marked block to learn from, the classifier abstains.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.tables import read

# Pages, and blocks of each, that the classifier learns from.
SAMPLE_PAGES = 2_000
SAMPLE_BLOCKS = 32

MOST_EVIDENCE = 3.0
CONTENT, BOILERPLATE = 3.5, -12.0
NEXT_BLOCK, SAME_PARENT = 1.6, 1.2
KIND = {"p": 0.6, "h1": 0.8, "h2": 0.3, "h3": 0.3, "blockquote": 0.3, "pre": 0.6, "li": -0.4, "td": -0.2, "th": -0.2, "label": -1.5}
TITLE = 2.0
_UNIT = 1000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template textarea title iframe svg math object select button datalist audio video canvas head".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select button datalist audio video canvas".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements that an implied end tag never reaches beyond.
_WALLS = frozenset("ul ol dl table tbody thead tfoot div article section main aside nav body blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button|datalist|audio|video|canvas)(?=[\s/>])"
    r"(?:[^>\"'=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+>(?P<body>.*?)(?:</(?P=raw)\s*+[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"'=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Words of classes, ids and roles.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation "
    "menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars rail widget widgets related recommended recommendations recommend suggestions share sharing "
    "social follow cookie cookies consent gdpr notice notices notification alert alerts popup popups modal overlay dialog newsletter subscribe subscription signup signin "
    "login register search form comment comments commentlist reply replies respond discussion disqus feedback footer foot copyright legal disclaimer masthead topbar toolbar "
    "logo branding skip toc complementary contentinfo taboola outbrain".split()
)
HEAD = frozenset("header head".split())
MAIN = frozenset("article content post entry story main body text prose".split())
_AROUND = frozenset("with has no without wrapper wrap layout container page site".split())


class Block(NamedTuple):
    """A stretch of text; distance counts tree steps from the block before, parent numbers the element around its own."""

    text: str
    linked: int
    kind: str
    mark: int
    titled: bool
    distance: int
    parent: int


class _Open:
    __slots__ = ("name", "number", "mark", "hidden")

    def __init__(self, name, number, mark, hidden):
        self.name, self.number, self.mark, self.hidden = name, number, mark, hidden


def _mark(name: str, rest: str, around: int) -> tuple[int, bool]:
    """(mark, hidden) of an element: 1 content, -1 boilerplate, -2 boilerplate that only a main element ends, 0 unknown."""
    tokens, hidden, role = set(), False, ""
    if rest and rest.strip():
        for match in _ATTRIBUTE.finditer(rest):
            key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDE.search(value)):
                hidden = True
            elif key == "role":
                role = value.lower()
            elif key in ("class", "id"):
                tokens.update(w.lower() for w in _WORD.findall(value))
    if name in ("html", "body"):
        return 0, False
    if role == "main" or name == "main":
        return (around if around == -1 else 1), hidden
    if around < 0:
        return around, hidden
    if name in ("nav", "aside", "footer") or role in ("navigation", "contentinfo", "complementary", "search", "banner", "dialog", "alertdialog", "menu"):
        return -1, hidden
    if tokens & AWAY and not tokens & _AROUND:
        return -1, hidden
    if name in ("form", "fieldset", "menu"):
        return -2, hidden
    # A heading part inside an article belongs to it.
    if (name == "header" or tokens & HEAD) and around < 1 and not tokens & _AROUND:
        return -1, hidden
    if name == "article" or role == "article" or tokens & MAIN:
        return 1, hidden
    return around, hidden


def page_blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page, in order, without hidden ones."""
    out: list[Block] = []
    if not page:
        return out
    stack = [_Open("", 0, 0, False)]
    count: dict[str, int] = {}
    parts: list[str] = []
    title, number, links, linked, lowest, depth_before = "", 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, lowest, depth_before
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            top = stack[-1]
            if text and not top.hidden:
                depth = len(stack)
                own = top.name.startswith("h") or top.name in ("p", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption", "label", "div", "section")
                parent = stack[-2].number if own and len(stack) > 1 else top.number
                same = len(text) > 2 and (text in title or (len(title) > 2 and title in text and len(text) < 2 * len(title)))
                out.append(Block(text, min(linked, len(text)), top.name, top.mark, same, max(0, depth_before + depth - 2 * min(lowest, depth)), parent))
                lowest = depth_before = depth
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal lowest
        for gone in stack[at:]:
            count[gone.name] -= 1
        del stack[at:]
        lowest = min(lowest, len(stack))

    def words(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if links:
            linked += len(raw.strip())

    at = 0
    for match in _TOKEN.finditer(page):
        if match.start() > at:
            words(page[at : match.start()])
        at = match.end()
        raw, name = match["raw"], match["name"]
        if raw:
            if raw.lower() == "title" and not title:
                title = " ".join(html.unescape(match["body"]).split())
            continue
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = 0 if match["close"] else 1
            continue
        flush()
        links = 0
        if match["close"]:
            if count.get(name):
                at_level = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name)
                pop_to(at_level)
            continue
        if name in _VOID:
            continue
        if count.get("p"):
            level = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name in _WALLS), 0)
            if level and stack[level].name == "p":
                pop_to(level)
        if (ends := _CLOSES.get(name)) and any(count.get(e) for e in ends):
            level = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ends or stack[i].name in _WALLS), 0)
            if level and stack[level].name in ends:
                pop_to(level)
        top = stack[-1]
        mark, hidden = _mark(name, match["rest"], top.mark)
        number += 1
        stack.append(_Open(name, number, mark, hidden or top.hidden or name in _HIDDEN))
        count[name] = count.get(name, 0) + 1
        if name == "body":
            # What a page's head holds is hidden up to here, closed or not.
            stack[-1].hidden = False
    if at < len(page):
        words(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- classifier

_STOP = re.compile(r"[.!?…。！？]")
N_FEATURES = 7


def features(block: Block) -> list[float]:
    """What the text says, without its mark-up."""
    text, size = block.text, len(block.text)
    n = text.count(" ") + 1
    ends = len(_STOP.findall(text))
    return [1.0, math.log1p(size), block.linked / size, math.log1p(n), float(text[-1] in ".!?…\"”»"), ends / n, (text.count("©") + text.count("|") + text.count("»")) / n]


class Evidence(NamedTuple):
    """Weights of a logistic classifier over standardised features."""

    weights: tuple[float, ...]

    def log_odds(self, block: Block) -> float:
        if not self.weights:
            return 0.0
        total = sum(w * x for w, x in zip(self.weights, features(block)))
        return max(-MOST_EVIDENCE, min(MOST_EVIDENCE, total))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> tuple[float, ...]:
    """Weights by Newton steps, both classes weighing the same; in units of the raw features. Empty without both classes."""
    if not len(y) or y.min() == y.max():
        return ()
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[spread == 0] = 0.0, 1.0
    z = (x - mean) / spread
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (y - p)) / len(y) - ridge * w
        curve = (z * (share * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    raw = w / spread
    raw[0] = w[0] - float((w[1:] * mean[1:] / spread[1:]).sum())
    return tuple(float(v) for v in raw)


def _examples(batches):
    for batch in batches:
        rows = []
        for page in batch.column(0).to_pylist():
            marked = [b for b in page_blocks(page) if b.mark]
            # Evenly over the page: a long page teaches no more than a short one.
            every = max(1, -(-len(marked) // SAMPLE_BLOCKS))
            rows += [[float(b.mark > 0), *features(b)] for b in marked[::every]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])


def fit_evidence(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> Evidence:
    """The text classifier from about ``sample`` pages, the same in every run; at most SAMPLE_BLOCKS rows a page reach the driver."""
    texts = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    n = texts.count()
    if not n:
        return Evidence(())
    span = 1 << 40
    chosen = texts.where(F.pmod(F.xxhash64(F.lit("pages"), "html"), F.lit(span)) < int(span * min(1.0, sample / n)))
    rows = chosen.mapInArrow(_examples, "x array<double>").toArrow().column(0)
    table = np.array(rows.to_pylist(), float).reshape(-1, N_FEATURES + 1)
    return Evidence(fit_logistic(table[:, 1:], table[:, 0]))


# ---------------------------------------------------------------- minimum cut


def min_cut(ties: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut: as many as can.

    ``ties`` are the capacities from the source (positive) or to the sink (negative) of each node, ``edges`` are
    (node, node, capacity) both ways. Flows are augmented along shortest paths, level by level.
    """
    n = len(ties)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(u, v, forth, back):
        at[u].append(len(to))
        at[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((forth, back))

    for node, tie in enumerate(ties):
        if tie > 0:
            connect(source, node, tie, 0)
        elif tie < 0:
            connect(node, sink, -tie, 0)
    for u, v, capacity in edges:
        if capacity > 0:
            connect(u, v, capacity, capacity)
    while True:
        # Steps to the sink; nodes without any can't lose more.
        level = [-1] * (n + 2)
        level[sink] = 0
        queue = deque([sink])
        while queue:
            v = queue.popleft()
            for e in at[v]:
                u = to[e]
                if level[u] < 0 and room[e ^ 1]:
                    level[u] = level[v] + 1
                    queue.append(u)
        if level[source] < 0:
            return [level[node] < 0 for node in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[back] ^ 1]
                del path[back:]
            edge = None
            while following[u] < len(at[u]):
                e = at[u][following[u]]
                if room[e] and level[to[e]] == level[u] - 1:
                    edge = e
                    break
                following[u] += 1
            if edge is not None:
                path.append(edge)
                u = to[edge]
            elif u == source:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                following[u] += 1


def block_graph(blocks: list[Block], evidence: Evidence) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal ties and smoothness edges of a page."""
    ties, edges, last_under = [], [], {}
    for i, b in enumerate(blocks):
        tie = evidence.log_odds(b) + KIND.get(b.kind, 0.0) + (TITLE if b.titled else 0.0)
        if b.mark:
            tie += CONTENT if b.mark > 0 else BOILERPLATE
        ties.append(round(_UNIT * tie))
        if i:
            edges.append((i - 1, i, round(_UNIT * NEXT_BLOCK / (1 + b.distance))))
        if (before := last_under.get(b.parent)) is not None:
            edges.append((before, i, round(_UNIT * SAME_PARENT)))
        last_under[b.parent] = i
    return ties, edges


def main_text(page: str | None, evidence: Evidence) -> str:
    """The content blocks of a page, one a line."""
    blocks = page_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, min_cut(*block_graph(blocks, evidence))) if keep)


def _texts(batches, evidence: Evidence) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(page.as_py(), evidence) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, evidence: Evidence | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page; the classifier is learned from a sample of the pages unless given."""
    known = fit_evidence(pages, html_col) if evidence is None else evidence
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lambda batches: _texts(batches, known), "page_id long, url string, text string")


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# Minimum cuts can't be written in SQL; tests compare with all cuts of small graphs and with known pages.
QUERIES = {"op12_html_extraction": (op12, None)}
