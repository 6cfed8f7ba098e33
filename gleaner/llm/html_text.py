"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A trained classifier gives each block the
cost of calling it content or boilerplate, the capacities of its terminal edges;
neighbours in page order and in the DOM are tied by smoothness edges. The minimum
cut is the cheapest labelling. Blocks whose own cost outweighs all their ties
are settled first, which leaves small graphs.

The classifier is a logistic regression on lengths, links, punctuation, depth,
position and shares of text, without names of elements, classes or ids. Its
training labels are the blocks of pages that name their parts (``article``,
``nav``, ``footer`` ...), in a sample of about ``SAMPLE_PAGES`` pages by hash.
Ties are the log-odds that neighbours at a distance in the DOM have one label,
counted in the same sample. What a page's markup says of a block is added to its
cost as a bounded number, so a page without telling names is cut by text alone. Words
of a class or id are no verdict: the more of the text they would take away on a page
that names no article outside them, the less they count, down to nothing.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

#: About how many pages, and at most how many of their blocks, the classifier is trained on.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 20_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Controls and embedded things: their text is boilerplate, but the page goes on inside them if an end tag is missing.
EMBEDDED = frozenset("svg math object canvas select button audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening tag of the key closes, if they are the nearest of their kind.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset("ul ol dl table article section main nav aside header footer form body div".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split()) | EMBEDDED
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner
    menu menubar nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar topbar masthead
    header footer sidebar aside widget widgets related recommended recommendations
    cookie cookies consent gdpr notice notices notification notifications popup modal overlay alert disclaimer
    comment comments commentlist reply replies respond disqus discussion
    share sharing social subscribe subscription newsletter signup login search form skip copyright legal""".split()
)
CONTENT_WORDS = frozenset("article articlebody content post entry story main body text".split())
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)""", re.I)
TOKEN = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: What the markup adds to a block's log-odds of being content: marked as boilerplate, inside a marked article,
#: outside it, named like content. The classifier's own part is at most ``TEXT_LIMIT`` either way.
BOILER, CONTENT, OUTSIDE, NAMED, TEXT_LIMIT = -8.0, 3.5, -2.0, 1.0, 2.5
#: A mark by words of a class or id alone counts in full while the element holds at most the first share of the text that could
#: be the article, and not at all from the second on: where nearly all would go, the words name something else.
WORD_SHARES = (0.25, 0.75)
#: A tie is at most so strong, by distance in the DOM; distances from ``FAR`` on are one.
TIE_LIMITS = (2.0, 2.0, 2.0, 1.0, 0.5, 0.3, 0.2)
FAR = len(TIE_LIMITS) - 1
FEATURES = [
    "log_length", "link_share", "punctuation", "sentence_end", "depth", "position", "position_squared", "parent_text_share", "parent_link_share", "log_before", "log_after", "copyright",
]


@dataclass
class Frame:
    tag: str
    number: int
    #: The nearest element above that is a block, and the number of blocks above.
    up: Frame | None = None
    depth: int = 0
    named: bool = False
    boiler: bool = False
    #: The boilerplate mark comes from a name only, which an article inside outweighs.
    soft: bool = False
    content: bool = False
    link: bool = False
    skip: bool = False
    #: The nearest element above that has such a mark of its own, and the blocks in this one: from the first to before the last.
    marker: Frame | None = None
    first: int = 0
    last: int = 0


@dataclass
class Block:
    holder: Frame
    frame: Frame
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _frame(tag: str, source: str, above: Frame, number: int) -> Frame:
    up = above.up if above.tag in INLINE else above
    f = Frame(tag, number, up, up.depth + (tag not in INLINE), above.named, above.boiler, above.soft, above.content, above.link or tag == "a", above.skip, above.marker)
    if tag == "head":
        f.skip = True
    if tag in CONTENT_TAGS:
        f.content = True
        if f.soft:
            f.boiler, f.soft, f.marker = False, False, None
    if tag in BOILER_TAGS or (tag == "header" and not above.content):
        f.boiler, f.soft = True, False
    if "=" in source or "hidden" in source:
        for m in ATTRIBUTE.finditer(source, len(tag) + 1):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                tokens = set(TOKEN.findall(CAMEL.sub(" ", value).lower()))
                if tokens & BOILER_WORDS and tag not in ("body", "html", "article", "main"):
                    # a header that names itself one inside an article holds the article's title
                    if not (above.content and tokens & BOILER_WORDS == {"header"}):
                        f.boiler, f.soft, f.marker = True, f.soft or not f.boiler, f
                elif tokens & CONTENT_WORDS and tag not in ("body", "html"):
                    f.named = True
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    f.boiler, f.soft = True, False
                elif value.lower() in ("main", "article"):
                    f.content = True
            elif name == "itemprop":
                if value.lower() == "articlebody":
                    f.content = True
                elif value.lower() == "comment":
                    f.boiler, f.soft = True, False
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    f.boiler, f.soft = True, False
            elif name == "hidden" or value.lower() == "true":
                f.boiler, f.soft = True, False
    return f


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, each with its innermost block element and the marks of its ancestors."""
    stack = [Frame("", 0)]
    stack[0].up = stack[0]
    blocks: list[Block] = []
    current: Block | None = None
    numbers, at = 0, 0

    def say(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.skip or not text:
            return
        if current is None:
            if text.isspace():
                return
            holder = next(f for f in reversed(stack) if f.tag not in INLINE)
            current = Block(holder, top)
            blocks.append(current)
        current.text.append(text)
        if top.link:
            current.linked += len(text)

    def pop_to(place: int) -> None:
        nonlocal current
        if any(f.tag not in INLINE for f in stack[place:]):
            current = None
        for f in stack[place:]:
            f.last = len(blocks)
        del stack[place:]

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        source = m[0]
        name = NAME.match(source)
        if name is None:
            if source.startswith("<![CDATA["):
                say(source[9:].removesuffix("]]>"))
            continue
        tag = name[1].lower()
        if source[1] == "/":
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == tag:
                    pop_to(place)
                    break
                if tag in INLINE and stack[place].tag in SCOPE:
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            if tag not in ("iframe", "script", "style", "template"):
                current = None
            continue
        if tag in EMBEDDED and source.endswith("/>"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                say("\n")
                if tag == "hr":
                    current = None
            continue
        if tag not in INLINE:
            current = None
            for place in range(len(stack) - 1, 0, -1):
                t = stack[place].tag
                if t == "p":
                    pop_to(place)
                    break
                if t in SCOPE:
                    break
            if tag in CLOSES:
                for place in range(len(stack) - 1, 0, -1):
                    t = stack[place].tag
                    if t in CLOSES[tag]:
                        pop_to(place)
                        if t == tag or tag not in ("tr",):
                            break
                    elif t in SCOPE:
                        break
        numbers += 1
        stack.append(_frame(tag, source, stack[-1], numbers))
        stack[-1].first = len(blocks)
    pop_to(0)
    return blocks


def clean(block: Block) -> str:
    """The block's text: references decoded, white space single and trimmed."""
    t = "".join(block.text)
    return " ".join((html_lib.unescape(t) if "&" in t else t).split())


PUNCTUATION, SENTENCE_END = re.compile(r"[.,;:!?。、！？]"), re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")


def features(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """(blocks, FEATURES): what the classifier sees, nothing of which depends on names."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    length = np.fromiter((len(t) for t in texts), float, n)
    linked = np.minimum(length, np.fromiter((b.linked for b in blocks), float, n))
    group: dict[int, int] = {}
    parent = np.fromiter((group.setdefault(b.holder.up.number, len(group)) for b in blocks), int, n)
    under, under_linked = np.bincount(parent, length), np.bincount(parent, linked)
    logs = np.log1p(length) / 4
    place = (np.arange(n) + 0.5) / n
    words = np.fromiter((t.count(" ") + 1 for t in texts), float, n)
    out[:, 0] = logs
    out[:, 1] = linked / np.maximum(length, 1)
    out[:, 2] = np.minimum(1, np.fromiter((len(PUNCTUATION.findall(t)) for t in texts), float, n) / words)
    out[:, 3] = [SENTENCE_END.search(t, max(0, len(t) - 8)) is not None for t in texts]
    out[:, 4] = np.minimum(12, np.fromiter((b.holder.depth for b in blocks), float, n)) / 4
    out[:, 5], out[:, 6] = place, place * place
    out[:, 7] = under[parent] / max(1.0, length.sum())
    out[:, 8] = under_linked[parent] / np.maximum(1, under[parent])
    out[1:, 9], out[:-1, 10] = logs[:-1], logs[1:]
    out[:, 11] = ["©" in t for t in texts]
    return out


def distance(a: Frame, b: Frame) -> int:
    """Steps between two block elements in the DOM, ``FAR`` at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs to tie, with their distance: blocks next to each other, and successive blocks under one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, distance(blocks[i - 1].holder, b.holder)))
        before = last.get(b.holder.up.number, i)
        if before < i - 1:
            out.append((before, i, distance(blocks[before].holder, b.holder)))
        last[b.holder.up.number] = i
    return out


@dataclass(frozen=True)
class TextModel:
    """Weights of ``FEATURES`` and a constant; the strength of a tie by distance, 0 to ``FAR``."""

    weights: tuple[float, ...]
    constant: float
    ties: tuple[float, ...]


#: Where no page of a table names its parts: a fit of this module to pages of invented prose, rounded.
DEFAULT = TextModel(
    (-0.4, -2.0, -0.3, -2.0, -0.4, -0.1, 0.6, 8.4, -2.0, 2.5, 1.0, -2.9), -3.7, (2.0, 2.0, 2.0, 0.5, 0.5, 0.2, 0.1)
)


def named_label(block: Block, page_has_content: bool) -> float | None:
    """What the page's own names say: 1 content, 0 boilerplate, null if they say nothing."""
    if block.frame.boiler:
        return 0.0
    return 1.0 if block.frame.content else None


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; both labels weigh the same; the ridge pulls towards ``DEFAULT``."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*DEFAULT.weights, DEFAULT.constant])
    w = prior.copy()
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (y - p)) - ridge * (w - prior)
        hessian = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> TextModel:
    """Train on the blocks of about ``sample_pages`` pages (page_id, html), taken by hash; at most ``sample_blocks`` come to the driver.

    Pages that name no parts teach nothing; without a block of either label the model is ``DEFAULT``.
    """
    every = max(1, pages.count() // sample_pages)
    order = F.xxhash64("page_id", F.length("html"))
    # a second hash, as pages may be partitioned by the first
    sample = pages.where(F.pmod(F.xxhash64(order, F.lit(1)), F.lit(every)) == 0).select(order.alias("page"), "html")
    columns = "page long, i int, label double, x array<double>, near array<int>, far array<int>"

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for page, html in zip(part["page"], part["html"], strict=True):
                blocks = blocks_of(html or "")
                x = features(blocks, [clean(b) for b in blocks])
                near: dict[int, list[tuple[int, int]]] = {}
                for a, b, d in neighbours(blocks):
                    near.setdefault(b, []).append((a, d))
                has = any(b.frame.content for b in blocks)
                for i, b in enumerate(blocks):
                    pairs = near.get(i, [])
                    out.append((page, i, named_label(b, has), x[i].tolist(), [a for a, _ in pairs], [d for _, d in pairs]))
            yield pd.DataFrame(out, columns=["page", "i", "label", "x", "near", "far"])

    got = sample.mapInPandas(rows, columns).where("label is not null").orderBy("page", "i").limit(sample_blocks).collect()
    y = np.array([r.label for r in got])
    if not got or y.min() == y.max():
        return DEFAULT
    weights, constant = train(np.array([r.x for r in got]), y)
    labels = {(r.page, r.i): r.label for r in got}
    same, other = np.ones(FAR + 1), np.ones(FAR + 1)
    for r in got:
        for a, d in zip(r.near, r.far, strict=True):
            if (r.page, a) in labels:
                (same if labels[r.page, a] == r.label else other)[d] += 1
    ties = np.where(same + other > 2, np.clip(np.log(same / other), 0.0, TIE_LIMITS), DEFAULT.ties)
    return TextModel(tuple(weights), constant, tuple(ties))


def word_strength(blocks: list[Block], texts: list[str]) -> list[float]:
    """For each block how much a mark by words of a class or id counts, 0 to 1; 1 for blocks that have none.

    The share is of the text that no element or role marks as boilerplate. Where an article, a main part or a part that is
    named like content stands outside all such marks, they count in full.
    """
    open_text = [0 if b.frame.boiler and not b.frame.soft else len(t) for b, t in zip(blocks, texts, strict=True)]
    if any(n and not b.frame.boiler and (b.frame.content or b.frame.named) for n, b in zip(open_text, blocks, strict=True)):
        return [1.0] * len(blocks)
    so_far = np.concatenate([[0], np.cumsum(open_text)])
    low, high = WORD_SHARES

    def of(f: Frame) -> float:
        if not f.soft or f.marker is None:
            return 1.0
        share = (so_far[f.marker.last] - so_far[f.marker.first]) / max(1, so_far[-1])
        return float(np.clip((high - share) / (high - low), 0.0, 1.0))

    return [of(b.frame) for b in blocks]


def costs_of(blocks: list[Block], texts: list[str], model: TextModel) -> np.ndarray:
    """Each block's log-odds of being content: the classifier's, and what the markup adds."""
    own = features(blocks, texts) @ np.array(model.weights) + model.constant
    has_content = any(b.frame.content and not b.frame.boiler for b in blocks)
    marks = []
    for f, strength in zip((b.frame for b in blocks), word_strength(blocks, texts), strict=True):
        other = CONTENT if f.content else OUTSIDE if has_content else NAMED if f.named else 0.0
        marks.append(strength * BOILER + (1 - strength) * other if f.boiler else other)
    return np.clip(own, -TEXT_LIMIT, TEXT_LIMIT) + np.array(marks)


def minimum_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node stays with the source. ``costs`` above zero bind to the source, below to the sink."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    own = list(costs)
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None:
            continue
        if abs(own[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    waiting.append(j)
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        for i, side in zip(open_nodes, _max_flow(open_nodes, own, near, label), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], own: list[float], near: list[dict[int, float]], label: list[bool | None]) -> list[bool]:
    """Dinic's algorithm on the nodes that are still open."""
    place = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    head: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in nodes:
        if own[v] > 0:
            edge(source, place[v], own[v], 0.0)
        elif own[v] < 0:
            edge(place[v], sink, -own[v], 0.0)
        for u, w in near[v].items():
            if u > v and label[u] is None:
                edge(place[v], place[u], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * len(head)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        nexts = [0] * len(head)
        while True:
            path: list[int] = []
            v = source
            while v != sink:
                while nexts[v] < len(head[v]):
                    e = head[v][nexts[v]]
                    if room[e] > tiny and level[to[e]] == level[v] + 1:
                        break
                    nexts[v] += 1
                if nexts[v] < len(head[v]):
                    path.append(head[v][nexts[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    nexts[v] += 1
                else:
                    break
            if v != sink:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def main_text(page: str | None, model: TextModel = DEFAULT) -> str:
    """The article's text: blocks in page order joined by one space; empty for null and for a page without any."""
    blocks = blocks_of(page or "")
    texts = [clean(b) for b in blocks]
    if not blocks:
        return ""
    ties = [(a, b, model.ties[d]) for a, b, d in neighbours(blocks)]
    kept = minimum_cut(costs_of(blocks, texts, model).tolist(), ties)
    return " ".join(t for t, keep in zip(texts, kept, strict=True) if keep and t)


def extract_text(html: Column, model: TextModel = DEFAULT) -> Column:
    """Main text of a page by ``model``.

    A null or empty page and one without text give an empty text. Very long pages are cut whole, one page at a
    time in a task. A block that costs the same either way (a tie) is boilerplate. Equal pages give equal texts.
    """

    @F.pandas_udf(StringType())
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in pages], dtype="object")

    return of(html)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, one row for each row of ``pages``; repeated rows repeat, an empty table gives an empty one."""
    pages = table(spark, sf_dir, "pages")
    text = extract_text(F.col("html"), fit(pages.select("page_id", "html"))).alias("text")
    return pages.select("page_id", "url", text).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
