"""Main text of web pages: a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Pages whose blocks the classifier is fitted on: a bound for any corpus.
SAMPLE_PAGES = 2000

# Names that page authors give to page parts, as words of class, id and role, and as elements.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar masthead header "
    "footer contentinfo copyright legal sidebar aside widget complementary related recommended "
    "share sharing social cookie cookies consent notice notices alert popup modal overlay dialog "
    "newsletter subscribe signup login search form comment comments reply replies respond disqus "
    "hidden skip tracking".split()
)
CONTENT_WORDS = frozenset("article main content post entry story".split())
# Within a compound name these often tell of a layout (right-sidebar), so what is below may be content;
# a compound with a word of state (no-sidebar, overflow-hidden) tells nothing.
LAYOUT_WORDS = frozenset("sidebar hidden search form header nav navbar menu banner toolbar".split())
STATE_WORDS = frozenset("no not non without with has have off overflow".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_TAGS = frozenset(("article", "main"))
SKIPPED_TAGS = frozenset(
    "script style noscript template textarea select button svg iframe object title canvas audio "
    "video head datalist".split()
)
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An element that closes an open one of these names, up to the nearest block of another name.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = 8
# Where the fit starts from and stays close to without data: bias, nearest named part is content,
# is boilerplate, length, share in links, ends like a sentence, is a list item, is a heading.
PRIOR = np.array([-1.5, 4.0, -6.0, 0.6, -3.0, 1.0, -0.5, 0.0])
SMOOTH_NEAR, SMOOTH_PARENT = 0.4, 0.6


class Block(NamedTuple):
    text: str
    parent: int
    part: int  # nearest named part: 1 content, -1 boilerplate, 0 none
    linked: int
    listed: bool
    heading: bool


# Parts while they are told apart: content, none, boilerplate by a layout's name, boilerplate for sure.
CONTENT, NONE, UNSURE, SURE = 1, 0, -1, -2


def _part_of(tag: str, attributes: str, inherited: int) -> int:
    """The part an element names, else that of the elements around it. A header inside content is its headline."""
    if tag in ("html", "body"):
        return inherited
    words: set[str] = set()
    layout: set[str] = set()
    if "=" in attributes:
        for found in _NAMES.findall(attributes):
            for name in "".join(found).split():
                own = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
                if len(own) == 1:
                    words.update(own)
                elif STATE_WORDS.isdisjoint(own):
                    unsure = LAYOUT_WORDS.intersection(own)
                    layout |= unsure
                    words.update(w for w in own if not unsure or w not in CONTENT_WORDS and w not in LAYOUT_WORDS)
    if inherited > 0:
        words.discard("header")
        layout.discard("header")
        if tag == "header":
            tag = "div"
    if tag in BOILERPLATE_TAGS or words & BOILERPLATE_WORDS or (attributes and _HIDDEN.search(attributes)):
        return SURE
    if tag in CONTENT_TAGS or (words & CONTENT_WORDS and inherited >= UNSURE):
        return CONTENT
    return min(inherited, UNSURE) if layout else inherited


def _parts(elements: list[tuple[int, str, str]], blocks: list[Block]) -> list[int]:
    """Of each element (the one around it, tag, attributes) the part its text is in.

    A class, id or role, or a form, that holds most of the page's unlinked text is a wrapper and marks
    nothing, unless other elements outside it are named as content.
    """
    wrappers: set[int] = set()
    sizes = None
    while True:
        parts = [NONE] * len(elements)
        for i, (up, tag, attributes) in enumerate(elements[1:], 1):
            plain = i in wrappers or not (attributes or tag in BOILERPLATE_TAGS or tag in CONTENT_TAGS)
            parts[i] = parts[up] if plain else _part_of(tag, attributes, parts[up])
        if min(parts) >= NONE:
            return parts
        if sizes is None:
            sizes = [0] * len(elements)
            for block in blocks:
                sizes[block.part] += max(0, len(block.text) - block.linked)
            whole = _with_inner(elements, sizes)
        content = _with_inner(elements, [n if p > 0 else 0 for n, p in zip(sizes, parts, strict=True)])
        fresh = {
            i
            for i, (up, tag, attributes) in enumerate(elements)
            if parts[i] < NONE <= parts[up]
            and 2 * whole[i] > whole[0]
            and content[i] == content[0]
            and (tag == "form" or tag not in BOILERPLATE_TAGS)
            and not _HIDDEN.search(attributes)
        }
        if not fresh:
            return parts
        wrappers |= fresh


def _with_inner(elements: list[tuple[int, str, str]], sizes: list[int]) -> list[int]:
    out = list(sizes)
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i][0]] += out[i]
    return out


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in its order, as loosely as browsers read markup."""
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, number, listed, link
    elements: list[tuple[int, str, str]] = [(0, "", "")]  # number of the one around it, tag, attributes
    pieces: list[str] = []
    linked, at, size = 0, 0, len(html)
    heading = False

    def flush() -> None:
        nonlocal linked, pieces, heading
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                holder = next(x for x in reversed(stack) if x[0] in BLOCK_TAGS or not x[0])
                up = stack.index(holder)
                parent = stack[up - 1][1] if up and holder[0] in ("p", "li", "h1", "h2", "h3") else holder[1]
                blocks.append(Block(text, parent, stack[-1][1], linked, stack[-1][2], heading))
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1][3]:
                linked += len(text)

    while at < size:
        found = _TAG.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                pieces.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCK_TAGS:
                flush()
            if depth and (tag in BLOCK_TAGS or not any(x[0] in BLOCK_TAGS for x in stack[depth:])):
                del stack[depth:]
            heading = False if tag in BLOCK_TAGS else heading
            continue
        attributes = found[3] or ""
        if tag in SKIPPED_TAGS:
            if tag == "head":
                continue  # its elements are skipped or hold no text
            if attributes.endswith("/") and tag in ("svg", "object", "canvas"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            if close:
                at = close.end()
            elif tag in RAW_TAGS:
                at = size
            continue
        if tag in ("br", "wbr") or tag in VOID_TAGS and tag != "hr":
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            while len(stack) > 1 and stack[-1][0] not in BLOCK_TAGS:
                stack.pop()  # inline markup left open ends with its block
            if stack[-1][0] == "p":
                stack.pop()
            gone = CLOSES.get(tag)
            while gone and len(stack) > 1 and (stack[-1][0] in gone or stack[-1][0] == "p"):
                stack.pop()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if tag == "hr":
                continue
        _, around, listed, link = stack[-1]
        stack.append((tag, len(elements), listed or tag in ("li", "td", "th"), link or tag == "a"))
        elements.append((around, tag, attributes))
    flush()
    # So far the part of a block is the number of its element.
    parts = _parts(elements, blocks)
    return [b._replace(part=max(-1, parts[b.part])) for b in blocks]


def features_of(blocks: list[Block]) -> np.ndarray:
    rows = [
        (1.0, b.part > 0, b.part < 0, np.log1p(len(b.text)) / 2, b.linked / max(1, len(b.text)), b.text[-1] in ".!?:;\"'", b.listed, b.heading)
        for b in blocks
    ]
    return np.array(rows, np.float64).reshape(len(blocks), FEATURES)


def fit(features: np.ndarray, labels: np.ndarray, pull: float = 5.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR.

    Every block counts twice, with its named part and without, so the other features learn to
    decide pages that name no parts.
    """
    blind = features.copy()
    blind[:, 1:3] = 0
    x, y = np.concatenate([features, blind]), np.concatenate([labels, labels])
    weights = PRIOR.copy()
    for _ in range(25 if len(labels) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + pull * (weights - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(FEATURES)
        weights -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return weights


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    ``gains`` is the capacity from the source less that to the sink (the flow through both is sent
    at once); ``edges`` hold a capacity for either direction. Breadth-first levels, then blocking
    flows along them, until the sink is out of reach.
    """
    size = len(gains)
    excess = list(gains)
    ahead: list[list[int]] = [[] for _ in range(size)]
    target, room = [], []
    for a, b, capacity in edges:
        for u, v in ((a, b), (b, a)):
            ahead[u].append(len(target))
            target.append(v)
            room.append(capacity)
    while True:
        level = [-1] * size
        queue = deque(i for i in range(size) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            if excess[u] < 0:
                reached = True
                continue
            for e in ahead[u]:
                if room[e] > 0 and level[target[e]] < 0:
                    level[target[e]] = level[u] + 1
                    queue.append(target[e])
        if not reached:
            return [depth >= 0 for depth in level]
        turn = [0] * size
        for start in range(size):
            while excess[start] > 0 and level[start] == 0:
                path, u = [], start
                while True:
                    if excess[u] < 0:
                        flow = min([excess[start], -excess[u], *(room[e] for e in path)])
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        excess[start] -= flow
                        excess[u] += flow
                        break
                    while turn[u] < len(ahead[u]):
                        e = ahead[u][turn[u]]
                        if room[e] > 0 and level[target[e]] == level[u] + 1:
                            break
                        turn[u] += 1
                    else:
                        if not path:
                            break
                        u = target[path.pop() ^ 1]
                        turn[u] += 1
                        continue
                    path.append(e)
                    u = target[e]
                if turn[start] >= len(ahead[start]) and not path:
                    break


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by blank lines; empty for null and for pages without any."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    scale = 1000
    gains = np.rint(np.clip(features_of(blocks) @ weights, -12, 12) * scale).astype(int).tolist()
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            same = blocks[i - 1].part == block.part
            edges[i - 1, i] = int(scale * SMOOTH_NEAR * (1 if same else 0.25))
        if block.parent in last:
            pair = last[block.parent], i
            edges[pair] = edges.get(pair, 0) + int(scale * SMOOTH_PARENT)
        last[block.parent] = i
    kept = min_cut(gains, [(a, b, c) for (a, b), c in edges.items()])
    return "\n\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def _pages(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def learn(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the block classifier, from the blocks of at most ``sample_pages`` pages that lie in
    a named part; drawn by a digest of the page, so the draw doesn't depend on partitions."""
    column = F.col(f"`{html}`")
    share = min(1.0, sample_pages / max(1, pages.count()))
    scale = 1_000_003
    drawn = pages.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(scale)) < int(share * scale) + 1)
    fields = "label double, " + ", ".join(f"f{i} double" for i in range(FEATURES)) + ", n bigint"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in _pages(batch.column(0)):
                blocks = [b for b in blocks_of(page or "") if b.part]
                rows = np.column_stack([[float(b.part > 0) for b in blocks], features_of(blocks)]) if blocks else np.empty((0, FEATURES + 1))
                # Like rows are summed here, so a page of any length sends few of them.
                rows, n = np.unique(np.round(rows, 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(FEATURES + 1)), pa.array(n, pa.int64())], names=["label", *[f"f{i}" for i in range(FEATURES)], "n"])

    rows = drawn.select(column).mapInArrow(label, fields).groupBy("label", *[f"f{i}" for i in range(FEATURES)]).agg(F.sum("n").alias("n"))
    found = sorted(tuple(r) for r in rows.collect())  # rounded to tenths: a few thousand at most
    data = np.array(found, np.float64).reshape(len(found), FEATURES + 2)
    share = np.maximum(1, np.rint(data[:, -1] / max(1.0, data[:, -1].sum() / 20_000))).astype(int)
    data = np.repeat(data, share, axis=0)
    return fit(data[:, 1:-1], data[:, 0])


def extract(pages: DataFrame, weights: np.ndarray, html: str = "html") -> DataFrame:
    """Adds ``text``, the page's main text, to ``pages``; a column of that name is replaced. Rows don't move.

    Null and empty pages, and pages without a content block, get an empty text.
    """
    kept = [c for c in pages.columns if c != "text"]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p, weights) for p in _pages(part.column(part.schema.get_field_index(html)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(read, T.StructType([*rows.schema, T.StructField("text", T.StringType())]))
