"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text.  A logistic classifier sees features of a block's text and of
the markup around it; its log-odds, bounded, become a capacity from the source (content) or to the
sink (boilerplate).  Neighbouring blocks and blocks under one parent are tied by smoothness edges.
The minimum cut labels all blocks at once, and may turn a block against its own evidence.

The classifier is trained on blocks of a bounded sample of pages whose markup says what they are.
Each is learned twice, with and without its markup, so that text has to count as well.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Pages that the classifier is trained on: those with the smallest hashes of their ids.
MAX_TRAINING_PAGES = 1_000

# Element names of the HTML standard by their role here.
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "noscript", "svg", "math", "object", "video", "audio", "canvas", "select", "datalist")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr", "rp", "rt")
BOILERPLATE_TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")
CONTENT_TAGS = ("article", "main")
BOILERPLATE_NAMES = ("ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget")
CONTENT_NAMES = ("article", "content", "entry", "main", "post", "story")
BOILERPLATE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "form")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
#: In a class name, what comes behind is had or lacked, not what the element is.
_WITH = re.compile(r"(?:^|[-_])(?:with|without|has|no)(?=[-_])")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that end an open one of the same group.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(frozen=True)
class _Marks:
    """What the open elements say about what they hold."""

    #: In an element that is boilerplate by its tag, role or style.
    apart: bool = False
    #: In an element named like boilerplate, within the innermost content element or without one.
    named: bool = False
    #: In an element named like boilerplate that holds the innermost content element.
    around: bool = False
    #: In a content element and in no boilerplate within it: by tag or role, by name.
    content: bool = False
    content_name: bool = False

    def within(self, mark: int) -> _Marks:
        if not mark:
            return self
        if mark == APART:
            return _Marks(True, self.named, self.around)
        if mark == NAMED:
            return _Marks(self.apart, True, self.around)
        # The innermost content element is what counts.
        return _Marks(self.apart, False, self.around or self.named, self.content or mark == CONTENT, self.content_name or mark == CONTENT_NAME)


#: Evidence of one element.
APART, NAMED, CONTENT, CONTENT_NAME = -2, -1, 2, 1
_NO_MARKS = _Marks()


@dataclass
class Block:
    text: str = ""
    linked: int = 0
    tag: str = "body"
    marks: _Marks = _NO_MARKS
    #: Number of the element above the block's own; steps in the tree from the block before.
    parent: int = 0
    steps: int = 0


@dataclass
class _Element:
    tag: str
    marks: _Marks
    #: Of the innermost element that is not inline: tag, number, its parent's number, depth.
    block_tag: str
    number: int
    parent: int
    depth: int


def _mark(tag: str, attributes: str) -> int:
    if tag in BOILERPLATE_TAGS:
        return APART
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    role = found.get("role", "").lower()
    if tag not in ("body", "html"):
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or role in BOILERPLATE_ROLES:
            return APART
    if tag in CONTENT_TAGS or role == "main" or found.get("itemprop", "").lower() == "articlebody":
        return CONTENT
    if tag in ("body", "html"):
        return 0
    # Words behind "with", "has", "no" tell what else the page has or lacks.
    names = {w for n in f"{found.get('class', '')} {found.get('id', '')}".lower().split() for w in _NAME.findall(_WITH.split(n)[0])}
    return NAMED if names.intersection(BOILERPLATE_NAMES) else CONTENT_NAME if names.intersection(CONTENT_NAMES) else 0


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of text of a page, in order; white space is one blank, references are decoded."""
    page = page or ""
    done: list[Block] = []
    stack: list[_Element] = [_Element("", _NO_MARKS, "body", 0, 0, 0)]
    open_tags: Counter = Counter()
    text: list[str] = []
    linked = number = in_link = at = depth_before = low = 0

    def flush() -> None:
        nonlocal text, linked, depth_before, low
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                e = stack[-1]
                done.append(Block(joined, linked, e.block_tag, e.marks, e.parent, depth_before + e.depth - 2 * min(low, e.depth)))
                depth_before = low = e.depth
        text, linked = [], 0

    def close(upto: int) -> None:
        nonlocal in_link, low
        while len(stack) > upto:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            in_link -= gone.tag == "a"
        low = min(low, stack[-1].depth)

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if not m[0].startswith(("<!", "<?")):
                piece = html.unescape(m[0])
                text.append(piece)
                linked += len(piece) if in_link else 0
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if closing:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        number += 1
        above = stack[-1]
        mark = _mark(tag, attributes)
        if tag == "header" and not mark:
            # Of the page, or of the article: its headings are text, a byline is not.
            mark = NAMED if above.marks.content else APART
        marks = above.marks.within(mark)
        if tag in _HEADINGS and above.block_tag == "header" and above.marks.named and not above.marks.apart:
            marks = _Marks(content=True)
        stack.append(_Element(tag, marks, above.block_tag, above.number, above.parent, above.depth) if tag in INLINE else _Element(tag, marks, tag, number, above.number, above.depth + 1))
        open_tags[tag] += 1
        in_link += tag == "a"
    flush()
    return done


#: Width of the features of text and of those of markup.
_TEXT, _MARKUP = 7, 6
#: Log-odds before anything is learned: text features (scaled), markup features, constant.
_PRIOR = np.array([0.3, -0.8, 0.2, 0.4, 0.0, -0.3, 0.0, -3.0, -2.2, -0.2, 2.5, 1.5, -1.2, 0.2])


def page_features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: of its text, then of the markup around it."""
    some = any(b.marks.content for b in blocks)
    out = np.zeros((len(blocks), _TEXT + _MARKUP))
    for i, b in enumerate(blocks):
        n, m = max(1, len(b.text)), b.marks
        place = i / max(1, len(blocks) - 1)
        out[i] = (math.log1p(n), min(1.0, b.linked / n), sum(map(b.text.count, ".,;:!?")) / n * 10, b.text[-1] in ".!?", b.tag in _HEADINGS, b.tag in ("li", "td", "th"), abs(place - 0.5),
                  m.apart, m.named, m.around, m.content, m.content_name, some and not m.content)
    return out


def known_label(b: Block, some: bool) -> bool | None:
    """What the markup alone says, if it is clear: whether the block is content."""
    if b.marks.apart or b.marks.named:
        return False
    return True if b.marks.content else False if some else None


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (Dinic's algorithm).

    A positive score is the capacity from the source, a negative one that to the sink.
    """
    n = len(score)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def tie(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        left.append(forth)
        head[b].append(len(to))
        to.append(a)
        left.append(back)
    for i, v in enumerate(score):
        if v > 0:
            tie(s, i, v, 0.0)
        elif v < 0:
            tie(i, t, -v, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if left[e] <= tiny)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                nxt[a] += 1
                continue
            path.append(e)
            a = to[e]


@dataclass(frozen=True)
class CutWeights:
    #: Most that a block's own evidence can weigh; its edges weigh up to twice neighbour and sibling.
    capacity: float = 3.0
    neighbour: float = 0.6
    sibling: float = 1.0


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def log_odds(blocks: list[Block], model: Model) -> np.ndarray:
    centre, scale, beta = model
    return np.column_stack([(page_features(blocks) - centre) / scale, np.ones(len(blocks))]) @ beta


def label(blocks: list[Block], model: Model, weights: CutWeights) -> list[bool]:
    """Whether each block is content."""
    if not blocks:
        return []
    score = np.clip(log_odds(blocks, model), -weights.capacity, weights.capacity).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, weights.neighbour / (1 + b.steps)))
        if b.parent in last:
            edges.append((last[b.parent], i, weights.sibling))
        last[b.parent] = i
    kept = minimum_cut(score, edges)
    if any(kept):
        return kept
    # A page has some content, unless its markup says that all of it is boilerplate.
    plain = [not (b.marks.apart or b.marks.named) for b in blocks]
    return plain if any(plain) else [not b.marks.apart and b.linked == 0 and b.text[-1] in ".!?" for b in blocks]


def _fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression, drawn to the prior."""
    centre, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    centre[:_TEXT], scale[:_TEXT] = x[:, :_TEXT].mean(axis=0), x[:, :_TEXT].std(axis=0) + 1e-9
    z, beta = np.column_stack([(x - centre) / scale, np.ones(len(x))]), _PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(beta)), z.T @ (p - y) + beta - _PRIOR)
    return centre, scale, beta


#: Where no page says what it is: usual length, share of links, marks and place of a block.
_UNTRAINED = (np.array([4.0, 0.2, 0.2, 0.5, 0.1, 0.2, 0.25] + [0.0] * _MARKUP), np.array([1.5, 0.4, 0.2, 0.5, 0.3, 0.4, 0.15] + [1.0] * _MARKUP), _PRIOR)


def train(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> Model:
    """The block classifier; the untrained one if the sample has not both kinds of blocks.

    Tasks give counts of feature rows rounded to steps, so the driver gets sums, not blocks.
    """
    width = _TEXT + _MARKUP

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: Counter = Counter()
            for page in b["html"]:
                blocks = blocks_of(page)
                some = any(x.marks.content for x in blocks)
                for block, x in zip(blocks, page_features(blocks)):
                    says = known_label(block, some)
                    if says is not None:
                        x = np.round(x * 4) / 4
                        rows[says, tuple(x)] += 1
                        rows[says, (*x[:_TEXT], *[0.0] * _MARKUP)] += 1
            yield pd.DataFrame([(says, list(x), n) for (says, x), n in rows.items()], columns=["content", "x", "n"])
    ids = pages.where("page_id is not null").select(F.col("page_id").alias("id")).orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = pages.join(F.broadcast(materialise(ids)), F.col("page_id") == F.col("id"), "left_semi").select("html")
    rows = sample.mapInPandas(read, "content boolean, x array<double>, n long").groupBy("content", "x").agg(F.sum("n").alias("n"))
    most = 20_000  # of the different rows those seen most, which bounds the driver
    rows = rows.orderBy(F.desc("n"), "content", "x").limit(most).toPandas()
    if not len(rows) or rows["content"].all() or not rows["content"].any():
        return _UNTRAINED
    x, y, n = np.array(rows["x"].tolist()).reshape(len(rows), width), rows["content"].to_numpy(dtype=float), np.minimum(rows["n"].to_numpy(), 20)
    return _fit(np.repeat(x, n, axis=0), np.repeat(y, n))


def extract(pages: DataFrame, weights: CutWeights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url, html).

    The text is that of the content blocks, joined by one blank.  A null or empty page has an empty
    text; repeated rows and nulls in page_id and url stay; an empty table gives an empty result;
    further columns are ignored.
    """
    weights = weights or CutWeights()
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    model = train(pages)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for page in b["html"]:
                blocks = blocks_of(page)
                texts.append(" ".join(x.text for x, kept in zip(blocks, label(blocks, model, weights)) if kept))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})
    return pages.mapInPandas(work, "page_id long, url string, text string, n_chars long")
