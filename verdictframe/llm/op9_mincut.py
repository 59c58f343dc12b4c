"""Main text of web pages by minimum cut.

A page is a row of text blocks. A classifier gives each block a cost of being content and of being boilerplate; these
are the capacities to the two terminals of a graph in which neighbours on the page and in the document tree are tied by
smoothness edges. The minimum cut is the labelling of the least total cost. The classifier is a logistic model that
starts from fixed weights and is fitted to blocks whose place in the tree names their role.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inverse

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
SILENT = frozenset("head button select option datalist svg math canvas audio video object".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre figcaption dd td".split())
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
ROLES = {"main": 1, "article": 1, "navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "menu": -1}
BAD = frozenset("ad ads advert advertisement adbox banner sponsor sponsored promo promotion comment comments reply replies disqus discussion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended widget tags pagination pager toolbar copyright legal skip".split())
GOOD = frozenset("article content main post entry story body maincontent articlebody posttext prose".split())

FEATURES = ("bias", "in_main", "in_aside", "bad_name", "good_name", "links", "length", "sentence", "heading", "prose", "item", "mark")
#: Weights that the fit starts from and is drawn to.
PRIOR = np.array([-1.0, 4.0, -5.0, -4.0, 1.5, -3.0, 2.5, 0.7, 0.0, 1.0, -0.5, -2.0])
#: Pages that the classifier is fitted to, the first of a hash order, and the blocks of each that count.
SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 400
#: Capacities of smoothness edges: next block, and previous block of the same container.
NEXT, SIBLING = 0.5, 0.3

_ATTR = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("open", tag, attributes), ("close", tag, ""); comments, declarations and the content of raw
    elements are passed over. A tag that doesn't end is the end of the page."""
    at, n = 0, len(page)
    low = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        nxt = page[lt + 1 : lt + 2]
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if page.startswith("<!--", lt):
            if lt > at:
                yield "text", page[at:lt], ""
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?") or closing and not name:
            if lt > at:
                yield "text", page[at:lt], ""
            end = page.find(">", lt + 1)
            at = n if end < 0 else end + 1
        elif not name:  # a bare sign
            yield "text", page[at : lt + 1], ""
            at = lt + 1
        else:
            if lt > at:
                yield "text", page[at:lt], ""
            end = _tag_end(page, name.end())
            if end < 0:
                return
            tag, attributes = name[0].lower(), page[name.end() : end]
            at = end + 1
            if closing:
                yield "close", tag, ""
            else:
                yield "open", tag, attributes
                if tag in RAW:
                    low = low or page.lower()
                    if len(low) != n:  # a letter whose lower case is longer: look for both cases by hand
                        stop = re.compile(rf"(?i)</{tag}").search(page, at)
                        stop = stop.start() if stop else -1
                    else:
                        stop = low.find(f"</{tag}", at)
                    at = n if stop < 0 else stop


_QUOTED = re.compile(r"""=\s*(["'])|>""")


def _tag_end(page: str, at: int) -> int:
    """The sign that ends the tag, outside quoted values; a value without its end quote ends at the first sign."""
    first = page.find(">", at)
    while True:
        m = _QUOTED.search(page, at)
        if not m:
            return first
        if m[0] == ">":
            return m.start()
        end = page.find(m[1], m.end())
        if end < 0:
            return first
        at = end + 1


class _Open:
    __slots__ = ("tag", "main", "aside", "bad", "good", "silent", "number")

    def __init__(self, tag: str, parent: "_Open | None", attributes: str, number: int) -> None:
        self.tag, self.number = tag, number
        self.main, self.aside, self.bad, self.good, self.silent = (parent.main, parent.aside, parent.bad, parent.good, parent.silent) if parent else (False,) * 5
        names, role = set(), ""
        if attributes:
            for key, value in _ATTR.findall(attributes):
                value = value.strip("\"'").lower()
                if key.lower() == "role":
                    role = value.strip()
                else:
                    names |= set(re.split(r"[^a-z0-9]+", value))
        if tag in MAIN or ROLES.get(role) == 1:
            self.main, self.aside, self.bad = True, False, False
        elif tag in ASIDE or ROLES.get(role) == -1 or tag == "header" and not self.main:
            self.main, self.aside = False, True
        if tag not in ("html", "body") and names & BAD and not (tag in MAIN):
            self.main, self.bad = False, True
        elif names & GOOD:
            self.good = True
        self.silent = self.silent or tag in SILENT


class Block:
    """Text of one block with what the classifier sees; ``path`` numbers its open elements from the root."""

    __slots__ = ("text", "link", "where", "tag", "path")

    def __init__(self, text: str, link: int, where: _Open, tag: str, path: tuple[int, ...]) -> None:
        self.text, self.link, self.where, self.tag, self.path = text, link, where, tag, path

    def features(self) -> list[float]:
        t, w = self.text, self.where
        return [1.0, w.main, w.aside, w.bad, w.good and not w.bad and not w.aside, min(1.0, self.link / len(t)), min(1.0, np.log1p(len(t)) / 7),
                t[-1] in ".!?…\"”", self.tag in HEADING, self.tag in PROSE, self.tag == "li", "©" in t]


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space made single."""
    root = _Open("", None, "", 0)
    stack, out, parts, link, links, number = [root], [], [], 0, 0, 0

    def flush() -> None:
        nonlocal parts, link
        text = " ".join("".join(parts).split())
        if text:
            holder = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in BLOCK), 0)
            out.append(Block(text, link, stack[-1] if stack[-1].tag not in BLOCK else stack[holder], stack[holder].tag, tuple(o.number for o in stack[: holder + 1])))
        parts, link = [], 0

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if not stack[-1].silent:
                text = html.unescape(value)
                parts.append(text)
                if links:
                    link += len(text.strip())
        elif kind == "open":
            if value in RAW:
                continue
            if value == "br":
                parts.append(" ")
                continue
            if value in BLOCK:
                flush()
            elif value in SILENT:
                flush()
            while len(stack) > 1 and value in CLOSES.get(stack[-1].tag, ()):
                stack.pop()
            if value in CLOSES["p"] and any(o.tag == "p" for o in stack[-8:]):
                # a paragraph ends with its unclosed inline elements
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        links -= sum(o.tag == "a" for o in stack[i:])
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            if value in VOID:
                continue
            number += 1
            stack.append(_Open(value, stack[-1], attributes, number))
            links += value == "a"
        else:
            if value in RAW or value in VOID:
                continue
            if value in BLOCK or value in SILENT:
                flush()
            if any(o.tag == value for o in stack[1:]):
                while stack[-1].tag != value:
                    links -= stack.pop().tag == "a"
                links -= stack.pop().tag == "a"
    flush()
    return out


def _near(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """1 for blocks of one parent, less the farther apart they are in the tree."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return 1.0 / (1 + max(0, max(len(a), len(b)) - same - 1))


def edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges by pair of block numbers: next on the page, and last before in the same container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            out[i - 1, i] = out.get((i - 1, i), 0.0) + NEXT * _near(page[i - 1].path, b.path)
        container = b.path[-2] if len(b.path) > 1 else 0
        if container in last:
            out[last[container], i] = out.get((last[container], i), 0.0) + SIBLING
        last[container] = i
    return out


def minimum_cut(score: list[float], tied: dict[tuple[int, int], float]) -> list[bool]:
    """True for the source side (content) of the minimum cut. ``score`` > 0 is a capacity from the source, < 0 one to the sink.

    A block whose score outweighs all its edges has that label in every minimum cut; it is fixed and its edges become
    part of its neighbours' scores. What is open after that goes through max-flow along shortest paths.
    """
    n = len(score)
    score = list(score)
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in tied.items():
        ties[a][b] = ties[a].get(b, 0.0) + w
        ties[b][a] = ties[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    ready = deque(i for i in range(n) if abs(score[i]) > sum(ties[i].values()))
    while ready:
        i = ready.popleft()
        if label[i] is not None or abs(score[i]) <= sum(ties[i].values()):
            continue
        label[i] = score[i] > 0
        for j, w in ties[i].items():
            score[j] += w if label[i] else -w
            del ties[j][i]
            if label[j] is None and abs(score[j]) > sum(ties[j].values()):
                ready.append(j)
        ties[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _max_flow(rest, score, ties)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], score: list[float], ties: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches when the flow is greatest."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(ties[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if score[i] > 0:
            room[source][i] = score[i]
            room[i].setdefault(source, 0.0)
        elif score[i] < 0:
            room[i][sink] = -score[i]
            room[sink].setdefault(i, 0.0)
    while True:
        came, todo = {source: source}, deque([source])
        while todo and sink not in came:
            u = todo.popleft()
            for v, r in room[u].items():
                if r > 1e-9 and v not in came:
                    came[v] = u
                    todo.append(v)
        if sink not in came:
            return set(came) - {source}
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        push = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= push
            room[v][u] = room[v].get(u, 0.0) + push


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    if not found:
        return ""
    score = np.array([b.features() for b in found], dtype=float) * weights
    keep = minimum_cut(score.sum(axis=1).tolist(), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = [], []
        for page in b.column(0).to_pylist():
            for x in blocks(page or "")[:SAMPLE_BLOCKS]:
                w = x.where
                if w.main or w.aside or w.bad:
                    xs.append([float(v) for v in x.features()])
                    ys.append(w.main)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.bool_())], ["x", "y"])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, pull: float = 5.0, rounds: int = 30) -> np.ndarray:
    """Weights of the logistic model, by Newton steps on a bounded sample: the first ``sample_pages`` pages by hash, and
    of each the first ``SAMPLE_BLOCKS`` blocks whose place in the tree names their role. ``pull``: strength of the draw
    to ``PRIOR``, which also is the result where no block has such a place."""
    mark = F.xxhash64("url", "page_id")
    # hashes alone are ordered; pages are read once the last one's is known
    last = pages.select(mark.alias("h")).orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    rows = pages.where(mark <= F.lit(last)).select("html").limit(sample_pages).mapInArrow(_labelled, "x array<double>, y boolean").collect()
    if not rows:
        return PRIOR
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        gradient = (x * (p - y)[:, None]).sum(axis=0) / len(y) * 50 + pull * (w - PRIOR)
        hessian = np.einsum("ni,nj->ij", x * (p * (1 - p))[:, None], x) / len(y) * 50 + pull * np.eye(len(w))
        step = (inverse(hessian) * gradient).sum(axis=1)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def _extractor(weights: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page or "", weights) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return go


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars. No shuffle.

    Null and empty pages have an empty text; repeated and null ids are rows like any other; an empty table gives an
    empty result; a page without tags is one block. ``weights``: the model, else fitted to a sample of ``pages``.
    """
    weights = fit(pages) if weights is None else weights
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extractor(weights), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
