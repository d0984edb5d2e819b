"""Main text of web pages: blocks labelled by a minimum cut."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import rows_of, whole

# HTML's elements by their role here.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
              "span strike strong sub sup time tt u var wbr".split())
#: Elements without text of their own for a reader, up to their end tag.
_RAW = set("script style noscript template textarea title svg math iframe object canvas audio video head select".split())
#: Of these, the ones in which there is no markup.
_TEXT_ONLY = set("script style textarea title".split())
_BOILERPLATE = set("nav footer aside form menu dialog button fieldset address".split())
_MAIN = set("article main".split())
_BOILERPLATE_NAMES = set(
    "nav navbar navigation menu header masthead footer sidebar aside side rail cookie cookies consent gdpr notice notices "
    "alert banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related "
    "recommended share sharing social breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup "
    "login form search popup modal overlay widget toolbar copyright legal disclaimer comment comments commentlist disqus "
    "respond reply replies reactions hidden skip tags".split())
#: Of these, the ones that parts of an article are named with as well, as in ``side-by-side`` or ``tags-guide``.
_DOUBTFUL_NAMES = set("side rail alert notice notices legal header form search tags skip menu widget overlay hidden "
                      "copyright disclaimer share sharing social related recommended promotion respond reply".split())
_MAIN_NAMES = set("article main content post entry story body text articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                        re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CLAUSE = re.compile(r"[.,;:!?…。，]")

#: Costs of the classifier, in nats: what each sign adds for (positive) or against main text.
IN_MAIN, IN_MAIN_NAME, IN_BOILERPLATE, IN_BOILERPLATE_NAME, HIDDEN, PAGE_HEADER = 4.0, 2.0, -9.0, -7.0, -12.0, -7.0
#: A doubtful name inside main text: long unlinked prose outweighs it, short or linked text does not.
IN_DOUBTFUL_NAME = -4.8
START, LONG_TEXT, CLAUSES, LINKS, HEADING = -0.6, 1.6, 0.8, -3.5, 0.6
#: Smoothness: neighbours in the page, and blocks under one parent.
NEIGHBOUR, SIBLING = 0.5, 0.4


@dataclass
class Element:
    """An open element, with what holds of it and all those around it, so that no stack need be walked."""

    tag: str
    number: int
    high: float  # greatest and least sign, at least and at most zero
    low: float
    in_main: bool
    block_at: int  # place on the stack of the innermost element that is not inline, or -1


class OpenElements:
    """The open elements; each is pushed and removed once, and found by its tag without a search."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.links = 0

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else _NONE

    def push(self, tag: str, number: int, sign: float, main: bool) -> None:
        top, at = self.top, len(self.stack)
        self.stack.append(Element(tag, number, max(top.high, sign), min(top.low, sign), top.in_main or main,
                                  top.block_at if tag in _INLINE else at))
        self.places.setdefault(tag, []).append(at)
        self.links += tag == "a"

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this tag, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close_from(self, at: int) -> None:
        for e in reversed(self.stack[at:]):
            self.places[e.tag].pop()
            self.links -= e.tag == "a"
        del self.stack[at:]

    def close_same(self, tag: str) -> None:
        """Close an open element of this tag if only inline elements and paragraphs lie in it."""
        at = self.top.block_at
        while at >= 0:
            if self.stack[at].tag == tag:
                self.close_from(at)
                return
            if self.stack[at].tag != "p" or at == 0:
                return
            at = self.stack[at - 1].block_at


_NONE = Element("", 0, 0.0, 0.0, False, -1)


@dataclass
class Block:
    parent: int
    tag: str
    sign: float
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def element_sign(tag: str, attributes: str, in_main: bool) -> tuple[float, bool]:
    """What an element says about its text, and whether it is a container of main text."""
    if tag in _BOILERPLATE:
        return IN_BOILERPLATE, False
    if tag == "header" and not in_main:
        return PAGE_HEADER, False
    main = tag in _MAIN
    sign = IN_MAIN if main else 0.0
    if attributes and attributes.strip(" /"):
        names: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" \
                    or key == "style" and "display:none" in value.replace(" ", ""):
                return HIDDEN, False
            if key != "style":
                names.update(_NAME.findall(value))
        if (told := names & _BOILERPLATE_NAMES) and tag not in ("html", "body") and not main:
            return IN_DOUBTFUL_NAME if in_main and told <= _DOUBTFUL_NAMES else IN_BOILERPLATE_NAME, False
        if names & _MAIN_NAMES and tag not in ("html", "body", "p") and not main:
            return IN_MAIN_NAME, True
    return sign, main


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order; markup that is never closed does no harm."""
    open_ = OpenElements()
    blocks: list[Block] = []
    open_block: Block | None = None
    number = at = 0
    length = len(page)
    never_closed: set[str] = set()

    def add(raw: str) -> None:
        nonlocal open_block
        if open_block is None:
            if not raw.strip():
                return
            top = open_.top
            inner = open_.stack[top.block_at] if top.block_at >= 0 else _NONE
            open_block = Block(inner.number, inner.tag, top.high + top.low)
            blocks.append(open_block)
        open_block.parts.append(raw)
        if open_.links:
            open_block.linked += len(raw.strip())

    while at < length:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_.last(tag)
            if depth >= 0 and not (tag in _INLINE and open_.top.block_at > depth):
                open_.close_from(depth)
            if tag not in _INLINE:
                open_block = None
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/") or tag in _TEXT_ONLY:
                close = None if tag in never_closed else re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                if close:
                    at = close.end()
                else:
                    never_closed.add(tag)
                    # what is no markup runs to the end of the page; other elements do no harm if they stay open
                    at = length if tag in _TEXT_ONLY else at
            if tag not in ("script", "style", "template", "noscript"):
                open_block = None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            open_block = None
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of their kind
                open_.close_same(tag)
        if tag in _VOID:
            continue
        number += 1
        open_.push(tag, number, *element_sign(tag, m[3], open_.top.in_main))
    for b in blocks:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        b.parts = []
    return [b for b in blocks if b.text]


def cost_of(block: Block) -> float:
    """Log-odds that a block is main text."""
    n = len(block.text)
    odds = START + block.sign + LONG_TEXT * min(n, 160) / 160 + LINKS * min(1.0, block.linked / n)
    odds += CLAUSES * min(3, len(_CLAUSE.findall(block.text))) / 3
    return odds + (HEADING if block.tag in ("h1", "h2", "h3") else 0.0)


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut: those of positive gain hang on it, the others on the sink.

    Shortest augmenting paths with blocking flows; the graph of a page is small and nearly a chain.
    """
    n = len(gains)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gains):
        if g > 0:
            link(source, i, g, 0.0)
        elif g < 0:
            link(i, sink, -g, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nexts[a] < len(heads[a]):
                e = heads[a][nexts[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            if nexts[a] < len(heads[a]):
                path.append(heads[a][nexts[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nexts[a] += 1
            else:
                break


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between successive blocks of one parent."""
    edges = [(i, i + 1, NEIGHBOUR) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    kept = minimum_cut([cost_of(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_text(pages: DataFrame, text: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points) for each row of ``pages``.

    A page is cut into blocks; a linear classifier over the elements around a block, its links, length and punctuation
    gives the cost of either label, neighbours in the page and in the tree are tied together, and the minimum cut is
    the labelling of least total cost.  Whole pages are read, whatever their length; nothing is dropped but blocks
    labelled boilerplate.  Null or empty pages, and pages without main text, give an empty text.  Null keys, repeated
    rows and empty tables pass through; further columns are ignored.
    """
    fields = pages.select(*keep).limit(0).toArrow().schema
    schema = f"{pages.select(*keep).schema.simpleString()[7:-1]}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64):
                found = [main_text(h) for h in rows["html"]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(rows[f.name], f.type) for f in fields), pa.array(found, pa.string()),
                     pa.array([len(t) for t in found], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, whole(text).alias("html")).mapInArrow(run, schema)
