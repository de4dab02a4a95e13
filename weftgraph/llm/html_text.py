"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks. A linear classifier's odds that a block is content become
its terminal capacities: the cost of calling it boilerplate goes to the source's edge, the
cost of calling it content to the sink's. Smoothness edges join neighbouring blocks and
blocks of one parent, by what lies between them in the DOM. The blocks on the source's side
of a minimum cut are the main text. The classifier's weights and the edges' are fitted to
the labelled layouts of `html_layouts`, see `fit`.

What an element is called (nav, article, class, id, role) is evidence, not a veto: the
nearest such element counts most. One that speaks against content is passed over if it is
the page's frame by what it holds: nearly all prose there is, and an article's landmark or
heading, like a form around a whole page or a menu that is never closed. A sidebar, a notice
or a footer that is alone on its page is none, and leaves it without a text.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_layouts import Page

# HTML's elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: What stands in these isn't markup, and not shown; the first ones reach to the page's end if they aren't closed.
RAW_TO_END = frozenset("script style title textarea".split())
RAW = RAW_TO_END | frozenset("noscript template iframe noembed noframes annotation annotation-xml".split())
#: Elements that hold something else than the article.
FRAME = frozenset("nav aside footer form menu dialog button select fieldset option optgroup datalist search".split())
#: Of these, those that no page wraps around its article by mistake.
NEVER_AROUND = frozenset("aside footer dialog button select option optgroup datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote dd figcaption".split())
ITEMS = frozenset("li td th dt caption summary".split())
#: A start tag of the key closes these, if they are open in the same list, table or paragraph.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = frozenset("ul ol menu dl table select div section article main aside nav header footer form body".split())

# Words in class, id and role that speak against a block, and for it.
AGAINST = frozenset(
    "ad ads adsense advert advertisement adverts advertorial alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright dialog disclaimer discussion disqus donate footer foot form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social "
    "popular trending reactions userposts usercomments readercomments sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo".split()
)
#: Speaks against a block outside articles only: an article has a header of its own.
HEAD = "header"
FOR = frozenset("article articlebody body content entry hentry main maincontent post postbody story text".split())

# A quote inside an attribute's name or an unquoted value is a letter like any other; one that opens a value and is never closed too.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>"""
)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++|=)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_COMMENT_END = re.compile(r"--!?>")
_READ = frozenset("class id role aria-hidden hidden style".split())
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I) for tag in RAW}

#: Evidence of elements: landmarks of the article, of the page's frame, names for and against content; OUTER is the weight of an outer element, or of one for content inside one against it.
ARTICLE, FRAMED, SPOKEN_FOR, SPOKEN_AGAINST, OUTER = 1.0, -2.0, 0.5, -2.5, 0.5
#: Words from which text outside paragraphs is called prose and prose may be an article, and the share of it that a frame must leave outside in order to count.
PROSE_WORDS, LEFT_OUTSIDE = 12, 0.1


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    linked: int  # characters in links
    words: int
    element: int  # number of the nearest element with evidence
    parent: int  # number of the block's element
    steps: int  # in the DOM from the block before
    evidence: float = 0.0

    @property
    def prose(self) -> bool:
        plain = 2 * self.linked < len(self.text)
        return plain and (self.tag in PARAGRAPHS or self.tag in HEADINGS or self.words >= PROSE_WORDS)


@dataclass(slots=True)
class _Element:
    """An element with evidence."""

    sign: float
    outer: int
    named: bool  # by class, id or role, not by its tag
    aside: bool  # a tag that never frames a page
    inside: bool  # of an article or main element
    first: int
    last: int = 1 << 60


@dataclass(slots=True)
class _Open:
    tag: str
    number: int
    element: int  # the nearest with evidence
    own: bool  # is it that one
    block_tag: str
    block_number: int
    depth: int  # in block elements
    inside: bool  # an article or main element
    link: bool


def _named(attributes: str, inside: bool) -> tuple[bool, bool]:
    """(against, for) by class, id, role and hiding attributes."""
    against = speaks = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _READ:
            continue
        value = value.strip("\"'")
        if name == "hidden":
            against = True
        elif name == "aria-hidden":
            against |= value.lower() == "true"
        elif name == "style":
            against |= "display:none" in value.replace(" ", "").lower()
        else:
            words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", value))} | {value.lower().replace("-", "").replace("_", "")}
            good = not words.isdisjoint(FOR)
            against |= not words.isdisjoint(AGAINST) or (HEAD in words and not inside and not good)
            speaks |= good
    return against, speaks and not against


def _sign(tag: str, attributes: str, inside: bool) -> tuple[float, bool]:
    """(evidence, is it by name) of an element; inside: of an article."""
    if tag in ("html", "body"):
        return 0.0, False
    against, speaks = _named(attributes, inside) if attributes else (False, False)
    if tag in FRAME or (tag == "header" and not inside):
        return FRAMED, False
    if against:
        return SPOKEN_AGAINST, True
    return ARTICLE * (tag in ("article", "main")) + SPOKEN_FOR * speaks, False


def blocks(page: str) -> list[Block]:
    """A page's text blocks in order, with their evidence. Tags that aren't closed end where HTML lets them."""
    out: list[Block] = []
    elements: list[_Element] = [_Element(0.0, 0, False, False, False, 0)]
    stack: list[_Open] = [_Open("", 0, 0, False, "", 0, 0, False, False)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = number = at = 0
    low, before = 0, 0  # least depth since the last block, and that block's depth

    def end_block() -> None:
        nonlocal linked, low, before
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            top = stack[-1]
            out.append(Block(text, top.block_tag, min(linked, len(text)), text.count(" ") + 1, top.element, top.block_number, before + top.depth - 2 * min(low, top.depth)))
            low = before = top.depth
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def pop_to(i: int) -> None:
        nonlocal low
        for o in stack[i:]:
            opened[o.tag] -= 1
            if o.own:
                elements[o.element].last = len(out)
        del stack[i:]
        low = min(low, stack[-1].depth)

    while found := _MARKUP.search(page, at):
        add(page[at : found.start()])
        start = found.start()
        kind = page[start + 1]
        tagged = _TAG.match(page, start)
        if not tagged:
            if page.startswith("<!--", start):  # <!--> and <!---> are whole comments
                shut = re.compile(r"-?>").match(page, start + 4) or _COMMENT_END.search(page, start + 4)
                at = shut.end() if shut else len(page)
            elif kind in "!?" or (kind == "/" and not page[start + 2 : start + 3].isalpha()):
                at = (page.find(">", start) + 1) or len(page)
            else:  # a tag that the page's end cuts off
                at = len(page)
            continue
        at = tagged.end()
        closing, tag, attributes = tagged.group(1), tagged.group(2).lower(), tagged.group(3)
        if tag in BLOCK:
            end_block()
        if closing:
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if stack[i].tag in SCOPE and tag not in SCOPE:
                        break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            if tag == "br":  # white space inside its block
                parts.append(" ")
            continue
        if tag in RAW:
            shut = _RAW_END[tag].search(page, at)
            at = shut.end() if shut else (len(page) if tag in RAW_TO_END else at)
            continue
        if tag in BLOCK and opened.get("p"):
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in CLOSES and any(opened.get(t) for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    pop_to(i)
                    if tag not in ("tbody", "tfoot", "tr"):
                        break
                elif stack[i].tag in SCOPE:
                    break
        number += 1
        top, block = stack[-1], tag in BLOCK
        inside = top.inside or tag in ("article", "main")
        sign, named = _sign(tag, attributes, inside) if block or attributes else (0.0, False)
        element = top.element
        if sign:
            element = len(elements)
            elements.append(_Element(sign, top.element, named, tag in NEVER_AROUND, top.inside, len(out)))
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(
            _Open(tag, number, element, bool(sign), tag if block else top.block_tag, number if block else top.block_number, top.depth + block, inside, top.link or tag == "a")
        )
    add(page[at:])
    end_block()
    _weigh(out, elements)
    _by_text(out)
    return out


#: Begins a row of links to share a page, and a line about rights.
_SHARE = re.compile(r"\W*(share|follow us|tweet|print|e-?mail this)\b", re.I)
_RIGHTS = re.compile(r"\W*(©|\(c\)\s*\d{4}|copyright\W+(©|\(c\)|\d{4}))", re.I)
SHORT = 8  # words


def _by_text(found: list[Block]) -> None:
    """What a short block itself says: an offer to share a page counts as links, a line about rights against content."""
    for b in found:
        if b.words <= SHORT and b.linked and _SHARE.match(b.text):
            b.linked = len(b.text)
        if b.words <= 2 * SHORT and _RIGHTS.match(b.text):
            b.evidence += FRAMED


def _weigh(found: list[Block], elements: list[_Element]) -> None:
    """Sets the blocks' evidence: that of the nearest element with some, and part of the outer ones'.

    An element against content is passed over if it holds most of the page's prose, next to
    none stands outside, and it is an article's frame: it holds one or lies in one, or has a
    page's heading, or, if only a form's or menu's tag speaks against it, any heading with prose.
    """

    def total() -> list[float]:
        value = [0.0] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            outer = value[e.outer]
            value[i] = outer + OUTER * e.sign if e.sign > 0 > outer else e.sign + OUTER * outer if e.sign else outer
        return value

    value = total()
    prose = np.array([b.words * b.prose for b in found])
    good = np.array([value[b.element] > 0 for b in found], dtype=bool)
    fair = np.array([value[b.element] >= 0 for b in found], dtype=bool)
    titles = [np.array([b.tag in tags for b in found], dtype=int) for tags in (("h1",), HEADINGS)]
    before = [np.concatenate([[0], np.cumsum(x)]) for x in (prose, prose * good, prose * fair, *titles)]
    landmarks = [i for i, e in enumerate(elements) if e.sign >= ARTICLE]
    passed = False
    for i, e in enumerate(elements):
        if e.sign < 0:
            last = min(e.last, len(found))
            held, held_good, held_fair, title, headings = (int(x[last] - x[e.first]) for x in before)
            outside_good, outside = int(before[1][-1]) - held_good, int(before[2][-1]) - held_fair
            inner = bisect.bisect_right(landmarks, i)
            article = inner < len(landmarks) and elements[landmarks[inner]].first < last
            frame = article or e.inside or title or (headings and not e.named and not e.aside)
            most = frame and 2 * held > before[0][-1] and not outside_good and (article or held >= PROSE_WORDS)
            if most and (outside == 0 if e.named and not article else outside <= LEFT_OUTSIDE * held):
                e.sign, passed = 0.0, True
    if passed:
        value = total()
    for b in found:
        b.evidence = value[b.element]


FEATURES = ("bias", "length", "sentence", "links", "paragraph", "heading", "item", "evidence")
# Weights of FEATURES, and of edges: inside one element with evidence to the block before, to a sibling further up, and across such elements.
# What fit() gives for html_layouts.pages().
WEIGHTS = (-2.71, 1.8, 1.98, -7.16, 1.51, 5.95, 4.7, 4.22)
NEIGHBOUR, SIBLING, ACROSS = 1.85, 0.05, 0.11


def features(block: Block) -> tuple[float, ...]:
    return (
        1.0,
        math.log1p(min(block.words, 60)),
        float(block.text[-1] in ".!?…:;\"”»" or ", " in block.text),
        block.linked / len(block.text),
        float(block.tag in PARAGRAPHS),
        float(block.tag in HEADINGS),
        float(block.tag in ITEMS),
        block.evidence,
    )


def odds(block: Block) -> float:
    """Logarithm of the odds that a block is content."""
    return sum(w * x for w, x in zip(WEIGHTS, features(block), strict=True))


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, the weaker the more steps lie between them in the DOM, and between a block and the one of its parent before it."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, (NEIGHBOUR if found[i - 1].element == b.element else ACROSS) / (1 + b.steps / 4)))
        before = last.get(b.parent)
        if before is not None and before < i - 1 and found[before].element == b.element:
            edges.append((before, i, SIBLING))
        last[b.parent] = i
    return edges


def fit(pages: list[Page]) -> tuple[tuple[float, ...], tuple[float, float, float]]:
    """WEIGHTS by ridge-penalised logistic regression, and the edges' by half the log odds that two joined blocks share a label."""
    rows, labels, same = [], [], {"neighbour": [1, 1], "sibling": [1, 1], "across": [1, 1]}
    for page in pages:
        content, found = set(page.content), blocks(page.html)
        label = [b.text in content for b in found]
        rows += [features(b) for b in found]
        labels += label
        for a, b, _ in smoothness(found):
            kind = "across" if found[a].element != found[b].element else "neighbour" if b == a + 1 else "sibling"
            same[kind][label[a] == label[b]] += 1
    x, y = np.array(rows), np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(len(w)), x.T @ (y - p) - w)
    edges = tuple(round(max(0.05, 0.5 * math.log(equal / other)), 2) for other, equal in same.values())
    return tuple(round(float(v), 2) for v in w), edges


def minimum_cut(values: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |value| of mislabelled nodes and of the cut edges' weights.

    A node whose value outweighs its edges keeps its own label in some minimum, and its
    edges then pull at the other ends; a maximum flow settles all other nodes.
    """
    n = len(values)
    joined: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        joined[a][b] = joined[a].get(b, 0.0) + w
        joined[b][a] = joined[b].get(a, 0.0) + w
    labels = [v > 0 for v in values]
    left = [i for i in range(n) if abs(values[i]) < sum(joined[i].values())]
    if left:
        open_nodes, value = set(left), list(values)
        for i in left:
            value[i] += sum(w if labels[j] else -w for j, w in joined[i].items() if j not in open_nodes)
        for i, side in zip(left, _source_side(left, value, joined), strict=True):
            labels[i] = side
    return labels


def _source_side(nodes: list[int], value: list[float], joined: list[dict[int, float]]) -> list[bool]:
    """Which of the nodes a maximum flow leaves on the source's side: blocking flows in level graphs."""
    place = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in nodes:
        if value[i] > 0:
            edge(source, place[i], value[i], 0.0)
        elif value[i] < 0:
            edge(place[i], sink, -value[i], 0.0)
        for j, w in joined[i].items():
            if i < j and j in place:
                edge(place[i], place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * len(out)
        path: list[int] = []  # edges from the source
        while True:
            a = to[path[-1]] if path else source
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                turn[to[path.pop() ^ 1]] += 1


def labelled(page: str) -> list[tuple[Block, bool]]:
    """A page's blocks, and whether each is content."""
    found = blocks(page)
    return list(zip(found, minimum_cut([odds(b) for b in found], smoothness(found)), strict=True))


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line feeds; empty if there are none."""
    return "\n".join([b.text for b, content in labelled(page) if content]) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have an empty text. Repeated rows are extracted each; an empty
    table gives no rows; other columns are ignored. Long pages are handled whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.iloc[first : first + 500]
                texts = [main_text(h) for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
