"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, with character references decoded and white
space made one space. A linear classifier gives each block its log-odds of being main text (from its length, link
share, tags, and the names of the elements around it); these become the capacities to the source
(text) or the sink (boilerplate). Edges carry smoothness: between neighbours in page order, and between near
siblings of one parent element (DOM proximity), so a short paragraph among long ones stays and a long sentence in a
menu goes; the further up their common ancestor, the weaker. The minimum cut labels the blocks; it is found by maximum flow. Nodes whose terminal capacity exceeds the
sum of their edges have the same label in every minimum cut; they are fixed first, which leaves few nodes to the flow.

Scripts, styles and comments of the mark-up are no text. Pages are parsed in Arrow batches, each page
on its own, in time linear in its length.

Defined cases: a null or empty page, or one without main text, has an empty text; broken mark-up is
read as far as it goes; an empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")    # in order, so that no value is read as a name
SPACE = re.compile("[\x20\x09-\x0d]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values: elements of HTML by their use
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "title", "textarea", "select", "option", "head", "canvas", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
BAD_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
             "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav",
             "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "recommended", "related",
             "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
             "toolbar", "widget"}
GOOD_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}

SAME_PARENT, NEIGHBOUR, SIBLING = 1.2, 0.4, 0.6
LEVELS = 4           # steps up to a common ancestor that count
NEAR = 2             # sibling edges of a block to earlier ones


class Element:
    __slots__ = ("tag", "aside", "main", "number", "good", "parent")

    def __init__(self, tag, parent, attrs, number):
        self.tag, self.number, self.parent = tag, number, parent
        self.aside = parent.aside if parent else False
        self.main = parent.main if parent else False
        self.good = parent.good if parent else False
        if tag in ASIDE or (tag == "header" and not self.main):
            self.aside = True
        if tag in MAIN:
            self.main = True
        if attrs:
            for name, value in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    names = {x.lower() for x in NAME.findall(value)}
                    if tag != "body" and names & BAD_NAMES and not (names & GOOD_NAMES and tag in MAIN):
                        self.aside = True
                    self.good |= bool(names & GOOD_NAMES)
                elif name == "role":
                    self.aside |= value.lower() in BAD_ROLES
                    self.main |= value.lower() in MAIN
                elif (name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
                      or (name == "style" and "display:none" in value.replace(" ", "").lower())):
                    self.aside = True


class Block:
    __slots__ = ("text", "element", "tag", "links")

    def __init__(self, text, element, tag, links):
        self.text, self.element, self.tag, self.links = text, element, tag, links


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in page order."""
    out: list[Block] = []
    number = 0
    stack = [Element("html", None, "", 0)]
    piece: list[str] = []
    links = depth = at = 0
    n = len(html)

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            t = unescape(raw) if "&" in raw else raw
            piece.append(t)
            if depth:
                links += len(t)

    def close() -> None:
        nonlocal links, piece
        if piece:
            t = SPACE.sub(" ", "".join(piece)).strip(" ")
            if t:
                out.append(Block(t, stack[-1], stack[-1].tag, min(1.0, links / len(t))))
            piece = []
        links = 0

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at: m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag not in INLINE and tag not in VOID:
                close()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
        elif tag in RAW and not m[3].rstrip().endswith("/"):
            if tag != "head":      # what stands in it is handled by its own elements
                if tag not in ("noscript", "option"):
                    close()
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
        elif tag == "a":
            depth += 1
        elif tag == "br" or tag == "hr":
            close()
        elif tag not in INLINE and tag not in VOID:
            close()
            depth = 0
            if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                stack.pop()
            number += 1
            stack.append(Element(tag, stack[-1], m[3], number))
            if m[3].rstrip().endswith("/") and tag not in ("p", "div"):
                stack.pop()
    close()
    return out


def log_odds(b: Block, has_main: bool) -> float:
    """Classifier: above 0 speaks for main text."""
    e, t = b.element, b.text
    x = -1.0 + 2.5 * min(1.0, len(t) / 200) - 4.0 * b.links
    if e.main:
        x += 4.0
    elif has_main:
        x -= 4.0
    elif e.good:
        x += 1.0
    if e.aside:
        x -= 12.0
    if b.tag in ("p", "blockquote", "pre"):
        x += 1.0
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        x += 0.8
    elif b.tag in ("li", "td", "th"):
        x -= 0.3
    if t[-1] in ".!?:;\"'”…":
        x += 0.5
    if "©" in t or "All rights reserved" in t:
        x -= 3.0
    return x


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbours in page order and near siblings of one parent, weaker by the steps up to the
    common ancestor."""
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple, list[tuple[int, int]]] = {}
    before: dict[int, int] = {}
    for i, b in enumerate(blocks):
        key = (b.element.aside, b.element.main)
        levels: dict[int, int] = {}
        e = b.element
        while e is not None and len(levels) <= LEVELS:
            levels[e.number] = len(levels)
            e = e.parent
        if i and key == (blocks[i - 1].element.aside, blocks[i - 1].element.main):
            steps = min((max(k, before[x]) for x, k in levels.items() if x in before), default=LEVELS + 1)
            out[i - 1, i] = SAME_PARENT if steps <= 1 else NEIGHBOUR * 2 / steps
        found: dict[int, int] = {}
        for x, k in levels.items():
            near = last.setdefault((x, *key), [])
            for j, level in near[-NEAR - 1:]:
                if j < i - 1:
                    found[j] = min(found.get(j, LEVELS), max(1, k, level))
            near.append((i, k))
        for j, steps in sorted(found.items(), key=lambda f: (f[1], -f[0]))[:NEAR]:
            out[j, i] = SIBLING / steps
        before = levels
    return out


def min_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: source side) that minimise sum of |unary| against the sign plus weights of cut edges."""
    n = len(unary)
    u = list(unary)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:                       # fixed in every minimum cut
        i = todo.popleft()
        if label[i] is None and abs(u[i]) > sum(around[i].values()):
            label[i] = u[i] > 0
            for j, w in around[i].items():
                del around[j][i]
                u[j] += w if label[i] else -w
                todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source = _max_flow(rest, u, around)
        for i in rest:
            label[i] = i in source
    return [bool(x) for x in label]


def _max_flow(rest: list[int], u: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {s: {}, t: {}}
    for i in rest:
        cap[i] = dict(around[i])
    for i in rest:
        if u[i] > 0:
            cap[s][i], cap[i][s] = u[i], 0.0
        elif u[i] < 0:
            cap[i][t], cap[t][i] = -u[i], 0.0
    while True:
        came, todo = {s: s}, deque([s])
        while todo and t not in came:
            i = todo.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    todo.append(j)
        if t not in came:
            return set(came) - {s}
        path, j = [], t
        while j != s:
            path.append((came[j], j))
            j = came[j]
        flow = min(cap[i][j] for i, j in path)
        for i, j in path:
            cap[i][j] -= flow
            cap[j][i] += flow


def main_text(html: str | None) -> str:
    """Main text of one page."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    has_main = any(b.element.main and not b.element.aside for b in blocks)
    keep = min_cut([log_odds(b, has_main) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", carry: list[Column] | None = None) -> DataFrame:
    """One row per page: the carried columns and ``text``."""
    t = pages.select(*(carry or []), col(html_col).alias("_html"))
    names = t.columns[:-1]

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    return t.mapInArrow(run, t.select(names).schema.add("text", "string")).withColumn("text", F.col("text"))
