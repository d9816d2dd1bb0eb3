"""Main-text extraction from HTML by minimum-cut labelling.

A page is read into text blocks (what lies between block-level tags). A linear
classifier gives each block a cost for being content and one for being boilerplate,
from the elements, roles and class names around it, its length, links and
punctuation. A class name counts by its place in the name, and the frame of the page by
nothing (``name_signs``, ``settle``). The costs become capacities: source to block what it costs to call it
boilerplate, block to sink what it costs to call it content. Smoothness edges join
neighbouring blocks and blocks of one parent, weaker the further apart in the DOM.
The minimum cut (max-flow, Dinic) parts content from boilerplate at the least total
cost, so that a doubtful block follows the blocks around it. There are no labelled
pages to learn from: the classifier's weights are fixed values, stated below.

Text: character references are decoded, white space within a block is one blank,
blocks are joined in page order by an empty line. Scripts, styles, comments, hidden
elements and the head give no blocks. A line break tag is white space. Inline elements
that are hidden or called adverts are left out of their block.

Defined cases: NULL or empty html has the empty text; a page without blocks or with
no content has the empty text; broken markup is read as far as it goes, an unclosed
tag at the end is dropped; repeated rows are read each; NULL page_id and url are
kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Elements of HTML.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "math",
       "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del",
          "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr"}
#: An element that a new one of the same kind closes.
SAME_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
               "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
               "option": {"option"}}
#: Elements beyond which such closing does not reach.
FENCES = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "aside", "nav",
          "header", "footer", "form", "main", "blockquote"}
# Signs of content and of boilerplate.
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "label", "dialog",
               "fieldset", "legend", "option"}
CONTENT_TAGS = {"article", "main"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog",
                "alert", "alertdialog", "menu", "menubar", "form"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot",
    "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside",
    "footer", "footnav", "share", "sharing", "social", "related", "recommended", "teaser",
    "widget", "search", "comment", "comments", "commentlist", "disqus", "replies", "reply",
    "pagination", "pager", "copyright", "toolbar", "masthead", "skip", "hidden", "alert",
    "warning", "disclaimer", "outbrain", "taboola", "adsbygoogle",
}
HEADER_WORDS = {"header", "head", "top", "topbar"}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
#: What an inline element must be called for its text to be no part of its block.
ADVERT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "adbox", "adslot", "sponsor",
                "sponsored", "promo", "share", "sharing"}
#: Last parts of a compound name that say nothing: its first part names the element.
CONTAINER_WORDS = {
    "area", "articles", "bar", "block", "body", "box", "btn", "button", "buttons", "col",
    "column", "container", "content", "footer", "form", "group", "header", "icons", "inner",
    "item", "items", "label", "left", "link", "links", "list", "outer", "panel", "posts",
    "right", "row", "section", "slot", "stories", "text", "title", "unit", "wrap", "wrapper",
}
#: First parts that make a compound name a statement about the page or a state.
STATE_WORDS = {"no", "not", "without", "has", "have", "with", "is", "hide", "show"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "td",
             "dd", "dt", "li"}
# The classifier's weights (log odds) and the smoothness.
W_SIGN = 6.0
W_HINT = 2.0
W_CONTENT_TAG = 4.0
W_CONTENT_WORD = 1.5
W_TEXT_TAG = 1.0
W_LENGTH, LENGTH, MAX_LENGTH = 1.0, 80.0, 2.5
W_SENTENCE = 0.7
W_LINKS = 4.0
W_SHORT, SHORT = 1.2, 30
W_PRIOR = 0.8
W_RIGHTS = 1.5
S_NEXT = 0.3
S_PARENT = 1.2
#: An element around the page's largest article or this share of its text is its frame.
FRAME, FRAME_ALONE = 0.5, 0.9

# Tags as HTML reads them: an unquoted value runs to white space or ">", whatever quotes it
# holds; a quote without its end opens no value. A "<" inside makes it no tag.
_ATTRS = r"(?:[\s/]+|[^\s/<>][^\s/<>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>]++))?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/<>]*+)(" + _ATTRS + r")>"
    r"|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<[!?/][^<>]*+>|<[a-zA-Z/!?][^<]*+\Z", re.S)
_ATTR = re.compile(r"([^\s/<>][^\s/<>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s<>]++)))?+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def name_signs(value: str) -> tuple[float, bool, bool, bool]:
    """What the names in a class or id say: boilerplate (0, ``W_HINT`` or ``W_SIGN``),
    content, header, advert. A name counts by its last part, or by its first where the
    last is a mere container; a word elsewhere in it is a hint."""
    sign, content, header, advert = 0.0, False, False, False
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name) if len(p) > 1]
        if not parts or parts[0] in STATE_WORDS and len(parts) > 1:
            continue
        first, last, whole = parts[0], parts[-1], "".join(parts)
        if whole in BOILER_WORDS or whole in HEADER_WORDS:  # "side-bar" is "sidebar"
            first = last = whole
        if len(parts) > 1 and first in BOILER_WORDS and last in CONTAINER_WORDS:
            last = first
        if last in BOILER_WORDS:
            sign = W_SIGN
            advert = advert or last in ADVERT_WORDS
        elif not BOILER_WORDS.isdisjoint(parts):
            sign = max(sign, W_HINT)
        elif not CONTENT_WORDS.isdisjoint(parts):
            content = True
        elif last in HEADER_WORDS or first in HEADER_WORDS and last in CONTAINER_WORDS:
            header = True
    return sign, content, header, advert


class Node:
    """An element: its own signs, and after ``settle`` those it stands under."""

    __slots__ = ("tag", "depth", "parent", "link", "sign", "landmark", "word", "header",
                 "unseen", "size", "framed", "boiler", "content")

    def __init__(self, tag: str, parent: "Node | None", attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.sign = W_SIGN if tag in BOILER_TAGS else 0.0
        self.landmark = tag in CONTENT_TAGS
        self.header = tag == "header"
        self.word = False
        self.unseen = bool(parent and parent.unseen)
        self.size, self.framed = 0, False
        self.boiler, self.content = 0.0, False
        if attrs and not attrs.isspace() and tag not in ("html", "body"):
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        hidden = advert = False
        named = header = False
        for name, x, y, z in _ATTR.findall(attrs):
            name, value = name.lower(), x or y or z
            if "&" in value:
                value = htmllib.unescape(value)
            if name in ("class", "id"):
                if self.tag == "a":
                    continue
                sign, word, head, ad = name_signs(value)
                self.sign = max(self.sign, sign)
                named, header, advert = named or word, header or head, advert or ad
            elif name == "role":
                value = value.strip().lower()
                if value in BOILER_ROLES:
                    self.sign = W_SIGN
                elif value in ("main", "article"):
                    self.landmark = True
            elif name == "hidden":
                hidden = value.lower() != "until-found"
            elif name == "aria-hidden":
                if value.strip().lower() == "true" and self.tag not in INLINE:
                    self.sign = W_SIGN
            elif name == "style" and _UNSEEN.search(value.lower()):
                hidden = True
        self.word = named and self.sign < W_SIGN
        self.header = self.header or header and not named
        if self.tag in INLINE:  # its text is left out of the block it stands in
            self.unseen = self.unseen or hidden or advert
        elif hidden:
            self.sign = W_SIGN


class Block:
    __slots__ = ("text", "node", "links")

    def __init__(self, text: str, node: Node, links: int):
        self.text, self.node, self.links = text, node, links


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    root = Node("", None, "")
    stack = [root]
    nodes = [root]
    parts: list[str] = []
    links = 0
    in_head = False
    holder = root  # the block-level element of the open block

    def text(raw: str) -> None:
        nonlocal links, holder
        if in_head or not raw or stack[-1].unseen:
            return
        s = htmllib.unescape(raw) if "&" in raw else raw
        if not parts and s.isspace():
            return
        if not parts:
            holder = next(n for n in reversed(stack) if n.tag not in INLINE)
        if stack[-1].link:
            links += len(s)
        parts.append(s)

    def close_block() -> None:
        nonlocal links
        if parts:
            s = " ".join("".join(parts).split())
            if s:
                out.append(Block(s, holder, links))
                holder.size += len(s)
            parts.clear()
            links = 0

    def pop_to(tags: set[str], fences: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        tag, end = m[1], m[3]
        if tag:
            tag = tag.lower()
            attrs = m[2]
            if tag == "head":
                in_head = True
            elif in_head and tag not in RAW and tag not in VOID:
                in_head = False
            if tag in RAW:
                # Raw text ends at its own end tag only.
                stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
                if stop is None:
                    if tag in ("script", "style", "textarea", "title"):
                        break
                    continue
                close = html.find(">", stop.start())
                at = n if close < 0 else close + 1
                continue
            if tag == "br":
                text(" ")
                continue
            if tag not in INLINE:
                close_block()
                if tag in SAME_CLOSES:
                    pop_to(SAME_CLOSES[tag], FENCES - {tag})
                elif stack[-1].tag not in ("", "html", "body"):
                    pop_to({"p"}, FENCES)
            if tag not in VOID and not attrs.endswith("/"):
                stack.append(Node(tag, stack[-1], attrs))
                nodes.append(stack[-1])
        elif end:
            end = end.lower()
            if end == "head":
                in_head = False
            if end not in INLINE:
                close_block()
            pop_to({end}, set() if end not in INLINE else FENCES)
    close_block()
    settle(nodes)
    return out


def settle(nodes: list[Node]) -> None:
    """What each element stands under, from the outermost inwards; ``nodes`` in page order.

    A sign of boilerplate ends what content elements around it say, and content elements
    below it say nothing. The frame of the page, that is an element around its largest
    article and half its text or around nine tenths of its text, is no boilerplate itself,
    whatever it is called. A header inside content holds a headline."""
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
    total = nodes[0].size
    marks = ([n for n in nodes if n.landmark and n.sign < W_SIGN and n.size]
             or [n for n in nodes if n.tag == "h1" and n.sign < W_SIGN and n.size])
    top = node = max(marks, key=lambda n: n.size, default=None)
    while node is not None:
        node.framed = node is not top and node.size >= FRAME * total
        node = node.parent
    for node in nodes[1:]:
        up = node.parent
        node.boiler, node.content = up.boiler, up.content
        node.word = node.word or up.word
        framed = node.framed or not marks and node.size >= FRAME_ALONE * total
        sign = node.sign
        if node.header and not node.content and not node.landmark:
            sign = W_SIGN
        if sign and not framed:
            node.boiler = min(W_SIGN, node.boiler + sign)
        if node.boiler >= W_SIGN:
            node.content = node.word = False
        elif node.landmark:
            node.content = True


def costs(b: Block) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and content."""
    node, s = b.node, b.text
    keep = min(MAX_LENGTH, W_LENGTH * len(s) / LENGTH)
    drop = W_PRIOR
    if node.content:
        keep += W_CONTENT_TAG
    if node.word:
        keep += W_CONTENT_WORD
    heading = len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit()
    if node.tag in TEXT_TAGS:
        keep += W_TEXT_TAG
    if s[-1] in ".!?…:\"”»":
        keep += W_SENTENCE
    drop += node.boiler
    drop += W_LINKS * min(1.0, b.links / len(s))
    if len(s) < SHORT and not heading:
        drop += W_SHORT
    if "©" in s or "all rights reserved" in s.lower():
        drop += W_RIGHTS
    return keep, drop


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements over their lowest common ancestor."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next one, and with the next of its parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        parent = b.node.parent or b.node
        j = last.get(id(parent))
        if i:
            near = S_PARENT / (1 + _distance(page[i - 1].node, b.node))
            out.append((i - 1, i, S_NEXT + near))
        if j is not None and j != i - 1:
            out.append((j, i, S_PARENT / (1 + _distance(page[j].node, b.node))))
        last[id(parent)] = i
    return out


def min_cut(keep: list[float], drop: list[float],
            smooth: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks lie on the source's side of a minimum cut (Dinic). Blocks that
    the flow leaves undecided go to the sink's side."""
    n = len(keep)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):  # the part that flows straight through is already cut
        through = keep[i] - drop[i]
        if through > 0:
            edge(s, i, through, 0.0)
        elif through < 0:
            edge(i, t, -through, 0.0)
    for a, b, c in smooth:
        edge(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(head[u]):
                e = head[u][at[u]]
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def label(html: str | None) -> tuple[list[Block], list[bool], int]:
    """The blocks of a page, which of them the minimum cut calls content, and how many of
    these labels differ from what each block's own costs say."""
    page = blocks(html or "")
    if not page:
        return [], [], 0
    keep, drop = zip(*(costs(b) for b in page))
    chosen = min_cut(list(keep), list(drop), edges(page))
    return page, chosen, sum(c != (k > d) for c, k, d in zip(chosen, keep, drop))


def main_text(html: str | None) -> str:
    page, chosen, _ = label(html)
    return "\n\n".join(b.text for b, c in zip(page, chosen) if c)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.slices(batches, "html"):
        texts, n_blocks, n_turned = [], [], []
        for h in b.column("html").to_pylist():
            page, chosen, turned = label(h)
            texts.append("\n\n".join(p.text for p, c in zip(page, chosen) if c))
            n_blocks.append(len(page))
            n_turned.append(turned)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array(n_blocks, pa.int64()), pa.array(n_turned, pa.int64())],
            names=["page_id", "url", "text", "n_blocks", "n_turned"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, and how many blocks it has
    (n_blocks) and how many of their labels the cut turned (n_turned)."""
    C.text_session(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_blocks long, n_turned long")
            .withColumn("n_chars", F.length("text").cast("long")))


def op8(spark, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
