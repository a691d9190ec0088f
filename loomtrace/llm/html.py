"""Main text of web pages by minimum cut.

A page is read into blocks of text. A linear classifier rates each block as content or boilerplate from its place in
the document (elements, class and id hints), its links and its text; the rating becomes the capacity of an arc from the
source (content) or to the sink (boilerplate). Blocks next to each other on the page, and blocks of one parent element,
are joined by smoothness arcs that weaken with their distance in the tree. The minimum cut, found by maximum flow, parts
content from boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
UNSEEN = {"head", "template", "svg", "math", "object", "select", "datalist", "noscript", "canvas", "audio", "video", "button", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "body", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "tr", "ul"}
OWN_KIND = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
CONTENT = {"article", "main"}
BOILERPLATE = {"nav", "aside", "form", "menu", "fieldset"}
FRAME = {"header", "footer"}

# Words of class, id and role names.
BAD_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "hidden", "legal", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "recommended", "related", "remark", "remarks", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget"}
#: A name that is part of a longer one says nothing of its element after one of these words, or before one of those.
OF_OTHERS = {"category", "format", "has", "have", "no", "non", "not", "status", "tag", "type", "with", "without"}
STATES = {"allowed", "closed", "disabled", "enabled", "open"}
GOOD_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}

# Weights of the classifier, and of smoothness.
PLAIN = -0.6
IN_CONTENT = 4.0
IN_BOILERPLATE = -7.0
IN_FRAME = -6.0
BAD_NAME = -7.0
GOOD_NAME = 1.5
PARAGRAPH = 0.6
HEADING = 0.4
LINKS = -3.0
NOTICE = -3.0
LENGTH = 0.25
SENTENCE = 0.5
SMOOTH = 1.2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADED = re.compile(r"(?:(?!</?article\b).)*?<h1\b", re.I | re.S)
#: Elements whose names tell of the whole page.
_WHOLE = {"html", "body"}
_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookie", re.I)
_END = re.compile(r"[.!?…。]['\")\]]*\s*$")


@dataclass
class Block:
    text: str
    rating: float
    #: Depth of the block's element, and the least depth between it and the block before.
    depth: int
    above: int
    parent: int


def _names(value: str) -> set[str]:
    """Words of class, id and role names, without those that tell of something else: ``no-sidebar``, ``comments-open``."""
    out: set[str] = set()
    for name in value.split():
        ws = [w.lower() for w in _NAME.findall(name)]
        if len(ws) > 1 and ws[-1] in STATES:
            continue
        other = next((i for i, w in enumerate(ws) if w in OF_OTHERS), len(ws))
        out.update(ws[:other])
    return out


def _hints(attributes: str) -> float:
    """What the names in a tag say of its content."""
    total = 0.0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return BAD_NAME
        if name in ("class", "id", "role", "itemprop"):
            names = _names(value)
            if names & BAD_NAMES:
                return BAD_NAME
            if names & GOOD_NAMES:
                total = GOOD_NAME
    return total


def _rating(text: str, linked: int, where: float, tag: str) -> float:
    out = PLAIN + where + LINKS * min(1.0, linked / len(text))
    out += HEADING if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else PARAGRAPH if tag in ("p", "pre", "blockquote") else 0.0
    out += LENGTH * min(4.0, len(text) / 60)
    if _END.search(text):
        out += SENTENCE
    if len(text) < 300 and _NOTICE.search(text):
        out += NOTICE
    return out


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page, in page order. Broken markup is read as browsers do: unclosed elements run on."""
    out: list[Block] = []
    # Open elements: tag, rating of the place, whether in content, links, unseen, serial number.
    stack: list[tuple[str, float, bool, bool, bool, int]] = [("", 0.0, False, False, False, 0)]
    opened: dict[str, int] = {}
    serial, shallow = 0, 0
    pieces: list[str] = []
    linked = 0
    holder: tuple[str, float, int, int] | None = None

    def flush() -> None:
        nonlocal linked, shallow, holder
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and holder:
                tag, where, depth, parent = holder
                out.append(Block(text, _rating(text, linked, where, tag), depth, min(shallow, depth), parent))
                shallow = len(stack)
            pieces.clear()
        linked, holder = 0, None

    def say(raw: str) -> None:
        nonlocal linked, holder
        if not raw or stack[-1][4]:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if holder is None and text.strip():
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            holder = (stack[k][0], stack[-1][1], k, stack[max(k - 1, 0)][5] if stack[k][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else stack[k][5])
        pieces.append(text)
        if stack[-1][3]:
            linked += len(text.strip())

    def close(tag: str) -> None:
        nonlocal shallow
        if opened.get(tag):
            while True:
                t = stack.pop()[0]
                opened[t] -= 1
                if t == tag:
                    break
            shallow = min(shallow, len(stack))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            if tag == "br":
                pieces.append(" ")
            else:
                flush()
        if m[1]:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ENDS_P and opened.get("p"):
            close("p")
        if (own := OWN_KIND.get(tag)) and opened.get(own) and tag not in ("li", "tr", "td", "th") or tag == "li" and stack[-1][0] == "li":
            close(tag)
        _, where, content, links, unseen, _ = stack[-1]
        hint = _hints(m[3]) if m[3] and not m[3].isspace() and tag not in _WHOLE else 0.0
        # Names around a page's only main part, or around an article with the page's heading, tell of other parts.
        if tag == "main" or tag == "article" and _HEADED.match(page, at):
            where = max(where, 0.0)
        if tag in CONTENT:
            where, content = where + (0 if content else IN_CONTENT), True
        elif tag in BOILERPLATE:
            where += IN_BOILERPLATE
        elif tag in FRAME and not content:
            where += IN_FRAME
        elif tag == "footer":
            where += IN_FRAME
        serial += 1
        if hint < 0 or hint and not content:
            where += hint
        stack.append((tag, max(where, -12.0), content, links or tag == "a", unseen or tag in UNSEEN, serial))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


class Flow:
    """Maximum flow by level graphs, on integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (there, back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in self.out[v]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """Which nodes are on the source's side of the minimum cut nearest to the source."""
        to, room, out = self.to, self.room, self.out
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            following = [0] * len(out)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if not room[e])
                    v = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while following[v] < len(out[v]):
                    e = out[v][following[v]]
                    if room[e] and level[to[e]] == level[v] + 1:
                        break
                    following[v] += 1
                else:
                    if not path:
                        break
                    v = to[path.pop() ^ 1]
                    following[v] += 1
                    continue
                path.append(e)
                v = to[e]


def label(found: list[Block]) -> list[bool]:
    """Which blocks are content, by minimum cut."""
    n = len(found)
    if not n:
        return []
    flow = Flow(n + 2)
    source, sink = n, n + 1
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        c = round(100 * b.rating)
        if c > 0:
            flow.arc(source, i, c)
        elif c < 0:
            flow.arc(i, sink, -c)
        if i:
            apart = found[i - 1].depth + b.depth - 2 * min(b.above, found[i - 1].depth)
            w = round(100 * SMOOTH / (2 + max(0, apart)))
            flow.arc(i - 1, i, w, w)
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            w = round(50 * SMOOTH / (1 + i - before))
            flow.arc(before, i, w, w)
        last[b.parent] = i
    return flow.cut(source, sink)[:n]


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty and text-less pages."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``text_col``.

    Any column may be null and rows may repeat; a null page has an empty text; an empty table gives no rows. A column
    named ``text_col`` is replaced.
    """

    @F.pandas_udf("string")
    def texts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in it:
            yield pd.Series([main_text(p) for p in pages_], dtype="object")

    return pages.withColumn(text_col, texts(html_col))
