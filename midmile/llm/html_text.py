"""Main text of web pages by composite text density.

A page becomes a tree. Nodes that say by tag, class, id or role that they are no article
text are taken out, but not the one around the densest text that holds at least half of the
page's text, unless that is mostly links or the text is in an article elsewhere; of the rest, the density of every node is its characters per tag,
lowered by its share of links. The node whose children's densities sum highest is the core;
the least density on its way up to the body is the threshold for further parts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches

# Element names of HTML, by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # a start tag of the key ends an open element of the value
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
LIMITS = {  # where the search for an element to end stops
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
    "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"},
}

# What is no article text: by element, and by words of class, id or role.
NOISE_TAGS = RAW | frozenset("head nav footer aside form button select input label menu dialog object embed canvas audio video".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs footer sidebar complementary comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended widget widgets pagination pager toolbar skip search masthead contentinfo form".split()
)
HEADER_WORDS = frozenset("header topbar site-header".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Page:
    """The tree as lists by node number, parents before children; text in page order."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.end = ["#root"], [""], [-1], [0]
        self.text: list[tuple[int, str]] = []  # (node, text); an empty text ends a block
        self._read(source)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at:
                self.text.append((stack[-1], source[at:stop]))
            if not found:
                break
            at = found.end()
            if name := found["start"]:
                at = self._start(name.lower(), found["attrs"], stack, source, at)
            elif name := found["end"]:
                self._close(name.lower(), stack)

    def _start(self, tag: str, attrs: str, stack: list[int], source: str, at: int) -> int:
        if tag in ("html", "body") and any(self.tag[n] == tag for n in stack[1:3]):
            return at
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if self.tag[stack[depth]] == "p":
                    del stack[depth:]
                    break
                if self.tag[stack[depth]] in BLOCK:
                    break
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if self.tag[stack[depth]] in LIMITS[tag]:
                    break
                if self.tag[stack[depth]] in CLOSES[tag]:
                    del stack[depth:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in ("body", "article", "main") and self.tag[stack[-1]] == "head":
            stack.pop()
        node = self._open(tag, attrs, stack[-1])
        if tag in BLOCK or tag == "br":
            self.text.append((node, "" if tag in BLOCK else " "))
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            return close.end() if close else len(source)
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            stack.append(node)
        return at

    def _close(self, tag: str, stack: list[int]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] == tag:
                if tag in BLOCK:
                    self.text.append((stack[depth], ""))
                del stack[depth:]
                return
            if tag not in BLOCK and self.tag[stack[depth]] in BLOCK:
                return


def _says(attrs: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the node is hidden."""
    names, hidden = [], False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            hidden = True
    return " ".join(names).lower(), hidden


def _dropped(page: Page, chars: list[int]) -> list[bool]:
    """Nodes that are, or lie in, no article text."""
    tags, parents = page.tag, page.parent
    inside = [False] * len(tags)  # of an article or main part
    holds = [False] * len(tags)
    never = [False] * len(tags)  # shown as text
    words: list[frozenset[str]] = []
    for n, tag in enumerate(tags):
        names, hidden = _says(page.attrs[n]) if page.attrs[n] else ("", False)
        words.append(frozenset(_WORD.findall(names)))
        p = parents[n]
        inside[n] = tag in ("article", "main") or (p >= 0 and inside[p])
        never[n] = tag in NOISE_TAGS or hidden or (p >= 0 and never[p])
    for n in range(len(tags) - 1, 0, -1):
        if holds[n] or (tags[n] in ("article", "main") and not words[n] & NOISE_WORDS):
            holds[parents[n]] = True
    named = [False] * len(tags)
    for n in range(1, len(tags)):
        tag = tags[n]
        header = (tag == "header" or words[n] & HEADER_WORDS) and not inside[n]
        named[n] = not holds[n] and bool(header or (tag not in ("body", "html", "main") and words[n] & NOISE_WORDS))
    kept = _kept(page, chars, never, named, words) if any(named) else frozenset()
    gone = [False] * len(tags)
    for n in range(1, len(tags)):
        gone[n] = gone[parents[n]] or never[n] or (named[n] and n not in kept)
    return gone


def _kept(page: Page, chars: list[int], never: list[bool], named: list[bool], words: list[frozenset[str]]) -> frozenset[int]:
    """Named nodes around the densest text that hold at least half of the page's text, less than half of it links."""
    c, linked = chars[:], [0] * len(chars)
    for n in range(len(c) - 1, 0, -1):
        if never[n]:
            c[n] = 0
            continue
        if page.tag[n] == "a":
            linked[n] = c[n]
        c[page.parent[n]] += c[n]
        linked[page.parent[n]] += linked[n]
    large = {n for n in range(1, len(c)) if named[n] and c[n] and 2 * c[n] >= c[0] and 2 * linked[n] < c[n]}
    if not large or any(t in ("article", "main") and 10 * c[n] >= c[0] and not words[n] & NOISE_WORDS for n, t in enumerate(page.tag)):
        return frozenset()
    density, sums = _densities(page, chars, never)
    node, around = max(range(len(c)), key=lambda n: (sums[n], density[n], -n)), set()
    while node >= 0:
        around.add(node)
        node = page.parent[node]
    return frozenset(large & around)


def _densities(page: Page, chars: list[int], gone: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum of its children's."""
    n = len(page.tag)
    c, tags, linked, links = chars[:], [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        if page.tag[i] == "a":
            linked[i], links[i] = c[i], links[i] + 1
        p = page.parent[i]
        c[p] += c[i]
        tags[p] += tags[i] + 1
        linked[p] += linked[i]
        links[p] += links[i]
    share = linked[0] / c[0] if c[0] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i] or not c[i]:
            continue
        t, lc, lt, rest = max(tags[i], 1), max(linked[i], 1), max(links[i], 1), max(c[i] - linked[i], 1)
        base = math.log(c[i] / rest * linked[i] + share * c[i] + math.e)
        density[i] = c[i] / t * math.log(max(c[i] * t / (lc * lt), 1.0) + 1.0) / math.log(base + 1.0)
        if i:
            sums[page.parent[i]] += density[i]
    return density, sums


def _core(page: Page, chars: list[int], gone: list[bool]) -> int:
    """The node whose subtree is the article."""
    density, sums = _densities(page, chars, gone)
    n = len(page.tag)
    body = next((i for i, tag in enumerate(page.tag) if tag == "body" and not gone[i]), 0)
    best = max(range(n), key=lambda i: (sums[i], density[i], -i))
    if not sums[best]:
        return body
    threshold, node = density[best], best
    while node > 0 and node != body:
        node = page.parent[node]
        threshold = min(threshold, density[node])
    # further parts: nodes reached from the body through nodes that are dense enough, and their densest subtrees
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if not gone[i] and sums[top[i]] > sums[top[p]]:
            top[p] = top[i]
    reached, core = [False] * n, best
    for i in range(n):
        reached[i] = not gone[i] and density[i] >= threshold and (i in (0, body) or (page.parent[i] >= 0 and reached[page.parent[i]]))
        if reached[i] and i not in (0, body) and density[i] > 0:
            core = _meet(page, core, top[i] if sums[top[i]] else i)
    up = core
    while up > 0:
        if page.tag[up] in ("article", "main"):
            return up
        up = page.parent[up]
    return core


def _meet(page: Page, a: int, b: int) -> int:
    while a != b:  # parents have lower numbers
        if a > b:
            a = page.parent[a]
        else:
            b = page.parent[b]
    return a


def main_text(source: str) -> str:
    """Blocks of the main part, joined by blank lines; white space in a block is one space."""
    page = Page(source)
    chars = [0] * len(page.tag)
    text = [(n, entities.unescape(x) if "&" in x else x) for n, x in page.text]
    for n, x in text:
        if not x.isspace():
            chars[n] += len(x)
    gone = _dropped(page, chars)
    chars = [0 if g else k for g, k in zip(gone, chars, strict=True)]
    core = _core(page, chars, gone)
    part = [False] * len(page.tag)
    for n in range(len(page.tag)):
        part[n] = n == core or (n > core and part[page.parent[n]])
    blocks, open_block = [], []
    for n, x in text:
        if not part[n] or gone[n] or x:
            if part[n] and not gone[n]:
                open_block.append(x)
            elif gone[n] and not x and open_block:
                blocks.append(open_block)
                open_block = []
            continue
        blocks.append(open_block)
        open_block = []
    blocks.append(open_block)
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks if b)
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text``: the main text of each whole ``html``.

    Null and empty pages, and pages without text, give the empty text. Rows are treated one
    by one: repeated rows, ties and other columns stay; a column named ``text`` is replaced.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def to_text(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in column:
            yield batch.map(lambda x: main_text(x.decode("utf-8", "replace")))

    return pages.withColumn(text, to_text(F.coalesce(F.col(html).cast("binary"), F.lit(b""))))
