"""Main text of web pages by tag-path ratios.

A page is read once into elements and blocks of text. Every block has a path, the tags (with their
classes) from the root to it. Over each path the length of its texts outside links, their
punctuation and their number are summed; text per node and punctuation per node are the path's
ratios. Both are smoothed over the paths in page order, multiplied together, and the paths at or
above a share of the page's spread are content.

The nodes of the article are those under the article or main elements that hold content, or, where
a page has neither, under the smallest element that holds all of it. Inside, a path that isn't
content goes if its ratios are a menu's: several nodes, most of their text in links. Elements that
are never content by their tag go before, and so do those whose name says so (comments, adverts,
footers and the like); where a name only suggests it, the ratios decide. All other nodes stay.

Every step is linear in the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted, with_made

#: Elements that are never content, with all in them.
DROP = frozenset("script style noscript template nav footer aside select textarea iframe svg canvas object embed menu dialog head title button label legend fieldset datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"))
#: Elements that stand in a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp br img".split())
#: Words of an element's class, id or role: what isn't the article's, what may not be, and what tells of the page around instead.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu navbar nav navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter "
    "subscribe signup share sharing related recommended comment comments disqus reply replies respond responses pagination pager complementary contentinfo".split()
)
PERHAPS = frozenset("notice notices alert banner popup modal overlay toolbar widget toc search login header masthead popular trending social copyright".split())
AROUND = frozenset("has with no without layout wrapper container page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("p blockquote pre ul ol li table tbody tr td dl dd dt figure".split())
#: A new element closes these by itself.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.IGNORECASE) for t in RAW}
_SPACE = re.compile(r"\s+")
_SIGNS = re.compile(r"[.,;:!?…。、，！？·¿¡]")
#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
SMOOTH, SHARE, LINKS = (0.25, 0.5, 0.25), 0.5, 0.5


def tags(page: str):
    """(start, end, name, whether it is an end tag, attributes) of every tag; comments and declarations have no name.

    A tag that is never closed is text. Where an open quote hides all that follows, quotes count no more.
    """
    at, n, quotes = 0, len(page), True
    last = {c: page.rfind(c) for c in "\"'>"}
    while (a := page.find("<", at)) >= 0:
        if page.startswith("<!--", a):
            z = page.find("-->", a + 4) + 3
            at = z if z > 2 else n
            yield a, at, "", False, ""
            continue
        if a > last[">"]:
            return  # no tag ends any more
        m = _NAME.match(page, a + 2 if page.startswith("/", a + 1) else a + 1)
        if not m and page[a + 1] not in "!?":
            at = a + 1
            continue
        z = page.find(">", a)
        if m and quotes:
            e = m.end()
            while (s := _STOP.search(page, e)) and s[0] != ">":
                if s.end() > last[s[0]]:  # its other end is missing
                    s = _STOP.search(page, page.find(">", s.end())) if s.end() <= last[">"] else None
                    break
                e = page.find(s[0], s.end()) + 1
            quotes = s is not None
            z = s.start() if s else z
        at = z + 1
        yield a, at, m[0].lower() if m else "", m is not None and m.start() == a + 2, page[m.end() : z] if m else ""


@dataclass
class Page:
    """Elements in page order (element 0 is the page; those under i are i + 1 to end[i] - 1) and blocks of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    end: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    odd: list[int] = field(default_factory=lambda: [0])  # 2: no content by its name or tag, 1: perhaps
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, length of the text in links
    paths: int = 1


def _oddness(tag: str, attributes: str, outside: bool) -> tuple[int, str]:
    """What tag and names say of an element, and its class."""
    if not attributes:
        return 2 if tag in DROP or tag == "form" or (tag == "header" and outside) else 0, ""
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x), "") for m in _ATTRIBUTE.finditer(attributes)}
    style = found.get("class", "")
    if tag in DROP or tag == "form" or (tag == "header" and outside) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return 2, style
    if tag in ("html", "body", "article", "main") or tag in INLINE:
        return 0, style
    for name in f"{style} {found.get('id', '')} {found.get('role', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & NOT_CONTENT and not words & AROUND:
            return 2, style
        if words & PERHAPS and not words & AROUND:
            return 1, style
    return 0, style


def read(page: str) -> Page:
    """The page's elements and blocks. What isn't closed is closed with its parent; a paragraph ends where the next block begins."""
    out = Page()
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, element (of an inline one: the element around it), open blocks
    places: dict[str, list[int]] = {}  # of each open tag, its places in the stack
    steps: dict[tuple[int, str], int] = {}
    held: list[str] = []
    linked = block = held_in = 0
    link = 0  # the stack's height at the open link, or 0
    within = 0  # open article and main elements

    def flush() -> None:
        nonlocal linked
        if held:
            s = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if s:
                out.blocks.append((held_in, s, min(linked, len(s))))
            held.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked, held_in
        if s:
            if stack[-1][1] != held_in:
                flush()
                held_in = stack[-1][1]
            held.append(s)
            if link:
                linked += len(s.strip())

    def close(k: int) -> None:
        nonlocal link, within
        if any(t not in INLINE for t, _, _ in stack[k:]):
            flush()
        for t, e, _ in reversed(stack[k:]):
            places[t].pop()
            if t not in INLINE:
                out.end[e] = len(out.tag)
                within -= t in ("article", "main")
        del stack[k:]
        if link > len(stack):
            link = 0

    at = 0
    for a, z, tag, closes, attributes in tags(page):
        if a < at:
            continue
        text(page[at:a])
        at = z
        if not tag:
            continue
        if closes:
            if tag == "a":
                link = 0
            if places.get(tag):
                k = places[tag][-1]
                # an inline end tag doesn't close blocks around it
                if tag not in INLINE or stack[-1][2] == stack[k][2]:
                    close(k)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "img"):
                text(" ")
            elif tag != "wbr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                link = len(stack) if "href" in attributes else 0
            stack.append((tag, stack[-1][1], stack[-1][2]))
            places.setdefault(tag, []).append(len(stack) - 1)
            continue
        flush()
        # formatting doesn't go on in the next block; a link does
        open_link = link
        while stack[-1][0] in INLINE:
            close(len(stack) - 1)
        link = min(open_link, len(stack))
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        for t in _CLOSES.get(tag, ()):
            if stack[-1][0] == t:
                close(len(stack) - 1)
        odd, style = _oddness(tag, attributes, not within)
        if tag == "article" and places.get("article"):
            odd = 2  # an article in an article is a reader's comment or another page's teaser
        over, e = stack[-1][1], len(out.tag)
        path = steps.setdefault((out.path[over], f"{tag}.{style}"), out.paths)
        out.paths = max(out.paths, path + 1)
        for column, x in ((out.parent, over), (out.tag, tag), (out.end, 0), (out.path, path), (out.odd, odd)):
            column.append(x)
        within += tag in ("article", "main")
        stack.append((tag, e, stack[-1][2] + 1))
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
    text(_CUT_TAG.sub("", page[at:]))
    close(1)
    flush()
    out.end[0] = len(out.tag)
    return out


def _smooth(x: list[float]) -> list[float]:
    n = len(x)
    return [sum(w * x[min(max(k + d, 0), n - 1)] for d, w in zip((-1, 0, 1), SMOOTH, strict=True)) for k in range(n)]


def content_paths(parts: list[tuple[int, str, int]], share: float = SHARE) -> set[int]:
    """Of (path, text, length in links): paths whose fused ratios reach the threshold, smoothed and by themselves.

    The threshold is `share` times the fused ratios' standard deviation over the paths, at most the
    greatest. If no path reaches it by itself, those that do smoothed are content.
    """
    sums: dict[int, list[float]] = {}
    for path, s, linked in parts:
        t = sums.setdefault(path, [0, 0, 0])
        t[0] += len(s) - linked
        t[1] += len(_SIGNS.findall(s)) * (1 - linked / len(s))
        t[2] += 1
    if not sums:
        return set()
    length, signs = ([t[k] / t[2] for t in sums.values()] for k in (0, 1))
    fused = [a * (b + 0.1) for a, b in zip(_smooth(length), _smooth(signs), strict=True)]
    mean = sum(fused) / len(fused)
    limit = min(max(fused), share * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)))
    over = [p for p, f in zip(sums, fused, strict=True) if f >= limit]
    alone = {p: a * (b + 0.1) for p, a, b in zip(sums, length, signs, strict=True)}
    return {p for p in over if alone[p] >= limit} or set(over)


def _menus(parts: list[tuple[int, str, int]]) -> set[int]:
    """Paths of several nodes with most of their text in links."""
    sums: dict[int, list[int]] = {}
    for path, s, linked in parts:
        t = sums.setdefault(path, [0, 0, 0])
        t[0] += len(s)
        t[1] += linked
        t[2] += 1
    return {p for p, (n, linked, k) in sums.items() if k > 1 and linked > LINKS * n}


def main_text(source: str | None, share: float = SHARE) -> str:
    """The article of a page, its blocks in page order joined by newlines; empty if there is none."""
    page = read(source or "")
    n = len(page.tag)
    holds = [t in ("article", "main") for t in page.tag]
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    # a form or an element of an odd name around the whole article says nothing
    odd = [o if not (holds[e] and page.tag[e] not in ("article", "main")) else 0 for e, o in enumerate(page.odd)]
    gone, perhaps = [False] * n, [0] * n
    for e in range(1, n):
        gone[e] = gone[page.parent[e]] or odd[e] == 2
        perhaps[e] = perhaps[page.parent[e]] or (e if odd[e] == 1 else 0)
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    parts = [(page.path[e], s, linked) for e, s, linked in blocks]
    content = content_paths(parts, share)
    # elements that only perhaps aren't content go if they hold none
    sure = {perhaps[e] for (e, _, _), (p, _, _) in zip(blocks, parts, strict=True) if p in content}
    left = [k for k, (e, _, _) in enumerate(blocks) if not perhaps[e] or perhaps[e] in sure]
    if not left:
        return ""
    own, under = [0] * n, [0] * n
    for k in left:
        e, s, _ = blocks[k]
        own[e] += len(s)
        under[e] += len(s) if parts[k][0] in content else 0
    for e in range(n - 1, 0, -1):
        own[page.parent[e]] += own[e]
        under[page.parent[e]] += under[e]
    roots: list[int] = []
    for name in ("article", "main"):
        found: list[int] = []
        for e in range(1, n):
            if page.tag[e] == name and not gone[e] and own[e] and not (found and e < page.end[found[-1]]):
                found.append(e)
        if found:
            roots = [e for e in found if under[e]] or [max(found, key=lambda e: own[e])]
            break
    if not roots:
        # the last element that holds all content is the smallest; a block has its neighbours with it, an element the headings beside it
        e = max(e for e in range(n) if under[e] == under[0])
        headed = {page.parent[i] for i, _, _ in blocks if page.tag[i] in HEADINGS}
        while e > 0 and (page.tag[e] in BLOCKS or page.parent[e] in headed):
            e = page.parent[e]
        roots = [e]
    menus = _menus([parts[k] for k in left]) - content
    inside, r = [], 0
    for k in left:
        e = blocks[k][0]
        while r + 1 < len(roots) and e >= page.end[roots[r]]:
            r += 1
        if roots[r] <= e < page.end[roots[r]]:
            inside.append((k, page.tag[e] not in HEADINGS and parts[k][0] in menus))
    # a heading goes with what it heads, if all else beside it went
    beside: dict[int, list[int]] = {}
    for k, menu in inside:
        e = blocks[k][0]
        if page.tag[e] not in HEADINGS:
            up = page.parent[e]
            for x in (up, page.parent[up] if up > 0 else up):
                t = beside.setdefault(x, [0, 0])
                t[0] += 1
                t[1] += menu
    out = []
    for k, menu in inside:
        e = blocks[k][0]
        t = beside.get(page.parent[e]) if page.tag[e] in HEADINGS and page.parent[e] not in roots else None
        if not menu and not (t and t[0] == t[1]):
            out.append(blocks[k][1])
    return "\n".join(out)


def extract(pages: DataFrame, source: str = "html", share: float = SHARE) -> DataFrame:
    """`pages` without `source`, with the main `text` of each whole page and its length `n_chars` in code points.

    A null, empty or wordless page has an empty text. Rows stand alone: repeated ones give equal
    results. Existing `text` and `n_chars` are replaced, whatever the other columns' names. An empty table gives none.
    """

    def make(found: list[str | None]) -> list[pa.Array]:
        texts = [main_text(t, share) for t in found]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    out = with_made(pages, source, make, "text string, n_chars long")
    return out.select(*[quoted(c) for c in out.columns if c != source or source in ("text", "n_chars")])
