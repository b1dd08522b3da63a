"""Main text of web pages by the distribution of line blocks.

Markup is stripped so that each block-level element becomes a line. Each line weighs its text outside links; lines under
navigation, header, footer, aside, form and similar elements, or under elements whose class or id names such a role, weigh
nothing and are never kept. Sums over sliding windows of lines show where text surges and where it dives for good: the part
with the largest total weight is the article, and with it the other parts of the block that encloses it; their lines, however
short, are kept.
"""

from __future__ import annotations

import collections
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea svg iframe object canvas audio video head xmp".split())
#: Elements that hold no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button select".split())
#: Elements that enclose the blocks of a part of the page.
HOLDER = frozenset("article div main td".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark parts outside the article.
ROLES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply share sharing sidebar skip social sponsor sponsored subscribe toc toolbar widget".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NONE = re.compile(r"display\s*:\s*none\b", re.I)
_END = {name: re.compile(f"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}
_BODY = re.compile("<body", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
#: Words that with a role before them name a part of a page, as in comment-list; on their own they say nothing.
PLACES = frozenset("area bar block body box buttons container content form header holder inner item items link links list menu panel row section slot text title thread unit wrap wrapper zone".split())

#: Lines of a window, its weight at which text surges, and the empty windows after which it has dived.
WINDOW, SURGE, DIVE = 3, 1, 3


def _marked(token: str) -> bool:
    """Whether a class, id or role names a part outside the article: a role as a whole or at its end (site-footer), or at its
    beginning with words for places only behind it (comment-list). A role among other words (share-price-table, ad-hoc) says nothing."""
    parts = _PARTS.findall(token)
    if not parts or "of" in parts:
        return False
    places = len(parts)
    while places > 1 and parts[places - 1] in PLACES:
        places -= 1
    return parts[places - 1] in ROLES and (places == len(parts) or places == 1 or parts[places - 1] not in ("ad", "share", "social", "skip"))


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _outside(name: str, text: str) -> bool:
    if name in ASIDE:
        return True
    if not text or name in ("html", "body", "main"):
        return False
    found = _attributes(text)
    if found.get("hidden", "false").lower() != "false" or found.get("aria-hidden", "").lower() == "true" or _NONE.search(found.get("style", "")):
        return True
    return any(_marked(token) for k in ("class", "id", "role") for token in found.get(k, "").lower().split())


class Holders(list):
    """For each HOLDER element the one around it; articles: those that are article elements."""

    def __init__(self):
        super().__init__()
        self.articles: set[int] = set()


def lines(page: str, parents: Holders | None = None) -> list[tuple[str, int, bool, bool, int]]:
    """The page's lines: text, characters outside links, whether outside any article, whether inside an article or main element,
    number of the enclosing HOLDER element, 0 without; `parents` receives for each of these the one around it, itself for 0."""
    out: list[tuple[str, int, bool, bool, int]] = []
    parents = Holders() if parents is None else parents
    parents.append(0)
    holder = 0
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is outside
    opened: collections.Counter[str] = collections.Counter()  # how many of the open elements have a name
    parts: list[str] = []
    linked = 0
    depth = {"out": 0, "a": 0, "in": 0}

    def close_line() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, 0 if depth["out"] else max(0, len(text) - linked), depth["out"] > 0, depth["in"] > 0, holder))
        parts.clear()
        linked = 0

    def leave(entry: tuple[str, bool]) -> None:
        nonlocal holder
        opened[entry[0]] -= 1
        if entry[0] in HOLDER:
            holder = parents[holder]
        depth["out"] -= entry[1]
        depth["a"] -= entry[0] == "a"
        depth["in"] -= entry[0] in ("article", "main")

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            parts.append(piece)
            if depth["a"]:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if m[3].endswith("/"):
                continue
            end = _END[name].search(page, at)
            if not end and name == "head":
                end = _BODY.search(page, at)
                at = end.start() if end else at
                continue
            at = end.start() if end else size
            continue
        if name in RAW:
            continue
        if name in BLOCK:
            close_line()
        if name in VOID:
            continue
        if not closing:
            if m[3].endswith("/"):
                continue
            if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                leave(stack.pop())  # its end tag may be left out
            outside = _outside(name, m[3]) or name == "header" and not depth["in"]
            stack.append((name, outside))
            opened[name] += 1
            if name in HOLDER:
                parents.append(holder)
                holder = len(parents) - 1
                if name == "article":
                    parents.articles.add(holder)
            depth["out"] += outside
            depth["a"] += name == "a"
            depth["in"] += name in ("article", "main")
        elif opened[name]:
            while True:
                top = stack.pop()
                leave(top)
                if top[0] == name:
                    break
    close_line()
    return out


def _around(parents: list[int], holders: set[int]) -> int:
    """The innermost element that encloses all these; elements have larger numbers than those around them."""
    left = set(holders)
    while len(left) > 1:
        last = max(left)
        left.discard(last)
        left.add(parents[last])
    return left.pop()


def _without_cards(found: list[tuple[str, int, bool, bool, int]], parents: Holders) -> list[tuple[str, int, bool, bool, int]]:
    """Of article elements side by side those with less than half the text of the largest are cards that lead elsewhere."""
    inside = {x[4] for x in found if x[3]}
    top: dict[int, int] = {}
    for holder in inside:
        chain = [holder]
        while parents[chain[-1]]:
            chain.append(parents[chain[-1]])
        top[holder] = next((h for h in reversed(chain) if h in parents.articles), chain[-1])
    weights: collections.Counter[int] = collections.Counter()
    for x in found:
        if x[3]:
            weights[top[x[4]]] += x[1]
    most = max(weights.values())
    small = {h for h in weights if h in parents.articles and 2 * weights[h] < most}
    return [(t, 0, True, i, h) if i and top[h] in small else (t, w, o, i, h) for t, w, o, i, h in found]


def main_text(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and for one without text outside menus and the like."""
    if not page:
        return ""
    parents = Holders()
    found = lines(page, parents)
    if any(x[3] and not x[2] for x in found):  # an article element bounds the text: what stands outside it weighs nothing
        found = [(t, len(t) if inside and not o else 0, o or not inside, inside, holder) for t, w, o, inside, holder in found]
        found = _without_cards(found, parents)
    n = len(found)
    weights = [x[1] for x in found]
    blocks = [sum(weights[i : i + WINDOW]) for i in range(n)]
    segments, best, best_weight, start = [], (0, 0), 0, None
    empty = 0
    for i in range(n + 1):
        if start is None:
            if i < n and weights[i] and blocks[i] >= SURGE:
                start, empty = i, 0
        elif i == n or not found[i][3] and (found[i][2] or not weights[i]):
            empty += 1
            if i == n or empty >= DIVE and not blocks[i]:
                weight, end = sum(weights[start:i]), i
                while not weights[end - 1]:  # what follows the last line with weight is no part of it
                    end -= 1
                segments.append((start, end))
                if weight > best_weight:
                    best, best_weight = (start, end), weight
                start = None
        else:
            empty = 0
    if len(segments) > 1:  # other parts of the block that encloses the heaviest belong to the article, too
        homes = [_around(parents, {x[4] for x in found[s:e] if x[1]}) for s, e in segments]
        home = homes[segments.index(best)]
        segments = [x for x, h in zip(segments, homes, strict=True) if h == home or home and _around(parents, {h, home}) == home]
    kept = [x[0] for s, e in segments for x in found[s:e] if not x[2]]
    return " ".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with text, the main text of the whole page, and n_chars, its code points; columns with these names are replaced.

    Null and empty pages have an empty text and 0. Repeated rows stay rows, pages of any length are read whole, an empty table stays
    empty."""
    kept = pages.drop("text", "n_chars") if column not in ("text", "n_chars") else pages

    @F.pandas_udf("string")
    def texts(column):
        return column.map(main_text)

    return kept.withColumn("text", texts(whole(column))).withColumn("n_chars", F.length("text").cast("long"))
