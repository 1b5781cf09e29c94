"""HTML extraction by line-block distribution.

A page is stripped to its text blocks, one a line, in page order. Every line has a weight: its
text length without the part in links, times what the mark-up says about it. Lines inside an
element that marks the article weigh more, the others of such a page less; lines inside elements
that are no part of an article (menus, headers, footers, forms and the like, by element, role,
class or id) weigh nothing, but a class or id that only contains such a word ("social-science")
is overruled where its element holds most of the page's text, and a form where it holds the article. In
an article, words that also name parts of articles ("discussion") do not count on text blocks and as
ids of sections. Lines of the page's owner (copyright) outside an article weigh nothing either. Sums of weights over sliding
windows of lines surge where the main text begins and dive where it ends; lines of weight between
a surge and its dive are kept, and so are those elsewhere in the element that contains them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: Summed weight at which a window counts as text.
SURGE = 80
#: Weight of a character inside an element that marks the article, in a link there, and outside on a page with such a mark.
MARKED, MARKED_LINK, UNMARKED = 8.0, 0.8, 0.25
#: Lines in a row that are links only and make a menu.
LINK_RUN = 3
#: Share of the page's text from which an element overrules a class that only contains a word of ``NAMES``.
OVERRULED = 0.5

#: Elements whose content is no text.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "title", "head")
#: Those that run to the end of the page where they aren't closed; of the others only the tag is skipped then.
ENDLESS = ("script", "style", "textarea", "title", "iframe")
#: Elements that hold no part of an article.
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")
#: Roles that hold no part of an article.
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar")
#: Words of class and id attributes that name such parts.
NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "promo", "promoted", "promotion", "sponsor", "sponsored",
    "nav", "navbar", "navigation", "navi", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "topbar", "toolbar",
    "header", "masthead", "footer", "footnav", "sidebar", "aside", "side", "widget", "widgets", "related", "recommended", "recommendations", "trending", "popular",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall",
    "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "discussion", "feedback", "responses", "adsbygoogle", "advertorial", "rail", "replies", "reply", "respond", "form", "search", "searchbox", "skip", "hidden",
)
#: Words of these that also name parts of articles: they say nothing as id of a section or in a text block of an article.
WEAK = ("discussion", "responses", "feedback", "search", "navigation", "form", "notice", "notices", "alert", "side", "header", "popular", "toc", "hidden", "skip", "rail", "reply", "respond", "share", "sharing", "social", "subscription", "login")
#: Elements that often hold whole pages. They do so if the article's mark is inside, or this share of the text of a page without a mark.
FRAMES, FRAMED = ("form", "fieldset"), 0.9
#: Openings of lines that name the owner of the page.
OWNER = ("©", "(c) ", "copyright ")
#: Words that may stand beside those in a class without making it mean anything else.
GLUE = (
    "area", "bar", "block", "bottom", "box", "col", "column", "container", "global", "group", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "my",
    "outer", "page", "panel", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "text", "the", "title", "top", "unit", "user", "wrap", "wrapper",
)
#: Words that make a class with "header" that of the article's own heading.
OWN_HEADER = ("article", "entry", "post", "story", "content")
#: Elements that mark the article.
MARKS = ("article", "main")
#: Elements that begin and end a block.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "head", "button",
)
#: Blocks that contain text only, and the outermost containers.
TEXT_BLOCKS, OUTERMOST = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd", "figcaption", "caption", "summary", "legend"), ("html", "body")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: An opening tag of the key closes an open element of the values first.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an implied end stops.
SCOPES = ("ul", "ol", "dl", "table", "select", "menu")

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
_ASIDE, _ROLES, _NAMES, _WEAK, _GLUE, _MARKS, _BLOCKS, _VOID = map(frozenset, (ASIDE, ROLES, NAMES, WEAK, GLUE, MARKS, BLOCKS, VOID))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ENDED = frozenset((*SCOPES, *(x for names in IMPLIED.values() for x in names)))
ENDS = {name: re.compile(rf"</{name}\s*(?:>|\Z)|\Z", re.I) for name in RAW if name != "head"}


@dataclass(eq=False)
class Block:
    name: str
    parent: Block | None


@dataclass(eq=False)
class Doubt:
    """An element whose class or id only contains a word of ``NAMES``, or one of ``FRAMES``, inside another one or none."""

    parent: Doubt | None
    frame: bool = False
    marked: bool = False
    chars: int = 0
    holds: bool = True


@dataclass
class Line:
    """A text block: characters in links, whether it is surely no part of an article, doubts, article mark, element."""

    text: str
    linked: int
    outside: bool
    doubt: Doubt | None
    mark: Block | None
    block: Block


NOTHING, DOUBTFUL, SURE = range(3)


def aside_evidence(name: str, attrs: str, in_article: bool) -> int:
    """What tag, role, class and id say: nothing, a doubt, or that the element is surely no part of an article."""
    words_of = lambda value: [WORDS.findall(x) for x in value.split()]
    given = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in ATTR.findall(attrs)} if attrs.strip() else {}
    own = {w for words in words_of(given.get("class", "") + " " + given.get("id", "")) for w in words}
    if name in FRAMES:
        return DOUBTFUL
    if name in _ASIDE and not (name == "header" and in_article and (not given or own & set(OWN_HEADER))):
        return SURE
    if name in ("html", "body", "article", "main"):
        return NOTHING
    if given.get("role") in _ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return SURE
    found = NOTHING
    for key in ("class", "id"):
        if key == "id" and name in HEADINGS:
            continue  # where a link leads, not what the heading is
        mild = in_article and (name in TEXT_BLOCKS or (key == "id" and name == "section"))
        for words in words_of(given.get(key, "")):
            hits = [w for w in words if w in _NAMES and not (w == "header" and any(x in OWN_HEADER for x in words)) and not (mild and w in _WEAK)]
            if hits:
                plainly = hits != ["side"] and all(w in _NAMES or w in _GLUE or w.isdigit() for w in words)
                found = max(found, SURE if plainly else DOUBTFUL)
    return found


def lines_of(page: str) -> list[Line]:
    """The text blocks of a page in order; white space inside a block is one space. Linear in the page."""
    found: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, Doubt | None, Block | None, bool]] = []  # name, surely aside, doubt, mark, link
    blocks: list[int] = []  # places of blocks in the stack, and of elements with implied ends and their scopes
    ended: list[int] = []
    aside = link = 0
    opened: Counter[str] = Counter()
    block, doubt, mark = Block("html", None), None, None
    unclosed: set[str] = set()  # names without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Line(text, linked, aside > 0, doubt, mark, block))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text)

    def close() -> None:
        nonlocal aside, doubt, mark, link, block
        name, sure, own_doubt, own_mark, is_link = stack.pop()
        opened[name] -= 1
        if name in _BLOCKS:
            flush()
            block = block.parent
            blocks.pop()
        if name in _ENDED:
            ended.pop()
        aside, link = aside - sure, link - is_link
        doubt = own_doubt.parent if own_doubt else doubt
        mark = None if own_mark else mark

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        if tag is None:
            take(page[at:])
            break
        take(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            if tag["cdata"]:
                parts.append(tag["cdata"])
            continue
        name = name.lower()
        if tag["close"]:
            if name == "br":
                parts.append(" ")
            elif opened[name]:
                while stack[-1][0] != name:
                    close()
                close()
            elif name == "p":
                flush()
            continue
        if name in ENDS:
            if (not tag["attrs"].endswith("/") or name in ("script", "style")) and name not in unclosed:
                close_tag = ENDS[name].search(page, at)
                if close_tag.group() or name in ENDLESS:
                    at = close_tag.end()
                else:
                    unclosed.add(name)
            parts.append(" ") if name not in ("script", "style", "template") else None
            continue
        if name == "br":
            parts.append(" ")
        if name in _BLOCKS:
            flush()
            if name in IMPLIED:
                for k in reversed(ended):
                    if stack[k][0] in IMPLIED[name]:
                        close_to(k)
                        break
                    if stack[k][0] in SCOPES:
                        break
            elif name == "body" and opened["head"]:
                while opened["head"]:
                    close()
            # A block ends an open paragraph and the inline elements in it.
            if blocks and stack[blocks[-1]][0] == "p":
                close_to(blocks[-1])
        if name in _VOID:
            continue
        evidence = aside_evidence(name, tag["attrs"], opened["article"] > 0)
        sure = name == "head" or evidence == SURE
        own_doubt = Doubt(doubt, name in FRAMES) if evidence == DOUBTFUL else None
        if name in _BLOCKS:
            block = Block(name, block)
            blocks.append(len(stack))
        if name in _ENDED:
            ended.append(len(stack))
        marks = name in _MARKS or 'role="main"' in tag["attrs"] or "articleBody" in tag["attrs"]
        own_mark = block if marks and mark is None else None
        if own_mark is not None and doubt is not None and not aside:
            doubt.marked = True
        stack.append((name, sure, own_doubt, own_mark, name == "a"))
        opened[name] += 1
        aside, link, doubt, mark = aside + sure, link + (name == "a"), own_doubt or doubt, own_mark or mark
    flush()
    return found


def _settle_doubts(lines: list[Line]) -> None:
    """Mark the lines in doubtful elements as outside, unless the element holds most of the page's text or, as a frame, its article."""
    total, has_mark = 0, any(x.mark and not x.outside for x in lines)
    for x in lines:
        if not x.outside:
            total += len(x.text) - x.linked
            if x.doubt and x.block.name not in FRAMES:  # a form's own text, outside of blocks, is no article
                x.doubt.chars += len(x.text) - x.linked
    seen: set[Doubt] = set()
    for x in lines:
        d = x.doubt
        while d is not None and d not in seen:
            seen.add(d)
            d = d.parent
    # Inner elements first: their texts belong to the outer ones too.
    depth: dict[Doubt, int] = {}
    for d in seen:
        path = []
        while d is not None and d not in depth:
            path.append(d)
            d = d.parent
        k = depth[d] if d is not None else -1
        for y in reversed(path):
            k += 1
            depth[y] = k
    chain = sorted(seen, key=depth.__getitem__, reverse=True)
    for d in chain:
        if d.parent is not None:
            d.parent.chars += d.chars
            d.parent.marked |= d.marked
    for d in reversed(chain):
        held = not d.marked and (has_mark or d.chars < FRAMED * total) if d.frame else d.chars < OVERRULED * total
        d.holds = held or (d.parent is not None and d.parent.holds)
    for x in lines:
        x.outside = x.outside or (x.doubt is not None and x.doubt.holds)


def line_weights(lines: list[Line]) -> list[float]:
    """The weight of each line: its characters outside of links times what the mark-up says."""
    has_mark = any(x.mark and not x.outside for x in lines)

    def weight(x: Line) -> float:
        own = max(0, len(x.text) - x.linked)
        if x.outside:
            return 0.0
        if not x.mark and x.text[:10].lower().startswith(OWNER):
            return 0.0
        if x.mark:
            return MARKED * own + MARKED_LINK * min(x.linked, len(x.text))
        return own * (UNMARKED if has_mark else 1.0)

    return [weight(x) for x in lines]


def stretches(weights: list[float], parts: list[object], window: int = WINDOW, surge: float = SURGE) -> list[bool]:
    """Whether each line lies between a surge and the next dive.

    A surge is a window whose sum reaches ``surge``, or the largest sum of a page without such a
    window; the dive is the next window without any weight. From the surge the stretch goes back
    over lines of weight. Windows do not reach from one part (a run of equal ``parts``) into another.
    """
    n, kept = len(weights), [False] * len(weights)
    ends, sums = [0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        ends[k] = ends[k + 1] if k + 1 < n and parts[k + 1] == parts[k] else k + 1
        sums[k] = sum(weights[k : min(k + window, ends[k])])
    surge = min(surge, max(sums, default=0.0)) or 1.0
    k = begin = 0
    while k < n:
        if k and parts[k] != parts[k - 1]:
            begin = k
        if sums[k] < surge:
            k += 1
            continue
        first, last = k, k
        while not weights[first]:
            first += 1
        while first > begin and not kept[first - 1] and weights[first - 1]:
            first -= 1
        while last < ends[k] and sums[last]:
            last += 1
        for i in range(first, last):
            kept[i] = True
        k = max(last, k + 1)
    return kept


def _in_containers(lines: list[Line], kept: list[bool]) -> list[bool]:
    """Whether each line shares a container with a kept one: anywhere below it, or as its own block where that is the page."""
    containers = set()
    for x, keep in zip(lines, kept, strict=True):
        if keep:
            containers.add(x.mark or x.block.parent or x.block)
            if x.block.name not in TEXT_BLOCKS:
                containers.add(x.block)
    inside: dict[Block, bool] = {}

    def below(block: Block | None) -> bool:
        path = []
        while block is not None and block not in inside:
            path.append(block)
            block = block.parent
        found = block is not None and inside[block]
        for b in reversed(path):
            found = inside[b] = found or (b in containers and b.name not in OUTERMOST)
        return found

    return [x.block in containers or x.block.parent in containers or below(x.block) for x in lines]


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The main text: kept blocks in page order, joined by an empty line; empty if there is none.

    Kept are the lines of a stretch that are not outside, but for menus (several lines in a row of
    links only, without an article mark), and lines of weight that share a container with them.
    """
    lines = lines_of(page or "")
    _settle_doubts(lines)
    weights = line_weights(lines)
    found = stretches(weights, [x.mark for x in lines], window, surge)
    solid = [keep and w > 0 for keep, w in zip(found, weights, strict=True)]
    near = _in_containers(lines, solid)
    run, menus = 0, [False] * len(lines)
    for k, (x, w) in enumerate(zip(lines, weights, strict=True)):
        run = run + 1 if not w and not x.outside else 0
        if run >= LINK_RUN:
            menus[k] = True
        if run == LINK_RUN:
            menus[k - run + 1 : k] = [True] * (run - 1)
    kept = [(keep and not x.outside and not menu) or (w > 0 and c) for x, keep, menu, w, c in zip(lines, found, menus, weights, near, strict=True)]
    return "\n\n".join(x.text for x, keep in zip(lines, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null or empty html gives an empty text with length 0; repeated rows each give a row; other
    columns do not matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
