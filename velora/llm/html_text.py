"""HTML extraction by two-pass block rules.

Method. A page is cut into blocks at block-level tags. Blocks inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments (by tag,
role, class or id of an enclosing element, be it a block or inline) are out; inside an
article only tags and names that can mean nothing else count, as a post-header has the
title and a foot-note is text. Pass one decides each other
block from its link density, its length and its density of stop words (the
densest of the four lists). Blocks that are too short or too poor in stop words
to decide are ambiguous. Pass two gives each ambiguous block the label of the
nearest decided block before or after it; of two equally near ones that differ,
good wins. Where the page has an article or main element, only blocks inside it
compete, and the place itself speaks for them: only link density makes such a
block bad, if it is no paragraph or heading, only good neighbours hand their label on,
and an ambiguous one without such neighbours is good. On a page without one, an ambiguous block without decided
neighbours is bad.

Text inside a block has its character references decoded and white space runs
turned into one space; blocks are joined by one newline. Nothing is cut or
capped. A single <br> is white space, two in a row end the block.

Work is per row, linear in its length, without a shuffle. Defined results: null or empty html gives
the empty text; broken or cut off markup is read as far as it goes; repeated
rows give equal rows; a null url stays null.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.common import map_batches

STOP_WORDS = {
    "en": frozenset("a about after all also an and any are as at be been but by can could for from had has have he her his i if in into is it its me more my no not of on one or our she so that the their them there they this to up was we were what when which who will with would you".split()),
    "de": frozenset("aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer es für haben hat ich im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und unter von vor war was wenn werden wie wir wird zu zum zur".split()),
    "fr": frozenset("au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais me même ne nous on ont ou où par pas pour qu que qui sa sans se ses si son sont sur te tu un une vous y".split()),
    "es": frozenset("a al algo como con de del donde el ella en entre era es esa ese esta este ha han hasta hay la las le les lo los más me mi muy no nos o para pero por porque que qué se si sin sobre son su sus también te un una y ya".split()),
}

#: Limits of pass one.
MAX_LINK_DENSITY = 0.5
MIN_STOP_DENSITY = 0.25
SHORT = 60

_RAW = "script|style|textarea|title|noscript|template|svg|math|iframe|object|xmp|select|datalist"
#: Comments, raw elements with their content, other markup, and tags; in this order.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    rf"|<(?P<raw>{_RAW})\b(?>[^>]*)(?:(?<=/)>|>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

BLOCK_TAGS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav aside form menu dialog footer header button fieldset head search frameset audio video canvas".split())
ROOT_TAGS = frozenset(("article", "main"))
ROOT_NAMES = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer foot header masthead comment comments commentlist reply replies respond discussion disqus share sharing social related recommended widget widgets newsletter subscribe subscription signup popup modal overlay login search skip pagination pager toolbar copyright disclaimer paywall outbrain taboola".split()
)
#: Of these names those that are boilerplate inside an article too.
NARROW_NAMES = BOILER_NAMES - frozenset("header foot masthead search respond reply discussion social notification alert rail overlay toolbar skip copyright disclaimer widget widgets modal navigation login signup pager".split())
#: Elements whose own names matter though they are no blocks.
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Blocks that are text of an article even if they are one link.
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre dd".split())
#: Opening one of these ends an open paragraph; and which open elements others of their kind end.
_CLOSES_P = BLOCK_TAGS - {"head", "body", "html"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What an end that is left out can be looked for behind, and where the search ends.
_PASSED = frozenset("address div p dd dt li td th tr a span".split())
_LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


class Block:
    """White space-normalised text; the share of its characters in links; where it stands."""

    __slots__ = ("boiler", "linked", "prose", "root", "text")

    def __init__(self, text: str, linked: float, root: bool, boiler: bool, prose: bool) -> None:
        self.text, self.linked, self.root, self.boiler, self.prose = text, linked, root, boiler, prose


def _names(value: str) -> set[str]:
    """A class or id attribute's words: sideBar-left gives side, bar, sidebar, left."""
    out: set[str] = set()
    for name in value.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        out |= {*parts, *(a + b for a, b in zip(parts, parts[1:])), name.lower()}
    return out


def _kind(tag: str, attrs: str, in_root: bool) -> tuple[bool, bool]:
    """(is a content root, is boilerplate) of an element."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    role = found.get("role", "").lower()
    root = tag in ROOT_TAGS or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    if tag in ("html", "body"):
        return False, False
    names = _names(f"{found.get('class', '')} {found.get('id', '')}") if "class" in found or "id" in found else set()
    root = root or bool(names & ROOT_NAMES)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    known = NARROW_NAMES if in_root else BOILER_NAMES
    if hidden or names & known and not (tag in ("header", "h1", "h2", "h3") and in_root) and not (root and tag == "main"):
        return False, True
    if tag in BOILER_TAGS and not (tag == "header" and in_root) or role in BOILER_ROLES and not (role == "banner" and in_root):
        return False, True
    return root, False


class _Inline:
    """Inline elements that are open inside one block element."""

    __slots__ = ("count", "hidden", "open")

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []  # tag, whether it is boilerplate
        self.count: Counter[str] = Counter()
        self.hidden = 0  # how many are boilerplate

    def push(self, tag: str, boiler: bool) -> None:
        self.open.append((tag, boiler))
        self.count[tag] += 1
        self.hidden += boiler

    def close(self, tag: str) -> None:
        while self.count[tag]:
            closed, boiler = self.open.pop()
            self.count[closed] -= 1
            self.hidden -= boiler
            if closed == tag:
                break


class _Open:
    """An open block element: what holds inside it, and the inline elements open around it."""

    __slots__ = ("around", "boiler", "root", "tag")

    def __init__(self, tag: str, root: bool, boiler: bool, around: _Inline) -> None:
        self.tag, self.root, self.boiler, self.around = tag, root, boiler, around


class _Parser:
    """Blocks of a page from its markup, one tag after the other."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.count: Counter[str] = Counter()  # open block elements by tag
        self.inline = _Inline()
        self.pieces: list[tuple[str, bool]] = []
        self.link, self.breaks = False, 0

    def flush(self) -> Block | None:
        self.breaks = 0
        if not self.pieces:
            return None
        raw = "".join(x for x, _ in self.pieces)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        whole = sum(len(x.strip()) for x, _ in self.pieces)
        linked = sum(len(x.strip()) for x, a in self.pieces if a) / max(whole, 1)
        self.pieces.clear()
        top = self.stack[-1] if self.stack else None
        return Block(text, linked, bool(top and top.root), bool(top and top.boiler), bool(top and top.tag in PROSE_TAGS)) if text else None

    def text(self, piece: str) -> None:
        if not self.inline.hidden:
            self.pieces.append((piece, self.link))
        if not piece.isspace():
            self.breaks = 0

    def pop(self) -> None:
        top = self.stack.pop()
        self.count[top.tag] -= 1
        self.inline = top.around

    def inline_tag(self, tag: str, end: bool, attrs: str) -> None:
        if tag == "a":
            self.link = not end
        if end:
            self.inline.close(tag)
        else:
            root = bool(self.stack and self.stack[-1].root)
            self.inline.push(tag, bool(attrs and not attrs.isspace()) and _kind(tag, attrs, root)[1])

    def close(self, tag: str) -> None:
        if self.count[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def open(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P and self.stack and self.stack[-1].tag == "p":
            self.pop()
        if tag == "body":  # an unclosed head ends here
            self.close("head")
        siblings, limits = _SIBLINGS.get(tag, ()), _LIMITS.get(tag, ())
        if any(self.count[x] for x in siblings):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in siblings:
                    while len(self.stack) > k:
                        self.pop()
                    break
                if self.stack[k].tag in limits or self.stack[k].tag not in _PASSED:
                    break
        top = self.stack[-1] if self.stack else None
        root, boiler = bool(top and top.root), bool(top and top.boiler)
        own_root, own_boiler = _kind(tag, attrs, root)
        self.stack.append(_Open(tag, root or own_root, boiler or own_boiler or self.inline.hidden > 0, self.inline))
        self.count[tag] += 1
        self.inline = _Inline()


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in page order, without empty ones."""
    p, at = _Parser(), 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            p.text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag in INLINE_TAGS:
            p.inline_tag(tag, end, attrs)
        elif tag == "br":
            breaks = p.breaks + 1
            p.pieces.append((" ", p.link))
            p.breaks = breaks
            if breaks > 1 and (b := p.flush()):
                yield b
        elif tag in BLOCK_TAGS or tag in BOILER_TAGS or tag in ROOT_TAGS:
            if b := p.flush():
                yield b
            p.link = False
            if tag in VOID_TAGS:
                continue
            if end:
                p.close(tag)
            else:
                p.open(tag, attrs)
    if at < len(page):
        p.text(page[at:])
    if b := p.flush():
        yield b


def stop_density(text: str) -> float:
    """The share of a text's words in the stop list that has most of them."""
    words = _WORD.findall(text.lower())
    return max(sum(map(known.__contains__, words)) for known in STOP_WORDS.values()) / len(words) if words else 0.0


def labels(found: list[Block]) -> list[bool]:
    """Both passes: which blocks are main text."""
    first: list[bool | None] = []
    for b in found:
        if b.linked > MAX_LINK_DENSITY:
            first.append(None if b.root and b.prose else False)
        elif len(b.text) < SHORT:
            first.append(None)
        elif stop_density(b.text) >= MIN_STOP_DENSITY:
            first.append(True)
        else:
            first.append(None if b.root or b.linked == 0 else False)
    decided = [k for k, x in enumerate(first) if x is not None]
    out, j = [], 0
    for k, (x, b) in enumerate(zip(first, found)):
        while j < len(decided) and decided[j] < k:
            j += 1
        if x is None:
            near = [decided[i] for i in (j - 1, j) if 0 <= i < len(decided)]
            # bad neighbours in an article are lists of links, which say nothing about the text beside them
            near = [i for i in near if first[i] or not b.root]
            least = min((abs(i - k) for i in near), default=0)
            x = any(first[i] for i in near if abs(i - k) == least) if near else b.root
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found = [b for b in blocks(page) if not b.boiler]
    if any(b.root for b in found):
        found = [b for b in found if b.root]
    return "\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")
