"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags and at two line breaks. First pass: each block is decided from its stop-word
density, its length and its link density. Blocks of links are bad; long blocks dense in stop words are good; long
blocks without them are bad; short blocks stay open. Second pass: an open block takes the label of its nearest decided
neighbour; a heading that of the one behind it. Between a good and a bad one at the same distance it is bad, in an article good.

Marks of the page count as decisions of the first pass: blocks in menus, headers, footers, asides, forms, dialogs, hidden elements and in
elements whose class, id or role names an advert, notice, sidebar, share bar or comments are bad, and no neighbour decides across
their edge. In an ``article`` or ``main`` only link density decides, open blocks look to neighbours in it alone, and without a
decided one they are good; a heading right before belongs to them. If such elements hold half of the good text, nothing outside them is main text.

A mark by name or a form is void if it holds the page itself (a ``main``, a first heading next to an ``article``, or, for forms, over
half of the text), as with forms around whole pages. Marks on ``html`` and ``body`` don't count.

Each page is parsed whole in one row of a map over the table; nothing is shuffled and no statistics of other pages are read.

Defined results: null and empty pages, and pages without main text, give an empty text; a tag that never ends reaches to the end of the
page; unknown character references stay as written; repeated rows and null ids are kept row by row; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import slices

# Frequent function words of the languages of the pages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on only
    or out she so than that the their them there they this to was we were what when which who will with would you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im ist mit nach nicht noch
    nur oder sich sie sind so um und von war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et être il ils la le les leur mais ne ou où par pas plus pour que qui sa se ses
    son sont sur un une à
    al como con de del el ella en es esta este fue ha la las lo los más muy no o para pero por que se ser sin sobre su sus también un una
    y ya
    """.split()
)
# Elements that start a new block.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
    th thead tr ul
    """.split()
)
# Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page; those of the first list end at their own end tag whatever they hold.
RAW_TAGS = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
MUTE_TAGS = frozenset("audio button canvas datalist map object option select svg video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are never main text.
BAD_TAGS = frozenset("aside dialog footer form header menu nav search".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id names that mark what is not main text.
BAD_NAMES = frozenset(
    """
    ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer disqus footer gdpr login menu
    modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion recommended related replies share sharing
    sidebar signup social sponsor sponsored subscribe teaser toolbar widget
    """.split()
)
# Words that turn such a name into a statement about the page.
STATES = frozenset("closed disabled enabled has hidden no off on open with without".split())
# Open elements that a start tag ends, and those that shield them.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORDS = re.compile(r"[^\W\d_]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Limits:
    """Thresholds of the rules."""

    short: int = 70  # a block under this many code points is open
    long: int = 200  # a block dense in stop words is good beyond it, open below
    dense: float = 0.3
    links: float = 0.33
    article_links: float = 0.5  # in an article or main element


@dataclass
class Element:
    """An element that may hold blocks; ``bad`` is "always", "by name", "form" or empty."""

    tag: str
    parent: Element | None
    depth: int = 0
    heading: bool = False  # in a heading
    bad: str = ""
    good: bool = False
    scope: Element | None = None  # the nearest article or main element
    mark: Element | None = None  # the outermost bad element
    chars: int = 0
    holds: set[str] = field(default_factory=set)  # which of main, article and h1 lie in it


@dataclass
class Block:
    """A stretch of text between block boundaries."""

    element: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""  # good, bad or, while open, empty
    scope: Element | None = None  # the article, main or bad element it belongs to

    @property
    def heading(self) -> bool:
        return self.element.heading


def _names_bad(value: str) -> bool:
    for token in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(token)]
        if not STATES.isdisjoint(parts):
            continue
        if any(p in BAD_NAMES for p in parts):
            return True
    return False


def _element(tag: str, attributes: str, parent: Element) -> Element:
    made = Element(tag, parent, parent.depth + 1, parent.heading or tag in HEADINGS, scope=parent.scope)
    if tag in ("html", "body"):
        return made
    values = {}
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value))
    role = values.get("role", "").strip().lower()
    made.good = tag in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()
    if "hidden" in values or _HIDING.search(values.get("style", "")):
        made.bad = "always"
    elif _names_bad(values.get("class", "")) or _names_bad(values.get("id", "")):
        made.bad = "by name"
    elif tag == "header" and parent.scope:
        pass  # the heading of an article
    elif tag == "form" or role == "form":
        made.bad = "form"
    elif tag in BAD_TAGS or role in BAD_ROLES:
        made.bad = "always"
    if made.bad:
        made.good = False
    if made.good:
        made.scope = made
    if tag in ("main", "article", "h1"):
        made.holds.add(tag)
    elif role == "main":
        made.holds.add("main")
    return made


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, and the elements that hold them, parents first."""
    blocks: list[Block] = []
    top = Element("", None)
    elements, open_tags = [top], Counter[str]()
    link: Element | None = None  # the element in which a link was opened
    current: Block | None = None
    at, breaks, mute, low = 0, 0, 0, ""

    def leave(upto: Element) -> None:
        nonlocal top, link
        while top is not upto:
            open_tags[top.tag] -= 1
            top = top.parent
        if link is not None and link.depth > top.depth:
            link = None

    def add(text: str) -> None:
        nonlocal current, breaks
        if mute or not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(top)
            blocks.append(current)
        if "&" in text:
            text = html.unescape(text)
        current.parts.append(text)
        if not text.isspace():
            breaks = 0
            if link is not None:
                current.link_chars += len(_SPACE.sub(" ", text).strip())

    while at < len(page):
        mark = _TAG.search(page, at)
        if mark is None:
            add(page[at:])
            break
        add(page[at : mark.start()])
        at = mark.end()
        tag = (mark[2] or "").lower()
        if not tag:
            if mark[0].startswith("<![CDATA["):
                add(html.escape(mark[0][9:].removesuffix("]]>")))
            continue
        ends = bool(mark[1])
        if not ends and tag in RAW_TAGS:
            low = low or _lowered(page)
            close = low.find(f"</{tag}", at)
            at = len(page) if close < 0 else (page.find(">", close) + 1 or len(page))
            continue
        if tag in MUTE_TAGS:
            mute = max(0, mute - 1) if ends else mute if mark[3].endswith("/") else mute + 1
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                current = None
            add(" ")
            continue
        if tag == "a":
            link = None if ends else top
            continue
        if tag in BLOCK_TAGS:
            current, breaks = None, 0
            mute = 0 if tag in ("body", "html", "article", "main", "section", "footer") else mute
        if tag in VOID_TAGS:
            continue
        if ends:
            if open_tags[tag]:
                while top.tag != tag:
                    leave(top.parent)
                leave(top.parent)
            continue
        if tag in BLOCK_TAGS and open_tags["p"]:
            leave(_left(top, {"p"}, {"button", "table", "td", "th", "caption"}))
        if tag in IMPLIED_ENDS:
            leave(_left(top, *IMPLIED_ENDS[tag]))
        if tag in BLOCK_TAGS or "class" in mark[3] or "id" in mark[3] or "none" in mark[3]:
            opened = _element(tag, mark[3], top)
            if opened.bad and tag not in BLOCK_TAGS:
                current = None  # an inline advert is a block of its own
            top = opened
            elements.append(top)
            open_tags[tag] += 1
    for block in blocks:
        block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
    return [b for b in blocks if b.text], elements


def _lowered(page: str) -> str:
    """Lower case with all places kept."""
    low = page.lower()
    return low if len(low) == len(page) else re.sub("[A-Z]+", lambda m: m[0].lower(), page)


def _left(top: Element, tags: set[str], shields: set[str]) -> Element:
    """What is open after the innermost element of these tags ends; a shield above it keeps it open."""
    e = top
    while e is not None and e.tag not in shields:
        if e.tag in tags:
            return e.parent
        e = e.parent
    return top


def label_blocks(page: str, stop_words: Collection[str] = STOP_WORDS, limits: Limits | None = None) -> list[Block]:
    """The blocks of a page after both passes; each is good or bad."""
    limits = limits or Limits()
    blocks, elements = parse(page)
    _mark(blocks, elements)
    for b in blocks:
        first, mark = b.element.scope, b.element.mark
        b.scope = first
        words = _WORDS.findall(b.text.lower())
        density = sum(w in stop_words for w in words) / max(1, len(words))
        links = b.link_chars / len(b.text)
        if mark:
            b.label, b.scope = "bad", mark
        elif links > (limits.article_links if first else limits.links):
            b.label = "bad"
        elif first:
            b.label = "good" if len(b.text) >= limits.short and density >= limits.dense and not b.heading else ""
        elif b.heading or len(b.text) < limits.short:
            b.label = "bad" if "©" in b.text else ""
        elif density >= limits.dense:
            b.label = "good" if len(b.text) > limits.long else ""
        else:
            b.label = "bad"
    for b, after in zip(blocks[-2::-1], blocks[:0:-1]):
        if b.heading and not b.scope and not b.label and after.scope and after.scope.good:
            b.scope = after.scope  # a heading right before an article
    _inherit(blocks)
    inside = sum(len(b.text) for b in blocks if b.label == "good" and b.scope and b.scope.good)
    outside = sum(len(b.text) for b in blocks if b.label == "good" and not b.scope)
    if inside and inside >= outside:
        for b in blocks:
            if not b.scope:
                b.label = "bad"
    return blocks


def _mark(blocks: list[Block], elements: list[Element]) -> None:
    """Per element what lies in it, then which bad element around it counts."""
    for b in blocks:
        b.element.chars += len(b.text)
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.holds |= e.holds
    for e in elements[1:]:
        around = e.bad != "always" and ("main" in e.holds or e.holds >= {"article", "h1"})
        void = around or (e.bad == "form" and 2 * e.chars > elements[0].chars)
        e.mark = e.parent.mark or (e if e.bad and not void else None)


def _inherit(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of their scope; both directions in one pass each."""
    before: list[tuple[int, str]] = []
    seen: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        before.append(seen.get(id(b.scope), (-1, "")))
        if b.label:
            seen[id(b.scope)] = (i, b.label)
    seen = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label:
            seen[id(b.scope)] = (i, b.label)
            continue
        (p, past), (n, ahead) = before[i], seen.get(id(b.scope), (-1, ""))
        if not past and not ahead:
            label = "good" if b.scope else "bad"
        elif not past or not ahead:
            label = past or ahead
        elif n - i == i - p and past != ahead and not b.heading:
            label = "good" if b.scope else "bad"
        else:
            label = ahead if b.heading or n - i < i - p else past
        b.parts = [label]
    for b in blocks:
        b.label = b.label or b.parts[0]


def main_text(page: str | None, stop_words: Collection[str] = STOP_WORDS, limits: Limits | None = None) -> str:
    """Good blocks of the page in order, joined by an empty line."""
    kept = label_blocks(page or "", stop_words, limits)
    return "\n\n".join(b.text for b in kept if b.label == "good")


def extract_main_text(
    pages: DataFrame, html_col: str = "html", keep: Iterable[str] = ("page_id", "url"),
    stop_words: Collection[str] = STOP_WORDS, limits: Limits | None = None,
) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (its code points) per page."""
    keep, words = list(keep), frozenset(stop_words)
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("html_"))
    out = rows.select(keep).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(x, words, limits) for x in part.column(len(keep)).to_pylist()]
            columns = part.columns[: len(keep)] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, out)
