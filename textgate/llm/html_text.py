"""Operator 4: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. In the first pass a block's place (navigation,
header, footer, sidebar, form, advert, notice, comments), its link density, its length and its
stop-word density decide whether it is text, boilerplate or undecided. In the second pass the
undecided blocks - short ones, headings, those of middling density - take the label of the nearest
decided neighbours: of both where they agree, else of the nearer one.

An article (or main region) that a page marks is a prior of both passes. Inside it a low density
leaves a block undecided, links decide on lists but not on paragraphs and headings, neighbours are
those of the same region that their own content decided, and where they disagree or are missing the
block is text. Outside it the same rules hold as on a page without a marked article, so a lead
paragraph stays; the region's blocks are no text neighbours there, so a credit that
follows the article does not become text.

A box is furniture by its element, or by a whole word of a class or id that is no statement about
the page (``has-sidebar``, ``comments-open``); one that is so by class only, or a form, stays where
it holds most of the page's prose. The scanner goes over a page once, so that time grows with its
length whatever is left open in it.

Defined cases: a null or empty page, or one without text, gives an empty text; markup that is
never closed runs to the end of its parent or of the page (a ``<`` without any ``>`` after it is
text); an element that closes itself is empty; a page without any decided block keeps
its undecided ones; repeated rows give repeated results; an empty table gives no rows; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS

# Names of elements, and words in their classes, ids and roles.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
DROPPED = frozenset("svg math select button object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SINGLE = frozenset({"hr"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BOILER_TAGS = frozenset({"nav", "footer", "aside", "menu", "dialog", "head"})
FORM_TAGS = frozenset({"form", "fieldset"})
BOILER_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentform commentlist comments "
    "consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion recommended related replies reply search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar topbar widget".split()
)
HEADER_WORDS = frozenset({"header", "masthead"})
COMMENT_WORDS = frozenset({"comment", "comments", "commentlist", "commentform", "disqus", "replies", "reply"})
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class of several words is furniture by its last word, or by its first where all others only say what kind of box it is.
BOX_WORDS = frozenset(
    "area articles bar block body bottom box btn button buttons column container content fixed form group header heading icon icons inner "
    "item items left link links list main media meta mobile panel post posts primary respond right row secondary section slot small "
    "stories text thread title top unit wrap wrapper".split()
)
#: A class with one of these words says whether something else is there.
STATE_WORDS = frozenset("allow can closed disable disabled enable enabled has hide is no not off on open show with without".split())
KEEP_TAGS = frozenset({"html", "body", "main"})
#: What an opening tag closes by itself, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, set()),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

LINK_DENSITY = 0.5
SHORT_CHARS = 70
LONG_CHARS = 140
LOW_STOPS = 0.15
HIGH_STOPS = 0.3
#: A box that is furniture by its class, or a form, is not if it holds more than this share of the page's prose.
MOST_PROSE = 0.5

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile("[>\"']")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    boiler: bool
    region: int  # 0: none; else the number of the article, or of main, that it is in
    kind: str  # "article", "main" or ""
    box: int = 0  # the innermost box around it that is furniture unless it holds most of the prose; 0: none


@dataclass
class Block:
    tag: str
    boiler: bool
    region: int
    kind: str
    box: int = 0
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""


class Open:
    """The open elements, with the places of each tag's, so that none is searched for."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}

    def top(self) -> Element:
        return self.stack[-1] if self.stack else Element("", False, 0, "")

    def push(self, e: Element) -> None:
        self.at.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.at[self.stack.pop().tag].pop()


def scanned(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", it, ""), ("open" or "single", tag, attributes), ("end", tag, "") and ("gap", tag, "") for what is left out whole.

    One pass forward: whatever is looked for and missing is not looked for again, and a tag whose
    quotes never end, which ends at its first ``>``, tells so for all tags that its quotes go through.
    """
    n, last_end = len(page), page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    last_cdata = page.rfind("]]>")
    endless: set[int] = set()  # places after a quote from which no tag end follows

    def end_of(at: int) -> int:
        first, passed = at, []
        while (m := QUOTE_OR_END.search(page, at)) and m[0] != ">":
            if m.start() >= last_quote[m[0]]:
                m = None
                break
            at = page.index(m[0], m.end()) + 1
            if at in endless:
                m = None
                break
            passed.append(at)
        if m:
            return m.start()
        endless.update(passed)
        return page.index(">", first)

    at = 0
    while (i := page.find("<", at)) >= 0:
        follows = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            stop, event = (n if j < 0 else j + 3), None
        elif page.startswith("<![CDATA[", i) and i + 9 <= last_cdata:
            stop, event = page.index("]]>", i + 9) + 3, None
        elif follows in ("!", "?") and i < last_end:
            stop, event = page.index(">", i) + 1, None
        else:
            ends = follows == "/"
            m = NAME.match(page, i + 1 + ends) if i < last_end else None
            if not m:  # a plain character
                if i >= last_end:
                    break
                yield ("text", page[at : i + 1], "")
                at = i + 1
                continue
            close = end_of(m.end())
            tag, attrs, stop = m[0].lower(), page[m.end() : close], close + 1
            single = attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\n\r\"'")
            event = ("end", tag, "") if ends else ("single" if single else "open", tag, attrs)
            if tag in RAW_END and event[0] == "open":
                m = RAW_END[tag].search(page, stop)
                stop, event = (m.end() if m else n), ("gap", tag, "")
        if i > at:
            yield ("text", page[at:i], "")
        if event:
            yield event
        at = stop
    if at < n:
        yield ("text", page[at:], "")


def _telling(token: str) -> str | None:
    """The word that says what a box of this class or id is; None where no word of furniture does."""
    words = [w.lower() for w in WORDS.findall(token)]
    if not words or not STATE_WORDS.isdisjoint(words):
        return None
    known = BOILER_WORDS | HEADER_WORDS
    if words[-1] in known and not (words[-1] in BOX_WORDS and words[0] in BOILER_WORDS):
        return words[-1]
    return words[0] if words[0] in known and BOX_WORDS.issuperset(words[1:]) else None


def _hints(attrs: str) -> tuple[set[str], set[str], bool]:
    words, roles, hidden = set(), set(), False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(w for t in value.split() if (w := _telling(t)))
        elif name == "role":
            roles.update(value.lower().split())
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return words, roles, hidden


def blocks(page: str) -> list[Block]:
    open_ = Open()
    found: list[Block] = []
    regions, links = 0, 0
    around = [0]  # of each box, the box around it
    here: Block | None = None
    dropped, depth, inner = "", 0, Counter()  # an element that is left out, how often it is open, and what is open in it

    def add(raw: str) -> None:
        nonlocal here
        text = html.unescape(raw) if "&" in raw else raw
        if here is None:
            if not text or text.isspace():
                return
            top = open_.top()
            here = Block(top.tag, top.boiler, top.region, top.kind, top.box)
            found.append(here)
        here.parts.append(text)
        if links:
            here.link_chars += len("".join(text.split()))

    for event, tag, attrs in scanned(page):
        if dropped:
            if event == "end" and tag == dropped:
                depth -= 1
                dropped = dropped if depth else ""
                continue
            if event == "end" and tag in BLOCKS and not inner[tag] and open_.last({tag}) >= 0:
                dropped = ""  # what is around it ends
            elif event == "open" and (tag == "article" or tag in KEEP_TAGS):
                dropped = ""
            else:
                depth += event == "open" and tag == dropped
                inner[tag] += (event == "open") - (event == "end" and inner[tag] > 0)
                continue
        if event == "text":
            add(tag)
        elif event == "gap":
            add(" ")
        elif tag in DROPPED:
            if tag != "svg":
                add(" ")
            if event == "open":
                dropped, depth, inner = tag, 1, Counter()
        elif tag == "a":
            links = 1 if event == "open" else 0
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            here, links = None, 0
            if event == "end":
                if (place := open_.last({tag})) >= 0:
                    open_.cut(place)
                continue
            if open_.top().tag == "p":
                open_.cut(len(open_.stack) - 1)
            if tag in CLOSES:
                closed, stop = CLOSES[tag]
                if (place := open_.last(closed)) > open_.last(stop):
                    # the outermost of those that follow one another directly
                    while place and open_.stack[place - 1].tag in closed:
                        place -= 1
                    open_.cut(place)
            elif tag in HEADINGS and open_.top().tag in HEADINGS:
                open_.cut(len(open_.stack) - 1)
            if tag in SINGLE or event == "single":
                continue
            top = open_.top()
            words, roles, hidden = _hints(attrs) if attrs else (set(), set(), False)
            region, kind = top.region, top.kind
            comment = bool(words & COMMENT_WORDS) and tag not in KEEP_TAGS
            if not comment and (tag == "article" or tag == "main" or "main" in roles or "article" in roles) and kind != "article":
                regions += 1
                region, kind = regions, "article" if tag == "article" or "article" in roles else "main"
            boiler = tag in BOILER_TAGS or comment or (hidden and tag not in KEEP_TAGS)
            weak = tag in FORM_TAGS
            if tag not in KEEP_TAGS and tag != "article":
                weak |= bool(words & BOILER_WORDS) or bool(roles & BOILER_ROLES)
                weak |= (tag == "header" or bool(words & HEADER_WORDS)) and not region
            if weak:
                around.append(top.box)
            open_.push(Element(tag, top.boiler or boiler, region, kind, len(around) - 1 if weak else top.box))
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    found = [b for b in found if b.text]
    _judge_boxes(found, around)
    return found


def _judge_boxes(found: list[Block], around: list[int]) -> None:
    """Blocks in a box of furniture become furniture, unless the box holds most of the page's prose."""
    prose = [0] * len(around)
    for b in found:
        if not b.boiler and b.link_chars <= LINK_DENSITY * len(b.text):
            prose[b.box] += len(b.text)
    for box in range(len(around) - 1, 0, -1):  # a box has a higher number than the one around it
        prose[around[box]] += prose[box]
    furniture = [False] * len(around)
    for box in range(1, len(around)):
        furniture[box] = furniture[around[box]] or prose[box] <= MOST_PROSE * prose[0]
    for b in found:
        b.boiler |= furniture[b.box]


def label(found: list[Block]) -> None:
    """Both passes: every block's label becomes "text" or "boiler"."""
    marked = {b.kind for b in found if not b.boiler}
    kind = "article" if "article" in marked else "main" if "main" in marked else ""
    for b in found:
        words = b.text.lower().split()
        density = sum(map(STOP_WORDS.__contains__, words)) / len(words)
        linked = b.link_chars / len(b.text)
        inside = bool(kind) and b.kind == kind
        if b.boiler:
            b.label = "boiler"
        elif linked > LINK_DENSITY and not (inside and b.tag in ("p", "blockquote", *HEADINGS)):
            b.label = "boiler"
        elif b.tag in HEADINGS or len(b.text) < SHORT_CHARS:
            b.label = ""
        elif density >= HIGH_STOPS and len(b.text) >= LONG_CHARS:
            b.label = "text"
        elif density < LOW_STOPS and not inside:
            b.label = "boiler"
        else:
            b.label = ""
    if kind:
        decided = [b.label for b in found]
        regions: dict[int, list[Block]] = {}
        for b in found:
            if b.kind == kind and not b.boiler:
                regions.setdefault(b.region, []).append(b)
        for own in regions.values():
            _inherit_inside(own)
        _inherit(found, ["boiler" if b.kind == kind else x for b, x in zip(found, decided, strict=True)])
    elif any(b.label for b in found):
        _inherit(found, [b.label for b in found])
    else:
        for b in found:
            b.label = "text"


def _inherit_inside(own: list[Block]) -> None:
    """Undecided blocks of one marked region are boilerplate between two decided neighbours that are,
    else text. Furniture by place or class is not among ``own``: it says nothing about what is next to it."""
    decided = [b.label for b in own]
    after, last = ["text"] * len(own), "text"
    for i in range(len(own) - 1, -1, -1):
        last = decided[i] or last
        after[i] = last
    last = "text"
    for i, b in enumerate(own):
        last = decided[i] or last
        if not decided[i]:
            b.label = "boiler" if last == after[i] == "boiler" else "text"


def _inherit(found: list[Block], decided: list[str]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours: of both where they agree,
    else of the nearer one (of the one before at equal distance); a heading takes that of the block
    after it. The ends of the page count as boilerplate far away."""
    before, after, last = [], [("boiler", 1 << 30)] * len(found), ("boiler", -(1 << 30))
    for i, x in enumerate(decided):
        last = (x, i) if x else last
        before.append(last)
    last = ("boiler", 1 << 30)
    for i in range(len(found) - 1, -1, -1):
        last = (decided[i], i) if decided[i] else last
        after[i] = last
    for i, b in enumerate(found):
        if not decided[i]:
            (left, at_left), (right, at_right) = before[i], after[i]
            b.label = right if b.tag in HEADINGS or at_right - i < i - at_left else left


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if found:
        label(found)
    return " ".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``; a narrow map, a page at a time."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(per_batch, f"page_id {kind}, url string, text string, n_chars long")
