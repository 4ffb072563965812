"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Blocks inside menus, headers,
footers, sidebars and the like by tag or role, inside hidden elements and comment
sections, are boilerplate at once; a form is, unless most of its text stands in
long blocks with few links (a form around the whole page). Below other elements
whose class or id names such a place, only long blocks with few links are looked
at, as if they stood outside an article. An element that its own end tag does not
close ends with its parent, and what it swallowed is looked at the same way. The
first pass classifies blocks by length, link density and the share of stop words
(several languages); inside an article or main element long ones need no stop
words, and neither do they on a page where no long block has any: there long
blocks of sentences with few links are text. Short ones stay undecided. The
second pass gives each of them the label of its nearest decided neighbour in the
same section; without one, blocks of an article or main element are text.

Cases: null or empty html, or a page without text, gives the empty string; cut
off tags at the end are dropped and open elements end with the page; character
references are decoded as browsers do, also without a semicolon; very long
pages are read whole. Repeated rows and null ids keep their rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import map_batches

# fixed values: element names of HTML
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ARTICLE_TAGS = frozenset({"article", "main"})
DROPPED_TAGS = frozenset(
    "head nav footer aside button select option label input dialog iframe object menu "
    "noscript template".split()
)
# block elements whose end tag may be left out
IMPLIED_TAGS = frozenset("p li dd dt tr td th tbody thead tfoot".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager toolbar footer footnav copyright related recommended share sharing social newsletter "
    "subscribe subscription signup login search widget widgets skip".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply".split())
# words that may stand beside a listed one in a class or id
PLAIN_NAMES = frozenset(
    "site page main primary secondary global top bottom left right post entry article box bar "
    "container wrapper wrap inner outer area block section list item items group content link links "
    "button buttons form media text sticky fixed icon icons".split()
)
HEADER_NAMES = frozenset({"header", "masthead", "topbar", "head"})
STOP_WORDS = frozenset(
    # English, German, French, Spanish, Italian, Portuguese, Dutch
    (
        "the of and to in a is that for it on was with be as by at this are from or an have not but "
        "they you his her she he we all which their has been were there who more if so what will "
        "der die das und in zu den ist von mit für auf ein eine des dem im nicht es an auch als nach "
        "bei aus wie einen sich er sie dass wird oder um war haben nur noch werden "
        "le la les de des du et un une à en est que qui dans pour par sur pas au avec il elle ce ne "
        "se plus ou son sa ses aux cette mais nous vous sont été comme "
        "el los las y del que en un una por con para no es se al lo su sus como más pero este esta "
        "fue son entre sobre muy ya también hay "
        "il lo gli di che non per una sono con ha della delle nel più anche "
        "o os as do da dos das em um uma com não por mais para foi ao "
        "het een van en dat op te zijn voor niet met ook aan er maar om"
    ).split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|svg|xmp)\b.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")
# white space of HTML and of Unicode alike
BLANKS = re.compile(r"\s+")
LEGAL = re.compile(r"©|\(c\)\s|copyright|all rights reserved|alle rechte vorbehalten", re.I)

# marks that end a sentence, of many scripts
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4\u061f\u1362\u0589\u104b]")
# from here on a character says about as much as three letters
DENSE = re.compile(r"[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")

SHORT = 70
LONG = 200
# characters to a sentence, at most
SENTENCE_CHARS = 400
LINKS_HIGH = 0.5
LINKS_SOME = 0.2
STOP_HIGH = 0.22
STOP_LOW = 0.10

GOOD, BAD, UNDECIDED = 1, -1, 0
KEEP, LISTED, FORM, DROP = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    section: int  # number of the article or main element, 0 outside
    label: int = UNDECIDED


def letters(text: str) -> int:
    """Length of a text in characters of an alphabet."""
    return len(text) + (0 if text.isascii() else 2 * len(DENSE.findall(text)))


def is_prose(text: str, links: int) -> bool:
    """Long and with few links: worth a look wherever it stands."""
    return letters(text) >= LONG and links <= LINKS_SOME * len(text)


@dataclass
class Frame:
    """An open element that is boilerplate, or may be."""

    kind: int
    block: int  # blocks before it
    sections: int  # open articles around it


@dataclass
class Cutter:
    """Walks over the markup once and collects the blocks outside boilerplate."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    in_link: bool = False
    link_depth: int = 0  # open elements around the link
    sections: list[int] = field(default_factory=list)
    begun: int = 0
    # open block elements and frames, and how many of each name
    stack: list[tuple[str, Frame | None]] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    listed: list[Frame] = field(default_factory=list)
    breaks: int = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            self.breaks = 0
        self.parts.append(text)
        if self.in_link:
            self.links += len(text)

    def end_block(self) -> None:
        if self.parts:
            text = BLANKS.sub(" ", "".join(self.parts)).strip()
            if text and not self.listed:
                self.blocks.append(Block(text, self.links, self.sections[-1] if self.sections else 0))
            elif is_prose(text, self.links):
                self.blocks.append(Block(text, self.links, 0))
            self.parts, self.links = [], 0
        self.breaks = 0

    def open(self, name: str, attributes: str, closed: bool) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            else:
                self.parts.append(" ")
            return
        is_block = name in BLOCK_TAGS or name == "body"
        if is_block:
            self.end_block()
            self.end_implied(name)
        if name == "body":
            self.end_all()
        if name == "a":
            self.in_link, self.link_depth = True, len(self.stack)
        elif name in ARTICLE_TAGS:
            self.listed.clear()
            self.begun += 1
            self.sections.append(self.begun)
        if name in VOID_TAGS or closed:
            return
        kind = self.boilerplate(name, attributes)
        frame = None
        if kind != KEEP:
            self.end_block()
            frame = Frame(kind, len(self.blocks), len(self.sections))
            if kind == LISTED:
                self.listed.append(frame)
        # of the other elements only those that could be taken for a frame's end
        if is_block or frame or self.opened[name]:
            self.stack.append((name, frame))
            self.opened[name] += 1

    def end_implied(self, name: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        if self.stack and self.stack[-1][0] == "p":
            self.pop(own=True)
        if name in IMPLIED_TAGS and self.stack and self.stack[-1][0] == name:
            self.pop(own=True)

    def end_all(self) -> None:
        while self.stack:
            self.pop(own=False)

    def pop(self, own: bool) -> None:
        """Leave the innermost open element, by its ``own`` end tag or with its parent."""
        name, frame = self.stack.pop()
        self.opened[name] -= 1
        if name in ARTICLE_TAGS:
            self.end_block()
            del self.sections[-1:]
        if self.in_link and self.link_depth > len(self.stack):
            self.in_link = False
        if frame is None:
            return
        if frame.kind == LISTED:
            if self.listed and self.listed[-1] is frame:
                self.end_block()
                self.listed.pop()
            return
        self.end_block()
        inside = self.blocks[frame.block :]
        if frame.kind == FORM:
            if not holds_page(inside):
                del self.blocks[frame.block :]
        elif own:
            del self.blocks[frame.block :]
        else:
            self.blocks[frame.block :] = [
                b for b in inside if b.section or is_prose(b.text, b.links)
            ]
        del self.sections[frame.sections :]

    def boilerplate(self, name: str, attributes: str) -> int:
        if name in DROPPED_TAGS or name == "header" and not self.sections:
            return DROP
        if not attributes or name in ("html", "body") or name in ARTICLE_TAGS:
            return FORM if name == "form" else KEEP
        kind = FORM if name == "form" else KEEP
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role" and value in ROLES and name != "form":
                return DROP
            if (
                key == "hidden" and value != "until-found"
                or key == "aria-hidden" and value == "true"
                or key == "style" and UNSEEN.search(value)
            ):
                return DROP
            if key in ("class", "id"):
                named = max((self.named(token) for token in value.split()), default=KEEP)
                kind = max(kind, named)
        return kind

    def named(self, token: str) -> int:
        """What a class or id says as a whole: each of its words is listed or a plain one."""
        names = set(NAME.findall(token))
        listed = DROPPED_NAMES if self.sections else DROPPED_NAMES | HEADER_NAMES
        if not names <= listed | COMMENT_NAMES | PLAIN_NAMES:
            return KEEP
        return DROP if names & COMMENT_NAMES else LISTED if names & listed else KEEP

    def close(self, name: str) -> None:
        if name in BLOCK_TAGS or name == "body":
            self.end_block()
        if name == "a":
            self.in_link = False
        if self.opened[name]:
            block = name in BLOCK_TAGS or name == "body"
            # the end of an inline element does not reach out of a block
            for open_name, _ in reversed(self.stack):
                if open_name == name:
                    break
                if not block and open_name in BLOCK_TAGS and open_name not in IMPLIED_TAGS:
                    return
            while self.stack[-1][0] != name:
                self.pop(own=False)
            self.pop(own=True)


def holds_page(blocks: list[Block]) -> bool:
    """Whether most of the text is prose, or an article: then a form is but a wrapper."""
    whole = sum(letters(b.text) for b in blocks)
    prose = sum(letters(b.text) for b in blocks if b.section or is_prose(b.text, b.links))
    return prose >= 2 * LONG and 2 * prose >= whole


def cut(page: str) -> list[Block]:
    """The blocks of a page that no element marks as boilerplate."""
    cutter, at = Cutter(), 0
    for m in MARKUP.finditer(page):
        cutter.text(page[at : m.start()])
        at = m.end()
        slash, name, rest = m.group(2, 3, 4) if m[3] else m.group(5, 6, 7)
        if name:
            if slash:
                cutter.close(name.lower())
            else:
                cutter.open(name.lower(), rest, rest.endswith("/"))
    cutter.text(page[at:])
    cutter.end_block()
    cutter.end_all()
    return cutter.blocks


def stop_share(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def is_sentences(block: Block) -> bool:
    """Long text with few links in sentences, whatever the language."""
    size = letters(block.text)
    marks = len(SENTENCE.findall(block.text))
    links = block.links / len(block.text)
    return size >= LONG and links <= LINKS_SOME and marks * SENTENCE_CHARS >= size


def first_label(block: Block, stops: float, known: bool) -> int:
    """Good, bad or undecided by length, links and stop words.

    ``known``: some long block of the page has stop words.
    """
    size = letters(block.text)
    links = block.links / len(block.text)
    if links > LINKS_HIGH:
        return BAD
    if size < SHORT:
        return BAD if links > LINKS_SOME or not block.section and LEGAL.search(block.text) else UNDECIDED
    if block.section:
        # prose of another language has few of these words, but an article says it is prose
        return GOOD if links <= LINKS_SOME or size >= LONG or stops >= STOP_LOW else BAD
    if size < LONG and LEGAL.search(block.text):
        return UNDECIDED
    if not known and is_sentences(block):
        return UNDECIDED if LEGAL.search(block.text) else GOOD
    return GOOD if stops >= (STOP_LOW if links <= LINKS_SOME else STOP_HIGH) else BAD


def label(blocks: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    shares = [stop_share(b.text) if len(b.text) >= SHORT else 0.0 for b in blocks]
    known = any(
        share >= STOP_LOW and is_prose(b.text, b.links)
        for b, share in zip(blocks, shares, strict=True)
    )
    for block, share in zip(blocks, shares, strict=True):
        block.label = first_label(block, share, known)
    # only labels of the first pass are neighbours
    decided: dict[int, list[int]] = {}
    for n, block in enumerate(blocks):
        if block.label:
            decided.setdefault(block.section, []).append(n)
    for n, block in enumerate(blocks):
        if block.label:
            continue
        near = decided.get(block.section, [])
        at = bisect_left(near, n)
        # the nearest on each side; the earlier one counts first
        sides = sorted(near[max(0, at - 1) : at + 1], key=lambda k: abs(k - n))
        if len(sides) == 2 and abs(sides[0] - n) == abs(sides[1] - n):
            labels = {blocks[k].label for k in sides}
            block.label = GOOD if labels == {GOOD} or GOOD in labels and block.section else BAD
        elif sides:
            block.label = blocks[sides[0]].label
        else:
            block.label = GOOD if block.section else BAD


def main_text(page: str | None) -> str:
    """Text blocks of a page in order, two line feeds between them."""
    if not page:
        return ""
    blocks = cut(page)
    label(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; a page without text has an empty one."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            sizes = pa.array(map(len, texts), pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
                ["page_id", "url", "text", "n_chars"],
            )

        return each

    own = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    return map_batches(own, make, "page_id long, url string, text string, n_chars long")
