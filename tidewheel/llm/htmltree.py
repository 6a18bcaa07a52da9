"""Main text of web pages by tree scoring.

The page becomes a tree of elements and text blocks. Each paragraph passes
points for its length and commas to its container and, halved, to the next
two up; a container's points are discounted by its link density. The best
container and those siblings that score like it are kept; an article or main
element around the best one takes its place, if its text is not mostly links.
All blocks of what is kept stay but those in boilerplate elements and in lists
and boxes of mostly linked text.

Every step passes over the tags or the elements once, so that the work is
linear in the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Elements that are not text, whose content is skipped up to the end tag.
RAW = frozenset("script style template textarea title iframe".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math noscript object q s samp small span strike strong sub sup svg time tt u var".split())
#: Tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that start a block. Others that are not listed run in the line, but for custom ones, whose names have a hyphen.
BLOCKS = CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption colgroup button select option optgroup legend summary search dialog".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Roles and words in class and id that mark furniture.
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|respond|cookies?|consent|notice|popup|modal|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|widget|pagination|pager|toolbar|copyright|legal)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)/?>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
#: One attribute, its value as a unit, so that matches in a row walk a tag's attributes.
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+))?)?""")
#: Elements that are one paragraph, whose points go to what holds them.
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6".split())
#: Share of the best score that a sibling needs, and of linked characters from which a box is a menu.
SIBLING, LINKED = 0.2, 0.5


_HREF = re.compile(r"(?:^|\s)href\b", re.I)


class _Element:
    __slots__ = ("tag", "parent", "points", "chars", "linked", "blocks", "furniture", "kept")

    def __init__(self, tag: str, parent: _Element | None, furniture: bool) -> None:
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.points = 0.0
        self.chars = self.linked = self.blocks = 0
        self.kept = False

    def score(self) -> float:
        return self.points * (1 - self.linked / max(1, self.chars))


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and _NAMED.search(value):
            return True
    return False


def _blocks(page: str) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """The elements, parents first, and (container, text, linked characters)
    of the text blocks in page order. A link reaches over blocks to its end or
    that of the element that it starts in."""
    root = _Element("", None, False)
    stack, elements, out = [root], [root], []
    words: list[str] = []
    opened: Counter[str] = Counter()
    links = anchors = 0  # anchors: the depth at which a link is open
    at = 0

    def flush() -> None:
        nonlocal words, links
        text = " ".join(" ".join(words).split()) if len(words) != 1 else " ".join(words[0].split())
        if text:
            out.append((stack[-1], text, min(links, len(text))))
        words, links = [], 0

    def pop_to(k: int) -> None:
        nonlocal anchors
        flush()
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]
        if anchors > k:
            anchors = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            text = html.unescape(piece)
            pieces.append(text)
            if anchors:
                links += len(text.strip())

    pieces: list[str] = []

    def join() -> None:
        if pieces:
            words.append("".join(pieces))
            pieces.clear()

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
        elif tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in INLINE or tag not in BLOCKS and tag not in VOID and "-" not in tag:
            if tag == "a":
                anchors = 0 if closing else len(stack) if _HREF.search(attributes) else anchors
        else:
            join()
            flush()
            if closing:
                for k in () if not opened[tag] else range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if tag == "p" and stack[k].tag not in INLINE and stack[k].tag != "p":
                        break
            elif tag in VOID:
                pass
            else:
                if tag in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            pop_to(k)
                            break
                        if stack[k].tag in CLOSES_P:
                            break
                if tag in SAME:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in SAME[tag]:
                            pop_to(k)
                            break
                        if stack[k].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                            break
                stack.append(_Element(tag, stack[-1], stack[-1].furniture or _is_furniture(tag, attributes)))
                elements.append(stack[-1])
                opened[tag] += 1
    add(page[at:])
    join()
    flush()
    return elements, out


def points(text: str) -> float:
    """Of a paragraph: one for each comma and each 100 characters, three of the
    latter at most."""
    return text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)


def main_text(page: str | None) -> str:
    """The main text, its blocks joined by one line feed; empty if none."""
    elements, blocks = _blocks(page or "")
    blocks = [b for b in blocks if not b[0].furniture]
    for element, text, linked in blocks:
        element.chars, element.linked, element.blocks = element.chars + len(text), element.linked + linked, element.blocks + 1
        up, own = element.parent if element.tag in PARAGRAPHS else element, points(text)
        for share in (1, 0.5, 0.25):
            if up is not None:
                up.points, up = up.points + own * share, up.parent
    for e in reversed(elements[1:]):
        up = e.parent
        up.chars, up.linked, up.blocks = up.chars + e.chars, up.linked + e.linked, up.blocks + e.blocks
    best = max(elements, key=_Element.score)
    if best.score() <= 0:
        return ""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and up.linked < LINKED * up.chars:
        best = up
    least = SIBLING * best.score()
    for e in elements:  # parents come first
        menu = e.tag not in PARAGRAPHS and e.blocks > 1 and e.linked >= LINKED * e.chars
        like = e.parent is best.parent and e.score() >= least and e.linked < LINKED * e.chars
        e.kept = e is best or like or e.parent is not None and e.parent.kept and not menu
    return "\n".join(text for element, text, _ in blocks if element.kept)


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: its keys, text and n_chars (code points). A null
    or empty page, and one without text that is not linked, has an empty text;
    long pages are read whole; of containers that tie, the first counts; rows
    may repeat, and keys may be null."""
    kinds = dict(pages.dtypes)
    rows = pages.select(F.struct(*keys).alias("keys"), F.col(html_col).alias("html"))

    def run(b: dict[str, list]) -> dict[str, list]:
        text = [main_text(x) for x in b["html"]]
        return {k: [r[k] for r in b["keys"]] for k in keys} | {"text": text, "n_chars": [len(x) for x in text]}

    return map_batches(rows, run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", text string, n_chars long")
