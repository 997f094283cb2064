"""Links of pages with the cards that enclose them.

One linear pass over a page's tags keeps the stack of open elements, as a
lenient parser does: a closing tag closes the innermost open element of its
name and all that was opened since; void elements are never open.  A link's card
is its innermost open list item, article, table row, cell or division, its row
the nearest such element whose class says that it is one.  Texts come from the
tokens between an element's first and last, as many as are needed, so nested
cards cost no more than flat ones.  A page is one row and what a task holds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CARDS, ROWS, HEADINGS = frozenset(("li", "article", "div", "tr", "td")), frozenset(("tr", "li", "article", "div")), frozenset(("h1", "h2", "h3", "h4", "h5"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROW_CLASS = re.compile(r"row|card|item|post|listing|result|entry", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = r"(?:^|\s){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_HREF, _CLASS = re.compile(_ATTRIBUTE.format("href"), re.I), re.compile(_ATTRIBUTE.format("class"), re.I)

#: Characters of a card's text that are kept.
CARD_CHARS, ROW_CHARS = 700, 120
#: Links that are handed on together.
TOGETHER = 2000


class _Element:
    __slots__ = ("name", "first", "last", "above", "is_row", "heading")

    def __init__(self, name: str, first: int, above, is_row: bool) -> None:
        self.name, self.first, self.last, self.above, self.is_row, self.heading = name, first, None, above, is_row, None


def _attribute(pattern: re.Pattern, given: str) -> str | None:
    m = pattern.search(given) if given else None
    return None if m is None else entities.unescape(next(g for g in m.groups() if g is not None))


def _text(tokens: list[str], first: int, last: int, most: int | None = None, between: str = " ") -> str:
    out, size = [], 0
    for i in range(first, last):
        out.append(tokens[i])
        size += len(tokens[i]) + len(between)
        if most is not None and size > most:
            break
    return between.join(out)[:most]


def links_of(page: str) -> list[tuple]:
    """href, text, heading, card, row_first, row_text of each link, in order."""
    tokens: list[str] = []
    links: list[tuple] = []
    top = None  # the innermost open element; each knows the one above
    at, skip = 0, None

    def opened(element: _Element) -> None:
        above = element.above
        while above is not None:  # the first heading inside a card is the card's
            if above.name in CARDS:
                if above.heading is not None:
                    break  # and so have all around it theirs
                above.heading = element
            above = above.above

    for m in _TAG.finditer(page):
        if skip is None:
            said = " ".join(entities.unescape(page[at : m.start()]).split())
            if said:
                tokens.append(said)
        at = m.end()
        closing, name = m.group(1), (m.group(2) or "").lower()
        if not name:
            continue
        if skip is not None:
            if closing and name == skip:
                skip = None
            continue
        if closing:
            element = top
            while element is not None and element.name != name:
                element = element.above
            while element is not None and top is not element.above:
                top.last = len(tokens)
                top = top.above
            continue
        if name in ("script", "style"):
            skip = name
            continue
        if name in VOID or m.group(3).endswith("/"):
            continue
        top = _Element(name, len(tokens), top, name in ROWS and ROW_CLASS.search(_attribute(_CLASS, m.group(3)) or "") is not None)
        if name in HEADINGS:
            opened(top)
        if name == "a" and (href := _attribute(_HREF, m.group(3))) is not None:
            links.append((href, top))
    if skip is None and (said := " ".join(entities.unescape(page[at:]).split())):
        tokens.append(said)
    while top is not None:
        top.last = len(tokens)
        top = top.above

    out, texts = [], {}
    for href, a in links:
        card = a.above
        while card is not None and card.name not in CARDS:
            card = card.above
        row = card.above if card is not None else None
        while row is not None and not row.is_row:
            row = row.above
        for e in (card, row):
            if e is not None and e not in texts:
                texts[e] = _text(tokens, e.first, e.last, CARD_CHARS)
        head = card.heading if card is not None else None
        out.append((
            href, _text(tokens, a.first, a.last), _text(tokens, head.first, head.last) if head is not None else None, texts.get(card),
            tokens[row.first][:ROW_CHARS] if row is not None and row.last > row.first else None, texts.get(row),
        ))
    return out


SCHEMA = "page_id long, page_url string, pos int, href string, text string, heading string, card string, row_first string, row_text string"


def linked_cards(pages: DataFrame) -> DataFrame:
    """page_id, page_url, pos, href, text, heading, card, row_first, row_text of
    every link; ``pages``: page_id, url, html."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 6]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                rows += ((page_id, url, i, *link) for i, link in enumerate(links_of(html or "")))
                if len(rows) >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(scan, SCHEMA)
