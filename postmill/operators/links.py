"""Links of ASCII pages, read in Arrow batches: what ``pages.anchors`` takes from
a page by expressions, which it keeps for other pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed import rule
from postmill.functions.scan import for_batch
from postmill.functions.urls import TRACKING

#: ``tested``: only wanted links are there.
KIND = "array<struct<pos:int,href:string,text:string,url:string,tested:boolean>>"
_BLANKS = " \t\n\r\f\v"
_ODD = re.compile(rf"[{_BLANKS[1:]}]|  ")
_RUN, _TAG = re.compile(rf"[{_BLANKS}]+"), re.compile("<[^>]+>")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)")
_FOLDER, _QUERY = re.compile(r"[^\n\r]*/"), re.compile(r"\?([^\n\r]*)(?:\Z|(?=(?:\r\n|\n|\r)\Z))")


def plain(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if _ODD.search(text):
        text = _RUN.sub(" ", text)
    return text.strip(" ")


def normaliser(base: str) -> Callable[[str], str]:
    """``urls.normalise`` of links as seen from the page at ``base``."""
    scheme, root = re.match(r"([A-Za-z]+):", base), re.match(r"[A-Za-z]+://[^/?#]*", base)
    scheme, root = scheme.group(1) if scheme else "", root.group() if root else ""
    m = _PARTS.match(base)
    path = m.group(3) if m else ""
    folder = _FOLDER.match(path)
    folder = folder.group() if folder else "/"

    def normal(href: str) -> str:
        raw = href.strip(" ")
        if not raw:
            return ""
        raw = raw.partition("#")[0]
        if _SCHEME.match(raw):
            whole = raw
        elif raw.startswith("//"):
            whole = f"{scheme}:{raw}"
        elif raw.startswith("/"):
            whole = root + raw
        elif raw.startswith("?"):
            whole = root + path + raw
        elif not raw:
            whole = base.partition("#")[0]
        else:
            whole = root + folder + raw
        m = _PARTS.match(whole)
        if m is None or not m.group(2) or (name := m.group(1).lower()) not in ("http", "https"):
            return ""
        out = f"{name}://{m.group(2).lower()}{m.group(3).rstrip('/') or '/'}"
        if "?" in whole and (m := _QUERY.search(whole)):
            kept = [kv for kv in m.group(1).split("&") if kv and not kv.partition("=")[0].strip(" ").lower().startswith(TRACKING)]
            if kept:
                out += "?" + "&".join(kept)
        return out

    return normal


@dataclass(frozen=True)
class Wanted:
    """Which links to keep: those with an address, a text of ``least`` to
    ``most`` characters, and what the patterns say of text and address."""

    least: int = 0
    most: int | None = None
    text: tuple[str, ...] = ()
    no_text: tuple[str, ...] = ()
    url: tuple[str, ...] = ()

    def condition(self) -> Column:
        text, url = F.col("text"), F.col("url")
        out = (url != "") & (F.length(text) >= self.least)
        if self.most is not None:
            out &= F.length(text) <= self.most
        for p in self.no_text:
            out &= ~text.rlike(rule(p))
        for c, patterns in ((url, self.url), (text, self.text)):
            for p in patterns:
                out &= c.rlike(rule(p))
        return out

    def among(self, text: pa.Array, url: pa.Array) -> np.ndarray:
        size = pc.utf8_length(text)
        out = pc.and_(pc.not_equal(url, ""), pc.greater_equal(size, self.least))
        if self.most is not None:
            out = pc.and_(out, pc.less_equal(size, self.most))
        at = np.flatnonzero(out.to_numpy(zero_copy_only=False))
        for column, patterns, good in ((text, self.no_text, False), (url, self.url, True), (text, self.text, True)):
            for p in patterns:
                hit = pc.match_substring_regex(column.take(pa.array(at)), for_batch(p), ignore_case=True)
                at = at[hit.to_numpy(zero_copy_only=False) == good]
        return at


def links(pages: pa.Array, addresses: pa.Array, anchor: re.Pattern, wanted: Wanted | None) -> pa.Array:
    """The links of each page; none of a page that is null."""
    known: dict[str, Callable] = {}
    pos, found, sizes = [], ([], [], []), np.zeros(len(pages) + 1, np.int64)
    for i, (html, base) in enumerate(zip(pages.to_pylist(), addresses.to_pylist())):
        if html is None:
            continue
        if (normal := known.get(base)) is None:
            known.clear()
            normal = known[base] = normaliser(base)
        some = anchor.findall(html)
        sizes[i + 1] = len(some)
        pos += range(len(some))
        found[0].extend(href for href, _ in some)
        found[1].extend(plain(text) for _, text in some)
        found[2].extend(normal(href) for href, _ in some)
    columns = [pa.array(pos, pa.int32()), *(pa.array(x, pa.string()) for x in found)]
    ends = np.cumsum(sizes)
    if wanted is not None:
        at = wanted.among(columns[2], columns[3])
        columns = [c.take(pa.array(at)) for c in columns]
        ends = np.searchsorted(at, ends)
    tested = pa.repeat(True, len(columns[0]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*columns, tested], ["pos", "href", "text", "url", "tested"]))


def links_of(html: Column, url: Column, anchor: str, wanted: Wanted | None) -> Column:
    pattern = re.compile(anchor, re.A)

    def read(pages: pa.Array, addresses: pa.Array) -> pa.Array:
        return links(pages, addresses, pattern, wanted)

    return F.arrow_udf(read, KIND)(html, url)
