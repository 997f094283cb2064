"""Phrases and dates of whole Arrow batches.

A batch is read as one run of bytes: places where a phrase may begin are found
by their first three characters in a table, and only those are compared.  Dates
are read text by text where a pattern over the batch says that there are any.
Texts are ASCII where this module reads dates; ``functions.dates`` reads others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import fixed

#: Bytes that are looked at together.
RUN = 1 << 22


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the end; the bytes of all.  A null is empty."""
    kind, width = (np.int64, pa.large_string()) if pa.types.is_large_string(texts.type) else (np.int32, pa.string())
    texts = texts.fill_null("").cast(width)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class Phrases:
    """Looks for many phrases of ASCII characters in texts at once."""

    def __init__(self, phrases) -> None:
        self.phrases = list(dict.fromkeys(phrases))
        self.bytes = [np.frombuffer(p.encode("ascii"), np.uint8) for p in self.phrases]
        self.kind = np.zeros(256, np.int32)
        for i, c in enumerate(sorted({int(c) for b in self.bytes for c in b}), 1):
            self.kind[c] = i
        self.wide = int(self.kind.max() + 1).bit_length()
        self.table = np.zeros(1 << 3 * self.wide, np.uint8)  # number of the first three characters, 0 for none
        self.long: dict[int, list[int]] = {}
        self.short = [k for k, b in enumerate(self.bytes) if len(b) < 3]
        for k, b in enumerate(self.bytes):
            if len(b) >= 3:
                code = self._code(b[:3])
                self.table[code] = self.table[code] or len(self.long) + 1
                self.long.setdefault(int(self.table[code]), []).append(k)

    def _code(self, b) -> int:
        out = 0
        for c in b:
            out = out << self.wide | int(self.kind[c])
        return out

    def found(self, texts: pa.Array) -> np.ndarray:
        """A row for each text, a column for each phrase: does it occur?"""
        at, data = _buffers(texts)
        out = np.zeros((len(texts), len(self.phrases)), bool)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + RUN, "right")) - 1)
            self._run(at[first : last + 1].astype(np.int64) - int(at[first]), data[at[first] : at[last]], out[first:last])
            first = last
        return out

    def _run(self, at: np.ndarray, data: np.ndarray, out: np.ndarray) -> None:
        n = len(data)
        longest = max(map(len, self.bytes))
        data = np.concatenate((data, np.zeros(longest + 3, np.uint8)))
        kind = self.kind[data[: n + 2]]
        pairs = (kind[:-1] << self.wide) | kind[1:]
        triples = self.table[(pairs[:-1] << self.wide) | kind[2:]]

        def meet(k: int, places: np.ndarray, known: int) -> None:
            b = self.bytes[k]
            for i in range(known, len(b)):
                places = places[data[places + i] == b[i]]
            rows = np.searchsorted(at, places, "right") - 1
            out[rows[places + len(b) <= at[rows + 1]], k] = True  # else it runs into the next text

        for k in self.short:
            b = self.bytes[k]
            meet(k, np.flatnonzero(data[:n] == b[0]), 1)
        places = np.flatnonzero(triples)
        numbers = triples[places]
        order = np.argsort(numbers, kind="stable")
        places, ends = places[order], np.cumsum(np.bincount(numbers, minlength=len(self.long) + 1))
        for number, phrases in self.long.items():
            some = places[ends[number - 1] : ends[number]]
            if len(some):
                for k in phrases:
                    meet(k, some, 3)


# --- dates
_A = re.ASCII
#: "updated" alone, which what ``dates`` looks at first leaves out, is no label here either.
_OTHER_LABEL = fixed.OTHER_DATE_LABEL.replace("|updated|", "|")
_ANY = f"{fixed.ISO_DATE}|{fixed.DAY_MONTH}|{fixed.MONTH_DAY}|{fixed.NUMERIC_DATE}"
_LEAD = r"(?=\d|[jfmasond][aepuco][nbrylgptvc])"
_DATE = re.compile(f"(?i){_LEAD}(?:{_ANY})", _A)
_DAY_MONTH, _MONTH_DAY, _NUMERIC = re.compile(r"(?i)(?=\d)" + fixed.DAY_MONTH, _A), re.compile(rf"(?i){_LEAD}" + fixed.MONTH_DAY, _A), re.compile(fixed.NUMERIC_DATE, _A)
_IS_ISO, _IS_NUMERIC = re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", _A), re.compile(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", _A)
_CUE, _LABEL = re.compile(f"(?i)(?=[dcasr][elpu][aopbg])(?:{fixed.DEADLINE_CUE})", _A), re.compile(f"(?i)(?:{_OTHER_LABEL})", _A)
_AFTER_STOP = re.compile(r"(?s)(?:.*(?:\. |\n|; | \| ))?(.*)")
_MONTH, _RECURS = re.compile(f"(?i){fixed.MONTHS}", _A), re.compile(fixed.RECURS, _A)
_YEAR, _DAY, _BY_ITSELF = re.compile(r"(\d{4})\Z", _A), re.compile(r"(?:^|\D)(\d{1,2})(?:st|nd|rd|th)?(?:\D|\Z)", _A), re.compile(r"^\d{4}[-/]|\d{4}\Z|[-/.]\d{2,4}\Z", _A)
_PLACE = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
_DAYS = (0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
NONE = ("", None, "unknown", 0.0)


def for_batch(pattern: str) -> str:
    """The pattern for ASCII texts of a batch."""
    return pattern.replace(r"\s", r"[\t\n\x0b\f\r ]")  # the batch's engine leaves one out


def like(text: Column, pattern: str, by_expression: Column) -> Column:
    """Does the pattern, in any case, occur in the text?  ASCII texts are looked
    at in Arrow batches, others by the expression."""
    for_ascii = for_batch(pattern)

    def met(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, for_ascii, ignore_case=True)

    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.arrow_udf(met, "boolean")(F.when(plain, text))).otherwise(by_expression)


_SOME_DATE, _SOME_LABEL, _SOME_CUE, _SOME_RECURRENCE = (for_batch(p) for p in (_ANY, _OTHER_LABEL, fixed.DEADLINE_CUE, fixed.RECURS))


def day_number(year: int, month: int, day: int) -> int | None:
    """Days since 1970-01-01, None where there is no such date."""
    if not (0 <= year <= 9999 and 1 <= month <= 12 and 1 <= day) or day > _DAYS[month] + (month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)):
        return None
    y = year - (month <= 2)
    era, of_era = divmod(y, 400)
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * ((month + 9) % 12) + 2) // 5 + day - 719469


def _year_of(days: int) -> int:
    return int(np.datetime64(days, "D").astype("datetime64[Y]").astype(int)) + 1970


def _graded(value: int | None, unresolved: bool, sureness: float, as_of: int | None) -> tuple:
    if value is None:
        return None, "unknown", sureness if unresolved else 0.0
    return value, "open" if as_of is not None and value >= as_of else "expired", sureness


def _typed(raw: str, text: str, as_of: int | None, day_first: bool, sure: float, guess: float) -> tuple:
    """value, status, confidence of a date as it stands in a text."""
    if m := _IS_ISO.fullmatch(raw):
        return _graded(day_number(*map(int, m.groups())), False, sure, as_of)
    if m := _IS_NUMERIC.fullmatch(raw):
        a, b, y = map(int, m.groups())
        certain = (a > 12 >= b) or (b > 12 >= a)
        day, month = (a, b) if (a > 12 if certain else day_first) else (b, a)
        return _graded(day_number(y + 2000 if y < 100 else y, month, day), False, sure if certain else guess, as_of)
    month, day, year = _PLACE[_MONTH.search(raw).group()[:3].lower()], _DAY.search(raw), _YEAR.search(raw)
    if day is None:
        return _graded(None, year is None, sure, as_of)
    day = int(day.group(1))
    if year is not None:
        return _graded(day_number(int(year.group(1)), month, day), False, sure, as_of)
    if not text or _RECURS.search(text) is None or _BY_ITSELF.search(raw):
        return _graded(None, True, sure, as_of)
    if as_of is None:
        return _graded(None, False, sure, as_of)
    this = _year_of(as_of)
    value = day_number(this, month, day)
    return _graded(value if value is not None and value >= as_of else day_number(this + 1, month, day), False, sure, as_of)


def _labelled(before: str) -> bool:
    w = before[-40:]
    return _LABEL.search(w) is not None and (_LABEL.search(_AFTER_STOP.match(w).group(1)) is not None or _CUE.search(w) is None)


def deadline_of(text: str, as_of: int | None, day_first: bool, some_label: bool = True) -> tuple:
    """raw, value, status, confidence of a text's deadline, as ``dates.deadline``
    reads it."""
    dates, end = [], 0
    for m in _DATE.finditer(text):
        if not (some_label and _labelled(text[end : m.start()])):
            dates.append(m.group().strip(" "))
        end = m.end()
    if not end:
        return NONE
    for raw in dates:
        if _IS_ISO.fullmatch(raw):
            return raw, *_typed(raw, text, as_of, day_first, 0.95, 0.95)
    cue = None
    for m in _CUE.finditer(text):
        cue = cue or m.group()
        w = text[m.end() : m.end() + 60]
        near = _DAY_MONTH.search(w) or _MONTH_DAY.search(w) or _NUMERIC.search(w)
        if near:
            raw = near.group().strip(" ")
            value, status, confidence = _typed(raw, w, as_of, day_first, 0.9, 0.6)
            if status != "unknown":
                return f"{cue} {raw}", value, status, 0.95 if confidence == 0.9 else 0.65
    for raw in dates:
        value, status, confidence = _typed(raw, "", as_of, day_first, 0.9, 0.6)
        if status != "unknown":
            return raw, value, status, 0.75 if confidence == 0.9 else 0.45
    return (dates[0], None, "unknown", 0.0) if dates else NONE


_NEXT, _BEFORE = for_batch(rf"(?is)(?P<raw>{_ANY})(?P<after>.*)"), for_batch(rf"(?is)^(?P<before>.*?)(?:{_ANY})")
_NEXT_CUE = for_batch(rf"(?is)(?P<cue>{fixed.DEADLINE_CUE})(?P<after>.*)")
_NEAR = tuple(for_batch(f"(?i)(?P<raw>{p})") for p in (fixed.DAY_MONTH, fixed.MONTH_DAY, fixed.NUMERIC_DATE))
_ISO_PARTS, _NUMERIC_PARTS = r"^(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})$", r"^(?P<a>\d{1,2})[-/.](?P<b>\d{1,2})[-/.](?P<y>\d{2,4})$"
#: How often a batch looks for a further date or cue; texts with more are read one by one.
ROUNDS = 5


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)


def _parts(texts: pa.Array, pattern: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Where a pattern is found, and its groups there."""
    found = pc.extract_regex(texts, pattern)
    ok = found.is_valid()
    return ok.to_numpy(zero_copy_only=False), found.filter(ok).flatten()


def _whole(numbers: pa.Array) -> np.ndarray:
    return numbers.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _rows(a: pa.Array, at: np.ndarray) -> pa.Array:
    return a.take(pa.array(at))


def _typed_batch(raw: pa.Array, texts: pa.Array | None, day_first: bool) -> tuple[np.ndarray, ...]:
    """Days, whether they are a date, whether it is sure, whether it is ISO,
    and whether the text may say that a date without year recurs."""
    n = len(raw)
    y, m, d, sure, slow = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
    iso, (years, months, days) = _parts(raw, _ISO_PARTS)
    y[iso], m[iso], d[iso] = _whole(years), _whole(months), _whole(days)
    left = np.flatnonzero(~iso)
    if len(left):
        numeric, (first, second, years) = _parts(_rows(raw, left), _NUMERIC_PARTS)
        at = left[numeric]
        first, second, years = _whole(first), _whole(second), _whole(years)
        certain = ((first > 12) & (second <= 12)) | ((second > 12) & (first <= 12))
        first_is_day = np.where(certain, first > 12, day_first)
        y[at], m[at], d[at], sure[at] = np.where(years < 100, years + 2000, years), np.where(first_is_day, second, first), np.where(first_is_day, first, second), certain
        left = left[~numeric]
    if len(left):
        words = _rows(raw, left)
        named, (months,) = _parts(words, r"(?i)(?P<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
        m[left[named]] = pc.index_in(pc.utf8_lower(months), pa.array(list(_PLACE))).to_numpy(zero_copy_only=False) + 1
        told, (days,) = _parts(words, r"(?:^|\D)(?P<d>\d{1,2})(?:st|nd|rd|th)?(?:\D|$)")
        d[left[told]] = _whole(days)
        dated, (years,) = _parts(words, r"(?P<y>\d{4})$")
        y[left[dated]] = _whole(years)
        open_ended = left[~dated]
        if texts is not None and len(open_ended):
            slow[open_ended] = _holds(_rows(texts, open_ended), _SOME_RECURRENCE)
    month = np.where((m >= 1) & (m <= 12), m, 1)
    last = np.array(_DAYS)[month] + ((month == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    good = (y >= 0) & (y <= 9999) & (m == month) & (d >= 1) & (d <= last)
    shifted = y - (month <= 2)
    era = shifted // 400
    of_era = shifted - era * 400
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * ((month + 9) % 12) + 2) // 5 + d - 719469, good, sure, iso, slow


def _labelled_batch(before: pa.Array) -> np.ndarray:
    w = pc.utf8_slice_codeunits(before, -40)
    out = _holds(w, _SOME_LABEL)
    at = np.flatnonzero(out)
    if len(at):
        some = _rows(w, at)
        near = pc.extract_regex(some, r"(?s)^(?:.*(?:\. |\n|; | \| ))?(?P<near>.*)$").field("near")
        out[at] = _holds(near, _SOME_LABEL) | ~_holds(some, _SOME_CUE)
    return out


def deadlines(texts: pa.Array, as_of: pa.Array, day_first: bool) -> pa.Array:
    """The deadlines of a batch of ASCII texts: the steps of ``deadline_of``,
    each for all texts that it still concerns."""
    n = len(texts)
    raws, sure, finished, slow = np.full(n, "", object), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    values, dated, told = np.zeros(n, np.int64), np.zeros(n, bool), as_of.is_valid().to_numpy(zero_copy_only=False)
    days = as_of.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)

    def settle(at: np.ndarray, raw, value: np.ndarray, good, confidence) -> None:
        raws[at], values[at], dated[at], sure[at], finished[at] = raw, value, good, confidence, True

    at = np.flatnonzero(_holds(texts, _SOME_DATE))
    rest = _rows(texts, at)
    label = np.zeros(n, bool)
    label[at] = _holds(rest, _SOME_LABEL)
    seen, other = np.zeros(n, bool), np.zeros(n, bool)  # texts with a date that is no ISO date, and those where one is settled
    first, other_raw, other_value, other_sure = np.full(n, "", object), np.full(n, "", object), np.zeros(n, np.int64), np.zeros(n, bool)
    every = at
    for _ in range(ROUNDS):
        here, (raw, after) = _parts(rest, _NEXT)
        rest, at = rest.filter(pa.array(here)), at[here]
        kept = np.ones(len(at), bool)
        near_label = np.flatnonzero(label[at])
        if len(near_label):
            kept[near_label] = ~_labelled_batch(pc.extract_regex(_rows(rest, near_label), _BEFORE).field("before"))
        raw = pc.utf8_trim(raw, " ")
        value, good, certain, iso, _ = _typed_batch(raw, None, day_first)
        raw = raw.to_numpy(zero_copy_only=False)
        x = kept & iso
        settle(at[x], raw[x], value[x], good[x], np.where(good[x], 0.95, 0.0))
        x = kept & ~iso & ~seen[at]
        first[at[x]], seen[at[x]] = raw[x], True
        x = kept & ~iso & good & ~other[at]
        other_raw[at[x]], other_value[at[x]], other_sure[at[x]], other[at[x]] = raw[x], value[x], certain[x], True
        more = ~finished[at]
        rest, at = after.filter(pa.array(more)), at[more]
        if not len(at):
            break
    slow[at[_holds(rest, _SOME_DATE)]] = True

    at = every[~finished[every] & ~slow[every]]
    rest = _rows(texts, at)
    cues = np.full(n, None, object)
    for _ in range(ROUNDS):
        here, (cue, after) = _parts(rest, _NEXT_CUE)
        at = at[here]
        x = np.equal(cues[at], None)
        cues[at[x]] = cue.to_numpy(zero_copy_only=False)[x]
        w = pc.utf8_slice_codeunits(after, 0, 60)
        left = np.arange(len(at))
        for pattern in _NEAR:
            met, (raw,) = _parts(_rows(w, left), pattern)
            if met.any():
                at_met = left[met]
                raw = pc.utf8_trim(raw, " ")
                value, good, certain, _, unclear = _typed_batch(raw, _rows(w, at_met), day_first)
                slow[at[at_met[unclear]]] = True
                x = good & ~unclear
                to = at[at_met[x]]
                settle(to, cues[to] + " " + raw.to_numpy(zero_copy_only=False)[x], value[x], True, np.where(certain[x], 0.95, 0.65))
                left = left[~met]
            if not len(left):
                break
        more = ~finished[at] & ~slow[at]
        rest, at = after.filter(pa.array(more)), at[more]
        if not len(at):
            break
    slow[at[_holds(rest, _SOME_CUE)]] = True

    at = every[~finished[every] & ~slow[every]]
    x = at[other[at]]
    settle(x, other_raw[x], other_value[x], True, np.where(other_sure[x], 0.75, 0.45))
    x = at[~other[at]]
    raws[x] = first[x]
    states = np.where(dated, np.where(told & (values >= days), "open", "expired"), "unknown").astype(object)
    for i in np.flatnonzero(slow).tolist():
        raws[i], value, states[i], sure[i] = deadline_of(texts[i].as_py(), int(days[i]) if told[i] else None, day_first, bool(label[i]))
        dated[i], values[i] = value is not None, value or 0
    parts = (pa.array(raws, pa.string()), pa.array(values.astype(np.int32), mask=~dated).cast(pa.date32()), pa.array(states, pa.string()), pa.array(sure))
    return pa.StructArray.from_arrays(parts, ["raw", "value", "status", "confidence"])
