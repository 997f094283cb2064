"""Deadline extraction and date arithmetic as Column expressions.

``deadline`` reads a text in three tries, the first that gives a date or a
status wins: an ISO date that no posting-date label precedes; the first date
within sixty characters of a deadline cue; any other date without such a
label.  Year-less dates stay unknown unless the text says they recur.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import fixed, scan

_MONTHS, _CUE, _LABEL, _ISO, _DMY, _MDY, _NUM, _RECURS, _ROLLING = fixed.MONTHS, fixed.DEADLINE_CUE, fixed.OTHER_DATE_LABEL, fixed.ISO_DATE, fixed.DAY_MONTH, fixed.MONTH_DAY, fixed.NUMERIC_DATE, fixed.RECURS, fixed.ROLLING
KIND = "struct<raw:string,value:date,status:string,confidence:double>"


def is_rolling(text: Column) -> Column:
    return scan.like(text, _ROLLING, text.rlike("(?i)(?=[rouna][opns])" + _ROLLING))


def days_left(value: Column, as_of: Column) -> Column:
    return F.datediff(value, as_of)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null where it is impossible; the parts should be cheap
    references.  Checked by numbers, since a text that is no date costs an
    exception."""
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(year.between(0, 9999) & month.between(1, 12) & (day >= 1), F.when((day <= 28) | (day <= last), F.make_date(year, month, day)))


def _number(text: Column, pattern: str, group: int) -> Column:
    return bind(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x.try_cast("int")))  # no number costs an exception


def _month(text: Column) -> Column:
    short = F.lower(F.left(F.regexp_extract(text, rf"(?i)({_MONTHS})", 1), F.lit(3)))
    place = F.position(short, F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.when((short != "") & (place > 0), (place + 2) / 3).cast("int")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.
    The one element is taken by ``array_max``: ``get`` would derive the type
    of the whole expression again for each row."""
    return F.array_max(F.transform(F.array(value), use))


def typed(raw: Column, text: Column, as_of: Column, day_first: bool, sure: float, guess: float) -> Column:
    """A matched date as (raw, value, status, confidence); null for no match.
    ``raw``, ``text`` and ``as_of`` should be cheap references."""
    dated_by_itself = raw.rlike(r"^\d{4}[-/]|\d{4}$|[-/.]\d{2,4}$")  # whether it recurs does not matter then
    never = F.lit(False).alias("recurs")

    # each kind of date looks for its own parts only
    numbers = F.struct(_number(raw, r"^(\d{1,2})\D", 1).alias("a"), _number(raw, r"^\d{1,2}\D(\d{1,2})", 1).alias("b"), _number(raw, r"(\d{2,4})$", 1).alias("y"))
    by_iso = F.struct(
        _number(raw, r"^(\d{4})", 1).alias("year"), _number(raw, r"^\d{4}\D(\d{1,2})", 1).alias("month"), _number(raw, r"(\d{1,2})$", 1).alias("day"), F.lit(sure).alias("sureness"), never,
    )

    def by_numbers(n: Column) -> Column:
        certain = ((n["a"] > 12) & (n["b"] <= 12)) | ((n["b"] > 12) & (n["a"] <= 12))
        day_is_a = F.when((n["a"] > 12) & (n["b"] <= 12), True).when((n["b"] > 12) & (n["a"] <= 12), False).otherwise(F.lit(day_first))
        return F.struct(
            F.when(n["y"] < 100, n["y"] + 2000).otherwise(n["y"]).alias("year"), F.when(day_is_a, n["b"]).otherwise(n["a"]).alias("month"), F.when(day_is_a, n["a"]).otherwise(n["b"]).alias("day"),
            F.when(~F.coalesce(certain, F.lit(False)), F.lit(guess)).otherwise(F.lit(sure)).alias("sureness"), never,
        )

    def by_words(year: Column) -> Column:
        return F.struct(
            year.alias("year"), _month(raw).alias("month"), _number(raw, r"(?:^|\D)(\d{1,2})(?:st|nd|rd|th)?(?:\D|$)", 1).alias("day"), F.lit(sure).alias("sureness"),
            (year.isNull() & ~dated_by_itself & text.rlike(_RECURS)).alias("recurs"),
        )

    parts = F.when(raw.rlike(rf"^{_ISO}$"), by_iso).when(raw.rlike(rf"^{_NUM}$"), bind(numbers, by_numbers)).otherwise(bind(_number(raw, r"(\d{4})$", 1), by_words))

    def dated(p: Column) -> Column:
        this_year = safe_date(F.year(as_of), p["month"], p["day"])
        implied = bind(this_year, lambda d: F.when(d >= as_of, d).otherwise(safe_date(F.year(as_of) + 1, p["month"], p["day"])))
        value = F.when(p["year"].isNotNull(), safe_date(p["year"], p["month"], p["day"])).when(p["recurs"], implied)
        return F.struct(value.alias("value"), (p["year"].isNull() & ~p["recurs"]).alias("unresolved"), p["sureness"].alias("sureness"))

    def result(v: Column) -> Column:
        status = F.when(v["value"].isNull(), F.lit("unknown")).when(v["value"] >= as_of, F.lit("open")).otherwise(F.lit("expired"))
        confidence = F.when(v["value"].isNull() & ~v["unresolved"], F.lit(0.0)).otherwise(v["sureness"])
        return F.struct(raw.alias("raw"), v["value"].alias("value"), status.alias("status"), confidence.alias("confidence"))

    return F.when(raw.isNotNull() & (raw != ""), bind(bind(parts, dated), result))


def _labelled(before: Column) -> Column:
    """Does a posting-date label stand in the forty characters before a date,
    after the last sentence stop (or before it, where no cue follows)?"""
    window = F.right(before, F.lit(40))

    def stands(w: Column) -> Column:
        near = F.regexp_extract(w, r"(?s)(?:.*(?:\. |\n|; | \| ))?(.*)$", 1)
        return w.rlike(_ANY_LABEL) & (near.rlike(_ANY_LABEL) | ~w.rlike(_ANY_CUE))

    return bind(window, stands)


# what a match can begin with is looked at first: most places of a text are left after one or two characters
_ANY_CUE, _ANY_LABEL = f"(?i)(?=[dcasr][elpu][aopbg])({_CUE})", f"(?i)(?=[dpaculse][adlourtn])({_LABEL})"
_DATE = rf"(?i)(?=\d|[jfmasond][aepuco][nbrylgptvc])\b(?:{_ISO}|{_DMY}|{_MDY}|{_NUM})"


def _placed(raws: Column, text: Column) -> Column:
    gaps = F.regexp_extract_all(text, F.lit(rf"\G([\s\S]*?){_DATE}"), F.lit(1))  # split would compile its pattern for each row; \G keeps what follows the last date linear
    return F.transform(raws, lambda raw, i: F.struct(F.trim(raw).alias("raw"), F.get(gaps, i).alias("before")))


def all_dates(text: Column) -> Column:
    """Dates in order of position, none overlapping, as array<struct<raw,
    before>>; ``before`` is the text up to the date."""
    return _placed(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)), text)


def _day_first(texts: pa.Array, as_of: pa.Array) -> pa.Array:
    return scan.deadlines(texts, as_of, True)


def _month_first(texts: pa.Array, as_of: pa.Array) -> pa.Array:
    return scan.deadlines(texts, as_of, False)


def deadline(text: Column, as_of: Column, day_first: bool = True) -> Column:
    """Application deadline of a text, a cheap reference: struct(raw, value,
    status, confidence).  ASCII texts are read in Arrow batches, others, whose
    letters bound words differently, by expressions."""
    plain = F.octet_length(text) == F.length(text)
    by_batch = F.arrow_udf(_day_first if day_first else _month_first, KIND)(F.when(plain, text), as_of)
    return F.when(plain, by_batch).otherwise(deadline_by_expressions(text, as_of, day_first))


def deadline_by_expressions(text: Column, as_of: Column, day_first: bool = True) -> Column:
    """``deadline`` of any text.  Each step looks at it only where those before
    it settled nothing: a text without a date is done after one pattern."""
    none = F.struct(F.lit("").alias("raw"), F.lit(None).cast("date").alias("value"), F.lit("unknown").alias("status"), F.lit(0.0).alias("confidence"))

    def first_settled(results: Column) -> Column:
        return bind(results, lambda all_of: F.get(F.filter(all_of, lambda d: d["status"] != "unknown"), F.lit(0)))

    def near_cue(w: Column) -> Column:
        part = lambda pattern: F.nullif(F.trim(F.regexp_extract(w, pattern, 0)), F.lit(""))
        return bind(F.coalesce(part(f"(?i){_DMY}"), part(f"(?i){_MDY}"), part(_NUM)), lambda raw: typed(raw, w, as_of, day_first, 0.9, 0.6))

    def graded(d: Column, raw: Column, confidence: Column) -> Column:
        return F.when(d.isNotNull(), F.struct(raw.alias("raw"), d["value"].alias("value"), d["status"].alias("status"), confidence.alias("confidence")))

    def best(dates: Column) -> Column:
        is_iso = lambda d: d["raw"].rlike(rf"^{_ISO}$")
        by_iso = bind(F.get(F.filter(dates, is_iso), F.lit(0)), lambda d: bind(d["raw"], lambda raw: typed(raw, text, as_of, day_first, 0.95, 0.95)))
        cue, windows = F.regexp_extract(text, _ANY_CUE, 0), F.regexp_extract_all(text, F.lit(f"(?s){_ANY_CUE}(?=(.{{0,60}}))"), F.lit(2))
        by_cue = bind(first_settled(F.transform(windows, near_cue)), lambda d: graded(d, F.concat_ws(" ", cue, d["raw"]), F.least(F.round(d["confidence"] + 0.05, 2), F.lit(1.0))))
        spoken = lambda raw: F.when(raw.rlike(r"^[\d/.-]+$"), text).otherwise(F.lit(""))
        plain = F.transform(dates, lambda d: bind(d["raw"], lambda raw: typed(raw, spoken(raw), as_of, day_first, 0.9, 0.6)))
        by_any = bind(first_settled(plain), lambda d: graded(d, d["raw"], F.greatest(F.round(d["confidence"] - 0.15, 2), F.lit(0.3))))
        unresolved = F.when(F.size(dates) > 0, F.struct(F.get(dates, F.lit(0))["raw"].alias("raw"), F.lit(None).cast("date").alias("value"), F.lit("unknown").alias("status"), F.lit(0.0).alias("confidence")))
        return F.coalesce(by_iso, by_cue, by_any, unresolved, none)

    def unlabelled(raws: Column) -> Column:
        """Where no label stands anywhere, none stands before a date."""
        placed = F.filter(_placed(raws, text), lambda d: ~_labelled(d["before"]))
        all_of = F.transform(raws, lambda raw: F.struct(F.trim(raw).alias("raw"), F.lit("").alias("before")))
        return F.when(F.size(raws) > 0, bind(F.when(text.rlike(_ANY_LABEL), placed).otherwise(all_of), best)).otherwise(none)

    return F.when(text.rlike("[0-9]"), bind(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)), unlabelled)).otherwise(none)


def deadline_line(status: Column, value: Column, as_of: Column) -> Column:
    """What a reader is told about a deadline."""
    left = days_left(value, as_of)
    return (
        F.when(status == "rolling", F.lit("Rolling"))
        .when(value.isNull(), F.lit("Not stated"))
        .when(left < 0, F.lit("Closed"))
        .when(left <= 14, F.concat(F.lit("Urgent: "), left.cast("string"), F.lit(" days left")))
        .otherwise(F.concat(left.cast("string"), F.lit(" days left")))
    )


def freshness_decay(age_days: Column, half_life: float = 30.0) -> Column:
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.exp(-age_days / F.lit(half_life)))


def cache_age_days(fetched_at: Column, now: Column) -> Column:
    """Whole days since a fetch, -1 when never fetched."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(fetched_at)
    return F.coalesce(F.floor(seconds / 86_400).cast("int"), F.lit(-1))


#: Formats of stated dates: day first, with four or two digits of the year.
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy")


#: What a text must look like to be a date in a format at all: a format that
#: does not fit costs an exception, so it is tried only where it may.
_SHAPES = {
    "d/M/yyyy": r"^\d+/\d+/[+-]?\d{4,}$", "d-M-yyyy": r"^\d+-\d+-[+-]?\d{4,}$", "d/M/yy": r"^\d+/\d+/\d\d$", "d-M-yy": r"^\d+-\d+-\d\d$",
    "yyyy-M-d": r"^[+-]?\d{4,}-\d+-\d+$", "d MMM yyyy": r"^\d+ [A-Za-z]{3} [+-]?\d{4,}$", "d MMMM yyyy": r"^\d+ (?:(?i:may)|[A-Za-z]{4,}) [+-]?\d{4,}$",
}


def date_by_formats(text: Column, formats=DAY_FIRST) -> Column:
    """A date in the first of the formats that fits; two-digit years are 1969
    to 2068."""

    def read(one: Column, form: str) -> Column:
        found = F.try_to_date(one, form)
        if form.endswith(("/yy", "-yy")):
            found = bind(found, lambda d: F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d))
        return F.when(one.rlike(_SHAPES[form]), found) if form in _SHAPES else found

    return bind(F.regexp_replace(F.trim(text), r"\s+", " "), lambda one: F.coalesce(*(read(one, form) for form in formats)))


def stated_deadline(text: Column, patterns=fixed.STATED_DEADLINES, formats=DAY_FIRST) -> Column:
    """The date of the first pattern whose match is a date in one of the
    formats, null without one."""
    found = (F.regexp_extract(text, fixed.rule(p), 1) for p in patterns)
    return F.when(text.rlike("[0-9]"), F.coalesce(*(date_by_formats(x, formats) for x in found)))  # the formats read these digits only


def element_deadline(text: Column) -> Column:
    """The deadline in the text of an element that holds one."""
    return stated_deadline(text, fixed.BARE_DEADLINES, ("d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d"))


def listed_deadline(text: Column) -> Column:
    """The deadline that a listing card prints, as it prints it."""
    return F.trim(F.regexp_extract(text, fixed.rule(fixed.LISTED_DEADLINE), 1))
