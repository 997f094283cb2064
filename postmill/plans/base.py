"""How queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from postmill.sources.postings import POSTINGS_ORACLE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: As-of date of all registered queries.
AS_OF = "1998-06-01"


def query(name: str, sql: str | None = None, postings: bool = True):
    """Register ``f(spark, sf_dir)``; ``sql`` may read the postings as ``p``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH p AS ({POSTINGS_ORACLE})\n{sql}" if postings else sql
        return f

    return add


def sql_list(terms) -> str:
    """Words as a DuckDB list."""
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def sql_hits(text: str, terms) -> str:
    """How many of the words a text holds, in DuckDB."""
    return f"len(list_filter({sql_list(terms)}, lambda x: contains({text}, x)))"


def sql_like(text: str, pattern: str, flags: str = "(?i)") -> str:
    """Whether a pattern occurs in a text, in DuckDB."""
    return "regexp_matches(" + text + ", '" + (flags + pattern).replace("'", "''") + "')"


def sql_first(text: str, table, default: str) -> str:
    """The first entry of (value, words) of which a text holds a word, in
    DuckDB."""
    rows = ", ".join("{'k': '" + k + "', 'w': " + sql_list(w) + "}" for k, w in table)
    return f"coalesce(list_filter([{rows}], lambda e: len(list_filter(e.w, lambda x: contains({text}, x))) > 0)[1].k, '{default}')"
