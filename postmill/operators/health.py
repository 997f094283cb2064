"""Probe verdicts and the freshness of listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.numbering import numbered


def classify_probe(status: Column, n_bytes: Column, links: Column, error: Column) -> Column:
    """struct(verdict, reason) of a source from its probe; an unresolved name
    first, then the status, then how much the page offers."""

    def told(verdict: str, *reason) -> Column:
        words = F.concat(*(r.cast("string") if isinstance(r, Column) else F.lit(r) for r in reason))
        return F.struct(F.lit(verdict).alias("verdict"), words.alias("reason"))

    size, found = F.coalesce(n_bytes, F.lit(0)), F.coalesce(links, F.lit(0))
    return (
        F.when(F.lower(error).contains("resolve"), told("dns_blocked", "Domain does not resolve from this network"))
        .when(status == 403, told("cloudflare_403", "Site healthy, bot blocked — needs Playwright"))
        .when(status >= 500, told("server_error", "Upstream returned ", status))
        .when((status == 200) & (found >= 3), told("crawlable", "200 OK, ", found, " candidate links"))
        .when((status == 200) & (size > 50_000), told("crawlable_spa", "200 OK with content, but no listing links in raw HTML (SPA)"))
        .when(status == 200, told("thin", "200 OK but only ", size, " bytes — likely a redirect shell"))
        .when(F.coalesce(status, F.lit(0)) != 0, told("redirect_or_error", "HTTP ", status))
        .otherwise(told("failed", F.when(F.coalesce(error, F.lit("")) == "", "no response").otherwise(error)))
    )


STATES = ("rolling", "open", "expired", "unknown")


def page_counts(listing: DataFrame) -> DataFrame:
    """Postings of each page (source, page_no) by their status, and what that
    makes of the page."""
    c = F.col
    counts = listing.groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c("status") == s).alias(s) for s in STATES))
    return counts.withColumns({"has_live": (c("open") > 0) | (c("rolling") > 0), "all_expired": c("expired") == c("total")})


def stop_after(listing: DataFrame, run: int = 4) -> DataFrame:
    """source, stop_after: the first page that ends ``run`` all-expired pages
    in a row; ``listing``: source, page_no (without gaps), all_expired.

    Expired pages in a row are those whose number less their number among the
    expired ones is the same; a row's pages are then an aggregate.
    """
    stale = numbered(listing.where("all_expired").select("source", "page_no"), "page_no", keys=("source",), name="nth")
    rows = stale.groupBy("source", (F.col("page_no") - F.col("nth")).alias("island")).agg(F.min("page_no").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= run).groupBy("source").agg((F.min("first") + run - 1).alias("stop_after"))
