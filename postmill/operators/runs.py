"""Crawl runs merged: summaries, cache state, coverage of the registry.

All choices among the runs of a source are ``min_by`` / ``max_by`` aggregates,
so a source with any share of the rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed

C = F.col


def merged_summary(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per source that any of the ``runs`` (run, source, n, method,
    note, status) lists.  A source with rows in ``merged`` (source) has their
    number as n, method and note of the first run that saw rows (where that has
    them), the first status that any run tells, and the names of all runs that
    saw rows; any other stays as its first run tells."""
    saw = C("n") > 0
    told = lambda name: F.coalesce(F.nullif(F.min_by(name, F.when(saw, C("run"))), F.lit("")), F.min_by(name, "run"))
    per = runs.groupBy("source").agg(
        F.min_by(F.struct("n", "method", "note", F.coalesce("status", F.lit("")).alias("status")), "run").alias("first"), told("method").alias("method"), told("note").alias("note"), F.coalesce(F.min_by("status", F.when(C("status").isNotNull(), C("run"))), F.lit("")).alias("status"),
        F.array_sort(F.collect_set(F.when(saw, C("run")))).alias("merged_from"),
    )
    counts = merged.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    live = C("rows").isNotNull()
    either = lambda name: F.when(live, C(name)).otherwise(C(f"first.{name}")).alias(name)
    return per.join(counts, "source", "left").select(
        "source", F.coalesce("rows", "first.n").cast("long").alias("n"), either("method"), either("note"), either("status"), F.when(live, C("merged_from")).otherwise(F.array().cast("array<string>")).alias("merged_from")
    )


def cache_state(runs: DataFrame) -> DataFrame:
    """What a cache holds of each source after all ``runs`` (run, source, n,
    note, at): the newest run that returned rows, and the last failure since."""
    good = F.max(F.when(C("n") > 0, F.struct("at", "n"))).alias("good")
    bad = F.max(F.when(C("n") <= 0, F.struct("at", "note"))).alias("bad")
    held = runs.groupBy("source").agg(good, bad)
    since = C("good").isNull() | (C("bad.at") > C("good.at"))
    return held.select(
        "source", C("good.at").alias("fetched_at"), F.coalesce("good.n", F.lit(0)).cast("long").alias("count"), F.when(since, C("bad.note")).alias("last_error"), F.when(since & C("good").isNotNull(), C("bad.at")).alias("last_error_at")
    )


def cache_stats(state: DataFrame) -> DataFrame:
    """Sources tracked, those with data, those that never succeeded, and all
    rows held; one row."""
    never = C("fetched_at").isNull()
    return state.agg(
        F.count(F.lit(1)).alias("sources_tracked"), F.count_if(C("count") > 0).alias("sources_with_data"), F.array_sort(F.collect_list(F.when(never, C("source")))).alias("sources_never_succeeded"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_cached_positions"),
    )


def coverage(sources: DataFrame, runs: DataFrame, health: DataFrame) -> DataFrame:
    """The registry beside each source's last crawl and last probe; either may
    be missing.  ``runs``: source, at, n, note; ``health``: name, at,
    http_status, http_bytes; ``sources``: name, label, is_board, status,
    needs_browser, verify_tls, url, search_url."""
    last = runs.groupBy("source").agg(F.max_by(F.struct("n", "note"), "at").alias("hit"))
    probe = health.groupBy(C("name").alias("probed")).agg(F.max_by(F.struct("http_status", "http_bytes"), "at").alias("seen"))
    status = F.coalesce("status", F.lit("unknown"))
    reasons = F.create_map(*(F.lit(x) for pair in fixed.COVERAGE_REASONS.items() for x in pair))
    tls = F.coalesce("verify_tls", F.lit(True))
    rows = sources.join(last, C("name") == C("source"), "left").join(probe, C("name") == C("probed"), "left")
    return rows.select(
        "name", F.coalesce("label", "name").alias("label"), F.when(C("is_board"), "job_board").otherwise("not_a_board").alias("kind"), status.alias("status"), F.coalesce(F.try_element_at(reasons, status), status).alias("status_reason"),
        F.when(C("needs_browser"), fixed.REACHED_BY_BROWSER).when(tls, fixed.REACHED_BY_HTTP).otherwise(F.lit(fixed.REACHED_BY_HTTP + " (TLS exception)")).alias("reach"), tls.alias("tls_verify"),
        F.coalesce("hit.n", F.lit(0)).cast("long").alias("last_returned"), F.coalesce("hit.note", F.lit("")).alias("last_note"), C("seen.http_status").alias("http_status"), C("seen.http_bytes").alias("bytes"),
        F.coalesce(F.nullif("search_url", F.lit("")), "url", F.lit("")).alias("url"),
    )


def coverage_totals(rows: DataFrame, postings: Column) -> DataFrame:
    """Counts over ``coverage``; a board is silent where it was crawled,
    returned nothing and was not skipped."""
    board = C("kind") == "job_board"
    return rows.agg(
        F.count(F.lit(1)).alias("sources_in_registry"), F.count_if(board).alias("job_boards"), F.count_if(~board).alias("not_job_boards"), F.count_if(board & (C("last_returned") > 0)).alias("boards_returning_data"),
        F.count_if(board & (C("last_returned") == 0) & (C("last_note") != "skipped")).alias("boards_returning_nothing"), F.max(postings).alias("distinct_postings_found"),
    )


def unregistered(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources that runs list and the registry does not, with their runs."""
    return runs.groupBy("source").agg(F.count(F.lit(1)).alias("runs")).join(sources.select(C("name").alias("source")), "source", "left_anti")
