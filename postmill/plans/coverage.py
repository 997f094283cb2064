"""Queries of crawl runs, their cache and the coverage of a registry.

Runs come from the events: a run is five days of them, a source a class of
users, its rows the purchases.  Nations are the registry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.operators import runs
from postmill.plans.base import query
from postmill.sources.postings import table

C = F.col


def _seen(spark, d):
    """Events with their run and source; purchases are postings."""
    e = table(spark, d, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return e.select(
        "event_id", "ts", "event_type", "value", "user_id", F.concat(F.lit("src"), (C("user_id") % 31).cast("string")).alias("source"), F.concat(F.lit("run"), F.lpad(F.floor(day / 5).cast("string"), 2, "0")).alias("run"),
        ((C("event_type") == "purchase") & (C("user_id") % 31 != 4) & (C("user_id") % 31 + F.floor(day / 5) != 11)).alias("is_row"),
    )


def _runs(seen):
    per = seen.groupBy("run", "source").agg(F.count_if("is_row").alias("n"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("all_n"))
    even = C("all_n") % 2 == 0
    return per.select("run", "source", "n", "at", F.when(even, "http").when(C("all_n") % 3 == 0, "").otherwise("browser").alias("method"), F.when(C("n") == 0, "timed out").otherwise(F.concat(F.lit("ok "), "run")).alias("note"), F.when(even, "verified_200").alias("status"))


_RUNS = """
WITH s AS (SELECT *, 'src' || CAST(user_id % 31 AS VARCHAR) AS source, (CAST(ts AS DATE) - DATE '2024-01-01') // 5 AS k FROM events),
x AS (SELECT *, 'run' || printf('%02d', k) AS run, event_type = 'purchase' AND user_id % 31 <> 4 AND user_id % 31 + k <> 11 AS is_row FROM s),
q AS (SELECT run, source, count(*) FILTER (is_row) AS n, max(ts) AS ended, count(*) AS all_n FROM x GROUP BY run, source),
r AS (SELECT run, source, n, ended, CASE WHEN all_n % 2 = 0 THEN 'http' WHEN all_n % 3 = 0 THEN '' ELSE 'browser' END AS method, CASE WHEN n = 0 THEN 'timed out' ELSE 'ok ' || run END AS note, CASE WHEN all_n % 2 = 0 THEN 'verified_200' END AS status FROM q)
"""


@query("j13_run_merge", _RUNS + """,
m AS (SELECT source, count(*) AS c FROM (SELECT DISTINCT source, user_id, floor(value) AS v FROM x WHERE is_row) GROUP BY source),
f AS (SELECT source, arg_min(n, run) AS n, arg_min(method, run) AS method, arg_min(note, run) AS note, arg_min(coalesce(status, ''), run) AS status1, arg_min(method, run) FILTER (n > 0) AS method2, arg_min(note, run) FILTER (n > 0) AS note2, string_agg(run, ',' ORDER BY run) FILTER (n > 0) AS names FROM r GROUP BY source),
z AS (SELECT source, arg_min(status, run) FILTER (status IS NOT NULL) AS status FROM r GROUP BY source)
SELECT source, coalesce(c, f.n) AS n, CASE WHEN c IS NULL THEN method ELSE coalesce(nullif(method2, ''), method) END AS method, CASE WHEN c IS NULL THEN note ELSE coalesce(nullif(note2, ''), note) END AS note,
       CASE WHEN c IS NULL THEN status1 ELSE coalesce(status, '') END AS status, CASE WHEN c IS NULL THEN '' ELSE coalesce(names, '') END AS merged_from
FROM f JOIN z USING (source) LEFT JOIN m USING (source)
""", postings=False)
def run_merge(spark, d):
    """Six runs and their merged postings, the purchases by user and price."""
    seen = _seen(spark, d)
    merged = seen.where("is_row").select("source", "user_id", F.floor("value").alias("v")).distinct()
    return runs.merged_summary(_runs(seen), merged).withColumn("merged_from", F.array_join("merged_from", ","))


@query("g09_cache_stats", _RUNS + """,
g AS (SELECT source, max(ended) FILTER (n > 0) AS fetched_at, arg_max(n, ended) FILTER (n > 0) AS n FROM r GROUP BY source)
SELECT count(*) AS sources_tracked, count(*) FILTER (n > 0) AS sources_with_data, coalesce(string_agg(source, ',' ORDER BY source) FILTER (fetched_at IS NULL), '') AS sources_never_succeeded, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_cached_positions FROM g
""", postings=False)
def cache_stats(spark, d):
    return runs.cache_stats(runs.cache_state(_runs(_seen(spark, d)))).withColumn("sources_never_succeeded", F.array_join("sources_never_succeeded", ","))


@query("j01_cache_state", _RUNS + """,
g AS (SELECT source, max(ended) FILTER (n > 0) AS fetched_at, coalesce(arg_max(n, ended) FILTER (n > 0), 0) AS n, max(ended) FILTER (n = 0) AS bad FROM r GROUP BY source)
SELECT source, CAST(fetched_at AS VARCHAR) AS fetched_at, n AS count, CASE WHEN fetched_at IS NULL OR bad > fetched_at THEN 'timed out' END AS last_error, CAST(CASE WHEN bad > fetched_at THEN bad END AS VARCHAR) AS last_error_at FROM g
""", postings=False)
def cache_state(spark, d):
    return runs.cache_state(_runs(_seen(spark, d))).withColumns({c: C(c).cast("string") for c in ("fetched_at", "last_error_at")})


_STATUSES = (*fixed.COVERAGE_REASONS, "new")


def _registry(spark, d):
    n, k = table(spark, d, "nation"), C("n_nationkey")
    at = F.element_at(F.array(*map(F.lit, _STATUSES)), (k % len(_STATUSES)).cast("int") + 1)
    return n.select(
        F.concat(F.lit("src"), k.cast("string")).alias("name"), F.when(k % 3 != 0, C("n_name")).alias("label"), (k % 4 != 0).alias("is_board"), F.when(k % 7 != 0, at).alias("status"), (k % 5 == 0).alias("needs_browser"),
        F.when(k % 6 == 1, False).alias("verify_tls"), F.concat(F.lit("https://"), "n_name").alias("url"), F.when(k % 2 == 0, F.concat(F.lit("https://"), "n_name", F.lit("/jobs"))).otherwise("").alias("search_url"),
    )


def _health(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(F.concat(F.lit("src"), (C("user_id") % 20).cast("string")).alias("name"), C("ts").alias("at"), F.when(C("value") > 100, 403).otherwise(200).alias("http_status"), F.floor("value").cast("long").alias("http_bytes"))


_COVERAGE = _RUNS + ", t(status, reason, k) AS (VALUES " + ", ".join(f"('{s}', '{fixed.COVERAGE_REASONS.get(s, s)}', {i})" for i, s in enumerate(_STATUSES)) + f"""),
reg AS (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS name, n_nationkey AS k, n_name FROM nation),
l AS (SELECT source, arg_max(n, ended) AS n, arg_max(note, ended) AS note FROM r GROUP BY source),
h AS (SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS name, arg_max(CASE WHEN value > 100 THEN 403 ELSE 200 END, ts) AS http_status, arg_max(CAST(floor(value) AS BIGINT), ts) AS bytes FROM events WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT reg.name, CASE WHEN reg.k % 3 <> 0 THEN n_name ELSE reg.name END AS label, CASE WHEN reg.k % 4 <> 0 THEN 'job_board' ELSE 'not_a_board' END AS kind, CASE WHEN reg.k % 7 <> 0 THEN t.status ELSE 'unknown' END AS status,
    CASE WHEN reg.k % 7 <> 0 THEN t.reason ELSE 'Not yet probed' END AS status_reason, CASE WHEN reg.k % 5 = 0 THEN '{fixed.REACHED_BY_BROWSER}' WHEN reg.k % 6 = 1 THEN '{fixed.REACHED_BY_HTTP} (TLS exception)' ELSE '{fixed.REACHED_BY_HTTP}' END AS reach,
    reg.k % 6 <> 1 AS tls_verify, coalesce(l.n, 0) AS last_returned, coalesce(l.note, '') AS last_note, http_status, bytes, 'https://' || n_name || CASE WHEN reg.k % 2 = 0 THEN '/jobs' ELSE '' END AS url
  FROM reg JOIN t ON t.k = reg.k % {len(_STATUSES)} LEFT JOIN l ON l.source = reg.name LEFT JOIN h ON h.name = reg.name)
"""


@query("j03_coverage", _COVERAGE + "SELECT * FROM c", postings=False)
def coverage(spark, d):
    """Sources without a crawl or a probe, and crawls without a source."""
    return runs.coverage(_registry(spark, d), _runs(_seen(spark, d)), _health(spark, d))


@query("g05_coverage_totals", _COVERAGE + """
SELECT count(*) AS sources_in_registry, count(*) FILTER (kind = 'job_board') AS job_boards, count(*) FILTER (kind <> 'job_board') AS not_job_boards, count(*) FILTER (kind = 'job_board' AND last_returned > 0) AS boards_returning_data,
       count(*) FILTER (kind = 'job_board' AND last_returned = 0 AND last_note <> 'skipped') AS boards_returning_nothing, (SELECT count(*) FROM (SELECT DISTINCT source, user_id, floor(value) FROM x WHERE is_row)) AS distinct_postings_found FROM c
""", postings=False)
def coverage_totals(spark, d):
    seen = _seen(spark, d)
    found = seen.where("is_row").select("source", "user_id", F.floor("value").alias("v")).distinct().count()
    return runs.coverage_totals(runs.coverage(_registry(spark, d), _runs(seen), _health(spark, d)), F.lit(found))


@query("j03_unregistered", _RUNS + "SELECT source, count(*) AS runs FROM r WHERE source NOT IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation) GROUP BY source", postings=False)
def unregistered(spark, d):
    return runs.unregistered(_registry(spark, d), _runs(_seen(spark, d)))
