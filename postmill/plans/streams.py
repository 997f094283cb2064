"""Streaming queries: the events table arrives in files, micro-batch by
micro-batch, with state and watermarks; what the stream has given when all has
arrived is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators.numbering import numbered
from postmill.plans.base import query
from postmill.sources.postings import CRAWL_LOGS_ORACLE, crawl_logs, table
from postmill.streaming import jobs

C = F.col

#: Longer than the events span: no row is late, so that SQL gives the same.
SPAN = "40 days"


def _stamped(logs):
    return logs.withColumn("started_at", C("started_at").cast("timestamp"))


@query("t01_last_good", "WITH l AS (" + CRAWL_LOGS_ORACLE + """),
g AS (SELECT source, max(started_at) FILTER (success) AS fetched_at, arg_max(CAST(floor(duration_ms) AS BIGINT), started_at) FILTER (success) AS n, max(started_at) FILTER (NOT success) AS bad FROM l GROUP BY source)
SELECT source, CAST(fetched_at AS VARCHAR) AS fetched_at, coalesce(n, 0) AS n, CASE WHEN bad > fetched_at OR fetched_at IS NULL THEN 'timed out' END AS last_error,
       fetched_at IS NULL OR fetched_at < TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR AS stale
FROM g
""", postings=False)
def last_good(spark, d):
    """The cache that never loses a source's last good run, as state."""
    logs = _stamped(crawl_logs(spark, d))
    runs = logs.select("event_id", "source", "started_at", "success", F.when(C("success"), F.floor("duration_ms")).otherwise(0).cast("long").alias("n"), F.coalesce("error_message", F.lit("")).alias("note"))
    held = jobs.drained(jobs.last_good(jobs.arriving(runs, "event_id").drop("event_id")), keys=("source",))
    stale = C("fetched_at").isNull() | (C("fetched_at") < F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return held.select("source", C("fetched_at").cast("string").alias("fetched_at"), "n", "last_error", stale.alias("stale"))


@query("t02_stale_stop", """
WITH h AS (SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS source, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS page_no, event_type IN ('view', 'click') AS gone FROM events)
SELECT source, CAST(page_no AS INT) AS page_no, page_no >= 4 AND count(*) FILTER (gone) OVER (PARTITION BY source ORDER BY page_no ROWS 3 PRECEDING) = 4 AS stop FROM h
""", postings=False)
def stale_stop(spark, d):
    """A counter per source that survives batches and pages out of turn."""
    e = table(spark, d, "events").select(F.concat(F.lit("src"), (C("user_id") % 20).cast("string")).alias("source"), "event_id", C("event_type").isin("view", "click").cast("int").alias("expired"))
    pages = numbered(e, "event_id", keys=("source",), name="page_no").select("source", C("page_no").cast("int").alias("page_no"), F.lit(1).alias("total"), "expired", F.xxhash64("event_id").alias("arrives"))
    return jobs.drained(jobs.stale_stop(jobs.arriving(pages, "arrives").drop("arrives")))


@query("t05_stream_dedupe", """
SELECT DISTINCT 'https://x.org/' || CAST(user_id AS VARCHAR) || '/' || event_type AS key FROM events
""", postings=False)
def stream_dedupe(spark, d):
    """First arrivals by canonical URL, whatever query string they carry."""
    url = F.concat(F.lit("https://x.org/"), C("user_id").cast("string"), F.lit("/"), "event_type", F.when(C("event_id") % 3 == 0, "/").when(C("event_id") % 3 == 1, F.concat(F.lit("?ref="), C("event_id").cast("string"))).otherwise(""))
    rows = table(spark, d, "events").select("event_id", url.alias("url"), C("ts").cast("timestamp").alias("event_time"))
    return jobs.drained(jobs.dedupe_stream(jobs.arriving(rows, "event_id"), SPAN).select("key"))


@query("t06_stream_log_health", "WITH l AS (" + CRAWL_LOGS_ORACLE + """)
SELECT source, CAST(date_trunc('day', started_at) AS VARCHAR) AS start, count(*) AS n, count(*) FILTER (success) AS ok FROM l GROUP BY 1, 2
""", postings=False)
def stream_log_health(spark, d):
    """Tumbling days per source, updated as logs arrive."""
    health = jobs.log_health(jobs.arriving(_stamped(crawl_logs(spark, d)), "event_id"), late=SPAN)
    return jobs.drained(health, keys=("source", "start")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("t03_stream_alerts", """
SELECT event_id AS seq, CAST(floor(value) AS INT) AS fit FROM events WHERE floor(value) >= 75 AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""", postings=False)
def stream_alerts(spark, d):
    """Strong rows of a stream that a table at rest does not list as sent."""
    rows = table(spark, d, "events").select(C("event_id").alias("seq"), F.floor("value").cast("int").alias("fit"), C("ts").cast("timestamp").alias("event_time"))
    sent = table(spark, d, "orders").where("o_orderstatus = 'F'").select(C("o_orderkey").alias("seq")).distinct()
    return jobs.drained(jobs.new_alerts(jobs.arriving(rows, "seq"), sent).select("seq", "fit"))
