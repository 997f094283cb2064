"""Postings and related tables derived from the given star schema.

``POSTINGS`` is one SQL text that Spark and DuckDB run unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = """
SELECT seq, source, source_label, university, country,
       'https://board' || CAST(n_nationkey AS STRING) || '.example.org/positions/phd-in-' || topic_slug || '-' || CAST(l_partkey % 40 AS STRING)
         || CASE variant WHEN 0 THEN '/' WHEN 1 THEN '?page=2&ref=x' WHEN 2 THEN '#top' ELSE '' END AS url,
       role || ' in ' || topic AS title,
       topic || ' at ' || university || '. ' || filler || deadline_text AS context,
       ship AS event_date
FROM (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, (l_orderkey + l_linenumber) % 4 AS variant, l_partkey, n.n_nationkey,
         'src' || CAST(l_suppkey % 8 AS STRING) AS source,
         'Board ' || CAST(l_suppkey % 8 AS STRING) AS source_label,
         'University of ' || n.n_name AS university, n.n_name AS country,
         CAST(l_shipdate AS DATE) AS ship,
         CASE l_orderkey % 7 WHEN 0 THEN 'PhD Position' WHEN 1 THEN 'Doctoral Candidate' WHEN 2 THEN 'Postdoctoral Fellow'
              WHEN 3 THEN 'Studentship' WHEN 4 THEN 'PhD Researcher' WHEN 5 THEN 'Research Fellow' ELSE 'Lecturer' END AS role,
         CASE l_partkey % 7 WHEN 0 THEN 'Gait Biomechanics' WHEN 1 THEN 'Machine Learning for Movement' WHEN 2 THEN 'Polymer Chemistry'
              WHEN 3 THEN 'Neuroscience' WHEN 4 THEN 'Combinatorics' WHEN 5 THEN 'Motor Control' ELSE 'Wearable Sensor Rehabilitation' END AS topic,
         CASE l_partkey % 7 WHEN 0 THEN 'gait-biomechanics' WHEN 1 THEN 'machine-learning' WHEN 2 THEN 'polymer-chemistry'
              WHEN 3 THEN 'neuroscience' WHEN 4 THEN 'combinatorics' WHEN 5 THEN 'motor-control' ELSE 'wearable-sensor' END AS topic_slug,
         CASE WHEN l_quantity > 40 THEN 'Motion capture, force plate and deep learning on human patients. '
              WHEN l_quantity > 20 THEN 'Fully funded, stipend EUR 2,800 per month. ' ELSE '' END AS filler,
         CASE l_linenumber % 7
              WHEN 0 THEN 'Deadline: ' || CAST(CAST(l_shipdate AS DATE) AS STRING)
              WHEN 1 THEN 'Apply by ' || CAST(day(l_shipdate) AS STRING) || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(l_shipdate) * 3 - 2 AS INT), 3) || ' ' || CAST(year(l_shipdate) AS STRING)
              WHEN 2 THEN 'Closing date ' || CAST(day(l_shipdate) AS STRING) || '/' || CAST(month(l_shipdate) AS STRING) || '/' || CAST(year(l_shipdate) AS STRING)
              WHEN 3 THEN 'Posted ' || CAST(CAST(l_shipdate AS DATE) AS STRING)
              WHEN 4 THEN 'Open until filled.'
              WHEN 5 THEN 'Deadline: 15 March'
              ELSE '' END AS deadline_text
  FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
) t
"""

#: The same for DuckDB, where the tables are views.
POSTINGS_ORACLE = POSTINGS.format(lineitem="lineitem", supplier="supplier", nation="nation")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a plain Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """seq, source, source_label, university, country, url, title, context,
    event_date; supplier and nation are small dimensions of the fact table,
    which is ``dealt`` out first where that is asked for."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation")}
    if dealt:
        tables["lineitem"] = spread(tables["lineitem"], tables["lineitem"], "l_orderkey", "l_linenumber")
    return spark.sql(POSTINGS, **tables)


def whole(key: Column, by: int) -> Column:
    """Whole part of a division of whole numbers.  Keys of large tables are
    beyond the 2 ** 53 up to which a double tells them apart."""
    return F.call_function("div", key, F.lit(by))


def spread(rows: DataFrame, fact: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out before costly expressions, where the fact table lies in
    fewer files than there are cores (one file is often one row group, and so
    one task); as it is where there are files enough.  By a key of many values
    no task sorts its rows first, as dealing in turn does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *key) if len(fact.inputFiles()) < cores else rows


def spread_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings for costly gates: the numbers they are made of are dealt out,
    not their texts."""
    return postings(spark, sf_dir, dealt=True)


def source_runs(rows: DataFrame) -> DataFrame:
    """Per-source run summary: odd sources failed and returned nothing."""
    odd = F.right("source", F.lit(1)).cast("int") % 2 == 1
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("all_n")).select(
        "source", F.when(odd, 0).otherwise(F.col("all_n")).cast("long").alias("n"),
        F.when(odd, "http").otherwise("browser").alias("method"), F.when(odd, "timed out").otherwise("ok").alias("note"),
    )


SOURCE_RUNS_ORACLE = """
SELECT source, CAST(CASE WHEN CAST(right(source, 1) AS INT) % 2 = 1 THEN 0 ELSE count(*) END AS BIGINT) AS n,
       CASE WHEN CAST(right(source, 1) AS INT) % 2 = 1 THEN 'http' ELSE 'browser' END AS method,
       CASE WHEN CAST(right(source, 1) AS INT) % 2 = 1 THEN 'timed out' ELSE 'ok' END AS note
FROM p GROUP BY source
"""


def crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl logs from the events table."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("ts").alias("started_at"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", F.lit("timed out")).alias("error_message"), F.col("value").alias("duration_ms"),
    )


CRAWL_LOGS_ORACLE = """
SELECT event_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS source, ts AS started_at, event_type <> 'error' AS success,
       CASE WHEN event_type = 'error' THEN 'timed out' END AS error_message, value AS duration_ms FROM events
"""
