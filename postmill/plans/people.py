"""Queries over people, institutions, works, boards and run counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import people as ops
from postmill.plans.base import query
from postmill.plans.tables import _GATED, C, gated, row_count
from postmill.sources import scans, sinks
from postmill.sources.postings import postings, spread_postings, table


def _people(spark, d):
    """Suppliers as people with their parts' names as keywords."""
    l = table(spark, d, "lineitem").select(C("l_suppkey").alias("person"), (C("l_partkey") % 7).alias("k")).distinct()
    words = F.array(*map(F.lit, ("gait", "motor control", "polymer", "balance", "neural coding", "wearables", "gait analysis")))
    keys = l.groupBy("person").agg(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.get(words, k.cast("int"))).alias("keywords"))
    return table(spark, d, "supplier").select(C("s_suppkey").alias("person"), "s_name", "s_nationkey", "s_acctbal").join(keys, "person")


_PEOPLE = """
WITH l AS (SELECT DISTINCT l_suppkey AS person, l_partkey % 7 AS k FROM lineitem),
w(k, word) AS (VALUES (0, 'gait'), (1, 'motor control'), (2, 'polymer'), (3, 'balance'), (4, 'neural coding'), (5, 'wearables'), (6, 'gait analysis')),
kw AS (SELECT person, word FROM l JOIN w USING (k) JOIN supplier ON s_suppkey = person)
"""


@query("j09_s25_touching_concepts", _PEOPLE + "SELECT person, word AS keyword, concept FROM kw, (VALUES ('gait'), ('motor'), ('neural coding of x')) c(concept) WHERE contains(word, concept) OR contains(concept, word)", postings=False)
def touching(spark, d):
    return ops.touching_concepts(_people(spark, d), ("gait", "motor", "neural coding of x"))


@query("s20_s21_email_chain", """
WITH e AS (SELECT s_suppkey AS person, pos, 'p' || CAST(s_suppkey AS VARCHAR) || CASE WHEN (s_suppkey + pos) % 3 = 0 THEN '@nation.org' ELSE '@mail.com' END AS email FROM supplier, (VALUES (0), (1), (3)) v(pos) WHERE s_suppkey % 4 <> 3 OR pos > 0),
g AS (SELECT person, min(pos) AS pos, arg_min(email, pos) AS email FROM e WHERE contains(email, '@nation') GROUP BY person)
SELECT person, g.email, CASE g.pos WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 3 THEN 0.8 END::DOUBLE AS confidence, CASE WHEN g.pos IN (0, 1) THEN 'VERIFIED' WHEN g.pos IS NOT NULL THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS level
FROM (SELECT DISTINCT person FROM e) LEFT JOIN g USING (person)
""", postings=False)
def email_chain(spark, d):
    s = table(spark, d, "supplier").select(C("s_suppkey").alias("person"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("source_pos"))
    s = s.where((C("person") % 4 != 3) | (C("source_pos") > 0))
    email = F.concat(F.lit("p"), C("person").cast("string"), F.when((C("person") + C("source_pos")) % 3 == 0, "@nation.org").otherwise("@mail.com"))
    return ops.verify_email(s.select("person", F.lit("University of nation").alias("university"), "source_pos", email.alias("email")))


@query("g12_j10_institutions", """
SELECT s_nationkey AS institution, CAST(l_partkey % 5 AS INT) AS concept, count(DISTINCT s_suppkey) AS authors FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 = 0 GROUP BY 1, 2
""", postings=False)
def institutions(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", (C("l_partkey") % 5).cast("int").alias("concept")).distinct()
    s = table(spark, d, "supplier").where("s_nationkey % 3 = 0").select(C("s_suppkey").alias("l_suppkey"), C("s_nationkey").alias("institution"))
    return pairs.join(s, "l_suppkey").groupBy("institution", "concept").agg(row_count().alias("authors"))


@query("s26_s27_s31_funded_works", """
SELECT o_orderkey AS work, l_suppkey AS person, 'PhD position in topic ' || CAST(l_partkey % 4 AS VARCHAR) AS title FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey % 4 AS t, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
WHERE year(o_orderdate) = 1997 AND l_partkey % 4 IN (1, 3) AND o_orderkey % 3 = 0
GROUP BY ALL
""", postings=False)
def funded_works(spark, d):
    """Works of a year whose concepts overlap the wanted ones and whose title
    shows hiring intent, with their authors."""
    from postmill.functions.titles import hiring_intent

    o = table(spark, d, "orders").where("year(o_orderdate) = 1997").select(C("o_orderkey").alias("work"))
    a = table(spark, d, "lineitem").select(C("l_orderkey").alias("work"), C("l_suppkey").alias("person"), (C("l_partkey") % 4).alias("concept")).distinct()
    title = F.concat(F.when(C("work") % 3 == 0, "PhD position in topic ").otherwise("A study of topic "), C("concept").cast("string"))
    rows = a.where(F.arrays_overlap(F.array("concept"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))).join(o, "work")
    return rows.select("work", "person", title.alias("title")).where(hiring_intent(C("title")))


@query("a05_a08_boards_by_size", """
WITH h AS (SELECT 'https://x.org/' || CAST(page_id % 7 AS VARCHAR) AS board_url, 'U' || CAST(page_id AS VARCHAR) AS university, page_id AS seq, page_id * 13 % 101 AS papers FROM pages)
SELECT board_url, arg_min(university, seq) AS university, string_agg(university, ',' ORDER BY university) AS shared, max(papers) AS papers FROM h GROUP BY board_url
""", postings=False)
def boards_by_size(spark, d):
    p = table(spark, d, "pages").select(C("page_id").alias("seq"), F.concat(F.lit("https://u"), C("page_id").cast("string"), F.lit(".org/")).alias("homepage"))
    size = scans.research_size(p.withColumn("openalex_papers", C("seq") * 13 % 101))
    boards = p.select("seq", "homepage", F.concat(F.lit("U"), C("seq").cast("string")).alias("university"), F.concat(F.lit("https://x.org/"), (C("seq") % 7).cast("string")).alias("board_url"))
    return scans.boards_by_size(boards, size).select("board_url", "university", F.array_join("shared", ",").alias("shared"), "papers")


@query("a09_w15_interleaved", """
SELECT c_custkey AS seq, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 3 ORDER BY rn, c_nationkey LIMIT 40
""", postings=False)
def interleaved(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").alias("seq"), C("c_nationkey").alias("country"))
    return scans.interleaved(c, 3, 40).select("seq", "rn")


@query("g15_g22_run_counters", _GATED + """
SELECT source, count(*) AS total, count(*) FILTER (reason = 'ok') AS kept, count(*) FILTER (reason = 'ok' AND fit >= 75) AS high, count(*) FILTER (reason = 'ok' AND fit >= 55 AND fit < 75) AS medium, count(*) FILTER (reason <> 'ok') AS failed FROM g GROUP BY source
""")
def run_counters(spark, d):
    ok, fit = C("reason") == "ok", C("fit")
    return gated(spread_postings(spark, d)).groupBy("source").agg(
        row_count().alias("total"), F.count_if(ok).alias("kept"), F.count_if(ok & (fit >= 75)).alias("high"), F.count_if(ok & (fit >= 55) & (fit < 75)).alias("medium"), F.count_if(~ok).alias("failed")
    )


@query("k01_k02_site_payload", """
SELECT seq, country, left(context, 400) AS description, 'Position listed on ' || source_label AS claim, CASE WHEN seq % 2 = 0 THEN 0.9 ELSE 0.65 END::DOUBLE AS confidence, 'aggregator' AS source_type FROM p
""")
def site_payload(spark, d):
    rows = postings(spark, d).withColumn("origin", F.when(C("seq") % 2 == 0, "browser_crawler").otherwise("crawl"))
    e = C("evidence")[0]
    return sinks.site_payload(rows).select("seq", "country", "description", e["claim"].alias("claim"), e["confidence"].alias("confidence"), e["source_type"].alias("source_type"))
