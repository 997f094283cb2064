"""Queries of the scalar operators: URLs, titles, dates, gates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, gates, titles, urls
from postmill.plans.base import AS_OF, query
from postmill.sources.postings import postings, spread_postings, table

C = F.col


@query("b01_b09_url_keys", r"""
SELECT seq, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS canonical_key, rtrim(split_part(url, '?', 1), '/') AS fragment_key,
       lower(rtrim(split_part(url, '#', 1), '/')) AS vacancy_key, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, 'example.org' AS registrable,
       '/positions/' || split_part(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/', 5) AS path_shape,
       CASE WHEN contains(url, 'page=2') THEN 2 END AS page_number,
       '/positions/' || split_part(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/', 5) AS paged_shape,
       CASE WHEN length(split_part(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/', 5)) > 30 THEN '/positions/*'
            ELSE '/positions/' || split_part(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/', 5) END AS url_pattern
FROM p
""")
def url_keys(spark, d):
    u = C("url")
    return postings(spark, d).select(
        "seq", urls.canonical(u).alias("canonical_key"), urls.canonical(u, True).alias("fragment_key"), urls.vacancy_key(u).alias("vacancy_key"),
        urls.host(u).alias("host"), urls.registrable(urls.host(u)).alias("registrable"), urls.path_shape(u).alias("path_shape"),
        urls.page_number(u).alias("page_number"), F.rtrim(urls.unpaged(u), F.lit("/")).alias("paged_shape"), urls.url_pattern(u).alias("url_pattern"),
    )


@query("b03_normalise_url", r"""
SELECT seq, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') || CASE WHEN contains(url, 'page=2') THEN '?page=2' ELSE '' END AS normal_url,
       'https://board.example.org/a/x' || CAST(seq % 7 AS VARCHAR) || '?q=1' AS joined_url
FROM p
""")
def normalise_url(spark, d):
    base = F.lit("https://Board.example.org/a/b")
    relative = F.concat(F.lit("x"), (C("seq") % 7).cast("string"), F.lit("/?utm_source=a&q=1&ref=b#frag"))
    return postings(spark, d).select("seq", urls.normalise(C("url"), base).alias("normal_url"), urls.normalise(relative, base).alias("joined_url"))


@query("b34_b35_redirects", r"""
SELECT seq, url AS unwrapped, contains(url, '//board1.example.org') AS in_scope FROM p
""")
def redirects(spark, d):
    wrapped = F.concat(F.lit("https://search.example.com/l/?uddg="), F.url_encode("url"))
    return postings(spark, d).select("seq", urls.unwrap_redirect(wrapped).alias("unwrapped"), urls.in_scope(C("url"), F.lit("www.Board1.example.org")).alias("in_scope"))


@query("b10_b14_titles", r"""
SELECT seq, title AS clean, title AS without_id,
       replace(CASE WHEN contains(title, 'Gait') THEN 'Phd in gait biomechanics ' WHEN contains(title, 'Machine') THEN 'Phd in machine learning '
            WHEN contains(title, 'Polymer') THEN 'Phd in polymer chemistry ' WHEN contains(title, 'Neuro') THEN 'Phd in neuroscience '
            WHEN contains(title, 'Combin') THEN 'Phd in combinatorics ' WHEN contains(title, 'Motor') THEN 'Phd in motor control ' ELSE 'Phd in wearable sensor ' END, '-', ' ')
         || regexp_extract(url, '-([0-9]+)(/|\?|#|$)', 1) AS from_slug,
       title AS with_badge, regexp_matches(split_part(title, ' ', 1) || CAST(seq AS VARCHAR), '[0-9]') AS id_like
FROM p WHERE NOT regexp_matches(title, 'Research Fellow|Lecturer')
""")
def title_scalars(spark, d):
    t = C("title")
    rows = postings(spark, d).where(~t.rlike("Research Fellow|Lecturer"))
    return rows.select(
        "seq", titles.clean_title(t).alias("clean"), titles.strip_trailing_id(F.concat(t, F.lit(" 5udgbc81w7"))).alias("without_id"),
        titles.title_from_slug(C("url"), t).alias("from_slug"), titles.clean_title(F.concat(F.lit("Just Landed Canada . "), t, F.lit(" Closing soon"))).alias("with_badge"),
        titles.looks_like_id(F.concat(F.split_part(t, F.lit(" "), F.lit(1)), C("seq").cast("string"))).alias("id_like"),
    )


@query("b38_search_queries", r"""
WITH t(pos, template) AS (VALUES (1, '"{name}" PhD position'), (2, '"{name}" {field} doctoral'), (3, '{university} {field} studentship')),
     f(fpos, field) AS (VALUES (1, 'gait'), (2, 'motor control'), (3, 'wearables'), (4, 'rehabilitation'), (5, 'locomotion'), (6, 'balance')),
     q AS (SELECT s_suppkey, pos, fpos, replace(replace(replace(template, '{name}', s_name), '{field}', field), '{university}', 'University of ' || n_name) AS query
           FROM supplier JOIN nation ON s_nationkey = n_nationkey, t, f),
     u AS (SELECT s_suppkey, query, min(fpos * 10 + pos) AS ord FROM q GROUP BY ALL)
SELECT s_suppkey, query, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY ord) AS rn FROM u) WHERE rn <= 15
""", postings=False)
def search_queries(spark, d):
    from postmill.operators.ranking import build_queries

    people = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), C("s_nationkey") == C("n_nationkey"))
    people = people.select("s_suppkey", C("s_name").alias("name"), F.concat(F.lit("University of "), C("n_name")).alias("university"))
    return build_queries(
        people, "s_suppkey", ('"{name}" PhD position', '"{name}" {field} doctoral', "{university} {field} studentship"),
        ("gait", "motor control", "wearables", "rehabilitation", "locomotion", "balance"),
    )


_DATE_ORACLE = r"""
, d AS (
  SELECT *, CASE
    WHEN regexp_matches(context, 'Deadline: \d{4}-') THEN try_cast(regexp_extract(context, '(\d{4}-\d{2}-\d{2})', 1) AS DATE)
    WHEN contains(context, 'Apply by ') THEN try_strptime(regexp_extract(context, 'Apply by (\d{1,2} [A-Z][a-z]{2} \d{4})', 1), '%d %b %Y')::DATE
    WHEN contains(context, 'Closing date ') THEN make_date(CAST(regexp_extract(context, '/(\d{4})', 1) AS BIGINT),
      CASE WHEN CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 2) AS INT) > 12 THEN CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 1) AS BIGINT) ELSE CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 2) AS BIGINT) END,
      CASE WHEN CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 2) AS INT) > 12 THEN CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 2) AS BIGINT) ELSE CAST(regexp_extract(context, 'date (\d+)/(\d+)/', 1) AS BIGINT) END)
    END AS value FROM p
), dl AS (
  SELECT *, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= DATE '1998-06-01' THEN 'open' ELSE 'expired' END AS status FROM d
)
"""


@query("d01_d09_deadlines", _DATE_ORACLE + r"""
SELECT seq, CAST(value AS VARCHAR) AS value, status, contains(context, 'Open until filled') AS rolling,
       CAST(value - DATE '1998-06-01' AS INT) AS days_left,
       CASE WHEN regexp_matches(context, 'Deadline: \d{4}-') THEN 0.95 WHEN contains(context, 'Apply by ') THEN 0.95
            WHEN contains(context, 'Closing date ') THEN CASE WHEN CAST(regexp_extract(context, 'date (\d+)/', 1) AS INT) > 12 THEN 0.95 ELSE 0.65 END
            ELSE 0.0 END::DOUBLE AS confidence
FROM dl
""")
def deadlines(spark, d):
    as_of = F.lit(AS_OF).cast("date")
    rows = spread_postings(spark, d).select("seq", "context", dates.deadline(C("context"), as_of).alias("d"))
    return rows.select("seq", C("d.value").cast("string").alias("value"), "d.status", dates.is_rolling(C("context")).alias("rolling"), dates.days_left(C("d.value"), as_of).alias("days_left"), "d.confidence")


@query("d17_d18_ages", r"""
SELECT seq, CASE WHEN DATE '1998-06-01' - event_date <= 0 THEN 1.0 ELSE round(exp(-(DATE '1998-06-01' - event_date) / 30.0), 9) END AS freshness,
       CASE WHEN seq % 5 = 0 THEN -1 ELSE CAST(DATE '1998-06-01' - event_date AS INT) END AS cache_age
FROM p
""")
def ages(spark, d):
    as_of = F.lit(AS_OF).cast("date")
    age = F.datediff(as_of, C("event_date"))
    fetched = F.when(C("seq") % 5 != 0, C("event_date").cast("timestamp"))
    return postings(spark, d).select("seq", F.round(dates.freshness_decay(age), 9).alias("freshness"), dates.cache_age_days(fetched, as_of.cast("timestamp")).alias("cache_age"))


@query("f01_gate_title", r"""
SELECT seq, CASE WHEN contains(title, 'Postdoctoral') THEN 'role:postdoc' WHEN contains(title, 'Lecturer') THEN 'role:lecturer'
                 WHEN contains(title, 'Chemistry') THEN 'field:chemistry' WHEN contains(title, 'Research Fellow') THEN 'not-doctoral' ELSE 'ok' END AS reason
FROM p
""")
def title_gate(spark, d):
    return postings(spark, d).select("seq", gates.gate_title(C("title")).alias("reason"))
