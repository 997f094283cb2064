"""Queries of the table operators: gates to ranking, merges, joins, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions import dates, gates, titles, urls
from postmill.operators import dedupe, health, numbering, pages, people, ranking, scoring
from postmill.plans.base import AS_OF, query
from postmill.plans.scalars import _DATE_ORACLE
from postmill.sources.postings import CRAWL_LOGS_ORACLE, SOURCE_RUNS_ORACLE, crawl_logs, postings, source_runs, spread_postings, table
from postmill.sources.scratch import stored
from postmill.streaming import jobs

C = F.col


def row_count():
    return F.count(F.lit(1))


def as_of():
    return F.lit(AS_OF).cast("date")


def _sql(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _hits(text: str, terms) -> str:
    return f"len(list_filter({_sql(terms)}, lambda x: contains({text}, x)))"


def gated(rows, rate_expired=False):
    """Postings with the reason that a gate rejects them for, or ``ok``; in
    gate order: title, deadline, topic with its thin-context deferral.  Each
    gate looks at what those before it let pass; the fit of expired rows, which
    no later gate needs, is 0 unless asked for."""
    title, context = C("title"), C("context")
    live = C("title_reason") == "ok"
    named = rows.select("*", gates.title_reason(title).alias("title_reason"))
    # exploding a one-element array keeps a costly column from being computed again wherever it is used
    dated = named.select("*", F.explode(F.array(F.when(live, dates.deadline(F.when(live, context), as_of())))).alias("deadline"))
    rated = live if rate_expired else live & (C("deadline.status") != "expired")
    step = dated.select("*", F.explode(F.array(F.when(rated, gates.topic_fit(F.when(rated, title), F.when(rated, context))).otherwise(0))).alias("fit"))
    thin = gates.thin_context(C("source"), title, context)
    why = (
        F.when(C("title_reason") != "ok", C("title_reason")).when(C("deadline.status") == "expired", "deadline")
        .when((C("fit") == 0) & thin, "deferred").when(C("fit") == 0, "offtopic").otherwise("ok")
    )
    return step.withColumn("reason", why).withColumn("fit", F.when(C("reason") == "deferred", 40).otherwise(C("fit")))


_GATED = _DATE_ORACLE + f"""
, t AS (SELECT *, lower(title) AS tl, lower(title || ' ' || context) AS blob FROM dl),
h AS (SELECT *, {_hits('tl', gates.TOPIC_TITLE)} AS core, {_hits('tl', gates.ADJACENT_TITLE)} AS near, {_hits('blob', gates.TOPIC_CONTEXT)} AS seen,
             {_hits('blob', gates.LEARNING)} AS learn, {_hits('blob', gates.SENSORS)} AS sense, {_hits('tl', gates.DOCTORAL)} AS doc,
             {_hits('tl', gates.REJECT_ROLE)} AS bad_role, {_hits('tl', gates.REJECT_FIELD)} AS bad_field FROM t),
b AS (SELECT *, CASE WHEN core > 0 THEN 60 WHEN seen >= 4 THEN 47 WHEN seen >= 2 THEN 35 WHEN near > 0 THEN 30 ELSE 0 END AS base FROM h),
f AS (SELECT *, CASE WHEN base = 0 THEN 0 ELSE least(100, base + CASE WHEN near > 0 THEN 8 ELSE 0 END + CASE WHEN learn > 0 THEN 18 ELSE 0 END
             + CASE WHEN sense > 0 THEN 14 ELSE 0 END + CASE WHEN doc > 0 THEN 3 ELSE 0 END) END AS fit FROM b),
g AS (SELECT *, CASE WHEN bad_role > 0 THEN 'role' WHEN bad_field > 0 THEN 'field' WHEN doc = 0 THEN 'not-doctoral' WHEN status = 'expired' THEN 'deadline' WHEN fit = 0 THEN 'offtopic' ELSE 'ok' END AS reason FROM f)
"""
_FINAL = _GATED + r"""
, k AS (SELECT *, rtrim(split_part(url, '?', 1), '/') AS key FROM g WHERE reason = 'ok'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(context) DESC, seq) AS rn FROM k) WHERE rn = 1)
"""


def live(spark, d):
    """What is published, one row per URL, not numbered yet.  Rows are dealt
    out before the gates where the table is one file; only those that pass every
    gate reach the shuffle by URL."""
    kept = gated(spread_postings(spark, d)).where("reason = 'ok'").select(
        "seq", "title", "university", "country", "url", "context", "fit", C("deadline.status").alias("deadline_status"), C("deadline.value").cast("string").alias("deadline_date")
    )
    return dedupe.longest_context(kept).withColumn("description", F.left("context", F.lit(400))).drop("context")


@query("q_published_positions", _FINAL + """
SELECT 'pd-' || printf('%03d', row_number() OVER (ORDER BY fit DESC, seq)) AS id, seq, title, university, country, url, fit,
       CASE WHEN fit >= 75 THEN 'HIGH' WHEN fit >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS tier, status AS deadline_status, CAST(value AS VARCHAR) AS deadline_date, left(context, 400) AS description
FROM w
""")
def published(spark, d):
    """Gates, longest-context dedupe, rank, number: the flagship query."""
    n = numbering.numbered(live(spark, d), F.desc("fit"), "seq")
    return n.select(
        F.format_string("pd-%03d", "n").alias("id"), "seq", "title", "university", "country", "url", "fit", scoring.tier(C("fit"), 75, 55).alias("tier"), "deadline_status", "deadline_date", "description",
    )


@query("g01_gate_funnel", _GATED + "SELECT count(*) AS total_in, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS \"{n}\"" for n, r in (("rejected_role", "role"), ("rejected_field", "field"), ("rejected_not_doctoral", "not-doctoral"), ("rejected_deadline", "deadline"), ("rejected_offtopic", "offtopic"), ("kept", "ok"))) + " FROM g")
def funnel(spark, d):
    named = (("rejected_role", "role"), ("rejected_field", "field"), ("rejected_not_doctoral", "not-doctoral"), ("rejected_deadline", "deadline"), ("rejected_offtopic", "offtopic"), ("kept", "ok"))
    return gated(spread_postings(spark, d)).agg(row_count().alias("total_in"), *(F.count_if(C("reason") == r).alias(n) for n, r in named))


@query("s01_topic_fit", _GATED + "SELECT seq, CASE WHEN reason IN ('role', 'field', 'not-doctoral') THEN 0 ELSE fit END AS fit, reason FROM g")
def topic_fit(spark, d):
    return gated(spread_postings(spark, d), rate_expired=True).select("seq", "fit", "reason")


@query("f02_f03_deadline_thin_gates", _DATE_ORACLE + "SELECT seq, status <> 'expired' AS live, seq % 3 = 0 AND regexp_matches(lower(title), 'phd|doctoral|studentship') AND NOT contains(title, 'Chemistry') AND length(context) < 120 AS waits FROM dl")
def deadline_gate(spark, d):
    rows = spread_postings(spark, d)
    source = F.when(C("seq") % 3 == 0, F.lit("applykite")).otherwise(C("source"))
    return rows.select("seq", (dates.deadline(C("context"), as_of())["status"] != "expired").alias("live"), gates.thin_context(source, C("title"), C("context")).alias("waits"))


@query("w01_longest_context", "SELECT * EXCLUDE (rn, key) REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(context) DESC, seq) AS rn FROM (SELECT *, rtrim(split_part(url, '?', 1), '/') AS key FROM p)) WHERE rn = 1")
def longest(spark, d):
    return dedupe.longest_context(postings(spark, d).withColumn("event_date", C("event_date").cast("string")))


@query("w02_merge_runs", """
SELECT rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS key, """ + ", ".join(f"arg_max({f}, struct_pack(a := length({f}), b := -seq)) AS {f}" for f in ("title", "context", "country", "source_label")) + " FROM p GROUP BY 1")
def merge_runs(spark, d):
    return dedupe.merge_longest(postings(spark, d), urls.canonical(C("url")), ["title", "context", "country", "source_label"])


@query("w03_w07_first_wins", """
SELECT 'url' AS kind, count(*) AS n, sum(seq) AS total FROM (SELECT min(seq) AS seq FROM p GROUP BY url)
UNION ALL SELECT 'title', count(*), sum(seq) FROM (SELECT min(seq) AS seq FROM p GROUP BY title, university, country)
UNION ALL SELECT 'either', count(*), sum(seq) FROM (SELECT min(seq) AS seq FROM p GROUP BY CASE WHEN seq % 2 = 0 THEN url ELSE title || source_label END)
""")
def first_wins(spark, d):
    rows = postings(spark, d).select("seq", "url", "title", "university", "country", "source_label")
    either = F.coalesce(F.when(C("seq") % 2 == 0, C("url")), F.concat("title", "source_label"))
    out = None
    for kind, keys in (("url", [C("url")]), ("title", [C("title"), C("university"), C("country")]), ("either", [either])):
        one = dedupe.first_wins(rows, *keys).agg(row_count().alias("n"), F.sum(C("seq").cast("decimal(38,0)")).alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("w08_shared_boards", """
WITH b AS (SELECT page_id AS seq, 'U' || CAST(page_id AS VARCHAR) AS university, 'https://x.org/' || CAST(page_id % 7 AS VARCHAR) AS board_url FROM pages)
SELECT university, seq, CASE WHEN rn = 1 THEN board_url END AS board_url, CASE WHEN rn > 1 THEN first END AS shared_with
FROM (SELECT *, row_number() OVER w AS rn, first_value(university) OVER w AS first FROM b WINDOW w AS (PARTITION BY lower(board_url) ORDER BY seq))
""", postings=False)
def shared_boards(spark, d):
    b = table(spark, d, "pages").select(C("page_id").alias("seq"), F.concat(F.lit("U"), C("page_id").cast("string")).alias("university"), F.concat(F.lit("https://x.org/"), (C("page_id") % 7).cast("string")).alias("board_url"))
    return dedupe.share_boards(b)


@query("w11_w15_w17_top_per_parent", "SELECT source, seq, CAST(rank AS INT) AS rank FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY length(context) DESC, seq) AS rank FROM p) WHERE rank <= 10")
def top_per_source(spark, d):
    return ranking.top_per(postings(spark, d).select("source", "seq", "context"), "source", [F.desc(F.length("context")), C("seq")], 10).select("source", "seq", "rank")


@query("w10_w12_top_list", "SELECT seq, length(context) AS n FROM p ORDER BY n DESC, seq LIMIT 12")
def top_list(spark, d):
    return postings(spark, d).select("seq", F.length("context").cast("long").alias("n")).orderBy(F.desc("n"), "seq").limit(12)


@query("w13_digest_batches", "SELECT c_custkey, CAST((rn - 1) // 50 AS BIGINT) AS batch FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)", postings=False)
def digest_batches(spark, d):
    rows = numbering.numbered(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_custkey", keys=("c_nationkey",))
    return rows.select("c_custkey", F.floor((C("n") - 1) / 50).alias("batch"))


@query("j05_cache_merge", """
, r AS (""" + SOURCE_RUNS_ORACLE + """)
SELECT p.seq, p.source, r.n = 0 AS from_cache, CASE WHEN r.n = 0 THEN CAST(DATE '1998-06-01' - p.event_date AS INT) END AS cache_age_days, r.n = 0 AND DATE '1998-06-01' - p.event_date > 21 AS stale
FROM p JOIN r USING (source)
""")
def cache_merge(spark, d):
    rows = postings(spark, d).select("seq", "source", "event_date")
    odd = F.right("source", F.lit(1)).cast("int") % 2 == 1
    cached = rows.where(odd).withColumn("fetched_at", C("event_date"))
    return dedupe.merge_cache(rows.where(~odd), cached, source_runs(rows), as_of()).select("seq", "source", "from_cache", "cache_age_days", "stale")


@query("g09_j13_source_runs", """
, r AS (""" + SOURCE_RUNS_ORACLE + """)
SELECT source, n, method, note, CASE WHEN n > 0 THEN 'fresh' ELSE 'cached' END AS state FROM r
""")
def run_summary(spark, d):
    return source_runs(postings(spark, d)).select("*", F.when(C("n") > 0, "fresh").otherwise("cached").alias("state"))


@query("g02_g06_histograms", "SELECT source_label, count(*) AS n, count(DISTINCT country) AS countries, array_to_string(list_sort(list(DISTINCT country)), ',') AS names FROM p GROUP BY source_label")
def histograms(spark, d):
    rows = postings(spark, d).groupBy("source_label", "country").agg(row_count().alias("n"))  # country first: members are few per label
    return rows.groupBy("source_label").agg(F.sum("n").alias("n"), row_count().alias("countries"), F.array_join(F.sort_array(F.collect_list("country")), ",").alias("names"))


@query("g03_g04_publish_meta", _FINAL + "SELECT count(*) AS total, count(DISTINCT university) AS universities, count(value) AS with_deadline, count(*) FILTER (country <> '') AS with_country, count(*) FILTER (fit >= 75) AS high FROM w")
def publish_meta(spark, d):
    p = live(spark, d)
    return p.agg(row_count().alias("total"), F.countDistinct("university").alias("universities"), F.count("deadline_date").alias("with_deadline"), F.count_if(C("country") != "").alias("with_country"), F.count_if(C("fit") >= 75).alias("high"))


@query("g05_j03_coverage", """
, r AS (""" + SOURCE_RUNS_ORACLE + """), u AS (SELECT source, count(DISTINCT rtrim(split_part(url, '?', 1), '/')) AS keys FROM p GROUP BY source)
SELECT count(*) AS boards, count(*) FILTER (n > 0) AS live, count(*) FILTER (n = 0) AS silent, CAST(sum(keys) AS BIGINT) AS distinct_postings FROM r JOIN u USING (source)
""")
def coverage(spark, d):
    rows = postings(spark, d).select("source", "url")
    keys = rows.select("source", urls.canonical(C("url"), True).alias("key")).distinct().groupBy("source").agg(row_count().alias("keys"))
    return source_runs(rows).join(keys, "source", "left").agg(row_count().alias("boards"), F.count_if(C("n") > 0).alias("live"), F.count_if(C("n") == 0).alias("silent"), F.sum("keys").alias("distinct_postings"))


@query("g07_g08_reason_histogram", _GATED + "SELECT country, reason, count(*) AS n FROM g GROUP BY country, reason")
def reasons(spark, d):
    return gated(spread_postings(spark, d)).groupBy("country", "reason").agg(row_count().alias("n"))


@query("g10_people_by_works", """
WITH a AS (SELECT l_orderkey AS work, l_suppkey AS person, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
s AS (SELECT person, work, CAST(floor(o_totalprice) AS BIGINT) AS cited FROM (SELECT DISTINCT person, work FROM a WHERE pos <= 3) JOIN orders ON work = o_orderkey)
SELECT person, count(*) AS papers, CAST(sum(cited) AS BIGINT) AS citations, array_to_string(list_slice(list_sort(list(work)), 1, 3), ',') AS examples FROM s GROUP BY person
""", postings=False)
def people_by_works(spark, d):
    """Authorship positions come from a window per work; a person's examples
    are their three smallest works, found without collecting all of them."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = l.select(C("l_orderkey").alias("work"), C("l_suppkey").alias("person"), pos.alias("pos")).where("pos <= 3").select("person", "work").distinct()
    s = pairs.join(o.select(C("o_orderkey").alias("work"), F.floor("o_totalprice").cast("long").alias("cited")), "work")
    totals = s.groupBy("person").agg(row_count().alias("papers"), F.sum("cited").alias("citations"))
    first = ranking.top_per(s.select("person", "work"), "person", [C("work")], 3).groupBy("person").agg(F.array_join(F.array_sort(F.collect_list("work")), ",").alias("examples"))
    return totals.join(first, "person")


@query("g11_research_groups", """
WITH c AS (SELECT DISTINCT s_nationkey AS institution, s_suppkey AS person, CAST(l_partkey % 9 AS INT) AS concept FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT institution, concept, count(*) AS members FROM c GROUP BY 1, 2 HAVING count(*) >= 2
""", postings=False)
def research_groups(spark, d):
    c = table(spark, d, "lineitem").select("l_suppkey", (C("l_partkey") % 9).cast("int").alias("concept")).distinct()
    s = c.join(table(spark, d, "supplier").select("s_suppkey", C("s_nationkey").alias("institution")), C("l_suppkey") == C("s_suppkey"))
    return s.groupBy("institution", "concept").agg(row_count().alias("members")).where("members >= 2")


@query("g14_g27_subscribers", "SELECT n_name AS country, count(*) AS total, count(*) FILTER (c_custkey % 3 <> 0) AS confirmed, count(*) FILTER (c_custkey % 11 = 0) AS unsubscribed, count(*) FILTER (c_custkey % 3 = 0 AND c_custkey % 11 <> 0) AS pending FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", postings=False)
def subscribers(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("c_nationkey") == C("n_nationkey"))
    k = C("c_custkey")
    return c.groupBy(C("n_name").alias("country")).agg(row_count().alias("total"), F.count_if(k % 3 != 0).alias("confirmed"), F.count_if(k % 11 == 0).alias("unsubscribed"), F.count_if((k % 3 == 0) & (k % 11 != 0)).alias("pending"))


@query("g23_published_checks", _FINAL + """
SELECT 'missing_title' AS check_name, count(*) FILTER (title = '') AS violations FROM w
UNION ALL SELECT 'bad_url', count(*) FILTER (NOT starts_with(url, 'https://')) FROM w
UNION ALL SELECT 'fit_range', count(*) FILTER (fit < 0 OR fit > 100) FROM w
UNION ALL SELECT 'status_domain', count(*) FILTER (status NOT IN ('open', 'unknown', 'rolling')) FROM w
UNION ALL SELECT 'repeated_url', CAST(count(*) - count(DISTINCT rtrim(split_part(url, '?', 1), '/')) AS BIGINT) FROM w
""")
def published_checks(spark, d):
    p = live(spark, d)
    one = p.agg(
        F.count_if(C("title") == "").alias("a"), F.count_if(~C("url").startswith("https://")).alias("b"), F.count_if((C("fit") < 0) | (C("fit") > 100)).alias("c"),
        F.count_if(~C("deadline_status").isin("open", "unknown", "rolling")).alias("d"), (row_count() - F.countDistinct(urls.canonical(C("url"), True))).alias("e"),
    )
    return one.select(F.expr("stack(5, 'missing_title', a, 'bad_url', b, 'fit_range', c, 'status_domain', d, 'repeated_url', e) AS (check_name, violations)"))


@query("g25_source_health", "WITH l AS (" + CRAWL_LOGS_ORACLE + """),
o AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY started_at DESC, event_id DESC) AS wins FROM l)
SELECT source, count(*) AS total, count(*) FILTER (NOT success) AS failed, round(avg(duration_ms), 4) AS avg_ms, count(*) FILTER (wins = 0) AS failures_in_a_row,
       CASE WHEN count(*) FILTER (wins = 0) >= 3 THEN 'down' WHEN count(*) FILTER (NOT success) * 5 > count(*) THEN 'degraded' ELSE 'healthy' END AS status
FROM o GROUP BY source
""", postings=False)
def source_health(spark, d):
    """The run of failures at the end is what started after the last success,
    so two aggregates do and no source's log is sorted."""
    logs = crawl_logs(spark, d)
    at = F.struct("started_at", "event_id")
    last = logs.groupBy("source").agg(row_count().alias("total"), F.count_if(~C("success")).alias("failed"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max(F.when(C("success"), at)).alias("last_ok"))
    tail = logs.join(last.select("source", "last_ok"), "source").where(C("last_ok").isNull() | (at > C("last_ok"))).groupBy("source").agg(row_count().alias("in_a_row"))
    row = F.coalesce("in_a_row", F.lit(0).cast("long"))
    status = F.when(row >= 3, "down").when(C("failed") * 5 > C("total"), "degraded").otherwise("healthy")
    return last.join(tail, "source", "left").select("source", "total", "failed", "avg_ms", row.alias("failures_in_a_row"), status.alias("status"))


@query("g26_j06_solutions", """
, s AS (SELECT source, CASE CAST(seq % 3 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'parse' ELSE 'dns' END AS failure, 'm' || CAST(seq % 5 AS VARCHAR) AS method, seq % 4 <> 0 AS success FROM p),
c AS (SELECT source, failure, method, count(*) FILTER (success) AS wins, count(*) FILTER (NOT success) AS losses FROM s GROUP BY ALL)
SELECT source, failure, method, wins, losses, CAST(row_number() OVER (PARTITION BY source, failure ORDER BY wins DESC, losses, method) AS INT) AS rank FROM c
""")
def solutions(spark, d):
    s = postings(spark, d).select("source", F.when(C("seq") % 3 == 0, "timeout").when(C("seq") % 3 == 1, "parse").otherwise("dns").alias("failure"), F.concat(F.lit("m"), (C("seq") % 5).cast("string")).alias("method"), (C("seq") % 4 != 0).alias("success"))
    c = s.groupBy("source", "failure", "method").agg(F.count_if(C("success")).alias("wins"), F.count_if(~C("success")).alias("losses"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("source", "failure").orderBy(F.desc("wins"), "losses", "method")))


@query("d14_d16_page_freshness", _DATE_ORACLE + """
, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY source ORDER BY seq) - 1) // 20 + 1 AS INT) AS page_no FROM dl),
g AS (SELECT source, page_no, count(*) AS total, count(*) FILTER (contains(context, 'Open until filled')) AS rolling, count(*) FILTER (NOT contains(context, 'Open until filled') AND status = 'open') AS open,
             count(*) FILTER (NOT contains(context, 'Open until filled') AND status = 'expired') AS expired FROM n GROUP BY ALL)
SELECT source, page_no, total, rolling, open, expired, total - rolling - open - expired AS unknown, open > 0 OR rolling > 0 AS has_live, expired = total AS all_expired FROM g
""")
def page_freshness(spark, d):
    """Pages are the postings of a source by twenties.  Each posting's state is
    settled where it is read, so that no text is sorted."""
    c = C("context")
    status = F.when(dates.is_rolling(c), "rolling").otherwise(dates.deadline(c, as_of())["status"])
    settled = stored(spread_postings(spark, d).select("source", "seq", status.alias("status")), "settled")  # ranges are sampled first, which would settle all twice
    listing = numbering.numbered(settled, "seq", keys=("source",))
    return health.page_counts(listing.withColumn("page_no", F.floor((C("n") - 1) / 20).cast("int") + 1))


@query("d16_stop_rule", """
WITH h AS (SELECT CAST(user_id % 20 AS INT) AS source, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS page_no, event_type IN ('view', 'click') AS all_expired FROM events),
r AS (SELECT *, count(*) FILTER (NOT all_expired) OVER (PARTITION BY source ORDER BY page_no) AS island FROM h),
k AS (SELECT source, page_no, row_number() OVER (PARTITION BY source, island, all_expired ORDER BY page_no) AS run FROM r WHERE all_expired)
SELECT source, CAST(min(page_no) AS INT) AS stop_after FROM k WHERE run >= 4 GROUP BY source
""", postings=False)
def stop_rule(spark, d):
    """First page that ends four all-expired pages in a row, per source."""
    e = table(spark, d, "events").select((C("user_id") % 20).cast("int").alias("source"), "event_id", C("event_type").isin("view", "click").alias("all_expired"))
    listing = numbering.numbered(e, "event_id", keys=("source",), name="page_no")
    return health.stop_after(listing, 4).select("source", C("stop_after").cast("int").alias("stop_after"))


@query("e01_e08_sets", """
, a AS (SELECT source FROM p WHERE seq % 2 = 0 UNION SELECT source || 'x' FROM p WHERE seq % 2 = 1)
SELECT 'union' AS kind, count(*) AS n FROM a
UNION ALL SELECT 'all', count(*) FROM (SELECT source FROM p UNION ALL SELECT source FROM p)
UNION ALL SELECT 'unexpected', count(*) FROM (SELECT DISTINCT country FROM p EXCEPT SELECT n_name FROM nation WHERE n_nationkey < 10)
""")
def sets(spark, d):
    rows = postings(spark, d).select("seq", "source", "country")
    union = rows.where("seq % 2 = 0").select("source").union(rows.where("seq % 2 = 1").select(F.concat("source", F.lit("x")))).distinct()
    expected = table(spark, d, "nation").where("n_nationkey < 10").select("n_name")
    parts = (("union", union), ("all", rows.select("source").union(rows.select("source"))), ("unexpected", rows.select("country").distinct().join(F.broadcast(expected), C("country") == C("n_name"), "left_anti")))
    out = None
    for kind, part in parts:
        one = part.agg(row_count().alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("e05_e06_targets", "SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(trim(p_name)), lower(p_brand), lower(p_type), lower(p_brand)])), '|') AS concepts, p_size <= 5 AS priority FROM part", postings=False)
def targets(spark, d):
    lists = F.array("p_name", "p_brand"), F.array("p_type"), F.array("p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(people.target_concepts(*lists)), "|").alias("concepts"), (C("p_size") <= 5).alias("priority"))


@query("e06_target_countries", "SELECT p_partkey FROM part WHERE p_size <= 5", postings=False)
def target_countries(spark, d):
    return people.target_countries(table(spark, d, "part").select("p_partkey", C("p_size").alias("priority"))).select("p_partkey")


@query("e07_k10_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Renamed ' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS c_name, c_mktsegment FROM customer", postings=False)
def upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("Renamed "), C("c_custkey").cast("string")).alias("c_name"), F.lit("").alias("c_mktsegment"))
    return dedupe.upsert(old, new, "c_custkey")


@query("j12_j15_detail_fields", """
, k AS (SELECT seq, title, context, seq % 50 AS page_id FROM p)
SELECT k.seq, coalesce(nullif(left(g.url, 20), ''), k.title) AS title, CASE WHEN g.page_id IS NULL THEN k.context ELSE g.url END AS detail FROM k LEFT JOIN pages g ON g.page_id = k.page_id AND g.page_id % 2 = 0
""")
def detail_fields(spark, d):
    k = postings(spark, d).select("seq", "title", "context", (C("seq") % 50).alias("page_id"))
    g = table(spark, d, "pages").where("page_id % 2 = 0").select("page_id", C("url").alias("page_url"))
    return k.join(g, "page_id", "left").select("seq", F.coalesce(F.nullif(F.left("page_url", F.lit(20)), F.lit("")), "title").alias("title"), F.coalesce("page_url", "context").alias("detail"))


@query("j11_missing_only", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", postings=False)
def missing_only(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j11_missing_boards", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)", postings=False)
def missing_boards(spark, d):
    """Universities whose board no crawl has found."""
    known = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(C("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(known, "c_custkey", "left_anti")


@query("h02_h03_anchors", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href\s*=\s*["''][^"''#]+["''][^>]*>.*?</a\s*>')) AS a FROM pages)
SELECT page_id, count(*) AS n FROM a GROUP BY page_id
""", postings=False)
def anchors(spark, d):
    return pages.anchors(table(spark, d, "pages")).groupBy("page_id").agg(row_count().alias("n"))


@query("v01_embedding_top_k", """
WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS similarity FROM q, embeddings)
SELECT q_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""", postings=False)
def embedding_top_k(spark, d):
    from postmill.operators.similarity import top_similar

    e = table(spark, d, "embeddings")
    return top_similar(e.where("vec_id % 100 = 0"), e, 10)


@query("v02_trigram_names", """
WITH g AS (SELECT s_suppkey, list_distinct([substring('  ' || lower(s_name) || ' ', CAST(i AS INT), 3) FOR i IN range(1, length(s_name) + 2)]) AS t FROM supplier),
x AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, len(list_intersect(a.t, b.t)) AS both_n, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS all_n FROM g a JOIN g b ON a.s_suppkey < b.s_suppkey)
SELECT a, b, round(both_n / CAST(all_n AS DOUBLE), 6) AS similarity FROM x WHERE both_n >= 0.9 * all_n
""", postings=False)
def trigram_names(spark, d):
    from postmill.operators.similarity import trigram_pairs

    return trigram_pairs(table(spark, d, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name")), 0.9)


@query("v02_trigram_parts", """
WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part), g AS (SELECT name, list_distinct([substring('  ' || lower(name) || ' ', CAST(i AS INT), 3) FOR i IN range(1, length(name) + 2)]) AS t FROM n),
x AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.t, b.t)) AS both_n, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS all_n FROM g a JOIN g b ON a.name < b.name)
SELECT a, b, round(both_n / CAST(all_n AS DOUBLE), 6) AS similarity FROM x WHERE both_n >= 0.6 * all_n
""", postings=False)
def trigram_parts(spark, d):
    from postmill.operators.similarity import trigram_pairs

    name = F.concat_ws(" ", "p_name", "p_type")
    return trigram_pairs(table(spark, d, "part").select(name.alias("id"), name.alias("name")).distinct(), 0.6)


@query("v03_state_funnel", "SELECT o_orderstatus AS state, count(*) AS n, o_orderstatus IN ('O', 'F', 'P') AS allowed FROM orders GROUP BY 1", postings=False)
def state_funnel(spark, d):
    return table(spark, d, "orders").groupBy(C("o_orderstatus").alias("state")).agg(row_count().alias("n")).withColumn("allowed", C("state").isin("O", "F", "P"))


@query("v04_alerts", _FINAL + """
, c AS (SELECT c_custkey, n_name AS country, 40 + c_custkey % 50 AS least FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT c_custkey, seq, row_number() OVER (PARTITION BY c_custkey ORDER BY fit DESC, seq) AS rank FROM c JOIN w ON w.country = c.country AND w.fit >= least WHERE (c_custkey + seq) % 7 <> 0)
SELECT c_custkey, seq, CAST(rank AS INT) AS rank FROM m WHERE rank <= 3
""")
def alerts(spark, d):
    """Subscriptions meet positions by country; what was sent stays out."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("c_nationkey") == C("n_nationkey")).select("c_custkey", C("n_name").alias("country"), (40 + C("c_custkey") % 50).alias("least"))
    found = c.join(live(spark, d).select("seq", "country", "fit"), "country").where(C("fit") >= C("least"))
    fresh = found.where((C("c_custkey") + C("seq")) % 7 != 0)
    return ranking.top_per(fresh, "c_custkey", [F.desc("fit"), C("seq")], 3).select("c_custkey", "seq", "rank")


@query("t03_t04_t06_log_windows", "WITH l AS (" + CRAWL_LOGS_ORACLE + """)
SELECT source, CAST(date_trunc('day', started_at) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (success) AS ok FROM l WHERE started_at >= TIMESTAMP '2024-01-05' GROUP BY 1, 2
""", postings=False)
def log_windows(spark, d):
    """Tumbling day windows of the logs that retention keeps."""
    logs = jobs.retained(crawl_logs(spark, d), F.lit("2024-01-31").cast("date"), 26)
    day = F.date_format(F.window("started_at", "1 day")["start"], "yyyy-MM-dd HH:mm:ss")
    return logs.groupBy("source", day.alias("day")).agg(row_count().alias("n"), F.count_if(C("success")).alias("ok"))
