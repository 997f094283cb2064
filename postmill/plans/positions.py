"""Queries of fits, rankings, evidence, rescue, people and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, fixed, gates, titles, urls
from postmill.operators import evidence, pages, people, scoring
from postmill.plans.base import AS_OF, query, sql_first, sql_hits, sql_like, sql_list
from postmill.plans.classify import _NAMES, pick, sql_pick
from postmill.plans.tables import _GATED, _hits, as_of, gated, row_count
from postmill.sources.postings import POSTINGS_ORACLE, postings, spread, spread_postings, table, whole

C = F.col

_SOURCES = ("euraxess", "jobbank", "src1", "nature_careers", "board")


@query("s02_s13_scores", f"""
, x AS (SELECT *, lower(title) AS t, lower(title || ' ' || context) AS b, {sql_pick(_SOURCES, 'seq')} AS site FROM p)
SELECT seq, CAST(least(100, 40 + CASE WHEN {sql_hits('t', fixed.CRAWLER_TOPICS)} > 0 THEN 25 ELSE 0 END + CASE WHEN {sql_hits('b', fixed.CRAWLER_LEARNING)} > 0 THEN 20 ELSE 0 END + CASE WHEN {sql_hits('b', fixed.CRAWLER_SENSORS)} > 0 THEN 15 ELSE 0 END) AS INT) AS crawler_fit,
  CAST(round(least(0.98, 0.5 + CASE WHEN {sql_list(fixed.OFFICIAL_SOURCES)} @> [site] THEN 0.2 ELSE 0 END + CASE WHEN length(context) > 100 THEN 0.2 ELSE 0 END + CASE WHEN contains(context, 'Deadline') THEN 0.05 ELSE 0 END + CASE WHEN contains(context, 'Fully') THEN 0.05 ELSE 0 END), 2) AS DOUBLE) AS confidence
FROM x
""")
def scores(spark, d):
    c = C("context")
    return postings(spark, d).select(
        "seq", scoring.crawler_fit(C("title"), F.concat_ws(" ", "title", "context")).alias("crawler_fit"),
        scoring.record_confidence(pick(_SOURCES, C("seq")), F.length(c) > 100, c.contains("Deadline"), c.contains("Fully")).alias("confidence"),
    )


_REQUIREMENTS = ("MSc needed", "a PhD candidate with IELTS", "EU citizen, master degree", "", "TOEFL or resident permit")
_UNIVERSITIES = ("University of Toronto", "Nowhere", "TU Delft", "Otago")
_DEPARTMENTS = ("Kinesiology", "Physics", "", "Human Kinetics", "Rehabilitation")
_DESCRIPTIONS = ("with industry partners", "a collaboration", "plain")
_KINDS = ("FUNDED_PHD", "MASTER", "DOCTORAL_RESEARCHER")

_RANK_SQL = f"""
, x AS (SELECT seq, title, context, event_date, s_suppkey IS NOT NULL AS known, coalesce(s_suppkey, 0) AS k, {sql_pick(_REQUIREMENTS, 'seq')} AS req, lower({sql_pick(_UNIVERSITIES, 'seq')}) AS uni, lower({sql_pick(_DEPARTMENTS, 'seq')}) AS dept,
         {sql_pick(_DESCRIPTIONS, 'seq')} AS descr, {sql_pick(_KINDS, 'seq')} AS kind, DATE '1998-06-01' - event_date AS age FROM p LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) s ON s_suppkey = seq % 10000),
y AS (SELECT seq, CASE WHEN known THEN k * 7 % 101 ELSE 50.0 END AS research_fit,
  round((CASE WHEN contains(lower(title || ' ' || context), 'motion capture') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title || ' ' || context), 'deep learning') THEN 1 ELSE 0 END) * 50.0, 6) AS method_fit,
  CASE WHEN NOT known THEN 30.0 ELSE least(100.0, k * 7 % 101 + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END) END AS supervisor_fit,
  50.0 + CASE WHEN known THEN CASE WHEN k % 3 > 1 THEN 10 ELSE 0 END + CASE WHEN k % 6 > 0 THEN 10 ELSE 0 END + CASE WHEN k % 6 > 3 THEN 5 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END ELSE 0 END AS lab_fit,
  70.0 + CASE WHEN regexp_matches(lower(req), 'master|msc') THEN 10 ELSE 0 END - CASE WHEN contains(lower(req), 'phd') AND contains(lower(req), 'candidate') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(req), 'ielts|toefl') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower(req), 'citizen|resident') THEN 10 ELSE 0 END AS eligibility,
  CASE WHEN contains(context, 'EUR') THEN 90.0 ELSE 20.0 END AS funding,
  50.0 + CASE WHEN kind <> 'MASTER' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(descr, 'industry|collaboration') THEN 20 ELSE 0 END AS career_alignment,
  CASE WHEN age <= 0 THEN 100.0 ELSE 100 * exp(-age / 30.0) END AS freshness,
  50.0 + CASE WHEN known THEN CASE WHEN k * 40 % 900 < 365 THEN 20 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 6 > 2 THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN contains(context, 'EUR') THEN 5 ELSE 0 END AS opportunity_strength,
  60.0 + CASE WHEN {sql_hits('uni', scoring.TOP_UNIVERSITIES)} > 0 THEN 25 ELSE 0 END + CASE WHEN regexp_matches(dept, 'biomechanics|motor control|kinesiology|human kinetics|rehabilitation') THEN 10 ELSE 0 END AS institutional_fit FROM x),
z AS (SELECT seq, CAST({" + ".join(f"{k} * {v}" for k, v in fixed.RANKING_WEIGHTS.items())} AS DOUBLE) AS total FROM y)
SELECT seq, round(total, 4) AS overall, CASE WHEN round(total, 4) >= 85 THEN 'HIGH' WHEN round(total, 4) >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM z
"""


@query("j01_j02_s14_rank_positions", _RANK_SQL)
def rank_positions(spark, d):
    """Positions with the people they name, kept where nobody is known."""
    s, k = table(spark, d, "supplier").where("s_suppkey % 3 <> 0"), C("s_suppkey")
    pis = s.select(
        k, F.lit(True).alias("found"), (k * 7 % 101).alias("fit"), (k % 2 == 0).alias("verified"), (k % 4 == 0).alias("grants"), (k % 5 == 0).alias("hiring"), (k % 6).cast("int").alias("students"),
        (k % 3).alias("papers"), F.array(F.date_sub(as_of(), (k * 40 % 900).cast("int"))).alias("grant_dates"),
    )
    rows = postings(spark, d).withColumn("s_suppkey", C("seq") % 10000).join(pis, "s_suppkey", "left")
    q, text, known = C("seq"), F.concat_ws(" ", "title", "context"), F.coalesce("found", F.lit(False))
    no = lambda name: F.coalesce(C(name), F.lit(False))
    scores = {
        "research_fit": F.coalesce("fit", F.lit(50.0)), "method_fit": scoring.method_fit(text, ("motion capture", "deep learning")), "supervisor_fit": scoring.supervisor_fit(known, C("fit"), no("verified"), no("grants"), no("hiring")),
        "lab_fit": scoring.lab_fit(known, F.when(C("papers") > 1, 1).otherwise(0), F.coalesce("students", F.lit(0)), no("grants")), "eligibility": scoring.eligibility(pick(_REQUIREMENTS, q)), "funding": scoring.funding_score(titles.funding_amount(C("context")), F.lit("")),
        "career_alignment": scoring.career_alignment(("academic", "industry"), pick(_KINDS, q), pick(_DESCRIPTIONS, q)), "freshness": dates.freshness_decay(F.datediff(as_of(), C("event_date"))) * 100,
        "opportunity_strength": scoring.opportunity_strength(known, F.coalesce("grant_dates", F.array().cast("array<date>")), as_of(), no("hiring"), F.coalesce("students", F.lit(0)), C("context").contains("EUR")),
        "institutional_fit": scoring.institutional_fit(pick(_UNIVERSITIES, q), pick(_DEPARTMENTS, q)),
    }
    return rows.select("seq", scoring.overall(scores).alias("overall")).select("seq", "overall", scoring.tier(C("overall"), 85, 70).alias("priority"))


_WORDS = ("the", "and", "tion", "ing", "der", "las")


@query("j08_keyword_score", f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CAST(least(25.0, {" + ".join(f"least(25.0, 2.0 * (length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in _WORDS)}) AS DOUBLE) AS score FROM t
""", postings=False)
def keyword_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.keyword_score(C("text"), _WORDS, 25).alias("score"))


def _specialists(spark, d):
    """Parts as people: name, name with type and brand are their keywords, and
    their text names them as often as their size tells."""
    name = F.lower("p_name")
    keywords = F.array(name, F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lower("p_brand"))
    parts = table(spark, d, "part")
    return spread(parts, parts, "p_partkey").select(C("p_partkey").alias("pi_id"), keywords.alias("keywords"), F.repeat(F.concat(name, F.lit(" ")), C("p_size") % 14).alias("text"))


PROFILE = {
    "core_topics": ("Cold-widgets large", "small red bolt"), "adjacent_topics": ("blue rings promo",), "methods": ("widget", "bolt"), "technical_methods": ("gizmo",),
    "data_modalities": ("blue", "cold"), "populations": ("rod",),
}


@query("j07_s15_s17_research_fit", None)
def research_fit(spark, d):
    return scoring.research_fit(_specialists(spark, d), PROFILE)


@query("s16_fitting_people", None)
def fitting(spark, d):
    return scoring.fitting_people(scoring.research_fit(_specialists(spark, d), PROFILE))


@query("g17_fit_bands", None)
def fit_bands(spark, d):
    return scoring.band_counts(scoring.research_fit(_specialists(spark, d), PROFILE))


_TEXTS = ("We are open. Deadline: 3/4/1999, fully funded.", "Position filled; a stipend was paid", "The deadline was in May", "Apply now! due 1-2-99", "nothing here", "closed, salary 30k, apply by: 5/6/1999")
_URLS = ("https://x.edu/staff/a", "https://x.ac.uk/phd/1", "https://orcid.org/1", "https://euraxess.ec.europa.eu/2", "https://jobs.org/a")
_PRIORITY = {"https://x.edu/staff/a": 10, "https://x.ac.uk/phd/1": 9, "https://orcid.org/1": 6, "https://euraxess.ec.europa.eu/2": 4, "https://jobs.org/a": 1}


@query("s19_s23_verify_positions", f"""
, x AS (SELECT seq, {sql_pick(_URLS, 'seq')} AS u, {sql_pick(_TEXTS, '(seq // 5)')} || ' ' || context AS text FROM p),
y AS (SELECT *, lower(text) AS low, CAST(CASE u {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _PRIORITY.items())} END AS INT) AS source_priority FROM x),
z AS (SELECT *, {sql_first('low', fixed.STATUS_WORDS, 'UNKNOWN')} AS position_status, {sql_hits('low', fixed.FUNDING_WORDS)} > 0 AS funding_confirmed,
   coalesce({", ".join("nullif(regexp_extract(text, '(?i)" + p + "', 1), '')" for p in fixed.STATED_DEADLINES[:3])}) AS stated FROM y)
SELECT seq, position_status, funding_confirmed, source_priority, CASE WHEN position_status <> 'ACTIVE' THEN 'NONE' WHEN source_priority >= 8 THEN 'STRONG' WHEN source_priority >= 5 THEN 'MEDIUM' ELSE 'NONE' END AS verification_level,
   concat_ws('|', CASE WHEN position_status <> 'UNKNOWN' THEN 'position_status_' || lower(position_status) || '=true' END, 'application_deadline=' || stated, CASE WHEN funding_confirmed THEN 'funding_confirmed=true' END) AS evidence
FROM z
""")
def verify(spark, d):
    rows = postings(spark, d).select("seq", pick(_URLS, C("seq")).alias("source_url"), F.concat_ws(" ", pick(_TEXTS, whole(C("seq"), 5)), "context").alias("text"))
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["claim"], e["value"])), "|")
    return evidence.verify_positions(rows).select("seq", "position_status", "funding_confirmed", "source_priority", "verification_level", told.alias("evidence"))


@query("s22_published_evidence", f"""
, x AS (SELECT *, {sql_pick(_SOURCES, 'seq')} AS site, seq % 3 = 0 AS enriched, contains(context, 'Fully') AS funded, coalesce(regexp_extract(context, '[0-9]{{4}}-[0-9]+-[0-9]+'), '') AS deadline FROM p)
SELECT seq, 1 + CAST(enriched AS INT) + CAST(deadline <> '' AS INT) + CAST(funded AS INT) AS n_evidence,
  concat_ws('|', 'Listed as a doctoral opening on ' || source_label || ':' || title, CASE WHEN enriched THEN 'Detail page fetched and parsed:' || CAST(length(context) AS VARCHAR) || ' chars of description, country=' || country END,
   CASE WHEN deadline <> '' THEN 'Application deadline found on the page:' || deadline END, CASE WHEN funded THEN 'Funding or salary language present:Yes' END) AS told,
  CASE WHEN {sql_list(fixed.OFFICIAL_SOURCES)} @> [site] THEN 'official' ELSE 'aggregator' END AS first_type,
  round(least(0.98, 0.5 + CASE WHEN {sql_list(fixed.OFFICIAL_SOURCES)} @> [site] THEN 0.2 ELSE 0 END + CASE WHEN enriched THEN 0.2 ELSE 0 END + CASE WHEN deadline <> '' THEN 0.05 ELSE 0 END + CASE WHEN funded THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS first_confidence
FROM x
""")
def published_evidence(spark, d):
    rows = postings(spark, d).withColumns({
        "source": pick(_SOURCES, C("seq")), "enriched": C("seq") % 3 == 0, "has_funding_evidence": C("context").contains("Fully"), "description_full": C("context"), "deadline": F.regexp_extract("context", r"[0-9]{4}-[0-9]+-[0-9]+", 0),
    })
    e = evidence.published_evidence()
    made = rows.select("seq", e.alias("e"))
    return made.select("seq", F.size("e").alias("n_evidence"), F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["claim"], x["value"])), "|").alias("told"), C("e")[0]["source_type"].alias("first_type"), C("e")[0]["confidence"].alias("first_confidence"))


_BARE = "WITH base AS (" + POSTINGS_ORACLE + "), p AS (SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN split_part(title, ' in ', 1) ELSE title END AS title, context || CASE WHEN seq % 2 = 0 THEN ' ' || repeat('The work needs careful thought and much time. ', 4) ELSE '' END AS context) FROM base)"


@query("s28_rescue", _BARE + _GATED + """
SELECT seq, CAST(fit AS INT) AS fit FROM g WHERE bad_role = 0 AND bad_field = 0 AND doc > 0 AND seq % 3 <> 0 AND length(context) >= 180 AND status <> 'expired' AND fit > 0
""", postings=False)
def rescue(spark, d):
    """Titles that name no discipline, judged by the description of their
    detail page."""
    rows = spread_postings(spark, d).withColumn("title", F.when(C("seq") % 3 != 0, F.split_part("title", F.lit(" in "), F.lit(1))).otherwise(C("title")))
    candidates = evidence.rescue_candidates(rows)
    full = F.concat("context", F.when(C("seq") % 2 == 0, F.concat(F.lit(" "), F.repeat(F.lit("The work needs careful thought and much time. "), 4))).otherwise(""))
    paged = candidates.withColumn("description_full", full).withColumn("context", F.lit(""))
    # a second look at each description's deadline happens for full ones only
    alive = dates.deadline(C("description_full"), as_of())["status"] != "expired"
    return evidence.rescued(paged, alive).select("seq", "fit")


@query("s29_rescore", _GATED + "SELECT seq, CAST(fit AS INT) AS fit FROM g WHERE status <> 'expired' AND fit > 0")
def rescore(spark, d):
    rows = spread_postings(spark, d).withColumn("description_full", F.when(C("seq") % 2 == 0, C("context")).otherwise(""))
    return evidence.rescored(rows, dates.deadline(C("context"), as_of())["status"] != "expired").select("seq", "fit")


@query("f14_f15_site_filters", """
, x AS (SELECT seq, title, university, country, seq % 101 AS fit, CASE WHEN seq % 101 >= 75 THEN 'HIGH' WHEN seq % 101 >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS tier, split_part(title, ' in ', 2) AS field, CASE WHEN contains(context, 'Fully') THEN 'yes' ELSE '' END AS funding FROM p)
SELECT seq, (contains(lower(title), 'motor') OR contains(lower(university), 'motor')) AND country = 'NATION_1' AND fit >= 30 AS on_site, tier = 'HIGH' AS high_only,
       country IN ('NATION_1', 'NATION_12') AND field IN ('Motor Control', 'Neuroscience') AND funding <> '' AND fit >= 50 AND tier IN ('HIGH', 'MEDIUM') AS in_app FROM x
""")
def site_filters(spark, d):
    rows = postings(spark, d).withColumns({
        "research_fit_score": C("seq") % 101, "contact_priority": scoring.tier(C("seq") % 101, 75, 55), "pi_name": F.lit(None).cast("string"), "research_domain": F.split_part("title", F.lit(" in "), F.lit(2)),
        "funding": F.when(C("context").contains("Fully"), "yes").otherwise(""),
    })
    return rows.select(
        "seq", gates.matches_site_filter("Motor", "NATION_1", least=30).alias("on_site"), gates.matches_site_filter(priority="HIGH").alias("high_only"),
        gates.matches_app_filter(("NATION_1", "NATION_12"), ("Motor Control", "Neuroscience"), True, 50, ("HIGH", "MEDIUM")).alias("in_app"),
    )


_SCHOOLS = ("University of Oslo", "Kunsthochschule Berlin", "Hogeschool Utrecht", "Akademie X", "Chalmers", "Military Academy", "Institute of Rocks", "Univ of Y")


@query("f17_university_eligibility", f"""
WITH u AS (SELECT c_custkey, {sql_pick(_SCHOOLS, 'c_custkey')} AS name, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://u.org' END AS url, c_custkey * 13 % 600 AS papers FROM customer)
SELECT c_custkey, CASE WHEN url = '' THEN 'no_official_url' WHEN {sql_like('name', fixed.NO_RESEARCH_SCHOOL)} THEN 'non_research_school' WHEN {sql_like('name', fixed.APPLIED_SCHOOL)} THEN 'applied_sciences_or_arts'
   WHEN {sql_like('name', fixed.DOCTORAL_SCHOOL)} AND papers >= 40 OR papers >= 400 THEN NULL ELSE 'low_research_activity' END AS reason FROM u
""", postings=False)
def eligibility(spark, d):
    k = C("c_custkey")
    return table(spark, d, "customer").select("c_custkey", gates.university_exclusion(pick(_SCHOOLS, k), F.when(k % 11 == 0, "").otherwise("https://u.org"), k * 13 % 600).alias("reason"))


@query("f16_target_selection", """
WITH u AS (SELECT c_custkey, n_name AS country, left(n_name, 2) AS code, 'https://u' || CAST(c_custkey AS VARCHAR) || '.org' AS homepage, c_custkey * 31 % 997 AS papers FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, papers FROM u WHERE (contains(lower(country), 'nation_1') OR lower(code) = 'nation_1') AND c_custkey % 5 <> 0 ORDER BY papers DESC, c_custkey LIMIT 25
""", postings=False)
def target_selection(spark, d):
    from postmill.sources.scans import select_targets

    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("c_nationkey") == C("n_nationkey"))
    k = C("c_custkey")
    u = c.select(k, C("n_name").alias("country"), F.left("n_name", F.lit(2)).alias("country_code"), F.concat(F.lit("https://u"), k.cast("string"), F.lit(".org/?x=1")).alias("homepage"), (k * 31 % 997).alias("openalex_papers"), k.alias("seq"))
    boards = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("https://u"), k.cast("string"), F.lit(".org")).alias("homepage"))
    return select_targets(u, boards, "Nation_1", 25, only_missing=True).select("c_custkey", C("openalex_papers").alias("papers"))


@query("w14_largest_silent", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20", postings=False)
def largest_silent(spark, d):
    boards = table(spark, d, "supplier").select(C("s_suppkey").alias("board"), C("s_acctbal").alias("papers"), (C("s_suppkey") % 4).alias("found"), F.when(C("s_suppkey") % 3 == 0, "skipped").alias("note"))
    return people.largest_silent(boards, 20).select(C("board").alias("s_suppkey"), C("papers").alias("s_acctbal"))


_V07 = (("NATION_1", ("stipend",)), ("NATION_12", ("funded", "eur")), ("NATION_7", ("scholarship",)))


@query("v05_v07_exclusions_funding", f"""
, x AS (SELECT seq, lower(title || ' ' || context) AS b, country FROM p)
SELECT seq, {sql_hits('b', ('chemistry', 'combinatorics'))} = 0 AS allowed, coalesce(CASE country WHEN 'NATION_1' THEN contains(b, 'stipend') WHEN 'NATION_12' THEN contains(b, 'funded') OR contains(b, 'eur') WHEN 'NATION_7' THEN contains(b, 'scholarship') END, false) AS funded_words FROM x
""")
def exclusions(spark, d):
    from postmill.operators.ranking import excludes, funded_by_country

    rows = postings(spark, d).withColumn("blob", F.lower(F.concat_ws(" ", "title", "context"))).withColumn("hard_exclusions", F.array(F.lit("Chemistry"), F.lit("combinatorics")))
    words = spark.createDataFrame([(c, list(w)) for c, w in _V07], "country string, funding_keywords array<string>")
    return funded_by_country(rows, words, "blob").select("seq", (~excludes(C("blob"), C("hard_exclusions"))).alias("allowed"), "funded_words")


def _listing(spark, d):
    """Listing pages made of the postings: one for each ten orders, so that
    pages grow in number and not in length."""
    p = postings(spark, d).select("seq", "url", "title", "context", whole(C("seq"), 100_000_000_000).alias("page_id"))
    said = lambda name: F.coalesce(name, F.lit("null"))
    link = F.concat(F.lit('<li><a href="'), said("url"), F.lit('">'), said("title"), F.lit("</a> "), said("context"), F.lit("</li>"))
    rows = p.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", link.alias("h"))))["h"], "\n").alias("items"))
    page = F.concat(F.lit('<html><h1>Research jobs</h1><a href="/home">Home</a> <a href="/careers">Careers at Example</a> <a href="/about-us">About</a> <a href="https://other.net/jobs">Other jobs</a>'), "items", F.lit('<a href="?page='), (F.col("page_id") % 4 + 2).cast("string"), F.lit('">Next page</a></html>'))
    return rows.select("page_id", F.concat(F.lit("https://list.example.org/jobs?page="), (F.col("page_id") % 4).cast("string")).alias("url"), page.alias("html"))


@query("h01_harvest", None)
def harvest(spark, d):
    return pages.harvest(_listing(spark, d), as_of())


@query("f23_verified_boards", None)
def verified_boards(spark, d):
    return pages.verified_boards(_listing(spark, d).unionByName(table(spark, d, "pages").select((-1 - C("page_id")).alias("page_id"), "url", "html")), as_of())


@query("h02_board_links", None)
def board_links(spark, d):
    return pages.board_links(_listing(spark, d)).select("page_id", "rank", "url", "text", "score")


_LINKED = f"""
, l AS (SELECT seq, seq // 100000000000 AS page_id, title, url AS raw, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) || '?page=2' ELSE rtrim(url, '/') END AS u FROM p WHERE NOT contains(url, '#')),
v AS (SELECT page_id, arg_min(title, seq) AS title FROM l WHERE length(title) BETWEEN 15 AND 240 AND {sql_like('u', fixed.DETAIL_LINK)} AND {sql_like('title', fixed.ROLE_TITLE)} AND NOT {sql_like('title', fixed.BROWSE_TEXT)} AND NOT {sql_like('title', fixed.STUDENT_SUPPORT)} GROUP BY page_id, u),
n AS (SELECT page_id, count(*) AS vacancies, count(*) FILTER ({sql_like('title', fixed.DOCTORAL_ROLE)}) AS doctoral FROM v GROUP BY page_id), g AS (SELECT DISTINCT seq // 100000000000 AS page_id FROM p)
"""


@query("h04_h10_vacancy_next", _LINKED + "SELECT page_id, coalesce(vacancies, 0) AS vacancies, coalesce(doctoral, 0) AS doctoral, 'https://list.example.org/jobs?page=' || CAST(page_id % 4 + 2 AS VARCHAR) AS next_url FROM g LEFT JOIN n USING (page_id)")
def vacancy_next(spark, d):
    p = _listing(spark, d)
    v = pages.vacancy_links(p).groupBy("page_id").agg(row_count().alias("vacancies"), F.count_if("is_phd").alias("doctoral"))
    return p.select("page_id").join(v, "page_id", "left").join(pages.next_page(pages.anchors(p)), "page_id", "left").select("page_id", F.coalesce("vacancies", F.lit(0).cast("long")).alias("vacancies"), F.coalesce("doctoral", F.lit(0).cast("long")).alias("doctoral"), "next_url")


@query("h05_h07_links", _LINKED + f"""
SELECT page_id, count(DISTINCT u) FILTER (length(title) >= 20 AND NOT {sql_like('title', fixed.NOISE_TEXT)} AND ({sql_like('title', fixed.DOCTORAL_TEXT)} OR {sql_like('title', fixed.JOB_TEXT)})) AS recovered, 2 AS careers, 4 + count(DISTINCT split_part(raw, '&', 1)) AS results
FROM g LEFT JOIN l USING (page_id) GROUP BY page_id
""")
def other_links(spark, d):
    p = _listing(spark, d)
    hits = p.withColumn("html", F.regexp_replace("html", 'href="https://board', 'href="https://duck.example/l/?uddg=https%3A%2F%2Fboard'))
    some = lambda df, kind: df.groupBy("page_id").agg(row_count().alias(kind))
    rows = p.select("page_id")
    for kind, df in (("recovered", pages.recovered_links(p)), ("careers", pages.careers_links(p)), ("results", pages.result_links(hits, F.lit("example.org")))):
        rows = rows.join(some(df, kind), "page_id", "left")
    return rows.na.fill(0)


@query("h08_h21_descriptions", None)
def descriptions(spark, d):
    return table(spark, d, "pages").select("page_id", pages.description(C("html")).alias("description"), pages.heading(C("html")).alias("heading"), F.size(pages.requirements(C("html"))).alias("requirements"))


def _details(spark, d):
    """Detail pages of some postings, one for each address."""
    p = postings(spark, d).where("seq % 3 = 0").groupBy("url").agg(F.min(F.struct("seq", "title", "context")).alias("x")).select("url", "x.*")
    prose = F.concat(F.col("context"), F.lit(" "), F.repeat(F.lit("The work needs careful thought and much time. "), 5))
    html = F.concat(F.lit('<html><head><meta property="og:site_name" content="Site '), (C("seq") % 7).cast("string"), F.lit('"></head><nav><p>menu</p></nav><h1>'), "title", F.lit("</h1><p>"), prose, F.lit("</p></html>"))
    return p.select("url", html.alias("html"))


@query("h09_enrich", None)
def enrich(spark, d):
    rows = spread_postings(spark, d).select("seq", "url", "title", "context", F.when(C("seq") % 2 == 0, "").otherwise(C("country")).alias("country"))
    return pages.enrich(rows, _details(spark, d), as_of()).drop("context", "title")


@query("g03_enrichment_counts", """
, u AS (SELECT url, min(seq) AS first FROM p WHERE seq % 3 = 0 GROUP BY url), x AS (SELECT p.*, u.first IS NOT NULL AS enriched, f.context AS detail FROM p LEFT JOIN u USING (url) LEFT JOIN p f ON f.seq = u.first)
SELECT count(*) AS total, count(*) FILTER (enriched) AS enriched, count(*) FILTER (seq % 2 <> 0) AS with_country,
       count(*) FILTER (enriched AND (regexp_matches(context || ' ' || detail, '(Deadline: [0-9]|Apply by [0-9]|Closing date [0-9])'))) AS with_deadline,
       count(*) FILTER (enriched AND regexp_matches(context || ' ' || detail, '(?i)fully funded|per month')) AS with_funding FROM x
""")
def enrichment_counts(spark, d):
    return pages.enrichment_counts(enrich(spark, d))


@query("h24_g18_best_page", _LINKED + """
, c AS (SELECT page_id, page_id % 9 AS university, coalesce(vacancies, 0) AS vacancies FROM g LEFT JOIN n USING (page_id)),
b AS (SELECT university, arg_max(page_id, vacancies * 1000000000 - page_id) AS page_id, max(vacancies) AS vacancies, CAST(sum(vacancies) AS BIGINT) AS total FROM c GROUP BY university)
SELECT *, CASE WHEN vacancies >= 3 THEN 'JOB_LIST' WHEN vacancies > 0 THEN 'LANDING' ELSE 'NONE' END AS status FROM b
""")
def best_page(spark, d):
    """The page with most vacancies for each university."""
    p = _listing(spark, d)
    v = pages.vacancy_links(p).groupBy("page_id").agg(row_count().alias("vacancies"))
    counted = p.select("page_id").join(v, "page_id", "left").select("page_id", (C("page_id") % 9).alias("university"), F.coalesce("vacancies", F.lit(0).cast("long")).alias("vacancies"))
    return people.best_page(counted)


_PEOPLE_TOPICS = ("gait", "polymer")


@query("s18_s24_topic_discovery", """
WITH w AS (SELECT DISTINCT l_suppkey AS person, l_partkey % 7 AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
t(k, title) AS (VALUES (0, 'Deep learning of gait'), (1, 'Motor control'), (2, 'Polymer physics'), (3, 'Balance'), (4, 'Neural coding'), (5, 'Wearables'), (6, 'Gait analysis')),
a AS (SELECT person, lower(string_agg(title, ' ' ORDER BY k)) AS papers FROM w JOIN t USING (k) GROUP BY person),
f AS (SELECT person, pos, topic, 40 + CASE WHEN regexp_matches(topic || ' ' || papers, 'balance|biomechanics') THEN 20 ELSE 0 END + CASE WHEN contains(topic || ' ' || papers, 'deep learning') THEN 15 ELSE 0 END
        + CASE WHEN person % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN person * 97 % 2000 > 1000 THEN 10 ELSE 0 END AS fit FROM a, (VALUES (0, 'gait'), (1, 'polymer')) v(pos, topic) WHERE contains(papers, topic)),
m AS (SELECT person, arg_min(topic, pos) AS topic, arg_min(fit, pos) AS fit FROM f GROUP BY person)
SELECT person, topic, CAST(fit AS INT) AS fit, CASE WHEN person % 2 = 0 THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS level FROM m WHERE fit >= 70
""", postings=False)
def topic_discovery(spark, d):
    names = F.array(*map(F.lit, ("Deep learning of gait", "Motor control", "Polymer physics", "Balance", "Neural coding", "Wearables", "Gait analysis")))
    w = table(spark, d, "lineitem").select(C("l_suppkey").alias("person"), (C("l_partkey") % 7).cast("int").alias("k")).distinct()
    papers = w.groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.get(names, k)), " ").alias("papers")).join(table(spark, d, "supplier").select(C("s_suppkey").alias("person")), "person")
    topics = F.array(*(F.struct(F.lit(i).alias("topic_pos"), F.lit(t).alias("topic")) for i, t in enumerate(_PEOPLE_TOPICS)))
    found = papers.select("person", "papers", F.explode(topics).alias("t")).select("person", "papers", "t.*").where(F.contains(F.lower("papers"), C("topic")))
    orcid = C("person") % 2 == 0
    fit = people.topic_fit(C("topic"), C("papers"), ("Balance", "biomechanics"), ("Deep Learning",), orcid, C("person") * 97 % 2000)
    return people.discover(found.select("person", "topic", "topic_pos", fit.alias("fit"), orcid.alias("has_orcid")), 70)


@query("s30_people_by_name", """
WITH w AS (SELECT l_suppkey AS person, count(DISTINCT l_orderkey) AS works FROM lineitem GROUP BY 1)
SELECT person, s_name AS name, works, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'University of ' || n_name END AS institution FROM w JOIN supplier ON s_suppkey = person JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '00') AND works > 30
""", postings=False)
def people_by_name(spark, d):
    works = table(spark, d, "lineitem").select(C("l_suppkey").alias("person"), "l_orderkey").distinct().groupBy("person").agg(row_count().alias("works"))
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), C("s_nationkey") == C("n_nationkey"))
    place = F.struct(F.concat(F.lit("University of "), C("n_name")).alias("name"), C("n_name").alias("country"))
    rows = s.select(C("s_suppkey").alias("person"), C("s_name").alias("name"), F.when(C("s_suppkey") % 3 != 0, F.array(place)).otherwise(F.array().cast("array<struct<name:string,country:string>>")).alias("institutions"))
    return people.by_name(rows.join(works, "person").withColumn("citations", F.lit(0)), "00").select("person", "name", "works", "institution")


@query("w17_recent_works", """
WITH a AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS work, CAST(o_orderdate AS DATE) AS published FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY published DESC, work) AS rank FROM a)
SELECT person, string_agg(CAST(work AS VARCHAR), ',' ORDER BY rank) AS works FROM r WHERE rank <= 10 GROUP BY person
""", postings=False)
def recent_works(spark, d):
    a = table(spark, d, "lineitem").select(C("l_suppkey").alias("person"), C("l_orderkey").alias("work")).distinct()
    dated = a.join(table(spark, d, "orders").select(C("o_orderkey").alias("work"), C("o_orderdate").cast("date").alias("published")), "work")
    return people.recent_works(dated).select("person", F.array_join("works", ",").alias("works"))


@query("g13_grants", """
WITH f AS (SELECT l_suppkey AS person, l_orderkey * 10 + l_linenumber AS seq, 'Funder ' || CAST(l_partkey % 5 AS VARCHAR) AS funder, 'A' || CAST(l_partkey % 13 AS VARCHAR) AS award FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT person, funder, award, min(seq) AS seq FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY seq, funder, award) AS rank FROM u)
SELECT person, funder, award, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10
""", postings=False)
def grants(spark, d):
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    funded = l.select(C("l_suppkey").alias("person"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("seq"), F.concat(F.lit("Funder "), (C("l_partkey") % 5).cast("string")).alias("funder"), F.concat(F.lit("A"), (C("l_partkey") % 13).cast("string")).alias("award"), C("l_orderkey").cast("string").alias("title"))
    return people.grants(funded).select("person", "funder", "award", "rank")


@query("g20_g21_g28_board_rollup", """
WITH b AS (SELECT c_nationkey AS board, count(*) FILTER (c_acctbal > 5000) AS found FROM customer GROUP BY 1),
s AS (SELECT *, CASE WHEN n_regionkey = 0 THEN 'skipped' WHEN found > 0 THEN 'with_data' ELSE 'silent' END AS state FROM b JOIN nation ON n_nationkey = board)
SELECT n_regionkey AS region, count(*) AS boards, count(*) FILTER (state <> 'skipped') AS crawled, count(*) FILTER (state = 'with_data') AS with_data, count(*) FILTER (state = 'silent') AS silent, count(*) FILTER (state = 'skipped') AS skipped,
       CAST(sum(CASE WHEN state <> 'skipped' THEN found ELSE 0 END) AS BIGINT) AS postings FROM s GROUP BY 1
""", postings=False)
def board_rollup(spark, d):
    found = table(spark, d, "customer").groupBy(C("c_nationkey").alias("board")).agg(F.count_if(C("c_acctbal") > 5000).alias("found"))
    n = table(spark, d, "nation").select(C("n_nationkey").alias("board"), C("n_regionkey").alias("region"))
    rows = n.join(found, "board").withColumn("status", F.when(C("region") == 0, "skipped").otherwise("crawled"))
    return people.board_report(rows, "region")


@query("e02_e08_subscribers", """
WITH c AS (SELECT c_custkey, [c_mktsegment, 'gait'] AS old, CASE WHEN c_custkey % 3 = 0 THEN ['balance', 'gait'] ELSE [] END AS new, c_custkey % 4 <> 0 AS confirmed, c_custkey % 6 = 0 AS gone FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(old, new))), ',') AS interests, confirmed AND NOT gone AS active FROM c
""", postings=False)
def subscriber_sets(spark, d):
    from postmill.operators.dedupe import active, merged_interests, unsubscribe

    k = C("c_custkey")
    c = table(spark, d, "customer").select(k, F.array("c_mktsegment", F.lit("gait")).alias("old"), F.when(k % 3 == 0, F.array(F.lit("balance"), F.lit("gait"))).otherwise(F.array().cast("array<string>")).alias("new"), (k % 4 != 0).alias("confirmed"), F.lit(False).alias("unsubscribed"))
    left = unsubscribe(c, table(spark, d, "customer").where("c_custkey % 6 = 0").select(k), "c_custkey")
    return left.select("c_custkey", F.array_join(merged_interests(C("old"), C("new")), ",").alias("interests"), active().alias("active"))
