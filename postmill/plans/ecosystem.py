"""Queries over institutions, people, works and funders of the star schema:
suppliers are institutions, customers people, orders works, line items
authorships."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.operators import people as ops
from postmill.plans.base import query, sql_hits
from postmill.sources.postings import table

C = F.col

#: SQL that Spark and DuckDB run unchanged, but for the brackets of arrays.
_SQL = {
    "institutions": "SELECT s_suppkey AS institution, s_name AS institution_name, 'C' || CAST(s_nationkey % 6 AS STRING) AS country, CASE WHEN s_suppkey % 3 = 0 THEN 'Town ' || s_name END AS city, CASE WHEN s_suppkey % 7 = 0 THEN 'company' ELSE 'education' END AS kind, CAST(floor(s_acctbal) AS BIGINT) AS works, [s_suppkey % 11, s_suppkey * 3 % 11, s_suppkey * 5 % 11] AS concepts FROM supplier",
    "people": "SELECT c_custkey AS person, c_name AS person_name, CAST(floor(c_acctbal) AS BIGINT) AS cited, c_custkey % 110 AS institution, [c_custkey % 11, c_custkey * 7 % 11] AS concepts, [c_custkey % 110, c_custkey * 3 % 50, c_custkey % 40] AS places FROM customer",
    "works": """SELECT o_orderkey AS work, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderkey % 5 WHEN 0 THEN 'PhD position on gait' WHEN 1 THEN 'A study' WHEN 2 THEN 'Fully Funded work ' || o_orderpriority WHEN 3 THEN 'Recruiting' ELSE repeat('long ', 120) END AS work_title,
        CASE WHEN o_orderkey % 4 = 0 THEN 'We look for a graduate student. ' || o_orderpriority WHEN o_orderkey % 4 = 1 THEN '' END AS abstract, CASE o_orderkey % 3 WHEN 0 THEN '10.1/' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'https://doi.org/10.2/x' END AS doi,
        [o_orderkey % 11, o_orderkey * 3 % 11] AS concepts, [o_custkey % 9, o_custkey % 4] AS funders FROM orders""",
    "authorships": "SELECT l_orderkey AS work, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS pos, l_partkey AS person, CASE WHEN l_quantity > 5 THEN l_suppkey END AS institution FROM lineitem",
}
_CONCEPTS, _COUNTRIES, _FUNDERS, _YEAR = (3, 7, 1, 9), ("C1", "C4", "C0"), (2, 8, 5, 1, 3, 7), 1997


def _view(spark, d, name):
    sql = _SQL[name].replace("[", "array(").replace("]", ")")
    t = sql.rsplit(" FROM ", 1)[1]
    return spark.sql(sql.replace(f"FROM {t}", "FROM {" + t + "}"), **{t: table(spark, d, t)})


def _listed(spark, values, kind="long"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"value {kind}, pos int")


def _values(name, values):
    return f"{name}(value, pos) AS (VALUES " + ", ".join(f"({v!r}, {i})" for i, v in enumerate(values)) + ")"


_WITH = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in _SQL.items()) + ", " + ", ".join((_values("wanted", _CONCEPTS), _values("countries", _COUNTRIES), _values("paying", _FUNDERS)))


def _position(w="w", p="p", i="i"):
    return f"""'https://openalex.org/' || CAST({w}.work AS VARCHAR) AS source_url, left('PhD Position in ' || coalesce(work_title, 'Research'), 500) AS title, coalesce({i}.institution_name, '') AS university, upper(coalesce({i}.country, '')) AS country, {i}.city,
       left(nullif(abstract, ''), 2000) AS description, CASE WHEN doi = '' OR starts_with(doi, 'http') THEN doi ELSE 'https://doi.org/' || doi END AS application_url, coalesce({p}.person_name, '') AS pi_name"""


@query("j10_institutions_by_concept", _WITH + """,
x AS (SELECT institution AS id, country, works, unnest(list_distinct(concepts)) AS concept FROM institutions WHERE kind = 'education'),
m AS (SELECT x.*, w.pos AS cp, c.pos AS np FROM x JOIN wanted w ON w.value = concept JOIN countries c ON c.value = country WHERE w.pos < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cp, np ORDER BY works DESC, id) AS rn FROM m)
SELECT id, arg_min(concept, cp * 1000 + np) AS matched_concept, arg_min(country, cp * 1000 + np) AS matched_country FROM r WHERE rn <= 5 GROUP BY id
""", postings=False)
def institutions_by_concept(spark, d):
    concepts, countries = _listed(spark, _CONCEPTS).toDF("concept", "concept_pos"), _listed(spark, _COUNTRIES, "string").toDF("country", "country_pos")
    return ops.institutions_by_concept(_view(spark, d, "institutions").withColumnRenamed("institution", "id"), concepts, countries, most_concepts=3, most=5)


@query("s25_discover_at", _WITH + """,
e AS (SELECT person, institution AS university, cited, person * 37 % 101 AS fit, CASE person % 3 WHEN 0 THEN 'a@b.c' WHEN 1 THEN '' END AS email, CASE WHEN person % 4 <> 3 THEN (person % 20) / 20.0 END AS confidence, person % 2 = 0 AS verified FROM people),
r AS (SELECT *, row_number() OVER (PARTITION BY university ORDER BY cited DESC, person) AS rank FROM e WHERE university < 25)
SELECT person, university, CAST(rank AS INT) AS rank, fit, CASE WHEN verified AND coalesce(confidence, 0) >= 0.9 THEN 'VERIFIED' WHEN coalesce(email, '') <> '' AND coalesce(confidence, 0) >= 0.7 THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS level FROM r WHERE rank <= 30 AND fit >= 70
""", postings=False)
def discover_at(spark, d):
    k = C("person")
    who = _view(spark, d, "people").select(k, C("institution").alias("university"), "cited", (k * 37 % 101).alias("fit"), F.when(k % 3 == 0, "a@b.c").when(k % 3 == 1, "").alias("email"), F.when(k % 4 != 3, (k % 20) / 20.0).alias("confidence"), (k % 2 == 0).alias("verified"))
    mapped = who.select("university").distinct().select("university", C("university").alias("pos"))
    return ops.discover_at(mapped, who)


@query("s27_funded_positions", _WITH + f""",
f AS (SELECT *, unnest(list_distinct(funders)) AS funder FROM works WHERE year = {_YEAR}),
s AS (SELECT work FROM (SELECT work, row_number() OVER (PARTITION BY funder ORDER BY work) AS rn FROM f JOIN paying ON paying.value = funder WHERE paying.pos < 5) WHERE rn <= 50 GROUP BY work),
h AS (SELECT w.*, (SELECT arg_min(value, pos) FROM wanted WHERE list_contains(w.concepts, value)) AS first_match FROM works w JOIN s USING (work)),
a AS (SELECT work, arg_min(person, pos) AS person, arg_min(coalesce(institution, -1), pos) AS institution FROM authorships GROUP BY work)
SELECT w.work, a.person, a.institution, first_match, {_position()}, 'https://openalex.org/' || CAST(a.person AS VARCHAR) AS pi_profile_url
FROM h w JOIN a USING (work) LEFT JOIN people p ON p.person = a.person LEFT JOIN institutions i ON i.institution = a.institution
WHERE first_match IS NOT NULL AND a.institution >= 0 AND {sql_hits("lower(concat_ws(' ', work_title, abstract))", fixed.HIRING)} > 0
""", postings=False)
def funded_positions(spark, d):
    get = lambda n: _view(spark, d, n)
    return ops.funded_positions(get("works"), get("authorships"), get("people").select("person", "person_name"), get("institutions").select("institution", "institution_name", "country", "city"), _listed(spark, _FUNDERS), _listed(spark, _CONCEPTS), _YEAR)


@query("s31_concept_positions", _WITH + f""",
t AS (SELECT i.*, unnest(list_distinct(concepts)) AS concept FROM institutions i JOIN countries c ON c.value = country WHERE kind = 'education'),
t1 AS (SELECT *, row_number() OVER (PARTITION BY concept, country ORDER BY works DESC, institution) AS rn FROM t WHERE concept IN (SELECT value FROM wanted WHERE pos < 10)),
p0 AS (SELECT *, unnest(list_distinct(concepts)) AS concept FROM people),
p AS (SELECT p0.person, p0.person_name, p0.institution, p0.concept, t1.institution_name, t1.country, t1.city, row_number() OVER (PARTITION BY p0.institution, p0.concept ORDER BY cited DESC, person) AS rn FROM p0 JOIN t1 ON t1.institution = p0.institution AND t1.concept = p0.concept AND t1.rn <= 20),
m AS (SELECT a.person, w.*, row_number() OVER (PARTITION BY a.person ORDER BY w.work) AS rn FROM (SELECT DISTINCT work, person FROM authorships) a JOIN works w USING (work) WHERE year = {_YEAR})
SELECT w.work, p.person, p.institution, p.concept, {_position(i="p")}, 'https://openalex.org/' || CAST(p.person AS VARCHAR) AS pi_profile_url
FROM p JOIN m w ON w.person = p.person WHERE p.rn <= 30 AND w.rn <= 10 AND {sql_hits("lower(concat_ws(' ', work_title, abstract))", fixed.HIRING)} > 0
""", postings=False)
def concept_positions(spark, d):
    get = lambda n: _view(spark, d, n)
    countries = _listed(spark, _COUNTRIES, "string").select(C("value").alias("country"))
    return ops.concept_positions(get("works"), get("authorships"), get("people"), get("institutions"), _listed(spark, _CONCEPTS), countries, _YEAR)


@query("g11_top_concept_groups", """
WITH n AS (SELECT l_suppkey AS person, 'concept ' || CAST(l_partkey % 9 AS VARCHAR) AS concept, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, concept) AS rn FROM n) WHERE rn <= 3),
m AS (SELECT s_nationkey AS institution, concept, person, count(*) OVER (PARTITION BY s_nationkey, concept) AS members FROM t JOIN supplier ON s_suppkey = person)
SELECT institution, concept, concept || ' Research Group' AS name, person, members FROM m WHERE members >= 2
""", postings=False)
def top_concept_groups(spark, d):
    counted = table(spark, d, "lineitem").groupBy(C("l_suppkey").alias("person"), F.concat(F.lit("concept "), (C("l_partkey") % 9).cast("string")).alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    at = table(spark, d, "supplier").select(C("s_suppkey").alias("person"), C("s_nationkey").alias("institution"))
    return ops.research_groups(ops.top_concepts(counted).join(at, "person"))


@query("g12_sub_institutions", _WITH + """
SELECT institution, part, count(*) AS authors FROM (SELECT person, institution, unnest(list_distinct(places)) AS part FROM people) WHERE part <> institution GROUP BY 1, 2
""", postings=False)
def sub_institutions(spark, d):
    return ops.sub_institutions(_view(spark, d, "people"))
