"""Queries of the declared tables, filled from the given star schema.

``ROWS`` is SQL that Spark and DuckDB run unchanged.  The rows break rules on
purpose: names that are too long, states that no domain has, numbers beyond
their precision, references to nobody, keys that repeat.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postmill.plans.base import query, sql_list
from postmill.sources import declared
from postmill.sources.postings import table


def _uuid(kind: str, value: str) -> str:
    m = f"md5('{kind}' || CAST({value} AS STRING))"
    return f"substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12)"


ROWS = {
    "universities": f"""SELECT {_uuid('u', 'n_nationkey')} AS id, CASE WHEN n_nationkey % 9 = 0 THEN 'University' ELSE 'University of ' || n_name END AS name,
        CASE WHEN n_nationkey % 9 = 0 THEN 'XX' WHEN n_nationkey = 7 THEN n_name ELSE substr(n_name, 1, 2) END AS country_code, CASE n_nationkey % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '[1, 2' ELSE 'true' END AS ranking_data FROM nation""",
    "departments": f"SELECT {_uuid('d', 's_suppkey')} AS id, {_uuid('u', 's_nationkey')} AS university_id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS name FROM supplier",
    "pis": f"""SELECT {_uuid('p', 'c_custkey')} AS id, c_name AS name, {_uuid('u', 'c_nationkey')} AS university_id, {_uuid('d', 'c_custkey % 130')} AS department_id,
        CASE WHEN c_custkey % 4 = 0 THEN 'WEAK' WHEN c_custkey % 4 = 1 THEN 'STRONG' END AS verification_level, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE CAST(CAST(c_acctbal AS INT) AS STRING) END AS research_fit_score, CASE WHEN c_nationkey = 3 THEN c_mktsegment ELSE '4' END AS phd_students_count FROM customer""",
    "positions": f"""SELECT {_uuid('o', 'l_orderkey * 10 + l_linenumber')} AS id, 'c' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS canonical_id, repeat('title ', CAST(l_quantity AS INT) * 4) AS title,
        CASE l_linestatus WHEN 'F' THEN 'POSTDOC' WHEN 'O' THEN 'PHD_CALL' END AS opportunity_type, {_uuid('u', 'l_suppkey % 27')} AS university_id, {_uuid('p', 'l_partkey')} AS pi_id,
        CASE l_returnflag WHEN 'A' THEN 'RANKED' WHEN 'R' THEN 'REJECTED' ELSE 'NEW' END AS state, substr('ABC', 1, l_linenumber) AS country_code, 'https://x.org/' || CAST(l_orderkey AS STRING) AS url, CAST(l_quantity AS INT) AS confidence FROM lineitem""",
    "user_subscriptions": f"SELECT {_uuid('s', 'c_custkey')} AS id, c_custkey % 1400 AS telegram_user_id, substr(c_mktsegment, 1, 2) AS language_code FROM customer",
    "alert_history": f"SELECT {_uuid('a', 'o_orderkey')} AS id, {_uuid('s', 'o_custkey * (1 + o_orderkey % 2)')} AS subscription_id, '[' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ']' END AS position_ids, o_orderstatus AS delivery_status FROM orders",
    "crawl_logs": f"SELECT {_uuid('l', 'event_id')} AS id, 'src' || CAST(user_id % 20 AS STRING) AS source_name, 'https://x.org/' || event_type AS url, CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'click' THEN event_type END AS error_type, event_type = 'view' AS success FROM events",
    "source_health": "SELECT r_name AS source_name, r_name AS id, CASE WHEN r_regionkey = 3 THEN repeat(r_name, 9) ELSE 'healthy' END AS status FROM region UNION ALL SELECT 'ASIA', 'x', NULL FROM region",
}


def star(spark, d):
    """The declared tables' rows by name.  A cast of a fraction to a whole number
    rounds, as in DuckDB; Spark's own would cut the fraction off."""
    names = ("nation", "supplier", "customer", "lineitem", "orders", "events", "region")
    out = {}
    for name, sql in ROWS.items():
        for t in names:
            sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
        sql = re.sub(r"CAST\((\w+) AS INT\)", r"CAST(rint(\1) AS INT)", sql)
        out[name] = spark.sql(sql, **{t: table(spark, d, t) for t in names if "{" + t + "}" in sql})
    return out


def _sql_rules() -> str:
    """The same rules in DuckDB, one count for each."""
    parts = []
    for name, sql in ROWS.items():
        declared_table, rows = declared.TABLES[name], f"({sql})"
        have = set(re.findall(r" AS ([a-z_]+)", sql))
        for f in declared_table.fields:
            if f.name not in have:
                continue
            rules = []
            if f.required:
                rules.append(("required", f"{f.name} IS NULL"))
            if f.kind == "uuid":
                rules.append(("uuid", f"NOT regexp_full_match({f.name}, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')"))
            elif f.kind == "json":
                rules.append(("json", f"{f.name} IS NOT NULL AND NOT json_valid({f.name})"))
            elif f.kind.startswith("decimal") or f.kind == "int":
                rules.append(("type", f"{f.name} IS NOT NULL AND TRY_CAST({f.name} AS {f.kind}) IS NULL"))
            if f.length and f.kind == "string":
                rules.append(("length", f"length({f.name}) {'<>' if f.exact else '>'} {f.length}"))
            if f.one_of:
                rules.append(("domain", f"NOT list_contains({sql_list(f.one_of)}, {f.name})"))
            parts += [f"SELECT '{name}' AS table_name, '{f.name}' AS columns, '{rule}' AS rule, count(*) FILTER ({when}) AS violations FROM {rows}" for rule, when in rules]
            if f.refers in ROWS:
                parts.append(f"SELECT '{name}', '{f.name}', 'reference', count(*) FROM {rows} WHERE {f.name} IS NOT NULL AND {f.name} NOT IN (SELECT id FROM ({ROWS[f.refers]}))")
        for keys in (("id",), *declared_table.unique):
            if have.issuperset(keys):
                k = ", ".join(keys)
                parts.append(f"SELECT '{name}', '{','.join(keys)}', 'unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {rows} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in keys)} GROUP BY {k})")
    return "\nUNION ALL ".join(parts)


@query("a12_declared_rules", _sql_rules(), postings=False)
def declared_rules(spark, d):
    """Violations of the declared types, domains, keys and references."""
    return declared.violations(star(spark, d))


def _sql_deletes() -> str:
    u, dep, pis, pos = (f"({ROWS[t]})" for t in ("universities", "departments", "pis", "positions"))
    g = f"(SELECT id FROM {u} WHERE country_code = 'XX')"
    return f"""
WITH d AS (SELECT * FROM {dep} WHERE university_id NOT IN {g}),
p0 AS (SELECT * FROM {pis} WHERE university_id NOT IN {g}),
p AS (SELECT id, CASE WHEN department_id IN (SELECT id FROM {dep} WHERE university_id IN {g}) THEN NULL ELSE department_id END AS department_id FROM p0),
o AS (SELECT id, CASE WHEN pi_id IN (SELECT id FROM {pis} WHERE university_id IN {g}) THEN NULL ELSE pi_id END AS pi_id FROM {pos} WHERE university_id NOT IN {g})
SELECT 'universities' AS table_name, count(*) AS n, 0 AS lost FROM {u} WHERE country_code <> 'XX'
UNION ALL SELECT 'departments', count(*), 0 FROM d
UNION ALL SELECT 'pis', count(*), count(*) FILTER (department_id IS NULL) FROM p
UNION ALL SELECT 'positions', count(*), count(*) FILTER (pi_id IS NULL) FROM o
"""


@query("a12_declared_deletes", _sql_deletes(), postings=False)
def declared_deletes(spark, d):
    """What is left when the universities of a country are deleted: rows that
    refer to them go, and rows that refer to those lose the reference."""
    frames = {k: v for k, v in star(spark, d).items() if k in ("universities", "departments", "pis", "positions")}
    after = declared.without(frames, "universities", frames["universities"].where("country_code = 'XX'"))
    out = None
    for name, lost in (("universities", None), ("departments", None), ("pis", "department_id"), ("positions", "pi_id")):
        n = F.count_if(F.col(lost).isNull()) if lost else F.lit(0).cast("long")
        one = after[name].agg(F.count(F.lit(1)).alias("n"), n.alias("lost")).select(F.lit(name).alias("table_name"), "n", "lost")
        out = one if out is None else out.unionByName(one)
    return out
