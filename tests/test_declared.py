"""Declared tables: every kind of rule is broken once, deletes reach others."""

import datetime

import pytest
from pyspark.sql import functions as F

from postmill.sources import declared
from postmill.sources.declared import TABLES

ID = "00000000-0000-0000-0000-00000000000{}"


def test_catalogue(spark):
    assert len(TABLES) == 12
    for t in TABLES.values():
        assert len(t.schema()) == len(t.fields) == len({f.name for f in t.fields})
        assert all(f.refers in TABLES for f in t.fields if f.refers)
        assert all({k for k in keys} <= {f.name for f in t.fields} for keys in t.unique)


def test_defaults_and_casts(spark):
    now = F.lit(datetime.datetime(2026, 1, 2))
    rows = spark.createDataFrame([("A", "xx", "7", "extra")], "name string, country_code string, city string, other string")
    made = declared.conform(rows, TABLES["universities"], now)
    assert made.columns == [f.name for f in TABLES["universities"].fields]
    row = made.head()
    assert (row.name, row.ranking_data, row.website, row.created_at) == ("A", "{}", None, datetime.datetime(2026, 1, 2))
    row = declared.conform(spark.createDataFrame([("x", "9.999", "many")], "name string, research_fit_score string, phd_students_count string"), TABLES["pis"], now).head()
    assert str(row.research_fit_score) == "10.00" and row.phd_students_count is None and row.verification_level == "NONE" and row.email_verified is False


def seeded(spark):
    uni = spark.createDataFrame(
        [(ID.format(1), "A", "DE", "{}"), (ID.format(2), "A", "DE", "{}"), (ID.format(2), None, "DEU", "{1"), ("no", "x" * 501, "FR", None)], "id string, name string, country_code string, ranking_data string",
    )
    pis = spark.createDataFrame(
        [(ID.format(1), "p", ID.format(1), ID.format(9), "WEAK", "1000", "1.5"), (ID.format(2), "p", None, None, None, "x", None)],
        "id string, name string, university_id string, department_id string, verification_level string, research_fit_score string, phd_students_count string",
    )
    prints = spark.createDataFrame([(ID.format(1), "u", [0.5]), (ID.format(2), "u", [0.5] * 384)], "id string, user_id string, embedding array<float>")
    dep = spark.createDataFrame([(ID.format(1), ID.format(1), "d")], "id string, university_id string, name string")
    return {"universities": uni, "pis": pis, "research_fingerprint": prints, "departments": dep}


def test_each_rule_finds_its_row(spark):
    found = {(r.table_name, r.columns, r.rule): r.violations for r in declared.violations(seeded(spark)).collect()}
    broken = {k: n for k, n in found.items() if n}
    assert broken == {
        ("universities", "id", "uuid"): 1, ("universities", "id", "unique"): 1, ("universities", "name", "required"): 1, ("universities", "name", "length"): 1, ("universities", "country_code", "length"): 1,
        ("universities", "ranking_data", "json"): 1, ("universities", "name,country_code", "unique"): 1,
        ("pis", "university_id", "required"): 1, ("pis", "department_id", "reference"): 1, ("pis", "verification_level", "domain"): 1, ("pis", "research_fit_score", "type"): 2, ("pis", "phd_students_count", "type"): 1,
        ("research_fingerprint", "embedding", "length"): 1, ("research_fingerprint", "user_id", "unique"): 1,
    }
    assert found["departments", "university_id", "reference"] == 0 and found["pis", "university_id", "reference"] == 0


def test_empty_tables_break_nothing(spark):
    frames = {k: v.limit(0) for k, v in seeded(spark).items()}
    assert declared.violations(frames).agg(F.sum("violations")).head()[0] == 0


def test_deletes_cascade_or_leave_null(spark):
    frames = seeded(spark)
    extra = spark.createDataFrame([(ID.format(7), "q", ID.format(2), ID.format(1), None, "1", "1")], frames["pis"].schema)
    frames["pis"] = frames["pis"].union(extra)
    after = declared.without(frames, "universities", spark.createDataFrame([(ID.format(1),)], "id string"))
    assert after["departments"].count() == 0
    left = {r.id: r.department_id for r in after["pis"].collect()}
    assert left == {ID.format(2): None, ID.format(7): None} and after["pis"].columns == frames["pis"].columns
    assert after["universities"].count() == 3


def test_tables_are_created(spark):
    try:
        declared.create_tables(spark, "declared_test")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN declared_test").collect()} == set(TABLES)
        assert spark.table("declared_test.pis").columns == [f.name for f in TABLES["pis"].fields]
    finally:
        spark.sql("DROP DATABASE IF EXISTS declared_test CASCADE")
