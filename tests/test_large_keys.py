"""Queries on keys and values that the small tables do not have: the SQL's rows
there too."""

import duckdb
import pytest
from oracle import TABLES, compare

from postmill.plans import registry

SF = "/root/testdata/sf0.001"
FAR = {"lineitem": "l_orderkey + 36000000 AS l_orderkey", "orders": "o_orderkey + 36000000 AS o_orderkey"}
ODD = {
    "customer": "CASE c_custkey % 3 WHEN 0 THEN 999.6 WHEN 1 THEN 1.5 ELSE 2.5 END AS c_acctbal",
    "events": "CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE value END AS value",
}


def changed(folder, change):
    for t in TABLES:
        given = f"* REPLACE ({change[t]})" if t in change else "*"
        duckdb.sql(f"COPY (SELECT {given} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["s19_s23_verify_positions", "k02_site_records", "h04_h10_vacancy_next"])
def test_keys_beyond_a_double(spark, tmp_path, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], changed(tmp_path, FAR))


@pytest.mark.parametrize("name", ["a12_declared_rules", "t01_last_good"])
def test_fractions_and_good_runs_without_rows(spark, tmp_path, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], changed(tmp_path, ODD))
