"""Every query with SQL gives the same rows as DuckDB."""

import pytest
from oracle import compare

from postmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_flagship_reads_only_what_it_needs(spark):
    plan = registry.QUERIES["q_published_positions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan
