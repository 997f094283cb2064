import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import numbering


def test_numbers_are_those_of_a_window(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice("aaaaab") if rng.random() < 0.95 else None, rng.randrange(50), i) for i in range(3000)], "k string, v int, id long").repartition(7)
    for order in (("v", "id"), (F.desc("v"), F.col("id"))):
        whole = numbering.numbered(rows, *order).collect()
        assert [r.n for r in sorted(whole, key=lambda r: (r.v if isinstance(order[0], str) else -r.v, r.id))] == list(range(1, 3001))
        within = numbering.numbered(rows, *order, keys=("k",), name="rn")
        same = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
        assert sorted(map(str, within.collect())) == sorted(map(str, same.collect()))


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_numbers_of_an_empty_table(spark, keys):
    assert numbering.numbered(spark.createDataFrame([], "k string, id long"), "id", keys=keys).collect() == []


def test_one_key_is_spread_over_tasks(spark):
    rows = spark.range(100_000).select(F.lit("one").alias("k"), "id")
    placed = numbering.ranged(rows, "k", "id", parts=8)
    sizes = [r[1] for r in placed.groupBy(numbering.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000
    plan = numbering.numbered(rows, "id", keys=("k",), parts=8)
    assert plan.agg(F.max("n"), F.sum((F.col("n") != F.col("id") + 1).cast("int"))).head()[:] == (100_000, 0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Window" not in text
