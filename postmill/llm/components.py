"""Connected components of a links table, by alternating star steps.

Each round is a pair of aggregations by node; the links of a star already hang
on its smallest node, so a star is done in one round and a chain shrinks
geometrically.  Lineage is cut each round with a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import materialise


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links as (larger, smaller)."""
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has
    a link to another."""
    now = materialise(_ordered(links), "cc")
    while True:
        after = materialise(_ordered(_small_star(_ordered(_large_star(now)))), "cc")
        moved = after.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(after, ["u", "v"], "left_anti").limit(1).count()
        now = after
        if not moved:
            break
    tails = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tails.unionByName(heads)
