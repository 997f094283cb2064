"""Row numbers without a task that sees all rows, or all rows of a key.

Rows are range-partitioned by key and order, sorted where they lie and written
with their partition and place in it.  A count per partition, as many numbers as
there are partitions, gives each its offset; a row's number is its place plus
that.  Numbers within a key follow by taking off the number that the key begins
with, an aggregate with one row per key and task.  A key with any share of the
rows is spread over as many tasks as its share needs.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.sources.scratch import stored

PART, PLACE = "__part", "__place"
_PLACES = (1 << 33) - 1  # of the rows of a partition in monotonically_increasing_id


def ranged(rows: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """``rows`` in global order, written, with ``__part`` and ``__place`` (from
    0 in each part).  The order must tell any two rows apart, or rows that tie
    meet in one part."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(placed.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)).alias(PLACE)), "ranged")


def offsets(placed: DataFrame) -> list[int]:
    """Rows before each part; at most as many as there are partitions."""
    sizes = {r[0]: r[1] for r in placed.groupBy(PART).count().collect()}
    return [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1))]


def numbered(rows: DataFrame, *order: Column | str, keys: tuple[str, ...] = (), name: str = "n", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: their number from 1 in the given order, or in
    that order within their ``keys`` (a null key is a key)."""
    placed = ranged(rows, *keys, *order, parts=parts)
    before = F.element_at(F.array(*map(F.lit, offsets(placed))), F.col(PART) + 1)
    counted = placed.withColumn(name, (before + F.col(PLACE) + 1).cast("long"))
    if keys:
        starts = counted.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(name).alias("__start"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        counted = counted.join(starts, same, "left").withColumn(name, F.col(name) - F.col("__start") + 1)
    return counted.select(*rows.columns, name)
