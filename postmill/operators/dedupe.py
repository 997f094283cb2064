"""Deduplication, keyed merges and caches over postings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.urls import canonical


def first_wins(rows: DataFrame, *keys: Column, order: str = "seq") -> DataFrame:
    """The first row of each key; the order makes it repeatable.  An
    aggregate, so a key with many rows moves one row per task."""
    names = [f"__k{i}" for i in range(len(keys))]
    first = F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")
    return rows.withColumns(dict(zip(names, keys))).groupBy(*names).agg(first).select("r.*")


def longest_context(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Per key (canonical URL, fragment kept) the row with the longest
    context, first on a tie.  A map-side aggregate: one row per key and task
    moves, whatever the number of copies."""
    keyed = rows.withColumn("__key", canonical(F.col("url"), True) if key is None else key)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.length("context"), -F.col("seq")))
    return keyed.groupBy("__key").agg(best.alias("r")).select("r.*")


def merge_longest(rows: DataFrame, key: Column, fields: list[str], order: str = "seq") -> DataFrame:
    """Field by field the longest value per key across runs, first on a tie."""
    best = [F.max_by(f, F.struct(F.length(F.coalesce(f, F.lit(""))), -F.col(order))).alias(f) for f in fields]
    return rows.withColumn("key", key).groupBy("key").agg(*best)


def merge_cache(fresh: DataFrame, cached: DataFrame, runs: DataFrame, now: Column, stale_days: int = 21) -> DataFrame:
    """Fresh rows of sources that returned some; cached rows, tagged with
    their age, of sources that failed.  ``runs``: source, n."""
    ok = runs.where("n > 0").select("source")
    kept = fresh.join(ok, "source", "left_semi").select("*", F.lit(False).alias("from_cache"), F.lit(None).cast("int").alias("cache_age_days"), F.lit(False).alias("stale"))
    age = F.datediff(now, "fetched_at")
    old = cached.join(ok, "source", "left_anti").withColumns({"from_cache": F.lit(True), "cache_age_days": age, "stale": age > stale_days}).drop("fetched_at")
    return kept.unionByName(old)


def share_boards(boards: DataFrame) -> DataFrame:
    """The first holder of a board keeps its URL; others name that holder."""
    same = Window.partitionBy(F.lower("board_url")).orderBy("seq")
    first = F.first_value("university").over(same)
    return boards.withColumn("rn", F.row_number().over(same)).select(
        "university", "seq", F.when(F.col("rn") == 1, F.col("board_url")).alias("board_url"), F.when(F.col("rn") > 1, first).alias("shared_with")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; a new null or empty string
    leaves the old value."""
    mine = [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")) if t == "string" else F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c, t in old.dtypes if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *mine)


def merged_interests(old: Column, new: Column) -> Column:
    """Both interest lists as one sorted set."""
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def unsubscribe(subscribers: DataFrame, leavers: DataFrame, key: str) -> DataFrame:
    """``subscribers`` with the flag set for those who leave."""
    gone = leavers.select(F.col(key).alias("__key"), F.lit(True).alias("__gone")).dropDuplicates(["__key"])
    met = subscribers.join(gone, F.col(key) == F.col("__key"), "left")
    return met.withColumn("unsubscribed", F.coalesce("__gone", "unsubscribed")).drop("__key", "__gone")


def active() -> Column:
    return F.col("confirmed") & ~F.col("unsubscribed")
