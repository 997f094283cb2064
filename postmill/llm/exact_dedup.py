"""Operator 4, exact dedup with a heavy-hitter split.

Texts are equal when they are identical after every ASCII white-space
character is deleted.  One pass over the texts makes a row of fixed size per
document (digest, length, row number).  A Misra-Gries summary
(``DataFrame.stat.freqItems``) names the digests that may hold more than
``support`` of all rows; an exact count verifies them and finds their winners,
at most ``1 / support`` rows, which are broadcast, so that a hot group never
meets in one task.  All other digests, none of which holds more than
``support`` of the rows, go through one ordinary shuffle.

Defined results: null text counts as empty; empty texts form one group; among
equal texts the row with the most code points stays, then the smallest doc_id
(a null id loses), then the first row read, so that exactly one of several
repeated rows stays; an empty table gives an empty result; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.shared import ASCII_SPACE, documents, materialise

#: A digest is hot when it holds more than this share of the rows; the
#: broadcast winners are at most ``1 / SUPPORT`` rows of about 100 bytes.
SUPPORT = 0.0005


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One small row per document: row_id, doc_id, digest, n_points, probe."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(whole, ASCII_SPACE, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(doc_id).alias("doc_id"),
        F.sha2(bare, 256).alias("digest"),
        F.length(whole).alias("n_points"),
    )
    return rows.withColumn("probe", F.xxhash64("digest"))


def hot_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests that hold more than ``support`` of ``rows``, with their exact
    group size and winner; never more than ``1 / support`` rows."""
    least = rows.count() * support
    maybe = rows.stat.freqItems(["probe"], support).select(F.explode("probe_freqItems").alias("probe"))
    return (
        rows.join(F.broadcast(maybe), "probe")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank()).alias("best"))
        .where((F.col("group_size") > F.lit(least)) & (F.col("group_size") > 1))
    )


def _rank():
    return F.struct(F.col("n_points"), (-F.col("doc_id")).alias("minus_id"), (-F.col("row_id")).alias("minus_row"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept,
    text_sha256."""
    rows = materialise(digests(docs, text, doc_id), "digests")
    hot = materialise(hot_digests(rows, support), "hot-digests")
    in_hot = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    in_rest = rest.withColumn("group_size", F.count(F.lit(1)).over(group)).withColumn("best", F.max(_rank()).over(group))
    return in_hot.select(in_rest.columns).unionAll(in_rest).select(
        "row_id",
        "doc_id",
        (-F.col("best.minus_id")).alias("keep_id"),
        "group_size",
        (F.col("row_id") == -F.col("best.minus_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_unique(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that lose to an equal text (same columns).

    The texts move once, by (doc_id, digest); rows that repeat both are then
    neighbours, and the longest of them stays.
    """
    tags = exact_dedup(docs, support=support)
    winners = tags.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__digest", F.sha2(F.translate(whole, ASCII_SPACE, ""), 256))
    met = keyed.join(winners, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    again = Window.partitionBy("doc_id", "__digest").orderBy(F.length(whole).desc())
    return met.withColumn("__rn", F.row_number().over(again)).where("__rn = 1").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("row_id")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       rn = 1 AS kept, text_sha256
FROM r
"""
