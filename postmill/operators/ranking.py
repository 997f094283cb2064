"""Search queries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_queries(people: DataFrame, key: str, templates: tuple, fields: tuple, most: int = 15) -> DataFrame:
    """Search queries per person from templates and fields, the first ``most``
    distinct ones in field, then template order.  ``people``: ``key``, name,
    university.  Everything happens within a row."""
    n = len(templates)
    orders = F.sequence(F.lit(0), F.lit(n * len(fields) - 1))
    template_at, field_at = F.array(*map(F.lit, templates)), F.array(*map(F.lit, fields))

    def query(i):
        text = F.get(template_at, (i % n).cast("int"))
        for name, value in (("{name}", F.col("name")), ("{field}", F.get(field_at, F.floor(i / n).cast("int"))), ("{university}", F.col("university"))):
            text = F.replace(text, F.lit(name), value)
        return text

    made = people.select(key, F.posexplode(F.slice(F.array_distinct(F.transform(orders, query)), 1, most)).alias("pos", "query"))
    return made.select(key, "query", (F.col("pos") + 1).alias("rank"))


def top_per(rows: DataFrame, parent: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each parent in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= most)


def excludes(text: Column, exclusions: Column) -> Column:
    """Does a profile's exclusion occur in the text?"""
    low = F.lower(text)
    return F.exists(exclusions, lambda e: low.contains(F.lower(e)))


def funded_by_country(rows: DataFrame, keywords: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``funded_words``: does the text hold a funding word of the
    row's country?  ``keywords``: country, funding_keywords, a row for each."""
    met = rows.join(keywords.withColumnRenamed("country", "__country"), F.col("country") == F.col("__country"), "left")
    return met.withColumn("funded_words", F.coalesce(F.exists("funding_keywords", lambda w: F.col(text).contains(w)), F.lit(False))).drop("__country", "funding_keywords")
