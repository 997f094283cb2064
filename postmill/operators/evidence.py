"""Verification of positions and the evidence that is published with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed, gates
from postmill.functions.fixed import rule
from postmill.operators.scoring import record_confidence


def position_status(text: Column) -> Column:
    """ACTIVE, CLOSED or EXPIRED by the first status whose words the page has."""
    low, out = F.lower(text), F.lit("UNKNOWN")
    for status, words in reversed(fixed.STATUS_WORDS):
        out = F.when(gates.any_of(low, words), F.lit(status)).otherwise(out)
    return out


def verify_positions(found: DataFrame) -> DataFrame:
    """``found`` (source_url, text and any others) with position_status,
    funding_confirmed, source_type, source_priority, verification_level and the
    evidence (claim, value, confidence) for each."""
    kind = gates.source_type(F.col("source_url"))
    known = found.withColumn("position_status", position_status(F.col("text"))).withColumn("source_type", kind).withColumn("source_priority", gates.source_priority(F.col("source_type")))
    low = F.lower("text")
    stated = [F.regexp_extract("text", rule(p), 1) for p in fixed.STATED_DEADLINES[:3]]
    deadline = F.coalesce(*(F.nullif(x, F.lit("")) for x in stated))
    funding = gates.first_of(low, fixed.FUNDING_WORDS)
    item = lambda claim, value, confidence: F.struct(claim.alias("claim"), value.alias("value"), F.lit(confidence).alias("confidence"))
    status = F.col("position_status")
    evidence = F.array_compact(F.array(
        F.when(status != "UNKNOWN", item(F.concat(F.lit("position_status_"), F.lower(status)), F.lit("true"), 0.8)),
        F.when(deadline.isNotNull(), item(F.lit("application_deadline"), deadline, 0.9)), F.when(funding.isNotNull(), item(F.lit("funding_confirmed"), F.lit("true"), 0.85)),
    ))
    active = status == "ACTIVE"
    level = F.when((F.col("source_priority") >= 8) & active, "STRONG").when((F.col("source_priority") >= 5) & active, "MEDIUM").otherwise("NONE")
    return known.withColumn("funding_confirmed", funding.isNotNull()).withColumn("verification_level", level).withColumn("evidence", evidence)


def published_evidence(chars: Column | None = None) -> Column:
    """Up to four pieces of evidence of a published row: source, source_label,
    title, url, enriched, description_full, country, deadline,
    has_funding_evidence; ``chars``: the full description's length, where the
    row does not hold all of it."""
    deadline, enriched, funded = F.coalesce("deadline", F.lit("")), F.coalesce("enriched", F.lit(False)), F.coalesce("has_funding_evidence", F.lit(False))
    country = F.coalesce("country", F.lit(""))

    def item(claim: Column, value: Column, kind: Column, confidence: Column) -> Column:
        return F.struct(claim.alias("claim"), value.alias("value"), F.col("url").alias("source_url"), kind.alias("source_type"), confidence.cast("double").alias("confidence"))

    official, own = F.col("source").isin(*fixed.OFFICIAL_SOURCES), F.lit("official")
    length = F.length(F.coalesce("description_full", F.lit(""))) if chars is None else chars
    parsed = F.concat(length.cast("string"), F.lit(" chars of description"), F.when(country != "", F.concat(F.lit(", country="), country)).otherwise(""))
    return F.array_compact(F.array(
        item(F.concat(F.lit("Listed as a doctoral opening on "), F.coalesce("source_label", "source")), F.col("title"), F.when(official, "official").otherwise("aggregator"), record_confidence(F.col("source"), enriched, deadline != "", funded)),
        F.when(enriched, item(F.lit("Detail page fetched and parsed"), parsed, own, F.lit(0.9))),
        F.when(deadline != "", item(F.lit("Application deadline found on the page"), deadline, own, F.lit(0.75))),
        F.when(funded, item(F.lit("Funding or salary language present"), F.lit("Yes"), own, F.lit(0.6))),
    ))


def rescue_candidates(rows: DataFrame) -> DataFrame:
    """Rows that pass the title gate but name no discipline: only their detail
    page can be judged."""
    return rows.where((gates.gate_title(F.col("title")) == "ok") & gates.is_generic(F.col("title")))


def rescued(rows: DataFrame, alive: Column, least: int = 180) -> DataFrame:
    """Of candidates with their ``description_full``, those that a full
    description puts on topic and whose deadline has not passed, with ``fit``."""
    blob = F.concat_ws(" ", "title", "context", "description_full")
    long = rows.where((F.length("description_full") >= least) & alive)
    return long.withColumn("fit", F.explode(F.array(gates.topic_fit(F.col("title"), blob)))).where("fit > 0")  # exploded, so that the filter does not compute it again


def rescored(rows: DataFrame, alive: Column) -> DataFrame:
    """Enriched rows judged again on the full text: expired and off-topic ones
    go, ``fit`` is new."""
    text = F.coalesce(F.nullif(F.col("description_full"), F.lit("")), "context")
    return rows.where(alive).withColumn("fit", F.explode(F.array(gates.topic_fit(F.col("title"), F.concat_ws(" ", "title", text))))).where("fit > 0")
