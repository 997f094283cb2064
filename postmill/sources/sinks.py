"""Writers of published data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.fixed import SITE_OFFICIAL
from postmill.functions.titles import guess_org
from postmill.operators.scoring import tier

EXPORT = ("id", "title", "university", "country", "url", "fit", "tier", "deadline_status", "deadline_date")


def site_payload(rows: DataFrame) -> DataFrame:
    """Published rows with the site's fields, defaults and an evidence array;
    ``rows``: title, context, university, source_label, country, deadline,
    deadline_date, deadline_status, fit, url, posted, source, origin and any
    others (those that lack a field get its default)."""
    given = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")
    or_else = lambda name, other: F.coalesce(F.nullif(given(name), F.lit("")), F.lit(other))
    fit = F.col("fit") if "fit" in rows.columns else F.lit(0)
    kind = F.when(F.col("source").isin(*SITE_OFFICIAL), "official").otherwise("aggregator")
    entry = F.struct(
        F.concat(F.lit("Position listed on "), F.col("source_label")).alias("claim"), F.col("title").alias("value"), F.col("url").alias("source_url"),
        kind.alias("source_type"), F.when(F.col("origin").contains("browser"), 0.9).otherwise(0.65).alias("confidence"),
    )
    return rows.withColumns({
        "university": guess_org(F.col("context"), F.col("source_label"), F.col("university")), "country": or_else("country", "N/A"), "department": F.lit("N/A"),
        "pi_name": F.lit("See official posting"), "pi_email": F.lit(""), "funding": F.lit("PhD position — see official posting"),
        "application_deadline": or_else("deadline", "See official posting"), "deadline_date": given("deadline_date"), "deadline_status": or_else("deadline_status", "unknown"),
        "opportunity_type": F.lit("FUNDED_PHD"), "research_domain": F.lit("Biomechanics / Human Movement"), "research_fit_score": fit, "contact_priority": tier(fit, 75, 55),
        "source_url": F.col("url"), "posted": given("posted"), "description": F.left("context", F.lit(400)), "evidence": F.array(entry),
    })


def write_site(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, least: float = 70.0) -> None:
    rows.where(F.col("fit") >= least).select(*EXPORT).write.mode("overwrite").csv(path, header=True)


def envelope(rows: DataFrame, least: float, at: str) -> DataFrame:
    """One JSON document with count, filter and time; for a published list,
    which is small.  Larger results go through ``write_site``."""
    kept = rows.where(F.col("fit") >= least)
    return kept.agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct(*kept.columns)).alias("positions")).select(
        F.to_json(F.struct(F.lit(at).alias("generated_at"), F.lit(least).alias("min_score"), "count", "positions")).alias("json")
    )


def export_all(rows: DataFrame, folder: str, least: float = 70.0) -> dict[str, str]:
    """CSV, JSON lines and Parquet of one frame, computed once."""
    paths = {kind: f"{folder}/{kind}" for kind in ("csv", "json", "parquet")}
    kept = rows.where(F.col("fit") >= least).persist()
    try:
        kept.write.mode("overwrite").csv(paths["csv"], header=True)
        kept.write.mode("overwrite").json(paths["json"])
        kept.write.mode("overwrite").parquet(paths["parquet"])
    finally:
        kept.unpersist()
    return paths


def append_log(rows: DataFrame, path: str) -> None:
    """Delivery log, append-only JSON lines."""
    rows.write.mode("append").json(path)


def write_by_country(rows: DataFrame, path: str) -> None:
    """One folder per country; kept rows have no reason."""
    rows.write.mode("overwrite").partitionBy("country_code").csv(path, header=True)
