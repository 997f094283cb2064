"""Scans of crawl artefacts, registries and snapshots at rest.

Every scan has an explicit schema; a damaged record becomes nulls and is
dropped or defaulted, as an unreadable artefact counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.titles import title_from_context
from postmill.functions.urls import canonical

POSTING = "title string, url string, source string, source_label string, context string, country string, deadline string, deadline_date string, deadline_status string, university string, posted string"
RUN = "n long, note string, method string, http_note string"
SOURCE = "name string, label string, url string, search_url string, region string, country string, tier int, source_type string, needs_browser boolean, status string, is_board boolean, max_pages int, stale_page_run int"

REGISTRY = "name string, label string, url string, search_url string, region string, country string, tier string, source_type string, needs_browser boolean, verify_tls boolean, status string, notes string, is_board boolean, max_pages int, stale_page_run int"


def scan_postings(spark: SparkSession, artefacts: list[tuple[str, str, str]]) -> DataFrame:
    """Several artefacts (path, origin, default label) as one table: defaults
    filled in, titles repaired, rows without a URL dropped; ``input_rank``
    keeps the artefacts' order.  An artefact is a JSON array or an envelope
    with ``positions``."""
    parts = []
    for rank, (path, origin, label) in enumerate(artefacts):
        raw = spark.read.schema(f"{POSTING}, organization string, description string, positions array<struct<{POSTING.replace(' string', ':string')}>>").json(path, multiLine=True, mode="PERMISSIVE")
        inner = raw.where("positions IS NOT NULL").select(F.inline("positions")).withColumns({"organization": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
        parts.append(raw.where("positions IS NULL").drop("positions").unionByName(inner).withColumns({
            "university": F.coalesce("university", "organization"), "context": F.coalesce("context", "description", F.lit("")), "origin": F.lit(origin),
            "source_label": F.coalesce(F.nullif("source_label", F.lit("")), F.lit(label)), "input_rank": F.lit(rank),
        }).drop("organization", "description"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    filled = out.where("coalesce(url, '') <> ''").fillna("", ["title", "country", "deadline", "deadline_date", "deadline_status", "posted"])
    return filled.withColumn("title", title_from_context(F.col("title"), F.col("context")))


def scan_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A crawl run: its postings, and its per-source summary as rows."""
    fields = POSTING.replace(" string", ":string")
    raw = spark.read.schema(f"positions array<struct<{fields}>>, per_source map<string,struct<{RUN.replace(' string', ':string').replace(' long', ':long')}>>").json(path, multiLine=True)
    return raw.select(F.inline("positions")), raw.select(F.explode("per_source").alias("source", "run")).select("source", "run.*")


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, a small dimension in JSON lines."""
    return spark.read.schema(SOURCE).json(path)


def scan_registry(spark: SparkSession, path: str, section: str = "sources") -> DataFrame:
    """The source registry as YAML: a section that is a list of flat records.
    One file is one row; its records, and then their fields, are cut out of it by
    built-in functions.  A value may go on over further, deeper indented lines,
    and may be quoted; a field that a record lacks is null."""
    text = spark.read.text(path, wholetext=True).select(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n"), F.lit("\n")).alias("t"))
    body = F.regexp_extract("t", rf"(?s)\n{section}:[^\n]*\n(.*?)(?=\n[A-Za-z_]|$)", 1)
    records = text.select(F.explode(F.filter(F.split(body, r"(?m)^ *- +(?=[a-z_]+:)"), lambda x: F.trim(x) != "")).alias("r"))
    flat = records.select(F.regexp_replace("r", r"\n {3,}(?![a-z_]+: |[a-z_]+:\n)", " ").alias("r"))

    def field(name: str, kind: str):
        raw = F.regexp_extract("r", rf"(?m)^ *{name}: *(.*?) *$", 1)
        bare = F.when(raw.rlike("^'.*'$"), F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))).when(raw.rlike('^".*"$'), F.substr(raw, F.lit(2), F.length(raw) - 2)).when((raw != "") & (raw != "null"), raw)
        return (bare if kind == "string" else bare.try_cast(kind)).alias(name)

    return flat.select(*(field(*f.split()) for f in REGISTRY.split(", ")))


def boards_of(sources: DataFrame) -> DataFrame:
    return sources.where("coalesce(is_board, true)")


def scan_institutions(spark: SparkSession, path: str) -> DataFrame:
    """University registry CSV: trimmed, cast, http(s) homepages only."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    clean = raw.toDF(*[c.strip("﻿ ").lower() for c in raw.columns])
    cols = {c: F.trim(c) for c in clean.columns}
    return clean.withColumns(cols).where(F.col("homepage").rlike("^https?://")).withColumn("openalex_papers", F.coalesce(F.col("openalex_papers").try_cast("int"), F.lit(0)))


def research_size(institutions: DataFrame) -> DataFrame:
    """homepage key -> papers; of repeated homepages the last row counts."""
    return institutions.groupBy(canonical(F.col("homepage")).alias("homepage")).agg(F.max_by("openalex_papers", "seq").alias("papers"))


def scan_board_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map homepage -> board record, as rows."""
    raw = spark.read.text(path, wholetext=True)
    record = "map<string,struct<board_url:string,stage:string,http_status:int,still_ok:boolean,shared_with:string>>"
    return raw.select(F.explode(F.from_json("value", record)).alias("homepage", "r")).select("homepage", "r.*")


def boards_by_size(boards: DataFrame, size: DataFrame, limit: int = 0) -> DataFrame:
    """Distinct boards, the universities that share each, largest first."""
    sized = boards.withColumn("homepage", canonical(F.col("homepage"))).join(size, "homepage", "left")
    out = sized.groupBy("board_url").agg(F.min_by("university", "seq").alias("university"), F.array_sort(F.collect_list("university")).alias("shared"), F.coalesce(F.max("papers"), F.lit(0)).alias("papers"))
    ordered = out.orderBy(F.desc("papers"), "board_url")
    return ordered.limit(limit) if limit else ordered


def interleaved(universities: DataFrame, per_country: int, limit: int) -> DataFrame:
    """At most ``per_country`` of each country, taken in turns."""
    rn = F.row_number().over(Window.partitionBy("country").orderBy("seq"))
    return universities.withColumn("rn", rn).where(F.col("rn") <= per_country).orderBy("rn", "country").limit(limit)


def select_targets(universities: DataFrame, boards: DataFrame, country: str = "", limit: int | None = None, refresh: bool = False, only_missing: bool = False) -> DataFrame:
    """The universities that a run looks at: of a country (part of its name, or
    its code), without a known board, the largest research output first."""
    out = universities
    if country:
        low = F.lit(country.lower())
        out = out.where(F.contains(F.lower("country"), low) | (F.lower("country_code") == low))
    if only_missing and not refresh:
        known = boards.select(canonical(F.col("homepage")).alias("__home")).distinct()
        out = out.join(known, canonical(F.col("homepage")) == F.col("__home"), "left_anti")
    return out.orderBy(F.desc("openalex_papers"), "seq").limit(limit) if limit else out


def institution_pages(spark: SparkSession, path: str) -> DataFrame:
    """Institution snapshot, JSON lines of API pages with ``results``, as rows."""
    one = "struct<id:string,display_name:string,country_code:string,homepage_url:string,works_count:bigint,type:string>"
    raw = spark.read.schema(f"country string, results array<{one}>").json(path)
    return raw.select("country", F.explode("results").alias("r")).select(
        F.coalesce("country", "r.country_code").alias("country"), F.col("r.id").alias("institution_id"), F.trim("r.display_name").alias("name"), F.col("r.homepage_url").alias("official_url"), F.coalesce("r.works_count", F.lit(0).cast("long")).alias("papers"),
    )


def institutions_per_country(institutions: DataFrame) -> DataFrame:
    return institutions.groupBy("country").agg(F.count(F.lit(1)).alias("institutions"), F.sum("papers").alias("papers"))
