"""Publishing: the site's records, their meta data and the checks of both, and
reports over boards and institutions.

Counts and checks are plain aggregate expressions.  ``publish`` hangs them on
the write itself (``Observation``), so the meta data are of exactly the rows
that were written and no row is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postmill.functions import gates
from postmill.functions.dates import bind
from postmill.functions.urls import canonical
from postmill.operators.evidence import published_evidence
from postmill.operators.numbering import numbered
from postmill.operators.scoring import tier

C = F.col
STATUSES = ("open", "rolling", "unknown")
#: Characters of a description that a record shows.
SHOWN = 420
_USED = (
    "title", "url", "source", "source_label", "context", "org_hint", "guess_org", "university", "country", "deadline", "deadline_date", "deadline_status", "fit", "posted", "enriched", "has_funding_evidence",
)


def _carried(rows: DataFrame) -> DataFrame:
    """Of ``rows`` what their order, records and meta data need: of a full
    description the shown characters and its length."""
    full = F.coalesce("description_full", F.lit(""))
    return rows.select("seq", *_USED, F.left(full, F.lit(SHOWN)).alias("description_full"), F.length(full).alias("full_chars"))


def site_records(rows: DataFrame) -> DataFrame:
    """The records of the site; ``rows``: n (their place in the list), title,
    url, source, source_label, context, description_full, org_hint, guess_org,
    university, country, deadline, deadline_date, deadline_status, fit, posted,
    enriched, has_funding_evidence; where full_chars is there, description_full
    is only the beginning of a text of that length."""
    given = lambda *names: F.coalesce(*(F.nullif(C(n), F.lit("")) for n in names))
    said = lambda name: F.trim(F.coalesce(C(name), F.lit("")))
    label, fit = F.coalesce("source_label", "source", F.lit("")), F.coalesce("fit", F.lit(0))
    funded = F.coalesce("has_funding_evidence", F.lit(False))
    return rows.select(
        F.format_string("pd-%03d", "n").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(given("org_hint", "guess_org", "university"), label).alias("university"), F.coalesce(given("country"), F.lit("N/A")).alias("country"),
        F.lit("N/A").alias("department"), F.lit("See official posting").alias("pi_name"), F.lit("").alias("pi_email"), F.when(funded, "Funding evidence on page").otherwise("See official posting").alias("funding"),
        F.coalesce(F.nullif(said("deadline"), F.lit("")), F.lit("See official posting")).alias("application_deadline"), said("deadline_date").alias("deadline_date"), F.coalesce(F.nullif(said("deadline_status"), F.lit("")), F.lit("unknown")).alias("deadline_status"),
        F.lit("FUNDED_PHD").alias("opportunity_type"), F.lit("Biomechanics / Human Movement").alias("research_domain"), fit.alias("research_fit_score"), tier(fit, 75, 55).alias("contact_priority"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("posted", F.lit("")).alias("posted"), F.left(F.coalesce(given("description_full", "context"), F.lit("")), F.lit(SHOWN)).alias("description"),
        label.alias("source"), published_evidence(C("full_chars") if "full_chars" in rows.columns else None).alias("evidence"),
    )


def meta(rows: DataFrame) -> dict[str, Column]:
    """What the meta file counts of the rows that ``site_records`` takes."""
    told = lambda name: F.count_if(F.coalesce(C(name), F.lit("")) != "")
    return {
        "position_count": F.count(F.lit(1)), "sources_contributing": F.array_sort(F.collect_set(F.coalesce("source_label", "source", F.lit("")))),
        "with_deadline": told("deadline"), "with_country": told("country"), "enriched": F.count_if(F.coalesce("enriched", F.lit(False))),
    }


def registry_checks() -> dict[str, Column]:
    """Violations of a registry: name, is_board, url, search_url, max_pages,
    stale_page_run."""
    board = F.coalesce("is_board", F.lit(False))
    none = (F.coalesce("url", F.lit("")) == "") & (F.coalesce("search_url", F.lit("")) == "")
    return {
        "no_sources": (F.count(F.lit(1)) == 0).cast("long"), "repeated_names": F.count("name") - F.count_distinct("name"), "no_boards": (F.count_if(board) == 0).cast("long"),
        "boards_without_url": F.count_if(board & none), "max_pages_without_stale_run": F.count_if(board & C("max_pages").isNotNull() & C("stale_page_run").isNull()),
    }


def record_checks() -> dict[str, Column]:
    """Violations of published records, but for repeated addresses."""
    blank = lambda name: F.coalesce(C(name), F.lit("")) == ""
    told = F.concat_ws("\n", "title", "university", "funding", "application_deadline", "description", "url", F.to_json("evidence"))
    return {
        "no_positions": (F.count(F.lit(1)) == 0).cast("long"), "without_url": F.count_if(blank("url")), "without_evidence": F.count_if(F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "without_fit": F.count_if(C("research_fit_score").isNull()),
        "expired_published": F.count_if(C("deadline_status") == "expired"), "open_without_date": F.count_if((C("deadline_status") == "open") & blank("deadline_date")),
        "unexpected_status": F.count_if(~F.coalesce("deadline_status", F.lit("none")).isin(*STATUSES)), "secrets": F.count_if(bind(told, gates.secret_shape)),
    }


def repeated_urls(records: DataFrame) -> DataFrame:
    """How many records repeat an address; one row."""
    keys = records.where("url <> ''").groupBy(canonical(C("url"), True).alias("key")).agg((F.count(F.lit(1)) - 1).alias("more"))
    return keys.agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("repeated_urls"))


def _as_rows(counts: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(c).alias("check_name"), C(c).cast("long").alias("violations")) for c in counts.columns))
    return counts.select(F.inline(each)).withColumn("ok", C("violations") == 0)


def checks(sources: DataFrame, records: DataFrame) -> DataFrame:
    """check_name, violations, ok: all fourteen checks of a registry and its
    published records."""
    named = lambda found: [c.alias(n) for n, c in found.items()]
    return _as_rows(sources.agg(*named(registry_checks()))).unionByName(_as_rows(records.agg(*named(record_checks())))).unionByName(_as_rows(repeated_urls(records)))


def publish(rows: DataFrame, path: str) -> dict:
    """Number ``rows`` by fit (then seq, then context), write their records as
    gzipped JSON (their evidence repeats itself, so that plain JSON is many times
    as large) and return meta data and violations of what was written.  Only the
    repeated addresses are counted apart, in one column of the numbered rows."""
    listed = numbered(_carried(rows), F.desc_nulls_last("fit"), "seq", "context")
    seen, kept = Observation(), Observation()
    watched = listed.observe(seen, *(c.alias(n) for n, c in meta(rows).items()))
    records = site_records(watched).observe(kept, *(c.alias(n) for n, c in record_checks().items()))
    records.write.mode("overwrite").json(path, compression="gzip")
    again = repeated_urls(listed.select(F.coalesce("url", F.lit("")).alias("url"))).head()[0]
    return {**seen.get, "violations": {**kept.get, "repeated_urls": again}}


def discovery_report(boards: DataFrame, registry: DataFrame) -> DataFrame:
    """kind, key, universities, boards, shared, missing: of each stage and each
    country, and of all; several groupings in one scan.  A shared board counts
    for the university that owns it; a country of the registry without a board
    is told with zeros.  ``boards``: country, stage, board_url, shared_board;
    ``registry``: country."""
    every = boards.select("country", "stage", (F.coalesce("board_url", F.lit("")) != "").alias("found"), F.coalesce(C("shared_board") != "", F.lit(False)).alias("shared"), F.lit(True).alias("known")).unionByName(
        registry.select("country").distinct(), allowMissingColumns=True
    )
    known, shared, found = F.coalesce("known", F.lit(False)), F.coalesce("shared", F.lit(False)), F.coalesce("found", F.lit(False))
    told = every.withColumns({"country": F.coalesce("country", F.lit("?")), "stage": F.when(found & ~shared, F.coalesce("stage", F.lit("?")))})
    counts = told.groupingSets([[C("stage")], [C("country")], []], "stage", "country").agg(
        F.grouping_id("stage", "country").alias("g"), F.count_if(known).alias("universities"), F.count_if(found & ~shared).alias("boards"), F.count_if(shared).alias("shared"), F.count_if(known & ~found & ~shared).alias("missing")
    )
    kind = F.when(C("g") == 1, "stage").when(C("g") == 2, "country").otherwise("all")
    return counts.where("g <> 1 OR stage IS NOT NULL").select(kind.alias("kind"), F.coalesce("stage", "country", F.lit("")).alias("key"), "universities", "boards", "shared", "missing")


def exclusion_report(universities: DataFrame) -> DataFrame:
    """kind, key, kept, excluded: of each reason and each country, and of all;
    ``universities``: country_code, reason (null where kept)."""
    reason = C("why")
    rows = universities.select("country_code", C("reason").alias("why"))
    counts = rows.groupingSets([[reason], [C("country_code")], []], "why", "country_code").agg(F.grouping_id("why", "country_code").alias("g"), F.count(F.lit(1)).alias("n"), F.count("why").alias("excluded"))
    kind = F.when(C("g") == 1, "reason").when(C("g") == 2, "country").otherwise("all")
    return counts.where("g <> 1 OR why IS NOT NULL").select(kind.alias("kind"), F.coalesce("why", "country_code", F.lit("")).alias("key"), (C("n") - C("excluded")).alias("kept"), "excluded")


def write_split(universities: DataFrame, path: str) -> None:
    """Kept and excluded universities in one pass, as CSV in a folder for each
    verdict and country; a large country is split over files."""
    rows = universities.withColumn("verdict", F.when(C("reason").isNull(), "kept").otherwise("excluded"))
    rows.hint("rebalance", "verdict", "country_code").write.mode("overwrite").partitionBy("verdict", "country_code").csv(path, header=True)
