"""The declared tables: types, domains, keys and what a delete does to others.

A declaration is compiled into an explicit schema, a conversion of arbitrary
rows to it, and one table of violations.  Rules on single rows are counted in
one scan of a table; a key is an aggregate; a reference is an aggregate of the
referring column and an anti-join, so a value that a third of all rows refer to
crosses the network once a task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from postmill.functions.fixed import CONTACT_PRIORITIES, FAILURE_TYPES, OPPORTUNITY_TYPES, POSITION_STATES, SOURCE_TYPES, VERIFICATION_LEVELS

UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


@dataclass(frozen=True)
class Field:
    """``kind``: uuid, json, vector or a Spark type; ``length``: most
    characters (exactly so many where ``exact``), or a vector's size."""

    name: str
    kind: str
    length: int | None = None
    required: bool = False
    default: str | None = None
    one_of: tuple[str, ...] = ()
    refers: str | None = None
    on_delete: str = ""
    exact: bool = False

    @property
    def spark(self) -> str:
        return {"uuid": "string", "json": "string", "vector": "array<float>"}.get(self.kind, self.kind)


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    unique: tuple[tuple[str, ...], ...] = ()

    def schema(self) -> StructType:
        return StructType([StructField(f.name, StructType.fromDDL(f"x {f.spark}")[0].dataType, not f.required) for f in self.fields])

    def ddl(self) -> str:
        """``CREATE TABLE`` of the catalogue."""
        columns = ", ".join(f"{f.name} {f.spark}{' NOT NULL' if f.required else ''}" for f in self.fields)
        return f"CREATE TABLE {self.name} ({columns}) USING parquet"


def _id() -> Field:
    return Field("id", "uuid", required=True, default="uuid()")


def _to(name: str, table: str, on_delete: str = "null") -> Field:
    return Field(name, "uuid", required=on_delete == "cascade", refers=table, on_delete=on_delete)


def _text(name: str, length: int | None = None, required: bool = False, default: str | None = None, one_of: tuple = (), exact: bool = False) -> Field:
    return Field(name, "string", length, required, None if default is None else f"'{default}'", one_of, exact=exact)


def _json(*names: str, required: bool = False, default: str = "[]") -> tuple[Field, ...]:
    return tuple(Field(n, "json", required=required, default=f"'{default}'") for n in names)


def _number(name: str, kind: str, default: str | None = None, required: bool = False) -> Field:
    return Field(name, kind, required=required, default=default)


def _when(*names: str, now: bool = False) -> tuple[Field, ...]:
    return tuple(Field(n, "timestamp", required=now, default="now" if now else None) for n in names)


_BOTH = _when("created_at", "updated_at", now=True)

# The declared tables.  Names, types, domains, defaults and keys are the data model itself.
TABLES = {t.name: t for t in (
    Table("research_fingerprint", (
        _id(), _text("user_id", 255, True), _text("version", 50, True, "1.0"),
        *_json("core_topics", "adjacent_topics", "methods", "technical_methods", "experimental_methods", "data_modalities", "populations", "research_questions", "career_goals", required=True),
        *_json("preferences", required=True, default="{}"), *_json("hard_exclusions", "soft_exclusions", required=True), Field("embedding", "vector", 384), *_BOTH,
    ), (("user_id",),)),
    Table("universities", (
        _id(), _text("name", 500, True), _text("country_code", 2, True, exact=True), _text("city", 200), _text("website", 500), _text("whed_url", 500), *_json("ranking_data", default="{}"), *_BOTH,
    ), (("name", "country_code"),)),
    Table("departments", (_id(), _to("university_id", "universities", "cascade"), _text("name", 500, True), _text("website", 500), *_json("research_areas"), *_BOTH)),
    Table("research_groups", (
        _id(), _to("department_id", "departments", "cascade"), _text("name", 500, True), Field("pi_id", "uuid"), _text("website", 500), *_json("research_keywords", "equipment"), *_BOTH,
    )),
    Table("pis", (
        _id(), _text("name", 300, True), _to("university_id", "universities", "cascade"), _to("department_id", "departments"), _to("research_group_id", "research_groups"),
        _text("profile_url", 1000), _text("lab_url", 1000), _text("email", 300), _text("email_source", 100), _number("email_confidence", "decimal(3,2)", "0.0"), _number("email_verified", "boolean", "false"),
        _text("verification_level", default="NONE", one_of=VERIFICATION_LEVELS), _text("orcid_id", 50), _text("google_scholar_id", 100), _text("openalex_id", 100),
        *_json("research_keywords", "recent_papers", "active_grants"), _number("phd_students_count", "int", "0"), *_json("hiring_signals"), _number("research_fit_score", "decimal(5,2)", "0.0"),
        _text("verification_status", default="NONE", one_of=VERIFICATION_LEVELS), *_when("last_verified_at"), *_BOTH,
    )),
    Table("positions", (
        _id(), _text("canonical_id", 100, True), _text("title", 1000, True), _text("opportunity_type", None, True, "UNKNOWN", OPPORTUNITY_TYPES),
        _to("university_id", "universities", "cascade"), _to("department_id", "departments"), _to("research_group_id", "research_groups"), _to("pi_id", "pis"),
        _text("country_code", 2, True, exact=True), _text("city", 200), _text("description"), *_json("requirements", "preferred_requirements", "methods", "topics"), _number("application_deadline", "date"),
        _text("funding_amount", 200), _text("funding_currency", 3, exact=True), _text("funding_details"), _text("url", 1000, True), _text("source_url", 1000), *_json("source_ids"),
        _number("email_verified", "boolean", "false"), _text("verification_source", 200), _text("verification_method", 100), _number("email_confidence", "decimal(3,2)", "0.0"),
        _text("verification_level", default="NONE", one_of=VERIFICATION_LEVELS), _text("research_domain", 100), _number("research_fit_score", "decimal(5,2)", "0.0"), _number("final_rank_score", "decimal(5,2)", "0.0"),
        _text("contact_priority", default="LOW", one_of=CONTACT_PRIORITIES), _text("state", default="DISCOVERED", one_of=POSITION_STATES), _number("freshness_score", "decimal(4,3)", "1.0"), _number("confidence", "decimal(3,2)", "0.0"),
        *_when("discovered_at", now=True), *_when("last_crawled_at", "last_verified_at"), _number("posting_date", "date"), *_BOTH,
    ), (("canonical_id",),)),
    Table("evidence", (
        _id(), Field("candidate_id", "uuid", required=True), _text("candidate_type", 50, True), _text("claim", None, True), Field("value", "json"), _text("source_url", 1000, True), _text("source_type", None, True, one_of=SOURCE_TYPES),
        _number("source_priority", "int", "5", True), *_when("retrieved_at", now=True), _text("evidence_text", None, True), _number("confidence", "decimal(3,2)", "0.5", True), _text("verification_state", 50, default="unverified"), *_when("created_at", now=True),
    )),
    Table("crawl_logs", (
        _id(), _text("source_name", 100, True), _text("url", 1000, True), _number("status_code", "int"), _text("content_hash", 64), _text("parser_version", 50), *_when("started_at", now=True), *_when("completed_at"),
        _number("duration_ms", "int"), _number("success", "boolean", "false"), _text("error_type", one_of=FAILURE_TYPES), _text("error_message"), _number("retry_count", "int", "0"), _number("items_extracted", "int", "0"), *_when("created_at", now=True),
    )),
    Table("recovery_solutions", (
        _id(), _text("source_name", 100, True), _text("failure_type", None, True, one_of=FAILURE_TYPES), _text("url_pattern", 500), _text("solution_method", 200, True), Field("solution_details", "json"),
        _number("success_count", "int", "0"), _number("failure_count", "int", "0"), *_when("last_used_at"), *_BOTH,
    ), (("source_name", "failure_type", "url_pattern", "solution_method"),)),
    Table("user_subscriptions", (
        _id(), _number("telegram_user_id", "bigint", required=True), _text("username", 200), _text("first_name", 200), _text("language_code", 2, default="fa", exact=True), _to("research_fingerprint_id", "research_fingerprint"),
        _text("alert_frequency", 20, default="daily"), _number("min_rank_score", "decimal(5,2)", "70.0"), *_json("preferred_countries", "preferred_fields"), _number("is_active", "boolean", "true"), *_BOTH, *_when("last_alert_at"),
    ), (("telegram_user_id",),)),
    Table("alert_history", (
        _id(), _to("subscription_id", "user_subscriptions", "cascade"), *_json("position_ids", required=True), *_when("sent_at", now=True), _text("delivery_status", 50, default="sent"), *_when("created_at", now=True),
    )),
    Table("source_health", (
        _id(), _text("source_name", 100, True), *_when("last_successful_crawl", "last_failed_crawl"), _number("consecutive_failures", "int", "0"), _number("total_crawls", "int", "0"), _number("successful_crawls", "int", "0"),
        _number("avg_duration_ms", "int"), _number("avg_items_per_crawl", "decimal(10,2)"), _text("current_parser_version", 50), _text("status", 50, default="healthy"), *_when("last_checked_at", "updated_at", now=True),
    ), (("source_name",),)),
)}


def create_tables(spark: SparkSession, database: str) -> None:
    """The declared tables in the catalogue, empty."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for t in TABLES.values():
        spark.sql(t.ddl().replace(f"TABLE {t.name}", f"TABLE IF NOT EXISTS {database}.{t.name}"))


def conform(rows: DataFrame, table: Table, now: Column) -> DataFrame:
    """``rows`` in the declared columns and types: columns that are absent take
    their defaults, others are cast (null where that fails), further ones go."""
    out = []
    for f in table.fields:
        if f.name in rows.columns:
            value = F.col(f.name).try_cast(f.spark) if f.kind != "vector" else F.col(f.name).cast(f.spark)
        elif f.default == "now":
            value = now.cast("timestamp")
        else:
            value = F.expr(f.default or "NULL").cast(f.spark)
        out.append(value.alias(f.name))
    return rows.select(*out)


def broken(f: Field, kind: str) -> dict[str, Column]:
    """Conditions under which a row breaks the field's rules; ``kind`` is the
    type that the column has in the rows."""
    c = F.col(f.name)
    rules = {}
    if f.required:
        rules["required"] = c.isNull()
    if f.kind == "uuid":
        rules["uuid"] = ~c.cast("string").rlike(UUID)
    elif f.kind == "json":
        rules["json"] = c.isNotNull() & F.try_parse_json(c.cast("string")).isNull()
    elif f.kind == "vector":
        rules["length"] = F.size(c) != f.length
    elif f.kind != "string" and kind != f.spark:
        rules["type"] = c.isNotNull() & c.try_cast(f.spark).isNull()
    if f.length and f.kind == "string":
        n = F.length(c.cast("string"))
        rules["length"] = n != f.length if f.exact else n > f.length
    if f.one_of:
        rules["domain"] = ~c.cast("string").isin(*f.one_of)
    return rules


def violations(frames: dict[str, DataFrame], tables: dict[str, Table] = TABLES) -> DataFrame:
    """table_name, columns, rule, violations: a row for each rule of the
    columns that ``frames`` have, rows that break it counted.

    Rows of a repeated key count but one; a reference of null breaks no rule,
    and one to a table that is not among ``frames`` is not looked up.
    """
    out = []
    for name, rows in frames.items():
        table, kinds = tables[name], dict(rows.dtypes)
        fields = [f for f in table.fields if f.name in kinds]
        single = [(f.name, rule, when) for f in fields for rule, when in broken(f, kinds[f.name]).items()]
        counts = rows.agg(*(F.count_if(when).alias(f"n{i}") for i, (_, _, when) in enumerate(single)))
        each = F.array(*(F.struct(F.lit(column).alias("columns"), F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations")) for i, (column, rule, _) in enumerate(single)))
        out.append(counts.select(F.inline(each)).select(F.lit(name).alias("table_name"), "*"))
        for keys in (("id",), *table.unique):
            if all(k in kinds for k in keys):
                whole = rows.dropna(subset=list(keys)).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n"))
                out.append(_one(whole, name, ",".join(keys), "unique"))
        for f in fields:
            if f.refers in frames:
                used = rows.dropna(subset=[f.name]).groupBy(F.col(f.name).alias("__ref")).agg(F.count(F.lit(1)).alias("n"))
                there = frames[f.refers].select(F.col("id").alias("__ref"))
                out.append(_one(used.join(there, "__ref", "left_anti"), name, f.name, "reference"))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def _one(counted: DataFrame, name: str, columns: str, rule: str) -> DataFrame:
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))
    return n.select(F.lit(name).alias("table_name"), F.lit(columns).alias("columns"), F.lit(rule).alias("rule"), "violations")


def without(frames: dict[str, DataFrame], name: str, gone: DataFrame, tables: dict[str, Table] = TABLES) -> dict[str, DataFrame]:
    """``frames`` after the rows of ``name`` whose id is in ``gone`` (id) are
    deleted: rows that refer to them go too, or lose the reference."""
    after = dict(frames)
    after[name] = after[name].join(gone.select("id").distinct(), "id", "left_anti")
    waiting = [(name, gone.select("id").distinct())]
    while waiting:  # the declarations have no cycle of references
        name, gone = waiting.pop(0)
        for child, field in referring(name, tables):
            if child not in after or field.name not in after[child].columns:
                continue
            key = gone.select(F.col("id").alias(field.name))
            if field.on_delete == "cascade":
                waiting.append((child, after[child].join(key, field.name, "left_semi").select("id").distinct()))
                after[child] = after[child].join(key, field.name, "left_anti")
            else:
                marked = after[child].join(key.withColumn("__gone", F.lit(True)), field.name, "left")
                kept = F.when(F.col("__gone").isNull(), F.col(field.name)).alias(field.name)
                after[child] = marked.select(*(kept if c == field.name else c for c in frames[child].columns))
    return {k: v.select(*frames[k].columns) for k, v in after.items()}


def referring(name: str, tables: dict[str, Table] = TABLES) -> Iterable[tuple[str, Field]]:
    return [(t.name, f) for t in tables.values() for f in t.fields if f.refers == name]
