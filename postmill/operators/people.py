"""People, institutions and works: joins and fits over snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import gates
from postmill.functions.dates import stated_deadline
from postmill.functions.gates import any_of
from postmill.functions.titles import funding_snippet, hiring_intent, is_university_email, university_country
from postmill.operators.ranking import top_per

# Trust in an address by where it was found, best first.
EMAIL_SOURCES = (("profile", 1.0), ("lab", 0.95), ("department", 0.95), ("orcid", 0.8), ("scholar", 0.75))


def topic_fit(topic: Column, paper_titles: Column, concepts: tuple, methods: tuple, has_orcid: Column, citations: Column) -> Column:
    """Fit of a person found by topic: 40, and 20 for a wanted concept or 15
    for a method in topic and paper titles, 15 for an ORCID, 10 for more than
    1,000 citations."""
    blob = F.lower(F.concat_ws(" ", topic, paper_titles))
    lower = lambda words: tuple(w.lower() for w in words)
    rules = ((any_of(blob, lower(concepts)), 20), (any_of(blob, lower(methods)), 15), (has_orcid, 15), (citations > 1000, 10))
    return F.least(sum((F.when(c, n).otherwise(0) for c, n in rules), F.lit(40)), F.lit(100))


def by_name(people: DataFrame, name: str, least: int = 30) -> DataFrame:
    """People whose name holds the words, with more than ``least`` works, and
    their first institution; ``people``: person, name, works, citations,
    institutions (array of struct name, country)."""
    first = F.get("institutions", F.lit(0))
    good = F.lower("name").contains(name.lower()) & (F.col("works") > least)
    return people.where(good).select("person", "name", "works", "citations", first["name"].alias("institution"), first["country"].alias("country"))


def positions_from_hits(hits: DataFrame) -> DataFrame:
    """Search hits as raw positions: hosts that never carry one are skipped,
    deadline and funding come from snippet and title; ``hits``: url, title,
    snippet, university and any others."""
    text = F.concat_ws(" ", F.coalesce("snippet", F.lit("")), F.coalesce("title", F.lit("")))
    kept = hits.where((F.coalesce("url", F.lit("")) != "") & ~gates.is_skipped(F.col("url")))
    return kept.withColumns({
        "source_name": F.lit("ddgs"), "source_url": F.col("url"), "application_url": F.col("url"), "title": F.left("title", F.lit(500)), "description": F.left("snippet", F.lit(1000)),
        "country": university_country(F.col("university")), "application_deadline": stated_deadline(text), "funding_info": funding_snippet(text),
    }).drop("url", "snippet")


def grants(funded: DataFrame, most: int = 10) -> DataFrame:
    """Distinct grants (funder, award) of each author in order of appearance,
    the first ``most``; ``funded``: person, seq, funder, award, title."""
    key = ["person", "funder", "award"]
    first = funded.groupBy(*key).agg(F.min(F.struct("seq", "title")).alias("f")).select(*key, "f.*")
    return top_per(first, "person", [F.col("seq"), F.col("funder"), F.col("award")], most)


def discover(people_by_topic: DataFrame, least: int) -> DataFrame:
    """People over several topics: the first topic that found a person counts,
    those under the minimum fit go, an ORCID makes them probable."""
    first = people_by_topic.groupBy("person").agg(F.min_by(F.struct("topic", "fit", "has_orcid"), "topic_pos").alias("r")).select("person", "r.*")
    return first.where(F.col("fit") >= least).withColumn("level", F.when(F.col("has_orcid"), "PROBABLE").otherwise("UNVERIFIED")).drop("has_orcid")


def verify_email(found: DataFrame) -> DataFrame:
    """The first address by source that belongs to the person's university;
    ``found``: person, university, source_pos (from 0), email."""
    good = found.where(is_university_email(F.col("email"), F.col("university")))
    trust = F.array(*(F.lit(t) for _, t in EMAIL_SOURCES))
    best = good.groupBy("person").agg(F.min(F.struct("source_pos", "email")).alias("b"))
    everyone = found.select("person").distinct()
    c = F.get(trust, F.col("b.source_pos"))
    return everyone.join(best, "person", "left").select(
        "person", F.col("b.email").alias("email"), c.alias("confidence"), F.when(c >= 0.95, "VERIFIED").when(c.isNotNull(), "PROBABLE").otherwise("UNVERIFIED").alias("level")
    )


def touching_concepts(people: DataFrame, concepts: tuple) -> DataFrame:
    """Pairs of a wanted concept and a keyword of which one contains the other."""
    pairs = people.select("person", F.explode("keywords").alias("keyword")).withColumn("wanted", F.array(*map(F.lit, concepts)))
    return pairs.select("person", "keyword", F.explode("wanted").alias("concept")).where(F.contains("keyword", "concept") | F.contains("concept", "keyword")).distinct()


def recent_works(works: DataFrame, most: int = 10) -> DataFrame:
    """Each person's latest works as an array."""
    kept = top_per(works, "person", [F.desc("published"), F.col("work")], most)
    return kept.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "work"))), lambda x: x["work"]).alias("works"))


def best_page(pages: DataFrame) -> DataFrame:
    """Per university the page with most vacancies, and what it is."""
    best = pages.groupBy("university").agg(F.max_by(F.struct("page_id", "vacancies"), F.struct(F.col("vacancies"), -F.col("page_id"))).alias("b"), F.sum("vacancies").alias("total"))
    n = F.col("b.vacancies")
    return best.select("university", F.col("b.page_id").alias("page_id"), n.alias("vacancies"), F.when(n >= 3, "JOB_LIST").when(n > 0, "LANDING").otherwise("NONE").alias("status"), "total")


def board_report(boards: DataFrame, by: str) -> DataFrame:
    """How many boards of each group were crawled, gave data, were silent or
    skipped, and the postings found; ``boards``: status (skipped or not), found
    and the grouping column."""
    skipped, found = F.col("status") == "skipped", F.coalesce("found", F.lit(0))
    return boards.groupBy(by).agg(
        F.count(F.lit(1)).alias("boards"), F.count_if(~skipped).alias("crawled"), F.count_if(~skipped & (found > 0)).alias("with_data"), F.count_if(~skipped & (found == 0)).alias("silent"), F.count_if(skipped).alias("skipped"),
        F.sum(F.when(skipped, 0).otherwise(found)).alias("postings"),
    )


def institutions_by_concept(institutions: DataFrame, concepts: DataFrame, countries: DataFrame, most_concepts: int = 10, most: int = 50) -> DataFrame:
    """Institutions of education in wanted countries that work on a wanted
    concept, with the first concept and country that found each.  Of the first
    ``most_concepts`` concepts and each country the ``most`` largest count, as a
    search page shows them.  Concepts and countries never meet in a product: an
    institution's concepts and its country are looked up each on their own.

    ``institutions``: id, country, kind, works, concepts (array); ``concepts``:
    concept, concept_pos; ``countries``: country, country_pos.
    """
    wanted = concepts.where(F.col("concept_pos") < most_concepts)
    cells = institutions.where("kind = 'education'").join(countries, "country").select("id", "country", "country_pos", "works", F.explode(F.array_distinct("concepts")).alias("concept")).join(wanted, "concept")
    cells = cells.withColumn("cell", F.struct("concept_pos", "country_pos"))
    shown = top_per(cells, "cell", [F.desc("works"), F.col("id")], most)
    first = F.min_by(F.struct(F.col("concept").alias("matched_concept"), F.col("country").alias("matched_country")), F.struct("concept_pos", "country_pos", "rank"))
    return shown.groupBy("id").agg(first.alias("m")).select("id", "m.*")


def discover_at(universities: DataFrame, people: DataFrame, least: float = 70.0, most_universities: int = 25, most_people: int = 30) -> DataFrame:
    """People at the first universities of a mapping: the best known of each,
    those that fit, and how far their address can be trusted.
    ``universities``: university, pos; ``people``: person, university, cited,
    fit, email, confidence, verified."""
    at = people.join(universities.where(F.col("pos") < most_universities).select("university"), "university")
    good = top_per(at, "university", [F.desc("cited"), F.col("person")], most_people).where(F.col("fit") >= least)
    trust, mail = F.coalesce("confidence", F.lit(0.0)), F.coalesce("email", F.lit("")) != ""
    level = F.when(F.coalesce("verified", F.lit(False)) & (trust >= 0.9), "VERIFIED").when(mail & (trust >= 0.7), "PROBABLE").otherwise("UNVERIFIED")
    return good.select("person", "university", "rank", "fit", level.alias("level"))


def overlapping(rows: DataFrame, key: str, listed: str, wanted: DataFrame) -> DataFrame:
    """``rows`` of which the array ``listed`` holds one of ``wanted`` (value,
    pos), with ``first_match``, the wanted value that comes first.  An inverted
    index: values meet by an equi-join, and a row that several values find is
    found once."""
    index = rows.select(F.col(key).alias("__key"), F.explode(F.array_distinct(listed)).alias("value"))
    met = index.join(wanted, "value").groupBy("__key").agg(F.min_by("value", "pos").alias("first_match"))
    return rows.join(met, F.col(key) == F.col("__key")).drop("__key")


def position_of_work() -> Column:
    """A work, its author and institution as a raw position; columns: work,
    work_title, abstract, doi, person, person_name, institution_name, country,
    city."""
    c, doi = F.col, F.col("doi")
    return F.struct(
        F.concat(F.lit("https://openalex.org/"), c("work").cast("string")).alias("source_url"), F.left(F.concat(F.lit("PhD Position in "), F.coalesce("work_title", F.lit("Research"))), F.lit(500)).alias("title"),
        F.coalesce("institution_name", F.lit("")).alias("university"), F.upper(F.coalesce("country", F.lit(""))).alias("country"), c("city").alias("city"), F.left(F.nullif("abstract", F.lit("")), F.lit(2000)).alias("description"),
        F.when((doi == "") | doi.startswith("http"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi)).alias("application_url"), F.coalesce("person_name", F.lit("")).alias("pi_name"),
        F.when(c("person").isNotNull(), F.concat(F.lit("https://openalex.org/"), c("person").cast("string"))).alias("pi_profile_url"),
    )


def funded_positions(works: DataFrame, authorships: DataFrame, people: DataFrame, institutions: DataFrame, funders: DataFrame, concepts: DataFrame, year: int, most_funders: int = 5, most: int = 50) -> DataFrame:
    """Positions that works of a year announce: funded by one of the first
    funders, on a wanted concept, with hiring intent; person and institution
    are those of the first authorship that has an institution at its head.

    ``works``: work, year, work_title, abstract, doi, concepts, funders (arrays);
    ``authorships``: work, pos, person, institution; ``people``: person,
    person_name; ``institutions``: institution, institution_name, country, city;
    ``funders``, ``concepts``: value, pos.  The ``most`` first works of each
    funder count, as a search page shows them.
    """
    recent = works.where(F.col("year") == year)
    paid = recent.select("work", F.explode(F.array_distinct("funders")).alias("value")).join(funders.where(F.col("pos") < most_funders), "value")
    shown = top_per(paid.select("value", "work"), "value", [F.col("work")], most).select("work").distinct()
    hiring = overlapping(recent.join(shown, "work", "left_semi"), "work", "concepts", concepts).where(hiring_intent(F.concat_ws(" ", "work_title", "abstract")))
    head = authorships.groupBy("work").agg(F.min_by(F.struct("person", "institution"), "pos").alias("a")).select("work", "a.*").where("institution IS NOT NULL")
    rows = hiring.join(head, "work").join(people, "person", "left").join(institutions, "institution", "left")
    return rows.select("work", "person", "institution", "first_match", position_of_work().alias("p")).select("work", "person", "institution", "first_match", "p.*")


def concept_positions(works: DataFrame, authorships: DataFrame, people: DataFrame, institutions: DataFrame, concepts: DataFrame, countries: DataFrame, year: int, most_concepts: int = 10, most_institutions: int = 20, most_people: int = 30, most_works: int = 10) -> DataFrame:
    """Positions found by concept and country: the institutions there, their
    most cited people on the concept, their works of the year with hiring
    intent; one row for each way that leads to a work.

    ``people``: person, person_name, cited, institution, concepts;
    ``institutions``: institution, institution_name, country, city, kind, works,
    concepts; the others as above.
    """
    wanted = concepts.where(F.col("pos") < most_concepts).select(F.col("value").alias("concept"))
    there = institutions.where("kind = 'education'").join(countries, "country").select("*", F.explode(F.array_distinct("concepts")).alias("concept")).drop("concepts").join(wanted, "concept")
    there = top_per(there.withColumn("cell", F.struct("concept", "country")), "cell", [F.desc("works"), F.col("institution")], most_institutions).select("concept", "institution", "institution_name", "country", "city")
    who = people.select("person", "person_name", "cited", "institution", F.explode(F.array_distinct("concepts")).alias("concept")).join(there, ["institution", "concept"])
    who = top_per(who.withColumn("cell", F.struct("institution", "concept")), "cell", [F.desc("cited"), F.col("person")], most_people).drop("cell", "rank", "cited")
    mine = authorships.select("work", "person").distinct().join(works.where(F.col("year") == year), "work")
    mine = top_per(mine, "person", [F.col("work")], most_works).where(hiring_intent(F.concat_ws(" ", "work_title", "abstract"))).drop("rank", "concepts")
    rows = who.join(mine, "person")
    return rows.select("work", "person", "institution", "concept", position_of_work().alias("p")).select("work", "person", "institution", "concept", "p.*")


def top_concepts(counted: DataFrame, most: int = 3) -> DataFrame:
    """person, concept of each person's ``most`` concepts; ``counted``: person,
    concept, n.  An aggregate over a person's concepts, of which there are few,
    instead of a window."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "concept"))), 1, most)
    return counted.groupBy("person").agg(best.alias("best")).select("person", F.explode(F.col("best.concept")).alias("concept"))


def research_groups(people: DataFrame, least: int = 2) -> DataFrame:
    """Groups of at least ``least`` people of an institution who share one of
    their top concepts, a row per member: institution, concept, name, person,
    members.  ``people``: person, institution, concept."""
    key = ["institution", "concept"]
    sizes = people.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    return people.join(sizes, key).select(*key, F.concat("concept", F.lit(" Research Group")).alias("name"), "person", "members")


def sub_institutions(authors: DataFrame) -> DataFrame:
    """institution, part, authors: other institutions that an institution's
    authors name, with how many do; ``authors``: person, institution, places
    (array)."""
    named = authors.select("institution", F.explode(F.array_distinct("places")).alias("part")).where("part <> institution")
    return named.groupBy("institution", "part").agg(F.count(F.lit(1)).alias("authors"))


def target_concepts(*lists: Column) -> Column:
    """The concepts of a profile's lists, lower case and trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != ""))


def target_countries(countries: DataFrame, most: int = 5) -> DataFrame:
    """Countries whose priority is at most ``most``."""
    return countries.where(F.coalesce("priority", F.lit(99)) <= most)


def largest_silent(boards: DataFrame, most: int) -> DataFrame:
    """Boards that were crawled, gave nothing and have no note that says why,
    the largest universities first; ``boards``: board, found, note, papers.  The
    first ``most`` are a report."""
    silent = (F.coalesce("found", F.lit(0)) == 0) & (F.coalesce("note", F.lit("")) == "")
    return boards.where(silent).orderBy(F.desc_nulls_last("papers"), "board").limit(most)
