"""Weighted position scores, fits and tiers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from postmill.functions import fixed
from postmill.functions.gates import any_of
from postmill.functions.titles import normal_text

WEIGHTS = fixed.RANKING_WEIGHTS
# Universities of the institutional fit.
TOP_UNIVERSITIES = (
    "toronto", "ubc", "mcgill", "waterloo", "alberta", "amsterdam", "delft", "leiden", "utrecht", "groningen", "munich", "heidelberg", "berlin",
    "bonn", "freiburg", "helsinki", "aalto", "turku", "tampere", "auckland", "otago", "victoria", "canterbury",
)


def bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(score.cast("double"), F.lit(100.0)))


def points(base: float, *rules: tuple) -> Column:
    """A base plus what each holding condition is worth, within 0 to 100."""
    return bounded(reduce(lambda total, rule: total + F.when(rule[0], F.lit(float(rule[1]))).otherwise(0.0), rules, F.lit(float(base))))


def method_fit(text: Column, methods: tuple) -> Column:
    """Share of the wanted methods that the text names."""
    low = F.lower(text)
    return F.lit(50.0) if not methods else F.round(F.size(F.filter(F.array(*map(F.lit, methods)), lambda m: low.contains(m))) * (100.0 / len(methods)), 6)


def supervisor_fit(known: Column, fit: Column, verified: Column, has_grants: Column, hiring: Column) -> Column:
    score = fit + F.when(verified, 10).otherwise(0) + F.when(has_grants, 10).otherwise(0) + F.when(hiring, 5).otherwise(0)
    return F.when(~known, F.lit(30.0)).otherwise(F.least(score.cast("double"), F.lit(100.0)))


def lab_fit(known: Column, papers: Column, students: Column, has_grants: Column) -> Column:
    return points(50, (known & (papers > 0), 10), (known & (students > 0), 10), (known & (students > 3), 5), (known & has_grants, 5))


def eligibility(requirements: Column) -> Column:
    low = F.lower(requirements)
    return points(
        70, (any_of(low, ("master", "msc")), 10), (low.contains("phd") & low.contains("candidate"), -20),
        (any_of(low, ("ielts", "toefl")), 5), (any_of(low, ("citizen", "resident")), -10),
    )


def funding_score(amount: Column, details: Column) -> Column:
    low = F.lower(F.coalesce(details, F.lit("")))
    nothing = (F.coalesce(amount, F.lit("")) == "") & (low == "")
    return (
        F.when(nothing, 20.0).when(F.coalesce(amount, F.lit("")).rlike("[0-9]"), 90.0)
        .when(any_of(low, ("fully funded", "full funding", "stipend", "salary")), 85.0)
        .when(any_of(low, ("funded", "funding available", "scholarship")), 70.0)
        .when(any_of(low, ("partial", "tuition")), 40.0).otherwise(50.0)
    )


def career_alignment(goals: tuple, kind: Column, description: Column) -> Column:
    low = F.lower(description)
    academic = F.lit("academic" in goals or "research" in goals) & kind.isin("FUNDED_PHD", "PHD_PROJECT", "DOCTORAL_RESEARCHER")
    return points(50, (academic, 30), (F.lit("industry" in goals) & any_of(low, ("industry", "collaboration")), 20))


def opportunity_strength(known: Column, grant_dates: Column, as_of: Column, hiring: Column, students: Column, has_methods: Column) -> Column:
    recent = F.exists(grant_dates, lambda d: F.datediff(as_of, d) < 365)
    return points(50, (known & recent, 20), (known & hiring, 15), (known & (students > 2), 10), (has_methods, 5))


def institutional_fit(university: Column, department: Column) -> Column:
    words = ("biomechanics", "motor control", "kinesiology", "human kinetics", "rehabilitation")
    return points(60, (any_of(F.lower(university), TOP_UNIVERSITIES), 25), (any_of(F.lower(department), words), 10))


def overall(scores: dict[str, Column] | None = None, weights: dict = WEIGHTS) -> Column:
    cols = scores or {name: F.col(name) for name in weights}
    return F.round(reduce(lambda a, b: a + b, (cols[n] * F.lit(w) for n, w in weights.items())), 4)


def tier(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, F.lit("HIGH")).when(score >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def crawler_fit(title: Column, context: Column) -> Column:
    """Fit that a crawler gives before the gates: 40, and 25 for a topic word
    in the title, 20 for learning and 15 for sensors in the context."""
    low, around = F.lower(title), F.lower(context)
    some = lambda text, words, worth: F.when(any_of(text, words), worth).otherwise(0)
    return F.least(F.lit(40) + some(low, fixed.CRAWLER_TOPICS, 25) + some(around, fixed.CRAWLER_LEARNING, 20) + some(around, fixed.CRAWLER_SENSORS, 15), F.lit(100))


def record_confidence(source: Column, enriched: Column, has_deadline: Column, funded: Column) -> Column:
    """Confidence in a published record, 0.50 to 0.98."""
    hundredths = F.lit(50) + sum(
        (F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in ((source.isin(*fixed.OFFICIAL_SOURCES), 20), (enriched, 20), (has_deadline, 5), (funded, 5))), F.lit(0)
    )
    return F.least(hundredths, F.lit(98)) / 100.0


def word_set(text: Column) -> Column:
    """Distinct words of a text, as an array."""
    return F.array_remove(F.array_distinct(F.split(text, r"\s+")), "")


def set_parts(left: Column, right: Column) -> Column:
    """Two word sets, each part sorted: struct(common, only_a, only_b)."""
    parts = (F.array_intersect(left, right), F.array_except(left, right), F.array_except(right, left))
    return F.struct(*(F.array_join(F.sort_array(x), " ").alias(name) for x, name in zip(parts, ("common", "only_a", "only_b"))))


def shared_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _shared_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_length(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def most_shared(a: Column, b: Column) -> Column:
    """No common subsequence is longer: the letters of either text that the
    other has at all."""
    met = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return F.least(met(a, b), met(b, a))


def parts_ratio(t: Column, shared: Column) -> Column:
    """Similarity, 0 to 100, of two word sets in ``set_parts`` whose remainders
    have a common subsequence of ``shared`` letters; it grows with ``shared``."""
    common, left, right = F.length(t["common"]), F.length(t["only_a"]), F.length(t["only_b"])
    edits = left + right - 2 * shared
    gap = F.when(common > 0, 1).otherwise(0)
    whole_a, whole_b = common + gap + left, common + gap + right
    ratio = lambda n, total: 100.0 * (1 - n / F.greatest(total, F.lit(1)))
    best = F.greatest(ratio(edits, whole_a + whole_b), *(F.when(common > 0, ratio(gap + n, 2 * common + gap + n)).otherwise(0.0) for n in (left, right)))
    nothing = (common + left == 0) | (common + right == 0)
    subset = (common > 0) & ((left == 0) | (right == 0))
    return F.round(F.when(nothing, 0.0).when(subset, 100.0).otherwise(best), 4)


def _true_ratio(t: Column) -> Column:
    return parts_ratio(t, _shared_lengths(t["only_a"], t["only_b"]))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two names by their word sets, 0 to 100: 100 where one set
    holds the other, else the best insert-and-delete ratio among the common
    words and the common words with each remainder.  Its only step in Python,
    the common subsequence of the remainders, runs in Arrow batches."""
    return _true_ratio(set_parts(word_set(a), word_set(b)))


def best_concept_match(people: DataFrame, concepts: tuple, least: float = 75.0) -> DataFrame:
    """Per person and wanted concept the best matching keyword at ``least``
    similarity, the first of equals; ``people``: pi_id, keywords.  The wanted
    concepts are a short literal list, so each keyword is compared within its
    row: its words are taken once, the parts of each pair once (``explode``
    keeps Catalyst from copying them), and only pairs whose letters allow the
    similarity at all go to Python."""
    keywords = people.select("pi_id", F.posexplode("keywords").alias("at", "keyword")).withColumn("words", word_set(normal_text(F.col("keyword"))))
    wanted = (F.struct(F.lit(i).alias("pos"), F.lit(c).alias("concept"), set_parts(word_set(normal_text(F.lit(c))), F.col("words")).alias("t")) for i, c in enumerate(concepts))
    pairs = keywords.select("pi_id", "at", "keyword", F.explode(F.array(*wanted)).alias("w")).select("pi_id", "at", "keyword", "w.*")
    t = F.col("t")
    near = pairs.where(parts_ratio(t, most_shared(t["only_a"], t["only_b"])) >= least)
    best = near.withColumn("similarity", _true_ratio(t)).groupBy("pi_id", "pos", "concept").agg(
        F.max("similarity").alias("similarity"), F.max_by("keyword", F.struct(F.col("similarity"), -F.col("at"))).alias("keyword")
    )
    # a filter on single pairs would be pushed down with a second call of Python
    return best.where(F.col("similarity") >= least).drop("pos")


def keyword_score(text: Column, keywords: tuple, weight: float) -> Column:
    """Twice the occurrences of each keyword, at most ``weight`` for one and
    for all."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(word: str) -> Column:
        count = (F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / max(len(word), 1)
        return F.least(count * 2.0, F.lit(float(weight)))

    return F.least(reduce(lambda a, b: a + b, map(one, keywords), F.lit(0.0)), F.lit(float(weight)))


def research_fit(people: DataFrame, profile: dict) -> DataFrame:
    """Five-part fit of people to a profile: topics (50, by similarity),
    methods (25), data modalities (15), populations (10) and technical methods
    (10), by occurrences in the person's text.  ``people``: pi_id, keywords,
    text; ``profile``: core_topics, adjacent_topics, methods, technical_methods,
    data_modalities, populations."""
    topics = tuple(t.lower() for t in (*profile["core_topics"], *profile["adjacent_topics"]))
    matched = best_concept_match(people.select("pi_id", F.transform("keywords", F.lower).alias("keywords")), topics)
    by_topic = matched.groupBy("pi_id").agg(F.least(F.sum(F.col("similarity") / 2), F.lit(50.0)).alias("topics"))
    parts = {
        "methods": ((*profile["methods"], *profile["technical_methods"]), 25.0), "data_modalities": (profile["data_modalities"], 15.0),
        "populations": (profile["populations"], 10.0), "technical_methods": (profile["technical_methods"], 10.0),
    }
    scored = people.select("pi_id", *(keyword_score(F.col("text"), tuple(words), most).alias(name) for name, (words, most) in parts.items())).join(by_topic, "pi_id", "left")
    rows = scored.withColumn("topics", F.coalesce("topics", F.lit(0.0)))
    total = F.round(rows["topics"] + sum((F.col(n) for n in parts), F.lit(0.0)), 2)
    band = lambda x: F.when(x >= 90, "EXCEPTIONAL").when(x >= 80, "STRONG").when(x >= 70, "GOOD").otherwise("REJECT")
    out = rows.withColumn("overall", total)
    return out.select("pi_id", *(F.round(c, 2).alias(c) for c in ("topics", *parts)), "overall", band(F.col("overall")).alias("band"))


def fitting_people(fits: DataFrame, least: float = 70.0) -> DataFrame:
    """People of at least the minimum fit, best first."""
    return fits.where(F.col("overall") >= least).orderBy(F.desc("overall"), "pi_id")


def band_counts(fits: DataFrame) -> DataFrame:
    """How many people each band has."""
    count = lambda name: F.count_if(F.col("band") == name).alias(name.lower())
    return fits.agg(F.count(F.lit(1)).alias("total"), *map(count, ("EXCEPTIONAL", "STRONG", "GOOD", "REJECT")))
