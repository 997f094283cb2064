"""What is read in Arrow batches equals what expressions read."""

import datetime
import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_work_done_once import optimized

from postmill.functions import dates, fixed, gates, scan, titles
from postmill.plans import positions

PIECES = (
    "Deadline", "deadline:", "Closing date", "closes on", "apply by", "Apply  until", "submit before", "Posted", "posted on", "Published", "last updated", "updated", "start date", "12", "3", "31", "1998", "98", "199", "0000",
    "/", "-", ".", " ", " ", " ", "\n", ". ", "; ", " | ", ",", "st", "th", "March", "Mar.", "sept", "May", "JUN", "February", "each year", "until filled", "x", "_", "a filler of words to pass the window of sixty chars ", "12/3/1998", "3.4.99",
    "13/12/2026", "12-13-1998", "1998-02-30", "1998/3/4", "2026-12-01", "5 May 1999", "May 5, 2027", "15 March", "30 Feb 1999", "\t", "\x0b", "\r",
)
WORDS = ("gait", "Gait analysis", "PhD", "sensor", "sensorimotor", "kinematics", "3d", "3", "human", "machine learning", "motor control", "ELECTROMYOGRAPHY", "imu", "thesis", "emg", "pat", "ient", "İ", "ſensor", "ph.d", "predict", "é", "x")
DAY = datetime.date(1998, 6, 1)


def some(words, most, n):
    pick = random.Random(5)
    return ["".join(pick.choice(words) + pick.choice(("", " ")) for _ in range(pick.randint(1, most))) for _ in range(n)]


def test_deadlines_of_a_batch_are_those_of_the_expressions(spark):
    texts = [None, "", "é12 March 1999", "Deadline: 1 May 1999 é", *some(PIECES, 20, 1500), *some((*PIECES, "é", "́"), 12, 300)]
    rows = spark.createDataFrame([(t, None if i % 7 == 3 else DAY) for i, t in enumerate(texts)], "t string, day date")
    for first in (True, False):
        got = rows.select("t", F.to_json(dates.deadline(F.col("t"), F.col("day"), first)).alias("a"), F.to_json(dates.deadline_by_expressions(F.col("t"), F.col("day"), first)).alias("b")).collect()
        assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got]
        assert sum("value" in r.a for r in got) > 300


def test_texts_of_many_dates_are_read_one_by_one():
    texts = ["Posted 1999-01-01. " * 9 + "Deadline: 2 May 1999", "3/4/99 " * 9, "apply by soon " * 9 + "apply by 3/4/99", "closing date 15 March, each year 3/4/99", None]
    found = scan.deadlines(pa.array(texts), pa.array([DAY] * len(texts)), True)
    assert found.field("raw").to_pylist() == ["Deadline 2 May 1999", "3/4/99", "apply by 3/4/99", "closing date 15 March", ""]
    days = found.field("value").cast(pa.int32()).to_pylist()
    assert days == [scan.day_number(1999, 5, 2), scan.day_number(2099, 4, 3), scan.day_number(2099, 4, 3), scan.day_number(1999, 3, 15), None]


def test_topic_points_of_a_batch_are_those_of_the_phrases(spark):
    titles, texts = [None, "", *some(WORDS, 4, 600)], ["sensor", None, *some(WORDS, 9, 600)]
    rows = spark.createDataFrame(list(zip(titles, texts)), "title string, context string")

    def points(r):
        title = r.low or ""
        seen, near = sum(t in r.blob for t in gates.TOPIC_CONTEXT), any(t in title for t in gates.ADJACENT_TITLE)
        base = 60 if any(t in title for t in gates.TOPIC_TITLE) else 47 if seen >= 4 else 35 if seen >= 2 else 30 if near else 0
        extra = 8 * near + 18 * any(t in r.blob for t in gates.LEARNING) + 14 * any(t in r.blob for t in gates.SENSORS) + 3 * any(t in title for t in gates.DOCTORAL)
        return min(100, base + extra) if base else 0

    got = rows.select(F.lower("title").alias("low"), F.lower(F.concat_ws(" ", "title", "context")).alias("blob"), gates.topic_fit(F.col("title"), F.col("context")).alias("fit")).collect()
    assert [r.fit for r in got] == [points(r) for r in got] and len({r.fit for r in got}) > 8


def test_phrases_do_not_run_into_the_next_text(monkeypatch):
    monkeypatch.setattr(scan, "RUN", 8)
    found = scan.Phrases(("gait", "3d", "gaits")).found(pa.array(["ga", "it", None, "gait", "s", "gaits 3", "d", "", "3d"]).slice(1))
    assert [[p for p, x in zip(("gait", "3d", "gaits"), row) if x] for row in found.tolist()] == [[], [], ["gait"], [], ["gait", "gaits"], [], [], ["3d"]]


def test_the_fit_is_computed_once(spark):
    assert optimized(positions.rescore(spark, "/root/testdata/sf0.001")).count("_topic_points") == 1


def test_funding_rolling_and_country_of_a_batch_are_those_of_the_expressions(spark):
    words = ("rolling", "Open until filled", "until  closed", "no deadline", "no application deadline", "as long as\x0bfunds last", "fully-funded", "SALARY", "€ 30,000", "EUR 30,000", "EUR30,00", "4 year", "3 years", "per month", "ſalary", "ETH Zurich", "oslo", "Karolinska", "Utrecht", "ktH", "é", " ", ".", "x")
    rows = spark.createDataFrame([(t,) for t in (None, "", *some(words, 6, 600))], "t string")
    t = F.col("t")
    pairs = (
        (titles.has_funding(t), t.rlike(fixed.rule(fixed.FUNDING_EVIDENCE))), (dates.is_rolling(t), t.rlike(fixed.ROLLING)),
        (titles.infer_country(F.lit("https://x.org/a"), t), titles.first_containing(F.lower(t), titles.COUNTRY_HINTS)), (gates.relevance(t, ("salary", "sal", "oslo", "filled")), gates.how_many(F.lower(t), ("salary", "sal", "oslo", "filled")) >= 2),
    )
    for a, b in pairs:
        got = rows.select("t", a.alias("a"), b.alias("b")).collect()
        assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got] and len({r.a for r in got}) > 1


def test_texts_of_details_are_not_matched_by_expressions_alone(spark):
    plan = optimized(positions.enrich(spark, "/root/testdata/sf0.001"))
    assert plan.count("met(") >= 2 and "_hinted(" in plan
