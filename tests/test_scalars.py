"""Literal cases of the scalar operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, gates, titles, urls
from postmill.operators import pages, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("text", "status", "value"),
    [
        ("Deadline: 2026-10-18", "open", "2026-10-18"),
        ("Deadline: 18 Oct 2026", "open", "2026-10-18"),
        ("Apply by October 18, 2026", "open", "2026-10-18"),
        ("Closing date 18/10/2026", "open", "2026-10-18"),
        ("Closing date 10/18/2026", "open", "2026-10-18"),
        ("Closing date 05/10/2026", "open", "2026-10-05"),
        ("Closes on 3rd March 2020", "expired", "2020-03-03"),
        ("Posted 2026-05-01", "unknown", None),
        ("Date placed: 28 Sep 2026", "unknown", None),
        ("Deadline: 15 March", "unknown", None),
        ("Apply by 15 March each year", "open", "2027-03-15"),
        ("Deadline: 31/02/2027", "unknown", None),
        ("Open until filled", "unknown", None),
        ("", "unknown", None),
        ("A date, 1 Dec 2026, in passing", "open", "2026-12-01"),
    ],
)
def test_deadline(spark, text, status, value):
    got = one(spark, dates.deadline(F.lit(text), F.lit("2026-06-01").cast("date")))
    assert got.status == status
    assert got.value == (datetime.date.fromisoformat(value) if value else None)


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("/jobs/", "https://a.org/jobs"),
        ("jobs?utm_source=x&id=4", "https://a.org/de/jobs?id=4"),
        ("//B.org/x#top", "https://b.org/x"),
        ("https://A.org", "https://a.org/"),
        ("mailto:x@a.org", ""),
        ("javascript:void(0)", ""),
        ("", ""),
        ("?page=2", "https://a.org/de/index?page=2"),
    ],
)
def test_normalise(spark, url, expected):
    assert one(spark, urls.normalise(F.lit(url), F.lit("https://a.org/de/index"))) == expected


@pytest.mark.parametrize(
    ("title", "generic"),
    [("PhD", True), ("PhD 2026", True), ("#PhD", True), ("PhD Candidates", True), ("PhD Student, in the area", True), ("", True), ("PhD position in Neuroscience", False), ("PhD defence of A B", False), ("The Institute of Things", True)],
)
def test_generic_titles(spark, title, generic):
    assert one(spark, gates.is_generic(F.lit(title))) is generic


@pytest.mark.parametrize(("title", "chrome"), [("Home", True), ("Find out more:", True), ("(untitled)", True), ("page 3", True), ("12.", True), ("", True), ("PhD in Gait", False), ("Careers", True), ("Career in research", False)])
def test_chrome(spark, title, chrome):
    assert one(spark, gates.is_chrome(F.lit(title))) is chrome


def test_titles(spark):
    assert one(spark, titles.strip_trailing_id(F.lit("PhD opening in optics 5udgbc81w7"))) == "PhD opening in optics"
    assert one(spark, titles.strip_trailing_id(F.lit("PhD in Biomechanics"))) == "PhD in Biomechanics"
    assert one(spark, titles.title_from_context(F.lit("Queen's University"), F.lit("PhD Studentship with us We are seeking"))) == "PhD Studentship"
    assert one(spark, titles.first_email(F.lit("a@gmail.com b@x.edu"))) == "b@x.edu"


def test_scores_and_similarity(spark):
    assert abs(sum(scoring.WEIGHTS.values()) - 1) < 1e-9
    assert one(spark, scoring.eligibility(F.lit("MSc; PhD candidate; IELTS; citizen"))) == 55.0
    assert one(spark, scoring.token_set_ratio(F.lit("motor control"), F.lit("control of motor"))) == 100.0
    assert one(spark, scoring.token_set_ratio(F.lit("gait"), F.lit("polymer"))) < 60


def test_board_links_are_ranked(spark):
    html = '<a href="/en">home</a><a href="/careers">Careers</a><a href="/phd/vacancies?utm_x=1">PhD vacancies</a><a href="https://other.org/jobs">Jobs</a><a href="/files/jobs.pdf">Jobs</a>'
    df = spark.createDataFrame([(1, "https://www.uni.org/", html)], "page_id long, url string, html string")
    got = pages.board_links(df).orderBy("rank").select("url").collect()
    assert [r.url for r in got] == ["https://www.uni.org/phd/vacancies", "https://www.uni.org/careers"]


def test_harvest_and_next_page(spark):
    html = '<ul><li><a href="/job/1">PhD in Gait</a> at a university, deadline 2030-01-01<li><a href="/job/1?x">again</a></li><li><a href="/job/2/">Doctoral candidate in X</a> research</ul><a href="/home">Home</a><a href="/list?page=2">Next</a>'
    df = spark.createDataFrame([(1, "https://www.uni.org/list", html)], "page_id long, url string, html string")
    got = pages.harvest(df, F.lit("2026-06-01").cast("date")).orderBy("n").collect()
    assert [(r.url, r.deadline_status) for r in got] == [("https://www.uni.org/job/1", "open"), ("https://www.uni.org/job/2/", "unknown")]
    assert pages.next_page(pages.anchors(df)).head().next_url == "https://www.uni.org/list?page=2"


def test_description_takes_the_longest_leaf(spark):
    prose = "word " * 60
    html = f"<nav><p>{prose * 2}</p></nav><div><p>{prose}</p></div><p>cookie {prose * 2}</p><p>short</p>"
    assert one(spark, pages.description(F.lit(html))) == prose.strip()
