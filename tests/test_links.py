"""Links that are read in Arrow batches equal those of the expressions."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions.fixed import rule
from postmill.operators import pages

PIECES = (
    "<a href='", '<A class=x HREF = "', '<a\nhref="', "<abbr href='", "'>", '">', "\">", "' title=x>", "</a>", "</A >", "<b>", "</b>", "<br/>", "text", "PhD Position in Gait ", "view all ", "Next page", "careers ", "  ", "\n", "\t", "\x0b", "\x1c", "#top",
    "https://Board1.Example.org/positions/phd-in-x", "HTTP://x.org", "//cdn.org/a/", "/jobs/1/", "jobs/2?ref=x&a=1&&UTM_x=2", "?page=3", "?page=", "mailto:x@y.org", "ftp://x.org/", "https:///x", "https://x.org/a?b\nc", "https://x.org/a?b=1#c", "?utm_a=1", " ", "&", "<", ">", "job vacancy for a research fellow ",
)
ADDRESSES = ("https://list.example.org/jobs?page=1", "https://list.example.org", "http://x.org/a/b/", "x", "", "https://x.org/a\nb/c#d", "file:/x/y", "https://x.org/é/", None)


def made(spark, n=700, letters=()):
    pick = random.Random(11)
    some = lambda most: "".join(pick.choice((*PIECES, *letters)) for _ in range(pick.randint(0, most)))
    link = lambda: pick.choice(PIECES[:3]) + pick.choice(PIECES[24:36]) + some(1) + "'>" + some(3) + "</a>"
    rows = [(i, pick.choice(ADDRESSES), "".join(link() if pick.random() < 0.7 else some(6) for _ in range(pick.randint(1, 9)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "https://x.org", None), (None, "https://x.org/", "<a href='/jobs/1'>PhD in Gait analysis</a>")], "page_id long, url string, html string")


@pytest.mark.parametrize("letters", [(), ("é", "<aé href='x'>", " ", "\x85")])
def test_links_of_a_batch_are_those_of_the_expressions(spark, letters):
    given = made(spark, letters=letters)
    order = ["page_id", "page_url", "pos"]
    got = pages.anchors(given).orderBy(*order).collect()
    want = given.select("page_id", F.col("url").alias("page_url"), F.explode(pages.links_by_expressions(F.col("html"), F.col("url"))).alias("a")).select("page_id", "page_url", "a.*").drop("tested").orderBy(*order).collect()
    assert got == want and len(got) > 500 and len({r.url for r in got}) > 50


def test_wanted_links_of_a_batch_are_those_of_the_patterns(spark):
    given, t = made(spark, letters=("é",) * 2), F.col("text")
    links = pages.anchors(given).where("url <> ''")
    vacancies = links.where((F.length(t) >= 15) & (F.length(t) <= 240) & ~t.rlike(rule(fixed.BROWSE_TEXT)) & ~t.rlike(rule(fixed.STUDENT_SUPPORT)) & F.col("url").rlike(rule(fixed.DETAIL_LINK)) & t.rlike(rule(fixed.ROLE_TITLE)))
    got = {(r.page_id, r.url, r.is_phd) for r in pages.vacancy_links(given).collect()}
    assert {(p, u) for p, u, _ in got} <= {(r.page_id, r.url) for r in vacancies.collect()} and len(got) == vacancies.select("page_id", F.lower(F.rtrim("url", F.lit("/")))).distinct().count() > 5
    recovered = links.where((F.length(t) >= 20) & ~t.rlike(rule(fixed.NOISE_TEXT)) & (t.rlike(rule(fixed.DOCTORAL_TEXT)) | t.rlike(rule(fixed.JOB_TEXT))))
    assert {(r.page_id, r.url) for r in pages.recovered_links(given).collect()} == {(r.page_id, r.url) for r in recovered.collect()}
    careers = links.where(t.rlike(rule(fixed.CAREERS_TEXT)) & ~t.rlike(rule(fixed.NOT_CAREERS_TEXT)))
    assert {(r.page_id, r.url) for r in pages.careers_links(given, 99).collect()} == {(r.page_id, r.url) for r in careers.collect()}
