"""Links with their enclosing cards, against a tree; harvests of literal pages."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postmill.operators import cards, pages, people

TODAY = "2026-06-01"


class Tree(HTMLParser):
    """A page as a tree that is asked upwards, one link at a time."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = self.now = {"name": "", "kids": [], "above": None, "given": {}}
        self.links = []
        self.feed(text)
        self.close()

    def handle_starttag(self, name, given):
        node = {"name": name, "kids": [], "above": self.now, "given": dict(given)}
        self.now["kids"].append(node)
        if name == "a" and "href" in node["given"]:
            self.links.append(node)
        if name not in cards.VOID:
            self.now = node

    def handle_endtag(self, name):
        node = self.now
        while node is not None and node["name"] != name:
            node = node["above"]
        if node is not None:
            self.now = node["above"]

    def handle_data(self, text):
        self.now["kids"].append(text)


def text(node):
    out = []
    for kid in node["kids"]:
        if isinstance(kid, str):
            out += [" ".join(kid.split())] * bool(kid.strip())
        elif kid["name"] not in ("script", "style"):
            out += [text(kid)] * bool(text(kid))
    return " ".join(out)


def first_heading(node):
    for kid in node["kids"]:
        if not isinstance(kid, str):
            if kid["name"] in cards.HEADINGS:
                return text(kid)
            if (found := first_heading(kid)) is not None:
                return found
    return None


def brute(page):
    out = []
    for a in Tree(page).links:
        card = a["above"]
        while card is not None and card["name"] not in cards.CARDS:
            card = card["above"]
        out.append((a["given"]["href"], text(a), first_heading(card) if card else None, text(card)[:700] if card else None))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_cards_like_a_tree(seed):
    rng = random.Random(seed)
    names = ["ul", "li", "div", "td", "tr", "span", "h2", "article", "b"]

    def make(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.3 or depth > 5:
                out.append(rng.choice(["words ", "more &amp; more", " ", "x", "<br>", "<!-- <li> -->", "<script>'<li>'</script>", "<img src=a>"]))
            elif kind < 0.55:
                out.append(f'<a class="q" href="/p/{rng.randrange(99)}">link {rng.randrange(99)}</a>')
            else:
                name = rng.choice(names)
                out.append(f"<{name}>{make(depth + 1)}" + (f"</{name}>" if rng.random() < 0.8 else ""))
        return "".join(out)

    page = make(0)
    assert [link[:4] for link in cards.links_of(page)] == brute(page)


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 20_000 + "".join(f'<a href="/{i}">t</a>' for i in range(2000)) + "</div>" * 20_000
    assert len(cards.links_of(deep)) == 2000
    nested = "".join(f'<div class="row"><h3>A heading number {i}</h3><a href="/{i}">x</a>' for i in range(5000))
    found = cards.links_of(nested)
    assert len(found) == 5000 and all(len(f[3]) <= 700 for f in found) and found[7][2] == "A heading number 7"
    assert cards.links_of("") == [] and cards.links_of("<a href=''>") == [("", "", None, None, None, None)]


LISTING = """
<h1>Jobs</h1><div class="list">
<ul><li class="posting"><h3>PhD position in gait research</h3><ul><li><a href="/job/1">Read more</a> at a university institute</li></ul></li>
<li><h3>Doctoral student in motor control</h3> neuroscience lab. Deadline 2030-01-05. <a href="/job/2?utm=1">Read More</a></li>
<li>The university research institute <a href="/about">181 New Jobs Posted Today.</a></li></ul>
<div class="result"><span>Postdoctoral fellow in wearables</span><div>Some university, research institute</div><div><a href="jobdetail-4427"></a> phd research</div></div>
<article>research university <a href="https://x.org/position/phd-in-human-movement">Queens</a></article>
<table><tr class="entry"><td>Studentship in rehabilitation</td><td><a href="/vacancy/9#main">Skip</a> phd research</td></tr></table>
<li>Doctoral student in motor control, neuroscience <a href="/job/2/">again</a> open until filled</li>
</div>"""


def test_harvest_reads_cards(spark):
    df = spark.createDataFrame([(1, "https://x.org/jobs?page=2", LISTING)], "page_id long, url string, html string")
    got = [(r.url, r.title, r.deadline_status) for r in pages.harvest(df, F.lit(TODAY).cast("date")).orderBy("n").collect()]
    assert got == [
        ("https://x.org/job/1", "PhD position in gait research", "unknown"),
        ("https://x.org/job/2?utm=1", "Doctoral student in motor control", "open"),
        ("https://x.org/jobdetail-4427", "Postdoctoral fellow in wearables", "unknown"),
        ("https://x.org/position/phd-in-human-movement", "Phd in human movement", "unknown"),
    ]
    assert pages.harvest(df, F.lit(TODAY).cast("date"), limit=1).count() == 1


def page(spark, *links, url="https://u.org/"):
    html = "".join(f'<a href="{h}">{t}</a>' for h, t in links)
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_vacancy_links(spark):
    df = page(
        spark, ("/jobs/12", "PhD position in biology"), ("/jobs/12/#top", "PhD position in biology"), ("/vacancy/3", "Lecturer in the law of trade"), ("/jobs/all", "View all PhD vacancies"), ("/jobs/4", "PhD short"), ("/about/5", "PhD position in physics"),
        ("/jobs/6", "Student services and PhD support"), ("/jobs/7", "x" * 230 + " PhD position"), ("/Jobs/12", "PhD position in biology, once more"),
    )
    got = sorted((r.url, r.is_phd) for r in pages.vacancy_links(df).collect())
    assert got == [("https://u.org/jobs/12", True), ("https://u.org/vacancy/3", False)]


def test_recovered_links(spark):
    df = page(spark, ("/a", "A PhD position in biology"), ("/a", "A second PhD position in biology"), ("/b", "Research associate, physics"), ("/c", "PhD too short"), ("/d", "Subscribe to new PhD positions"), ("/e", "Nothing to see here at all"), ("/f", "Open position " + "y" * 300))
    got = [(r.n, r.url, len(r.title)) for r in pages.recovered_links(df).orderBy("n").collect()]
    assert got == [(1, "https://u.org/a", 25), (2, "https://u.org/b", 27), (3, "https://u.org/f", 200)]
    assert pages.recovered_links(df, most=2).count() == 2


def test_result_links(spark):
    df = page(spark, ("https://duck.example/l/?uddg=https%3A%2F%2Fwww.uni.org%2Fjobs%2F1", "One"), ("https://uni.org/jobs/2", "Two"), ("https://uni.org/jobs/2", "Two again"), ("https://jobs.uni.org/3", "Three"), ("https://other.org/4", "Four"), ("https://notuni.org/5", "Five"))
    got = [(r.url, r.title) for r in pages.result_links(df, F.lit("www.uni.org")).orderBy("pos").collect()]
    assert got == [("https://www.uni.org/jobs/1", "One"), ("https://uni.org/jobs/2", "Two"), ("https://jobs.uni.org/3", "Three")]


def test_careers_links(spark):
    df = page(spark, ("/1", "Careers"), ("/2", "Student careers"), ("/3", "Work with us"), ("/4", "Stellenangebote"), ("/1", "Jobs"), ("/5", "Vacancies"), ("/6", "Recruitment"), ("/7", "Openings"), ("/8", "Home"))
    assert [r.url[-1] for r in pages.careers_links(df).orderBy("n").collect()] == ["1", "3", "4", "5", "6"]


def test_verified_boards_and_best_pages(spark):
    html = [LISTING, "<p>We have an open PhD position and vacancies for doctoral students.</p>", "<p>Welcome</p>", None]
    df = spark.createDataFrame([(i, f"https://x{i}.org/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: (r.postings, r.verified) for r in pages.verified_boards(df, F.lit(TODAY).cast("date")).collect()}
    assert got[0] == (4, True) and got[2] == (0, False) and not got[3][1]
    counted = spark.createDataFrame([("a", 1, 2), ("a", 2, 5), ("a", 3, 5), ("b", 4, 1), ("c", 5, 0)], "university string, page_id long, vacancies long")
    assert {r.university: (r.page_id, r.status, r.total) for r in people.best_page(counted).collect()} == {"a": (2, "JOB_LIST", 12), "b": (4, "LANDING", 1), "c": (5, "NONE", 0)}
