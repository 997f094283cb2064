"""Literal cases of gates, boards, pagers and people fits.

Fixed values: the inputs and what must come of them.
"""


import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, fixed, gates, titles
from postmill.operators import evidence, pages, people, scoring
from postmill.operators.health import classify_probe
from postmill.sources import scans


def check(spark, cases, make):
    """All (input, expected) cases of one column function in one job."""
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", make(F.col("x")).alias("y")).collect()}
    assert {c[0]: got[i] for i, c in enumerate(cases)} == {c[0]: c[1] for c in cases}


def test_transient_failures(spark):
    check(spark, [
        ("ConnectError: [Errno 11001] getaddrinfo failed", False), ("net::ERR_CERT_COMMON_NAME_INVALID", False), ("Page.goto: Timeout 60000ms exceeded.", True),
        ("net::ERR_TIMED_OUT at https://x", True), ("HTTP 403 (secure)", False), ("ReadError: ", True), ("SSL: SSLV3_ALERT_HANDSHAKE_FAILURE", True), ("HTTP 200 0 postings", False), ("", False), (None, False),
    ], gates.is_transient)


def test_failure_orders(spark):
    check(spark, [("429 timeout", "timeout"), ("Schema differs", "api_changed"), ("a spa", "js_required"), ("unreachable", "network_error"), ("", "unknown")], gates.failure_kind)
    check(spark, [("connection: api changed", "api_changed"), ("dynamic page", "unknown")], lambda m: gates.failure_kind(m, fixed.AGENT_FAILURES))
    check(spark, [("connection: api changed", "network_error"), ("a spa", "unknown")], lambda m: gates.failure_kind(m, fixed.CRAWLER_FAILURES))


def test_boards(spark):
    boards = [
        "https://jobs.ethz.ch/", "https://phd.ku.dk/", "https://careers.utoronto.ca/", "https://jobs.unibe.ch/", "https://www.lmu.de/de/die-lmu/arbeiten-an-der-lmu/stellenportal",
        "https://www.kth.se/om/jobba-pa-kth", "https://www.univie.ac.at/karriere", "https://www.lu.se/vacancies", "https://www.helsinki.fi/phd", "https://tudelft.nl/onderwijs/opleidingen/phd",
        "https://www.uni-freiburg.de/en/jobs", "https://www.uzh.ch/careers",
    ]
    others = [
        "https://uamd.edu.al/misioni-dhe-vizioni", "https://www.uda.ad/recerca/escola-internacional", "https://www.uu.nl/en/organisation/about", "https://example.edu/privacy-policy", "https://example.edu/media/brochure.pdf",
    ]
    check(spark, [(u, True) for u in boards] + [(u, False) for u in others], lambda u: gates.looks_like_board(u, F.lit("")))


def test_board_chrome(spark):
    chrome = [
        "home", "Home", "Return", "Back", "Menu", "Search", "Careers", "Find out more:", "Read more", "More information", "Show more", "View all", "See all", "Apply now", "Next", "Previous", "Page 2",
        "Skip to main content", "Main navigation", "Privacy policy", "Cookie settings", "Imprint", "(untitled)", "untitled", "", "   ", "!!!", "2026",
    ]
    named = [
        "Postdoctoral Fellow in Gait Biomechanics", "PhD Researcher", "Doctoral Candidate, Biomechanics of Human Movement", "Postdoc: Neural Control of Locomotion", "Home Economics PhD position", "Careers in Research",
        "Careers and Employability PhD Programme", "Next-generation joint replacement PhD", "Page and Locomotion Studies PhD",
    ]
    check(spark, [(t, True) for t in chrome] + [(t, False) for t in named], gates.is_chrome)


def test_generic_titles(spark):
    generic = ["PhD", "#PhD", "PhD 2026", "PhD (2 positions)", "Doctoral", "PhD Researcher", "PhD Student", "PhD Student, in the area", "PhD Candidates \u2014 open call"]
    named = [
        "PhD defence of György Bodon", "PhD Defense of Jane Roe", "University Doctoral Regulations 2026", "President's Vlog: Part-Time Doctoral Studies", "DBA vs. PhD: What's the Difference?", "Compare doctoral programmes",
        "PhD Alumni Network", "Doctoral Annual Report 2025", "How to apply for a PhD", "Doctoral programme in Neuroscience", "PhD in biomechanics and gait analysis", "PhD Student Position in Motor Control", "PhD candidate in neuroscience",
        "PhD Researcher - PDTx", "PhD Program Admissions", "Doctoral Colloquium in Accounting Research", "Postdoc in Clinical Movement Analysis", "PhD position in sensorimotor control and gait biomechanics",
        "Doctoral Researcher - Machine Learning for Human Movement",
    ]
    check(spark, [(t, True) for t in generic] + [(t, False) for t in named], gates.is_generic)


def test_pagers(spark):
    cases = [
        ('<a href="?page=2">Next</a>', "https://x.com/jobs", "https://x.com/jobs?page=2"), ('<a href="/page/2/">2</a>', "https://x.com/jobs", "https://x.com/page/2/"), ('<a href="?offset=20">Next</a>', "https://x.com/jobs", "https://x.com/jobs?offset=20"),
        ('<a href="/job/job/index?page=2">More Feature</a>', "https://x.com/jobs", "https://x.com/job/job/index?page=2"), ('<a href="/jobs">Next &raquo;</a>', "https://x.com/", "https://x.com/jobs"),
        ('<a href="?page=2">Mehr</a>', "https://x.de/jobs", "https://x.de/jobs?page=2"), ('<a href="https://x.com/jobs?page=2">Next</a>', "https://x.com/jobs", "https://x.com/jobs?page=2"),
        ('<a href="/jobs/1">PhD in Biomechanics</a><a href="/about">About</a>', "https://x.com/jobs", None), ('<a href="https://x.com/jobs">Next</a>', "https://x.com/jobs", None), ('<a href="?page=">Next</a>', "https://x.com/jobs", None),
        ('<a href="?page=2">Next</a>', "https://x.com/jobs?page=3", None), ('<a href="?page=4">Next</a>', "https://x.com/jobs?page=4", None), ('<a href="?page=5">Next</a>', "https://x.com/jobs?page=4", "https://x.com/jobs?page=5"),
        ('<a href="/search/?sortOrder=1&pageSize=25">Next</a>', "https://x.com/jobs/phd?page=1", None), ('<a href="/jobs/page/3/">Next</a>', "https://x.com/jobs/page/2/", "https://x.com/jobs/page/3/"),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (h, u, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.next_url for r in pages.next_page(pages.anchors(df)).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[2] for c in cases]


def test_sources_and_probes(spark):
    check(spark, [
        ("https://euraxess.ec.europa.eu/x", "EURAXESS"), ("https://www.phdportal.com/", "AGGREGATOR"), ("https://x.edu/people/a", "OFFICIAL_UNIVERSITY"), ("https://x.ac.uk/phd", "OFFICIAL_DOCTORAL_SCHOOL"), ("https://x.ac.uk/", "UNIVERSITY_DIRECTORY"),
        ("https://orcid.org/1", "ORCID"), ("https://a.org", "SEARCH_SNIPPET"), (None, "SEARCH_SNIPPET"),
    ], gates.source_type)
    rows = spark.createDataFrame([(200, 10, 5, ""), (200, 60_000, 0, ""), (200, 10, 0, ""), (403, 0, 0, ""), (502, 0, 0, ""), (404, 0, 0, ""), (None, None, None, "cannot resolve"), (None, None, None, None)], "s int, b int, l int, e string")
    got = [r.v for r in rows.select(classify_probe(F.col("s"), F.col("b"), F.col("l"), F.col("e"))["verdict"].alias("v")).collect()]
    assert got == ["crawlable", "crawlable_spa", "thin", "cloudflare_403", "server_error", "redirect_or_error", "dns_blocked", "failed"]


def brute_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if not x or not y:
        return 0.0
    if both and (not left or not right):
        return 100.0

    def common(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            new = [0]
            for j, e in enumerate(t):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def ratio(s, t):
        return 200.0 * common(s, t) / max(len(s) + len(t), 1)

    whole = [(both + " " + r).strip() for r in (left, right)]
    # what both start with stays together
    edits = len(left) + len(right) - 2 * common(left, right)
    best = 100 * (1 - edits / max(len(whole[0]) + len(whole[1]), 1))
    return round(max(best, *(ratio(both, w) for w in whole) if both else (0,)), 4)


def test_token_set_ratio_against_brute_force(spark):
    names = ["motor control", "control of motor learning", "gait", "gait analysis in water", "polymer", "", "neural coding", "neural decoding", "human gait", "motor", "sensorimotor control"]
    pairs = [(a, b) for a in names for b in names]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.x for r in df.select(scoring.token_set_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([brute_ratio(a, b) for a, b in pairs], abs=1e-3)


def test_research_fit(spark):
    df = spark.createDataFrame([(1, ["Motor-Control", "gait"], "EMG study. emg and EMG of stroke patients"), (2, [], ""), (3, ["polymers"], None)], "pi_id long, keywords array<string>, text string")
    profile = {"core_topics": ["motor control"], "adjacent_topics": ["gait analysis"], "methods": ["emg"], "technical_methods": ["mocap"], "data_modalities": ["study"], "populations": ["stroke"]}
    got = {r.pi_id: r for r in scoring.research_fit(df, profile).collect()}
    assert (got[1].topics, got[1].methods, got[1].data_modalities, got[1].populations, got[1].technical_methods) == (50.0, 6.0, 2.0, 2.0, 0.0)
    assert got[1].overall == 60.0 and got[1].band == "REJECT" and got[2].overall == 0.0 and got[3].overall == 0.0
    assert [r.pi_id for r in scoring.fitting_people(scoring.research_fit(df, profile), 50).collect()] == [1]
    assert scoring.band_counts(scoring.research_fit(df, profile)).head().asDict() == {"total": 3, "exceptional": 0, "strong": 0, "good": 0, "reject": 3}


def test_dates_and_countries(spark):
    as_text = lambda c: dates.stated_deadline(c).cast("string")
    check(spark, [("Deadline: 3/4/2026", "2026-04-03"), ("due 1-2-99", "1999-02-01"), ("apply by: 31/31/2026 or 4 May 2026", "2026-05-04"), ("2026-7-8", "2026-07-08"), ("12 September 2026", "2026-09-12"), ("", None)], as_text)
    check(spark, [("University of Toronto", "CA"), ("Victoria Wellington", "CA"), ("Oulu", "FI"), ("Nowhere", "UNKNOWN"), (None, "UNKNOWN")], titles.university_country)
    check(spark, [("Cape Town, South Africa", "CA"), ("Berlin, Deutschland", "DE"), ("Oslo", "UNKNOWN"), ("", "UNKNOWN")], titles.country_code)
    check(spark, [("TU Munich", "tum.de"), ("The Open University of Nowhere", "openuniversity.edu"), ("UBC", "ubc.ca")], titles.likely_domain)


def test_verification(spark):
    df = spark.createDataFrame([("https://x.edu/staff/1", "We are open. Deadline: 1/2/2027; stipend"), ("https://a.org", "position filled"), ("https://orcid.org/1", "Apply now"), ("https://a.org", None)], "source_url string, text string")
    got = [(r.position_status, r.verification_level, r.funding_confirmed, [e.claim for e in r.evidence]) for r in evidence.verify_positions(df).collect()]
    assert got == [("ACTIVE", "STRONG", True, ["position_status_active", "application_deadline", "funding_confirmed"]), ("CLOSED", "NONE", False, ["position_status_closed"]), ("ACTIVE", "MEDIUM", False, ["position_status_active"]), ("UNKNOWN", "NONE", False, [])]


def test_enrichment(spark):
    prose = "Careful work on gait at Aalborg, fully funded. Deadline: 2027-01-02. " * 5
    html = f'<meta property="og:site_name" content="Uni X"><h1>PhD in Gait</h1><div><p>{prose}</p></div>'
    rows = spark.createDataFrame([("https://a.org/1", "PhD", "", ""), ("https://a.org/2", "PhD", "ctx", "Norway")], "url string, title string, context string, country string")
    found = {r.url: r for r in pages.enrich(rows, spark.createDataFrame([("https://a.org/1", html)], "url string, html string"), F.lit("2026-06-01").cast("date")).collect()}
    one, two = found["https://a.org/1"], found["https://a.org/2"]
    assert one.enriched and one.country == "Denmark" and one.has_funding_evidence and one.org_hint == "Uni X" and one.page_heading == "PhD in Gait" and str(one.page_deadline_date) == "2027-01-02" and one.page_deadline_status == "open"
    assert not two.enriched and two.country == "Norway" and not two.has_funding_evidence and two.page_deadline_status == "unknown"


def test_search_hits_grants_and_targets(spark):
    hits = spark.createDataFrame([("https://x.com/a", "t", "s", "u"), ("https://u.edu/a", "PhD", "stipend: 20k. due 1/2/2027", "Delft")], "url string, title string, snippet string, university string")
    row = people.positions_from_hits(hits).collect()
    assert len(row) == 1 and row[0].country == "NL" and str(row[0].application_deadline) == "2027-02-01" and row[0].funding_info.startswith("stipend")
    funded = spark.createDataFrame([(1, i, "F", f"A{i % 12}", "t") for i in range(30)], "person long, seq long, funder string, award string, title string")
    assert [r.award for r in people.grants(funded).orderBy("rank").collect()] == [f"A{i}" for i in range(10)]
    u = spark.createDataFrame([(1, "Norway", "NO", "https://a.org/", 5), (2, "Norway", "NO", "https://b.org", 9), (3, "Spain", "ES", "https://c.org", 7)], "seq long, country string, country_code string, homepage string, openalex_papers int")
    known = spark.createDataFrame([("https://b.org/",)], "homepage string")
    assert [r.seq for r in scans.select_targets(u, known, "no", 5).collect()] == [2, 1]
    assert [r.seq for r in scans.select_targets(u, known, "no", only_missing=True).collect()] == [1]


def test_institution_pages(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text('{"country": "NO", "results": [{"id": "I1", "display_name": " Oslo ", "homepage_url": "https://uio.no", "works_count": 5}, {"id": "I2", "display_name": "Bergen"}]}\n{"results": []}\n')
    rows = scans.institution_pages(spark, str(tmp_path / "pages.jsonl"))
    assert [(r.country, r.institution_id, r.name, r.papers) for r in rows.collect()] == [("NO", "I1", "Oslo", 5), ("NO", "I2", "Bergen", 0)]
    assert scans.institutions_per_country(rows).head().asDict() == {"country": "NO", "institutions": 2, "papers": 5}
