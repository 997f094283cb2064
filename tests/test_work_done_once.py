"""What large tables need: costly work is done once, and little is written."""

import pytest
from pyspark.sql import functions as F
from test_literal_cases import brute_ratio
from test_publishing import GOOD, ROWS

from postmill.functions import dates
from postmill.operators import pages, publishing, scoring
from postmill.plans import positions, tables
from postmill.sources import postings


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_compressed_and_whole(spark, tmp_path):
    long = "word " * 200
    row = (*GOOD[:6], long, *GOOD[7:])
    publishing.publish(spark.createDataFrame([row], ROWS), f"file://{tmp_path}/site")
    files = [p.name for p in (tmp_path / "site").glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.json(f"file://{tmp_path}/site").head()
    assert back.description == long[:420] and back.evidence[1].value.startswith("1000 chars of description")


def test_pages_are_read_before_they_meet_their_postings(spark):
    rows = spark.createDataFrame([("u", "PhD", "", "")], "url string, title string, context string, country string")
    found = pages.enrich(rows, spark.createDataFrame([("u", "<h1>x</h1>")], "url string, html string"), F.lit("2026-06-01").cast("date"))
    above = optimized(found).split("Join LeftOuter")[0]
    assert "script|style" not in above and "og:site_name" not in above


def test_addresses_of_links_are_computed_once(spark):
    plan = optimized(pages.vacancy_links(spark.createDataFrame([(1, "https://x.org/", "<a href='/phd/1'>PhD</a>")], "page_id long, url string, html string")))
    assert plan.count("fbclid") == 1


def test_dates_need_no_pattern_compiled_for_each_row(spark):
    plan = optimized(spark.createDataFrame([("Deadline: 1 May 2027",)], "t string").select(dates.deadline(F.col("t"), F.lit("2026-06-01").cast("date"))))
    assert "split(" not in plan


DATES = (
    "5/6/1999", "05/06/99", "5-6-1999", "5-6-69", "5/6/68", "1999-6-5", "1999-06-31", "31/2/1999", "5 Jun 1999", "5 june  1999", " 5 May 1999 ", "5 Marc 1999", "5 mAY 20001", "+5/6/1999", "5/6/+20001", "5/6/-1999",
    "-1999-6-5", "0005/6/1999", "5/6/199", "5/6/19999", "1999-6-5 x", "٥/٦/١٩٩٩", "", None, "soon",
)


def test_a_format_is_tried_only_where_it_may_fit(spark):
    """A format that does not fit costs an exception a row."""
    rows = spark.createDataFrame([(x,) for x in DATES], "t string")
    one = F.regexp_replace(F.trim("t"), r"\s+", " ")
    late = lambda form, d: F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d) if form.endswith(("/yy", "-yy")) else d
    plain = F.coalesce(*(late(form, F.try_to_date(one, form)) for form in dates.DAY_FIRST))
    got = rows.select("t", dates.date_by_formats(F.col("t")).cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got] and sum(r.a is not None for r in got) >= 11
    plan = optimized(rows.select(dates.date_by_formats(F.col("t"))))
    assert plan.count("RLIKE") >= len(dates.DAY_FIRST)


def test_numbers_are_dealt_out_and_not_the_texts_made_of_them(spark):
    plan = optimized(postings.spread_postings(spark, "/root/testdata/sf0.001"))
    assert plan.index("Join") < plan.index("Repartition")


def test_a_bound_value_is_taken_without_deriving_its_type(spark):
    """``get`` of an array that an expression makes walks the expression for its type, a row at a time."""
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    bound = dates.bind(F.upper("t"), lambda x: F.struct(x.alias("x"), F.coalesce(x, F.lit("none")).alias("y")))
    assert [tuple(r[0]) for r in rows.select(bound).collect()] == [("A", "A"), (None, "none")]
    assert "array_max" in optimized(rows.select(bound))


def test_impossible_dates_are_null(spark):
    parts = [(2027, 2, 29), (2028, 2, 29), (2027, 4, 31), (2027, 13, 1), (2027, 0, 1), (2027, 1, 0), (2027, 12, 31), (None, 3, 1), (2027, None, 1), (2027, 3, None), (199, 6, 5)]
    rows = spark.createDataFrame(parts, "y int, m int, d int").select(dates.safe_date(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("v"))
    assert [r.v for r in rows.collect()] == [None, "2028-02-29", None, None, None, None, "2027-12-31", None, None, None, "0199-06-05"]
    assert "try_to_date" not in optimized(rows)


def test_later_gates_see_only_what_earlier_ones_let_pass(spark):
    rows = spark.createDataFrame(
        [(1, "s", "PhD in Gait", "Deadline: 1997-01-01"), (2, "s", "PhD in Gait", "Deadline: 1999-01-01"), (3, "s", "Lecturer in Gait", ""), (4, "s", "PhD in Polymer", ""), (5, "s", "Gait", "")],
        "seq int, source string, title string, context string",
    )
    found = lambda df: [(r.reason, r.fit) for r in df.orderBy("seq").collect()]
    assert found(tables.gated(rows)) == [("deadline", 0), ("ok", 71), ("role", 0), ("field", 0), ("not-doctoral", 0)]
    assert found(tables.gated(rows, rate_expired=True))[0] == ("deadline", 71)


KEYWORDS = (
    "Motor-Control", "control of motor learning", "gait", "gaits", "gait analysis in water", "tiag", "polymer", "", " ", "neural coding", "neural  decoding", "human gait", "motor", "sensorimotor control", "gait \U0001f6b6 analysis",
    "\U0001f6b6 gait", "\u00e9tude du gait", "coding\tneural neural", "contorl motor",
)
CONCEPTS = ("motor control", "gait analysis", "neural coding", "\U0001f6b6 gait", "contoll motrr")


def test_pairs_that_cannot_be_alike_do_not_reach_python(spark):
    people = spark.createDataFrame([(i, [k, None]) for i, k in enumerate(KEYWORDS)] + [(99, list(KEYWORDS)), (100, []), (101, None)], "pi_id long, keywords array<string>")
    norm = lambda x: x.lower().strip().replace("-", " ")
    for least in (75.0, 40.0, 0.0):
        found = scoring.best_concept_match(people, CONCEPTS, least)
        got = {(r.pi_id, r.concept): (r.keyword, r.similarity) for r in found.collect()}
        wanted = {}
        for i, names in [*((i, [k]) for i, k in enumerate(KEYWORDS)), (99, KEYWORDS)]:
            for c in CONCEPTS:
                best = max(brute_ratio(c, norm(k)) for k in names)
                if best >= least:
                    wanted[i, c] = next(k for k in names if brute_ratio(c, norm(k)) == best), pytest.approx(best, abs=1e-3)
        assert got == wanted
    plan = optimized(found)
    assert plan.count("ArrowEvalPython") == 1 and plan.count("split(") == 1 and "translate(" in plan.split("ArrowEvalPython")[1]


def test_similarity_of_the_most_shared_letters_is_no_less(spark):
    rows = spark.createDataFrame([(a, b) for a in (*KEYWORDS, None) for b in (*KEYWORDS, None)], "a string, b string")
    t = scoring.set_parts(scoring.word_set(F.col("a")), scoring.word_set(F.col("b")))
    got = rows.select(scoring.parts_ratio(t, scoring.most_shared(t["only_a"], t["only_b"])).alias("most"), scoring.token_set_ratio(F.col("a"), F.col("b")).alias("ratio")).collect()
    assert all(r.most >= r.ratio for r in got) and sum(r.most < 75 for r in got) > len(got) / 2


def test_parts_in_one_file_are_dealt_out(spark):
    assert "RepartitionByExpression [p_partkey" in optimized(positions.fit_bands(spark, "/root/testdata/sf0.001"))
