"""Operators over people, works and registries, on small cases."""


from postmill.operators import people, runs
from postmill.plans import registry
from postmill.sources import scans

SF = "/root/testdata/sf0.001"

YAML = """version: 2
defaults:
  is_board: true
sources:
- name: one
  label: 'It''s one: first'
  url: https://one.org/
  search_url: https://one.org/search?q=a: b
  tier: primary
  needs_browser: true
  notes: A long note that goes on
    over a second line: with a colon.
  is_board: true
  max_pages: 6
  stale_page_run: 4
- name: two
  label: "Two"
  url: https://two.org/
  country: ''
  needs_browser: false
  verify_tls: false
  is_board: false
  status: null
other:
- name: three
"""


def test_registry_from_yaml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    rows = {r.name: r for r in scans.scan_registry(spark, str(tmp_path / "s.yaml")).collect()}
    assert set(rows) == {"one", "two"}
    one, two = rows["one"], rows["two"]
    assert (one.label, one.search_url, one.max_pages, one.stale_page_run, one.needs_browser, one.is_board) == ("It's one: first", "https://one.org/search?q=a: b", 6, 4, True, True)
    assert one.notes == "A long note that goes on over a second line: with a colon."
    assert (two.label, two.country, two.verify_tls, two.status, two.search_url, two.max_pages) == ("Two", "", False, None, None, None)
    assert [r.name for r in scans.boards_of(scans.scan_registry(spark, str(tmp_path / "s.yaml"))).collect()] == ["one"]
    (tmp_path / "none.yaml").write_text("version: 1\n")
    assert scans.scan_registry(spark, str(tmp_path / "none.yaml")).count() == 0


def test_merged_summary_takes_what_saw_rows(spark):
    rows = [("r1", "a", 0, "http", "timed out", None), ("r2", "a", 3, "browser", "", "ok"), ("r3", "a", 5, "x", "late", "z"), ("r1", "b", 0, "http", "dns", None), ("r2", "b", 0, "y", "again", "s")]
    table = spark.createDataFrame(rows, "run string, source string, n long, method string, note string, status string")
    merged = spark.createDataFrame([("a",)] * 4, "source string")
    got = {r.source: (r.n, r.method, r.note, r.status, r.merged_from) for r in runs.merged_summary(table, merged).collect()}
    assert got == {"a": (4, "browser", "timed out", "ok", ["r2", "r3"]), "b": (0, "http", "dns", "", [])}


def test_cache_state_and_stats(spark):
    rows = [("a", 5, "", 1), ("a", 0, "down", 2), ("b", 0, "dns", 1), ("c", 0, "x", 1), ("c", 2, "", 2)]
    table = spark.createDataFrame(rows, "source string, n long, note string, at int")
    got = {r.source: (r.fetched_at, r["count"], r.last_error, r.last_error_at) for r in runs.cache_state(table).collect()}
    assert got == {"a": (1, 5, "down", 2), "b": (None, 0, "dns", None), "c": (2, 2, None, None)}
    assert runs.cache_stats(runs.cache_state(table)).head()[:] == (3, 2, ["b"], 7)
    assert runs.cache_stats(runs.cache_state(table.limit(0))).head()[:] == (0, 0, [], 0)


def test_first_match_of_an_overlap(spark):
    rows = spark.createDataFrame([(1, [5, 3]), (2, [9]), (3, None), (4, [3, 3, 7])], "k int, xs array<long>")
    wanted = spark.createDataFrame([(7, 0), (3, 1), (5, 2)], "value long, pos int")
    assert {r.k: r.first_match for r in people.overlapping(rows, "k", "xs", wanted).collect()} == {1: 3, 4: 7}


def test_top_n_is_cut_before_the_shuffle(spark):
    """A university's people meet after each task has kept its first thirty."""
    plan = registry.QUERIES["s25_discover_at"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_are_not_empty(spark):
    for name in ("j10_institutions_by_concept", "s25_discover_at", "s27_funded_positions", "s31_concept_positions", "g11_top_concept_groups", "g12_sub_institutions"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1, name


def test_groups_need_two(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "y"), (3, 2, "x")], "person int, institution int, concept string")
    assert {(r.institution, r.concept, r.person, r.members) for r in people.research_groups(rows).collect()} == {(1, "x", 1, 2), (1, "x", 2, 2)}
    counted = spark.createDataFrame([(1, c, n) for c, n in zip("abcd", (1, 5, 5, 2))], "person int, concept string, n long")
    assert sorted(r.concept for r in people.top_concepts(counted).collect()) == ["b", "c", "d"]
