import json

from pyspark.sql import functions as F

from postmill.operators import dedupe
from postmill.sources import scans, sinks
from postmill.streaming import jobs


def test_scan_postings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "PhD in Gait", "url": "https://a/1", "organization": "U"}, {"title": "no url"}]))
    (tmp_path / "b.json").write_text(json.dumps({"positions": [{"title": "PhD in X", "url": "https://a/2", "context": "c", "extra": 1}], "per_source": {"s": {"n": 3, "note": "ok"}}}))
    got = scans.scan_postings(spark, [(f"{tmp_path}/a.json", "one", "One"), (f"{tmp_path}/b.json", "two", "Two")]).orderBy("url").collect()
    assert [(r.url, r.origin, r.source_label, r.university, r.input_rank) for r in got] == [("https://a/1", "one", "One", "U", 0), ("https://a/2", "two", "Two", None, 1)]
    rows, runs = scans.scan_run(spark, f"{tmp_path}/b.json")
    assert rows.count() == 1 and runs.head().n == 3


def test_registries(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿university,country,homepage,openalex_papers\n A ,X,https://a.org/,12\nB,Y,ftp://b,3\nC,X,https://c.org,oops\n", encoding="utf-8")
    got = scans.scan_institutions(spark, f"{tmp_path}/u.csv").orderBy("university").collect()
    assert [(r.university, r.openalex_papers) for r in got] == [("A", 12), ("C", 0)]
    (tmp_path / "r.json").write_text(json.dumps({"https://a.org": {"board_url": "https://a.org/jobs", "stage": "link"}}))
    assert scans.scan_board_registry(spark, f"{tmp_path}/r.json").head().board_url == "https://a.org/jobs"
    boards = spark.createDataFrame([("https://a.org", "A", "u", 1), ("https://b.org", "B", "u", 2)], "homepage string, university string, board_url string, seq long")
    size = spark.createDataFrame([("https://b.org", 9)], "homepage string, papers int")
    row = scans.boards_by_size(boards, size).head()
    assert (row.university, row.shared, row.papers) == ("A", ["A", "B"], 9)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("pd-001", "t", "u", "", "https://x", 80, "HIGH", "open", "2030-01-01", "c", "msca", "L", "browser")], "id string, title string, university string, country string, url string, fit int, tier string, deadline_status string, deadline_date string, context string, source string, source_label string, origin string")
    site = sinks.site_payload(rows).head()
    assert site.country == "N/A" and site.evidence[0].source_type == "official" and site.evidence[0].confidence == 0.9
    sinks.write_csv(rows, f"{tmp_path}/csv", 70)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 1
    assert json.loads(sinks.envelope(rows, 70, "now").head().json)["count"] == 1
    assert set(sinks.export_all(rows, f"{tmp_path}/all")) == {"csv", "json", "parquet"}
    sinks.append_log(rows, f"{tmp_path}/log")
    sinks.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_merges_on_empty_tables(spark):
    empty = spark.createDataFrame([], "seq long, url string, context string")
    assert dedupe.longest_context(empty).count() == 0
    assert dedupe.first_wins(empty, F.col("url")).count() == 0


def _stream(spark, df, path):
    df.write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([("https://a/1?x",), ("https://a/1",), ("https://a/2",)], "url string").withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    _run(jobs.dedupe_stream(_stream(spark, rows, tmp_path / "in")), "deduped")
    assert spark.table("deduped").count() == 2


def test_stream_stale_stop(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, 20, 0 if i <= 2 else 20) for i in range(1, 11)], "source string, page_no int, total int, expired int").coalesce(1)
    _run(jobs.stale_stop(_stream(spark, rows, tmp_path / "in")), "stops")
    assert spark.table("stops").where("stop").agg(F.min("page_no")).head()[0] == 6


def test_stream_log_health(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"2024-01-0{d} 01:00:00", d % 2 == 0) for d in range(1, 8)], "source string, t string, success boolean").select("source", F.col("t").cast("timestamp").alias("started_at"), "success")
    _run(jobs.log_health(_stream(spark, rows, tmp_path / "in")), "health", "complete")
    assert spark.table("health").agg(F.sum("n"), F.sum("ok")).head()[:] == (7, 3)


def test_cache_generations(spark, tmp_path):
    merge = jobs.keep_last_good(str(tmp_path / "cache"))
    schema = "source string, url string"
    merge(spark.createDataFrame([("a", "1"), ("b", "2")], schema), 0)
    merge(spark.createDataFrame([("a", "3")], schema), 1)
    got = {(r.source, r.url) for r in spark.read.parquet(f"{tmp_path}/cache/1").collect()}
    assert got == {("a", "3"), ("b", "2")}


def test_stream_stale_stop_waits_for_pages(spark, tmp_path):
    """Pages arrive backwards, a batch for each file."""
    for i in range(10, 0, -1):
        spark.createDataFrame([("s", i, 20, 0 if i <= 2 else 20), ("t", i, 20, 0)], "source string, page_no int, total int, expired int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, page_no int, total int, expired int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.source, r.page_no): r.stop for r in jobs.drained(jobs.stale_stop(stream)).collect()}
    assert len(got) == 20 and {k for k, stop in got.items() if stop} == {("s", i) for i in range(6, 11)}


def test_stream_last_good_in_any_order(spark):
    rows = [("a", 1, 5, ""), ("a", 3, 0, "down"), ("a", 2, 7, ""), ("b", 4, 0, "dns"), ("b", 2, 0, "old"), ("c", 1, 0, "x"), ("c", 2, 9, "")]
    runs = spark.createDataFrame(rows, "source string, day int, n long, note string").withColumn("started_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)")).drop("day")
    for order in ("started_at", "note"):
        got = {r.source: (r.fetched_at and r.fetched_at.day, r.n, r.last_error, r.last_error_at and r.last_error_at.day) for r in jobs.drained(jobs.last_good(jobs.arriving(runs, order, files=4, a_batch=1)), keys=("source",)).collect()}
        assert got == {"a": (3, 7, "down", 4), "b": (None, 0, "dns", 5), "c": (3, 9, None, None)}


def test_stream_drops_late_copies_only_within_the_watermark(spark):
    rows = [("https://a/1", 0), ("https://a/1?x", 1), ("https://a/2", 200), ("https://a/1", 201)]
    df = spark.createDataFrame(rows, "url string, hour int").withColumn("event_time", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, hour)"))
    kept = jobs.drained(jobs.dedupe_stream(jobs.arriving(df, "hour", files=4, a_batch=1).drop("hour")))
    assert 2 <= kept.count() <= 3 and kept.where("key = 'https://a/2'").count() == 1


def test_streams_of_empty_tables(spark):
    empty = spark.createDataFrame([], "source string, started_at timestamp, n long, note string")
    assert jobs.drained(jobs.last_good(jobs.arriving(empty, "started_at")), keys=("source",)).count() == 0


def test_retained(spark):
    logs = spark.createDataFrame([("2024-01-01",), ("2024-01-31",)], "started_at string")
    assert jobs.retained(logs, F.lit("2024-02-01").cast("date"), 30).count() == 1


def test_stop_after(spark):
    from postmill.operators import health

    runs = {"a": "eeexeeee", "b": "eee", "c": "eeeeeeee", "d": "xxxx"}
    rows = [(s, i + 1, c == "e") for s, text in runs.items() for i, c in enumerate(text)]
    got = {r.source: r.stop_after for r in health.stop_after(spark.createDataFrame(rows, "source string, page_no int, all_expired boolean"), 4).collect()}
    assert got == {"a": 8, "c": 4}
