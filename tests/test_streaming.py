"""ST1-ST3: the stream jobs run to completion with availableNow."""

from pyspark.sql import functions as F

from pressgrid.streaming import jobs


def test_stream_intake_dedupes_by_content(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    (d / "a.txt").write_text("https://a.com/1")
    (d / "b.txt").write_text("https://a.com/1")
    (d / "c.csv").write_text("x,https://c.com/2\n")
    out = jobs.run_to_table(jobs.stream_intake(spark, str(d)), "t-intake")
    assert spark.read.parquet(out).count() == 2


def test_stream_pages_through_pipeline(spark, tmp_path):
    src = tmp_path / "urls"
    spark.createDataFrame([(1, "https://p.com/a"), (2, "https://blocked.com/2025/05/01/some-news-story"),
                           (3, "nope"), (4, "https://missing.com/x")], "pos long, url string") \
        .write.parquet(str(src))
    pages = spark.createDataFrame([(1, "https://p.com/a", "<html><body><h1>Head line</h1><p>x</p></body></html>")],
                                  "page_id long, url string, html string")
    blocked = spark.createDataFrame([("https://blocked.com/",)], "url string")
    stream = spark.readStream.schema("pos long, url string").parquet(str(src))
    out = jobs.run_to_table(stream, "t-pages", batch_fn=jobs.stream_pages(pages, blocked))
    got = {r.pos: (r.status, r.title) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("success", "Head line"), 2: ("success_url_parser", "Some News Story"),
                   3: ("error_invalid_url", ""), 4: ("error_scraping", "")}


def test_stream_progress_counts(spark, tmp_path):
    src = tmp_path / "res"
    spark.createDataFrame([("success",), ("success",), ("error_scraping",)], "status string").write.parquet(str(src))
    stream = spark.readStream.schema("status string").parquet(str(src))
    out = jobs.run_to_table(jobs.stream_progress(stream), "t-progress", "complete")
    assert {r.status: r.n for r in spark.read.parquet(out).collect()} == {"success": 2, "error_scraping": 1}


def test_restart_adds_to_the_same_table(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(str(src))
    stream = spark.readStream.schema("k long, v string").parquet(str(src))
    out = jobs.run_to_table(stream, "t-restart", checkpoint=state)
    spark.createDataFrame([(2, "b")], "k long, v string").write.mode("append").parquet(str(src))
    again = jobs.run_to_table(stream, "t-restart", checkpoint=state)
    assert out == again and sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]
    jobs.run_to_table(stream, "t-restart", checkpoint=state)
    assert spark.read.parquet(out).count() == 2
