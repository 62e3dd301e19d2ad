"""A third of all rows on one key: results stay whole and the heavy work runs
once per distinct key."""

from pyspark.sql import functions as F

from pressgrid.operators.ordering import running_totals
from pressgrid.operators.urls import cap_batch, discover_url_column
from pressgrid.plans import pipeline


def test_hot_url_through_pipeline(spark):
    hot = "https://p.com/hot"
    rows = [(i, hot if i % 3 == 0 else f"https://p.com/{i % 40}") for i in range(3000)]
    urls = spark.createDataFrame(rows, "pos long, url string")
    pages = spark.createDataFrame([(i, f"https://p.com/{i}", f"<body><h1>Story {i}</h1></body>") for i in range(40)]
                                  + [(99, hot, "<body><h1>Hot story</h1></body>")],
                                  "page_id long, url string, html string")
    blocked = spark.createDataFrame([], "url string")
    extracted = []

    def counting_extractor(df):
        extracted.append(df)
        return pipeline.page_metadata(df)

    out = pipeline.process_urls(urls, pages, blocked, extractor=counting_extractor, hot_url_rows=500,
                                salt_buckets=8)
    got = out.groupBy("title").count().collect()
    counts = {r.title: r["count"] for r in got}
    assert sum(counts.values()) == 3000 and counts["Hot story"] == 1000
    # The extractor saw each distinct URL once, however often it was listed.
    assert extracted[0].count() == 41
    # The hot URL was joined back salted: its rows spread over the buckets.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    plain = pipeline.process_urls(urls, pages, blocked)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_hot_batch_and_file(spark):
    df = spark.createDataFrame([(-1 if i % 3 else i, f"https://a.com/{i}") for i in range(900)], "b long, url string")
    capped = cap_batch(df, "b", 20)
    assert capped.where("refused").count() == 600 and capped.count() == 900
    files = spark.createDataFrame([(-1 if i % 3 else i, "x", f"https://a.com/{i}") for i in range(900)],
                                  "f long, c0 string, c1 string")
    assert discover_url_column(files, "f", ["c0", "c1"]).count() == 900


def test_hot_run_in_running_totals(spark):
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("run"))
    out = running_totals(df, ["id"], {"n": F.lit(1)}, "run", num_partitions=8, totals=True)
    rows = out.where("run = 0").orderBy("id").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1)) and rows[0].n_total == len(rows)


def test_one_row_group_of_narrow_rows_is_dealt_out(spark, tmp_path):
    """Many splits of a scan may share one row group, which one of them reads whole."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pressgrid.plans import inputs
    n = 40_000
    pq.write_table(pa.table({"event_id": list(range(n)), "user_id": [i * 7919 % n for i in range(n)]}),
                   f"{tmp_path}/events.parquet", row_group_size=n)
    conf = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sizes = inputs.table(spark, str(tmp_path), "events").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sum(sizes) == n and max(sizes) <= 2 * n / spark.sparkContext.defaultParallelism
