"""W1, W2, P4 at a size where two range exchanges would sample different bounds."""

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import ordering


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    (spark.range(1_000_000).select(F.col("id").alias("k"),
                                   F.concat(F.lit("https://example.org/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"),
                                   (F.col("id") % 3 == 0).alias("hit"))
     .orderBy(F.xxhash64("k")).write.parquet(path))
    return spark.read.parquet(path)


def test_row_numbers_with_extra_columns(million):
    out = ordering.number_rows(million, ["k"])
    wrong = out.where((F.col("row_no") != F.col("k") + 1) | (F.col("total") != 1_000_000))
    assert wrong.count() == 0 and out.count() == 1_000_000


def test_slice_holds_its_rows_once(million):
    part = ordering.row_slice(ordering.number_rows(million, ["k"], total_col=None), "row_no", 3154, 3865)
    assert sorted(r.k for r in part.select("k").collect()) == list(range(3154, 3865))


def test_running_sums_per_run(million):
    runs = million.withColumn("run", F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise(F.when(F.col("k") < 400_000, 1).otherwise(2)))
    out = ordering.running_totals(runs, ["k"], {"n": F.lit(1), "hits": F.col("hit")}, "run", totals=True)
    last = {r.run: (r.n, r.hits, r.n_total) for r in
            out.groupBy("run").agg(F.max("n").alias("n"), F.max("hits").alias("hits"), F.max("n_total").alias("n_total")).collect()}
    want = {r.run: (r.n, r.hits, r.n) for r in
            runs.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits")).collect()}
    assert last == want
    assert out.select("run", "n").distinct().count() == 1_000_000


def test_empty_and_repeated_plans(spark, million):
    assert ordering.number_rows(million.limit(0), ["k"]).count() == 0
    small = million.where("k < 1000")
    assert ordering.number_rows(small, ["k"], total_col=None).where("row_no <> k + 1").count() == 0


def test_plan_does_not_grow_with_the_partitions(spark, million):
    def plan(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            out = ordering.number_rows(million, ["k"])
            return out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    wide, narrow = plan(20_000), plan(8)
    assert abs(len(wide) - len(narrow)) < 500
    assert wide.count("Exchange hashpartitioning") <= 3 and "rangepartitioning" not in wide and wide.count("FileScan") <= 2
