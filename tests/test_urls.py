"""P1-P5, SRC1-SRC3, J1-J3, W1: URL checks, intake and routing."""

from pyspark.sql import functions as F

from pressgrid.functions.urls import base_url, has_scheme, is_valid_url
from pressgrid.operators import urls as U
from pressgrid.operators.ordering import number_rows, row_slice


def test_url_predicates(spark):
    rows = [(" https://a.io/x ",), ("http://b",), ("HTTP://c.example/x",), ("ftp://x.example",), ("",), (None,),
            ("https://x.io",)]
    df = spark.createDataFrame(rows, "u string")
    got = df.select(is_valid_url("u"), has_scheme("u")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False),
                                       (False, False), (False, False), (True, True)]


def test_base_url_shapes(spark):
    rows = [("https://www.x.com/a/b?q=1",), ("http://https://h.com/path",), ("https://h.com:8080",),
            ("https://h.com?x=1",), ("https://a.com/https://b.com/x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(base_url("u")).collect()]
    assert got == ["https://www.x.com", "http://https:", "https://h.com:8080", "https://h.com?x=1",
                   "https://a.com"]


def test_split_urls_text_blob(spark):
    blob = " https://a.com/x , ftp://no\nhttps://b.com/y\n\nhttps://a.com/x,http://s"
    df = spark.createDataFrame([(1, blob)], "k int, t string")
    got = sorted(r.url for r in U.split_urls(df, "t", ["k"]).collect())
    assert got == ["https://a.com/x", "https://b.com/y"]


def test_discover_url_column_leftmost_wins(spark):
    rows = [(1, "n1", " https://a.com/1", "https://z.com/9"), (1, "n2", "none", None),
            (2, None, "x", "https://c.com/3"), (2, "https://d.com/4", "y", None),
            (3, "a", "b", "c")]
    df = spark.createDataFrame(rows, "f int, c0 string, c1 string, c2 string")
    got = sorted((r.f, r.url) for r in U.discover_url_column(df, "f", ["c0", "c1", "c2"]).collect())
    assert got == [(1, " https://a.com/1"), (2, "https://d.com/4")]


def test_cap_batch_refuses_whole_batch(spark):
    df = spark.createDataFrame([(1, f"https://a.com/{i}") for i in range(3)] + [(2, "https://b.com/1")],
                               "b int, url string")
    out = {r.b: (r.refused, r.error) for r in U.cap_batch(df, "b", 2).collect()}
    assert out[1] == (True, "Too many URLs (3). Maximum allowed: 2") and out[2] == (False, None)


def test_route_semi_anti(spark):
    urls = spark.createDataFrame([(1, "https://bad.com/a"), (2, "https://ok.com/b"), (3, "https://bad.com")],
                                 "pos int, url string")
    blocked = spark.createDataFrame([(" https://bad.com/zzz ",), ("",)], "url string")
    assert sorted(r.pos for r in U.blocked_urls(urls, blocked).collect()) == [1, 3]
    assert [r.pos for r in U.open_urls(urls, blocked).collect()] == [2]
    routed = {r.pos: r.blocked for r in U.route(urls, blocked).collect()}
    assert routed == {1: True, 2: False, 3: True}
    # Above the broadcast bound the same answer comes from a shuffle join.
    routed2 = {r.pos: r.blocked for r in U.route(urls, blocked, max_broadcast_rows=0).collect()}
    assert routed2 == routed


def test_number_rows_and_slice_across_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    n = number_rows(df, ["k"])
    got = sorted((r.k, r.row_no, r.total) for r in n.collect())
    assert got == [(k, k + 1, 1000) for k in range(1000)]
    s = sorted(r.k for r in row_slice(number_rows(df, ["k"], total_col=None), "row_no", 10, 20).collect())
    assert s == list(range(10, 20))
