"""D1-D4 and X1-X3 goldens."""

from pressgrid.functions import dates, extract, jsonld
from pressgrid.plans import pipeline


def test_afp_golden_and_impossible(spark):
    rows = [("https://x.afp.com/doc.20250416T170321Z",), ("https://x/doc.20251316T170321Z",), ("no stamp",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(dates.afp_datetime("u")).collect()]
    assert got == ["4/16/2025T13:03:21", None, None, None]


def test_to_eastern_golden(spark):
    rows = [("2025-04-26T16:30:00.000Z",), ("2025-02-09T06:13:44-05:00",), ("2025-02-09T06:13:44",),
            ("2025-02-09",), ("nonsense",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(dates.to_eastern("s")).collect()]
    assert got == ["2025-04-26T12:30:00", "2025-02-09T06:13:44", "2025-02-09T06:13:44", "2025-02-09", None]


def test_stamps_in_every_form(spark):
    want = {
        "2025-06-26T02:00Z": "2025-06-25T22:00:00", "2025-04-26T16:30:00-04": "2025-04-26T16:30:00",
        "2025-04-26T16:30:00+0530": "2025-04-26T07:00:00", "2025-04-26 16:30": "2025-04-26T16:30:00",
        "2025-04-26T16:30:00,123z": "2025-04-26T12:30:00", "20250426T163000Z": "2025-04-26T12:30:00",
        "20250426": "2025-04-26", "2025-4-6": "2025-04-06", "2025-01-26T16:30:00 UTC": "2025-01-26T11:30:00",
        "Sat, 26 Apr 2025 16:30:00 GMT": "2025-04-26T12:30:00", "26 Apr 2025 16:30 +0200": "2025-04-26T10:30:00",
        "26-Apr-2025": "2025-04-26", "April 26, 2025": "2025-04-26", "Apr. 26th, 2025 at 4:05 p.m. PDT": "2025-04-26T19:05:00",
        "Sept 3, 2024 12:00 AM": "2024-09-03T00:00:00", "September 3 2024, 12:30 PM ET": "2024-09-03T12:30:00",
        "Tuesday, 3 September 2024": "2024-09-03", "May 5, 2025 9:07 EDT": "2025-05-05T09:07:00",
        "2025-02-30": None, "2025-02-10T25:00:00Z": None, "Maybe 3, 2024": None, "2025-13-01T10:00": None,
        "May 5, 2025 13:00 PM": None, "12:30": None, "": None, "2025-04-26T16:30:00 XYZ": None, "2025-04": None}
    df = spark.createDataFrame(list(want.items()), "s string, w string")
    got = {r.s: r.e for r in df.select("s", dates.to_eastern("s").alias("e")).collect()}
    assert got == want


def test_meta_attributes_without_quotes_and_hosts_with_users(spark):
    r = _meta(spark, PAGE % """<meta name=author content=Jo><meta content='x "y"' property=og:title>
        <meta data-x="name='og:site_name' content='No'" name="x" content="y"><META NAME=og:site_name CONTENT=Post/Two>
        <meta property=article:published_time content=2024-05-01T10:00Z>""")
    assert (r.title, r.authors, r.source, r.published_date) == ('x "y"', "Jo", "Post/Two", "2024-05-01")
    df = spark.createDataFrame([("https://user@ex.com/x-y",), ("https://u:p@www.cnn.com:80/a",)], "u string")
    assert [x.m.source for x in df.select(extract.url_metadata("u").alias("m")).collect()] == ["EX", "CNN"]


def test_url_metadata_golden(spark):
    rows = [("https://www.cnn.com/2024/03/07/travel/harbour-ferry-returns-after-winter-repairs",),
            ("https://www.theguardian.com/world/2025/apr/5/some-story-here",),
            ("https://news.example.org/by/jane-roe/15-apr-2023/index.html",),
            ("https://apnews.com/article/20250230-bad-date-slug",),
            ("https://t.co/abc123",)]
    df = spark.createDataFrame(rows, "u string").select(extract.url_metadata("u").alias("m"))
    got = [r.m.asDict() for r in df.collect()]
    assert got[0] == {"title": "Harbour Ferry Returns After Winter Repairs", "authors": "unknown",
                      "source": "CNN", "published_date": "2024-03-07", "modified_date": "2024-03-07",
                      "article_text": "unknown"}
    assert (got[1]["source"], got[1]["published_date"], got[1]["title"]) == \
        ("The Guardian", "2025-04-05", "Some Story Here")
    assert (got[2]["authors"], got[2]["published_date"], got[2]["source"]) == ("Jane Roe", "2023-04-15", "NEWS")
    assert got[3]["published_date"] == "unknown" and got[3]["source"] == "AP News"
    assert got[4]["title"] == "unknown" and got[4]["source"] == "T"


LD = """<script type="application/ld+json">{"@type": "NewsArticle", "headline": "Bridge opens to cyclists",
 "publisher": {"@type": "Organization", "name": "Harbour Post"}, "author": {"@type": "Person", "name": ["Ana Lund"]},
 "datePublished": "2024-03-07T09:41:18-05:00", "dateModified": "2024-03-08T10:02:33-05:00"}</script>"""
PAGE = """<html><head><title>Bridge opens : Harbour Post</title>%s</head>
<body><article><header><h1>Bridge opens to cyclists</h1></header>
<section><span class="when byline"><time datetime="2024-03-07T09:41:18-05:00">7 March</time></span>
<p class="story-byline">By <a href="/ana">Ana Lund</a></p><div class="byline two"><a href="/per">Per Ohm</a></div></section>
<p>Body text.</p></article></body></html>"""


def _meta(spark, html, **kw):
    df = spark.createDataFrame([(1, "https://www.harbourpost.org/2024/x", html)], "page_id long, url string, html string")
    return pipeline.page_metadata(df, **kw).first()


def test_page_metadata_structured_first(spark):
    r = _meta(spark, PAGE % LD)
    assert (r.title, r.authors, r.source, r.published_date, r.modified_date) == \
        ("Bridge opens to cyclists", "Ana Lund", "Harbour Post", "2024-03-07", "2024-03-08")
    assert _meta(spark, PAGE % LD, date_style="et_datetime").published_date == "2024-03-07T09:41:18"


def test_page_metadata_from_the_visible_page(spark):
    r = _meta(spark, PAGE % "")
    # The headline stands in a header, two by-lines name people and one a date.
    assert (r.title, r.authors, r.published_date) == ("Bridge opens to cyclists", "Ana Lund, Per Ohm", "2024-03-07")


def test_meta_values_end_at_their_own_quote(spark):
    head = """<meta property="og:title" content="It's a Tom &amp; Jerry story"><meta content='He said "no"' name='author'>"""
    r = _meta(spark, PAGE % head)
    assert (r.title, r.authors) == ("It's a Tom & Jerry story", 'He said "no"')


def test_jsonld_fields_nested_shapes(spark):
    blocks = ['[[{"@type": "AudioObject", "name": "Tape", "dateModified": "2023-11-02T08:55:00Z",'
              ' "mainEntityOfPage": {"@type": "WebPage", "headline": "Main", "datePublished": "2023-11-01T07:20:10Z",'
              ' "publisher": {"@type": "Org", "name": "Post"}}}]]',
              '{"author": [{"name": "A"}, "B", {"name": ["C", "D"]}]}']
    df = spark.createDataFrame([(blocks,)], "b array<string>")
    r = df.select(jsonld.jsonld_fields("b").alias("f")).first().f
    assert (r.title, r.authors, r.source, r.published, r.modified) == \
        ("Main", "A, B, C, D", "Post", "2023-11-01T07:20:10Z", "2023-11-02T08:55:00Z")


def test_enrich_afp_keeps_rows_and_reads_upper_case_url(spark):
    from pressgrid.operators.enrich import enrich_afp
    rows = [("https://x.afp.com/doc.20250416T170321Z", " afp ", "2025-04-16", "2025-04-16", "t"),
            ("https://x.afp.com/doc.20250416T170321Z", "Reuters", "2025-04-16", "N/A", "t"),
            ("https://x.afp.com/no-stamp", "AFP", "2025-04-16", "2025-04-17", "t")]
    df = spark.createDataFrame(rows, "URL string, source string, published_date string, modified_date string, x string")
    out = enrich_afp(df, url_col="url")
    assert out.columns == df.columns
    got = [(r.published_date, r.modified_date) for r in out.collect()]
    assert got == [("4/16/2025T13:03:21", "4/16/2025T13:03:21"), ("2025-04-16", "N/A"), ("2025-04-16", "2025-04-17")]
