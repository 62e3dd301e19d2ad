"""H1-H8 on hand-written pages."""

from pyspark.sql import functions as F

from pressgrid.functions import html, jsonld
from pressgrid.operators.text import table_endpoints

PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{x}</style>
<script>var s = "</p><p>not text";</script></head><body><nav><a>Home</a></nav>
<article><header><h1>Gone with header</h1></header><p>First <b>bold</b>line.
<p>Second &copy; 2025 &amp;more<!-- <p>hidden --></p><aside>side</aside>
<footer>foot</footer></article><footer>page foot</footer></body></html>"""


def _one(spark, col_fn, page=PAGE):
    return spark.createDataFrame([(page,)], "h string").select(col_fn("h")).first()[0]


def test_clean_content_article_and_header(spark):
    assert _one(spark, html.clean_content) == "First bold line. Second © 2025 &more"


def test_main_then_body_then_document(spark):
    assert _one(spark, html.clean_content, "<main><p>in main</p></main><p>out</p>") == "in main"
    assert _one(spark, html.clean_content, "<p>pre</p><body><p>in body") == "in body"
    assert _one(spark, html.clean_content, "<div>just <i>text</i></div>") == "just text"


def test_unclosed_removable_runs_to_end(spark):
    assert _one(spark, html.clean_content, "<body>keep<nav>drop all of this") == "keep"


def test_nav_prefix_is_not_nav(spark):
    assert _one(spark, html.clean_content, "<body><nav-bar>stay</nav-bar></body>") == "stay"


def test_paragraph_text_exact(spark):
    got = _one(spark, html.paragraph_text, "<p> Getty<b>hide</b> x </p><div><p>two</div><p>three")
    assert got == "Gettyhidex two three"


def test_raw_html_for_dates_keeps_head(spark):
    got = _one(spark, lambda c: html.raw_html_for_dates(c, 60), PAGE)
    assert got.startswith("<!DOCTYPE html><html><head><title>T &amp; T</title>")
    assert "<script" not in got and len(got) == 60


def test_jsonld_blocks_and_wrapper(spark):
    page = ('<script type="application/ld+json">{"headline": "H"}</script>'
            "<script type='application/ld+json'>[[{\"name\": \"N\"}]]</script>"
            '<script type="application/ld+json">{"broken": </script>'
            '<script type="application/ld+json; x">{"no": 1}</script>'
            '<script data-type="application/ld+json">{"no": 2}</script>'
            '<script type="application/ld+json">{"a": 1} trailing</script><p>para <i>one</i></p>')
    df = spark.createDataFrame([(page,)], "h string")
    blocks = df.select(jsonld.jsonld_blocks("h")).first()[0]
    assert blocks == ['{"headline": "H"}', '[[{"name": "N"}]]']
    w = df.select(jsonld.jsonld_wrapper("h").alias("w")).first()["w"]
    assert w["article_text"] == "paraone" and len(w["ld_json_list"]) == 2
    none = spark.createDataFrame([("<p>x</p>",)], "h string").select(jsonld.jsonld_wrapper("h")).first()[0]
    assert none is None


def test_has_dates_top_level_only(spark):
    import json
    vals = ['"2025-01-01"', '""', '"0"', '0', '0.0', '5', 'false', 'true', '[]', '[0]', '{}', '{"a": 1}', 'null']
    rows = [(f'{{"datePublished": {v}}}',) for v in vals] + [('{"x": {"datePublished": "d"}}',),
                                                           ('[{"datePublished": "d"}]',), ("not json",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string").select(jsonld.has_dates("b")).collect()]

    def py(t):
        try:
            d = json.loads(t)
        except ValueError:
            return False
        return isinstance(d, dict) and any(d.get(k) for k in jsonld.DATE_KEYS)
    assert got == [py(r[0]) for r in rows]


def test_table_endpoints_stride(spark):
    cells = "".join(f"<td>{v}</td>" for v in ["1.2.3.4", "80", "US", "x", "y", "z", "w", "v",
                                              "5.6.7.8", "3128", "DE", "x", "y", "z", "w", "v", "9.9.9.9"])
    df = spark.createDataFrame([(1, f"<table>{cells}</table>")], "id int, h string")
    got = [r["endpoint"] for r in table_endpoints(df, "h", ["id"]).orderBy("pos").collect()]
    assert got == ["1.2.3.4:80", "5.6.7.8:3128"]


def test_table_endpoints_of_awkward_cells(spark):
    """Cells are text of markup; a group without a second cell gives no row, empty cells do."""
    def table(*cells):
        return "<table>" + "".join(f"<td class='a'> {c}\n</td>" for c in cells) + "</table>"
    rows = [(1, table("<b>1.1.1.1</b>", "8&#48;", *"cdefgh", "", "", *"cdefgh", "2.2.2.2")), (2, table("3.3.3.3")),
            (3, table("4.4.4.4", "&lt;1")), (4, ""), (5, None), (6, "<p>no cells</p>")]
    df = spark.createDataFrame(rows, "id int, h string")
    got = sorted(tuple(r) for r in table_endpoints(df, "h", ["id"]).collect())
    assert got == [(1, 0, "1.1.1.1:80"), (1, 1, ":"), (3, 0, "4.4.4.4:<1")]
