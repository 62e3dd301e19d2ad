"""Nesting, references, quoted attributes and JSON strictness on stated cases, and
nesting against a stack on random markup."""

import random
from html import unescape
from html.entities import html5

from pressgrid.functions import html, jsonld
from pressgrid.plans import pipeline


def one(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = dict(df.select("i", column("s").alias("v")).collect())
    return [got[i] for i in range(len(rows))]


def test_inner_elements_of_the_same_kind(spark):
    pages = ["<article>A<article>B</article>C</article>D", "<body><nav>x<nav>y</nav>z</nav>T</body>",
             "<main><form>a<div><form>b</form>c</div></form>kept</main>", "<aside>open <p>to the end", "a</nav>b"]
    assert one(spark, html.clean_content, pages) == ["A B C", "T", "kept", "", "a b"]


def test_quoted_attributes_may_hold_a_bracket(spark):
    rows = ['<p title="a>b">x</p>', "<a href='?q=>' class=z>link</a>", "<p don't>y</p>", '<img alt="never closed>tail', "1 < 2"]
    assert one(spark, html.html_text, rows) == ["x", "link", "y", "tail", "1 < 2"]


def test_references_are_decoded_once(spark):
    rows = ["caf&eacute; &#233; &#x2019;", "&#38;amp; &amp;lt;", "&copy 2024 &unknown; &;", "&#0; &#150; &#1114112;", "a & b", None,
            "&#128512;&hearts;", "&ampx &notit; &dollar; &lbrace;"]
    assert one(spark, html.unescape_entities, rows) == [
        "café é ’", "&amp; &lt;", "© 2024 &unknown; &;", "� – �", "a & b", None, "😀♥", "&x ¬it; $ {"]


def test_strict_json_refuses_tails(spark):
    good = ['{"a":1}', "[1, 2]", '"x"', " 1 ", "null"]
    bad = ['{"a":1}] x', '{"a":1}],[2', '{"a":1}} x', '{"a":1},{"b":2}', '1,"k":2', "1 2", "", "{", "x"]
    assert one(spark, jsonld.strict_json, good + bad) == [True] * len(good) + [False] * len(bad)


def test_json_ld_script_type_without_quotes(spark):
    rows = ['<script type=application/ld+json>{"a":1}</script>', '<script type=application/ld+json async>{"a":2}</script>',
            '<script type="application/ld+json">{"a":3}</script>', '<script type="Application/LD+JSON">{"a":4}</script>',
            '<script type=application/ld+jsonx>{"a":5}</script>']
    assert one(spark, jsonld.jsonld_blocks, rows) == [['{"a":1}'], ['{"a":2}'], ['{"a":3}'], [], []]


def test_every_name_and_prefix_reads_as_the_standard_library(spark):
    names = sorted(html5)
    rows = [f"a&{n}" for n in names] + [f"&{n}." for n in names] + [f"&{n}x; b" for n in names if not n.endswith(";")]
    rows += [f"&{n[:k]};" for n in names for k in (2, 4, len(n) - 2)] + ["&#65 &#065;&#x41;", "&#11;&#127;&#xFFFE;|&#x1F;", "&#99999999999;"]
    assert one(spark, html.unescape_entities, rows) == [unescape(r) for r in rows]


VOID = {"br", "img", "hr"}
REMOVED = {"nav", "footer", "aside", "form", "header"}


def read(tokens):
    """(kept markup, main text) with a stack of open elements."""
    stack, kept, found = [], [], {}
    texts = {c: [] for c in ("article", "main", "body", "")}
    for kind, name, raw in tokens:
        removed = any(n in REMOVED for n, _ in stack)
        if kind == "text":
            if not removed:
                kept.append(raw)
                texts[""].append(raw)
                for n, first in stack:
                    if first:
                        texts[n].append(raw)
            continue
        if kind == "open":
            if not removed:
                kept.append(" " if name in REMOVED else raw)
            first = name in texts and not removed and name not in found
            if first:
                found[name] = True
            stack.append((name, first))
        elif kind == "close" and name in [n for n, _ in stack]:
            while stack.pop()[0] != name:
                pass
            if not any(n in REMOVED for n, _ in stack) and not removed:
                kept.append(raw)
        elif not removed:
            kept.append(" " if kind == "gone" or kind == "alone" and name in REMOVED else raw)
    best = next((c for c in ("article", "main", "body") if c in found), "")
    return "".join(kept), " ".join(" ".join(texts[best]).split())


def mutated(r, k):
    """Random markup with tags in attribute values, comments and scripts."""
    out = []
    for i in range(k):
        name = r.choice(["nav", "form", "article", "main", "body", "div", "p", "b", "aside", "ARTICLE", "br", "x-nav"])
        low = name.lower()
        trick = r.choice(["", "", ' title="<nav>"', " alt='</article>'", " data-x=<b", ' a="1" b=\'>\'', " checked"])
        pick = r.randrange(10)
        if pick < 3:
            out.append(("text", "", f"w{i} "))
        elif pick < 6:
            raw = f"<{name}{trick}>" if "<b" not in trick else f"<{name} data-x=1>"
            out.append(("alone" if low in VOID else "open", low, raw))
        elif pick < 8:
            out.append(("close", low, f"</{name}>") if low not in VOID else ("text", "", f"v{i} "))
        elif pick == 8:
            out.append(("gone", "", r.choice(["<!-- <nav> </article> -->", "<script>var a='</p><form>';</script>", "<style>x{}</style>"])))
        else:
            out.append(("alone", low, f"<{name}{' ' if trick else ''}/>"))
    return out


def test_mutated_pages_equal_a_stack_parser(spark):
    r = random.Random(5)
    pages = [mutated(r, r.randrange(1, 60)) for _ in range(600)] + [mutated(r, 900) for _ in range(3)]
    markup = ["".join(raw for _, _, raw in p) for p in pages]
    df = spark.createDataFrame(list(enumerate(markup)), "i int, s string").withColumn("p", html.page_parts("s"))
    got = {x.i: (x.m, x.t) for x in df.select("i", html.stripped_markup("p").alias("m"), html.main_text("p").alias("t")).collect()}
    for i, p in enumerate(pages):
        assert got[i] == read(p), markup[i]


def test_tags_in_attribute_values_and_unclosed_elements(spark):
    pages = ['<article title="<nav>">q<nav>n</nav>r</article>', "<article>a<nav>menu</article>after", "<div><nav>m</div>kept",
             "<body><nav/>x</body>", "<article>" + "<p>y</p>" * 20_000 + "</article>z", "<p>" * 3_000 + "deep"]
    got = one(spark, html.clean_content, pages)
    assert got[:4] == ["q r", "a", "kept", "x"]
    assert got[4] == " ".join(["y"] * 20_000) and got[5] == "deep"


def test_one_result_per_row_when_a_page_is_stored_twice(spark):
    urls = spark.createDataFrame([(1, "https://p.com/a"), (2, "https://p.com/a")], "pos long, url string")
    pages = spark.createDataFrame([(5, "https://p.com/a", "<h1>Later crawl</h1>"), (3, "https://p.com/a", "<h1>First crawl</h1>"),
                                   (3, "https://p.com/a", "<h1>First crawl</h1>")], "page_id long, url string, html string")
    out = pipeline.process_urls(urls, pages, spark.createDataFrame([], "url string")).collect()
    assert [(r.pos, r.title) for r in sorted(out)] == [(1, "First crawl"), (2, "First crawl")]


def test_whole_text_in_parquet_and_a_cut_in_csv(spark, tmp_path):
    from pressgrid.sources import files
    urls = spark.createDataFrame([(1, "https://p.com/a")], "pos long, url string")
    pages = spark.createDataFrame([(1, "https://p.com/a", "<body>" + "x" * 45000 + "</body>")], "page_id long, url string, html string")
    rows = pipeline.result_rows(pipeline.process_urls(urls, pages, spark.createDataFrame([], "url string")))
    assert len(rows.first().article_text) == 45000
    files.write_result_csv(rows, str(tmp_path / "csv"))
    assert len(files.read_result_csv(spark, str(tmp_path / "csv")).first().article_text) == 32750
