"""H1-H3 against an independent reading with Python's html.parser.

The reference reads pages with a tree parser on top of html.parser.  This
test replays the same page through html.parser events and applies the same
rules (drop script/style/comments, drop nav/footer/aside/form/header with all
they hold, take the first article, else main, else body, else everything,
join the stripped text nodes with one space) and compares the result with
the engine's regular-expression plan on every page of the test tables.
"""

import re
from html.parser import HTMLParser

import pyarrow.parquet as pq

from pressgrid.functions import html
from pressgrid.plans import inputs

REMOVED = {"nav", "footer", "aside", "form", "header"}
RAW = {"script", "style"}


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("start", tag))
        self.events.append(("end", tag))

    def handle_endtag(self, tag):
        self.events.append(("end", tag))

    def handle_data(self, data):
        self.events.append(("data", data))


def reference_text(page: str) -> str:
    p = _Events()
    p.feed(page)
    p.close()
    ev = p.events
    # Mark events inside removed elements (first closing tag of the same name
    # ends one; unclosed ones run to the end), and raw-text elements.
    keep = [True] * len(ev)
    i = 0
    while i < len(ev):
        kind, val = ev[i]
        if kind == "start" and (val in REMOVED or val in RAW):
            j = i + 1
            while j < len(ev) and ev[j] != ("end", val):
                j += 1
            for k in range(i, min(j + 1, len(ev))):
                keep[k] = False
            i = j + 1
            continue
        i += 1
    kept = [e for e, k in zip(ev, keep) if k]
    for tag in ("article", "main", "body"):
        starts = [n for n, e in enumerate(kept) if e == ("start", tag)]
        if starts:
            s = starts[0] + 1
            e = next((n for n in range(s, len(kept)) if kept[n] == ("end", tag)), len(kept))
            kept = kept[s:e]
            break
    pieces = [d.strip() for kind, d in kept if kind == "data"]
    return re.sub(r"\s+", " ", " ".join(x for x in pieces if x)).strip()


def test_clean_content_matches_html_parser(spark):
    sf = "/root/testdata/sf0.1"
    pages = pq.read_table(f"{sf}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    want = {pid: reference_text(h) for pid, h in zip(pages["page_id"], pages["html"])}
    df = inputs.table(spark, sf, "pages").withColumn("_h1", html.strip_boilerplate("html"))
    got = {r.page_id: r.t for r in df.select("page_id", html.html_text(html.main_content("_h1")).alias("t")).collect()}
    bad = [pid for pid in want if want[pid] != got[pid]]
    assert not bad, (len(bad), bad[:3], want[bad[0]][:200], got[bad[0]][:200])


def test_rich_pages_match_html_parser(spark):
    sf = "/root/testdata/sf0.01"
    rich = inputs.rich_pages(inputs.table(spark, sf, "pages")).withColumn("_h1", html.strip_boilerplate("html"))
    rows = rich.select("page_id", "html", html.html_text(html.main_content("_h1")).alias("t")).collect()
    bad = [r.page_id for r in rows if reference_text(r.html) != r.t]
    assert not bad, bad[:5]


class _Paragraphs(HTMLParser):
    """Paragraph text read from parser events with the engine's rule: a
    paragraph ends at its closing tag, at the next paragraph, or where an
    enclosing block closes; text nodes are stripped and glued with nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paras, self.cur, self.raw = [], None, None

    def _close(self):
        if self.cur is not None:
            self.paras.append("".join(self.cur))
            self.cur = None

    def handle_starttag(self, tag, attrs):
        if tag in RAW:
            self.raw = tag
        elif tag == "p":
            self._close()
            self.cur = []

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        elif tag == "p" or tag in html.BLOCK_ENDS:
            self._close()

    def handle_data(self, data):
        if self.cur is not None and self.raw is None:
            piece = data.strip()
            if piece:
                self.cur.append(piece)


def reference_paragraphs(page: str) -> str:
    p = _Paragraphs()
    p.feed(page)
    p.close()
    p._close()
    return " ".join(p.paras)


def test_paragraph_text_matches_parser_events(spark):
    sf = "/root/testdata/sf0.1"
    pages = pq.read_table(f"{sf}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    want = {pid: reference_paragraphs(h) for pid, h in zip(pages["page_id"], pages["html"])}
    df = inputs.table(spark, sf, "pages")
    got = {r.page_id: r.t for r in df.select("page_id", html.paragraph_text("html").alias("t")).collect()}
    bad = [pid for pid in want if want[pid] != got[pid]]
    assert not bad, (len(bad), bad[:3], want[bad[0]][:300], got[bad[0]][:300])
