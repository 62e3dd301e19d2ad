"""Inputs the operators need, derived deterministically from the driver's tables.

The driver's tables hold raw pages, events, documents and conversations, but
no URL lists, JSON-LD, dated URLs, result logs or model responses.  Each
builder below derives one such input with plain column expressions, so that
its size grows with the source table.  ``oracles.py`` states the same rules in
DuckDB SQL; the two must stay equal rule for rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partitioning import spread


# Tables whose rows hold whole texts.
WIDE = {"pages", "documents"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; per-row work here is CPU-bound (regular expressions,
    JSON), so a scan with fewer splits than cores is spread (no-op at scale for texts,
    narrow rows always are)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), narrow=name not in WIDE)


def _s(c) -> F.Column:
    return c.cast("string")


def _pick(idx, values) -> F.Column:
    """values[idx] for a 0-based index column (fixed small lists only)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# --- URL lines and blobs (pages) --------------------------------------------

def url_lines_raw(pages: DataFrame) -> DataFrame:
    """(line_no, line): padded, sometimes blank, sometimes without a scheme."""
    pid = F.col("page_id")
    line = (F.when(pid % 5 == 0, F.lit("   "))
            .when(pid % 7 == 0, F.concat(F.lit("  "), F.regexp_replace("url", "^https?://", ""), F.lit(" ")))
            .otherwise(F.concat(F.lit(" "), F.col("url"), F.lit("\t"))))
    return pages.select(pid.alias("line_no"), line.alias("line"))


def url_blobs(pages: DataFrame) -> DataFrame:
    """(blob_id, blob): ten lines per blob, joined by newline (even) or comma (odd)."""
    lines = url_lines_raw(pages).withColumn("blob_id", F.floor(F.col("line_no") / 10))
    g = lines.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    parts = F.transform("ls", lambda x: x["line"])
    return g.select("blob_id", F.when(F.col("blob_id") % 2 == 0, F.array_join(parts, "\n"))
                    .otherwise(F.array_join(parts, ",")).alias("blob"))


def blocked_list(pages: DataFrame) -> DataFrame:
    """(url): the URLs of every tenth page are the blocked-site list."""
    return pages.where(F.col("page_id") % 10 == 0).select("url")


# --- Pages with structured data (pages) -------------------------------------

def _ld_script(body: F.Column) -> F.Column:
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def _pub_date(pid: F.Column) -> F.Column:
    zone = _pick(pid % 4, ["Z", "-05:00", ".000Z", ""])
    return F.concat(F.lit("2025-0"), _s(pid % 9 + 1), F.lit("-1"), _s(pid % 10),
                    F.lit("T1"), _s(pid % 10), F.lit(":30:00"), zone)


def _mod_date(pid: F.Column) -> F.Column:
    return F.concat(F.lit("2025-0"), _s(pid % 9 + 1), F.lit("-2"), _s(pid % 8),
                    F.lit("T0"), _s(pid % 10), F.lit(":05:00Z"))


def article_ld_json(pid: F.Column) -> F.Column:
    author = _pick(pid % 4, [
        '{"@type": "Person", "name": "Ann Lee"}',
        '[{"@type": "Person", "name": "Ann Lee"}, {"@type": "Person", "name": "Bo Chen"}]',
        '{"@type": "Person", "name": ["Cy Diaz", "Di Eze"]}',
        '"Ed Fox"'])
    modified = F.when(pid % 2 == 0, F.concat(F.lit(', "dateModified": "'), _mod_date(pid), F.lit('"'))) \
        .otherwise(F.lit(""))
    return F.concat(
        F.lit('{"@context": "https://schema.org", "@type": "NewsArticle", "headline": "Story '), _s(pid),
        F.lit('", "author": '), author,
        F.lit(', "publisher": {"@type": "Organization", "name": "Desk '), _s(pid % 5),
        F.lit('"}, "datePublished": "'), _pub_date(pid), F.lit('"'), modified, F.lit("}"))


def video_ld_json(pid: F.Column) -> F.Column:
    return F.concat(
        F.lit('[[{"@type": "VideoObject", "name": "Clip '), _s(pid),
        F.lit('", "dateModified": "'), _mod_date(pid),
        F.lit('", "mainEntityOfPage": {"@type": "WebPage", "headline": "Video story '), _s(pid),
        F.lit('", "datePublished": "'), _pub_date(pid),
        F.lit('", "publisher": {"@type": "NewsMediaOrganization", "name": "Channel '), _s(pid % 3),
        F.lit('"}}}]]'))


def broken_ld_json(pid: F.Column) -> F.Column:
    return F.concat(F.lit('{"@type": "NewsArticle", "headline": "Broken '), _s(pid), F.lit('"'))


def rich_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) with JSON-LD, meta tags, by-lines, time and main inserted.

    JSON-LD: an article object when page_id%3=0, an array in an array when
    %3=1, a broken block as well when %7=0.  Meta tags when %5=0; a by-line and
    a time element after the h1 when %5=1; the article becomes main when %4=0.
    """
    pid = F.col("page_id")
    scripts = F.concat(
        F.when(pid % 3 == 0, _ld_script(article_ld_json(pid))).otherwise(F.lit("")),
        F.when(pid % 3 == 1, _ld_script(video_ld_json(pid))).otherwise(F.lit("")),
        F.when(pid % 7 == 0, _ld_script(broken_ld_json(pid))).otherwise(F.lit("")))
    metas = F.when(pid % 5 == 0, F.concat(
        F.lit('<meta property="og:title" content="Headline '), _s(pid),
        F.lit('"><meta name="author" content="Gil Ho"><meta property="og:site_name" content="Site '),
        _s(pid % 4), F.lit('"><meta property="article:published_time" content="2025-03-0'),
        _s(pid % 9 + 1), F.lit('T08:00:00Z">'))).otherwise(F.lit(""))
    byline = F.when(pid % 5 == 1, F.concat(
        F.lit('</h1><p class="byline">By Cy Diaz and Di Eze</p><time datetime="2025-02-1'),
        _s(pid % 10), F.lit('T09:15:00-05:00">Feb</time>'))).otherwise(F.lit("</h1>"))
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(scripts, metas, F.lit("</head>")))
    html = F.replace(html, F.lit("</h1>"), byline)
    html = F.when(pid % 4 == 0, F.replace(F.replace(html, F.lit("<article>"), F.lit("<main>")),
                                          F.lit("</article>"), F.lit("</main>"))).otherwise(html)
    return pages.select("page_id", "url", html.alias("html"))


# --- Dated URLs and result logs (events) ------------------------------------

MONTH_ABBR = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HOSTS = ["www.cnn.com", "edition.cnn.com", "www.reuters.com", "apnews.com", "www.bbc.co.uk",
         "news.example-daily.org"]


def dated_urls(events: DataFrame) -> DataFrame:
    """(event_id, ts, url, ...): news-like URLs whose path carries the event's date
    in one of five shapes; some impossible months; AFP stamps on every fourth."""
    eid = F.col("event_id")
    ts = F.col("ts")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    # Date parts from field functions (cheaper than a formatter per part).
    yyyy = F.year(ts).cast("string")
    month = two(F.month(ts))
    mm = F.when(eid % 17 == 0, F.lit("13")).otherwise(month)
    dd = two(F.dayofmonth(ts))
    d = F.dayofmonth(ts).cast("string")
    mon = _pick(F.month(ts) - 1, list(MONTH_ABBR))
    slug = F.when(eid % 9 == 0, F.concat(F.lit("a"), _s(eid))).otherwise(
        F.concat(F.col("event_type"), F.lit("-market-"), _s(F.col("user_id")), F.lit("-update")))
    shape = eid % 5
    path = (F.when(shape == 0, F.concat_ws("/", F.lit(""), yyyy, mm, dd, F.lit("world"), slug))
            .when(shape == 1, F.concat_ws("/", F.lit(""), yyyy, mon, d, slug))
            .when(shape == 2, F.concat(F.lit("/news/"), slug, F.lit("-"), yyyy, F.lit("-"), mm, F.lit("-"), dd))
            .when(shape == 3, F.concat(F.lit("/"), d, F.lit("-"), mon, F.lit("-"), yyyy, F.lit("/"), slug,
                                       F.lit(".html")))
            .otherwise(F.concat(F.lit("/video/"), yyyy, mm, dd, F.lit("-"), slug, F.lit("/index.html"))))
    path = F.when(eid % 8 == 3, F.concat(F.lit("/by/jane-roe"), path)).otherwise(path)
    stamp_month = F.when(eid % 23 == 0, F.lit("13")).otherwise(month)
    hhmmss = F.concat(two(F.hour(ts)), two(F.minute(ts)), two(F.second(ts)))
    frag = F.when(eid % 4 == 0, F.concat(F.lit("#doc."), yyyy, stamp_month, dd, F.lit("T"),
                                         hhmmss, F.lit("Z"))).otherwise(F.lit(""))
    url = F.concat(F.lit("https://"), _pick(eid % 6, HOSTS), path, frag)
    return events.select("event_id", "ts", url.alias("url"), "event_type", "user_id", "props")


# How an event type stands in for a processing outcome.
STATUS_OF_EVENT = {"view": "success", "purchase": "success", "click": "success_url_parser",
                   "signup": "error_invalid_url", "error": "error_scraping"}


def result_log(events: DataFrame) -> DataFrame:
    """The ten result columns plus (event_id, ts, run_id), one row per event."""
    e = dated_urls(events)
    eid = F.col("event_id")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATUS_OF_EVENT.items()],
                        F.lit("error_future"))
    ok = status.startswith("success")
    blank = F.lit("")
    return e.select(
        "event_id", "ts", F.to_date("ts").cast("string").alias("run_id"), "url",
        F.when(ok, F.concat(F.lit("Title "), _s(eid))).otherwise(blank).alias("title"),
        F.when(ok, F.when(eid % 3 == 0, F.lit("Ann Lee, Bo Chen")).otherwise(F.lit("N/A"))).otherwise(blank)
        .alias("authors"),
        F.when(ok, F.when(eid % 3 == 0, F.lit(" afp ")).otherwise(F.lit("Reuters"))).otherwise(blank)
        .alias("source"),
        F.when(ok, F.to_date("ts").cast("string")).otherwise(blank).alias("published_date"),
        F.when(ok, F.when(eid % 2 == 0, F.to_date("ts").cast("string")).otherwise(F.lit("N/A")))
        .otherwise(blank).alias("modified_date"),
        F.when(status == "success", F.lit("page-rules"))
        .when(status == "success_url_parser", F.lit("url-rules")).otherwise(F.lit("N/A")).alias("llm_used"),
        status.alias("status"),
        F.when(ok, blank).otherwise(F.concat(F.lit("failed: "), F.col("event_type"))).alias("error_message"),
        F.when(ok & (eid % 10 != 0), F.col("props")).otherwise(blank).alias("article_text"),
    )


# --- Model responses (conversations) ----------------------------------------

def _json_string_body(c: F.Column) -> F.Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def model_responses(conversations: DataFrame) -> DataFrame:
    """(id, response): a record per turn in eight shapes (clean, fenced, chatty,
    key missing, raw newlines, cut short, array, number for text), plus empty
    and brace-less responses."""
    rid = F.col("conv_id") * 1000 + F.col("turn")
    text = F.col("text")

    def rec(body_text, date_val='"2025-01-0{d}"', drop_text=False):
        d = _s(rid % 9 + 1)
        parts = [F.lit('{"title": "Reply '), _s(rid), F.lit('", "authors": "'), F.col("role"),
                 F.lit('", "source": "Chat", "published_date": ')]
        if date_val is None:
            parts.append(_s(F.lit(20250101) + rid % 9))
        else:
            parts += [F.lit('"2025-01-0'), d, F.lit('"')]
        parts += [F.lit(', "modified_date": "2025-02-0'), d, F.lit('"')]
        if not drop_text:
            parts += [F.lit(', "article_text": "'), body_text, F.lit('"')]
        parts.append(F.lit("}"))
        return F.concat(*parts)

    clean = rec(_json_string_body(text))
    k = rid % 8
    resp = (F.when(k == 0, clean)
            .when(k == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here is the record: "), clean, F.lit(" Hope it helps.")))
            .when(k == 3, rec(None, drop_text=True))
            .when(k == 4, rec(text))
            .when(k == 5, F.left(clean, F.greatest(F.floor(F.char_length(clean) / 2), F.lit(1)).cast("int")))
            .when(k == 6, F.concat(F.lit("["), clean, F.lit("]")))
            .otherwise(rec(_json_string_body(text), date_val=None)))
    resp = F.when(rid % 13 == 0, F.lit("")).when(rid % 11 == 0, text).otherwise(resp)
    return conversations.select(rid.alias("id"), resp.alias("response"))


# --- Endpoint text and tables (events) --------------------------------------

def _ip(a, b, c, d) -> F.Column:
    return F.concat_ws(".", _s(a % 256), _s(b % 256), _s(c % 256), _s(d % 256))


def endpoint_text(events: DataFrame) -> DataFrame:
    """(event_id, text): free text holding two endpoints and one near miss."""
    eid, uid = F.col("event_id"), F.col("user_id")
    first = F.concat(_ip(uid, eid, F.floor(eid / 256), uid * 7), F.lit(":"), _s(8000 + eid % 1000))
    second = F.concat(_ip(eid * 3, uid + 1, eid, F.lit(10)), F.lit(":"), _s(3128 + uid % 7))
    text = F.concat(F.lit("proxy "), first, F.lit(" up; bad 10.0."), _s(eid % 9), F.lit(":80; alt "),
                    second, F.lit("\n"))
    return events.select("event_id", text.alias("text"))


def endpoint_tables(events: DataFrame) -> DataFrame:
    """(event_id, html): a two-row, eight-column proxy table per event."""
    eid, uid = F.col("event_id"), F.col("user_id")

    def row(a, b):
        cells = [_ip(a, b, eid, uid), _s(1000 + (a + b) % 9000), F.lit("US"), F.lit("United States"),
                 F.lit("anonymous"), F.lit("no"), F.lit("yes"), F.lit("1 min ago")]
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit(" </td>")) for c in cells],
                        F.lit("</tr>"))

    html = F.concat(F.lit('<table class="table"><tbody>'), row(eid, uid), row(uid + 5, eid + 1),
                    F.lit("</tbody></table>"))
    return events.select("event_id", html.alias("html"))
