"""The per-URL pipeline as one plan (X2, X4-X6, T7, SNK2, P9-P14).

URL list -> quick scheme check -> blocked-site routing -> page lookup ->
cleaning, JSON-LD and metadata -> status.  The reference runs these steps
per URL in a thread pool; here they are one DataFrame plan that Catalyst
optimises as a whole.  Heavy work runs once per *distinct* URL; the
per-position rows are joined back at the end, so a URL repeated a million
times costs one page parse (AQE splits the skewed join-back partitions).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, extract, html, jsonld, text
from ..functions.urls import has_scheme, py_strip
from ..operators.joins import broadcast_if_small, salted_lookup_join
from ..operators.urls import route
from ..session import stored

# The status domain, the failure messages, the sink columns.
STATUS_SUCCESS = "success"
STATUS_URL_PARSER = "success_url_parser"
STATUS_INVALID = "error_invalid_url"
STATUS_SCRAPING = "error_scraping"
# Our extractors, named in ``llm_used`` (the column keeps its original name).
EXTRACTOR_PAGE = "page-rules"
EXTRACTOR_URL = "url-rules"
ERR_INVALID = "Invalid or empty URL"
ERR_NO_PAGE = "page not found"
ERR_DEFAULT = "Unknown error"
NA = "N/A"

RESULT_COLUMNS = ("url", "title", "authors", "source", "published_date", "modified_date",
                  "llm_used", "status", "error_message", "article_text")
RECORD_FIELDS = ("title", "authors", "source", "published_date", "modified_date", "article_text")


def page_parts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Bind the expensive intermediate columns once: the parts of the page (one
    reading), cleaned text (H3), JSON-LD blocks (H4).  Later steps read these columns
    instead of reading the page again."""
    return (pages
            .withColumn("_parts", html.page_parts(html_col))
            .withColumn("ld_blocks", jsonld.jsonld_blocks(html_col))
            .withColumn("content", html.main_text("_parts")))


def page_metadata(pages: DataFrame, date_style: str = "date", html_col: str = "html",
                  url_col: str = "url") -> DataFrame:
    """Structured data first (JSON-LD, then meta/OpenGraph), then the
    visible page (h1, by-line, time, title), then the host for the source.

    Adds the six record columns (null where nothing is found) to ``pages``.
    Dates follow ``date_style`` (D3); the modified date falls back to the
    published one (D4).
    """
    p = (page_parts(pages, html_col)
         .withColumn("_cands", jsonld.jsonld_candidates("ld_blocks"))
         .withColumn("_ld", jsonld.jsonld_fields("ld_blocks", "_cands")))
    # A headline often stands in the header that the text leaves out.
    p = (p.withColumn("_page", html.drop_comments_scripts(html_col))
         .withColumn("_metas", extract.page_metas(html_col)))
    title = F.coalesce(F.col("_ld.title"), extract.meta_content("_metas", "og:title"),
                       extract.first_inner_text("_page", extract.H1_INNER),
                       extract.first_inner_text(html_col, extract.TITLE_INNER))
    authors = F.coalesce(F.col("_ld.authors"), extract.meta_content("_metas", "author"),
                         extract.byline_authors("_page"))
    source = F.coalesce(F.col("_ld.source"), extract.meta_content("_metas", "og:site_name"),
                        extract.source_from_host(extract.url_host(url_col)))
    published = F.coalesce(F.col("_ld.published"), extract.meta_content("_metas", "article:published_time"),
                           extract.time_datetime(html_col))
    modified = F.coalesce(F.col("_ld.modified"), extract.meta_content("_metas", "article:modified_time"))
    p = (p.withColumns({"title": title, "authors": authors, "source": source,
                        "_published": published, "_modified": modified})
         .withColumn("published_date", dates.to_date_style("_published", date_style))
         .withColumn("modified_date", dates.modified_or_published(
             dates.to_date_style("_modified", date_style), "published_date"))
         .withColumn("article_text", F.col("content")))
    return p.drop("_ld", "_parts", "_cands", "_page", "_metas", "_published", "_modified")


def build_payload(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                  legacy_wrapper: bool = False) -> DataFrame:
    """T7 + T6: what an external extractor would be sent, as a struct and as text.

    ``website_content`` is the cleaned text cut at 50,000 characters and
    mojibake-fixed; ``json_ld`` only when a block parses; ``raw_html_for_dates``
    only when no block has a date key at its top level (with
    ``legacy_wrapper=True`` the check is made on the wrapper, as originally, and
    the raw HTML is always attached).
    """
    p = page_parts(pages, html_col)
    wrapper = F.when(F.size("ld_blocks") > 0, F.struct(
        F.transform("ld_blocks", lambda b: F.parse_json(b)).alias("ld_json_list"),
        jsonld.scrub_default(html.paragraph_text(html_col)).alias("article_text")))
    good = F.lit(False) if legacy_wrapper else F.exists("ld_blocks", lambda b: jsonld.has_dates(b))
    content = text.truncate_content("content")
    payload = F.struct(
        F.col(url_col).alias("url"),
        F.when(F.col("content") != "", text.fix_mojibake(content)).otherwise(F.lit("")).alias("website_content"),
        wrapper.alias("json_ld"),
        F.when(~good, F.left(F.col("_raw"), F.lit(20000))).alias("raw_html_for_dates"))
    # H7 (``_raw``) is the page with the removed elements gone, not replaced by
    # a space as for the text.
    p = p.withColumn("_raw", html.stripped_markup("_parts", ""))
    p = p.withColumn("payload", payload)
    return p.withColumn("payload_text", text.truncate_payload(payload_json("payload", "ld_blocks"))) \
        .drop("_parts", "_raw")


def _json_string(c: F.Column) -> F.Column:
    """A string as a JSON string literal (quoted and escaped by ``to_json``)."""
    wrapped = F.to_json(F.struct(c.alias("v")))  # {"v":<literal>}
    return F.when(c.isNotNull(), F.substring(wrapped, 6, F.length(wrapped) - 6))


def payload_json(payload_col: str, blocks_col: str) -> F.Column:
    """The payload as JSON text, fields in payload order, absent fields left
    out; the JSON-LD blocks are embedded as the page wrote them."""
    p = F.col(payload_col)
    ld = F.concat(F.lit(',"json_ld":{"ld_json_list":['), F.array_join(blocks_col, ","),
                  F.lit('],"article_text":'), _json_string(p["json_ld"]["article_text"]), F.lit("}"))
    raw = F.concat(F.lit(',"raw_html_for_dates":'), _json_string(p["raw_html_for_dates"]))
    return F.concat(F.lit('{"url":'), F.coalesce(_json_string(p["url"]), F.lit("null")),
                    F.lit(',"website_content":'), _json_string(p["website_content"]),
                    F.when(p["json_ld"].isNotNull(), ld).otherwise(F.lit("")),
                    F.when(p["raw_html_for_dates"].isNotNull(), raw).otherwise(F.lit("")),
                    F.lit("}"))


def _wanted(open_rows: DataFrame, pages: DataFrame, url_col: str, hot_url_rows: int) -> DataFrame:
    """Per distinct URL of ``open_rows``: whether it is stored, its lowest page id and
    whether more than ``hot_url_rows`` rows list it.  No HTML is read for it."""
    counts = open_rows.groupBy(url_col).agg((F.count(F.lit(1)) > hot_url_rows).alias("_hot"))
    page_id = F.col("page_id").cast("long") if "page_id" in pages.columns else F.lit(None).cast("long")
    ids = (pages.select(F.col(url_col).alias("_url"), page_id.alias("_id"))
           .groupBy("_url").agg(F.min("_id").alias("_page")).withColumn("_stored", F.lit(True)))
    return (counts.join(ids, F.col(url_col) == F.col("_url"), "left")
            .select(url_col, "_hot", F.coalesce("_stored", F.lit(False)).alias("_stored"), "_page"))


def process_urls(urls: DataFrame, pages: DataFrame, blocked: DataFrame,
                 extractor: Callable[[DataFrame], DataFrame] = page_metadata,
                 url_col: str = "url", pos_col: str = "pos",
                 hot_url_rows: int = 1_000_000, salt_buckets: int = 32) -> DataFrame:
    """X4 + X5: one result row per input row.

    A URL stored several times in ``pages`` is read from its lowest ``page_id``
    (any one of its rows when the table has no such column).  Columns: ``pos``, the ten result columns (record columns null when there is
    no record) and ``has_record``.  A URL listed more than ``hot_url_rows``
    times is joined back salted over ``salt_buckets`` tasks.
    """
    # The routed positions and, per URL to look up, its page and whether it is hot: two
    # narrow tables, stored once, that everything else is planned from.
    routed = stored(route(urls.select(pos_col, url_col).withColumn("_valid", has_scheme(url_col)), blocked, url_col)
                    .select(pos_col, url_col, "_valid", "blocked"), "routed")
    wants_page = F.col("_valid") & ~F.col("blocked")
    # Only open rows need a page; the others are finished by the URL alone.
    open_rows = routed.where(wants_page).select(pos_col, url_col)
    closed = extract.with_url_metadata(routed.where(~wants_page), url_col, "_u")
    wanted = stored(_wanted(open_rows, pages, url_col, hot_url_rows), "wanted")
    here = wanted.where("_stored").select(F.col(url_col).alias("_url"), "_page")
    found = pages.join(here, F.col(url_col) == F.col("_url"))
    if "page_id" in pages.columns:
        found = found.where(F.col("page_id").eqNullSafe(F.col("_page")))
    meta = extractor(found.drop("_url", "_page")).select(url_col, *RECORD_FIELDS, F.lit(True).alias("_found"))
    meta = meta.dropDuplicates([url_col])
    hot = wanted.where("_hot").select(url_col)
    if hot.isEmpty():
        joined = open_rows.join(meta, url_col, "left")
    else:
        joined = salted_lookup_join(open_rows, meta, url_col, "left", hot_url_rows, salt_buckets, pos_col,
                                    hot=broadcast_if_small(hot))
    got = F.col("_found").isNotNull()
    paged = joined.select(
        pos_col, url_col, *RECORD_FIELDS,
        F.when(got, F.lit(EXTRACTOR_PAGE)).otherwise(F.lit(NA)).alias("llm_used"),
        F.when(got, F.lit(STATUS_SUCCESS)).otherwise(F.lit(STATUS_SCRAPING)).alias("status"),
        F.when(~got, F.lit(ERR_NO_PAGE)).alias("error_message"), got.alias("has_record"))
    valid = F.col("_valid")
    by_url = closed.select(
        pos_col, url_col, *[F.when(valid, F.col(f"_u.{c}")).alias(c) for c in RECORD_FIELDS],
        F.when(valid, F.lit(EXTRACTOR_URL)).otherwise(F.lit(NA)).alias("llm_used"),
        F.when(valid, F.lit(STATUS_URL_PARSER)).otherwise(F.lit(STATUS_INVALID)).alias("status"),
        F.when(~valid, F.lit(ERR_INVALID)).alias("error_message"), valid.alias("has_record"))
    return paged.unionByName(by_url)


def result_rows(results: DataFrame, char_limit: int | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """SNK2: the ten sink columns.  A row with a record has an empty error and
    its whole text mojibake-fixed (only a CSV cell is cut, by
    ``write_result_csv``; ``char_limit`` cuts here); missing record fields
    become 'N/A'.  A row without one has blank metadata, 'N/A' as extractor
    and 'Unknown error' when no reason is known."""
    rec = F.col("has_record")
    blank = F.lit("")
    article = F.coalesce(F.col("article_text"), F.lit(NA))
    if char_limit is not None:
        article = F.left(article, F.lit(char_limit))
    cols = [F.col("url")]
    for c in RECORD_FIELDS[:-1]:
        cols.append(F.when(rec, F.coalesce(F.col(c), F.lit(NA))).otherwise(blank).alias(c))
    cols += [
        F.when(rec, F.col("llm_used")).otherwise(F.coalesce(F.col("llm_used"), F.lit(NA))).alias("llm_used"),
        F.col("status"),
        F.when(rec, blank).otherwise(F.coalesce(F.col("error_message"), F.lit(ERR_DEFAULT)))
        .alias("error_message"),
        F.when(rec, text.fix_mojibake(article)).otherwise(blank).alias("article_text"),
    ]
    return results.select(*keep, *cols)


def is_lonely(cols: list[str]) -> F.Column:
    """First cell non-blank, every other cell blank (a one-cell row is lonely)."""
    first = F.coalesce(py_strip(cols[0]), F.lit("")) != ""
    rest = [F.coalesce(py_strip(c), F.lit("")) == "" for c in cols[1:]]
    out = first
    for r in rest:
        out = out & r
    return out


def reprocess_lonely(rows: DataFrame, pages: DataFrame, blocked: DataFrame,
                     row_col: str = "row_no") -> DataFrame:
    """Rows holding only a URL go through the pipeline again; all other rows
    pass through unchanged.  ``row_col`` keeps the input order (sort at the sink)."""
    lonely = is_lonely(list(RESULT_COLUMNS))
    marked = rows.withColumn("_lonely", lonely)
    keep = marked.where(~F.col("_lonely")).select(row_col, *RESULT_COLUMNS)
    todo = marked.where(F.col("_lonely")).select(F.col(row_col).alias("pos"),
                                                  py_strip("url").alias("url"))
    redone = result_rows(process_urls(todo, pages, blocked), keep=("pos",)) \
        .withColumnRenamed("pos", row_col)
    return keep.unionByName(redone)


def outcome_split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a record, rows without one); url-parser rows count as records."""
    return results.where(F.col("has_record")), results.where(~F.col("has_record"))


def retry_candidates(results: DataFrame) -> DataFrame:
    """P10: rows not 'success' that still carry their payload."""
    return results.where((F.col("status") != STATUS_SUCCESS) & F.col("payload").isNotNull())


def result_preview(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P13 + P14: what the results view shows per row: a label, defaults for
    empty fields, the 'updated' date only when it differs, and an HTML-escaped
    text preview of at most 1,000 characters."""
    rec = F.col("has_record")

    def dflt(c, d):
        return text.fix_mojibake(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)))

    title = dflt("title", "Untitled Article")
    short_title = F.when(F.char_length(title) > 80, F.concat(F.left(title, F.lit(80)), F.lit("...")))\
        .otherwise(title)
    short_url = F.when(F.char_length("url") > 60, F.concat(F.left(F.col("url"), F.lit(60)), F.lit("...")))\
        .otherwise(F.col("url"))
    label = F.when(rec, F.concat(F.lit("✅ "), short_title)).otherwise(
        F.concat(F.lit("❌ "), short_url, F.lit(" ("), F.coalesce(F.col("status"), F.lit("Unknown")), F.lit(")")))
    published = dflt("published_date", NA)
    modified = dflt("modified_date", NA)
    body = text.fix_mojibake(F.coalesce(F.col("article_text"), F.lit("")))
    preview = F.when(F.char_length(body) > 1000, F.concat(F.left(body, F.lit(1000)), F.lit("..."))).otherwise(body)
    return results.select(
        *keep, "url", label.alias("label"),
        F.when(rec, title).alias("title"),
        F.when(rec, dflt("authors", NA)).alias("authors"),
        F.when(rec, dflt("source", NA)).alias("source"),
        F.when(rec, published).alias("published"),
        F.when(rec & (modified != NA) & (modified != published), modified).alias("updated"),
        F.when(rec & (body != ""), text.html_escape(preview)).alias("preview"),
    )
