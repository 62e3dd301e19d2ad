"""Registered queries: one per operator of the inventory, over the driver's tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame of scalar
columns whose names match the DuckDB oracle in ``oracles.py``.  Every query
reads whole tables; inputs the tables lack are derived in ``inputs.py``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, extract, html, jsonld, llm_output, text
from ..functions.urls import base_url, has_scheme, is_valid_url, py_strip
from ..operators import enrich, joins, ordering, stats
from ..operators import text as text_ops
from ..operators import urls as url_ops
from ..sources import files
from . import inputs, pipeline

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query = None, *, name: str | None = None):
    def reg(f: Query) -> Query:
        REGISTRY[name or f.__name__] = f
        return f
    return reg(fn) if fn is not None else reg


def _t(spark, sf, name):
    return inputs.table(spark, sf, name)


def _pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", "url", "html")


def _rich(spark, sf):
    return inputs.rich_pages(_pages(spark, sf))


# --- HTML -------------------------------------------------------------------

@query
def clean_content(spark, sf):
    """H1 -> H2 -> H3 on every page."""
    p = _pages(spark, sf).withColumn("_parts", html.page_parts("html"))
    return p.select("page_id", html.main_text("_parts").alias("content"))


@query
def strip_boilerplate(spark, sf):
    return _pages(spark, sf).select("page_id", html.strip_boilerplate("html").alias("stripped"))


@query
def main_content(spark, sf):
    return _rich(spark, sf).select("page_id", html.main_content("html").alias("main_html"))


@query
def raw_html_for_dates(spark, sf):
    return _rich(spark, sf).select("page_id", html.raw_html_for_dates("html").alias("raw_html"))


@query
def paragraph_text(spark, sf):
    return _pages(spark, sf).select("page_id", html.paragraph_text("html").alias("paragraph_text"))


@query
def jsonld_blocks(spark, sf):
    p = _rich(spark, sf).select("page_id", jsonld.jsonld_blocks("html").alias("b"))
    return p.select("page_id", F.posexplode("b").alias("block_no", "block")) \
        .withColumn("block_no", F.col("block_no").cast("bigint"))


@query
def jsonld_wrapper(spark, sf):
    w = _rich(spark, sf).select("page_id", jsonld.jsonld_wrapper("html").alias("w"))
    return w.where(F.col("w").isNotNull()).select(
        "page_id", F.size("w.ld_json_list").cast("bigint").alias("n_blocks"),
        F.col("w.article_text").alias("article_text"))


@query
def jsonld_has_dates(spark, sf):
    b = jsonld_blocks(spark, sf)
    return b.select("page_id", "block_no", jsonld.has_dates("block").alias("has_dates"))


@query
def jsonld_fields(spark, sf):
    p = _rich(spark, sf).withColumn("ld_blocks", jsonld.jsonld_blocks("html"))
    p = p.where(F.size("ld_blocks") > 0).withColumn("c", jsonld.jsonld_candidates("ld_blocks"))
    p = p.withColumn("f", jsonld.jsonld_fields("ld_blocks", "c"))
    return p.select("page_id", "f.title", "f.authors", "f.source", "f.published", "f.modified")


@query
def table_endpoints(spark, sf):
    t = inputs.endpoint_tables(_t(spark, sf, "events"))
    return text_ops.table_endpoints(t, "html", ["event_id"]).withColumn("pos", F.col("pos").cast("bigint"))


# --- Extraction ---------------------------------------------------------------

@query
def page_metadata(spark, sf):
    m = pipeline.page_metadata(_rich(spark, sf))
    return m.select("page_id", *pipeline.RECORD_FIELDS)


@query
def url_metadata(spark, sf):
    u = inputs.dated_urls(_t(spark, sf, "events"))
    r = extract.with_url_metadata(u.select("event_id", "url"), "url", "m")
    return r.select("event_id", "url", *[F.col(f"m.{c}").alias(c) for c in pipeline.RECORD_FIELDS])


@query
def build_payload(spark, sf):
    p = pipeline.build_payload(_rich(spark, sf))
    return p.select("page_id", F.col("payload.website_content").alias("website_content"),
                    F.col("payload.json_ld").isNotNull().alias("has_json_ld"),
                    F.col("payload.json_ld.article_text").alias("ld_article_text"),
                    F.col("payload.raw_html_for_dates").alias("raw_html_for_dates"))


@query
def payload_text(spark, sf):
    """The payload as JSON text, cut at 50,000 characters."""
    return pipeline.build_payload(_rich(spark, sf)).select("page_id", "payload_text")


# --- Dates --------------------------------------------------------------------

@query
def afp_datetime(spark, sf):
    u = inputs.dated_urls(_t(spark, sf, "events"))
    return u.select("event_id", dates.afp_datetime("url").alias("afp_datetime"))


@query
def afp_enrich(spark, sf):
    log = inputs.result_log(_t(spark, sf, "events"))
    return enrich.enrich_afp(log).select("event_id", "source", "published_date", "modified_date")


def _stamp_strings(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    s = (F.when(eid % 5 == 0, F.concat(base, F.lit("Z")))
         .when(eid % 5 == 1, F.concat(base, F.lit(".250+02:00")))
         .when(eid % 5 == 2, base)
         .when(eid % 5 == 3, F.date_format("ts", "yyyy-MM-dd"))
         .otherwise(F.concat(base, F.lit("-0700"))))
    return events.select("event_id", s.alias("stamp"))


@query
def to_eastern(spark, sf):
    s = _stamp_strings(_t(spark, sf, "events"))
    return s.select("event_id", "stamp", dates.to_eastern("stamp").alias("eastern"))


# --- URLs -----------------------------------------------------------------------

def _lines(spark, sf):
    return inputs.url_lines_raw(_pages(spark, sf))


@query
def url_lines(spark, sf):
    return url_ops.clean_lines(_lines(spark, sf), "line").select("line_no", "url")


@query
def validate_url(spark, sf):
    return _lines(spark, sf).select("line_no", "line", is_valid_url("line").alias("valid"))


@query
def scheme_check(spark, sf):
    return _lines(spark, sf).select("line_no", has_scheme("line").alias("has_scheme"))


@query(name="base_url")
def base_url_q(spark, sf):
    u = inputs.dated_urls(_t(spark, sf, "events"))
    return u.select("event_id", base_url("url").alias("base_url"))


@query
def urls_from_text(spark, sf):
    return url_ops.split_urls(inputs.url_blobs(_pages(spark, sf)), "blob", ["blob_id"])


def _csv_rows(pages: DataFrame) -> DataFrame:
    """Header-less three-column CSV rows, 25 per file; URLs in column 0 for
    every third file, in column 1 (padded) otherwise, never in column 2."""
    pid = F.col("page_id")
    fid = F.floor(pid / 25)
    c0 = F.when(fid % 3 == 0, F.when(pid % 4 == 0, F.col("url"))).otherwise(
        F.concat(F.lit("row "), pid.cast("string")))
    c1 = F.concat(F.lit(" "), F.col("url"))
    c2 = F.concat(F.lit("note "), (pid % 7).cast("string"))
    return pages.select(fid.alias("file_id"), c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))


@query
def urls_from_csv_column(spark, sf):
    rows = _csv_rows(_pages(spark, sf))
    return url_ops.discover_url_column(rows, "file_id", ["c0", "c1", "c2"])


@query
def distinct_urls(spark, sf):
    lines = url_ops.clean_lines(_lines(spark, sf), "line")
    return lines.select(base_url("url").alias("base_url")).distinct()


def _page_urls(spark, sf):
    return _pages(spark, sf).select("page_id", "url")


def _blocked(spark, sf):
    return inputs.blocked_list(_pages(spark, sf))


@query
def blocked_urls(spark, sf):
    return url_ops.blocked_urls(_page_urls(spark, sf), _blocked(spark, sf)).select("page_id", "url")


@query
def open_urls(spark, sf):
    return url_ops.open_urls(_page_urls(spark, sf), _blocked(spark, sf)).select("page_id", "url")


@query
def route_urls(spark, sf):
    return url_ops.route(_page_urls(spark, sf), _blocked(spark, sf)).select("page_id", "url", "base_url",
                                                                            "blocked")


@query
def page_lookup(spark, sf):
    lines = url_ops.clean_lines(_lines(spark, sf), "line").select("line_no", "url")
    # Only what is asked of a page crosses the join, and a URL listed very often is salted.
    pages = _pages(spark, sf).select("url", F.char_length("html").alias("chars"))
    j = joins.salted_lookup_join(lines, pages, "url", "left", salt_from="line_no")
    return j.select("line_no", "url", F.col("chars").isNotNull().alias("found"),
                    F.coalesce("chars", F.lit(0)).cast("bigint").alias("html_chars"))


@query
def row_labels(spark, sf):
    lines = url_ops.clean_lines(_lines(spark, sf), "line").select("line_no", "url")
    n = ordering.number_rows(lines, ["line_no"])
    return n.select("line_no", "row_no", F.concat(F.col("row_no").cast("string"), F.lit("/"),
                                                  F.col("total").cast("string")).alias("label"))


ROW_SLICE = (10, 110)


@query
def row_slice(spark, sf):
    lines = url_ops.clean_lines(_lines(spark, sf), "line").select("line_no", "url")
    n = ordering.number_rows(lines, ["line_no"], total_col=None)
    return ordering.row_slice(n, "row_no", *ROW_SLICE).select("line_no", "url")


BATCH_CAP = 8


@query
def batch_cap(spark, sf):
    u = url_ops.split_urls(inputs.url_blobs(_pages(spark, sf)), "blob", ["blob_id"])
    c = url_ops.cap_batch(u, "blob_id", BATCH_CAP)
    return c.select("blob_id", "url", "batch_size", "refused", "error")


# --- Result tables and stats ----------------------------------------------------

def _log(spark, sf):
    return inputs.result_log(_t(spark, sf, "events"))


@query
def run_stats(spark, sf):
    return stats.run_stats(_log(spark, sf))


@query
def running_progress(spark, sf):
    p = stats.running_progress(_log(spark, sf))
    return p.select("event_id", "run_id", "completed", "successful_so_far", "total")


@query
def outcome_split(spark, sf):
    log = _log(spark, sf).withColumn("has_record", F.col("status").startswith("success"))
    ok, bad = pipeline.outcome_split(log)
    return ok.select("event_id", F.lit("successful").alias("side")).unionByName(
        bad.select("event_id", F.lit("failed").alias("side")))


@query
def retry_candidates(spark, sf):
    log = _log(spark, sf).withColumn(
        "payload", F.when(F.col("event_id") % 2 == 0, F.col("article_text")))
    return pipeline.retry_candidates(log).select("event_id", "status")


@query
def result_preview(spark, sf):
    log = _log(spark, sf).withColumn("has_record", F.col("status").startswith("success"))
    return pipeline.result_preview(log, keep=("event_id",))


def _old_results(spark, sf):
    """A result table keyed by row_no: every sixth page holds only its URL."""
    p = _pages(spark, sf)
    pid = F.col("page_id")
    lonely = pid % 6 == 0
    cells = {
        "title": F.concat(F.lit("Old "), pid.cast("string")), "authors": F.lit("N/A"),
        "source": F.lit("Wire"), "published_date": F.lit("2025-01-01"),
        "modified_date": F.lit("2025-01-01"), "llm_used": F.lit("page-rules"),
        "status": F.lit("success"), "error_message": F.lit(""),
        "article_text": F.lit("kept"),
    }
    cols = [pid.alias("row_no"), F.concat(F.lit(" "), F.col("url")).alias("url")]
    cols += [F.when(lonely, F.when(pid % 12 == 0, F.lit(" ")).otherwise(F.lit(""))).otherwise(v).alias(k)
             for k, v in cells.items()]
    return p.select(*cols)


@query
def lonely_rows(spark, sf):
    rows = _old_results(spark, sf)
    return rows.select("row_no", pipeline.is_lonely(list(pipeline.RESULT_COLUMNS)).alias("lonely"))


@query
def reprocess_lonely(spark, sf):
    rows = _old_results(spark, sf)
    return pipeline.reprocess_lonely(rows, _rich(spark, sf), _blocked(spark, sf))


def _url_list(spark, sf):
    """The URL list the pipeline runs on: every page URL as a line (stripped
    or not), followed by every dated URL (no stored page: scraping errors)."""
    lines = _lines(spark, sf).select(F.col("line_no").alias("pos"), py_strip("line").alias("url"))
    dated = inputs.dated_urls(_t(spark, sf, "events")).select(
        (F.col("event_id") + 1_000_000_000).alias("pos"), "url")
    return lines.unionByName(dated)


@query
def process_urls(spark, sf):
    r = pipeline.process_urls(_url_list(spark, sf), _rich(spark, sf), _blocked(spark, sf))
    return r.select("pos", "url", "status", "llm_used", "error_message", *pipeline.RECORD_FIELDS)


@query
def result_rows(spark, sf):
    r = pipeline.process_urls(_url_list(spark, sf), _rich(spark, sf), _blocked(spark, sf))
    return pipeline.result_rows(r, keep=("pos",))


# --- Text -------------------------------------------------------------------------

def _docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text")


@query
def collapse_ws(spark, sf):
    return _docs(spark, sf).select("doc_id", text.collapse_ws("text").alias("collapsed"))


@query
def scrub_text(spark, sf):
    return text_ops.scrub_text(_docs(spark, sf), "text").select("doc_id", "scrubbed")


# What follows a document's text by ``doc_id % 12``, one kind of escape each.
ESCAPES = (r"\n", r"\t|\v|\f", r"\'q\"", r"\x41\x7a", r"\u00e9\u2014", r"\U0001F600", r"\101\60", r"\ud83d\ude00",
           r"\\n", r"\q\8", r"\u12", r"x\ud83d!")


@query
def scrub_escapes(spark, sf):
    """T3 on texts with escapes of every kind, a cut-off one and a lone half."""
    d = _docs(spark, sf)
    tail = F.get(F.array(*[F.lit(e) for e in ESCAPES]), (F.col("doc_id") % len(ESCAPES)).cast("int"))
    return text_ops.scrub_text(d.select("doc_id", F.concat("text", F.lit(" "), tail).alias("text")), "text") \
        .select("doc_id", "scrubbed")


@query
def scrub_text_legacy(spark, sf):
    """T4: the original decoder's behaviour (UTF-8 bytes read as Latin-1)."""
    return text_ops.scrub_text(_docs(spark, sf), "text", legacy=True).select("doc_id", "scrubbed")


def _mojibake_inputs(docs: DataFrame) -> DataFrame:
    once = text.utf8_as_latin1("text")
    twice = F.translate(text.utf8_as_latin1(once), text.CP1252_BYTES, text.CP1252_SPECIALS)
    k = F.col("doc_id") % 3
    return docs.select("doc_id", F.when(k == 0, F.col("text")).when(k == 1, once).otherwise(twice)
                       .alias("input"))


@query
def fix_mojibake(spark, sf):
    """T2 on plain, once- and twice-mis-decoded text (also checked against
    Python's codecs in tests/test_text.py)."""
    m = _mojibake_inputs(_docs(spark, sf))
    return m.select("doc_id", F.md5(text.fix_mojibake("input")).alias("fixed_md5"))


@query
def truncate_content(spark, sf):
    t = text.truncate_content(text.collapse_ws("text"))
    return _docs(spark, sf).select("doc_id", F.char_length(t).cast("bigint").alias("n_chars"),
                                   F.md5(t).alias("text_md5"))


@query
def extract_endpoints(spark, sf):
    t = inputs.endpoint_text(_t(spark, sf, "events"))
    return text_ops.extract_endpoints(t, "text", ["event_id"]).withColumn("pos", F.col("pos").cast("bigint"))


# --- Model responses ----------------------------------------------------------------

def _responses(spark, sf):
    return inputs.model_responses(_t(spark, sf, "conversations"))


@query
def llm_json_span(spark, sf):
    r = _responses(spark, sf).select("id", llm_output.json_span("response").alias("s"))
    return r.select("id", "s.span", "s.error")


def _validated(spark, sf):
    return llm_output.validate_responses(_responses(spark, sf), "response")


@query
def llm_json_repair(spark, sf):
    r = _validated(spark, sf)
    # parse_rung 0: no JSON span to parse (the row carries an error instead).
    return r.select("id", F.coalesce("parse_rung", F.lit(0)).cast("bigint").alias("parse_rung"), "json")


@query
def llm_validate(spark, sf):
    r = _validated(spark, sf)
    return r.select("id", "error", F.coalesce("parse_rung", F.lit(0)).cast("bigint").alias("parse_rung"),
                    *llm_output.RECORD_FIELDS, F.coalesce("valid", F.lit(False)).alias("valid"))


@query
def llm_yield(spark, sf):
    v = llm_validate(spark, sf).withColumn("valid", F.coalesce("valid", F.lit(False)))
    return stats.response_yield(v)


# --- Sources ----------------------------------------------------------------------

def _page_bytes(spark, sf):
    """Page HTML as bytes: UTF-8, with one stray 0xE9 byte after every third page."""
    p = _pages(spark, sf)
    tail = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit("")))
    return p.select("page_id", F.concat(F.encode("html", "UTF-8"), tail).alias("content"))


@query
def decode_text_fallback(spark, sf):
    b = _page_bytes(spark, sf)
    t = files.decode_text("content")
    return b.select("page_id", (~F.is_valid_utf8(F.col("content").cast("string"))).alias("latin1"),
                    F.char_length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("text_md5"))


def _upload_files(spark, sf):
    """Each URL blob as an uploaded text file (path, length, content)."""
    b = inputs.url_blobs(_pages(spark, sf))
    content = F.encode("blob", "UTF-8")
    return b.select(F.concat(F.lit("upload-"), F.col("blob_id").cast("string"), F.lit(".txt")).alias("path"),
                    F.octet_length(content).cast("bigint").alias("length"), content.alias("content"),
                    "blob_id")


@query
def size_gate(spark, sf):
    f = files.size_gate(_upload_files(spark, sf))
    return f.select("path", "length", "refused", "error")


def _ledger(f: DataFrame) -> DataFrame:
    """Hashes recorded by an earlier run: every fifth upload."""
    return f.where(F.col("blob_id") % 5 == 0).select(F.md5("content").alias("md5"))


@query
def intake_outcome(spark, sf):
    f = _upload_files(spark, sf)
    _, outcome = files.intake(f.drop("blob_id"), ledger=_ledger(f))
    return outcome.select("path", "n_urls", "error")


@query
def intake_urls(spark, sf):
    f = _upload_files(spark, sf)
    urls, _ = files.intake(f.drop("blob_id"), ledger=_ledger(f))
    return urls.select("path", "url")


@query
def content_hash_dedupe(spark, sf):
    d = _docs(spark, sf).withColumn("md5", F.md5("text"))
    return d.groupBy("md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def content_ledger_anti(spark, sf):
    d = _docs(spark, sf).withColumn("md5", F.md5("text"))
    ledger = d.where(F.col("doc_id") % 4 == 0).select("md5")
    return url_ops.drop_seen(d, ledger).select("doc_id")


CORPUS_DIRS = ["src", ".git", "docs/__pycache__", "data", "node_modules/pkg"]
CORPUS_NAMES = ["Links.csv", "temp.txt", "notes.md", "proxies_list.txt", "main.py", ".env"]


def _corpus(spark, sf):
    d = _docs(spark, sf)
    did = F.col("doc_id")
    name = inputs._pick(did % 6, CORPUS_NAMES)
    path = F.concat(inputs._pick(did % 5, CORPUS_DIRS), F.lit("/d"), did.cast("string"), F.lit("/"), name)
    return d.select("doc_id", path.alias("path"), name.alias("name"), "text")


@query
def head_lines(spark, sf):
    c = _corpus(spark, sf)
    return c.select("doc_id", "path", files.corpus_content("name", files.universal_newlines("text"))
                    .alias("content"))


@query
def path_filter(spark, sf):
    c = _corpus(spark, sf)
    return c.select("doc_id", "path", (~files.path_is_ignored("path")).alias("kept"))


def _folder(spark, name):
    """A fresh folder under the shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Documents to a folder of the written corpus.
DOCS_PER_FOLDER = 25


@query
def corpus_scan(spark, sf):
    """SRC12: the documents written as files, a folder for every few of them, and
    scanned back; a document is a line (its newlines are written as tabs)."""
    d = _docs(spark, sf)
    line = F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.regexp_replace("text", "[\r\n]", "\t"))
    out = _folder(spark, "corpus")
    (d.select(line.alias("value"), (F.col("doc_id") / DOCS_PER_FOLDER).cast("bigint").alias("folder"))
     .repartition("folder").write.partitionBy("folder").text(out))
    c = files.scan_corpus(spark, out).where(F.col("path").endswith(".txt"))
    lines = c.select(F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("bigint").alias("folder"),
                     F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n", -1)).alias("line"))
    return lines.select("folder", F.substring_index("line", "|", 1).cast("bigint").alias("doc_id"),
                        F.md5("line").alias("line_md5"))


@query
def url_file_lines(spark, sf):
    """SRC1: the URL lines written as a text file and read back."""
    out = _folder(spark, "url-lines")
    _lines(spark, sf).select(F.col("line").alias("value")).write.text(out)
    return files.read_url_lines(spark, out).select("url")


@query
def upload_files(spark, sf):
    """SRC6, SRC7: every URL blob written as an upload file and taken in; the valid
    URLs of accepted files."""
    b = inputs.url_blobs(_pages(spark, sf))
    out = _folder(spark, "uploads")
    b.select("blob_id", "blob").repartition("blob_id").write.partitionBy("blob_id").text(out)
    urls, outcome = files.read_uploads(spark, out)
    blob = F.regexp_extract("path", "blob_id=([0-9]+)/", 1).cast("bigint")
    n = urls.select(blob.alias("blob_id"), "url")
    told = outcome.select(blob.alias("blob_id"), "n_urls", "error")
    return told.join(n, "blob_id", "left")


# Pages to an upload, and kinds of uploads.
PAGES_PER_CSV, CSV_KINDS = 10, 7


def _csv_uploads(pages: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, note, link, extra): a CSV upload of every few pages.
    The kinds by ``file_id % 7``: 1 links first, 2 no link, 3 a quote left open, 4 a wider
    record, else links second beside a note with commas, quotes and a line end."""
    pid = F.col("page_id")
    file_id = F.floor(pid / PAGES_PER_CSV)
    kind = file_id % CSV_KINDS
    note = F.concat(F.lit('said "'), pid.cast("string"), F.lit('",\nhttps://in.note/'), pid.cast("string"))
    return pages.select(file_id.alias("file_id"), pid.alias("line_no"), kind.alias("kind"),
                        F.when(kind == 1, F.col("url")).otherwise(note).alias("note"),
                        F.when(kind == 2, "none").otherwise(F.concat(F.lit(" "), F.col("url"))).alias("link"),
                        F.col("url").alias("extra"))


@query
def upload_csv_files(spark, sf):
    """SRC3, SRC6, SRC7: CSV uploads with quoted line ends, open quotes and uneven
    records, written as files and taken in; one row per URL or refused file."""
    rows = _csv_uploads(_pages(spark, sf))
    out = _folder(spark, "csv-uploads")
    cell = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in ("note", "link")]
    first = F.col("line_no") % PAGES_PER_CSV == 0
    last = F.col("line_no") % PAGES_PER_CSV == PAGES_PER_CSV - 1
    line = F.concat_ws(",", *cell, F.when((F.col("kind") == 4) & ~first, F.col("extra")))
    line = F.concat(line, F.when((F.col("kind") == 3) & last, ',"').otherwise(""))
    # A row for each line of the file, written without quoting, so that the lines reach
    # the files as they are.
    (rows.select("file_id", "line_no", F.posexplode(F.split(line, "\n", -1)).alias("part", "line"))
     .repartition("file_id").sortWithinPartitions("file_id", "line_no", "part").select("file_id", "line")
     .write.partitionBy("file_id").option("quote", "").option("escape", "").option("sep", "\t")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(out))
    urls, outcome = files.read_uploads(spark, out)
    file_id = F.regexp_extract("path", "file_id=([0-9]+)/", 1).cast("bigint")
    told = outcome.select(file_id.alias("file_id"), "n_urls", "error")
    return told.join(urls.select(file_id.alias("file_id"), "url"), "file_id", "left")


@query
def result_csv_replaced_header(spark, sf):
    """SRC9: result rows written as CSV and read under the ten result columns,
    whatever the file's header says."""
    r = pipeline.result_rows(pipeline.process_urls(_url_list(spark, sf), _rich(spark, sf), _blocked(spark, sf)))
    out = _folder(spark, "result-csv")
    files.write_result_csv(r, out, bom=False)
    return files.read_result_csv(spark, out, replace_header=True)


@query
def appended_lines(spark, sf):
    """SNK5: the endpoints found in the event texts appended as lines in two
    writes and read back."""
    t = inputs.endpoint_text(_t(spark, sf, "events"))
    e = text_ops.extract_endpoints(t, "text", ["event_id"])
    out = _folder(spark, "endpoints")
    for half in (0, 1):
        files.append_lines(e.where(F.col("event_id") % 2 == half), "endpoint", out)
    return spark.read.text(out).select(F.col("value").alias("endpoint"))


@query
def stream_pages(spark, sf):
    """ST3: the URL list read as a stream and run through the pipeline per micro-batch."""
    from ..streaming import jobs
    src = _folder(spark, "url-stream")
    _url_list(spark, sf).write.parquet(src)
    urls = spark.readStream.schema("pos bigint, url string").parquet(src)
    out = jobs.run_to_table(urls, "stream-pages", batch_fn=jobs.stream_pages(_rich(spark, sf), _blocked(spark, sf)))
    return spark.read.parquet(out).select("pos", *pipeline.RESULT_COLUMNS)


@query
def page_decode(spark, sf):
    """SRC11: pages stored as Latin-1 with a declared charset
    (page_id%4=0, when the page fits Latin-1), with a byte-order mark (%4=1),
    or as plain UTF-8."""
    p = _pages(spark, sf)
    k = F.col("page_id") % 4
    fits = F.col("html").rlike(text.LATIN1_ONLY)
    declared = F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.lit('<meta charset="iso-8859-1">'))
    content = (F.when((k == 0) & fits, F.encode(declared, "ISO-8859-1"))
               .when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8")))
               .otherwise(F.encode("html", "UTF-8")))
    t = files.page_text(content)
    return p.select("page_id", F.md5(t).alias("text_md5"))


@query
def result_csv_roundtrip(spark, sf):
    """SNK1 -> SRC8: result rows written as CSV with a BOM in the shared
    checkpoint folder and read back (empty cells come back as null)."""
    r = pipeline.result_rows(pipeline.process_urls(_url_list(spark, sf), _rich(spark, sf), _blocked(spark, sf)))
    out = _folder(spark, "result-csv")
    files.write_result_csv(r, out)
    return files.read_result_csv(spark, out)


# --- Streaming ----------------------------------------------------------------------

@query
def stream_progress(spark, sf):
    """ST2: the result log read as a stream of event files; totals per status."""
    from ..streaming import jobs
    schema = _t(spark, sf, "events").schema
    events = (spark.readStream.format("parquet").schema(schema)
              .option("pathGlobFilter", "events.parquet").load(sf))
    out = jobs.run_to_table(jobs.stream_progress(inputs.result_log(events)), "stream-progress", "complete")
    return spark.read.parquet(out)


@query
def stream_intake(spark, sf):
    """ST1: every URL blob dropped as an upload file (every fifth one twice);
    the stream keeps one row per distinct content."""
    from ..streaming import jobs
    b = inputs.url_blobs(_pages(spark, sf))
    copies = b.where(F.col("blob_id") % 5 == 0).withColumn("blob_id", F.col("blob_id") + 1_000_000)
    drop = jobs.checkpoint_path(spark, f"uploads-{__import__('uuid').uuid4().hex}")
    b.unionByName(copies).write.partitionBy("blob_id").text(drop)
    out = jobs.run_to_table(jobs.stream_intake(spark, drop), "stream-intake")
    return spark.read.parquet(out).select("md5", "length", "refused")
