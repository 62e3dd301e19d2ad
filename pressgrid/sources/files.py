"""File sources and sinks (SRC1, SRC3-SRC9, SRC11-SRC13, SNK1, SNK4, SNK5).

Everything is read with Spark's own data sources (text, csv, binaryFile), so
files are listed, split and read in parallel; per-file work happens in
columns of the file rows, never on the driver.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import charsets
from ..functions.text import CSV_TEXT_LIMIT
from ..operators.joins import broadcast_if_small
from ..functions.urls import is_valid_url, py_strip
from ..operators.urls import clean_lines
from ..session import stored
from . import csv_records

log = logging.getLogger(__name__)

# Upload limit and the messages of the intake form.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
ERR_TOO_LARGE = "File too large. Maximum size: {mb}MB"
ERR_SEEN = "File already processed. Upload a different file or modify the content."
ERR_NO_URLS = "No valid URLs found in file"
ERR_EMPTY_CSV = "CSV file is empty"
# The columns of a result table, in file order.
RESULT_SCHEMA = StructType([StructField(c, StringType()) for c in (
    "url", "title", "authors", "source", "published_date", "modified_date",
    "llm_used", "status", "error_message", "article_text")])
BOM = "\ufeff"
# Folders a corpus scan leaves out, and files read only in part.
IGNORED_DIRS = ("__pycache__", ".vscode", ".git", "node_modules")
HEAD_FILES = ("Links.csv", "temp.txt", "Enriched_Links_Updated.csv", "proxies_list.txt")
HEAD_LINES = 3


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (pos, url) for every non-blank stripped line; a missing file gives
    an empty table and a warning.  ``pos`` follows file order (unique, rising)."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("URL file not found: %s", path)
        return _empty(spark, StructType([StructField("pos", LongType()), StructField("url", StringType())]))
    lines = raw.withColumn("pos", F.monotonically_increasing_id())
    return clean_lines(lines, "value", "url").select("pos", "url")


def decode_text(content) -> F.Column:
    """SRC4: bytes as UTF-8 when they are valid UTF-8, else as Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    as_utf8 = c.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(c, "ISO-8859-1"))


def size_gate(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES, length_col: str = "length") -> DataFrame:
    """SRC5: add ``refused`` and the form's message for files over the limit."""
    too_big = F.col(length_col) > max_bytes
    msg = ERR_TOO_LARGE.format(mb=max_bytes // (1024 * 1024))
    return files.withColumn("refused", too_big).withColumn("error", F.when(too_big, F.lit(msg)))


def read_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES,
                 ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC3-SRC7 + J5 over a folder of uploads (``*.csv`` and ``*.txt``): ``(urls,
    outcome)`` as :func:`intake`, after one scan of the folder."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,txt}")
             .option("recursiveFileLookup", "true").load(path))
    return intake(files, ledger, max_bytes)


def upload_pieces(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """What the intake needs of every upload, in one pass over ``files(path, length,
    content)``: per file a row of its own (place -1: md5, length, error so far), the
    valid URLs of text files, and the tokens of CSV files."""
    is_csv = F.col("path").endswith(".csv")
    gated = size_gate(files.select("path", "length", "content"), max_bytes)
    raw = F.col("content").cast("string")
    read = F.when(F.col("refused"), F.lit(None)).when(is_csv & F.is_valid_utf8(raw), F.regexp_replace(raw, f"^{BOM}", ""))
    bound = gated.select(
        "path", "length", F.md5("content").alias("md5"), is_csv.alias("csv"), "error",
        (is_csv & ~F.col("refused") & ~F.is_valid_utf8(raw)).alias("unreadable"),
        csv_records.tokens(read).alias("toks"),
        F.when(~F.col("refused") & ~is_csv, decode_text("content")).alias("text"))
    lines = F.transform(F.split("text", "[\n,]", -1), lambda v: py_strip(v))
    urls = F.array_distinct(F.filter(lines, lambda v: is_valid_url(v)))
    told = (F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("unreadable"), csv_records.NOT_UTF8)
            .when(csv_records.has_open_quote(F.col("toks")), csv_records.OPEN_QUOTE))
    # All that a file says of itself goes into its own piece: a column beside the pieces
    # would be copied to every one of them.
    types = {"kind": "tinyint", "n": "int", "quoted": "boolean", "value": "string", "length": "bigint",
             "md5": "string", "error": "string"}

    def piece(**known):
        return F.struct(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    own = F.array(piece(length=F.col("length"), md5=F.col("md5"), error=told))
    cells = F.transform(csv_records.pieces(F.col("toks")), lambda p: piece(**{c: p[c] for c in list(types)[:4]}))
    texts = F.transform(urls, lambda v: piece(kind=F.lit(csv_records.CELL), value=v))
    return (bound.select("path", "csv", F.posexplode(F.concat(own, F.coalesce(cells, texts, F.array()))).alias("place", "p"))
            .select("path", "csv", (F.col("place") - 1).alias("place"), "p.*"))


def intake(files: DataFrame, ledger: DataFrame | None = None,
           max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Uploads ``files(path, length, content)`` -> ``(urls, outcome)``.

    ``urls(path, url)`` are the valid URLs of accepted files;
    ``outcome(path, md5, length, n_urls, error)`` has one row per file with
    ``error`` null when accepted.  Order of the checks: size gate (SRC5),
    hash already in ``ledger(md5)`` (J5), empty CSV, unreadable CSV, no valid URL (SRC7).
    Text files (``.txt``) are decoded UTF-8 first, Latin-1 when that fails
    (SRC4), then split on newlines and commas with values stripped (SRC2);
    CSV files (``.csv``) keep the leftmost column holding a valid URL, values as they
    are (SRC3, module ``csv_records``).

    The files are read in one pass, whose narrow rows (``upload_pieces``) and the URLs
    found in them are stored in the shared folder; everything after that reads those
    two tables.  Hashing, decoding and splitting are map-side, so many copies of one
    file (a hot hash) or one file with very many URLs cost no more than their narrow
    rows.  A file past the gate is at most ``max_bytes``.  A zero-byte file gives no row
    at all: Spark's file scans make no split for it (the form reported "CSV file is
    empty").
    """
    rows = stored(upload_pieces(files, max_bytes), "upload-pieces")
    numbers = csv_records.numbered(rows.where(F.col("csv") & (F.col("place") >= 0)), "path")
    text = rows.where(~F.col("csv") & (F.col("place") >= 0)).select("path", F.col("value").alias("url"))
    found = stored(text.unionByName(csv_records.url_column(csv_records.cells(numbers, "path"), "path").distinct()),
                   "upload-urls")
    meta = rows.where(F.col("place") == -1).select("path", "csv", "length", "md5", "error")
    meta = meta.join(csv_records.faults(numbers, "path"), "path", "left")
    if ledger is not None:
        seen = ledger.select("md5").distinct().withColumn("_seen", F.lit(True))
        meta = meta.join(broadcast_if_small(seen), "md5", "left")
    else:
        meta = meta.withColumn("_seen", F.lit(None).cast("boolean"))
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n_urls"))
    out = meta.join(counts, "path", "left")
    refused = F.col("error").isNotNull() & ~F.col("error").startswith(csv_records.ERR_CSV)
    wide = csv_records.too_wide(F.col("width"), F.col("widest"))
    error = (F.when(refused, F.col("error"))
             .when(F.col("_seen"), F.lit(ERR_SEEN))
             .when(F.col("error").isNotNull(), F.col("error"))
             .when(F.col("csv") & F.col("width").isNull(), F.lit(ERR_EMPTY_CSV))
             .when(wide.isNotNull(), wide)
             .when(F.coalesce(F.col("n_urls"), F.lit(0)) == 0, F.lit(ERR_NO_URLS)))
    # A refused file reports no URLs (they were not taken).
    told = out.select("path", "md5", "length", "n_urls", error.alias("error"))
    outcome = told.withColumn("n_urls", F.when(F.col("error").isNull(), F.col("n_urls")).otherwise(0).cast("bigint"))
    # One narrow row per file.  No count is run on this computed side: the plan
    # broadcasts it from its measured size, or splits a file that holds most URLs.
    accepted = outcome.where(F.col("error").isNull()).select("path")
    return found.join(accepted, "path", "left_semi"), outcome


def read_result_csv(spark: SparkSession, path: str, replace_header: bool = False) -> DataFrame:
    """SRC8 / SRC9: a result table written as CSV (header, BOM, quoted newlines).

    ``replace_header=True`` puts the ten result columns in place of the file's
    header; further columns keep their cells under ``_c10``, ``_c11``, ...
    Undecodable bytes become U+FFFD.
    """
    reader = (spark.read.option("header", "true").option("multiLine", "true")
              .option("escape", '"').option("encoding", "UTF-8"))
    if replace_header:
        wide = len(reader.csv(path).columns)
        more = [StructField(f"_c{i}", StringType()) for i in range(len(RESULT_SCHEMA.fields), wide)]
        reader = reader.schema(StructType(RESULT_SCHEMA.fields + more)).option("enforceSchema", "true")
    df = reader.csv(path)
    first = df.columns[0]
    if first.startswith(BOM):
        df = df.withColumnRenamed(first, first[len(BOM):])
    return df


def write_result_csv(df: DataFrame, path: str, bom: bool = True, partition_by: str | None = None,
                     mode: str = "overwrite") -> None:
    """SNK1: the ten result columns as CSV with a header, minimal quoting and
    (by default) a UTF-8 byte-order mark at the start of every part file.

    Empty cells stay empty (no ``""``) and padding is kept; the article text of a
    cell is cut at what spreadsheets hold.  Parquet remains the main sink and
    keeps everything; CSV is for people.
    """
    cols = [c.name for c in RESULT_SCHEMA.fields]
    out = df.select(*cols, *([partition_by] if partition_by else []))
    out = out.withColumn("article_text", F.left("article_text", F.lit(CSV_TEXT_LIMIT)))
    if bom:
        out = out.withColumnRenamed(cols[0], BOM + cols[0])
    w = (out.write.mode(mode).option("header", "true").option("escape", '"')
         .option("emptyValue", "").option("nullValue", "")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false"))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def append_lines(df: DataFrame, col: str, path: str) -> None:
    """SNK5: append one text line per row."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("append").text(path)


def path_is_ignored(rel_path) -> F.Column:
    """Some part of the relative path starts with '.' or is an ignored folder."""
    p = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    ignored = F.array(*[F.lit(d) for d in IGNORED_DIRS])
    return F.exists(F.split(p, "/"), lambda part: part.startswith(".") | F.array_contains(ignored, part))


def head_lines(text, n: int = HEAD_LINES) -> F.Column:
    """The first ``n`` lines with their line ends (all of them when fewer)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, rf"^((?:[^\n]*\n){{0,{n - 1}}}[^\n]*\n?)", 1)


def universal_newlines(text) -> F.Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def corpus_content(name, text, head_names=HEAD_FILES, n: int = HEAD_LINES) -> F.Column:
    """SRC13: named files give their first ``n`` lines, all others the whole text."""
    nm = F.col(name) if isinstance(name, str) else name
    t = F.col(text) if isinstance(text, str) else text
    return F.when(nm.isin(*head_names), head_lines(t, n)).otherwise(t)


def scan_corpus(spark: SparkSession, path: str, head_names=HEAD_FILES, n: int = HEAD_LINES) -> DataFrame:
    """SRC12: (path, content) for every file under ``path``, relative paths with
    '/', undecodable bytes dropped, text-mode newlines.  Hidden files and the
    ignored folders are left out (Spark's listing already skips names that
    start with '.' or '_')."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "content"))
    root = path.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^(?:file:)?/*" + _rx_escape(root.lstrip("/")), "")
    text = universal_newlines(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")),
                                               "\ufffd", ""))
    name = F.substring_index(rel, "/", -1)
    out = files.select(rel.alias("path"), name.alias("_name"), text.alias("_text"))
    out = out.where(~path_is_ignored("path"))
    return out.select("path", corpus_content("_name", "_text", head_names, n).alias("content"))


def _rx_escape(s: str) -> str:
    import re
    return re.escape(s)


def page_text(content) -> F.Column:
    """SRC11: page bytes to text: byte-order mark (UTF-8 or UTF-16), UTF-16 without a
    mark, then the character set declared anywhere in the page (module ``charsets``),
    then UTF-8 when valid, else windows-1252, which browsers use for all of Latin-1.  A
    page that declares UTF-8 but is not is read as windows-1252 too."""
    def read(b):
        def decoded(latin):
            bom16 = F.hex(F.substring(b, 1, 2)).isin("FFFE", "FEFF")
            bom8 = F.hex(F.substring(b, 1, 3)) == "EFBBBF"
            as_utf8 = b.cast("string")
            order = charsets.unmarked_utf16(b)
            return (F.when(bom8, F.substring(as_utf8, 2, 1 << 30))
                    .when(bom16, F.decode(b, "UTF-16"))
                    .when(order == "UTF-16LE", F.decode(b, "UTF-16LE"))
                    .when(order == "UTF-16BE", F.decode(b, "UTF-16BE"))
                    .when(stated.isNotNull(), stated)
                    .when(F.is_valid_utf8(as_utf8), as_utf8)
                    .otherwise(charsets.single_byte(latin, "cp1252")))
        return decoded(F.decode(b, "ISO-8859-1"))

    c = F.col(content) if isinstance(content, str) else content
    latin = F.decode(c, "ISO-8859-1")
    label = F.regexp_extract(F.lower(latin), r"<(?:meta[^>]+charset|\?xml[^>]+encoding)\s*=\s*[\"']?([a-z0-9_:.-]+)", 1)
    stated = charsets.declared_text(c, latin, label)
    return read(c)


def write_page_store(pages: DataFrame, table: str, buckets: int, url_col: str = "url",
                     mode: str = "overwrite") -> None:
    """Keep a page table bucketed (and sorted) by URL.

    The URL pipeline semi-joins the page store with the wanted URLs and joins
    results back on the URL; with the store bucketed on ``url`` those joins
    shuffle only the URL side, never the page HTML.  Choose ``buckets`` so a
    bucket file is a few hundred MB.
    """
    (pages.write.mode(mode).format("parquet").bucketBy(buckets, url_col).sortBy(url_col)
     .saveAsTable(table))
