"""CSV uploads without a schema: cells by record and column number (SRC3, SRC7).

A file's text becomes tokens by one regular expression: runs of commas, runs of line
ends, plain stretches, and quoted pieces (``"a""b"`` is two pieces in a row, so the
pattern never repeats a group and needs no stack).  Tokens are rows of their own after
that; running sums over a file's tokens number its records and columns.  There is no
width anywhere: a file may have one column or ten million, and each file its own.

Before the rows leave the scan, cells that cannot be a URL shrink to a mark, and those
beside a comma go altogether, since the comma already proves the record.  A file is at
most the upload limit, which bounds its tokens.

As the intake form read CSV: records are lines, blank lines are skipped, blanks before
a record's first cell are dropped, a quote inside an unquoted cell is a plain
character, and the first record sets the width.  A file whose text is not UTF-8, whose
last quote is never closed, or that has a record wider than the first is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_valid_url

TOKEN = r'"[^"]*+"?+|[^",\r\n][^,\r\n]*+|,++|[\r\n]++'
# Fixed value: how the form's messages for unreadable CSV begin.
ERR_CSV = "Error reading CSV: "
NOT_UTF8 = ERR_CSV + "the file is not UTF-8 text"
OPEN_QUOTE = ERR_CSV + "a quoted cell is not closed"
COMMAS, LINE, CELL = 0, 1, 2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_open_quote(toks: Column) -> Column:
    """The last token is a quoted piece without its closing quote."""
    last = F.try_element_at(toks, F.lit(-1))
    return F.coalesce(last.startswith('"') & ((F.char_length(last) == 1) | ~last.endswith('"')), F.lit(False))


def _kind(tok: Column) -> Column:
    first = F.left(tok, F.lit(1))
    return F.when(first == ",", COMMAS).when(first.isin("\r", "\n"), LINE).when(first.isNotNull(), CELL)


def pieces(toks: Column) -> Column:
    """array<struct<kind, n, quoted, value>> of a file's tokens: for commas their
    number; for a cell its piece, null when the cell holds no URL."""
    def piece(tok, i):
        # Neighbours outside the file count as line ends.
        around = [F.coalesce(_kind(F.get(toks, i + d)), F.lit(LINE)) for d in (-1, 1)]
        kind, quoted = _kind(tok), tok.startswith('"')
        closed = quoted & (F.char_length(tok) > 1) & tok.endswith('"')
        bare = (F.when(closed, F.substr(tok, F.lit(2), F.char_length(tok) - 2))
                .when(quoted, F.substr(tok, F.lit(2))).otherwise(tok))
        alone = (around[0] != CELL) & (around[1] != CELL)
        whole_line = (around[0] == LINE) & (around[1] == LINE)
        blank = ~quoted & (F.btrim(tok, F.lit(" \t")) == "")
        needless = (kind == CELL) & alone & ~is_valid_url(bare) & (~whole_line | blank)
        value = F.when((kind == CELL) & ~(alone & ~is_valid_url(bare)), bare)
        return F.struct(F.when(~needless, kind).cast("tinyint").alias("kind"),
                        F.when(kind == COMMAS, F.char_length(tok)).otherwise(0).alias("n"),
                        quoted.alias("quoted"), value.alias("value"))

    return F.filter(F.transform(toks, piece), lambda p: p["kind"].isNotNull())


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, place, kind, n, quoted, value) with record and column numbers."""
    upto = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    line = (F.col("kind") == LINE).cast("int")
    out = rows.select("*", F.coalesce(F.sum(line).over(before), F.lit(0)).alias("record"),
                      F.sum("n").over(upto).alias("commas"))
    began = F.max(F.when(F.col("kind") == LINE, F.col("commas")).otherwise(0)).over(before)
    return out.withColumn("column", F.col("commas") - F.coalesce(began, F.lit(0)))


def cells(numbers: DataFrame, key: str) -> DataFrame:
    """(key, record, column, value) of the cells that may hold a URL.  The pieces of
    one cell are joined, with a quote between two quoted ones."""
    piece = F.struct("place", "quoted", "value")
    grouped = (numbers.where((F.col("kind") == CELL) & F.col("value").isNotNull())
               .groupBy(key, "record", "column").agg(F.array_sort(F.collect_list(piece)).alias("p")))
    p = F.col("p")
    text = F.array_join(F.transform(p, lambda x, i: F.concat(
        F.when(x["quoted"] & F.coalesce(F.get(p, i - 1)["quoted"], F.lit(False)), '"').otherwise(""), x["value"])), "")
    first = (F.col("column") == 0) & ~p[0]["quoted"]
    return grouped.select(key, "record", "column", F.when(first, F.ltrim(text, F.lit(" \t"))).otherwise(text).alias("value"))


def faults(numbers: DataFrame, key: str) -> DataFrame:
    """(key, width, widest): commas plus one of the first and of the widest record of
    every file that has a record."""
    real = (numbers.where(F.col("kind") != LINE).groupBy(key, "record")
            .agg((F.max("column") + 1).alias("width")))
    return real.groupBy(key).agg(F.min_by("width", "record").alias("width"), F.max("width").alias("widest"))


def too_wide(width: Column, widest: Column) -> Column:
    """The message for a file with a record wider than its first one."""
    return F.when(widest > width, F.concat(F.lit(ERR_CSV + "expected "), width.cast("string"),
                                           F.lit(" cells in a record, saw "), widest.cast("string")))


def url_column(found: DataFrame, key: str) -> DataFrame:
    """SRC3: (key, url) of the leftmost column that holds a valid URL, values as they
    are.  The smallest column number of a file is joined to its cells."""
    valid = found.where(is_valid_url("value"))
    least = valid.groupBy(F.col(key).alias("k")).agg(F.min("column").alias("least"))
    return (valid.join(least, (F.col(key) == F.col("k")) & (F.col("column") == F.col("least")))
            .select(key, F.col("value").alias("url")))
