"""URL table operators (SRC1-SRC3, P5, J1-J3, J5, SET1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import base_url, is_valid_url, py_strip
from .joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small, salted_lookup_join

# Fixed value: the batch size the intake form starts with.
DEFAULT_MAX_URLS = 20


def clean_lines(df: DataFrame, col: str = "value", out: str = "url") -> DataFrame:
    """SRC1: strip every line, drop the blank ones; other columns kept."""
    return df.withColumn(out, py_strip(col)).where(F.col(out) != "")


def split_urls(df: DataFrame, text_col: str, keys: list[str], out: str = "url") -> DataFrame:
    """SRC2: split free text on newlines and commas, strip, keep valid URLs, one
    row per distinct (keys, url)."""
    parts = df.select(*keys, F.explode(F.split(F.col(text_col), "[\n,]", -1)).alias("_part"))
    stripped = parts.select(*keys, py_strip("_part").alias(out))
    return stripped.where(is_valid_url(out)).distinct()


def discover_url_column(df: DataFrame, file_col: str, cols: list[str], out: str = "url") -> DataFrame:
    """SRC3: per file, the leftmost column that holds at least one valid URL wins;
    its valid values (unstripped, nulls dropped) are returned, one per distinct value.

    The cells become rows, those that hold no URL go at once, and the smallest column
    number per file is joined back (salted for a file with very many rows), so no file's
    rows are ever gathered in one place and the number of columns does not matter.
    """
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("_column", out)
    valid = df.select(file_col, cells).where(is_valid_url(out))
    least = valid.groupBy(file_col).agg(F.min("_column").alias("_least"))
    joined = salted_lookup_join(valid, least, file_col, "inner")
    return joined.where(F.col("_column") == F.col("_least")).select(file_col, out).distinct()


def cap_batch(df: DataFrame, batch_col: str, max_urls: int = DEFAULT_MAX_URLS) -> DataFrame:
    """P5: a batch with more than ``max_urls`` URLs is refused whole, not cut.

    Adds ``batch_size`` and ``refused`` (with the form's message in ``error``).
    """
    if max_urls < 1:
        raise ValueError("max_urls must be at least 1")
    sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("batch_size"))
    out = salted_lookup_join(df, sizes, batch_col, "inner")
    refused = F.col("batch_size") > max_urls
    msg = F.concat(F.lit("Too many URLs ("), F.col("batch_size").cast("string"),
                   F.lit(f"). Maximum allowed: {max_urls}"))
    return out.withColumn("refused", refused).withColumn("error", F.when(refused, msg))


def blocked_bases(blocked: DataFrame, url_col: str = "url") -> DataFrame:
    """The blocked-site set: distinct base URLs of the stripped, non-blank list lines."""
    lines = clean_lines(blocked, url_col, "_u")
    return lines.select(base_url("_u").alias("base_url")).distinct()


def _with_base(urls: DataFrame, url_col: str) -> DataFrame:
    return urls.withColumn("base_url", base_url(url_col))


def route(urls: DataFrame, blocked: DataFrame, url_col: str = "url",
          max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Every URL with ``blocked`` = its base URL is in the blocked set.

    The set is broadcast only when it is provably small; otherwise the planner
    keeps a shuffle join on ``base_url``.  The set is distinct, so the left
    join never multiplies rows.
    """
    bases = broadcast_if_small(blocked_bases(blocked).withColumn("_hit", F.lit(True)),
                               max_broadcast_rows)
    out = _with_base(urls, url_col).join(bases, "base_url", "left")
    return out.withColumn("blocked", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def blocked_urls(urls: DataFrame, blocked: DataFrame, url_col: str = "url") -> DataFrame:
    """The URLs whose base is in the blocked set (semi join)."""
    bases = broadcast_if_small(blocked_bases(blocked))
    return _with_base(urls, url_col).join(bases, "base_url", "left_semi")


def open_urls(urls: DataFrame, blocked: DataFrame, url_col: str = "url") -> DataFrame:
    """The URLs that go on to the page path (anti join)."""
    bases = broadcast_if_small(blocked_bases(blocked))
    return _with_base(urls, url_col).join(bases, "base_url", "left_anti")


def drop_seen(df: DataFrame, ledger: DataFrame, key: str = "md5") -> DataFrame:
    """Drop the rows whose content hash is already in the ledger."""
    seen = broadcast_if_small(ledger.select(key).distinct())
    return df.join(seen, key, "left_anti")
