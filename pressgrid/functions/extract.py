"""Metadata column functions: URL-only rules (X1) and page fallbacks (X2 parts).

The reference hands these rules to a language model as prose; here they are
fixed, testable column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, bind, built_once, collapse_ws
from .html import ATTRS, html_text, unescape_entities

UNKNOWN = "unknown"

# Host -> readable publication name for well-known sites.  Other
# hosts fall back to their first label (see ``source_from_host``).
KNOWN_SOURCES = {
    "cnn.com": "CNN", "bbc.com": "BBC", "bbc.co.uk": "BBC", "reuters.com": "Reuters",
    "apnews.com": "AP News", "afp.com": "AFP", "npr.org": "NPR",
    "nytimes.com": "The New York Times", "washingtonpost.com": "The Washington Post",
    "theguardian.com": "The Guardian", "wsj.com": "The Wall Street Journal",
    "foxnews.com": "Fox News", "nbcnews.com": "NBC News", "cbsnews.com": "CBS News",
    "abcnews.go.com": "ABC News", "aljazeera.com": "Al Jazeera", "bloomberg.com": "Bloomberg",
    "politico.com": "Politico", "axios.com": "Axios", "usatoday.com": "USA Today",
    "latimes.com": "Los Angeles Times", "france24.com": "France 24", "dw.com": "DW",
}
# Host prefixes that are not part of the site name.
HOST_PREFIXES = r"^(?:www\.|m\.|edition\.)"
# Month abbreviations in calendar order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

URL_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)"
URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?"
PAGE_EXT = r"(?i)\.(?:html?|php|aspx?)$"
BYLINE_PATH = r"(?i)/(?:by|authors?)/([a-z]+(?:-[a-z]+)+)(?:/|$)"

# Date shapes in a path, tried in this order; each yields (year, month, day).
DATE_YMD = r"/([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)"
DATE_Y_MON_D = r"/([0-9]{4})/([a-zA-Z]{3})/([0-9]{1,2})(?:/|$)"
DATE_ISO = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
DATE_D_MON_Y = r"([0-9]{1,2})-([a-zA-Z]{3})-([0-9]{4})"
DATE_COMPACT = r"(?:^|[^0-9])(20[0-9]{2})([0-9]{2})([0-9]{2})(?:[^0-9]|$)"


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(F.trim(_col(c)), URL_HOST, 1))


def url_path(c) -> Column:
    return F.regexp_extract(F.trim(_col(c)), URL_PATH, 1)


def source_from_host(host: Column, names: dict | None = None) -> Column:
    """Readable source: dictionary hit on the host (or its last 2-3 labels),
    else the first label of the host, upper-cased when at most 4 letters,
    otherwise capitalised."""
    names = KNOWN_SOURCES if names is None else names
    lookup = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    h = F.regexp_replace(host, HOST_PREFIXES, "")
    label = F.substring_index(h, ".", 1)
    fallback = F.when(F.char_length(label) <= 4, F.upper(label)).otherwise(F.initcap(label))
    hit = F.coalesce(F.try_element_at(lookup, h),
                     F.try_element_at(lookup, F.substring_index(h, ".", -2)),
                     F.try_element_at(lookup, F.substring_index(h, ".", -3)))
    return F.when(h == "", F.lit(None)).otherwise(F.coalesce(hit, fallback))


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def title_from_path(path: Column) -> Column:
    """Slug of the last path part (the one before ``index.*``), words kept as they
    are, title-cased; null unless it holds at least two alphabetic words."""
    parts = _path_parts(path)
    last = F.try_element_at(parts, F.lit(-1))
    prev = F.try_element_at(parts, F.lit(-2))
    slug = F.when(last.rlike(r"(?i)^index\."), prev).otherwise(last)
    words = F.regexp_replace(F.regexp_replace(slug, PAGE_EXT, ""), "-", " ")
    alpha = F.size(F.filter(F.split(words, " "), lambda w: w.rlike("^[A-Za-z]+$")))
    return F.when(alpha >= 2, F.initcap(collapse_ws(words)))


def authors_from_path(path: Column) -> Column:
    name = F.regexp_extract(path, BYLINE_PATH, 1)
    return F.when(name != "", F.initcap(F.replace(name, F.lit("-"), F.lit(" "))))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d"), "yyyy-MM-dd")


def _month_no(mon: Column) -> Column:
    months = F.array(*[F.lit(m) for m in MONTHS])
    pos = F.array_position(months, F.lower(mon))
    return F.when(pos > 0, pos.cast("string"))


def date_from_path(path: Column) -> Column:
    """First date shape in the path that is a real calendar date, as ``yyyy-MM-dd``."""
    def g(p, i):
        return F.regexp_extract(path, p, i)

    def found(p):
        return path.rlike(p)

    cands = [
        F.when(found(DATE_YMD), _ymd(g(DATE_YMD, 1), g(DATE_YMD, 2), g(DATE_YMD, 3))),
        F.when(found(DATE_Y_MON_D), _ymd(g(DATE_Y_MON_D, 1), _month_no(g(DATE_Y_MON_D, 2)),
                                         g(DATE_Y_MON_D, 3))),
        F.when(found(DATE_ISO), _ymd(g(DATE_ISO, 1), g(DATE_ISO, 2), g(DATE_ISO, 3))),
        F.when(found(DATE_D_MON_Y), _ymd(g(DATE_D_MON_Y, 3), _month_no(g(DATE_D_MON_Y, 2)),
                                         g(DATE_D_MON_Y, 1))),
        F.when(found(DATE_COMPACT), _ymd(g(DATE_COMPACT, 1), g(DATE_COMPACT, 2), g(DATE_COMPACT, 3))),
    ]
    return F.coalesce(*cands)


def url_metadata(c, names: dict | None = None, path=None, date=None) -> Column:
    """Article record from the URL alone; every missing field is 'unknown'.

    ``path`` / ``date`` may name columns already holding ``url_path`` and
    ``date_from_path`` (see ``with_url_metadata``), so that the path is cut
    once per row rather than once per rule.
    """
    u = _col(c)
    path = url_path(u) if path is None else _col(path)
    date = date_from_path(path) if date is None else _col(date)
    unk = F.lit(UNKNOWN)
    return F.struct(
        F.coalesce(title_from_path(path), unk).alias("title"),
        F.coalesce(authors_from_path(path), unk).alias("authors"),
        F.coalesce(source_from_host(url_host(u), names), unk).alias("source"),
        F.coalesce(date, unk).alias("published_date"),
        F.coalesce(date, unk).alias("modified_date"),
        unk.alias("article_text"),
    )


def with_url_metadata(df, url_col: str = "url", out: str = "url_meta", names: dict | None = None):
    """X1 as a DataFrame step: binds the path and the date first, then adds the
    record struct ``out``."""
    r = df.withColumn("_path", url_path(url_col)).withColumn("_date", date_from_path(F.col("_path")))
    return r.withColumn(out, url_metadata(url_col, names, "_path", "_date")).drop("_path", "_date")


# --- X2 page fallbacks ------------------------------------------------------

META = rf"(?i)<meta\s{ATTRS}>"
# One attribute with its value, which ends at the quote that began it.
ATTRIBUTE = r"[^\s\"'>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


@built_once
def page_metas(html) -> Column:
    """array<struct<keys, content>>: the meta tags of a page that have content, with their
    name and property in lower case; attributes in any order, quoted or not, references
    in the content decoded."""
    def read(tag):
        attrs = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"),
            F.regexp_replace(F.regexp_replace(a, r"^[^=]*=\s*", ""), r"^([\"'])(.*)\1$", "$2").alias("value")))
        named = F.filter(attrs, lambda a: a["name"].isin("name", "property"))
        content = F.get(F.filter(attrs, lambda a: a["name"] == "content"), F.lit(0))["value"]
        return F.struct(F.transform(named, lambda a: F.lower(a["value"])).alias("keys"),
                        F.coalesce(unescape_entities(content), F.lit("")).alias("content"))
    return F.filter(F.transform(F.regexp_extract_all(_col(html), F.lit(META), F.lit(0)), read), lambda m: m["content"] != "")


@built_once
def meta_content(metas, key: str) -> Column:
    """``content`` of the first meta tag (of ``page_metas``) named ``key``."""
    hits = F.filter(_col(metas), lambda m: F.array_contains(m["keys"], key))
    return F.get(hits, F.lit(0))["content"]


H1_INNER = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"
TITLE_INNER = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
BYLINE_OPEN = (r"(?is)<(p|div|span|a|li|address)\s[^>]*?class\s*=\s*"
               r"(?:\"[^\"]*byline[^\"]*\"|'[^']*byline[^']*'|[^\s>]*byline[^\s>]*)[^>]*>")
# A name: letters and the marks of names, at most six words, no digit.
PERSON = r"^\p{L}[\p{L}\p{M}.'’-]*(?: [\p{L}\p{M}.'’-]+){0,5}$"
TIME_ATTR = r"(?is)<time\s[^>]*?datetime\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s\"'>]+))"


@built_once
def first_inner_text(html, pattern: str) -> Column:
    t = html_text(F.regexp_extract(_col(html), pattern, 1))
    return F.nullif(t, F.lit(""))


@built_once
def byline_authors(html) -> Column:
    """Names in the visible by-lines, each once: 'By A, B and C' -> 'A, B, C'.

    Every by-line element counts, its text up to its own closing tag or to a
    by-line inside it; what does not read as a name (a date, a sentence) is left out."""
    def body(s):
        rest = F.split(s, BYLINE_OPEN, -1)
        inner = F.zip_with(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))),
                           F.regexp_extract_all(s, F.lit(BYLINE_OPEN), 1),
                           lambda p, t: F.get(F.split(p, F.concat(F.lit("(?i)</"), t, F.lit(r"\s*>")), -1), F.lit(0)))
        line = F.transform(inner, lambda x: F.regexp_replace(html_text(x), r"(?i)^by:?\s+", ""))
        names = F.flatten(F.transform(line, lambda x: F.split(x, r"\s*[,;|]\s*|\s+and\s+", -1)))
        names = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.rlike(PERSON)))
        return F.nullif(F.array_join(names, ", "), F.lit(""))
    return bind(_col(html), body)


@built_once
def time_datetime(html) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(_col(html), TIME_ATTR, g), F.lit("")) for g in (1, 2, 3)])
