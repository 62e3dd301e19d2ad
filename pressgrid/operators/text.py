"""Text table operators."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.html import html_text, raw_cells
from ..functions.text import ONE_LETTER, bind, collapse_ws, unescape, utf8_as_latin1

# Fixed value: an address with a port.
ENDPOINT = r"[0-9]+(?:\.[0-9]+){3}:[0-9]+"


def extract_endpoints(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Every ``ip:port`` match in the text, one row each, with its position."""
    found = F.regexp_extract_all(F.col(col), F.lit(ENDPOINT), 0)
    return df.select(*keys, F.posexplode(found).alias("pos", "endpoint"))


def table_endpoints(df: DataFrame, col: str, keys: list[str], stride: int = 8) -> DataFrame:
    """H8: table cells read ``stride`` at a time; cells 0 and 1 of each group
    make ``ip:port``.  One row per pair, with its position.

    The raw cells are found once and numbered, the row is spread over its groups, and
    only then are the two cells of a group turned into text: ``posexplode`` of the
    finished text would make Spark build it again to leave out rows without one."""
    def group(cells):
        n = F.floor((F.size(cells) + stride - 2) / stride).cast("int")    # groups with a second cell
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k < n),
                           lambda k: F.struct(F.get(cells, k * stride).alias("a"), F.get(cells, k * stride + 1).alias("b")))

    out = df.select(*keys, F.posexplode(bind(raw_cells(col), group)).alias("pos", "_cells"))
    return out.select(*keys, "pos", F.concat(html_text("_cells.a"), F.lit(":"), html_text("_cells.b")).alias("endpoint"))


ESCAPE = re.compile(r"""\\(?:(?P<oct>[0-7]{1,3})|x(?P<x>[0-9a-fA-F]{2})|u(?P<u>[0-9a-fA-F]{4})|U(?P<U>[0-9a-fA-F]{8})
    |N\{(?P<name>[^}]+)\}|(?P<one>[\\'"abfnrtv\n])|(?P<bad>[xuUN]|$))""", re.X)


def _unescape(text: str) -> str:
    """Every escape sequence of ``text`` as its character.  A cut-off sequence or an
    impossible character leaves the whole text as it was; a backslash before any
    other character is kept."""
    def char(m: re.Match) -> str:
        if m["one"] is not None:
            return ONE_LETTER[m["one"]]
        if m["name"] is not None:
            return unicodedata.lookup(m["name"])
        if m["bad"] is not None:
            raise ValueError(m[0])
        return chr(int(m["oct"], 8)) if m["oct"] else chr(int(m["x"] or m["u"] or m["U"], 16))
    try:
        out = ESCAPE.sub(char, text)
    except (KeyError, ValueError, OverflowError):
        return text
    # Two escapes may be the halves of one character; a lone half is none.
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@pandas_udf(StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _unescape(x))


@pandas_udf(StringType())
def _unescape_legacy_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _unescape(x.encode().decode("latin-1")))


def scrub_text(df: DataFrame, col: str, out: str = "scrubbed", legacy: bool = False) -> DataFrame:
    """Null or empty -> ''; escape sequences decoded; whitespace collapsed.

    Native expressions do it all but characters given by their Unicode name
    (``\\N{...}``): only texts that hold one cross to the Arrow-batched Python function,
    the others send it null, so one scan does.
    ``legacy=True`` repeats the original decoder exactly, which also reads
    UTF-8 text as Latin-1 (``—`` -> ``â\\x80\\x94``).
    """
    s = F.col(col)
    named = F.coalesce(s.contains("\\N{"), F.lit(False))
    text, udf = (utf8_as_latin1(s), _unescape_legacy_udf) if legacy else (s, _unescape_udf)
    decoded = F.when(named, udf(F.when(named, s))).otherwise(unescape(text))
    return df.withColumn(out, F.coalesce(collapse_ws(decoded), F.lit("")))
