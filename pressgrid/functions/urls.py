"""URL column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, _col

LEAD_TRAIL_WS = f"^{WS_CLASS}+|{WS_CLASS}+$"


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace (Unicode set)."""
    return F.regexp_replace(_col(c), LEAD_TRAIL_WS, "")


def _starts_with_scheme(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://")


def is_valid_url(c) -> Column:
    """Stripped value starts with http:// or https:// and is at least 10 long.

    Case-sensitive on the scheme, like the intake form.  Null is not valid.
    """
    s = py_strip(c)
    return F.coalesce(_starts_with_scheme(s) & (F.char_length(s) >= 10), F.lit(False))


def has_scheme(c) -> Column:
    """The pipeline's quick check: non-empty and starts with a scheme, no strip.

    One reference to the input, so a filter on it that Catalyst pushes towards
    the scan evaluates the URL expression once.
    """
    return F.coalesce(_col(c).rlike("^https?://"), F.lit(False))


def base_url(c) -> Column:
    """The first three '/'-separated parts joined again (``scheme://host``).

    Keeps the port, keeps a query when there is no path, and turns a doubled
    scheme ``http://https://h/..`` into ``http://https:``.
    """
    return F.substring_index(_col(c), "/", 3)


def is_afp_source(c) -> Column:
    """Source equals AFP after strip and upper-casing."""
    return F.upper(py_strip(F.coalesce(_col(c), F.lit("")))) == "AFP"
