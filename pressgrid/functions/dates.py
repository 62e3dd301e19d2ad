"""Date column functions.

Every date leaves the engine as a string, as in the result tables; parsing
uses ``try_*`` forms so that an impossible date becomes null, never an error.
The session clock must be UTC (see ``pressgrid.session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, bind, built_once

# The zone results are given in, and the output layouts.
EASTERN = "America/New_York"
AFP_STAMP = r"\.([0-9]{8}T[0-9]{6})Z"
AFP_OUT = "M/d/yyyy'T'HH:mm:ss"
ET_OUT = "yyyy-MM-dd'T'HH:mm:ss"
# Month names, and zones that pages name, in minutes from UTC.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
ZONES = {"z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
         "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "et": None}

_ZONE = r"(" + "|".join(ZONES) + r"|[+-]\d{2}(?::?\d{2})?)?"
_TIME = (r"(?:(?:\s*t|,?\s+(?:at\s+)?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
         r"\s*([ap]\.?m\.?)?\s*" + _ZONE + ")?")
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_NAME = r"([a-z]{3,9})\.?"
# The forms of a stamp in the order they are tried: pattern, and the groups of year,
# month and day; the five groups of the time follow.
FORMS = (
    (r"(?i)^(\d{4})-(\d{1,2})-(\d{1,2})" + _TIME + "$", (1, 2, 3)),
    (r"(?i)^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?()\s*" + _ZONE + ")?$", (1, 2, 3)),
    (r"(?i)^(?:[a-z]{3,9},?\s+)?" + _DAY + r"[\s-]+" + _NAME + r",?[\s-]+(\d{4})" + _TIME + "$", (3, 2, 1)),
    (r"(?i)^(?:[a-z]{3,9},?\s+)?" + _NAME + r"\s+" + _DAY + r",?\s+(\d{4})" + _TIME + "$", (3, 1, 2)),
)


def afp_datetime(c) -> Column:
    """``.yyyyMMddTHHmmssZ`` stamp in a URL, UTC, shown in US Eastern time.

    Output ``M/d/yyyyTHH:mm:ss`` with month and day unpadded; null when there
    is no stamp or the stamp is not a real time.
    """
    stamp = F.regexp_extract(F.coalesce(_col(c), F.lit("")), AFP_STAMP, 1)
    ts = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
    return F.date_format(F.from_utc_timestamp(ts, EASTERN), AFP_OUT)


def _map(pairs: dict) -> Column:
    """A literal map of numbers by name, as one expression."""
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")")


def _months() -> dict:
    """The number of every month by its name and the name's beginnings."""
    names = {month[:k]: i for i, month in enumerate(MONTHS, 1) for k in range(3, len(month) + 1)}
    return names | {"sept": 9}


def _offset(zone: Column) -> Column:
    """Minutes from UTC of a zone's name or number; null for none and for Eastern."""
    hours = F.regexp_extract(zone, r"^[+-](\d{2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    size = hours * 60 + minutes
    named = F.try_element_at(_map({k: v for k, v in ZONES.items() if v is not None}), F.lower(zone))
    return F.coalesce(F.when(zone.startswith("-"), -size).otherwise(size), named)


PARTS = ("year", "month", "day", "hour", "minute", "second", "half", "zone")


def _parts(s: Column) -> Column:
    """The parts of a stamp as text, by the first form that it has."""
    out = F.lit(None)
    for form, places in reversed(FORMS):
        groups = F.struct(*[F.regexp_extract(s, form, g).alias(n) for n, g in zip(PARTS, (*places, 4, 5, 6, 7, 8))])
        out = F.when(s.rlike(form), groups).otherwise(out)
    return out


def _read(p: Column) -> Column:
    """struct<day, time, offset>: text of day and time ('' without one), and minutes."""
    month = F.coalesce(p["month"].try_cast("int"), F.try_element_at(_map(_months()), F.lower(p["month"])))
    hour = p["hour"].try_cast("int")
    half = F.when(p["half"].rlike("(?i)^p"), 12).otherwise(0)
    hour = F.when(p["half"] == "", hour).when(hour.between(1, 12), hour % 12 + half).otherwise(99)
    day = F.format_string("%s-%02d-%02d", p["year"], month, p["day"].try_cast("int"))
    time = F.format_string("%02d:%s:%s", hour, p["minute"], F.when(p["second"] == "", "00").otherwise(p["second"]))
    return F.struct(F.when(month.isNotNull(), day).alias("day"), F.when(p["hour"] != "", time).otherwise("").alias("time"),
                    _offset(p["zone"]).alias("offset"))


def to_eastern(c) -> Column:
    """D3: a stamp with a zone -> US Eastern wall time; without a zone -> as given.

    Reads ISO 8601 (also compact, without seconds, with hours alone as the offset),
    RFC 1123 and dates with month names.  Output ``yyyy-MM-ddTHH:mm:ss``; a bare date
    stays a bare date (``yyyy-MM-dd``).  Anything that does not read as a time gives
    null.
    """
    def shown(r):
        ts = F.try_to_timestamp(F.concat(r["day"], F.lit(" "), r["time"]), F.lit("yyyy-MM-dd HH:mm:ss"))
        utc = ts - F.make_dt_interval(mins=r["offset"])
        local = F.when(r["offset"].isNotNull(), F.from_utc_timestamp(utc, EASTERN)).otherwise(ts)
        bare = F.when(F.try_to_date(r["day"], "yyyy-MM-dd").isNotNull(), r["day"])
        return F.when(r["time"] == "", bare).otherwise(F.date_format(local, ET_OUT))

    return bind(F.trim(_col(c)), lambda s: bind(_parts(s), lambda p: bind(_read(p), shown)))


@built_once
def to_date_style(c, style: str = "date") -> Column:
    """Date as the sink wants it: ``'date'`` -> ``yyyy-MM-dd``, ``'et_datetime'`` -> D3."""
    et = to_eastern(c)
    if style == "et_datetime":
        return et
    if style != "date":
        raise ValueError(f"unknown date style {style!r}")
    return F.left(et, F.lit(10))


def modified_or_published(modified, published) -> Column:
    """The modified date falls back to the published one."""
    return F.coalesce(_col(modified), _col(published))
