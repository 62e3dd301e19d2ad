"""Whitespace, mojibake, scrubbing and cuts against Python's own behaviour."""

import random
import re

from pyspark.sql import functions as F

from pressgrid.functions import text
from pressgrid.operators.text import scrub_text

ALPHABET = (list("ab Z\t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　​,é—’\\") +
            ["Ã©", "â€”", "\u0081", "ñ", "€"])


def _fuzz(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_collapse_ws_matches_python(spark):
    cases = _fuzz(400) + [None, "", "   "]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(text.collapse_ws("s")).collect()]
    want = [None if c is None else re.sub(r"\s+", " ", c).strip() for c in cases]
    assert got == want


# (read wrongly twice, the text); a text that was not stays as it is.
TWICE = [
    ("cafÃƒÂ©", "café"), ("StraÃƒÂŸe", "Straße"), ("naÃƒÂ¯ve", "naïve"), ("ÃƒÂ±andÃƒÂº", "ñandú"),
    ("plain", "plain"), ("", ""), ("Ã©", "Ã©"), ("café", "café"), ("€uro", "€uro"), ("â€”", "â€”"),
    ("a\x81b", "a\x81b"), ("mixed ÃƒÂ© and é", "mixed ÃƒÂ© and é"), (None, None),
]


def test_fix_mojibake_on_stated_pairs(spark):
    df = spark.createDataFrame([(a,) for a, _ in TWICE], "s string")
    assert [r[0] for r in df.select(text.fix_mojibake("s")).collect()] == [b for _, b in TWICE]


def test_truncate(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(text.truncate("s", 3, "...")).collect()]
    assert got == ["abc...", "abc", None]


# (raw, scrubbed, scrubbed by the original decoder)
SCRUBBED = [
    (r"a\nb\tc", "a b c", "a b c"),
    ("plain  text ", "plain text", "plain text"),
    ("—dash", "—dash", "â\x80\x94dash"),
    (r"bad \x1 escape", r"bad \x1 escape", r"bad \x1 escape"),
    (r"cut off \\"[:-1], "cut off \\", "cut off \\"),
    (r"\u00e9t\u00e9", "été", "été"),
    (r"\ud83d\ude00!", "😀!", "😀!"),
    (r"quote \' and \"", "quote ' and \"", "quote ' and \""),
    (r"back\\slash \q", "back\\slash \\q", "back\\slash \\q"),
    (r"\101\x42\N{LATIN SMALL LETTER C}", "ABc", "ABc"),
    ("mixed — and \\n", "mixed — and", "mixed â\x80\x94 and"),
    ("", "", ""), (None, "", ""),
]


def test_scrub_text_both_modes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SCRUBBED)], "id int, s string")
    for legacy in (False, True):
        got = dict(scrub_text(df, "s", legacy=legacy).select("id", "scrubbed").collect())
        for i, c in enumerate(SCRUBBED):
            assert got[i] == c[2 if legacy else 1], (legacy, c)


def test_html_escape(spark):
    df = spark.createDataFrame([("<a href=\"x\">&'</a>",)], "s string")
    import html
    assert df.select(text.html_escape("s")).first()[0] == html.escape("<a href=\"x\">&'</a>")
