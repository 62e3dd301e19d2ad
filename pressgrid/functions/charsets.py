"""Character sets of stored pages (SRC11).

Single-byte sets are read as Latin-1 and translated by a table of their upper 128
characters, which the standard library's codecs give; that stays a column expression.
Sets of several bytes have no such table: their pages, and no others, pass an Arrow
function.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Labels that pages declare, and the codec each one stands for.
SINGLE_BYTE = {
    "cp1250": ("windows-1250", "cp1250", "x-cp1250"),
    "cp1251": ("windows-1251", "cp1251", "x-cp1251", "win-1251"),
    "cp1252": ("windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii"),
    "cp1253": ("windows-1253", "cp1253", "x-cp1253"),
    "cp1254": ("windows-1254", "cp1254", "x-cp1254", "iso-8859-9", "iso8859-9", "latin5", "l5"),
    "cp1255": ("windows-1255", "cp1255", "x-cp1255"),
    "cp1256": ("windows-1256", "cp1256", "x-cp1256"),
    "cp1257": ("windows-1257", "cp1257", "x-cp1257"),
    "cp1258": ("windows-1258", "cp1258", "x-cp1258"),
    "cp874": ("windows-874", "iso-8859-11", "tis-620"),
    "cp866": ("ibm866", "cp866", "866"),
    "koi8_r": ("koi8-r", "koi8", "koi", "cskoi8r"),
    "koi8_u": ("koi8-u", "koi8-ru"),
    "mac_roman": ("macintosh", "mac", "x-mac-roman"),
    "mac_cyrillic": ("x-mac-cyrillic", "x-mac-ukrainian"),
    "iso8859_2": ("iso-8859-2", "iso8859-2", "latin2", "l2"),
    "iso8859_3": ("iso-8859-3", "iso8859-3", "latin3", "l3"),
    "iso8859_4": ("iso-8859-4", "iso8859-4", "latin4", "l4"),
    "iso8859_5": ("iso-8859-5", "iso8859-5", "cyrillic"),
    "iso8859_6": ("iso-8859-6", "iso8859-6", "arabic"),
    "iso8859_7": ("iso-8859-7", "iso8859-7", "greek"),
    "iso8859_8": ("iso-8859-8", "iso8859-8", "hebrew", "iso-8859-8-i"),
    "iso8859_10": ("iso-8859-10", "iso8859-10", "latin6", "l6"),
    "iso8859_13": ("iso-8859-13", "iso8859-13"),
    "iso8859_14": ("iso-8859-14", "iso8859-14"),
    "iso8859_15": ("iso-8859-15", "iso8859-15", "latin9", "l9"),
    "iso8859_16": ("iso-8859-16",),
}
MULTI_BYTE = {
    "cp932": ("shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j", "ms_kanji"),
    "euc_jp": ("euc-jp", "x-euc-jp"),
    "iso2022_jp": ("iso-2022-jp",),
    "gb18030": ("gbk", "gb2312", "gb_2312-80", "gb18030", "x-gbk", "chinese"),
    "big5hkscs": ("big5", "big5-hkscs", "cn-big5", "x-x-big5"),
    "cp949": ("euc-kr", "ks_c_5601-1987", "korean", "windows-949"),
}
_LATIN = "".join(map(chr, range(128, 256)))


def upper_half(codec: str) -> str:
    """The 128 characters of a single-byte codec's upper half; a byte without one stands
    for the control character of its number (windows sets) or for U+FFFD."""
    rest = "".join if codec.startswith("cp12") else None
    out = []
    for b in range(128, 256):
        c = codecs.decode(bytes([b]), codec, "replace")
        out.append(chr(b) if rest and c == "�" and b < 160 else c)
    return "".join(out)


def single_byte(latin: Column, codec: str) -> Column:
    """Bytes read as Latin-1 -> text of a single-byte set."""
    table = upper_half(codec)
    pairs = [(a, b) for a, b in zip(_LATIN, table) if a != b]
    return F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else latin


@F.pandas_udf(StringType())
def _multi_byte(content: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or k is None else bytes(c).decode(k, "replace")
                      for c, k in zip(content, codec)], dtype=object)


def declared_text(content: Column, latin: Column, label: Column) -> Column:
    """The text of a page in the character set it declares; null for other labels."""
    out = F.lit(None).cast("string")
    for codec, labels in SINGLE_BYTE.items():
        out = F.when(label.isin(*labels), single_byte(latin, codec)).otherwise(out)
    codec = F.lit(None).cast("string")
    for name, labels in MULTI_BYTE.items():
        codec = F.when(label.isin(*labels), name).otherwise(codec)
    # Only the pages that need it go to Python; the others send nulls.
    return F.coalesce(out, _multi_byte(F.when(codec.isNotNull(), content), codec))


def unmarked_utf16(content: Column) -> Column:
    """The byte order of UTF-16 text without a mark that begins with two ASCII
    characters; null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    ascii_ = "(?:0[9AD]|[2-7][0-9A-F])"
    return (F.when(head.rlike(f"^{ascii_}00{ascii_}00$"), "UTF-16LE")
            .when(head.rlike(f"^00{ascii_}00{ascii_}$"), "UTF-16BE"))
