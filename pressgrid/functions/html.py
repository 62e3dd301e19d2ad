"""HTML column functions (H1-H8), native expressions, no Python worker.

``page_parts`` reads a page once: a regular expression that knows quoted attribute
values splits it into text and marks (tags, comments, whole scripts and styles), and
one fold over the marks keeps a stack of the open elements, as a forgiving tree parser
does (a void or self-closed element is never open): a closing tag ends the latest open element of its name and all inside it, one
without an open element does nothing, and elements never closed run to the end of what
they stand in.  The fold says for every piece whether it lies in a removed element
and in the first article, main or body; the cleaned page, its main markup and its text
are read off that.

* comments, ``script`` and ``style`` are one mark each, so a tag inside a comment or a
  ``</p>`` inside a script is not read as markup, nor is one inside a quoted value;
* a paragraph ends at ``</p>``, at the next ``<p>``, or at the end of an enclosing
  block (a tree parser would repeat the text of unclosed nested paragraphs).
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CP1252_BYTES, CP1252_SPECIALS, WS_CLASS, _col, bind, built_once, collapse_ws

# Elements removed before the text is taken (script and style go
# in the first pass with comments), in removal order.
REMOVED_ELEMENTS = ("nav", "footer", "aside", "form", "header")
# Where the main content is looked for, first hit wins.
CONTENT_CONTAINERS = ("article", "main", "body")
# Elements without content, which are never open.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
                 "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
                 "command", "frame", "image", "isindex", "nextid", "spacer")
# Closing tags that end an unclosed paragraph.
BLOCK_ENDS = ("article", "main", "body", "html", "div", "section", "td", "th", "tr",
              "table", "li", "ul", "ol", "blockquote", "figure", "header", "footer",
              "nav", "aside", "form", "dd", "dl", "dt")

FIRST_PASS = (r"(?is)<!--.*?(?:-->|\z)"
              r"|<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)"
              r"|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)")


# The rest of a tag: a quoted value after an equals sign may hold a ">".
ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"


TAG = rf"</?[a-zA-Z]{ATTRS}>|<![^>]*>|<\?[^>]*>"
MARK = rf"{FIRST_PASS}|{TAG}"
P_OPEN = rf"(?i)<p(?:\s{ATTRS})?>"
P_BODY = r"(?is)^(.*?)(?:</p\s*>|</(?:" + "|".join(BLOCK_ENDS) + r")\s*>|\z)"

# A character reference: decimal, hexadecimal, or a name, each with or without ";".
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{1,31};?)"
# Names that count without ";", also as the beginning of a longer word; longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
BARE_NAME = "^(?:" + "|".join(_BARE) + ")"


def _names() -> str:
    """The named references of HTML as JSON, from the standard library's table: by first
    letter, so that a look-up reads a few dozen names."""
    table: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        table.setdefault(name[0], {})[name] = value
    return json.dumps(table)


def _code_point(n: Column) -> Column:
    """The character of a number: 0, surrogates and what lies beyond Unicode become
    U+FFFD, the windows-1252 range stands for its characters, controls and
    non-characters are left out."""
    def body(v):
        char = F.decode(F.unhex(F.lpad(F.hex(v), 8, "0")), "UTF-32")
        return (F.when((v < 1) | (v > 0x10FFFF) | v.between(0xD800, 0xDFFF), "�")
                .when(v.between(0x80, 0x9F), F.translate(char, CP1252_BYTES, CP1252_SPECIALS))
                .when((v >= 0xFDD0) & (v.between(0xFDD0, 0xFDEF) | (v % 65536 >= 0xFFFE)), "")
                .otherwise(F.regexp_replace(char, r"[\x01-\x08\x0b\x0e-\x1f\x7f]", "")))
    return bind(n, body)


def _decoded(ref: Column, names: Column) -> Column:
    body = F.substring(ref, 2, 1 << 30)
    hex_ = body.rlike("^#[xX]")
    digits = F.regexp_extract(body, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(F.char_length(digits) > 8, str(1 << 40)).when(hex_, F.conv(digits, 16, 10)).otherwise(digits)

    def named(bare):
        known = F.try_element_at(F.try_element_at(names, F.left(bare, F.lit(1))), bare)
        return F.concat(known, F.substr(body, F.char_length(bare) + 1))

    whole = F.try_element_at(F.try_element_at(names, F.left(body, F.lit(1))), body)
    return (F.when(body.startswith("#"), _code_point(F.coalesce(number.try_cast("bigint"), F.lit(0))))
            .otherwise(F.coalesce(whole, bind(F.regexp_extract(body, BARE_NAME, 0), named), ref)))


def unescape_entities(c) -> Column:
    """Turn character references into characters, each once, as browsers read text:
    every name of HTML, the old ones also without ";" and before other letters;
    unknown names stay."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")

    def body(src):
        refs = F.transform(F.regexp_extract_all(src, F.lit(REFERENCE), 0), lambda r: _decoded(r, names))
        joined = F.array_join(F.zip_with(F.split(src, REFERENCE, -1), F.concat(refs, F.array(F.lit(""))),
                                         lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
        return F.when(src.contains("&"), joined).otherwise(src)

    return bind(_col(c), body)


def drop_comments_scripts(c) -> Column:
    """Remove comments, scripts and styles (their text is never page text)."""
    return F.regexp_replace(_col(c), FIRST_PASS, " ")


# Kinds of marks.
OTHER, OPEN, CLOSE, ALONE, DROPPED = range(5)
# Where a piece lies: in no removed element, in the first article, main, body.
KEPT, IN_ARTICLE, IN_MAIN, IN_BODY = 1, 2, 4, 8
PLACES = dict(zip(CONTENT_CONTAINERS, (IN_ARTICLE, IN_MAIN, IN_BODY)))
# Marks folded together: what a fold appends to is copied at every step, so it is kept
# short and the parts are joined at the end.
FOLD = 128


def _mark(m: Column) -> Column:
    """struct<m, name, kind> of a mark."""
    def body(name):
        closing = m.startswith("</")
        # A slash that ends an unquoted value belongs to the value.
        alone = m.endswith("/>") & ~m.rlike(r"=\s*[^\s\"'>]+/>$")
        gone = name.isin("script", "style") & ~closing | name.isin(*REMOVED_ELEMENTS) & alone
        kind = (F.when(m.startswith("<!--") | gone, DROPPED).when(name == "", OTHER).when(closing, CLOSE)
                .when(alone | name.isin(*VOID_ELEMENTS), ALONE).otherwise(OPEN))
        return F.struct(m.alias("m"), name.alias("name"), kind.alias("kind"))
    return bind(F.lower(F.regexp_extract(m, r"^</?([a-zA-Z][^\s/>]*)", 1)), body)


def _step(a: Column, x: Column) -> Column:
    """The stack of open elements (latest first) after a mark, the sizes it had when the
    removed element and the containers around began (0 outside, -1 past a container), and
    the place after every mark so far."""
    name, opens = x["name"], x["kind"] == OPEN

    def sized(up):          # elements that a closing tag ends
        size = F.when(opens, a["n"] + 1).otherwise(a["n"] - up)

        def placed(n):
            stack = F.when(opens, F.concat(F.array(name), a["stack"])).when(
                up > 0, F.slice(a["stack"], up + 1, n)).otherwise(a["stack"])
            removed = (F.when(opens & (a["removed"] == 0) & name.isin(*REMOVED_ELEMENTS), n)
                       .when(a["removed"] > n, 0).otherwise(a["removed"]))

            def contained(gone):
                inside = {c: F.when(opens & (a[c] == 0) & (gone == 0) & (name == c), n)
                          .when(a[c] > n, -1).otherwise(a[c]) for c in CONTENT_CONTAINERS}
                place = F.when(gone == 0, KEPT).otherwise(0)
                for c, bit in PLACES.items():
                    place = place + F.when(inside[c] > 0, bit).otherwise(0)
                return F.struct(stack.alias("stack"), n.alias("n"), gone.alias("removed"),
                                *[inside[c].alias(c) for c in CONTENT_CONTAINERS],
                                F.concat(a["out"], F.array(place)).alias("out"))
            return bind(removed, contained)
        return bind(size, placed)

    up = F.when(x["kind"] == CLOSE, F.array_position(a["stack"], name).cast("int")).otherwise(0)
    return bind(up, sized)


@built_once
def page_parts(c) -> Column:
    """array<struct<text, mark, dropped, before, after>>: the page in order, each text
    with the mark after it ('' at the end) and the places before and after that mark."""
    def read(s):
        texts = F.split(s, MARK, -1)
        marks = F.transform(F.regexp_extract_all(s, F.lit(MARK), F.lit(0)), _mark)

        def folded(ms):
            zero = F.lit(0)
            start = F.struct(F.array().cast("array<string>").alias("stack"), zero.alias("n"), zero.alias("removed"),
                             *[zero.alias(t) for t in CONTENT_CONTAINERS], F.array().cast("array<int>").alias("out"))

            def fresh(a, out):
                return F.struct(*[a[f].alias(f) for f in ("stack", "n", "removed", *CONTENT_CONTAINERS)], out.alias("out"))

            def block(a, i):
                part = F.slice(ms, i * FOLD + 1, FOLD)
                done = F.aggregate(part, fresh(a["s"], F.array().cast("array<int>")), _step)
                return bind(done, lambda d: F.struct(fresh(d, F.array().cast("array<int>")).alias("s"),
                                                     F.concat(a["all"], F.array(d["out"])).alias("all")))

            blocks = F.sequence(F.lit(0), F.floor(F.size(ms) / FOLD).cast("int"))
            first = F.struct(start.alias("s"), F.array(F.array(F.lit(KEPT))).alias("all"))
            places = F.flatten(F.aggregate(blocks, first, block)["all"])
            return bind(places, lambda p: F.transform(texts, lambda t, i: F.struct(
                t.alias("text"), F.coalesce(F.get(ms, i)["m"], F.lit("")).alias("mark"),
                (F.coalesce(F.get(ms, i)["kind"], F.lit(OTHER)) == DROPPED).alias("dropped"),
                F.get(p, i).alias("before"), F.coalesce(F.get(p, i + 1), F.get(p, i)).alias("after"))))
        return bind(marks, folded)
    return bind(_col(c), read)


def _in(place: Column, bit) -> Column:
    return place.bitwiseAND(bit) != 0


def _container(parts: Column) -> Column:
    """The place of the first article, else main, else body; the kept page without one."""
    out = F.lit(KEPT)
    for bit in reversed(PLACES.values()):
        out = F.when(F.exists(parts, lambda p: _in(p["after"], bit)), bit).otherwise(out)
    return out


def _markup(parts: Column, bit, replacement: str) -> Column:
    """The markup of the pieces in a place, a removed element or comment as
    ``replacement``."""
    def piece(p):
        here, there = (_in(p[w], F.lit(KEPT)) & _in(p[w], bit) for w in ("before", "after"))
        begins = _in(p["before"], F.lit(KEPT)) & ~_in(p["after"], F.lit(KEPT))
        mark = (F.when(here & (p["dropped"] | begins), F.lit(replacement))
                .when(here & there, p["mark"]).otherwise(F.lit("")))
        return F.concat(F.when(here, p["text"]).otherwise(F.lit("")), mark)
    return F.array_join(F.transform(parts, piece), "")


@built_once
def stripped_markup(parts, replacement: str = " ") -> Column:
    """H1 of a page's parts."""
    return _markup(_col(parts), F.lit(KEPT), replacement)


@built_once
def main_text(parts) -> Column:
    """H1 -> H2 -> H3 of a page's parts: the main text as one line."""
    parts = _col(parts)

    def body(bit):
        texts = F.filter(parts, lambda p: _in(p["before"], F.lit(KEPT)) & _in(p["before"], bit) & (p["text"] != ""))
        return collapse_ws(unescape_entities(F.array_join(F.transform(texts, lambda p: p["text"]), " ")))
    return bind(_container(parts), body)


def strip_boilerplate(c, replacement: str = " ") -> Column:
    """H1: remove script, style, nav, footer, aside, form and header anywhere."""
    return bind(page_parts(c), lambda parts: stripped_markup(parts, replacement))


def main_content(c) -> Column:
    """H2: inner markup of the first article, else main, else body, else all; removed
    elements are left out."""
    return bind(page_parts(c), lambda parts: bind(_container(parts), lambda bit: _markup(parts, bit, " ")))


def html_text(c, sep: str = " ") -> Column:
    """H3: text of a markup fragment: tags become ``sep``, references decoded, WS collapsed."""
    return collapse_ws(unescape_entities(F.regexp_replace(_col(c), TAG, sep)))


def clean_content(c) -> Column:
    """H1 -> H2 -> H3: the page's main text as one line."""
    return bind(page_parts(c), main_text)


def raw_html_for_dates(c, n: int = 20000) -> Column:
    """H7: the page after H1 removed its elements, first ``n`` characters."""
    return F.left(strip_boilerplate(c, ""), F.lit(n))


def paragraphs(c) -> Column:
    """Array of the markup inside every ``p`` of the page, in document order."""
    parts = F.split(drop_comments_scripts(c), P_OPEN)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                       lambda x: F.regexp_extract(x, P_BODY, 1))


def node_text_glued(c) -> Column:
    """Text nodes stripped and glued with nothing (``get_text(strip=True)``)."""
    s = F.replace(_col(c), F.lit("&nbsp;"), F.lit("\u00a0"))
    s = F.regexp_replace(s, f"{WS_CLASS}*(?:{TAG}){WS_CLASS}*", "")
    return F.regexp_replace(unescape_entities(s), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


@built_once
def paragraph_text(c, sep: str = "") -> Column:
    """H6 (before scrubbing): every paragraph's glued text, joined with one space.

    ``sep`` is the glue between text nodes inside a paragraph; the default
    ``''`` matches a parser's ``get_text(strip=True)``, which runs words of
    adjacent inline elements together.
    """
    if sep == "":
        return F.array_join(F.transform(paragraphs(c), node_text_glued), " ")
    return F.array_join(F.transform(paragraphs(c), lambda p: html_text(p, sep)), " ")


TD_CELL = r"(?is)<td(?:\s[^>]*)?>(.*?)</td\s*>"


def raw_cells(c) -> Column:
    """The markup inside every ``td`` cell of a fragment, in document order."""
    return F.regexp_extract_all(_col(c), F.lit(TD_CELL), 1)


def table_cells(c) -> Column:
    """All ``td`` cells of a fragment, as stripped text, in document order."""
    return F.transform(raw_cells(c), lambda x: html_text(x))
