"""JSON-LD column functions.

Blocks stay JSON text at the edges of the engine and are read as VARIANT
inside (``try_parse_json`` / ``try_variant_get``), so no schema has to be
guessed for data whose shape changes from site to site.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, built_once, collapse_ws, unescape
from .html import paragraph_text

LD_SCRIPT = (r"(?is)<script(?:\s[^>]*?)?\stype\s*=\s*"
             r"(?:\"(?-i:application/ld\+json)\"[^>]*|'(?-i:application/ld\+json)'[^>]*"
             r"|(?-i:application/ld\+json)(?:\s[^>]*)?)>(.*?)</script\s*>")

# The keys that count as "good dates" at the top of an object.
DATE_KEYS = ("datePublished", "dateModified", "dateCreated", "publishedDate", "modifiedDate")
# Fixed values: @type words that make an object's name usable as a title.
ARTICLE_TYPES = r"(?i)article|posting|report|videoobject|webpage"


def strict_json(c) -> Column:
    """True when the text is exactly one JSON value, as Python's ``json.loads`` reads it.

    ``try_parse_json`` alone accepts trailing text (``{"a":1} x``), so the text is
    parsed inside ``[...]``, giving an array of exactly one element, and inside
    ``{"v":...}``: text that closes one bracket early cannot close the other.
    Known difference: ``NaN`` and duplicate keys are rejected here, accepted
    there.
    """
    s = _col(c)
    wrapped = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    n = F.size(F.try_variant_get(wrapped, "$", "array<variant>"))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    return F.coalesce((n == 1) & keyed.isNotNull(), F.lit(False))


@built_once
def jsonld_blocks(c) -> Column:
    """H4: text of every ``application/ld+json`` script that parses, in page order."""
    blocks = F.regexp_extract_all(_col(c), F.lit(LD_SCRIPT), 1)
    return F.filter(blocks, lambda b: strict_json(b))


def scrub_default(c) -> Column:
    """Empty for null, escapes decoded, whitespace collapsed."""
    return F.coalesce(collapse_ws(unescape(c)), F.lit(""))


def jsonld_wrapper(html, blocks=None) -> Column:
    """H5: ``{ld_json_list, article_text}`` or null when no block parses.

    ``article_text`` is the paragraph text of the whole page (H6), scrubbed.
    """
    b = jsonld_blocks(html) if blocks is None else _col(blocks)
    return F.when(F.size(b) > 0, F.struct(
        b.alias("ld_json_list"),
        scrub_default(paragraph_text(html)).alias("article_text")))


def _truthy(field: Column) -> Column:
    """Python truthiness of one JSON value held as VARIANT (null or absent: false)."""
    kind = F.schema_of_variant(field)
    txt = F.try_variant_get(field, "$", "string")
    num = F.try_variant_get(field, "$", "double")
    falsy = (kind.isNull() | (kind == "VOID")
             | ((kind == "STRING") & (txt == ""))
             | ((kind == "BOOLEAN") & (txt == "false"))
             | (kind.startswith("ARRAY") & (txt == "[]"))
             | (kind.startswith("OBJECT") & (txt == "{}"))
             | (~kind.isin("STRING", "BOOLEAN") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
                & (num == 0)))
    return ~F.coalesce(falsy, F.lit(False))


def has_dates(c) -> Column:
    """P6 on one JSON text: any date key at the top level of an object is truthy.

    Truthy follows Python: non-empty string (``"0"`` included), non-zero
    number, true, non-empty list or object.  A missing or null value, or a
    text that is not an object, gives false.
    """
    v = F.try_parse_json(_col(c))
    out = F.lit(False)
    for k in DATE_KEYS:
        out = out | _truthy(F.try_variant_get(v, f"$.{k}", "variant"))
    return F.coalesce(out, F.lit(False))


# --- X3: field getters over all candidate objects of a page ----------------

_AS_LIST = ("CASE WHEN schema_of_variant({v}) LIKE 'ARRAY%' "
            "THEN variant_get({v}, '$', 'array<variant>') ELSE array({v}) END")


def _as_list(v: str) -> str:
    return _AS_LIST.format(v=v)


def _is_object(v: str) -> str:
    return f"(schema_of_variant({v}) LIKE 'OBJECT%')"


def candidates_sql(blocks: str) -> str:
    """SQL text: ARRAY<VARIANT> of the objects to search, in order.

    Each block, its array members and the members of arrays inside it; each
    object followed by its ``mainEntityOfPage`` when that is an object.
    """
    lvl0 = f"transform({blocks}, b -> parse_json(b))"
    lvl1 = f"flatten(transform({lvl0}, v -> {_as_list('v')}))"
    lvl2 = f"flatten(transform({lvl1}, w -> {_as_list('w')}))"
    objs = f"filter({lvl2}, o -> {_is_object('o')})"
    main = "try_variant_get(o2, '$.mainEntityOfPage', 'variant')"
    return (f"flatten(transform({objs}, o2 -> CASE WHEN {main} IS NOT NULL AND "
            f"{_is_object(main)} THEN array(o2, {main}) ELSE array(o2) END))")


def _first(expr_over_o: str, objs: str, cond: str | None = None) -> str:
    src = objs if cond is None else f"filter({objs}, o -> {cond})"
    return (f"try_element_at(filter(transform({src}, o -> {expr_over_o}), "
            f"x -> x IS NOT NULL AND trim(x) <> ''), 1)")


def _names_of(v: str) -> str:
    """SQL text: list of person/organisation names in a variant (string, object or list)."""
    name = "try_variant_get(a, '$.name', 'variant')"
    per_item = (f"CASE WHEN {_is_object('a')} THEN "
                f"transform({_as_list(name)}, "
                f"n -> try_variant_get(n, '$', 'string')) "
                f"WHEN schema_of_variant(a) = 'STRING' THEN array(try_variant_get(a, '$', 'string')) "
                f"ELSE array() END")
    return (f"filter(flatten(transform({_as_list(v)}, a -> {per_item})), "
            f"x -> x IS NOT NULL AND trim(x) <> '')")


def jsonld_candidates(blocks_col: str) -> Column:
    """ARRAY<VARIANT> of the objects X3 searches (see ``candidates_sql``)."""
    return F.expr(candidates_sql(f"`{blocks_col}`"))


def jsonld_fields(blocks_col: str, candidates_col: str | None = None) -> Column:
    """Title, authors, source and the two dates from a page's JSON-LD blocks.

    ``blocks_col`` names an ARRAY<STRING> column (bind H4's result with
    ``withColumn`` first); pass ``candidates_col`` when ``jsonld_candidates``
    is already bound, so the blocks are parsed once.  Each field is the first
    non-empty hit over the candidate objects; authors are joined with ', ';
    all null without blocks.
    """
    objs = f"`{candidates_col}`" if candidates_col else candidates_sql(f"`{blocks_col}`")
    title = _first("try_variant_get(o, '$.headline', 'string')", objs)
    name_title = _first("try_variant_get(o, '$.name', 'string')", objs,
                        cond=f"coalesce(regexp_like(try_variant_get(o, '$[\"@type\"]', 'string'), "
                             f"'{ARTICLE_TYPES}'), false)")
    author = "try_variant_get(o, '$.author', 'variant')"
    authors_list = (f"try_element_at(filter(transform({objs}, o -> "
                    f"CASE WHEN {author} IS NULL THEN NULL ELSE {_names_of(author)} END), "
                    f"x -> x IS NOT NULL AND size(x) > 0), 1)")
    publisher = "try_variant_get(o, '$.publisher', 'variant')"
    source = _first(f"CASE WHEN {publisher} IS NULL THEN NULL "
                    f"ELSE try_element_at({_names_of(publisher)}, 1) END", objs)
    published = _first("try_variant_get(o, '$.datePublished', 'string')", objs)
    modified = _first("try_variant_get(o, '$.dateModified', 'string')", objs)
    return F.struct(
        F.expr(f"coalesce({title}, {name_title})").alias("title"),
        F.expr(f"array_join({authors_list}, ', ')").alias("authors"),
        F.expr(source).alias("source"),
        F.expr(published).alias("published"),
        F.expr(modified).alias("modified"),
    )
