"""DuckDB SQL building blocks for the oracles.

Each function returns SQL text that restates one column function of the
engine in DuckDB's dialect (RE2 regular expressions, ``lambda`` list
functions).  The oracle queries in ``oracles.py`` are assembled from these.
"""

from __future__ import annotations

from . import oracle_rules as R



def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = R.WS_CLASS
_LET = [0]


def let(x: str, body) -> str:
    """Evaluate ``x`` once and use it in ``body(name)`` (a one-element list lambda)."""
    _LET[0] += 1
    v = f"v{_LET[0]}"
    return f"(list_transform([{x}], lambda {v}: {body(v)}))[1]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def rx(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")


def truncate(x: str, n: int, suffix: str) -> str:
    return let(x, lambda v: f"(CASE WHEN length({v}) > {n} THEN left({v}, {n}) || {lit(suffix)} ELSE {v} END)")


# --- urls ---------------------------------------------------------------------

def valid_url(x: str) -> str:
    return let(strip(x), lambda s: f"coalesce((starts_with({s}, 'http://') OR starts_with({s}, 'https://')) "
                                    f"AND length({s}) >= 10, false)")


def has_scheme(x: str) -> str:
    return f"coalesce({x} <> '' AND (starts_with({x}, 'http://') OR starts_with({x}, 'https://')), false)"


def base_url(x: str) -> str:
    return f"array_to_string(string_split({x}, '/')[1:3], '/')"


# --- text ---------------------------------------------------------------------

# Runs of ASCII stay whole; every other character is its own token, so the
# per-character lists below are only as long as the non-ASCII part of a text.
TOKENS = r"[\x{0}-\x{7f}]+|[^\x{0}-\x{7f}]"


def _latin1_step(x: str) -> str:
    """Encode a string of code points <= U+00FF as Latin-1 and decode the bytes
    as UTF-8; null when that is not valid UTF-8 or a code point is larger."""
    def body(u):
        hexed = (f"array_to_string(list_transform(regexp_extract_all({u}, {lit(TOKENS)}), "
                 f"lambda tk: CASE WHEN unicode(tk) < 128 THEN hex(encode(tk)) "
                 f"ELSE lpad(hex(unicode(tk)), 2, '0') END), '')")
        return (f"(CASE WHEN {u} = '' THEN '' WHEN {matches(u, R.LATIN1_ONLY)} "
                f"THEN TRY(decode(unhex({hexed}))) END)")
    return let(x, body)


def latin1_of_blob(b: str) -> str:
    """Latin-1 reading of a BLOB: one character per byte."""
    return let(f"hex({b})", lambda h: (
        f"array_to_string(list_transform(range(0, length({h}) // 2), "
        f"lambda i: chr(CAST('0x' || substr({h}, 2 * i + 1, 2) AS INTEGER))), '')"))


def utf8_as_latin1(x: str) -> str:
    """Read the UTF-8 bytes of a string as Latin-1: one character per byte
    (ASCII runs are kept whole, other characters are expanded one by one)."""
    per_char = (f"array_to_string(list_transform(range(0, length(hex(encode(tk))) // 2), "
                f"lambda i: chr(CAST('0x' || substr(hex(encode(tk)), 2 * i + 1, 2) AS INTEGER))), '')")
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {lit(TOKENS)}), "
            f"lambda tk: CASE WHEN unicode(tk) < 128 THEN tk ELSE {per_char} END), '')")


def fix_mojibake(x: str) -> str:
    def body(v):
        t = f"translate({v}, {lit(R.CP1252_SPECIALS)}, {lit(R.CP1252_BYTES)})"
        step2 = _latin1_step(_latin1_step(t))
        return f"coalesce(CASE WHEN NOT {matches(v, R.C1_CONTROLS)} THEN {step2} END, {v})"
    return let(x, body)


def html_escape(x: str) -> str:
    s = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = f"replace({s}, {lit(a)}, {lit(b)})"
    return s


# --- html ---------------------------------------------------------------------

def _unescape_one(s: str, ref: str, char: str) -> str:
    s = f"replace({s}, {lit('&' + ref + ';')}, {lit(char)})"
    stop = R.NUMBER_STOP if ref.startswith("#") else R.NAME_STOP
    return f"regexp_replace({s}, {lit('&' + ref + '(' + stop + '|$)')}, {lit(char.replace(chr(92), chr(92) * 2) + chr(92) + '1')}, 'g')"


def unescape(x: str) -> str:
    def body(v):
        s = v
        for ref, char in R.NAMED_ENTITIES + R.NUMERIC_ENTITIES:
            s = _unescape_one(s, ref, char)
        s = _unescape_one(s, "amp", "&")
        return f"(CASE WHEN contains({v}, '&') THEN {s} ELSE {v} END)"
    return let(x, body)


def strip_boilerplate(x: str, repl: str = " ") -> str:
    s = rx(x, R.FIRST_PASS, repl)
    for tag in R.REMOVED_ELEMENTS:
        s = rx(s, R.element_pattern(tag), repl)
    return s


def main_content(x: str) -> str:
    def body(v):
        branches = " ".join(
            f"WHEN {matches(v, R.has_element_pattern(t))} THEN {extract(v, R.inner_pattern(t))}"
            for t in R.CONTENT_CONTAINERS)
        return f"(CASE {branches} ELSE {v} END)"
    return let(x, body)


def html_text(x: str, sep: str = " ") -> str:
    return collapse(unescape(rx(x, R.TAG, sep)))


def paragraphs(x: str) -> str:
    parts = f"regexp_split_to_array({rx(x, R.FIRST_PASS, ' ')}, {lit(R.P_OPEN)})"
    return f"list_transform(({parts})[2:], lambda p: {extract('p', R.P_BODY)})"


def glued(x: str) -> str:
    s = f"replace({x}, '&nbsp;', chr(160))"
    s = rx(s, f"{WS}*(?:{R.TAG}){WS}*", "")
    return rx(unescape(s), f"^{WS}+|{WS}+$", "")


def paragraph_text(x: str) -> str:
    return f"array_to_string(list_transform({paragraphs(x)}, lambda q: {glued('q')}), ' ')"


def table_cells(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {lit(R.TD_CELL)}, 1), lambda c: {html_text('c')})"


# --- json-ld ------------------------------------------------------------------

def ld_blocks(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {lit(R.LD_SCRIPT)}, 1), lambda b: json_valid(b))"


def _as_list(v: str) -> str:
    return f"(CASE WHEN json_type({v}) = 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [{v}] END)"


def candidates(blocks: str) -> str:
    lvl1 = f"flatten(list_transform({blocks}, lambda b: {_as_list('CAST(b AS JSON)')}))"
    lvl2 = f"flatten(list_transform({lvl1}, lambda v: {_as_list('v')}))"
    objs = f"list_filter({lvl2}, lambda o: json_type(o) = 'OBJECT')"
    return (f"flatten(list_transform({objs}, lambda o2: CASE WHEN "
            f"coalesce(json_type(o2, '$.mainEntityOfPage') = 'OBJECT', false) "
            f"THEN [o2, json_extract(o2, '$.mainEntityOfPage')] ELSE [o2] END))")


def _first(expr_over_o: str, objs: str, cond: str | None = None) -> str:
    src = objs if cond is None else f"list_filter({objs}, lambda o: {cond})"
    return (f"(list_filter(list_transform({src}, lambda o: {expr_over_o}), "
            f"lambda x: x IS NOT NULL AND trim(x) <> ''))[1]")


def _names_of(v: str) -> str:
    name = "json_extract(a, '$.name')"
    per_item = (f"CASE WHEN json_type(a) = 'OBJECT' THEN "
                f"CASE WHEN {name} IS NULL THEN [] ELSE "
                f"list_transform({_as_list(name)}, lambda n: json_extract_string(n, '$')) END "
                f"WHEN json_type(a) = 'VARCHAR' THEN [json_extract_string(a, '$')] ELSE [] END")
    return (f"list_filter(flatten(list_transform({_as_list(v)}, lambda a: {per_item})), "
            f"lambda x: x IS NOT NULL AND trim(x) <> '')")


def ld_fields(blocks: str) -> dict[str, str]:
    objs = candidates(blocks)
    title = _first("json_extract_string(o, '$.headline')", objs)
    name_title = _first("json_extract_string(o, '$.name')", objs,
                        cond=f"coalesce(regexp_matches(json_extract_string(o, '$.\"@type\"'), "
                             f"{lit(R.ARTICLE_TYPES)}), false)")
    author = "json_extract(o, '$.author')"
    authors = (f"array_to_string((list_filter(list_transform({objs}, lambda o: "
               f"CASE WHEN {author} IS NULL THEN NULL ELSE {_names_of(author)} END), "
               f"lambda x: x IS NOT NULL AND len(x) > 0))[1], ', ')")
    publisher = "json_extract(o, '$.publisher')"
    source = _first(f"CASE WHEN {publisher} IS NULL THEN NULL ELSE ({_names_of(publisher)})[1] END", objs)
    return {
        "title": f"coalesce({title}, {name_title})",
        "authors": authors,
        "source": source,
        "published": _first("json_extract_string(o, '$.datePublished')", objs),
        "modified": _first("json_extract_string(o, '$.dateModified')", objs),
    }


def has_dates(x: str) -> str:
    tests = []
    for k in R.DATE_KEYS:
        t = f"json_type({x}, '$.{k}')"
        v = f"json_extract_string({x}, '$.{k}')"
        falsy = (f"({t} IS NULL OR {t} = 'NULL' OR ({t} = 'VARCHAR' AND {v} = '') "
                 f"OR ({t} = 'BOOLEAN' AND {v} = 'false') "
                 f"OR ({t} = 'ARRAY' AND json_array_length({x}, '$.{k}') = 0) "
                 f"OR ({t} = 'OBJECT' AND len(json_keys({x}, '$.{k}')) = 0) "
                 f"OR ({t} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AND TRY_CAST({v} AS DOUBLE) = 0))")
        tests.append(f"NOT coalesce({falsy}, false)")
    return "coalesce(" + " OR ".join(tests) + ", false)"


# --- dates --------------------------------------------------------------------

def afp_datetime(x: str) -> str:
    stamp = extract(f"coalesce({x}, '')", r"\.([0-9]{8}T[0-9]{6})Z")
    ts = f"try_strptime(nullif({stamp}, ''), '%Y%m%dT%H%M%S')"
    return f"strftime(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%-m/%-d/%YT%H:%M:%S')"


def to_eastern(x: str) -> str:
    return let(f"trim({x})", _to_eastern)


def _to_eastern(s: str) -> str:
    norm = rx(rx(s, r"([+-][0-9]{2})([0-9]{2})$", r"\1:\2"), "z$", "Z")
    zoned = f"strftime(try_cast({norm} AS TIMESTAMPTZ) AT TIME ZONE 'America/New_York', '%Y-%m-%dT%H:%M:%S')"
    local = f"strftime(try_cast({norm} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')"
    return (f"(CASE WHEN {matches(s, r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} "
            f"THEN CASE WHEN try_cast({s} AS DATE) IS NOT NULL THEN {s} END "
            f"WHEN {matches(s, r'(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$')} THEN {zoned} ELSE {local} END)")


def date_style(x: str) -> str:
    return f"left({to_eastern(x)}, 10)"


# --- url-only metadata ----------------------------------------------------------

def url_host(x: str) -> str:
    return f"lower({extract(f'trim({x})', R.URL_HOST)})"


def url_path(x: str) -> str:
    return extract(f"trim({x})", R.URL_PATH)


def source_from_host(host: str) -> str:
    return let(rx(host, R.HOST_PREFIXES, ""), _source_from_host)


def _source_from_host(h: str) -> str:

    def look(k):
        whens = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in sorted(R.KNOWN_SOURCES.items()))
        return f"(CASE {k} {whens} END)"

    label = f"split_part({h}, '.', 1)"
    fallback = f"(CASE WHEN length({label}) <= 4 THEN upper({label}) ELSE {initcap(label)} END)"
    tail2 = f"array_to_string(string_split({h}, '.')[-2:], '.')"
    tail3 = f"array_to_string(string_split({h}, '.')[-3:], '.')"
    return (f"(CASE WHEN {h} = '' THEN NULL ELSE coalesce({look(h)}, {look(tail2)}, {look(tail3)}, "
            f"{fallback}) END)")


def title_from_path(path: str) -> str:
    def body(parts):
        slug = (f"(CASE WHEN regexp_matches({parts}[-1], '(?i)^index\\.') THEN {parts}[-2] "
                f"ELSE {parts}[-1] END)")
        words = f"replace({rx(slug, R.PAGE_EXT, '')}, '-', ' ')"

        def fin(w):
            alpha = f"len(list_filter(string_split({w}, ' '), lambda w2: regexp_matches(w2, '^[A-Za-z]+$')))"
            return f"(CASE WHEN {alpha} >= 2 THEN {initcap(collapse(w))} END)"
        return let(words, fin)
    return let(f"list_filter(string_split({path}, '/'), lambda x: x <> '')", body)


def authors_from_path(path: str) -> str:
    name = extract(path, R.BYLINE_PATH)
    return f"(CASE WHEN {name} <> '' THEN {initcap(f'replace({name}, ' + lit('-') + ', ' + lit(' ') + ')')} END)"


def _ymd(y: str, m: str, d: str) -> str:
    return f"strftime(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d'), '%Y-%m-%d')"


def _month_no(mon: str) -> str:
    months = "[" + ", ".join(lit(m) for m in R.MONTHS) + "]"
    return f"CAST(list_position({months}, lower({mon})) AS VARCHAR)"


def date_from_path(x: str) -> str:
    return let(x, _date_from_path)


def _date_from_path(path: str) -> str:
    def g(p, i):
        return extract(path, p, i)

    def w(p, expr):
        return f"(CASE WHEN {matches(path, p)} THEN {expr} END)"

    c = [
        w(R.DATE_YMD, _ymd(g(R.DATE_YMD, 1), g(R.DATE_YMD, 2), g(R.DATE_YMD, 3))),
        w(R.DATE_Y_MON_D, _ymd(g(R.DATE_Y_MON_D, 1), _month_no(g(R.DATE_Y_MON_D, 2)), g(R.DATE_Y_MON_D, 3))),
        w(R.DATE_ISO, _ymd(g(R.DATE_ISO, 1), g(R.DATE_ISO, 2), g(R.DATE_ISO, 3))),
        w(R.DATE_D_MON_Y, _ymd(g(R.DATE_D_MON_Y, 3), _month_no(g(R.DATE_D_MON_Y, 2)), g(R.DATE_D_MON_Y, 1))),
        w(R.DATE_COMPACT, _ymd(g(R.DATE_COMPACT, 1), g(R.DATE_COMPACT, 2), g(R.DATE_COMPACT, 3))),
    ]
    return "coalesce(" + ", ".join(c) + ")"


def url_metadata(x: str) -> dict[str, str]:
    path = url_path(x)
    date = date_from_path(path)
    return {
        "title": f"coalesce({title_from_path(path)}, 'unknown')",
        "authors": f"coalesce({authors_from_path(path)}, 'unknown')",
        "source": f"coalesce({source_from_host(url_host(x))}, 'unknown')",
        "published_date": f"coalesce({date}, 'unknown')",
        "modified_date": f"coalesce({date}, 'unknown')",
        "article_text": "'unknown'",
    }


# --- page fallbacks -------------------------------------------------------------

def meta_content(x: str, key: str) -> str:
    k = key.replace(".", r"\.")
    a = (rf"(?is)<meta\s[^>]*?(?:name|property)\s*=\s*[\"']{k}[\"'][^>]*?"
         r"\scontent\s*=\s*[\"']([^\"']*)[\"']")
    b = (r"(?is)<meta\s[^>]*?content\s*=\s*[\"']([^\"']*)[\"'][^>]*?"
         rf"\s(?:name|property)\s*=\s*[\"']{k}[\"']")
    return f"coalesce(nullif({extract(x, a)}, ''), nullif({extract(x, b)}, ''))"


def first_inner_text(x: str, pattern: str) -> str:
    return f"nullif({html_text(extract(x, pattern))}, '')"


def byline_authors(x: str) -> str:
    t = first_inner_text(x, R.BYLINE_INNER)
    t = f"regexp_replace({t}, '(?i)^by\\s+', '')"
    names = (f"list_filter(list_transform(regexp_split_to_array({t}, {lit(r'\s*,\s*|\s+and\s+')}), "
             f"lambda n: trim(n)), lambda n: n <> '')")
    return f"nullif(array_to_string({names}, ', '), '')"


def time_datetime(x: str) -> str:
    return f"nullif({extract(x, R.TIME_ATTR)}, '')"


# --- model responses ------------------------------------------------------------

def json_span(x: str) -> dict[str, str]:
    s = strip(x)

    def span(o, c):
        return let(strip(rx(rx(s, R.FENCE_OPEN, ""), R.FENCE_CLOSE, "")), lambda cl: _span(cl, o, c))

    def _span(cleaned, o, c):
        start = f"strpos({cleaned}, {lit(o)})"
        # 1-based position of the last closing character.
        end = (f"(CASE WHEN strpos({cleaned}, {lit(c)}) > 0 THEN "
               f"length({cleaned}) - length({extract(cleaned, '[' + chr(92) + c + ']([^' + chr(92) + c + ']*)$', 1)}) "
               f"ELSE 0 END)")
        return f"(CASE WHEN {start} > 0 AND {end} > {start} THEN substring({cleaned}, {start}, {end} - {start} + 1) END)"

    sp = f"coalesce({span('{', '}')}, {span('[', ']')})"
    empty = f"({x} IS NULL OR {s} = '')"
    return {
        "span": f"(CASE WHEN NOT {empty} THEN {sp} END)",
        "error": f"(CASE WHEN {empty} THEN {lit(R.ERR_EMPTY)} WHEN {sp} IS NULL THEN {lit(R.ERR_NO_JSON)} END)",
    }


# --- model-output repair ladder ---------------------------------------------------

def _last_char_pos(s: str, ch: str) -> str:
    """1-based position of the last ``ch`` in ``s`` (0 when absent)."""
    return (f"(CASE WHEN strpos({s}, {lit(ch)}) > 0 THEN "
            f"length({s}) - length(regexp_extract({s}, {lit('[' + ch + ']([^' + ch + ']*)$')}, 1)) ELSE 0 END)")


QUOTE_NOT_ESCAPED = r'(^|[^\\])"'
QUOTE_ESCAPED = r'\1\\"'


def _escape_quotes_before_key(line: str) -> str:
    """Repair A, first step, on one line without look-around: every quote not
    preceded by a backslash and standing before the last quote that precedes
    the line's last colon is escaped (two passes cover runs of quotes)."""
    def body(ln):
        colon = _last_char_pos(ln, ":")

        def with_q(q):
            head = rx(rx(f"left({ln}, {q} - 1)", QUOTE_NOT_ESCAPED, QUOTE_ESCAPED), QUOTE_NOT_ESCAPED, QUOTE_ESCAPED)
            return f"(CASE WHEN {q} > 1 THEN {head} || substr({ln}, {q}) ELSE {ln} END)"
        return let(f"left({ln}, {colon} - 1)", lambda prefix: let(_last_char_pos(prefix, '"'), with_q))
    return let(line, body)


def _escape_value_controls(line: str) -> str:
    """Repair A, second step, on one line: CR and TAB escaped inside
    ``: "value"`` spans (matched without look-around)."""
    span = r': "(.*?)("[,}])'

    def body(ln):
        vals = f"regexp_extract_all({ln}, {lit(span)}, 1)"
        terms = f"regexp_extract_all({ln}, {lit(span)}, 2)"
        pieces = f"regexp_split_to_array({ln}, {lit(span)})"
        fix = "replace(replace(vals[i - 1], chr(13), '\\r'), chr(9), '\\t')"
        return (f"(CASE WHEN NOT (contains({ln}, chr(9)) OR contains({ln}, chr(13))) THEN {ln} ELSE "
                f"(list_transform([{{'vals': {vals}, 'terms': {terms}, 'pieces': {pieces}}}], lambda z: "
                f"array_to_string(list_transform(range(1, len(z.pieces) + 1), lambda i: CASE WHEN i = 1 "
                f"THEN z.pieces[1] ELSE ': \"' || {fix.replace('vals', 'z.vals')} || z.terms[i - 1] || z.pieces[i] END),"
                f" '')))[1] END)")
    return let(line, body)


def repair_a(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, chr(10)), lambda ln0: "
            f"{_escape_value_controls(_escape_quotes_before_key('ln0'))}), chr(10))")


def repair_b(x: str) -> str:
    esc = f"replace(replace(replace({x}, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return rx(esc, R.OPEN_STRING, r'\1"\2')
