"""DuckDB oracle SQL, one statement per registered query.

The driver runs each statement against views named after the parquet tables
(``pages``, ``events``, ``documents``, ``conversations`` ...).  The derived
inputs of ``inputs.py`` are restated here as CTEs, rule for rule; the
operators are restated with the building blocks of ``oracle_sql.py``.
The one query left out of ``ORACLES`` (``corpus_scan``: DuckDB cannot list the
folder the query is given) gets the driver's rows-only check plus a pytest.
"""

from __future__ import annotations

from . import oracle_rules as R
from . import oracle_sql as S
from .inputs import HOSTS, STATUS_OF_EVENT
from .pipeline import (EXTRACTOR_PAGE, EXTRACTOR_URL, ERR_DEFAULT, ERR_INVALID, ERR_NO_PAGE,
                       RECORD_FIELDS, RESULT_COLUMNS)
from .queries import BATCH_CAP, ROW_SLICE

lit = S.lit
NA_SQL = "'N/A'"


def _pick(idx: str, values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + f"][({idx}) + 1]"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# --- derived inputs ------------------------------------------------------------

LINES = f"""lines AS (
  SELECT page_id AS line_no,
         CASE WHEN page_id % 5 = 0 THEN '   '
              WHEN page_id % 7 = 0 THEN '  ' || regexp_replace(url, '^https?://', '') || ' '
              ELSE ' ' || url || chr(9) END AS line
  FROM pages)"""

CLEAN_LINES = f"""clean_lines AS (
  SELECT line_no, {S.strip('line')} AS url FROM lines WHERE {S.strip('line')} <> '')"""

BLOBS = """blobs AS (
  SELECT line_no // 10 AS blob_id,
         CASE WHEN (line_no // 10) % 2 = 0 THEN string_agg(line, chr(10) ORDER BY line_no)
              ELSE string_agg(line, ',' ORDER BY line_no) END AS blob
  FROM lines GROUP BY line_no // 10)"""

SPLIT_URLS = f"""split_urls AS (
  SELECT DISTINCT blob_id, u AS url FROM (
    SELECT blob_id, {S.strip('part')} AS u
    FROM blobs, unnest(regexp_split_to_array(blob, '[\\n,]')) AS t(part))
  WHERE {S.valid_url('u')})"""

BLOCKED = f"""blocked_bases AS (
  SELECT DISTINCT {S.base_url(S.strip('url'))} AS base_url
  FROM pages WHERE page_id % 10 = 0 AND {S.strip('url')} <> '')"""


def _pub_date(p: str) -> str:
    return (f"'2025-0' || {_s(p + ' % 9 + 1')} || '-1' || {_s(p + ' % 10')} || 'T1' || {_s(p + ' % 10')}"
            f" || ':30:00' || {_pick(p + ' % 4', ['Z', '-05:00', '.000Z', ''])}")


def _mod_date(p: str) -> str:
    return (f"'2025-0' || {_s(p + ' % 9 + 1')} || '-2' || {_s(p + ' % 8')} || 'T0' || {_s(p + ' % 10')}"
            f" || ':05:00Z'")


def _article_ld(p: str) -> str:
    author = _pick(f"{p} % 4", [
        '{"@type": "Person", "name": "Ann Lee"}',
        '[{"@type": "Person", "name": "Ann Lee"}, {"@type": "Person", "name": "Bo Chen"}]',
        '{"@type": "Person", "name": ["Cy Diaz", "Di Eze"]}',
        '"Ed Fox"'])
    modified = f"(CASE WHEN {p} % 2 = 0 THEN ', \"dateModified\": \"' || {_mod_date(p)} || '\"' ELSE '' END)"
    return ("'{\"@context\": \"https://schema.org\", \"@type\": \"NewsArticle\", \"headline\": \"Story ' || "
            f"{_s(p)} || '\", \"author\": ' || {author} || "
            f"', \"publisher\": {{\"@type\": \"Organization\", \"name\": \"Desk ' || {_s(p + ' % 5')} || "
            f"'\"}}, \"datePublished\": \"' || {_pub_date(p)} || '\"' || {modified} || '}}'")


def _video_ld(p: str) -> str:
    return ("'[[{\"@type\": \"VideoObject\", \"name\": \"Clip ' || " + _s(p) +
            " || '\", \"dateModified\": \"' || " + _mod_date(p) +
            " || '\", \"mainEntityOfPage\": {\"@type\": \"WebPage\", \"headline\": \"Video story ' || " + _s(p) +
            " || '\", \"datePublished\": \"' || " + _pub_date(p) +
            " || '\", \"publisher\": {\"@type\": \"NewsMediaOrganization\", \"name\": \"Channel ' || "
            + _s(p + " % 3") + " || '\"}}}]]'")


def _script(body: str) -> str:
    return f"'<script type=\"application/ld+json\">' || {body} || '</script>'"


RICH = f"""rich AS (
  SELECT page_id, url,
    CASE WHEN page_id % 4 = 0 THEN replace(replace(h2, '<article>', '<main>'), '</article>', '</main>')
         ELSE h2 END AS html
  FROM (
    SELECT page_id, url,
      replace(replace(html, '</head>',
        (CASE WHEN page_id % 3 = 0 THEN {_script(_article_ld('page_id'))} ELSE '' END) ||
        (CASE WHEN page_id % 3 = 1 THEN {_script(_video_ld('page_id'))} ELSE '' END) ||
        (CASE WHEN page_id % 7 = 0 THEN {_script("'{\"@type\": \"NewsArticle\", \"headline\": \"Broken ' || " + _s('page_id') + " || '\"'")} ELSE '' END) ||
        (CASE WHEN page_id % 5 = 0 THEN '<meta property=\"og:title\" content=\"Headline ' || {_s('page_id')} ||
              '\"><meta name=\"author\" content=\"Gil Ho\"><meta property=\"og:site_name\" content=\"Site ' ||
              {_s('page_id % 4')} || '\"><meta property=\"article:published_time\" content=\"2025-03-0' ||
              {_s('page_id % 9 + 1')} || 'T08:00:00Z\">' ELSE '' END) || '</head>'),
        '</h1>',
        CASE WHEN page_id % 5 = 1 THEN '</h1><p class=\"byline\">By Cy Diaz and Di Eze</p><time datetime=\"2025-02-1' ||
             {_s('page_id % 10')} || 'T09:15:00-05:00\">Feb</time>' ELSE '</h1>' END) AS h2
    FROM pages))"""


def _dated_urls_cte() -> str:
    e = "event_id"
    yyyy = "strftime(ts, '%Y')"
    mm = f"(CASE WHEN {e} % 17 = 0 THEN '13' ELSE strftime(ts, '%m') END)"
    dd = "strftime(ts, '%d')"
    d = "strftime(ts, '%-d')"
    mon = "lower(strftime(ts, '%b'))"
    slug = f"(CASE WHEN {e} % 9 = 0 THEN 'a' || {_s(e)} ELSE event_type || '-market-' || {_s('user_id')} || '-update' END)"
    path = (f"(CASE {e} % 5 WHEN 0 THEN concat_ws('/', '', {yyyy}, {mm}, {dd}, 'world', {slug}) "
            f"WHEN 1 THEN concat_ws('/', '', {yyyy}, {mon}, {d}, {slug}) "
            f"WHEN 2 THEN '/news/' || {slug} || '-' || {yyyy} || '-' || {mm} || '-' || {dd} "
            f"WHEN 3 THEN '/' || {d} || '-' || {mon} || '-' || {yyyy} || '/' || {slug} || '.html' "
            f"ELSE '/video/' || {yyyy} || {mm} || {dd} || '-' || {slug} || '/index.html' END)")
    path = f"(CASE WHEN {e} % 8 = 3 THEN '/by/jane-roe' || {path} ELSE {path} END)"
    stamp_mm = f"(CASE WHEN {e} % 23 = 0 THEN '13' ELSE strftime(ts, '%m') END)"
    frag = (f"(CASE WHEN {e} % 4 = 0 THEN '#doc.' || {yyyy} || {stamp_mm} || {dd} || 'T' || "
            f"strftime(ts, '%H%M%S') || 'Z' ELSE '' END)")
    return (f"dated AS (SELECT event_id, ts, 'https://' || {_pick(e + ' % 6', HOSTS)} || {path} || {frag} AS url,"
            f" event_type, user_id, props FROM events)")


DATED = _dated_urls_cte()


def _log_cte() -> str:
    status = "CASE event_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in STATUS_OF_EVENT.items()) \
        + " ELSE 'error_future' END"
    ok = "starts_with(status, 'success')"
    return f"""log AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS run_id, url,
    CASE WHEN {ok} THEN 'Title ' || {_s('event_id')} ELSE '' END AS title,
    CASE WHEN {ok} THEN CASE WHEN event_id % 3 = 0 THEN 'Ann Lee, Bo Chen' ELSE 'N/A' END ELSE '' END AS authors,
    CASE WHEN {ok} THEN CASE WHEN event_id % 3 = 0 THEN ' afp ' ELSE 'Reuters' END ELSE '' END AS source,
    CASE WHEN {ok} THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS published_date,
    CASE WHEN {ok} THEN CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'N/A' END ELSE '' END
      AS modified_date,
    CASE WHEN status = 'success' THEN {lit(EXTRACTOR_PAGE)} WHEN status = 'success_url_parser'
      THEN {lit(EXTRACTOR_URL)} ELSE 'N/A' END AS llm_used,
    status,
    CASE WHEN {ok} THEN '' ELSE 'failed: ' || event_type END AS error_message,
    CASE WHEN {ok} AND event_id % 10 <> 0 THEN props ELSE '' END AS article_text
  FROM (SELECT *, {status} AS status FROM dated))"""


LOG = _log_cte()


def _json_body(x: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def _responses_cte() -> str:
    rid = "(conv_id * 1000 + turn)"
    d = _s(f"{rid} % 9 + 1")

    def rec(body, number_date=False, drop_text=False):
        date = (_s(f"20250101 + {rid} % 9") if number_date else f"'\"2025-01-0' || {d} || '\"'")
        out = (f"'{{\"title\": \"Reply ' || {_s(rid)} || '\", \"authors\": \"' || role || "
               f"'\", \"source\": \"Chat\", \"published_date\": ' || {date} || "
               f"', \"modified_date\": \"2025-02-0' || {d} || '\"'")
        if not drop_text:
            out += f" || ', \"article_text\": \"' || {body} || '\"'"
        return out + " || '}'"

    clean = rec(_json_body("text"))
    k = f"{rid} % 8"
    resp = (f"CASE WHEN {k} = 0 THEN {clean} "
            f"WHEN {k} = 1 THEN '```json' || chr(10) || {clean} || chr(10) || '```' "
            f"WHEN {k} = 2 THEN 'Here is the record: ' || {clean} || ' Hope it helps.' "
            f"WHEN {k} = 3 THEN {rec(None, drop_text=True)} "
            f"WHEN {k} = 4 THEN {rec('text')} "
            f"WHEN {k} = 5 THEN left({clean}, CAST(greatest(floor(length({clean}) / 2), 1) AS BIGINT)) "
            f"WHEN {k} = 6 THEN '[' || {clean} || ']' "
            f"ELSE {rec(_json_body('text'), number_date=True)} END")
    resp = f"CASE WHEN {rid} % 13 = 0 THEN '' WHEN {rid} % 11 = 0 THEN text ELSE {resp} END"
    return f"responses AS (SELECT {rid} AS id, {resp} AS response FROM conversations)"


RESPONSES = _responses_cte()


def _ip(a, b, c, d):
    return "concat_ws('.', " + ", ".join(_s(f"({x}) % 256") for x in (a, b, c, d)) + ")"


ENDPOINT_TEXT = ("endpoint_text AS (SELECT event_id, 'proxy ' || "
                 + _ip("user_id", "event_id", "event_id // 256", "user_id * 7") + " || ':' || "
                 + _s("8000 + event_id % 1000") + " || ' up; bad 10.0.' || " + _s("event_id % 9")
                 + " || ':80; alt ' || " + _ip("event_id * 3", "user_id + 1", "event_id", "10")
                 + " || ':' || " + _s("3128 + user_id % 7") + " || chr(10) AS text FROM events)")


def _table_row(a: str, b: str) -> str:
    cells = [_ip(a, b, "event_id", "user_id"), _s(f"1000 + (({a}) + ({b})) % 9000"), "'US'",
             "'United States'", "'anonymous'", "'no'", "'yes'", "'1 min ago'"]
    return "'<tr>' || " + " || ".join(f"'<td> ' || {c} || ' </td>'" for c in cells) + " || '</tr>'"


ENDPOINT_TABLES = ("endpoint_tables AS (SELECT event_id, '<table class=\"table\"><tbody>' || "
                   + _table_row("event_id", "user_id") + " || " + _table_row("user_id + 5", "event_id + 1")
                   + " || '</tbody></table>' AS html FROM events)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- page metadata (X2) as SQL --------------------------------------------------

def _page_meta_cte(src: str = "rich", name: str = "page_meta") -> str:
    h1 = S.strip_boilerplate("html")
    f = S.ld_fields("ld_blocks")
    title = (f"coalesce(ld_title, {S.meta_content('html', 'og:title')}, "
             f"{S.first_inner_text('h1s', R.H1_INNER)}, {S.first_inner_text('html', R.TITLE_INNER)})")
    authors = f"coalesce(ld_authors, {S.meta_content('html', 'author')}, {S.byline_authors('html')})"
    source = (f"coalesce(ld_source, {S.meta_content('html', 'og:site_name')}, "
              f"{S.source_from_host(S.url_host('url'))})")
    published = (f"coalesce(ld_published, {S.meta_content('html', 'article:published_time')}, "
                 f"{S.time_datetime('html')})")
    modified = f"coalesce(ld_modified, {S.meta_content('html', 'article:modified_time')})"
    return f"""{name}_a AS (
  SELECT *, {S.html_text(S.main_content('h1s'))} AS content FROM (
    SELECT *, {h1} AS h1s, {S.ld_blocks('html')} AS ld_blocks FROM {src})),
{name}_b AS (
  SELECT *, {f['title']} AS ld_title, {f['authors']} AS ld_authors, {f['source']} AS ld_source,
    {f['published']} AS ld_published, {f['modified']} AS ld_modified FROM {name}_a),
{name} AS (
  SELECT page_id, url, {title} AS title, {authors} AS authors, {source} AS source,
    {S.date_style(published)} AS published_date,
    coalesce({S.date_style(modified)}, {S.date_style(published)}) AS modified_date,
    content AS article_text
  FROM {name}_b)"""


def _process_ctes(urls_cte: str) -> str:
    """SQL for X4 over a CTE named ``urls(pos, url)``; defines ``processed``."""
    um = S.url_metadata("url")
    rec = ", ".join(
        f"CASE WHEN status = 'success_url_parser' THEN {um[c]} WHEN status = 'success' THEN m_{c} END AS {c}"
        for c in RECORD_FIELDS)
    return f"""{urls_cte},
{BLOCKED},
{RICH},
{_page_meta_cte()},
routed AS (
  SELECT u.pos, u.url, {S.has_scheme('u.url')} AS valid,
         coalesce(b.base_url IS NOT NULL, false) AS blocked
  FROM urls u LEFT JOIN blocked_bases b ON {S.base_url('u.url')} = b.base_url),
joined AS (
  SELECT r.*, m.page_id IS NOT NULL AS found,
    {", ".join(f"m.{c} AS m_{c}" for c in RECORD_FIELDS)},
    CASE WHEN NOT r.valid THEN 'error_invalid_url' WHEN r.blocked THEN 'success_url_parser'
         WHEN m.page_id IS NULL THEN 'error_scraping' ELSE 'success' END AS status
  FROM routed r LEFT JOIN page_meta m ON r.url = m.url AND r.valid AND NOT r.blocked),
processed AS (
  SELECT pos, url, {rec},
    CASE WHEN status = 'success_url_parser' THEN {lit(EXTRACTOR_URL)} WHEN status = 'success'
         THEN {lit(EXTRACTOR_PAGE)} ELSE 'N/A' END AS llm_used,
    status,
    CASE WHEN status = 'error_invalid_url' THEN {lit(ERR_INVALID)}
         WHEN status = 'error_scraping' THEN {lit(ERR_NO_PAGE)} END AS error_message,
    starts_with(status, 'success') AS has_record
  FROM joined)"""


def _result_rows_select(src: str, keep: str) -> str:
    cols = [f"{keep}", "url"]
    for c in RECORD_FIELDS[:-1]:
        cols.append(f"CASE WHEN has_record THEN coalesce({c}, 'N/A') ELSE '' END AS {c}")
    cols += [
        "CASE WHEN has_record THEN llm_used ELSE coalesce(llm_used, 'N/A') END AS llm_used",
        "status",
        f"CASE WHEN has_record THEN '' ELSE coalesce(error_message, {lit(ERR_DEFAULT)}) END AS error_message",
        f"CASE WHEN has_record THEN {S.fix_mojibake(f'left(coalesce(article_text, {NA_SQL}), {R.CSV_TEXT_LIMIT})')}"
        " ELSE '' END AS article_text",
    ]
    return f"SELECT {', '.join(cols)} FROM {src}"


URL_LIST = f"""urls AS (
  SELECT line_no AS pos, {S.strip('line')} AS url FROM lines
  UNION ALL
  SELECT event_id + 1000000000 AS pos, url FROM dated)"""


def _lonely(cols: list[str]) -> str:
    first = f"coalesce({S.strip(cols[0])}, '') <> ''"
    rest = " AND ".join(f"coalesce({S.strip(c)}, '') = ''" for c in cols[1:])
    return f"({first} AND {rest})"


OLD_RESULTS = """old AS (
  SELECT page_id AS row_no, ' ' || url AS url,
    """ + ",\n    ".join(
    f"CASE WHEN page_id % 6 = 0 THEN CASE WHEN page_id % 12 = 0 THEN ' ' ELSE '' END ELSE {v} END AS {k}"
    for k, v in [("title", "'Old ' || CAST(page_id AS VARCHAR)"), ("authors", "'N/A'"), ("source", "'Wire'"),
                 ("published_date", "'2025-01-01'"), ("modified_date", "'2025-01-01'"),
                 ("llm_used", "'page-rules'"), ("status", "'success'"), ("error_message", "''"),
                 ("article_text", "'kept'")]) + "\n  FROM pages)"


def _stamps_cte() -> str:
    base = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    s = (f"CASE event_id % 5 WHEN 0 THEN {base} || 'Z' WHEN 1 THEN {base} || '.250+02:00' "
         f"WHEN 2 THEN {base} WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE {base} || '-0700' END")
    return f"stamps AS (SELECT event_id, {s} AS stamp FROM events)"


def _csv_rows_cte() -> str:
    return """csv_rows AS (
  SELECT page_id // 25 AS file_id,
    CASE WHEN (page_id // 25) % 3 = 0 THEN CASE WHEN page_id % 4 = 0 THEN url END
         ELSE 'row ' || CAST(page_id AS VARCHAR) END AS c0,
    ' ' || url AS c1,
    'note ' || CAST(page_id % 7 AS VARCHAR) AS c2
  FROM pages)"""


def _mojibake_cte() -> str:
    once = S.utf8_as_latin1("text")
    twice = f"translate({S.utf8_as_latin1(once)}, {lit(R.CP1252_BYTES)}, {lit(R.CP1252_SPECIALS)})"
    return (f"moji AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN {once} ELSE {twice} END"
            f" AS input FROM documents)")


# --- the statements -------------------------------------------------------------

def _h1_text(src: str) -> str:
    return S.html_text(S.main_content(f"({S.strip_boilerplate('html')})"))


H1_SQL = f"({S.strip_boilerplate('html')})"

PAYLOAD = f"""payload AS (
  SELECT page_id, url, ld_blocks,
    CASE WHEN content <> '' THEN {S.fix_mojibake(S.truncate('content', R.CONTENT_LIMIT, R.CONTENT_SUFFIX))}
         ELSE '' END AS website_content,
    len(ld_blocks) > 0 AS has_json_ld,
    CASE WHEN len(ld_blocks) > 0 THEN coalesce({S.collapse(S.paragraph_text('html'))}, '') END AS ld_article_text,
    CASE WHEN NOT coalesce(list_bool_or(list_transform(ld_blocks, lambda b: {S.has_dates('b')})), false)
         THEN left({S.strip_boilerplate('html', '')}, 20000) END AS raw_html_for_dates
  FROM (SELECT *, {S.html_text(S.main_content('h1s'))} AS content FROM (
    SELECT page_id, url, html, {S.strip_boilerplate('html')} AS h1s, {S.ld_blocks('html')} AS ld_blocks FROM rich)))"""


def _js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


PAYLOAD_TEXT = S.truncate(
    "'{\"url\":' || coalesce(" + _js("url") + ", 'null') || ',\"website_content\":' || " + _js("website_content")
    + " || CASE WHEN has_json_ld THEN ',\"json_ld\":{\"ld_json_list\":[' || array_to_string(ld_blocks, ',') || "
    + "'],\"article_text\":' || " + _js("ld_article_text") + " || '}' ELSE '' END"
    + " || CASE WHEN raw_html_for_dates IS NOT NULL THEN ',\"raw_html_for_dates\":' || "
    + _js("raw_html_for_dates") + " ELSE '' END || '}'",
    R.PAYLOAD_LIMIT, R.PAYLOAD_SUFFIX)

ORACLES: dict[str, str] = {
    "clean_content": f"SELECT page_id, {_h1_text('pages')} AS content FROM pages",
    "strip_boilerplate": f"SELECT page_id, {S.strip_boilerplate('html')} AS stripped FROM pages",
    "main_content": with_(RICH) + f"SELECT page_id, {S.main_content(H1_SQL)} AS main_html FROM rich",
    "raw_html_for_dates": with_(RICH) + f"SELECT page_id, left({S.strip_boilerplate('html', '')}, 20000) AS raw_html FROM rich",
    "paragraph_text": f"SELECT page_id, {S.paragraph_text('html')} AS paragraph_text FROM pages",
    "jsonld_blocks": with_(RICH) + f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS block_no, b[i] AS block
      FROM (SELECT page_id, {S.ld_blocks('html')} AS b FROM rich), range(1, len(b) + 1) AS t(i)""",
    "jsonld_wrapper": with_(RICH) + f"""SELECT page_id, CAST(len(b) AS BIGINT) AS n_blocks,
      coalesce({S.collapse(S.paragraph_text('html'))}, '') AS article_text
      FROM (SELECT page_id, html, {S.ld_blocks('html')} AS b FROM rich) WHERE len(b) > 0""",
    "jsonld_has_dates": with_(RICH) + f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS block_no, {S.has_dates('b[i]')} AS has_dates
      FROM (SELECT page_id, {S.ld_blocks('html')} AS b FROM rich), range(1, len(b) + 1) AS t(i)""",
    "jsonld_fields": with_(RICH) + "SELECT page_id, " + ", ".join(
        f"{v} AS {k}" for k, v in S.ld_fields("ld_blocks").items()) +
        f" FROM (SELECT page_id, {S.ld_blocks('html')} AS ld_blocks FROM rich) WHERE len(ld_blocks) > 0",
    "table_endpoints": with_(ENDPOINT_TABLES) + f"""SELECT event_id, pos, endpoint FROM (
      SELECT event_id, CAST(i - 1 AS BIGINT) AS pos,
        CASE WHEN ports[i] IS NOT NULL THEN ips[i] || ':' || ports[i] END AS endpoint
      FROM (SELECT event_id,
              list_filter(cells, lambda x, j: (j - 1) % 8 = 0) AS ips,
              list_filter(cells, lambda x, j: (j - 1) % 8 = 1) AS ports
            FROM (SELECT event_id, {S.table_cells('html')} AS cells FROM endpoint_tables)),
           range(1, greatest(len(ips), len(ports)) + 1) AS t(i))
      WHERE endpoint IS NOT NULL""",
    "page_metadata": with_(RICH, _page_meta_cte()) + "SELECT page_id, " + ", ".join(RECORD_FIELDS) + " FROM page_meta",
    "url_metadata": with_(DATED) + "SELECT event_id, url, " + ", ".join(
        f"{v} AS {k}" for k, v in S.url_metadata("url").items()) + " FROM dated",
    "build_payload": with_(RICH, PAYLOAD) + """SELECT page_id, website_content, has_json_ld, ld_article_text,
        raw_html_for_dates FROM payload""",
    "payload_text": with_(RICH, PAYLOAD) + f"SELECT page_id, {PAYLOAD_TEXT} AS payload_text FROM payload",
    "afp_datetime": with_(DATED) + f"SELECT event_id, {S.afp_datetime('url')} AS afp_datetime FROM dated",
    "afp_enrich": with_(DATED, LOG) + f"""SELECT event_id, source,
        CASE WHEN hit THEN stamp ELSE published_date END AS published_date,
        CASE WHEN hit THEN stamp ELSE modified_date END AS modified_date
      FROM (SELECT *, {S.afp_datetime('url')} AS stamp,
              upper({S.strip("coalesce(source, '')")}) = 'AFP' AND {S.afp_datetime('url')} IS NOT NULL AS hit
            FROM log)""",
    "to_eastern": with_(_stamps_cte()) + f"SELECT event_id, stamp, {S.to_eastern('stamp')} AS eastern FROM stamps",
    "url_lines": with_(LINES, CLEAN_LINES) + "SELECT line_no, url FROM clean_lines",
    "validate_url": with_(LINES) + f"SELECT line_no, line, {S.valid_url('line')} AS valid FROM lines",
    "scheme_check": with_(LINES) + f"SELECT line_no, {S.has_scheme('line')} AS has_scheme FROM lines",
    "base_url": with_(DATED) + f"SELECT event_id, {S.base_url('url')} AS base_url FROM dated",
    "urls_from_text": with_(LINES, BLOBS, SPLIT_URLS) + "SELECT blob_id, url FROM split_urls",
    "urls_from_csv_column": with_(_csv_rows_cte()) + f"""SELECT DISTINCT r.file_id, CASE f.col_no
          WHEN 0 THEN r.c0 WHEN 1 THEN r.c1 WHEN 2 THEN r.c2 END AS url
      FROM csv_rows r JOIN (
        SELECT file_id, CASE WHEN bool_or({S.valid_url('c0')}) THEN 0 WHEN bool_or({S.valid_url('c1')}) THEN 1
                             WHEN bool_or({S.valid_url('c2')}) THEN 2 END AS col_no
        FROM csv_rows GROUP BY file_id) f ON r.file_id = f.file_id
      WHERE f.col_no IS NOT NULL AND (CASE f.col_no WHEN 0 THEN r.c0 WHEN 1 THEN r.c1 ELSE r.c2 END) IS NOT NULL
        AND {S.valid_url("CASE f.col_no WHEN 0 THEN r.c0 WHEN 1 THEN r.c1 ELSE r.c2 END")}""",
    "distinct_urls": with_(LINES, CLEAN_LINES) + f"SELECT DISTINCT {S.base_url('url')} AS base_url FROM clean_lines",
    "blocked_urls": with_(BLOCKED) + f"""SELECT page_id, url FROM pages
      WHERE {S.base_url('url')} IN (SELECT base_url FROM blocked_bases)""",
    "open_urls": with_(BLOCKED) + f"""SELECT page_id, url FROM pages
      WHERE {S.base_url('url')} NOT IN (SELECT base_url FROM blocked_bases)""",
    "route_urls": with_(BLOCKED) + f"""SELECT page_id, url, {S.base_url('url')} AS base_url,
        {S.base_url('url')} IN (SELECT base_url FROM blocked_bases) AS blocked FROM pages""",
    "page_lookup": with_(LINES, CLEAN_LINES) + """SELECT l.line_no, l.url, p.html IS NOT NULL AS found,
        CAST(coalesce(length(p.html), 0) AS BIGINT) AS html_chars
      FROM clean_lines l LEFT JOIN pages p ON l.url = p.url""",
    "row_labels": with_(LINES, CLEAN_LINES) + """SELECT line_no, row_number() OVER (ORDER BY line_no) AS row_no,
        CAST(row_number() OVER (ORDER BY line_no) AS VARCHAR) || '/' || CAST(count(*) OVER () AS VARCHAR) AS label
      FROM clean_lines""",
    "row_slice": with_(LINES, CLEAN_LINES) + f"""SELECT line_no, url FROM (
        SELECT line_no, url, row_number() OVER (ORDER BY line_no) AS rn FROM clean_lines)
      WHERE rn > {ROW_SLICE[0]} AND rn <= {ROW_SLICE[1]}""",
    "batch_cap": with_(LINES, BLOBS, SPLIT_URLS) + f"""SELECT blob_id, url, batch_size, batch_size > {BATCH_CAP} AS refused,
        CASE WHEN batch_size > {BATCH_CAP} THEN 'Too many URLs (' || CAST(batch_size AS VARCHAR) ||
             '). Maximum allowed: {BATCH_CAP}' END AS error
      FROM (SELECT *, count(*) OVER (PARTITION BY blob_id) AS batch_size FROM split_urls)""",
    "run_stats": with_(DATED, LOG) + """SELECT count(*) AS total,
        count(*) FILTER (WHERE status = 'success') AS successful,
        count(*) - count(*) FILTER (WHERE status = 'success') AS failed,
        count(*) FILTER (WHERE coalesce(article_text, '') <> '') AS with_text,
        count(*) FILTER (WHERE starts_with(status, 'success')) AS with_record
      FROM log""",
    "running_progress": with_(DATED, LOG) + """SELECT event_id, run_id,
        count(*) OVER w AS completed,
        CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS successful_so_far,
        count(*) OVER (PARTITION BY run_id) AS total
      FROM log WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "outcome_split": with_(DATED, LOG) + """SELECT event_id,
        CASE WHEN starts_with(status, 'success') THEN 'successful' ELSE 'failed' END AS side FROM log""",
    "retry_candidates": with_(DATED, LOG) + """SELECT event_id, status FROM log
      WHERE status <> 'success' AND event_id % 2 = 0 AND article_text IS NOT NULL""",
    "lonely_rows": with_(OLD_RESULTS) + f"SELECT row_no, {_lonely(list(RESULT_COLUMNS))} AS lonely FROM old",
    "collapse_ws": f"SELECT doc_id, {S.collapse('text')} AS collapsed FROM documents",
    "scrub_text": f"SELECT doc_id, coalesce({S.collapse('text')}, '') AS scrubbed FROM documents",
    "scrub_text_legacy": f"SELECT doc_id, coalesce({S.collapse(S.utf8_as_latin1('text'))}, '') AS scrubbed FROM documents",
    "fix_mojibake": with_(_mojibake_cte()) + f"SELECT doc_id, md5({S.fix_mojibake('input')}) AS fixed_md5 FROM moji",
    "truncate_content": f"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (
        SELECT doc_id, {S.truncate(S.collapse('text'), R.CONTENT_LIMIT, R.CONTENT_SUFFIX)} AS t FROM documents)""",
    "extract_endpoints": with_(ENDPOINT_TEXT) + f"""SELECT event_id, CAST(i - 1 AS BIGINT) AS pos, m[i] AS endpoint
      FROM (SELECT event_id, regexp_extract_all(text, {lit(r'[0-9]+(?:\.[0-9]+){3}:[0-9]+')}) AS m FROM endpoint_text),
           range(1, len(m) + 1) AS t(i)""",
    "llm_json_span": with_(RESPONSES) + "SELECT id, " + ", ".join(
        f"{v} AS {k}" for k, v in S.json_span("response").items()) + " FROM responses",
}


def _preview_sql() -> str:
    rec = "starts_with(status, 'success')"

    def dflt(c, d):
        return S.fix_mojibake(f"coalesce(nullif({c}, ''), {lit(d)})")

    title = dflt("title", "Untitled Article")
    short_title = f"(CASE WHEN length({title}) > 80 THEN left({title}, 80) || '...' ELSE {title} END)"
    short_url = "(CASE WHEN length(url) > 60 THEN left(url, 60) || '...' ELSE url END)"
    label = (f"CASE WHEN {rec} THEN '✅ ' || {short_title} ELSE '❌ ' || {short_url} || ' (' || "
             f"coalesce(status, 'Unknown') || ')' END")
    pub = dflt("published_date", "N/A")
    mod = dflt("modified_date", "N/A")
    body = S.fix_mojibake("coalesce(article_text, '')")
    preview = f"(CASE WHEN length({body}) > 1000 THEN left({body}, 1000) || '...' ELSE {body} END)"
    return with_(DATED, LOG) + f"""SELECT event_id, url, {label} AS label,
        CASE WHEN {rec} THEN {title} END AS title,
        CASE WHEN {rec} THEN {dflt('authors', 'N/A')} END AS authors,
        CASE WHEN {rec} THEN {dflt('source', 'N/A')} END AS source,
        CASE WHEN {rec} THEN {pub} END AS published,
        CASE WHEN {rec} AND {mod} <> 'N/A' AND {mod} <> {pub} THEN {mod} END AS updated,
        CASE WHEN {rec} AND {body} <> '' THEN {S.html_escape(preview)} END AS preview
      FROM log"""


ORACLES["result_preview"] = _preview_sql()
ORACLES["process_urls"] = (with_(LINES, DATED, _process_ctes(URL_LIST)) +
                           "SELECT pos, url, status, llm_used, error_message, " + ", ".join(RECORD_FIELDS) +
                           " FROM processed")
ORACLES["result_rows"] = with_(LINES, DATED, _process_ctes(URL_LIST)) + _result_rows_select("processed", "pos")
# The CSV round trip: the same rows, with empty cells read back as null.
ORACLES["result_csv_roundtrip"] = (
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RESULT_COLUMNS) + " FROM ("
    + with_(LINES, DATED, _process_ctes(URL_LIST)) + _result_rows_select("processed", "pos") + ")")
ORACLES["reprocess_lonely"] = (
    with_(OLD_RESULTS, _process_ctes(f"urls AS (SELECT row_no AS pos, {S.strip('url')} AS url FROM old "
                                     f"WHERE {_lonely(list(RESULT_COLUMNS))})"))
    + "SELECT row_no, " + ", ".join(RESULT_COLUMNS) + f" FROM old WHERE NOT {_lonely(list(RESULT_COLUMNS))}"
    + " UNION ALL " + _result_rows_select("processed", "pos AS row_no"))

# --- sources ----------------------------------------------------------------------

PAGE_BYTES = ("page_bytes AS (SELECT page_id, encode(html) || CASE WHEN page_id % 3 = 0 THEN unhex('E9') "
              "ELSE unhex('') END AS content FROM pages)")
UPLOADS = ("uploads AS (SELECT blob_id, 'upload-' || CAST(blob_id AS VARCHAR) || '.txt' AS path, "
           "CAST(octet_length(encode(blob)) AS BIGINT) AS length, blob FROM blobs)")
LEDGER = "ledger AS (SELECT DISTINCT md5(blob) AS md5 FROM uploads WHERE blob_id % 5 = 0)"
_UPLOAD_URLS = f"""upload_urls AS (
  SELECT DISTINCT path, u AS url FROM (
    SELECT path, {S.strip('part')} AS u
    FROM uploads, unnest(regexp_split_to_array(blob, '[\\n,]')) AS t(part)
    WHERE length <= {10 * 1024 * 1024} AND md5(blob) NOT IN (SELECT md5 FROM ledger))
  WHERE {S.valid_url('u')})"""
_OUTCOME = f"""outcome AS (
  SELECT f.path, CAST(coalesce(c.n, 0) AS BIGINT) AS n_urls,
    CASE WHEN f.length > {10 * 1024 * 1024} THEN 'File too large. Maximum size: 10MB'
         WHEN md5(f.blob) IN (SELECT md5 FROM ledger) THEN
           'File already processed. Upload a different file or modify the content.'
         WHEN coalesce(c.n, 0) = 0 THEN 'No valid URLs found in file' END AS error
  FROM uploads f LEFT JOIN (SELECT path, count(*) AS n FROM upload_urls GROUP BY path) c ON f.path = c.path)"""


def _corpus_cte() -> str:
    from .queries import CORPUS_DIRS, CORPUS_NAMES
    name = _pick("doc_id % 6", CORPUS_NAMES)
    return (f"corpus AS (SELECT doc_id, {_pick('doc_id % 5', CORPUS_DIRS)} || '/d' || CAST(doc_id AS VARCHAR)"
            f" || '/' || {name} AS path, {name} AS name, text FROM documents)")


ORACLES.update({
    "decode_text_fallback": with_(PAGE_BYTES) + f"""SELECT page_id, latin1, CAST(length(t) AS BIGINT) AS n_chars,
        md5(t) AS text_md5 FROM (
        SELECT page_id, TRY(decode(content)) IS NULL AS latin1,
          coalesce(TRY(decode(content)), {S.latin1_of_blob('content')}) AS t FROM page_bytes)""",
    "size_gate": with_(LINES, BLOBS, UPLOADS) + f"""SELECT path, length, length > {10 * 1024 * 1024} AS refused,
        CASE WHEN length > {10 * 1024 * 1024} THEN 'File too large. Maximum size: 10MB' END AS error FROM uploads""",
    "intake_outcome": with_(LINES, BLOBS, UPLOADS, LEDGER, _UPLOAD_URLS, _OUTCOME) +
        "SELECT path, n_urls, error FROM outcome",
    "intake_urls": with_(LINES, BLOBS, UPLOADS, LEDGER, _UPLOAD_URLS, _OUTCOME) +
        "SELECT path, url FROM upload_urls WHERE path IN (SELECT path FROM outcome WHERE error IS NULL)",
    "content_hash_dedupe": """SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) AS copies
      FROM documents GROUP BY md5(text)""",
    "content_ledger_anti": """SELECT doc_id FROM documents
      WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0)""",
    "head_lines": with_(_corpus_cte()) + f"""SELECT doc_id, path, CASE WHEN name IN ({", ".join(lit(n) for n in ('Links.csv', 'temp.txt', 'Enriched_Links_Updated.csv', 'proxies_list.txt'))})
        THEN {S.extract("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))", '^((?:[^' + chr(92) + 'n]*' + chr(92) + 'n){0,2}[^' + chr(92) + 'n]*' + chr(92) + 'n?)')}
        ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS content FROM corpus""",
    "path_filter": with_(_corpus_cte()) + """SELECT doc_id, path, NOT list_bool_or(list_transform(string_split(path, '/'),
        lambda p: starts_with(p, '.') OR p IN ('__pycache__', '.vscode', '.git', 'node_modules'))) AS kept FROM corpus""",
})

# Files written and read back: the rows are those that were written.
ORACLES.update({
    "corpus_scan": """SELECT doc_id // 25 AS folder, doc_id,
        md5(CAST(doc_id AS VARCHAR) || '|' || regexp_replace(text, '[\\r\\n]', chr(9), 'g')) AS line_md5 FROM documents""",
    "url_file_lines": with_(LINES, CLEAN_LINES) + "SELECT url FROM clean_lines",
    "upload_files": with_(LINES, BLOBS, SPLIT_URLS) + """SELECT b.blob_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_urls,
        CASE WHEN c.n IS NULL THEN 'No valid URLs found in file' END AS error, s.url
      FROM blobs b LEFT JOIN (SELECT blob_id, count(*) AS n FROM split_urls GROUP BY blob_id) c USING (blob_id)
      LEFT JOIN split_urls s USING (blob_id)""",
    "result_csv_replaced_header": ORACLES["result_csv_roundtrip"],
    "appended_lines": "SELECT endpoint FROM (" + ORACLES["extract_endpoints"] + ")",
    "stream_pages": ORACLES["result_rows"],
})

ORACLES.update({
    "stream_progress": with_(DATED, LOG) + "SELECT status, count(*) AS n FROM log GROUP BY status",
    "stream_intake": with_(LINES, BLOBS) + f"""SELECT DISTINCT md5(blob || chr(10)) AS md5,
        CAST(octet_length(encode(blob || chr(10))) AS BIGINT) AS length,
        octet_length(encode(blob || chr(10))) > {10 * 1024 * 1024} AS refused FROM blobs""",
})


def _ladder_cte() -> str:
    sp = S.json_span("response")
    return f"""spans AS (SELECT id, response, {sp['span']} AS span, {sp['error']} AS error FROM responses),
rungs AS (
  SELECT *, CASE WHEN span IS NULL THEN NULL WHEN json_valid(span) THEN 1
                 WHEN json_valid(ra) THEN 2 WHEN json_valid(rb) THEN 3 ELSE 4 END AS parse_rung
  FROM (SELECT *, {S.repair_a('span')} AS ra, {S.repair_b('span')} AS rb FROM spans)),
ladder AS (
  SELECT id, response, error, parse_rung,
    CASE parse_rung WHEN 1 THEN span WHEN 2 THEN ra WHEN 3 THEN rb WHEN 4 THEN {lit(R.FALLBACK_JSON)} END AS json
  FROM rungs),
checked AS (
  SELECT *, CASE WHEN error IS NULL THEN coalesce(json_type(json) = 'OBJECT' AND """ + " AND ".join(
        f"coalesce(json_type(json, '$.{k}') = 'VARCHAR', false)" for k in R.RECORD_FIELDS) + """, false) END AS valid
  FROM ladder)"""


LADDER = _ladder_cte()
_FIELDS_SQL = ", ".join(
    f"CASE WHEN valid THEN json_extract_string(json, '$.{k}') WHEN NOT valid THEN "
    + ("left(response, 1000) || '... [partial]'" if k == "article_text" else "'N/A'") + f" END AS {k}"
    for k in R.RECORD_FIELDS)

ORACLES.update({
    "llm_json_repair": with_(RESPONSES, LADDER) + "SELECT id, CAST(coalesce(parse_rung, 0) AS BIGINT) AS parse_rung, json FROM checked",
    "llm_validate": with_(RESPONSES, LADDER) + f"""SELECT id, error, CAST(coalesce(parse_rung, 0) AS BIGINT) AS parse_rung,
        {_FIELDS_SQL}, coalesce(valid, false) AS valid FROM checked""",
    "llm_yield": with_(RESPONSES, LADDER) + """SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid,
        count(*) FILTER (WHERE valid) / count(*) AS yield FROM checked""",
})

# SRC11 as a round trip: decoding the stored bytes must give back the page
# text as it was before encoding (Latin-1 pages with their charset line, a BOM
# dropped, UTF-8 as is).
ORACLES["page_decode"] = f"""SELECT page_id, md5(CASE
      WHEN page_id % 4 = 0 AND {S.matches('html', R.LATIN1_ONLY)}
        THEN replace(html, '<meta charset="utf-8">', '<meta charset="iso-8859-1">')
      ELSE html END) AS text_md5
    FROM pages"""


# Kinds 3 (the last line of a file of ten leaves a quote open) and 4 (every line but the
# first has a third cell) are refused; a file whose lines lack that one is not.
ORACLES["upload_csv_files"] = """
WITH r AS (SELECT CAST(floor(page_id / 10) AS BIGINT) AS file_id, page_id, url FROM pages),
f AS (SELECT file_id, file_id % 7 AS kind, bool_or(page_id % 10 = 9) AS closes, bool_or(page_id % 10 = 0) AS starts,
             bool_or(page_id % 10 <> 0) AS more FROM r GROUP BY file_id),
o AS (SELECT file_id, kind, CASE
        WHEN kind = 3 AND closes THEN 'Error reading CSV: a quoted cell is not closed'
        WHEN kind = 4 AND starts AND more THEN 'Error reading CSV: expected 2 cells in a record, saw 3'
        WHEN kind = 2 THEN 'No valid URLs found in file' END AS error FROM f),
u AS (SELECT DISTINCT r.file_id, CASE WHEN kind = 1 THEN url ELSE ' ' || url END AS url
      FROM r JOIN o USING (file_id) WHERE error IS NULL)
SELECT o.file_id, CAST(coalesce(n, 0) AS BIGINT) AS n_urls, error, url
FROM o LEFT JOIN u USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS n FROM u GROUP BY 1) c USING (file_id)
"""

# The characters that the escapes stand for; the cut-off one stays as it is.
_TAILS = ("chr(10)", "chr(9) || '|' || chr(11) || '|' || chr(12)", """chr(39) || 'q"'""", "'Az'", "chr(233) || chr(8212)",
          "chr(128512)", "'A0'", "chr(128512)", "chr(92) || 'n'", "chr(92) || 'q' || chr(92) || '8'", "chr(92) || 'u12'",
          "'x' || chr(65533) || '!'")
ORACLES["scrub_escapes"] = "SELECT doc_id, coalesce(" + S.collapse(
    "text || ' ' || CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TAILS)) + " END") + \
    ", '') AS scrubbed FROM documents"
