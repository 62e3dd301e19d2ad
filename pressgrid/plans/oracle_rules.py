"""The rules as the oracles state them, apart from the engine.

Patterns are in RE2's dialect and lists are plain values, so that a wrong
pattern in the engine shows as a difference.
"""

from __future__ import annotations

# Fixed values of the survey: character classes, references, element names,
# field names, messages, limits, hosts and date shapes.
ARTICLE_TYPES = '(?i)article|posting|report|videoobject|webpage'
BYLINE_INNER = '(?is)<(?:p|div|span|a)\\s[^>]*class\\s*=\\s*[\\"\'][^\\"\']*byline[^\\"\']*[\\"\'][^>]*>(.*?)</(?:p|div|span|a)\\s*>'
BYLINE_PATH = '(?i)/(?:by|authors?)/([a-z]+(?:-[a-z]+)+)(?:/|$)'
C1_CONTROLS = '[\\x{80}-\\x{9f}]'
CONTENT_CONTAINERS = ('article', 'main', 'body')
CONTENT_LIMIT = 50000
CONTENT_SUFFIX = '... [truncated for processing speed]'
CP1252_BYTES = '\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f'
CP1252_SPECIALS = '\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178'
CSV_TEXT_LIMIT = 32750
DATE_COMPACT = '(?:^|[^0-9])(20[0-9]{2})([0-9]{2})([0-9]{2})(?:[^0-9]|$)'
DATE_D_MON_Y = '([0-9]{1,2})-([a-zA-Z]{3})-([0-9]{4})'
DATE_ISO = '([0-9]{4})-([0-9]{2})-([0-9]{2})'
DATE_KEYS = ('datePublished', 'dateModified', 'dateCreated', 'publishedDate', 'modifiedDate')
DATE_YMD = '/([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)'
DATE_Y_MON_D = '/([0-9]{4})/([a-zA-Z]{3})/([0-9]{1,2})(?:/|$)'
ERR_EMPTY = 'Empty response'
ERR_NO_JSON = 'No valid JSON structure found'
FALLBACK_JSON = '{"title": "N/A", "authors": "N/A", "source": "N/A", "published_date": "N/A", "modified_date": "N/A", "article_text": "Parsing failed - invalid JSON response"}'
FENCE_CLOSE = '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*```'
FENCE_OPEN = '```(?:json)?[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*'
FIRST_PASS = '(?is)<!--.*?(?:-->|\\z)|<script(?:\\s[^>]*)?>.*?(?:</script\\s*>|\\z)|<style(?:\\s[^>]*)?>.*?(?:</style\\s*>|\\z)'
H1_INNER = '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>'
HOST_PREFIXES = '^(?:www\\.|m\\.|edition\\.)'
KNOWN_SOURCES = {'abcnews.go.com': 'ABC News',
 'afp.com': 'AFP',
 'aljazeera.com': 'Al Jazeera',
 'apnews.com': 'AP News',
 'axios.com': 'Axios',
 'bbc.co.uk': 'BBC',
 'bbc.com': 'BBC',
 'bloomberg.com': 'Bloomberg',
 'cbsnews.com': 'CBS News',
 'cnn.com': 'CNN',
 'dw.com': 'DW',
 'foxnews.com': 'Fox News',
 'france24.com': 'France 24',
 'latimes.com': 'Los Angeles Times',
 'nbcnews.com': 'NBC News',
 'npr.org': 'NPR',
 'nytimes.com': 'The New York Times',
 'politico.com': 'Politico',
 'reuters.com': 'Reuters',
 'theguardian.com': 'The Guardian',
 'usatoday.com': 'USA Today',
 'washingtonpost.com': 'The Washington Post',
 'wsj.com': 'The Wall Street Journal'}
LATIN1_ONLY = '^[\\x{0}-\\x{ff}]*\\z'
LD_SCRIPT = '(?is)<script(?:\\s[^>]*?)?\\stype\\s*=\\s*(?:\\"application/ld\\+json\\"|\'application/ld\\+json\')[^>]*>(.*?)</script\\s*>'
MONTHS = ('jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec')
NAMED_ENTITIES = (('nbsp', '\xa0'),
 ('lt', '<'),
 ('gt', '>'),
 ('quot', '"'),
 ('apos', "'"),
 ('copy', '©'),
 ('reg', '®'),
 ('trade', '™'),
 ('middot', '·'),
 ('bull', '•'),
 ('hellip', '…'),
 ('ndash', '–'),
 ('mdash', '—'),
 ('lsquo', '‘'),
 ('rsquo', '’'),
 ('ldquo', '“'),
 ('rdquo', '”'),
 ('laquo', '«'),
 ('raquo', '»'),
 ('euro', '€'),
 ('pound', '£'),
 ('deg', '°'),
 ('times', '×'))
NAME_STOP = '[^-.a-zA-Z0-9]'
NUMBER_STOP = '[^0-9a-fA-F]'
NUMERIC_ENTITIES = (('#39', "'"),
 ('#x27', "'"),
 ('#34', '"'),
 ('#38', '&'),
 ('#160', '\xa0'),
 ('#8211', '–'),
 ('#8212', '—'),
 ('#8216', '‘'),
 ('#8217', '’'),
 ('#8220', '“'),
 ('#8221', '”'),
 ('#8230', '…'))
OPEN_STRING = '("[^"]*[^\\\\])([\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*[,}])'
PAGE_EXT = '(?i)\\.(?:html?|php|aspx?)$'
PAYLOAD_LIMIT = 50000
PAYLOAD_SUFFIX = '... [truncated]'
P_BODY = '(?is)^(.*?)(?:</p\\s*>|</(?:article|main|body|html|div|section|td|th|tr|table|li|ul|ol|blockquote|figure|header|footer|nav|aside|form|dd|dl|dt)\\s*>|\\z)'
P_OPEN = '(?i)<p(?:\\s[^>]*)?>'
RECORD_FIELDS = ('title', 'authors', 'source', 'published_date', 'modified_date', 'article_text')
REMOVED_ELEMENTS = ('nav', 'footer', 'aside', 'form', 'header')
TAG = '</?[a-zA-Z][^>]*>|<![^>]*>|<\\?[^>]*>'
TD_CELL = '(?is)<td(?:\\s[^>]*)?>(.*?)</td\\s*>'
TIME_ATTR = '(?is)<time\\s[^>]*?datetime\\s*=\\s*[\\"\']([^\\"\']+)[\\"\']'
TITLE_INNER = '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>'
URL_HOST = '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)'
URL_PATH = '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?'
WS_CLASS = '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'


def element_pattern(tag: str) -> str:
    return "(?is)<" + tag + r"(?:\s[^>]*)?>.*?(?:</" + tag + r"\s*>|\z)"


def has_element_pattern(tag: str) -> str:
    return "(?i)<" + tag + r"(?:\s|/?>)"


def inner_pattern(tag: str) -> str:
    return "(?is)<" + tag + r"(?:\s[^>]*)?>(.*?)(?:</" + tag + r"\s*>|\z)"
