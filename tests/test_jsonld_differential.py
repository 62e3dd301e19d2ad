"""X3 field resolution against a plain-Python reading of the same blocks."""

import json
import re

from pressgrid.functions import jsonld
from pressgrid.plans import inputs


def _as_list(v):
    return v if isinstance(v, list) else [v]


def _candidates(blocks):
    out = []
    for b in blocks:
        for v in _as_list(json.loads(b)):
            for w in _as_list(v):
                if isinstance(w, dict):
                    out.append(w)
                    m = w.get("mainEntityOfPage")
                    if isinstance(m, dict):
                        out.append(m)
    return out


def _text(v):
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))


def _first(vals):
    return next((v for v in vals if v is not None and v.strip() != ""), None)


def _names(v):
    out = []
    for a in _as_list(v):
        if isinstance(a, dict):
            if a.get("name") is not None:
                out += [_text(n) for n in _as_list(a["name"])]
        elif isinstance(a, str):
            out.append(a)
    return [x for x in out if x is not None and x.strip() != ""]


def py_fields(blocks):
    objs = _candidates(blocks)
    title = _first(_text(o.get("headline")) for o in objs)
    if title is None:
        title = _first(_text(o.get("name")) for o in objs
                       if re.search(jsonld.ARTICLE_TYPES, _text(o.get("@type")) or ""))
    authors = next((n for n in (_names(o["author"]) for o in objs if o.get("author") is not None) if n), None)
    source = _first((_names(o["publisher"]) or [None])[0] for o in objs if o.get("publisher") is not None)
    return (title, ", ".join(authors) if authors else None, source,
            _first(_text(o.get("datePublished")) for o in objs), _first(_text(o.get("dateModified")) for o in objs))


def test_jsonld_fields_match_python(spark):
    p = inputs.rich_pages(inputs.table(spark, "/root/testdata/sf0.1", "pages"))
    p = p.withColumn("b", jsonld.jsonld_blocks("html")).where("size(b) > 0")
    rows = p.select("page_id", "b", jsonld.jsonld_fields("b").alias("f")).collect()
    assert len(rows) > 1000
    for r in rows:
        f = r.f
        assert (f.title, f.authors, f.source, f.published, f.modified) == py_fields(r.b), r.page_id
