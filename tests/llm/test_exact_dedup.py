import hashlib
import re
from collections import defaultdict

import pytest

from pressgrid.llm import exact_dedup as X


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [g for g in groups[t] if g is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_groups_equal_brute_force(docs, texts):
    assert got(X.mark_duplicates(docs)) == expected(texts)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_hot_group_by_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(X, "HOT_ROWS", 50)
    rows = [(i, f"text number {i}" if i % 3 else "the same everywhere") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.mark_duplicates(df)) == expected(rows)


def test_documents_keep_their_columns(docs, none):
    out = X.drop_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert X.drop_duplicates(none).count() == 0 and X.mark_duplicates(none).count() == 0


def test_filter_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(20000).selectExpr("sha2(cast(id as string), 256) as k")
    twice = keys.union(keys.limit(50))
    bits = 1 << 19
    words = X.repeated_filter(twice, "k", bits)
    flagged = X._flagged(twice, "k", words, bits, "f").where("f").select("k").distinct().collect()
    assert {r.k for r in keys.limit(50).collect()} <= {r.k for r in flagged} and len(flagged) < 2000


def _kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def _one_of_each(rows):
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in best or best[key][0] is None or i is not None and i < best[key][0]:
            best[key] = (i, t)
    return best


@pytest.mark.parametrize("most", [500_000, 1])
def test_one_row_stays_of_every_group(spark, docs, texts, most, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", most)
    rows = texts + [(5, "a  b"), (5, "a  b"), (5, "a b"), (6, "a b"), (None, "z"), (None, "z"), (90, "alone")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, x int")
    out = _kept(X.drop_duplicates(frame))
    want = _one_of_each(rows)
    assert len(out) == len(want)
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", t or ""): i for i, t in out} == {k: i for k, (i, _) in want.items()}


def test_only_rows_that_may_be_named_shuffle_with_their_text(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 1)
    frame = spark.createDataFrame([(i, f"text {i // 2 if i < 20 else i}") for i in range(3000)], "doc_id long, text string")
    passed = {}
    whole = X._flagged

    def flagged(rows, key, words, bits, flag):
        out = whole(rows, key, words, bits, flag)
        if flag == "maybe":
            passed.update({r.maybe: r["count"] for r in out.groupBy("maybe").count().collect()})
        return out

    monkeypatch.setattr(X, "_flagged", flagged)
    out = X.drop_duplicates(frame)
    assert out.count() == 2990 and passed[True] < 100 and passed[False] > 2900
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "strategy=broadcast" in plan
