import hashlib
import random
import re

import pytest

from pressgrid.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def expected(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            b = words(it)
            k = min(n, len(b))
            if not k or item is None:
                continue
            win = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in win:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, limit", [(10, 250_000), (3, 250_000), (3, 20)])
def test_hits_equal_brute_force(spark, monkeypatch, n, limit):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", limit)
    r = random.Random(n)
    vocab = ["Ab", "cd", "É1", "é1", "x", "Y2", "the", "ß"]
    sep = [" ", ", ", "--", "\n"]

    def text(k):
        return "".join(r.choice(vocab) + r.choice(sep) for _ in range(k))

    items = [(i, text(r.randrange(0, 14))) for i in range(12)] + [(3, text(12)), (None, text(12)), (99, None)]
    docs = [(i, text(r.randrange(0, 30)) + (r.choice(items)[1] or "") + text(r.randrange(8))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "!!!")]
    # Repeated ids: equal rows, and rows of other texts.
    docs += [docs[7], docs[7], (7, docs[8][1]), (None, docs[9][1]), (None, docs[9][1]), (None, "x y")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(x[c] for c in cols) for x in D.hits_by_document(d, b, n).collect()), key=str)
    assert got == expected(docs, items, n)
    kept = {x.doc_id for x in D.remove_contaminated(d, b, n).collect()}
    assert kept == {e[0] for e in expected(docs, items, n) if not e[5]}


def test_awkward_rows(spark, docs, none):
    b = spark.createDataFrame([(1, "fox jumps over the lazy dog near the river bank")], "item_id long, text string")
    assert {r.doc_id for r in D.hits_by_document(docs, b).where("contaminated").collect()} == {1, 2, 11}
    out = D.remove_contaminated(docs, b)
    assert out.columns == docs.columns and out.count() == docs.count() - 4
    assert D.remove_contaminated(none, b).count() == 0 and D.hits_by_document(none, b).count() == 0
    assert D.hits_by_document(docs, b.limit(0)).where("contaminated").count() == 0
