import collections
import hashlib
import random

import numpy as np
import pytest

from pressgrid.llm import suffix_dedup as S


def test_suffix_order_equals_sorting():
    r = np.random.default_rng(0)
    for n in [*range(1, 30), 100, 1000]:
        for letters in (1, 2, 4, 200):
            s = r.integers(0, letters, n)
            t = s.tolist()
            assert S.suffix_order(s).tolist() == sorted(range(n), key=lambda i: t[i:])


def brute(docs, size):
    seen = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i:i + size] for i in range(len(b) - size + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    words = ["alpha", "beta", "gämma", "de", "e", "zeta", "eta", "thet", "io"]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    passages = [text(30) for _ in range(4)]
    docs = []
    for i in range(60):
        k, t = r.random(), text(r.randrange(0, 60))
        if k < .4:
            t = t[:r.randrange(len(t) + 1)] + r.choice(passages)[r.randrange(30):] + " " + text(r.randrange(20))
        if k < .1:
            t = "ab" * r.randrange(100)
        if .1 < k < .15:
            t = "a" * r.randrange(150)
        if .9 < k and docs:
            t = docs[-1][1]
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (None, text(40)), (5, text(40)), (7, docs[7][1]), (102, passages[0]),
                   (103, passages[0] + passages[1])]


@pytest.mark.parametrize("size, gram, hot", [(40, 16, 2000), (64, 20, 1)])
def test_removed_bytes_equal_brute_force(spark, size, gram, hot):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(df, length=size, gram=gram, hot_phrases=hot).collect()), key=str)
    assert got == brute(docs, size)


def test_awkward_rows(docs, texts, none):
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(docs, with_bytes=False).collect()), key=str)
    big = [(i, t) for i, t in texts if t and len(t) > 60000]
    rows = {r[0]: r for r in got}
    assert len(got) == len(texts)
    assert all(rows[i][2] == len(t) for i, t in big)  # both long texts repeat inside themselves
    assert S.remove_repeats(none).count() == 0


def test_pieces_of_long_texts_agree(monkeypatch):
    text = ("The cat sat on the mat. " * 30 + "Something else entirely, at length. " * 20).encode()

    def starts(parts):
        return sorted((int(h), s) for h, lo, n, _, _ in parts for h, l, k in zip(h, lo, n) for s in range(l, l + k))

    whole = starts(S.phrases(text))
    monkeypatch.setattr(S, "PIECE", 100)
    assert starts(S.phrases(text)) == whole
