import random
import re

import pytest

from pressgrid.llm import jaccard_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def corpus():
    r = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]

    def text(n):
        return [r.choice(vocab) for _ in range(n)]

    base, boiler, docs = [text(r.randrange(3, 120)) for _ in range(20)], [text(30) for _ in range(3)], []
    for i in range(300):
        if r.random() < .7:
            w = list(r.choice(base))
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < .3:
                w += text(r.randrange(12))
        else:
            w = text(r.randrange(60)) + r.choice(boiler)
        docs.append((i, " ".join(w) if r.random() < .5 else "  ".join(w).upper()))
    return docs + [(600, None), (601, ""), (602, " \n"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[4][1]),
                   (7, "a b"), (8, "a B"), (9, "a b c")]


@pytest.mark.parametrize("cut", [{}, {"heavy_docs": 2, "members": 3, "part_tokens": 2000, "block_docs": 40}])
def test_components_equal_brute_force(spark, cut):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in J.similar_documents(df, **cut).drop("x").collect()), key=str)
    assert got == brute(docs)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "u long, v long")
    got = dict(J.components(links).collect())
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_awkward_rows(docs, texts, none):
    got = sorted((tuple(r) for r in J.similar_documents(docs).drop("x").collect()), key=str)
    assert got == brute(texts)
    kept = J.drop_similar(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, None}
    assert J.similar_documents(none).count() == 0 and J.drop_similar(none).count() == 0


def test_sets_of_very_long_texts():
    text = " ".join("w%d" % (i % 5000) for i in range(9000))
    a, b = J.shingle_sets([text, text])
    assert len(a) == 5000 and (a == b).all()
