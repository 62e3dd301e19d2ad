import math
import random

import numpy as np
import pytest

from pressgrid.llm import hard_negatives as H
from pressgrid.llm.queries import LLM_QUERIES

COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    """Every anchor against every row, with Python integers."""
    kept = []
    for vec, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec, [math.floor(256 * v) for v in x], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (vec, q, label) in enumerate(kept):
        if vec is None or vec % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, o)), v, lab) for j, (v, o, lab) in enumerate(kept) if j != i]
        for ps, pv, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            good = sorted((s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)
            out += [(vec, pv, rank, v, ps, s) for rank, (s, v, _) in enumerate(good[:3], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z", 2, 3) for r in rows],
                                 "vec_id long, embedding array<float>, label int, place long, q string, g int, rank int")


def rounded(x):
    return [float(np.float32(v)) for v in x]


@pytest.mark.parametrize("dims,labels,scale", [(1, 2, 1), (16, 3, 0.2), (64, 10, 0.1), (3, 1, 5), (2_300, 4, 30)])
def test_random_vectors_equal_brute_force(spark, dims, labels, scale):
    r = random.Random(dims)
    rows = [(i, rounded(r.gauss(0.05, scale) for _ in range(dims)), r.randrange(labels))
            for i in range(160 if dims < 1000 else 60)]
    assert got(H.mine(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    r = random.Random(3)
    rows = [(i // 2, rounded([r.choice([0.5, 0.25, -0.1, 0.0]) for _ in range(r.randrange(0, 6))]), r.randrange(3))
            for i in range(220)]
    rows += [(50, [0.5, None], 1), (100, [float("nan")], 1), (150, [float("inf")], 0), (0, None, 1), (200, [0.5, 0.5], None),
             (None, [0.5, 0.5, 0.1], 1), (None, [0.5, 0.5, 0.1], 0), (250, [], 2), (-50, [0.5, 0.5, 0.5], 1)]
    rows += rows[:40]
    assert got(H.mine(frame(spark, rows))) == brute(rows)
    assert H.mine(frame(spark, rows).limit(0)).collect() == []


def test_many_groups_give_the_same_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(H.mine(table, group_bytes=1_500)) == got(H.mine(table)) == brute(
        [(x.vec_id, x.embedding, x.label) for x in table.collect()])


def test_query_has_full_ranks(spark):
    rows = LLM_QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {x["rank"] for x in rows} == {1, 2, 3}


def test_scores_are_exact_at_the_bound():
    r = np.random.default_rng(5)
    for dims, top in ((1, 2**27), (3_000, 2**20), (5_000, 3)):
        a, b = (r.integers(-top, top + 1, (20, dims)) for _ in range(2))
        a[0], b[0], b[1] = top, top, -top
        primes = H.moduli(int(dims * top) * int(top))
        assert (H.exact_scores(H.residues(a, primes), H.residues(b, primes), primes) == a @ b.T).all()


def test_scores_past_a_long_raise(spark):
    with pytest.raises(ArithmeticError):
        H.mine(frame(spark, [(0, [1e30], 1), (1, [1e30], 1)]))
