import random
import zlib

import numpy as np
import pytest

from pressgrid.llm import pieces as S
from pressgrid.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = ["", "a", " ", " a", "a ", "   x   y   ", "▁▁ a ▁", "日本語テキスト処理" * 5, "a" * 300, "=" * 120, "\n\n\t x😀é",
       "<0xFC> <s> </s><unk>", "internationalization" * 20]


@pytest.fixture(scope="module")
def v():
    return S.Pieces(PATH)


def scan(v, text, size):
    chunks = [S.Chunk(v, *c) for c in S.cut(v, S.normalise(text), size)]
    if not chunks:
        return []
    states = S.resolve([c.transfer() for c in chunks])
    return [i for c, s in zip(chunks, states) for i in c.trace(*s)]


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_chunked_encoding_equals_the_library(v, size):
    r = random.Random(size)
    texts = ODD + ["".join(r.choice("abeinrst ▁=é日\n ") for _ in range(r.randrange(1, 120))) for _ in range(150)]
    for t in texts:
        assert scan(v, t, size) == v.sp.encode(t), t[:60]


def test_combination_is_associative(v):
    chunks = [S.Chunk(v, *c).transfer() for c in S.cut(v, S.normalise("internationalization without any space" * 3), 9)]
    left = chunks[0]
    for m in chunks[1:]:
        left = S.combine(left, m)
    right = chunks[-1]
    for m in chunks[-2::-1]:
        right = S.combine(m, right)
    assert (left == right).all() and left.max() == 0


def test_spark_scan_round_trips(spark, docs, texts, none, v):
    out = S.round_trip(docs, PATH, chunk=500).collect()
    want = sorted((i is None, i or 0, len(v.sp.encode(t or "")), zlib.crc32(np.array(v.sp.encode(t or ""), "<u4").tobytes()))
                  for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_pieces, r.pieces_crc32) for r in out) == want
    assert all(r.round_trip for r in out)
    assert S.round_trip(none, PATH).count() == 0
    wide = S.encode(docs, PATH, chunk=500)
    assert set(docs.columns) == set(wide.columns) and wide.count() == docs.count()
