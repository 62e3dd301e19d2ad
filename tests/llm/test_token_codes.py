import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pressgrid.llm import token_codes as C
from pressgrid.llm.common import shared_path
from pressgrid.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "a  b", " lead", "tail ", "x\n y \n z", "tab\t x", "it's  don't 'll", "\x1c a\x85 b", "日本 語 　 x",
       "a" * 5000 + " b", "<|endoftext|> q<|endoftext|>z", "  \n\n  ", "a\n", "one two one two", "é è\xa0 x"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(tok, monkeypatch):
    enc = C.WordEncoder(PATH)
    for limit in (900_000, 10):  # with and without room for the words
        monkeypatch.setattr(C, "CACHE_WORDS", limit)
        for texts in (ODD, ODD[::-1], ["one two", "two three one"], []):
            ids, n = enc.encode(texts)
            at = 0
            for t, k in zip(texts, n):
                assert ids[at:at + k].tolist() == tok.encode(t, add_special_tokens=False).ids + [0], t[:40]
                at += k
            assert at == len(ids)


CUT = ["a word, a word. a word!? (word) word\nword.\nWord word\n\nword", "don't, it's. x' y'. '. l'été, été; ß. 12, 1.5. _a_, a_b. __",
       "a <|endoftext|>. b<|endoftext|>, c<|endoftext|>\nd <|endof, |> x|>", "\nword word", "a.\n.b ,\n, .\nc a\n1", "漢字. 語, ñ. ж, ǅ. ʰ. ª. ²,",
       "a \x00. b\x00c, \ufffd. \U0001f600, e\u0301. e\u0301\nx"]


def test_parts_of_words_equal_the_library(tok):
    enc = C.WordEncoder(PATH)
    for texts in (CUT, ["x " + t for t in CUT], CUT[::-1]):
        ids, n = enc.encode(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids + [0], t


def test_words_share_their_parts():
    enc = C.WordEncoder(PATH)
    enc.encode(["start alpha beta gamma"])
    known = len(enc.lens)
    enc.encode(["start alpha, beta. gamma; alpha. beta, gamma. beta; gamma,"])
    assert len(enc.lens) == known + 3       # one entry for each punctuation, none for a word


@pytest.mark.parametrize("high", [1, 200, 50_000, 1 << 32])
def test_codes_round_trip_and_random_access(high):
    r = np.random.default_rng(high)
    ids = r.integers(0, high, 5_000).astype(np.uint32)
    reader = C.DacReader(C.dac_encode(ids))
    assert len(reader) == len(ids) and (reader.read(0, len(ids)) == ids).all()
    for i in r.integers(0, len(ids), 300):
        assert reader[int(i)] == ids[i]
    for a, b in ((0, 1), (511, 513), (7, 4321), (4999, 5000), (8, 8)):
        assert (reader.read(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader[len(ids)]
    assert len(C.DacReader(C.dac_encode(np.zeros(0, np.uint32)))) == 0


def check(rows, texts, tok):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.start), order):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert r.doc_id == i and r.start == at
        if [x for x, _ in texts].count(i) == 1:
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        at += r.n_tokens
    assert len(rows) == len(texts)


def test_files_give_every_document_back(docs, texts, none, tok):
    check(C.token_code_digest(docs, PATH).collect(), texts, tok)
    assert C.token_code_digest(none, PATH).count() == 0


def test_blocks_are_cut_and_in_order(spark, tok, monkeypatch):
    rows = [(i, f"document {i} " * (i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = shared_path(spark, "codes-test")
    C.write_codes(df, out, PATH)
    files = spark.read.schema(C.SCHEMA).parquet(out)
    check(C.read_digest(files).collect(), rows, tok)
    keys = [k for r in files.orderBy("part", "block").collect() for k in r.doc_ids]
    assert keys == sorted(keys)
