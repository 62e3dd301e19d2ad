import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_training_never_reads_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lied = docs.withColumn("lang", F.when(L.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.identify(d).collect()} for d in (docs, lied))
    assert a == b


@pytest.mark.parametrize("k", [2, 3, 4, 7, 12, 40])
def test_codewords_are_apart_and_every_bit_splits(k):
    c = L.codewords(k).astype(int)
    assert len(c) == k and (np.abs(c.sum(0)) < k).all()
    gap = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
    assert gap >= (1 if k == 2 else 2 if k <= 4 else 3)


def test_one_wrong_bit_is_corrected():
    m = L.Model(list("abcd"), L.codewords(4), None, None, None, np.ones((4, 7)) / 7, 0.5)
    for k in range(4):
        for bit in range(7):
            f = 5.0 * m.code[k]
            f[bit] = -f[bit]
            assert m.distances(f[None]).argmin() == k


def test_pieces_of_long_texts_count_alike(monkeypatch):
    texts = ["Größe und Straße " * 50, "the cat sat on the mat " * 9, "x"]
    whole = L.features(texts)
    monkeypatch.setattr(L, "PIECE", 64)
    assert np.allclose(whole, L.features(texts), atol=1e-6)


def test_awkward_rows(docs, none, spark):
    out = {(r.doc_id, r.lang_pred, r.score, r.ambiguous) for r in L.identify(docs).collect()}
    assert {r[1:] for r in out} == {("und", 0.0, True)}  # no labelled row at all
    one = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    got = {r.doc_id: r.lang_pred for r in L.identify(one).collect()}
    assert got[1] == got[8] == "en" and got[3] == got[4] == got[5] == got[7] == "und"
    two = docs.withColumn("lang", F.when(F.col("doc_id").isin(1, 2), "en").when(F.col("doc_id") == 8, "de"))
    wide = L.predict(two, L.train(two))
    assert wide.count() == docs.count() and set(docs.columns) <= set(wide.columns)
    assert L.identify(none).count() == 0
