import zlib

from pressgrid.llm import sharding as S


def check(rows, shards, slack):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= slack, sizes


def test_bytes_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else "word%d " % i * (i % 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = S.shard_digest(df, 10).collect()
    total = sum(len(t) + 16 for _, t in rows)
    check(out, 10, 2 * (max(len(t) for _, t in rows) + 16) + 0.01 * total / 10)
    text = dict(rows)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == {
        (i, len(t) + 16, zlib.crc32(t.encode())) for i, t in text.items()}
    again = S.shard_digest(df.repartition(3), 10).collect()
    assert sorted(out) == sorted(again)  # the cut does not depend on the partitioning


def test_awkward_rows(docs, texts, none):
    out = S.shard_documents(docs, 4)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.collect()
    assert len(rows) == len(texts)
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert S.shard_documents(none, 4).count() == 0 and S.shard_digest(none, 4).count() == 0
    sizes = {r.doc_id: r["size"] for r in S.shard_digest(docs, 4).collect()}
    assert sizes[3] == 16 and sizes[9] == 70016


def test_digest_is_of_the_written_shards(spark, monkeypatch):
    written = []
    keep = S.written_shards
    monkeypatch.setattr(S, "written_shards", lambda d: written.append(keep(d)) or written[-1])
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"word{i} " * (i % 40)) for i in range(2000)]
    df = spark.createDataFrame(rows + [(5000, "long " * 40000), (None, None)], "doc_id long, text string")
    out = S.shard_digest(df, 8)
    assert len(written) == 1
    whole = written[0].collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in whole) == sorted([*rows, (5000, "long " * 40000), (-1, "")])
    assert {(r.doc_id, r.shard, r.slot) for r in whole} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}
