"""Every stage of the pipeline against a brute-force version on its own input."""

import importlib.util
import os
import random
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline as C
from pressgrid.llm import pieces
from pressgrid.llm.common import stored
from pressgrid.llm.queries import LLM_ORACLES, LLM_QUERIES, vocabulary
from llm.test_decontaminate import expected as leaks
from llm.test_exact_dedup import expected as copies
from llm.test_jaccard_join import brute as near

ROOT = os.path.dirname(os.path.abspath(C.__file__))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """documents and benchmark with copies, near copies, leaks and wordless texts."""
    r = random.Random(9)
    sf = str(tmp_path_factory.mktemp("sf"))
    tongue = {"en": ["the", "and", "thing", "river", "walk", "house", "often"], "de": ["der", "und", "straße", "haus", "größe", "oft", "gehen"]}

    def text(lang, n):
        return " ".join(r.choice(tongue[lang]) + r.choice(["", "", "s", "e", "er"]) for _ in range(n))

    items = [(i, text("en", 14)) for i in range(5)]
    docs = []
    for i in range(160):
        lang = r.choice(["en", "de"])
        t = text(lang, r.randrange(30, 90))
        k = r.random()
        if k < .15 and docs:
            t = docs[r.randrange(len(docs))][1] or t
        elif k < .3 and docs:
            w = (docs[r.randrange(len(docs))][1] or t).split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif k < .4:
            t += " " + r.choice(items)[1] + " " + text(lang, 5)
        docs.append((i, t, lang, f"src{i % 3}", len(t)))
    docs += [(200, None, None, None, None), (201, "", "en", "x", 0), (202, "123 456 !!!", "de", "x", 11)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, items


def test_stages_equal_brute_force(spark, world):
    sf, items = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stored(stage(spark, docs, sf), "test-stage")
        after = {r.doc_id for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        want = {i for i, _ in before}
        if name == "language_id":
            want -= {200, 201, 202}
        elif name == "exact_dedup":
            want = {i for i, _, _, kept, _ in copies(before) if kept}
        elif name == "jaccard_join":
            want = {i for i, _, component in near(before) if i == component}
        elif name == "decontaminate":
            want = {e[0] for e in leaks(before, items, 10) if not e[5]}
        assert after == want, name
        seen[name] = len(after)
    assert seen["language_id"] > seen["exact_dedup"] > seen["jaccard_join"] > seen["decontaminate"] > 0
    sp = pieces.Pieces(vocabulary("piece_bpe_32k.model")).sp
    for r in docs.collect():
        assert r.n_pieces == len(sp.encode(r.text)) and sp.decode(list(memoryview(r.pieces).cast("I"))) == r.text
    whole = C.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in docs.collect())


def test_empty_documents_and_extra_columns(spark, world):
    sf, _ = world
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as score", "'x' as lang_pred", "true as kept", "0 as shard")
    for part in (docs.limit(0), docs.where("doc_id < 12")):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, part, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= part.count()


def _entry(folder):
    code = ("import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); "
            "s.loader.exec_module(m); print(*m.queries()); print(len(m.oracle_sql()))")
    env = {**os.environ, "PYTHONPATH": ""}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True)


def test_entry_with_and_without_the_subpackage(tmp_path):
    names = _entry(ROOT).stdout.split("\n")[0].split()
    assert {f.__name__ for f in LLM_QUERIES.values()} | {"pipeline"} <= set(names) and set(LLM_ORACLES) <= set(names)
    shutil.copytree(ROOT, tmp_path / "bare", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = _entry(tmp_path / "bare")
    assert out.returncode == 0 and not any(n.startswith("op") and n[2].isdigit() for n in out.stdout.split()), out.stderr
    # Any other import error is not swallowed.
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path / "bare")
    (tmp_path / "bare" / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert _entry(tmp_path / "bare").returncode != 0
    assert importlib.util.find_spec("pressgrid.llm") is not None
