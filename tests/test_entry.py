"""The driver contract and the queries that have no oracle."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.columns[:2] == ["pos", "url"] and df.count() > 0
    assert set(m.oracle_sql()) <= set(m.queries())


def test_rows_only_queries_run(spark):
    from pressgrid.plans.oracles import ORACLES
    m = _entry()
    for name, fn in m.queries().items():
        if name in ORACLES:
            continue
        assert fn(spark, "/root/testdata/sf0.001").count() >= 0, name
