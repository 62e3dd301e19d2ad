"""Run a registered query in Spark and its oracle in DuckDB; compare results.

Mirrors the driver's check: same row count, same column names, and the
same multiset of rows once columns are sorted by name.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows(df_pandas) -> tuple[list[str], list[tuple]]:
    cols = sorted(df_pandas.columns)
    out = []
    for rec in df_pandas[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort(key=lambda r: tuple("" if x is None else x for x in r))
    return cols, out


def compare(spark, con, name, spark_fn, sql, sf_dir):
    sdf = spark_fn(spark, sf_dir).toPandas()
    odf = con.execute(sql).df()
    scols, srows = rows(sdf)
    ocols, orows = rows(odf)
    problems = []
    if scols != ocols:
        problems.append(f"columns differ: spark={scols} oracle={ocols}")
    if len(srows) != len(orows):
        problems.append(f"row count: spark={len(srows)} oracle={len(orows)}")
    if not problems and srows != orows:
        so, oo = set(srows), set(orows)
        only_s = sorted(so - oo, key=str)[:3]
        only_o = sorted(oo - so, key=str)[:3]
        problems.append(f"values differ; spark-only={only_s} oracle-only={only_o}")
    return problems
