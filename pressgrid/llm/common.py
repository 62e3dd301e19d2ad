"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage (nothing above it is computed twice or lost with an
    executor) and lets Spark plan later joins from real sizes.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``in``: work columns beside it cannot clash with
    its own, and ``select("in.*")`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("in"))


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tidy(run):
    """``run`` (a function over Arrow batches) that gives freed memory back to the
    system when a task ends: workers are kept for later tasks, and one executor's
    workers and JVM share its memory."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system's C library can
                ctypes.CDLL(None).malloc_trim(0)
    return wrapped


# Rows in one Arrow batch to a Python worker: texts are long, so fewer rows than
# Spark's default keep a worker's memory small.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def slices(texts: list, limit: int):
    """Consecutive (start, end) ranges of ``texts`` with about ``limit`` characters
    each (a longer text has a range of its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
