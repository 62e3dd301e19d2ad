"""Partitioning helpers for CPU-bound row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


# Tasks for one split of a scan of narrow rows.
TASKS_PER_SPLIT = 4


def spread(df: DataFrame, min_partitions: int | None = None, narrow: bool = False) -> DataFrame:
    """Spread rows over at least ``min_partitions`` tasks (default: the
    cluster's parallelism) when the scan yields fewer.

    Page and document text is small on disk but costly per row (regular
    expressions, JSON parsing); a small file read as one row group would put
    all of it in one task.  On large inputs the scan already has far more
    splits than cores and this is a no-op, so no shuffle is added at scale.
    The round-robin repartition is sorted first by Spark, so a retried task
    sees the same rows.

    ``narrow`` rows (tens of bytes) are always dealt out, to several tasks a split: one
    row group holds millions of them and is read by one task, however many splits the
    scan has, and to move them costs little beside the work on each.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave the plan as is
        return df
    if narrow:
        return df.repartition(max(target, TASKS_PER_SPLIT * current))
    if current >= target:
        return df
    return df.repartition(target)
