"""Ordered operators without a single-partition window.

A window with ``ORDER BY`` and no ``PARTITION BY`` moves every row into one
task.  Here one range exchange cuts the ordering key into ranges, and the rows are
stored with the number of their range, so every branch of the plan and every retried
task agrees on it, and the plan holds no cut points, however many ranges there are.
Each range computes its local running values, a table with one row per (range, run)
carries the totals, and a running sum over that small table gives each range its
starting offset.  The ordering key must be unique (add a tie-breaker such as an id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


# A range holds about this many rows, unless there are more ranges than shuffle partitions.
RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``df`` stored with ``_pid``, the number of its range of ``keys`` (rising with the
    key).  At most ``n`` ranges; a small table has one for every core."""
    spark = df.sparkSession
    rows = df.count()
    n = max(1, min(n, max(-(-rows // RANGE_ROWS), spark.sparkContext.defaultParallelism)))
    return stored(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, order_cols: list[str], sums: dict[str, Column],
                   run_col: str | None = None, num_partitions: int | None = None,
                   totals: bool = False) -> DataFrame:
    """Add one column per ``sums`` entry: the running sum of that expression over
    ``order_cols`` (rows up to and including the current one), restarting per
    ``run_col`` when given.  With ``totals=True`` also ``<name>_total``, the
    run's whole sum, taken from the same small per-range table (no extra
    aggregate over the rows)."""
    run = F.col(run_col) if run_col else F.lit(0)
    keys = ([run_col] if run_col else []) + list(order_cols)
    r = df.withColumn("_run", run)
    for name, expr in sums.items():
        r = r.withColumn(f"_v_{name}", F.coalesce(expr.cast("long"), F.lit(0)))
    r = in_ranges(r, keys, _partitions(df, num_partitions))
    w_local = (Window.partitionBy("_pid", "_run").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.select("*", *[F.sum(f"_v_{n}").over(w_local).alias(f"_l_{n}") for n in sums])
    parts = r.groupBy("_pid", "_run").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    # One row per (range, run): at most as many rows as ranges without runs,
    # which is a proven bound, so it is broadcast; with runs the bound is
    # ranges + runs and the choice is left to AQE's runtime statistics.
    w_prev = Window.partitionBy("_run").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy("_run")
    offsets = parts.select("_pid", F.col("_run").alias("_orun"), *[
        F.coalesce(F.sum(f"_p_{n}").over(w_prev), F.lit(0)).alias(f"_o_{n}") for n in sums], *[
        F.sum(f"_p_{n}").over(w_run).alias(f"{n}_total") for n in (sums if totals else [])])
    offsets = offsets.withColumnRenamed("_pid", "_opid")
    same = (F.col("_pid") == F.col("_opid")) & F.col("_run").eqNullSafe(F.col("_orun"))
    out = local.join(offsets if run_col else F.broadcast(offsets), same)
    out = out.select("*", *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])
    drop = ["_pid", "_run", "_opid", "_orun"] + [f"_{p}_{n}" for n in sums for p in ("v", "l", "o")]
    return out.drop(*drop)


def number_rows(df: DataFrame, order_cols: list[str], run_col: str | None = None,
                out_col: str = "row_no", total_col: str | None = "total") -> DataFrame:
    """1-based row number over ``order_cols`` (per run), plus the run's size."""
    out = running_totals(df, order_cols, {out_col: F.lit(1)}, run_col, totals=bool(total_col))
    if total_col:
        out = out.withColumnRenamed(f"{out_col}_total", total_col)
    return out


def row_slice(df: DataFrame, row_no_col: str, begin: int, end: int) -> DataFrame:
    """Rows ``[begin, end)`` (0-based, half-open) of a numbered table.

    A filter on the row number, so it stays distributed and is pushed down;
    no global sort-and-limit.
    """
    n = F.col(row_no_col)
    return df.where((n > begin) & (n <= end))
