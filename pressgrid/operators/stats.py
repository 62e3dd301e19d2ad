"""Counts over result and response tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals


def run_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1 + A2: total, successful (status 'success' only), failed = total -
    successful, rows with article text, and rows that carry a record (which
    also counts 'success_url_parser')."""
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.coalesce(F.col("article_text"), F.lit("")) != "").alias("with_text"),
        F.count_if(F.col("status").startswith("success")).alias("with_record"),
    ]
    g = results.groupBy(*by) if by else results
    out = g.agg(*aggs)
    return out.select(*(by or []), "total", "successful",
                      (F.col("total") - F.col("successful")).alias("failed"), "with_text", "with_record")


def running_progress(results: DataFrame, ts_col: str = "ts", id_col: str = "event_id",
                     run_col: str | None = "run_id") -> DataFrame:
    """After each completed row: completed so far, successful so far, and the
    run's total, in completion order (ts, then id)."""
    out = running_totals(results, [ts_col, id_col],
                         {"completed": F.lit(1), "successful_so_far": (F.col("status") == "success")},
                         run_col, totals=True)
    return out.withColumnRenamed("completed_total", "total").drop("successful_so_far_total")


def response_yield(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: valid records / all responses."""
    g = validated.groupBy(*by) if by else validated
    out = g.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid")).alias("valid"))
    return out.withColumn("yield", F.col("valid") / F.col("total"))
