"""Enrichment of existing result tables (D2) and progress metrics (section 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import afp_datetime
from ..functions.urls import is_afp_source


def enrich_afp(df: DataFrame, url_col: str = "url", source_col: str = "source") -> DataFrame:
    """Rows whose source is AFP and whose URL carries an AFP stamp get that
    stamp (US Eastern) as published and modified date; all rows and columns
    are kept as they are otherwise.  Column names resolve case-insensitively,
    so a table with ``URL`` works as well as one with ``url``."""
    out = df.withColumn("_stamp", F.when(is_afp_source(source_col), afp_datetime(url_col)))
    dates = {c: F.coalesce("_stamp", F.col(c)) for c in ("published_date", "modified_date")}
    return out.withColumns(dates).select(*df.columns)


def with_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The status callback as metrics: rows done, rows with 'success', per
    status class, gathered while the job runs (``Observation.get`` after an
    action).  Streaming jobs see the same numbers in ``StreamingQueryListener``
    progress events."""
    obs = Observation(name)
    observed = df.observe(
        obs,
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status").startswith("error")).alias("failed"),
    )
    return observed, obs
