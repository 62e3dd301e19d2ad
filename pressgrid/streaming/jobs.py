"""Structured Streaming jobs (ST1-ST3).

The same column functions and operators as the batch plans; only the source
and the sink change.  State lives in the checkpoint folder the cluster names
(``spark.checkpoint.dir``), so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..plans import pipeline
from ..session import ensure_checkpoint_dir
from ..sources.files import MAX_UPLOAD_BYTES, size_gate


BINARY_FILE_SCHEMA = StructType([
    StructField("path", StringType(), False), StructField("modificationTime", TimestampType(), False),
    StructField("length", LongType(), False), StructField("content", BinaryType(), True)])


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def stream_intake(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES,
                  dedupe_window: str | None = None) -> DataFrame:
    """ST1: upload files dropped into ``path`` -> one row per new file content.

    Size gate as in the batch intake; files whose bytes were seen before (in
    any earlier micro-batch) are dropped.  ``dedupe_window`` (e.g. '30 days')
    bounds that state with a watermark on the file time; without it the
    state holds one hash per distinct file, which is small per file.
    """
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.{csv,txt}")
             .option("recursiveFileLookup", "true").load(path))
    # Hash map-side and drop the bytes, so the de-duplication shuffle (and its
    # state) holds narrow rows even when one content has very many copies.
    files = size_gate(files.select("path", "modificationTime", "length", F.md5("content").alias("md5")),
                      max_bytes)
    if dedupe_window:
        files = files.withWatermark("modificationTime", dedupe_window).dropDuplicatesWithinWatermark(["md5"])
    else:
        files = files.dropDuplicates(["md5"])
    return files.select("path", "modificationTime", "length", "md5", "refused", "error")


def stream_progress(results: DataFrame) -> DataFrame:
    """ST2: running totals per status over a stream of result rows."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_pages(pages: DataFrame, blocked: DataFrame):
    """ST3: the URL pipeline as a per-micro-batch function for ``foreachBatch``.

    Each micro-batch of ``(pos, url)`` is a static DataFrame, so the whole
    batch plan applies (distinct URLs, page semi-join, join-back); the page
    and blocked tables are the static sides.  Use with ``run_to_table(...,
    batch_fn=stream_pages(pages, blocked))``.
    """
    def run(batch: DataFrame) -> DataFrame:
        return pipeline.result_rows(pipeline.process_urls(batch, pages, blocked), keep=("pos",))
    return run


def run_to_table(df: DataFrame, name: str, output_mode: str = "append",
                 checkpoint: str | None = None, batch_fn=None) -> str:
    """Run a streaming DataFrame over everything available now and keep the
    result as parquet; returns the table path.  ``batch_fn`` transforms each
    micro-batch (a static DataFrame) first.

    The table belongs to the checkpoint: a restart with the same ``checkpoint``
    goes on from the last committed batch and adds to the same table.  In
    append mode every micro-batch has a folder of its own (``batch=<id>``),
    written over when the batch is retried, so no row is kept twice; in
    complete mode the table is written over.
    """
    spark = df.sparkSession
    ckpt = checkpoint or checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}-state")
    out = f"{ckpt.rstrip('/')}-table"

    def write(batch: DataFrame, epoch: int) -> None:
        folder = out if output_mode == "complete" else f"{out}/batch={epoch}"
        (batch_fn(batch) if batch_fn else batch).write.mode("overwrite").parquet(folder)

    q: StreamingQuery = (df.writeStream.outputMode(output_mode).foreachBatch(write)
                         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out
