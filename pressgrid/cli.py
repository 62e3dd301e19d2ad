"""Command line for the three user flows, as Spark jobs.

    python -m pressgrid.cli process  --urls links.txt --pages pages/ --blocked blocked.txt \
                                     --out results/ [--begin 3154 --end 3865] [--csv]
    python -m pressgrid.cli intake   --uploads drop/ --pages pages/ --blocked blocked.txt \
                                     --out results/ [--max-urls 20]
    python -m pressgrid.cli reprocess --table old.csv --pages pages/ --blocked blocked.txt --out new/
    python -m pressgrid.cli enrich-afp --table results.csv --out enriched/

``--pages`` is a parquet table ``(page_id, url, html)`` (or a bucketed table
name with ``--pages-table``).  Results are parquet, plus the BOM CSV with
``--csv``; run statistics are printed as one JSON line.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ordering, stats
from .operators.enrich import enrich_afp
from .operators.urls import cap_batch
from .plans import pipeline
from .session import build_session, configure
from .sources import files


def _pages(spark: SparkSession, args) -> DataFrame:
    if args.pages_table:
        return spark.table(args.pages_table)
    return spark.read.parquet(args.pages)


def _blocked(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        return spark.createDataFrame([], "url string")
    return files.read_url_lines(spark, path).select("url")


def _write(results: DataFrame, out: str, csv: bool, order_col: str = "pos") -> dict:
    """Run the plan once into parquet; the CSV and the statistics read that
    output back (column-pruned), so the pipeline is never computed twice."""
    spark = results.sparkSession
    pipeline.result_rows(results, keep=(order_col,)).write.mode("overwrite").parquet(f"{out}/parquet")
    rows = spark.read.parquet(f"{out}/parquet")
    if csv:
        files.write_result_csv(rows.orderBy(order_col), f"{out}/csv")
    return stats.run_stats(rows).first().asDict()


def cmd_process(spark: SparkSession, args) -> dict:
    """URL file -> optional row slice -> pipeline -> sink -> stats."""
    urls = files.read_url_lines(spark, args.urls)
    if args.begin is not None or args.end is not None:
        numbered = ordering.number_rows(urls, ["pos"], total_col=None)
        begin = args.begin or 0
        end = args.end if args.end is not None else (1 << 62)
        urls = ordering.row_slice(numbered, "row_no", begin, end).drop("row_no")
    results = pipeline.process_urls(urls, _pages(spark, args), _blocked(spark, args.blocked))
    return _write(results, args.out, args.csv)


def cmd_intake(spark: SparkSession, args) -> dict:
    """Uploaded files -> per-file outcome -> batch cap -> pipeline."""
    urls, outcome = files.read_uploads(spark, args.uploads)
    # Every file is a batch of its own; a refused one says so in its outcome.
    capped = cap_batch(urls, "path", args.max_urls)
    refused = capped.where("refused").groupBy("path").agg(F.first("error").alias("_refused"))
    outcome.join(refused, "path", "left") \
        .withColumn("error", F.coalesce("error", "_refused")).drop("_refused") \
        .write.mode("overwrite").parquet(f"{args.out}/intake")
    todo = capped.where(~F.col("refused")).select(F.monotonically_increasing_id().alias("pos"), "url")
    results = pipeline.process_urls(todo, _pages(spark, args), _blocked(spark, args.blocked))
    return _write(results, args.out, args.csv)


def cmd_reprocess(spark: SparkSession, args) -> dict:
    """An old result CSV -> URL-only rows reprocessed, the rest kept, order kept."""
    old = files.read_result_csv(spark, args.table, replace_header=True)
    old = old.withColumn("row_no", F.monotonically_increasing_id())
    out = pipeline.reprocess_lonely(old, _pages(spark, args), _blocked(spark, args.blocked))
    out.write.mode("overwrite").parquet(f"{args.out}/parquet")
    written = spark.read.parquet(f"{args.out}/parquet")
    if args.csv:
        files.write_result_csv(written.orderBy("row_no"), f"{args.out}/csv")
    return {"rows": written.count()}


def cmd_enrich_afp(spark: SparkSession, args) -> dict:
    """AFP rows get the stamp of their URL as published and modified date."""
    df = files.read_result_csv(spark, args.table)
    out = enrich_afp(df)
    # Cells as they were: padding and empty cells are kept.
    (out.write.mode("overwrite").option("header", "true").option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(args.out))
    return {"rows": spark.read.option("header", "true").option("multiLine", "true")
            .option("escape", '"').csv(args.out).count()}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pressgrid")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("process", "intake", "reprocess", "enrich-afp"):
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        s.add_argument("--csv", action="store_true")
        s.add_argument("--master", default=None)
        if name != "enrich-afp":
            s.add_argument("--pages")
            s.add_argument("--pages-table")
            s.add_argument("--blocked")
        if name == "process":
            s.add_argument("--urls", required=True)
            s.add_argument("--begin", type=int)
            s.add_argument("--end", type=int)
        if name == "intake":
            s.add_argument("--uploads", required=True)
            s.add_argument("--max-urls", type=int, default=20)
        if name in ("reprocess", "enrich-afp"):
            s.add_argument("--table", required=True)
    args = p.parse_args(argv)
    spark = build_session(args.master) if args.master else configure(SparkSession.builder.getOrCreate())
    handler = {"process": cmd_process, "intake": cmd_intake, "reprocess": cmd_reprocess,
               "enrich-afp": cmd_enrich_afp}[args.cmd]
    print(json.dumps(handler(spark, args)))


if __name__ == "__main__":
    main()
