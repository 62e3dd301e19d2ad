"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list, default the headline set).
Each query is run to completion with the ``noop`` sink (every row computed,
nothing collected to the driver); the time is the best wall-clock time of
``BENCH_RUNS`` (default 2) runs per query, after a warm-up pass of the same
queries on the sf0.01 tables (JIT and code generation), so that noise from a
shared machine weighs less.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressgrid.plans.queries import REGISTRY  # noqa: E402
from pressgrid.session import build_session  # noqa: E402

HEADLINE = [
    "result_rows",          # whole URL pipeline: routing, page lookup, cleaning, JSON-LD, metadata
    "page_metadata",        # structured-first metadata on every page
    "clean_content",        # boilerplate removal + main text
    "paragraph_text",
    "jsonld_fields",
    "url_metadata",         # URL-only rules on every event URL
    "afp_enrich",
    "llm_validate",         # model-output span, repair ladder, record check
    "running_progress",     # ordered running counts without a single-task window
    "row_labels",
    "run_stats",
    "urls_from_text",
    "scrub_text",
    "fix_mojibake",
    "content_hash_dedupe",
    "intake_outcome",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="pressgrid-bench")
    # Warm-up: the same plans once on the smallest tables, so that the timed
    # pass measures execution rather than JIT and code generation.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    for name in names:
        REGISTRY[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir) \
            .write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
