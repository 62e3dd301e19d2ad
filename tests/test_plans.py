"""Plan properties that matter at scale, checked on every registered query."""

import pytest

from pressgrid.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
# These run a job while they are built (a stream or a CSV round trip).
RUN_WHILE_BUILT = {"stream_intake", "stream_progress", "stream_pages", "result_csv_roundtrip", "result_csv_replaced_header",
                   "corpus_scan", "url_file_lines", "upload_files", "upload_csv_files", "appended_lines"}


def _plan(spark, name):
    df = REGISTRY[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - RUN_WHILE_BUILT))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


def test_clean_content_reads_only_needed_columns(spark):
    plan = _plan(spark, "clean_content")
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l]
    assert scans and all("[page_id" in l and ",html" in l and "url" not in l.split("]")[0] for l in scans), scans


def test_running_windows_are_partitioned(spark):
    plan = _plan(spark, "running_progress")
    windows = [l for l in plan.splitlines() if "Window [" in l]
    row_window = [w for w in windows if "_pid" in w and "ts" in w]
    assert row_window, windows
    # The per-row window is keyed by partition id and run; only the small
    # per-partition table is ever ordered without a data key.
    assert "windowspecdefinition(_pid" in row_window[0] or "windowspecdefinition(_run" in row_window[0]


def test_result_rows_read_their_tables_once(spark):
    plan = _plan(spark, "result_rows")
    assert plan.count("FileScan") <= 4 and plan.count("Exchange") <= 8, plan


def test_page_lookup_joins_lengths_not_pages(spark):
    plan = _plan(spark, "page_lookup")
    joins = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "html" in l]
    assert not joins, joins
