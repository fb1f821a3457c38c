"""Physical plan shape: no single-task windows, pruned scans, bounded broadcasts."""
import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_pruned_scan_without_shuffle(spark):
    df = E.queries()["page_linkage"](spark, SF_SMALL)
    plan = _plan(df)
    # Only the round-robin spread of a single-split table; no keyed shuffle.
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert "FileScan parquet" in plan


def test_scan_reads_only_used_columns(spark):
    df = E.queries()["page_url_features"](spark, SF_SMALL)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in formatted


def test_domain_limit_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(E.queries()["limited_links"](spark, SF_SMALL))


def test_error_heatmap_reads_its_rows_once_and_joins_only_the_grid(spark):
    plan = _plan(E.queries()["error_heatmap"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 2  # documents and labels; the edges are in the expression
    assert "Window" not in plan


def test_order_statistics_have_no_window_per_feature(spark):
    for name in ("feature_percentiles", "value_statistics", "interval_edges", "day_change_curve"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "Window" not in plan and "SinglePartition" not in plan, name


def test_day_pairs_are_one_scan_and_one_exchange(spark):
    plan = _plan(E.queries()["day_pair_bits"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_text_leaves_its_task_in_the_crawl_order(spark, monkeypatch):
    """What goes through the range exchange and the checkpoint holds digests and hashes, no lines."""
    from pagetide.operators import ordering
    seen = []
    shifted = ordering._shifted
    monkeypatch.setattr(ordering, "_shifted", lambda groups, carry, prefix: (seen.append(carry), shifted(groups, carry, prefix))[1])
    for name in ("start_duplicates", "hash_duplicates", "false_duplicates"):
        assert "text_lines" not in _plan(E.queries()[name](spark, SF_SMALL)).split("FileScan")[0]
    assert seen and all("text_lines" not in carry and "text" not in carry for carry in seen)


def test_crawl_order_has_no_single_partition_exchange(spark):
    for name in ("start_duplicates", "hash_duplicates", "false_duplicates", "crawl_ordered"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "SinglePartition" not in plan, name


def test_weekly_counts_shuffle_once_over_the_input(spark):
    from pagetide.operators import timeline as T
    from pagetide.sources import proxies as X
    from pagetide.sources.tables import Tables
    bits = X.change_bits(Tables(spark, SF_SMALL).events)
    import datetime as dt
    plan = _plan(T.weekly_count_arrays(bits, dt.date(2024, 1, 1), 4))
    # proxy build (user, day) + the per-page weekly arrays
    assert plan.count("Exchange hashpartitioning") == 2


def test_change_bits_shuffle_digests_not_lists(spark):
    plan = E.queries()["day_pair_bits"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan


def test_python_runs_only_where_alignment_is_needed(spark):
    """Only the difflib-backed queries carry a Python evaluation node (amplitude_curve
    runs its alignment before its checkpoint, so its final plan starts from files)."""
    python_ok = {"false_duplicates", "feature_diff", "change_amplitudes", "diff_totals"}
    for name in ("page_linkage", "page_static_features", "page_feature_numbers", "weekly_changes", "change_cube",
                 "daily_changes", "feature_percentiles", "error_heatmap", "start_duplicates", "day_pair_bits",
                 "changed_sample", "limited_links", "threat_urls", "token_chunks", "cosine_neighbours",
                 *sorted(python_ok)):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        has_python = "ArrowEvalPython" in plan or "BatchEvalPython" in plan
        assert has_python == (name in python_ok), name
