"""Plan properties that matter at scale, checked on the physical plans."""

import re

import pytest

import __spark_entry__ as E
from scrivener.plans import registry
from tests.conftest import SF_SMALL

registry.load_all()
QUERIES = registry.QUERIES
STREAMING = {"window_analytics_stream", "chained_topics", "upsert_results", "dedupe_stream",
             "topic_source", "topic_sink", "append_sink", "session_metrics_stream",
             "error_rate_stream"}


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_latest_per_key_is_an_aggregate(spark):
    p = plan(spark, "latest_results")
    assert "HashAggregate" in p or "SortAggregate" in p or "ObjectHashAggregate" in p
    assert "Window [" not in p


def test_top_k_is_limited_before_shuffle(spark):
    p = plan(spark, "top5_notifications")
    assert "WindowGroupLimit" in p


def test_point_lookup_is_pushed_to_scan(spark):
    p = plan(spark, "lookup_submission")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderkey,7\)", p)


def test_flagship_scan_is_pruned(spark):
    p = plan(spark, "window_analytics")
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert "user_id" not in schema


def test_internal_similarity_has_no_pair_join(spark):
    p = plan(spark, "internal_similarity")
    assert "Expand" in p                      # grouping sets: one scan, two groupings
    joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)[^\n]*", p)
    assert all("h1" not in j for j in joins)


def test_bucketed_tables_join_without_shuffle(spark):
    """Co-located join: both sides bucketed by the join key, no Exchange."""
    from scrivener.sources.tables import read_table, save_bucketed
    orders = read_table(spark, SF_SMALL, "orders")
    docs = read_table(spark, SF_SMALL, "documents")
    save_bucketed(orders.withColumnRenamed("o_orderkey", "id"), "b_orders", "id", 8)
    save_bucketed(docs.withColumnRenamed("doc_id", "id"), "b_documents", "id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("b_orders").join(spark.table("b_documents"), "id", "left")
        p = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert j.count() == orders.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["notify_upload", "enrich_submission", "notifications_all", "top5_notifications",
                                  "student_dashboard", "dead_letter", "text_backfill"])
def test_no_text_is_shuffled_for_its_length(spark, name):
    """Texts are read by the scan only: no exchange, join or sort carries them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in p.splitlines():
        if re.search(r"\btext#\d+", line):
            assert re.search(r"FileScan|Project|Filter", line), line
    assert "text:string" in p


@pytest.mark.parametrize("name", ["external_similarity", "document_checks"])
def test_no_single_task_size_check(spark, name):
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", "build")
    p = plan(spark, name)
    # building the plan reads the footers of the two tables and nothing else
    assert len(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) <= 2
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert "SinglePartition" not in p and "GlobalLimit" not in p
