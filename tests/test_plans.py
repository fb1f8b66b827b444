"""What the planner makes of the operators."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import documents, ranking, relational, retrieval
from tessera.sources.readers import load_table


def explained(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_lookup_reaches_the_scan(spark, sf):
    plan = explained(relational.exact_lookup(load_table(spark, sf, "customer"), "c_name", "x", ["c_custkey", "c_name"]))
    assert "EqualTo(c_name,x)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_prefilter_reaches_the_scan_and_postfilter_stays_above_the_limit(spark, sf):
    rows = load_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    probe = [1.0] * 64
    before = explained(retrieval.vector_topk_prefilter(rows, probe, 5, F.col("label") == 3, columns=["label"]))
    assert "EqualTo(label,3)" in before
    after = explained(retrieval.vector_topk_postfilter(rows, probe, 5, F.col("label") == 3, columns=["label"]), "extended")
    optimized = after.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.index("Filter (isnotnull(label") < optimized.index("GlobalLimit")


@pytest.mark.parametrize("key", ["topk_per_group", "latest_run", "stratified_sample", "dedup_by_hash", "prompt_registry"])
def test_group_limits_run_before_the_shuffle(spark, sf, key):
    plan = explained(plans.QUERIES[key](spark, sf), "simple")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_semi_and_small_joins(spark, sf):
    assert "LeftSemi" in explained(plans.QUERIES["usage_semi_join"](spark, sf), "simple")
    assert "BroadcastHashJoin" in explained(plans.QUERIES["golden_inner_join"](spark, sf), "simple")


SLOW = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
NO_STREAMS = sorted(k for k in plans.QUERIES if not k.startswith("stream_") and k != "sql_chunks")


@pytest.mark.parametrize("key", NO_STREAMS)
def test_no_cross_joins_and_no_row_functions(spark, sf, key):
    plan = explained(plans.QUERIES[key](spark, sf), "simple")
    assert not [s for s in SLOW if s in plan]


def test_whole_table_order_is_not_one_task(spark, sf):
    events = load_table(spark, sf, "events").select("event_id")
    plan = explained(ranking.global_running(events, [F.col("event_id")], row_number="n", partitions=8), "simple")
    assert plan.count("SinglePartition") <= 1
    # the rows themselves are already written in order: only the totals of the ranges are exchanged now
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan and "Window" in plan


def test_whole_table_order_takes_one_exchange_and_even_ranges(spark):
    """Also where nine of ten rows share the first column of the order."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), "id").repartition(5)
    out = ranking.global_running(rows, [F.col("k"), F.col("id")], row_number="n", partitions=8)
    assert out.agg(F.max("n")).first()[0] == 20_000
    sizes = [r["count"] for r in spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)


def test_chunks_do_not_shuffle(spark, sf):
    docs = load_table(spark, sf, "documents")
    assert "Exchange" not in explained(documents.window_chunk(docs, "doc_id", "text", 50, 10), "simple")
    assert "Exchange" not in explained(documents.html_header_sections(load_table(spark, sf, "pages"), "page_id", "html"), "simple")
