"""What the optimizer makes of the queries: pruning, pushdown, no hidden bottlenecks."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fareloom.columns import TripColumns
from fareloom.operators import analytics as a
from fareloom.operators import corpus as q
from fareloom.plans.bindings import lineitem_trips
from fareloom.plans.catalog import catalog
from fareloom.sinks.writers import write_hive_partitioned
from fareloom.sources.files import scan_hive

PICKUP = "tpep_pickup_datetime"
BY_MONTH = TripColumns(pickup_year="year", pickup_month="month")
PLAIN = [n for n in catalog() if n[0] in "qba" and not n.startswith("a_daily_summary_")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df) -> int:
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    stack, total = [text], 0
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return total


@pytest.fixture(scope="module")
def partitioned(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hive") / "t")
    write_hive_partitioned(lineitem_trips(spark, sf_dir), root, PICKUP)
    return scan_hive(spark, root)


def test_range_reads_only_its_months(partitioned):
    everything = files_read(partitioned.groupBy("year").count())
    three_months = a.range_daily_stats(partitioned, "1998-06-01", "1998-08-31", BY_MONTH)
    plan = plan_of(three_months)
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*month", plan)
    read = files_read(three_months)
    assert 3 <= read <= 8 and everything > 10 * read
    over_new_year = a.range_daily_stats(partitioned, "1997-12-01", "1998-01-31", BY_MONTH)
    assert 2 <= files_read(over_new_year) <= 6


def test_pruned_and_flat_answers_agree(spark, sf_dir, partitioned):
    for first, last in (("1996-01-01", "1996-02-29"), ("1997-06-01", "1998-06-30"), ("1997-12-31", "1998-01-01")):
        flat = a.range_daily_stats(lineitem_trips(spark, sf_dir), first, last).collect()
        assert a.range_daily_stats(partitioned, first, last, BY_MONTH).collect() == flat and flat


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(a.range_count(lineitem_trips(spark, sf_dir), "1998-06-01", "1998-08-31"))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
    plan = plan_of(q.fee_impact(lineitem_trips(spark, sf_dir)))
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double>" in plan


def test_top_k_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(q.top_routes_by_revenue(lineitem_trips(spark, sf_dir)))


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_single_task_over_raw_rows(spark, sf_dir, name):
    """A single-partition exchange may only follow an aggregate or a limit."""
    plan = plan_of(catalog()[name].run(spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "".join(lines[i + 1 : i + 8])
            assert re.search(r"HashAggregate|LocalLimit|SortAggregate|TakeOrdered", below), below


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for operator in (q.daily_vendor_growth, q.payment_tips, q.cumulative_revenue):
        plan = plan_of(operator(lineitem_trips(spark, sf_dir)))
        assert "partial_count" in plan or "partial_sum" in plan
        assert "HashAggregate" in plan


def test_partition_write_splits_hot_months(spark, tmp_path):
    """AQE may cut one month into several files when it outgrows the target size."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        hot = spark.range(200_000).select(
            F.lit("2024-01-05").cast("timestamp_ntz").alias(PICKUP), F.rand(1).alias("x")
        ).repartition(8)
        write_hive_partitioned(hot, str(tmp_path / "hot"), PICKUP)
    finally:
        spark.conf.set(key, before)
    parts = list((tmp_path / "hot" / "year=2024" / "month=1").glob("*.parquet"))
    assert len(parts) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 200_000
