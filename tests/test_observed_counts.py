"""Counts of a filter observed while its rows are written: one job, no second scan."""

from __future__ import annotations

import duckdb

import tallyframe as tf

SF = "/root/testdata/sf0.01"


def test_rows_written_and_counted_in_one_job(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    plan = {"operation": "filter", "filter": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}]}
    result = tf.run_plan(orders, plan)
    spark.sparkContext.setJobGroup("write-and-count", "write-and-count")
    try:
        result.write_rows(str(tmp_path / "rows"))
        counted = result.count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("write-and-count")
    assert len(jobs) == 1
    want = duckdb.sql(f"select count(*) from '{SF}/orders.parquet' where o_orderstatus = 'F'").fetchall()[0][0]
    assert counted == want == spark.read.parquet(str(tmp_path / "rows")).count()


def test_other_operations_count_on_demand(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    result = tf.run_plan(orders, {"operation": "value_counts", "target_column": "o_orderpriority"})
    result.write_rows(str(tmp_path / "counts"), "json")
    assert result.count() == orders.count()
