"""What the physical plans must look like to hold at a thousand times the data."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import tallyframe as tf
from tallyframe import shared

SF_DIR = "/root/testdata/sf0.001"

# Row-wise or Arrow Python, joins of all pairs, and whole results through one task.
UNWANTED = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "InPandas",
    "InArrow",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "CollectLimit",
)


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(registered.CORE))
def test_no_unwanted_operators(spark, name):
    plan = plan_of(registered.queries()[name](spark, SF_DIR))
    assert not [word for word in UNWANTED if word in plan]


def orders(spark):
    return registered.table(spark, SF_DIR, "orders")


@pytest.mark.parametrize(
    "condition, pushed",
    [
        ({"column": "o_orderstatus", "operator": "eq", "value": "F"}, "EqualTo(o_orderstatus,F)"),
        ({"column": "o_custkey", "operator": "eq", "value": "3"}, "EqualTo(o_custkey,3)"),
        ({"column": "o_totalprice", "operator": "eq", "value": 1.5}, "EqualTo(o_totalprice,1.5)"),
        ({"column": "o_orderdate", "operator": "date_year", "value": 1997}, "LessThan(o_orderdate,1998-01-01T00:00)"),
        (
            {"column": "o_orderdate", "operator": "date_month_year", "value": {"month": 12, "year": 1997}},
            "GreaterThanOrEqual(o_orderdate,1997-12-01T00:00)",
        ),
        ({"column": "o_orderpriority", "value": "this"}, "IsNotNull(o_orderpriority)"),
        ({"column": "o_orderpriority", "value": "low"}, "IsNotNull(o_orderpriority)"),
    ],
)
def test_filters_reach_the_scan(spark, condition, pushed):
    plan = plan_of(tf.apply_filters(orders(spark), condition).select("o_orderkey"))
    line = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert pushed in line
    read = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert read.count(":") == 3  # the label, the key and the filtered column


def test_impossible_equality_reads_nothing(spark):
    plan = plan_of(tf.apply_filters(orders(spark), {"column": "o_custkey", "operator": "eq", "value": "03"}))
    assert "FileScan" not in plan and "Scan parquet" not in plan


def test_top_k_without_full_sort(spark):
    for df in (tf.sort_limit(orders(spark), "o_totalprice"), tf.value_counts(orders(spark), "o_custkey")):
        plan = plan_of(df)
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_counts_are_combined_before_the_shuffle(spark):
    plan = plan_of(tf.value_counts(orders(spark), "o_orderstatus", split=True))
    assert "partial_count" in plan and plan.count("Exchange (") <= 2


def test_distinct_per_group_shuffles_by_key_and_value(spark):
    plan = plan_of(tf.group_agg(orders(spark), "o_orderpriority", "o_custkey", "nunique"))
    assert "hashpartitioning(key" in plan and "_value" in plan.split("hashpartitioning(key", 1)[1].splitlines()[0]


def test_medians_never_hold_a_group(spark):
    for keys in ("o_orderstatus", "o_custkey"):
        plan = plan_of(tf.group_agg(orders(spark), keys, "o_totalprice", "median"))
        assert "median(" not in plan and "percentile(" not in plan and "Scan ExistingRDD" in plan


def test_positions_move_rows_once(spark):
    from tallyframe.operators.ranges import RANGE, with_positions

    plan = plan_of(with_positions(orders(spark), [F.col("o_totalprice")], "n"))
    assert f"hashpartitioning({RANGE}" not in plan.replace("partial", "") or plan.count("SortMergeJoin") == 0
    assert "Window.partitionBy" not in plan and plan.count("BroadcastHashJoin") >= 1


def test_first_and_last_stay_hash_aggregates(spark):
    plan = plan_of(tf.group_agg(orders(spark), "o_orderstatus", "o_totalprice", ["first", "last"], order_by="o_orderkey"))
    assert "SortAggregate" not in plan


def test_size_of_the_profile_query_does_not_grow(spark):
    from tallyframe.operators.metrics import _partial

    wide = spark.range(5).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(40)])
    few = _partial(wide, range(2), wide.columns, ["date_text"])
    many = _partial(wide, range(40), wide.columns, ["date_text"])
    assert len(few.columns) == len(many.columns)
    assert len(plan_of(many)) < 3 * len(plan_of(few))


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, context, conf):
        self.sparkContext, self.conf = context, conf


def test_shared_folder():
    named = Session(Context("yarn"), {"spark.checkpoint.dir": "hdfs:///c"})
    assert shared.shared_folder(named) == named.sparkContext.folder == "hdfs:///c"
    assert shared.shared_folder(Session(Context("yarn", "s3a://b/c"), {})) == "s3a://b/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(Context("yarn"), {}))
    local = Session(Context("local[2]"), {})
    assert shared.shared_folder(local) == local.sparkContext.folder
