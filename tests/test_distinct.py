"""Distinct whole numbers by bitmaps against DuckDB: table, groups, negatives, nulls, empty."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.operators.distinct import bitmap_distinct

SF = "/root/testdata/sf0.01"


def test_table_and_groups_equal_duckdb(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    assert tf.total_values(lines, "l_partkey").first()[0] == con.execute("select count(distinct l_partkey) from lineitem").fetchone()[0]
    got = sorted((r.key, r.value) for r in tf.group_agg(lines, "l_returnflag", "l_suppkey", "nunique").collect())
    want = sorted(con.execute("select l_returnflag, count(distinct l_suppkey)::double from lineitem group by 1").fetchall())
    assert got == want
    plan = tf.total_values(lines, "l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" in plan.lower()


def test_negatives_zero_extremes_nulls_and_empty_groups(spark):
    values = [0, -1, 1, -32768, 32768, -32767, 32767, 2**63 - 1, -(2**63), 5, 5, None]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v long")
    assert bitmap_distinct(rows, F.col("v")).first()[0] == len({v for v in values if v is not None})
    got = {r.k: r.n for r in bitmap_distinct(rows, F.col("v"), [F.col("k")], "n").collect()}
    assert got == {"a": 10, "b": 0}
    assert bitmap_distinct(rows.limit(0), F.col("v")).first()[0] == 0


def test_sparse_whole_numbers_are_counted_without_bitmaps(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 10**12, -(10**15), 10**12)], "v long")
    plan = tf.total_values(rows, "v")
    assert plan.first()[0] == 3 and "bitmap" not in plan._jdf.queryExecution().executedPlan().toString().lower()
