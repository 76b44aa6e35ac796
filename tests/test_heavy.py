"""Top values from Misra-Gries summaries: settled, unsettled and fallen back, always exact."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.operators.heavy import top_values

SF = "/root/testdata/sf0.01"


def duck(sql: str):
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return [tuple(r) for r in con.execute(sql).fetchall()]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_skewed_column_is_settled_without_counting_all_values(lines):
    # A third of the rows share one value; the rest spread over suppliers.
    rows = lines.select(F.when(F.col("l_linenumber") <= 2, F.lit(-1)).otherwise(F.col("l_suppkey")).alias("value"))
    got = top_values(rows, "value", 5, counters=64)
    assert got is not None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan or "Scan" in plan  # the count reads candidates only (a written table)
    top = sorted(((r.value, r["count"]) for r in got.collect()), key=lambda r: (-r[1], r[0]))[:5]
    want = duck(
        "select case when l_linenumber <= 2 then -1 else l_suppkey end v, count(*) c from lineitem "
        "group by 1 order by c desc, v limit 5"
    )
    assert top == want


@pytest.mark.parametrize("counters", [4, 64, 1 << 14])
def test_value_counts_equal_duckdb_at_every_number_of_counters(lines, monkeypatch, counters):
    import tallyframe.operators.heavy as heavy

    monkeypatch.setattr(heavy, "COUNTERS", counters)
    monkeypatch.setattr(heavy.top_values, "__defaults__", (counters, heavy.BROADCAST_CANDIDATES))
    got = [(r.value, r["count"]) for r in tf.value_counts(lines, "l_suppkey", limit=10, split=False).collect()]
    want = duck("select l_suppkey::varchar, count(*) from lineitem group by 1 order by 2 desc, l_suppkey::varchar limit 10")
    assert got == want


def test_mostly_distinct_column_falls_back_to_all_values(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("value"))
    assert top_values(rows, "value", 20, counters=16) is None
    got = [(r.value, r["count"]) for r in tf.value_counts(orders, "o_orderkey", split=False).collect()]
    want = duck("select o_orderkey::varchar v, count(*) c from orders group by 1 order by c desc, v limit 20")
    assert got == want


def test_fewer_values_than_asked_and_empty_tables(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "value string")
    assert sorted(tuple(r) for r in tf.value_counts(rows, "value", limit=5, split=False).collect()) == [("a", 2), ("b", 1)]
    assert tf.value_counts(rows.limit(0), "value", split=False).count() == 0
