"""First, last and samples in the order of the files, against DuckDB's row numbers of the file."""

from __future__ import annotations

import duckdb
import pytest

import tallyframe as tf

SF = "/root/testdata/sf0.01"


def test_first_last_follow_the_file(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(7)  # tasks in any order; places stay
    got = sorted(tuple(r) for r in tf.group_agg(orders, "o_orderpriority", "o_totalprice", ["first", "last"], order_by="file").collect())
    want = duckdb.sql(
        f"select o_orderpriority, arg_min(o_totalprice, file_row_number), arg_max(o_totalprice, file_row_number) "
        f"from read_parquet('{SF}/orders.parquet', file_row_number=true) group by 1 order by 1"
    ).fetchall()
    assert got == want


def test_samples_follow_the_files_and_csv_splits(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = [tuple(r) for r in tf.sample_rows(lines.where("l_quantity > 10"), 5, order_by=["file"]).collect()]
    want = duckdb.sql(f"select * from read_parquet('{SF}/lineitem.parquet') where l_quantity > 10 limit 5").fetchall()
    assert [r[:3] for r in got] == [r[:3] for r in want]
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as out:
        out.write("n,t\n" + "".join(f"{i},x{i}\n" for i in range(500)))
    rows = spark.read.option("header", True).csv(path)
    assert [int(r.n) for r in tf.sample_rows(rows, 4, order_by=["file"]).collect()] == [0, 1, 2, 3]


def test_a_column_called_file_wins_and_plain_tables_refuse(spark):
    rows = spark.createDataFrame([(2, "a", 1.0), (1, "a", 2.0)], "file int, k string, v double")
    assert tf.group_agg(rows, "k", "v", "first", order_by="file").first().value == 2.0
    with pytest.raises(ValueError):
        tf.sample_rows(rows.drop("file"), 1, order_by=["file"])
