"""Grouped aggregates, counts and order against pandas on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.operators import groups, ranges
from tallyframe.operators.ranges import RANGE, first_rows, median_by_ranges, number_ranges, sort_columns, with_positions

ROWS = [
    ("a", 1.0, "x"),
    ("a", 2.0, ""),
    ("a", 7.0, None),
    ("a", None, "x"),
    ("b", 5.0, None),
    ("c", None, None),
    ("c", float("nan"), ""),
    ("d", 3.0, "z"),
    ("d", 3.0, "z"),
    ("d", 3.0, "y"),
    (None, 9.0, "q"),
    ("e", 0.0, "0"),
    ("e", -2.5, "1"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, k string, v double, t string")


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame([(i, *r) for i, r in enumerate(ROWS)], columns=["i", "k", "v", "t"])


def by_key(df, name="value"):
    return {r["key"]: r[name] for r in df.collect()}


def plain(value):
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


@pytest.mark.parametrize(
    "func",
    ["count", "sum", "mean", "min", "max", "median", "quantile", "std", "var", "sem", "nunique", "size", "prod", "skew"],
)
def test_same_as_pandas(table, frame, func):
    expected = frame.groupby("k")["v"].agg(func)
    got = by_key(tf.group_agg(table, "k", "v", func))
    assert set(got) == set("abcde")
    for key, value in expected.items():
        assert got[key] == (pytest.approx(value) if plain(float(value)) is not None else None), key


@pytest.mark.parametrize("func", ["any", "all"])
@pytest.mark.parametrize("column", ["v", "t"])
def test_truth_same_as_pandas(table, frame, func, column):
    expected = frame.dropna(subset=[column]).groupby("k")[column].agg(lambda g: bool(getattr(g.astype(bool), func)()))
    got = by_key(tf.group_agg(table, "k", column, func))
    for key in "abcde":
        assert got[key] == expected.get(key, func == "all"), key


def test_special_groups(table):
    assert by_key(tf.group_agg(table, "k", "v", "sum"))["c"] == 0.0
    assert by_key(tf.group_agg(table, "k", "v", "mean"))["c"] is None
    assert by_key(tf.group_agg(table, "k", "v", "prod"))["c"] == 1.0
    assert by_key(tf.group_agg(table, "k", "v", "std"))["b"] is None
    assert by_key(tf.group_agg(table, "k", "v", "skew"))["a"] == pytest.approx(1.545392525695021)


def test_first_and_last(table, frame):
    got = tf.group_agg(table, "k", "v", ["first", "last"], order_by="i")
    assert by_key(got, "first_value") == {k: plain(v) for k, v in frame.groupby("k")["v"].first().items()}
    assert by_key(got, "last_value") == {k: plain(v) for k, v in frame.groupby("k")["v"].last().items()}
    with pytest.raises(ValueError, match="order_by"):
        tf.group_agg(table, "k", "v", "first")


@pytest.mark.parametrize(
    "column, func, message",
    [("t", "mean", "of type string"), ("t", "sum", "of type string"), ("v", "cumsum", "unknown aggregate")],
)
def test_refused(table, column, func, message):
    with pytest.raises(ValueError, match=message):
        tf.group_agg(table, "k", column, func)


def test_text_minimum_stays_text(table):
    assert by_key(tf.group_agg(table, "k", "t", "max"))["d"] == "z"


def test_booleans_are_summed(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, v boolean")
    assert by_key(tf.group_agg(df, "k", "v", "sum")) == {"a": 1.0, "b": 1.0}
    assert by_key(tf.group_agg(df, "k", "v", "mean")) == {"a": 0.5, "b": 1.0}


def test_units_only_missing(spark):
    rows = [("a", f"{i} min") for i in range(6)] + [("b", None), ("a", "none")]
    df = spark.createDataFrame(rows, "k string, u string")
    assert by_key(tf.group_agg(df, "k", "u", "sum")) == {"a": 15.0, "b": 0.0}
    assert by_key(tf.group_agg(df, "k", "u", "mean")) == {"a": pytest.approx(15 / 7), "b": None}
    assert by_key(tf.group_agg(df, "k", "u", "count")) == {"a": 7.0, "b": 0.0}


def test_several_keys(table):
    rows = tf.group_agg(table, ["k", "t"], "v", "size").collect()
    assert {(r["k"], r["t"]): r["value"] for r in rows} == {
        ("a", "x"): 2, ("a", ""): 1, ("c", ""): 1, ("d", "z"): 2, ("d", "y"): 1, ("e", "0"): 1, ("e", "1"): 1,
    }
    assert tf.groups_count(table, "k").first()["groups_count"] == 5


def test_order_of_groups(table):
    rows = groups.order_groups(tf.group_agg(table, "k", "v", "mean")).collect()
    assert [r["key"] for r in rows] == ["b", "a", "d", "e", "c"]


def hot_table(spark):
    """One key holds most rows, and its values repeat."""
    ids = spark.range(40_000)
    key = F.when(F.col("id") < 30_000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") * 7919) % 50))
    value = F.when(F.col("id") % 11 != 0, ((F.col("id") * 48271) % 9973).cast("double"))
    return ids.select(key.alias("key"), value.alias("v"))


def test_median_of_a_hot_group(spark):
    df = hot_table(spark)
    expected = df.toPandas().groupby("key")["v"].median().to_dict()
    assert by_key(median_by_ranges(df, ["key"], "v", "value")) == expected
    assert by_key(tf.group_agg(df, "key", "v", "median")) == expected
    both = tf.group_agg(df, "key", "v", ["median", "count"])
    assert by_key(both, "median_value") == expected
    assert sum(by_key(both, "count_value").values()) == df.where("v is not null").count()
    approximate = by_key(tf.group_agg(df, "key", "v", "median", approximate=True))
    assert approximate["hot"] == pytest.approx(expected["hot"], rel=0.01)


def test_median_by_ranges_edges(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", 9.0), ("b", 2.0), ("c", None), ("d", 5.0), ("d", 6.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    assert by_key(median_by_ranges(df, ["key"], "v", "value")) == {"a": 2.5, "b": 2.0, "c": None, "d": 5.5}


def test_median_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "k string, v int")
    assert by_key(tf.group_agg(df, "k", "v", "median")) == {"a": 2.5, "b": None}


def test_value_counts(spark):
    values = ["b", "a", "b", None, "a", "c", "d, e"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    rows = [tuple(r) for r in tf.value_counts(df, "t").collect()]
    assert rows == [("a", 2), ("b", 2), ("c", 1), ("d, e", 1)]
    assert sum(n for _, n in rows) == 6
    split = [tuple(r) for r in tf.value_counts(df, "t", split=True).collect()]
    assert split == [("a", 2), ("b", 2), ("c", 1), ("d", 1), ("e", 1)]


@pytest.mark.parametrize("limit", [0, None])
def test_value_counts_default_limit(spark, limit):
    df = spark.range(50)
    assert tf.value_counts(df, "id", limit).count() == 20
    assert tf.value_counts(df, "id", 3).count() == 3
    with pytest.raises(ValueError, match="negative"):
        tf.value_counts(df, "id", -1)


def test_value_counts_skip_nan(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (1.5,)], "v double")
    assert [tuple(r) for r in tf.value_counts(df, "v").collect()] == [("1.5", 2)]
    assert tf.total_values(df, "v").first()["total_values"] == 1
    assert tf.total_values(df, "v", approximate=True).first()["total_values"] == 1


def test_missing_values_sort_last(table):
    down = [r["v"] for r in tf.sort_limit(table, "v", limit=None).collect()]
    up = [r["v"] for r in tf.sort_limit(table, "v", ascending=True, limit=None).collect()]
    finite = sorted(v for _, v, _ in ROWS if plain(v) is not None)
    assert up[: len(finite)] == finite and down[: len(finite)] == finite[::-1]
    assert all(plain(v) is None for v in up[len(finite) :] + down[len(finite) :])


def test_sort_limit_is_a_prefix(table):
    whole = [r["i"] for r in tf.sort_limit(table, ["k", "v"], limit=None).collect()]
    for n in (0, 1, 5, 100):
        assert [r["i"] for r in tf.sort_limit(table, ["k", "v"], limit=n).collect()] == whole[:n]
    with pytest.raises(ValueError, match="negative"):
        tf.sort_limit(table, "v", limit=-2)


def test_sample_rows(table):
    assert tf.sample_rows(table, 4).count() == 4
    assert [r["i"] for r in tf.sample_rows(table, 2, ["i"]).collect()] == [0, 1]


def test_positions_and_large_limits(spark, monkeypatch):
    df = spark.range(5000).select(((F.col("id") * 48271) % 4999).alias("v"), "id")
    order = [(F.col("v"), False), (F.col("id"), True)]
    placed = with_positions(df, sort_columns(order), "p").orderBy("p").collect()
    rows = sorted(df.collect(), key=lambda r: (-r["v"], r["id"]))
    assert [(r["v"], r["id"], r["p"]) for r in placed] == [(r["v"], r["id"], i + 1) for i, r in enumerate(rows)]
    monkeypatch.setattr(ranges, "SMALL_LIMIT", 10)
    assert first_rows(df, order, 700).collect() == rows[:700]
    monkeypatch.setattr(ranges, "SAMPLE_HITS", 100)
    assert first_rows(df, order, 700).collect() == rows[:700]
    assert 700 <= ranges._candidates(df, order[0], 700).count() < 3000
    assert first_rows(df, order, 4990).collect() == rows[:4990]


@pytest.mark.parametrize("ascending", [True, False])
def test_large_limits_with_missing_and_equal_values(spark, monkeypatch, ascending):
    monkeypatch.setattr(ranges, "SMALL_LIMIT", 10)
    monkeypatch.setattr(ranges, "SAMPLE_HITS", 40)
    value = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") % 100)
    df = spark.range(4000).select("id", value.alias("v"))
    for limit in (500, 3000, 3500, 10_000):
        got = tf.sort_limit(df, "v", ascending, limit).collect()
        monkeypatch.setattr(ranges, "SMALL_LIMIT", 10**6)
        assert got == tf.sort_limit(df, "v", ascending, limit).collect()
        monkeypatch.setattr(ranges, "SMALL_LIMIT", 10)


@pytest.mark.parametrize("splits", [1, 12])
def test_equal_rows_are_spread_over_ranges(spark, splits):
    """Half of the rows are the same, from one split or many, and still no range holds them all."""
    value = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))
    df = spark.range(0, 40_000, 1, splits).select(value.alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = number_ranges(df, [F.asc("v")])
        sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
        placed = with_positions(df, [F.asc("v")], "p").orderBy("p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2 * 40_000 / len(sizes)
    assert [r["p"] for r in placed] == list(range(1, 40_001))
    assert [r["v"] for r in placed] == sorted(r["v"] for r in df.collect())


@pytest.mark.parametrize("limit", [1, 50, 399])
def test_ties_do_not_depend_on_the_way(spark, monkeypatch, limit):
    """The first column is not unique; both sides of the limit's switch give the same rows."""
    df = spark.range(400).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("v"), ((F.col("id") * 7) % 400).alias("z"))
    small = tf.sort_limit(df, "v", limit=limit).collect()
    monkeypatch.setattr(ranges, "SMALL_LIMIT", 0)
    assert tf.sort_limit(df, "v", limit=limit).collect() == small
    assert small == sorted(df.collect(), key=lambda r: (-r["v"], r["a"], r["z"]))[:limit]


def test_functions_of_a_list_choose_units_each(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["90 min", "90 Seasons", "5 min", "10 min", "9 min", None])], "i int, t string")
    df = df.withColumn("k", F.lit("a"))
    row = tf.group_agg(df, "k", "t", ["sum", "nunique", "min", "mean", "count"]).first()
    assert (row.sum_value, row.nunique_value, row.min_value, row.mean_value, row.count_value) == (204.0, 5, "10 min", 40.8, 5)
    assert tf.group_agg(df, "k", "t", ["nunique", "max"]).first().max_value == "90 min"
    with pytest.raises(ValueError, match="std of column"):
        tf.group_agg(df, "k", "t", ["sum", "std"])


def test_sums_of_large_numbers_do_not_overflow(spark):
    df = spark.range(4).select(F.lit("a").alias("k"), F.lit(2**62).alias("v"))
    assert tf.group_agg(df, "k", "v", "sum").first()["value"] == float(2**64)


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1, float("nan"), np.float32("nan").item()), (2, 1.0, 2.0)], "i int, d double, f float")
    rows = tf.nan_to_null(df).orderBy("i").collect()
    assert tuple(rows[0]) == (1, None, None) and tuple(rows[1]) == (2, 1.0, 2.0)


def test_sum_in_a_list_does_not_overflow_and_equals_the_single_form(spark):
    rows = spark.createDataFrame([("a", 2**62)] * 4 + [("b", -5), ("b", None)], "k string, v long")
    single = {r.key: r.value for r in tf.group_agg(rows, "k", "v", "sum").collect()}
    listed = {r.key: r.sum_value for r in tf.group_agg(rows, "k", "v", ["sum", "count"]).collect()}
    assert listed == single == {"a": float(2**64), "b": -5.0}
