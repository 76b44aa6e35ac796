"""Structural rules at their thresholds, identifiers and the breakdown column."""

import pytest
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.operators import ids, metrics
from tallyframe.operators.rules import TEXT_RULES, missing_check, rule_check


def table(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def mixed(n, hits, hit, miss):
    return [hit] * hits + [miss] * (n - hits)


@pytest.mark.parametrize(
    "rule, values, holds",
    [
        ("comma_list", mixed(4, 4, "a,b", "a"), False),
        ("comma_list", mixed(5, 1, "a,b", "a"), False),
        ("comma_list", mixed(5, 2, "a,b", "a"), True),
        ("comma_list", mixed(5, 5, "a,b", "a") + [None] * 50, True),
        ("number_with_unit", mixed(4, 4, "90 min", "x"), False),
        ("number_with_unit", mixed(6, 3, "90 min", "x"), False),
        ("number_with_unit", mixed(6, 4, "3.5kg", "1.x"), True),
        ("date_text", mixed(2, 2, "2020-01-02", "x"), False),
        ("date_text", mixed(5, 3, "2020-01-02", "x"), False),
        ("date_text", mixed(5, 4, "2020-01-02", "x"), True),
        ("date_text", mixed(8, 4, "2020-01-02", "1/2/2020"), False),
        ("mixed_numeric", mixed(4, 2, "1", "x"), False),
        ("mixed_numeric", mixed(6, 3, "1", "x"), True),
        ("mixed_numeric", mixed(7, 3, "1", "x"), False),
        ("mixed_numeric", mixed(100, 99, "1", "x"), False),
        ("mixed_numeric", mixed(100, 98, "1", "x"), True),
        ("mixed_numeric", mixed(6, 6, "1", "x"), False),
        ("mixed_numeric", [], False),
    ],
)
def test_thresholds(spark, rule, values, holds):
    df = table(spark, values)
    assert df.agg(rule_check(df, "c", rule).alias("x")).first()["x"] is holds
    found = {r["rule"] for r in tf.profile(df).collect()}
    assert (rule in found) is holds


@pytest.mark.parametrize("missing, holds", [(2, False), (3, True), (0, False), (5, True)])
def test_missing_rate(spark, missing, holds):
    df = table(spark, [None] * missing + [1.0] * (5 - missing), "double")
    assert df.agg(missing_check(df, "c").alias("x")).first()["x"] is holds
    assert ("missing_rate" in {r["rule"] for r in tf.profile(df).collect()}) is holds


def test_nan_counts_as_missing(spark):
    df = table(spark, [float("nan")] * 3 + [1.0] * 2, "double")
    assert tf.profile(df).first()["metric"] == 0.6
    assert tf.describe(df).first()["n_missing"] == 3


def test_empty_table(spark):
    df = table(spark, [])
    assert tf.profile(df).count() == 0
    assert tf.id_columns(df) == []
    assert tf.describe(df).first()["n_rows"] == 0
    assert df.agg(missing_check(df, "c").alias("x")).first()["x"] is False
    assert tf.pick_breakdown_column(df) is None
    assert tf.breakdown(df).count() == 0


def test_rules_are_for_text_only(spark):
    df = table(spark, list(range(10)), "bigint")
    assert df.agg(*[rule_check(df, "c", r).alias(r) for r in TEXT_RULES]).first() == (False,) * len(TEXT_RULES)


@pytest.mark.parametrize(
    "values, is_id",
    [(["a"], False), (["a", "b"], True), (["a", "b", None], False), (["a", "b", "a"], False), ([], False)],
)
def test_ids(spark, values, is_id):
    assert tf.id_columns(table(spark, values)) == (["c"] if is_id else [])


def test_one_repeat_among_many(spark):
    numbers = spark.range(50_000).select(F.when(F.col("id") == 31_000, 7).otherwise(F.col("id")).alias("c"))
    texts = numbers.select(F.concat(F.lit("value "), "c").alias("c"))
    unique = spark.range(50_000).select(F.concat(F.lit("value "), "id").alias("c"))
    assert tf.id_columns(numbers) == []
    assert tf.id_columns(texts) == []
    assert tf.id_columns(unique) == ["c"]


def test_rows_that_only_share_a_hash(spark, monkeypatch):
    """With a useless hash the values themselves decide."""
    monkeypatch.setattr(ids, "SUSPECTS", 3)
    monkeypatch.setattr(ids.F, "xxhash64", lambda c: F.length(c).cast("bigint"))
    unique = table(spark, ["a", "b", "cc", "dd", "eee", "fff", "gggg", "hhhh"])
    assert not ids.has_repeated_value(unique, "c")
    repeated = table(spark, ["a", "b", "cc", "dd", "eee", "fff", "gggg", "gggg"])
    assert ids.has_repeated_value(repeated, "c")


def test_more_columns_than_one_pass(spark, monkeypatch):
    df = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(23)])
    expected = tf.id_columns(df), tf.pick_breakdown_column(df)
    assert expected == (["c19", "c20", "c21", "c22"], "c3")
    monkeypatch.setattr(metrics, "COLUMNS_PER_PASS", 4)
    assert (tf.id_columns(df), tf.pick_breakdown_column(df)) == expected


def test_columns_that_cannot_be_compared(spark):
    df = spark.sql("select id, map('a', id) m, array(id) l, struct(id) s from range(6)")
    assert tf.id_columns(df) == ["id", "l", "s"]
    assert tf.profile(df).count() == 3


def test_breakdown_prefers_four_classes(spark):
    df = spark.range(40).select(
        "id",
        F.lit("only").alias("one"),
        (F.col("id") % 9).alias("nine"),
        (F.col("id") % 3).cast("string").alias("three"),
        (F.col("id") % 5).alias("five"),
        (F.col("id") % 4).cast("string").alias("title"),
    )
    assert tf.pick_breakdown_column(df) == "three"
    assert tf.pick_breakdown_column(df, exclude=()) == "title"
    assert tf.pick_breakdown_column(df.select("id", "one", "nine")) == "nine"
    assert tf.pick_breakdown_column(df.select("id", "one")) is None


def test_breakdown_skips_ids_near_four(spark):
    df = spark.createDataFrame([(i, i // 2, 1) for i in range(4)], "a int, b int, c int")
    assert tf.id_columns(df) == ["a"]
    assert tf.pick_breakdown_column(df) == "b"


def test_breakdown_of_large_columns_is_exact(spark):
    df = spark.range(6000).select(
        (F.col("id") % 1000).alias("a"), (F.col("id") % 999).alias("b"), (F.col("id") % 1001).alias("c")
    )
    assert tf.pick_breakdown_column(df) == "b"
