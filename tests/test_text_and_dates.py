"""Column functions against plain Python and pandas on the same values."""

import re
import warnings

import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.functions.dates import DATE_FORMATS, best_format, parse_date
from tallyframe.functions.literals import equals_text
from tallyframe.functions.text import explode_list, first_number, is_float_text, is_number_with_unit, strip, text_form
from tallyframe.operators.filters import search

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
TEXTS = st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85  　,abzAé0İıſK", max_size=8), min_size=40, max_size=60)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(df, expression):
    rows = df.select("i", expression.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


@FEW
@given(TEXTS)
def test_strip(spark, values):
    assert column(texts(spark, values), strip(F.col("t"))) == [v.strip() for v in values]


@FEW
@given(TEXTS, st.sampled_from(["i", "s", "K", "ab", "é", "É", "a.b", r"\w", r"\s,", "ı", "A,"]))
def test_search(spark, values, pattern):
    found = column(texts(spark, values), search(F.col("t"), pattern))
    assert found == [bool(re.search(pattern, v, re.IGNORECASE)) for v in values]


@pytest.mark.parametrize(
    "pattern, text, matches",
    [
        ("CAFÉ", "café", True),
        ("u.s.", "U.S.", True),
        ("u.s.", "UKS", False),
        ("u.s.", "UKSA", True),
        ("THIS", "is this", True),
        ("this", "ıs thıſ", True),
        ("(?P<a>b)(?P=a)", "aBb", True),
        ("a.c", "a\rc", True),
        (r"a\sb", "a\x1cb", True),
        (r"a[\s,]b", "a\x1fb", True),
        (r"a[^\s]b", "a\x1cb", False),
        (r"a\Sb", "a\x1cb", False),
        ("a.c", "a\nc", False),
    ],
)
def test_search_cases(spark, pattern, text, matches):
    expected = bool(re.search(pattern, text, re.IGNORECASE))
    assert column(texts(spark, [text]), search(F.col("t"), pattern)) == [expected]
    assert expected == matches


def test_missing_never_matches(spark):
    df = texts(spark, ["a", None, "nan"])
    assert [r["i"] for r in tf.apply_filters(df, {"column": "t", "value": "a"}).collect()] == [0, 2]
    assert [r["i"] for r in tf.apply_filters(df, {"column": "t", "operator": "eq", "value": "nan"}).collect()] == [2]
    numbers = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "i int, d double")
    assert tf.apply_filters(numbers, {"column": "d", "value": "n"}).count() == 0
    assert tf.apply_filters(numbers, {"column": "d", "operator": "eq", "value": "nan"}).count() == 0


# Java 17 writes some doubles beyond 1e16 with more digits than they need.
FLOATS = st.builds(
    lambda m, e: float(f"{m}e{e}"), st.integers(-(10**15) + 1, 10**15 - 1), st.integers(-25, 0)
) | st.builds(lambda m, e: float(f"{m}e{e}"), st.integers(-1000, 1000), st.integers(-25, 12))


@FEW
@given(st.lists(FLOATS, min_size=40, max_size=60))
def test_text_of_doubles(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, d double")
    assert column(df, text_form(F.col("d"), df.schema["d"].dataType)) == [str(float(v)) for v in values]


def test_text_forms_agree(spark):
    """What a value is labelled with is what finds it again."""
    values = [1e7, 12345678.9, 0.00015, 1.5e22, 1e-05, 1e16, 9999999.5, 0.0, -2e7, float("inf"), 7.0, 0.001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d double")
    counted = tf.value_counts(df, "d", 100).collect()
    assert sorted(r["value"] for r in counted) == sorted(map(str, values))
    for v in values:
        assert tf.apply_filters(df, {"column": "d", "operator": "eq", "value": str(v)}).count() == 1
    assert tf.apply_filters(df, {"column": "d", "value": "678.9"}).count() == 1
    flags = spark.createDataFrame([(True,), (False,), (True,), (None,)], "b boolean")
    assert [tuple(r) for r in tf.value_counts(flags, "b").collect()] == [("True", 2), ("False", 1)]
    assert tf.apply_filters(flags, {"column": "b", "value": "^T"}).count() == 2


def test_first_number(spark):
    values = ["none", "-5 min", "1.5h", None, "a 12.5.7", "7.", ""]
    assert column(texts(spark, values), first_number(F.col("t"))) == [0.0, 5.0, 1.5, None, 12.5, 7.0, 0.0]


def test_list_items(spark):
    rows = explode_list(texts(spark, ["a, b,,", None, "\tc ,d "]), F.col("t"), "x").collect()
    assert sorted(r["x"] for r in rows) == ["", "", "a", "b", "c", "d"]


def test_number_with_unit(spark):
    values = ["90 min", "2 Seasons", "3.5kg", "90 min", "ORD1", "12", "1.x", " 5 min"]
    expected = [bool(re.match(r"^\d+(\.\d+)?\s*[a-zA-Z]+", v)) for v in values]
    assert column(texts(spark, values), is_number_with_unit(F.col("t"))) == expected


def test_float_text(spark):
    values = ["1", "1d", "1f", "nan", "inf", "-Infinity", " 3 ", "1e5", ".5", "5.", ".", "1_0", "0x10", "", "True", "1e"]
    expected = pd.to_numeric(pd.Series(values), errors="coerce").notna().tolist()
    assert column(texts(spark, values), is_float_text(F.col("t"))) == expected


DATE_COLUMNS = [
    ["2025-01-15", "2025-1-5", "2025-01-15 ", "2025-02-30", "x"],
    ["2025-01-15 10:00:00", "2025-01-15 1:00:00", "2025-01-15"],
    ["01/02/2020", "1/2/2020", "12/31/2021"],
    ["2020/01/02", "2020/1/2"],
    ["September 25, 2021", " August 4, 2017", "september 05, 2021", "2021-01-02"],
    ["Jan 5, 2020", "May 5, 2020", "jan 6, 2020"],
    ["May 5, 2020", "June 5, 2020", "July 5, 2020"],
    ["5 January 2020", "05 May 2020"],
    ["05-Jan-2020", "5-Jan-2020"],
    ["20200105", "20201301"],
    ["2020", "1999", "99"],
    ["2020-01", "2021-1"],
    ["Jan 2020", "May 2020", "Feb 2021"],
    ["January 2020", "March 2021"],
    ["5 Jan 2020", "6 Feb 2020"],
    ["01-02-2020", "12-31-2020"],
    ["13/02/2020", "14/02/2020", "01/02/2020"],
    ["2025-01-15T10:00:00", "2025-01-16T11:00:00"],
    ["2025-01-15 10:00", "2025-01-15 11:30"],
    ["2025-01-15 10:00:00.5", "2025-01-15 10:00:00.123456"],
    ["North", "12", "3.5", "x1"],
    ["15.01.2025", "16.01.2025"],
    ["2025.01.15", "2025.1.5"],
    ["2025/01/15 10:00:00", "2025/01/16 11:00:00"],
    ["01/15/2025 10:00", "12/31/2025 23:59"],
    ["01/15/2025 10:00:00", "12/31/2025 23:59:59"],
    ["01/15/2025 10:30:00 AM", "01/15/2025 01:30:00 PM"],
    ["Jan 5 2020", "Feb 6 2020"],
    ["January 5 2020", "March 6 2020"],
    ["01/15/20", "12/31/99"],
    ["Monday, January 5, 2020", "Monday, March 2, 2020"],
    ["2025-01-15T10:00", "2025-01-16T11:30"],
    ["2025-01-15 10:00:00.123456789", "2025-01-15 10:00:00.5"],
]

OFFSET_COLUMNS = [["2025-01-15T10:00:00.123Z", "2025-03-01T23:59:59.5Z"], ["2025-01-15 10:00:00+00:00", "2025-03-01 23:59:59+00:00"]]


@pytest.mark.parametrize("values", DATE_COLUMNS[-12:] + OFFSET_COLUMNS, ids=lambda v: v[0])
def test_every_form_is_filtered_and_profiled(spark, values):
    days = pd.to_datetime(pd.Series(values * 2))
    df = texts(spark, values * 2)
    condition = {"column": "t", "operator": "date_month_year", "value": {"month": int(days[0].month), "year": int(days[0].year)}}
    same = (days.dt.month == days[0].month) & (days.dt.year == days[0].year)
    assert tf.apply_filters(df, condition).count() == same.sum()
    assert ("t", "date_text") in {(r["column"], r["rule"]) for r in tf.profile(df).collect()}


@pytest.mark.parametrize("values", DATE_COLUMNS, ids=lambda v: v[0])
def test_dates_equal_pandas(spark, values):
    """On a column with one format the choice by majority is the same."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = pd.to_datetime(pd.Series(values), errors="coerce")
    df = texts(spark, values)
    chosen = best_format(df, F.col("t"))
    ours = column(df, parse_date(F.col("t"), chosen)) if chosen else [None] * len(values)
    assert ours == [None if pd.isna(p) else p.to_pydatetime() for p in parsed]


def test_offsets_keep_the_local_day(spark):
    df = texts(spark, ["2025-01-15T23:30:00-05:00", "2025-01-15T23:30:00Z", "2025-01-16T00:10:00+0900"])
    chosen = best_format(df, F.col("t"))
    days = column(df, parse_date(F.col("t"), chosen))
    assert [(d.month, d.day) for d in days] == [(1, 15), (1, 15), (1, 16)]


def test_majority_format_and_ties(spark):
    assert best_format(texts(spark, ["2020-01-02", "1/2/2020", "3/4/2020"]), F.col("t")) == "M/d/yyyy"
    assert best_format(texts(spark, ["2020-01-02", "1/2/2020"]), F.col("t")) == "yyyy-M-d"
    assert best_format(texts(spark, ["junk", None]), F.col("t")) is None
    assert len(set(DATE_FORMATS)) == len(DATE_FORMATS)


def test_any_format(spark):
    df = texts(spark, ["2020-01-02", "1/2/2020", "junk", "Jan 5, 2020", None])
    condition = {"column": "t", "operator": "date_year", "value": 2020}
    assert tf.apply_filters(df, condition).count() == 1
    assert tf.apply_filters(df, condition, formats="any").count() == 3
    assert tf.apply_filters(df, condition, formats=["MMM d, yyyy"]).count() == 1
    with pytest.raises(ValueError, match="no known form of date"):
        tf.apply_filters(texts(spark, ["junk"]), condition)
    assert tf.apply_filters(texts(spark, [None]), condition).count() == 0


@pytest.mark.parametrize("pattern", [r"(?P<a_b>x)x", r"^x{,2}$", "[[]", r"c\Z", "[a&&b]", "[]x]", r"(?P<q>x)(?P=q)", r"[\s{,2}]", r"x{2,}"])
def test_patterns_of_python(spark, pattern):
    values = ["xx", "x", "", "xxx", "[", "abc", "abc\n", "a", "&", "b", "]", "{", " ", "x x"]
    expected = [bool(re.search(pattern, v, re.IGNORECASE)) for v in values]
    assert column(texts(spark, values), search(F.col("t"), pattern)) == expected


def test_wrong_patterns_are_named(spark):
    with pytest.raises(ValueError, match="not a regular expression"):
        search(F.col("t"), "(")


def test_floats_are_found_by_their_labels(spark):
    df = spark.sql("select cast(v as float) v from values (1e7), (1e-5), (0.1), (12345678), (1e20), (3) as t(v)")
    for r in df.select(text_form(F.col("v"), df.schema["v"].dataType).alias("x")).collect():
        assert tf.apply_filters(df, {"column": "v", "operator": "eq", "value": r["x"]}).count() == 1, r["x"]


def test_format_is_chosen_after_earlier_conditions(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-02"), ("a", "2020-05-02"), ("a", "2020-06-02"), ("b", "1/2/2020")], "k string, t string"
    )
    conditions = [
        {"column": "k", "operator": "eq", "value": "b"},
        {"column": "t", "operator": "date_month", "value": "1"},
    ]
    assert tf.apply_filters(df, conditions).count() == 1


@pytest.mark.parametrize(
    "kind, stored, value, same",
    [
        ("bigint", "3", "03", False),
        ("bigint", "3", "3", True),
        ("bigint", "3", 3, True),
        ("bigint", "3", 3.0, False),
        ("int", "3", "99999999999", False),
        ("bigint", "0", "-0", False),
        ("double", "1.5", 1.5, True),
        ("double", "7", 7, False),
        ("double", "7", "7.0", True),
        ("double", "1e22", "1e+22", True),
        ("double", "1e22", "1e22", False),
        ("float", "0.1", "0.1", True),
        ("boolean", "true", "True", True),
        ("boolean", "true", True, True),
        ("boolean", "true", "true", False),
        ("decimal(10,2)", "1.5", "1.50", True),
        ("decimal(10,2)", "1.5", "1.5", False),
        ("date", "2020-01-02", "2020-01-02", True),
        ("date", "2020-01-02", "2020-1-2", False),
        ("timestamp_ntz", "2020-01-02", "2020-01-02 00:00:00", True),
        ("timestamp_ntz", "2020-01-02 00:00:00.5", "2020-01-02 00:00:00.5", True),
        ("timestamp_ntz", "2020-01-02", "junk", False),
        ("string", "a", "A", False),
        ("array<int>", None, "[1]", None),
    ],
)
def test_equal_text(spark, kind, stored, value, same):
    df = spark.createDataFrame([(0, stored)], "i int, t string").select("i", F.col("t").try_cast(kind).alias("v")) if (
        kind != "array<int>"
    ) else spark.createDataFrame([(0, None)], "i int, v array<int>")
    result = column(df, equals_text(F.col("v"), df.schema["v"].dataType, value))[0]
    assert result is same or (same is None and result is None)


@pytest.mark.parametrize(
    "condition, message",
    [
        ({"column": "t", "operator": "like", "value": "a"}, "unknown filter operator"),
        ({"column": "nope", "value": "a"}, "unknown column"),
        ({"column": "t"}, "needs column and value"),
        ({"column": "i", "operator": "date_year", "value": 2020}, "of type int"),
        ({"column": "t", "operator": "date_year", "value": "soon"}, "whole number"),
        ({"column": "t", "operator": "date_month_year", "value": 5}, "month and year"),
    ],
)
def test_wrong_conditions(spark, condition, message):
    with pytest.raises(ValueError, match=message):
        tf.apply_filters(texts(spark, ["a"]), condition)


def test_typed_dates(spark):
    df = spark.sql(
        "select id, cast(d as date) d, cast(d as timestamp) t, cast(d as timestamp_ntz) n from values "
        "(1, '1997-12-31 23:59:59'), (2, '1998-01-01 00:00:00'), (3, '1998-12-31 10:00:00'), (4, null) as v(id, d)"
    )
    for name in "dtn":
        year = {"column": name, "operator": "date_year", "value": "1998"}
        month = {"column": name, "operator": "date_month", "value": 12}
        both = {"column": name, "operator": "date_month_year", "value": {"month": 12, "year": 1998}}
        none = {"column": name, "operator": "date_month_year", "value": {"month": 13, "year": 1998}}
        assert sorted(r["id"] for r in tf.apply_filters(df, year).collect()) == [2, 3]
        assert sorted(r["id"] for r in tf.apply_filters(df, month).collect()) == [1, 3]
        assert sorted(r["id"] for r in tf.apply_filters(df, both).collect()) == [3]
        assert tf.apply_filters(df, none).count() == 0


def test_order_of_conditions_does_not_matter(spark):
    df = texts(spark, ["ab", "bc", "abc", None, "x"])
    a, b = {"column": "t", "value": "a"}, {"column": "t", "value": "c"}
    assert tf.apply_filters(df, [a, b]).collect() == tf.apply_filters(df, [b, a]).collect()
    assert tf.apply_filters(df, None).count() == tf.apply_filters(df, []).count() == 5


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`x.y` int, `t``u` string")
    assert tf.apply_filters(df, {"column": "x.y", "operator": "eq", "value": 1}).count() == 1
    assert tf.value_counts(df, "t`u").count() == 2
    assert tf.group_agg(df, "t`u", "x.y", "sum").count() == 2
    assert tf.sort_limit(df, "x.y").count() == 2
    assert tf.id_columns(df) == ["x.y", "t`u"]
