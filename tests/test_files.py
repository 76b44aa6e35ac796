"""Delimited text in and out."""

import io
import json

import pandas as pd
import pytest

import tallyframe as tf
from tallyframe.sources.files import MISSING_TOKENS


def load(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return tf.load_csv(spark, str(path), **options)


KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "uint64": "decimal(20,0)"}


@pytest.mark.parametrize(
    "cells",
    [
        ["1", "-2", "+3"],
        [" 12 ", "3"],
        ["1.5", "2"],
        ["1e5", ".5", "5."],
        ["inf", "1"],
        ["TRUE", "false", "tRue"],
        ["a", "1"],
        ["1_0", "1"],
        ["0x10", "1"],
        ["2025-01-15", "2025-01-16"],
        ["12345678901234567890", "1"],
        ["123456789012345678901234", "1"],
        ["9223372036854775807", "1"],
        ["NA", "n/a"],
        ["true", "1"],
        ["1d", "2"],
    ],
    ids=lambda c: c[0],
)
def test_types_equal_pandas(spark, tmp_path, cells):
    text = "a,b\n" + "".join(f"{c},x\n" for c in cells)
    frame = pd.read_csv(io.StringIO(text))
    table = load(spark, tmp_path, text)
    assert table.schema["a"].dataType.simpleString() == KINDS[str(frame["a"].dtype)]
    got = sorted(str(r["a"]) for r in table.collect())
    assert got == sorted("None" if pd.isna(v) else str(v) for v in frame["a"])


def test_missing_integers_stay_integers(spark, tmp_path):
    table = load(spark, tmp_path, "a,b\n1,x\nNA,y\n")
    assert table.dtypes[0] == ("a", "bigint")
    assert tf.apply_filters(table, {"column": "a", "operator": "eq", "value": 1}).count() == 1


def test_every_missing_token(spark, tmp_path):
    text = "a,b\n" + "".join(f'"{t}",x\n' for t in MISSING_TOKENS) + "Null,x\n"
    assert pd.read_csv(io.StringIO(text))["a"].isna().sum() == len(MISSING_TOKENS) == 19
    table = load(spark, tmp_path, text)
    assert table.where("a is null").count() == 19
    assert [r["a"] for r in table.where("a is not null").collect()] == ["Null"]


def test_quotes_and_blank_lines(spark, tmp_path):
    table = load(spark, tmp_path, 'a,b\n"say ""hi"", x",1\n\n  ,2\n')
    assert sorted((r["a"], r["b"]) for r in table.collect()) == [("  ", 2), ('say "hi", x', 1)]


def test_line_breaks_in_quotes(spark, tmp_path):
    table = load(spark, tmp_path, 'a,b\n"one\ntwo",1\n', multi_line=True)
    assert [tuple(r) for r in table.collect()] == [("one\ntwo", 1)]


def test_given_schema(spark, tmp_path):
    table = load(spark, tmp_path, "a,b\n1,x\nNA,y\nz,w\n", schema="a int, b string", on_bad="null")
    assert table.dtypes == [("a", "int"), ("b", "string")]
    assert sorted(str(r["a"]) for r in table.collect()) == ["1", "None", "None"]
    with pytest.raises(ValueError, match="header"):
        load(spark, tmp_path, "a,b\n1,x\n", schema="a int, c string")


def test_header_only(spark, tmp_path):
    table = load(spark, tmp_path, "a,b\n")
    assert table.dtypes == [("a", "double"), ("b", "double")] and table.count() == 0


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', None), (2, "a,b", 1.5)], "i int, t string, d double")
    path = str(tmp_path / "out")
    tf.write_csv(df.coalesce(1), path)
    lines = sorted(p for f in (tmp_path / "out").glob("part-*") for p in f.read_text().splitlines())
    assert lines == ['"1","say ""hi""",""', '"2","a,b","1.5"', '"i","t","d"']
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tf.write_csv(df, path)


def test_json_out(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, t string")
    tf.write_json(df, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["i"]) == [{"i": 1, "t": None}, {"i": 2, "t": "b"}]


def test_parquet_in(spark):
    assert tf.load_parquet(spark, "/root/testdata/sf0.001/region.parquet").count() == 5


def test_nothing_is_lost_without_a_word(spark, tmp_path):
    ragged = "a,b\n1,2\n3,4,5\n6\n"
    with pytest.raises(ValueError, match="1 rows .* more values"):
        load(spark, tmp_path, ragged)
    kept = load(spark, tmp_path, ragged, on_bad="null")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, 2), (3, 4), (6, None)]
    with pytest.raises(Exception, match="more values"):
        load(spark, tmp_path, ragged, schema="a int, b int").select("b").collect()
    with pytest.raises(Exception, match="is not int: z"):
        load(spark, tmp_path, "a,b\n1,2\nz,3\n", schema="a int, b int").collect()
    with pytest.raises(ValueError, match="on_bad"):
        load(spark, tmp_path, ragged, on_bad="drop")


@pytest.mark.parametrize("row", ["1,2,,9", "1,2,", "1,2,,", ",,,", "1,,,,,9", '"1,5",2,,9', '1,"x ""y"", z",', '1,2,NA,9', '1,2,""'])
def test_empty_values_beyond_the_header_are_noticed(spark, tmp_path, row):
    text = f'a,b\n1,2\n3\n"4,4"\n"5,5,5","6 ""x"", y"\n{row}\n7,\n'
    for lines in (False, True):
        with pytest.raises(ValueError, match="1 rows .* more values"):
            load(spark, tmp_path, text, multi_line=lines)
        for build in (lambda t: t.collect(), lambda t: t.select("b").collect(), lambda t: t.count()):
            with pytest.raises(Exception, match="more values"):
                build(load(spark, tmp_path, text, schema="a string, b string", multi_line=lines))
    assert load(spark, tmp_path, text, on_bad="null").count() == 6


def test_short_rows_are_not_too_long(spark, tmp_path):
    text = 'a,b,c\n1\n"2,2"\n3,\n"4 ""x"", y",5\n,\n6,7,\n8,9,z\n'
    want = [("1", None, None), ("2,2", None, None), ("3", None, None), ('4 "x", y', 5, None), (None, None, None), ("6", 7, None), ("8", 9, "z")]
    for options in ({}, {"schema": "a string, b bigint, c string"}, {"multi_line": True}):
        table = load(spark, tmp_path, text, **options)
        assert sorted(map(tuple, table.collect()), key=str) == sorted(want, key=str) and table.count() == 7
    table = load(spark, tmp_path, 'a,b,c\n"1\n,2",x\n3,"4\n\n,",5\n', multi_line=True)
    assert sorted(map(tuple, table.collect()), key=str) == [("1\n,2", "x", None), ("3", "4\n\n,", 5)]
    with pytest.raises(ValueError, match="1 rows .* more values"):
        load(spark, tmp_path, 'a,b\n"1\n,2",x\n3,"4\n\n,",\n', multi_line=True)
