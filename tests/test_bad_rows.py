"""The side table of a CSV's bad rows: file, text and reason, for three kinds of fault."""

from __future__ import annotations

import tallyframe as tf


def test_three_kinds_of_bad_rows(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name,price\n1,one,1.5\n2,two,2.5,surplus\n3,three\n")
    (folder / "b.csv").write_text('id,name,price\n4,four,4.5,\n5,"five, quoted",x\n6,six,6.5\n')
    plain = {(r.file.rsplit("/", 1)[-1], r.row, r.reason) for r in tf.bad_rows(spark, str(folder)).collect()}
    assert plain == {
        ("a.csv", "2,two,2.5,surplus", "more values than the header"),
        ("b.csv", "4,four,4.5,", "more values than the header"),
    }
    typed = {(r.file.rsplit("/", 1)[-1], r.row, r.reason) for r in tf.bad_rows(spark, str(folder), "id int, name string, price double").collect()}
    assert typed == plain | {("b.csv", '5,"five, quoted",x', "a value does not fit the schema")}
    # load_csv refuses the same files; with on_bad="null" they load, short rows padded.
    assert tf.load_csv(spark, str(folder), on_bad="null").count() == 6
