"""A typed copy of a CSV, found again without a job, and made anew when a file changes."""

from __future__ import annotations

import tallyframe as tf


def write(path, rows):
    with open(path, "w") as out:
        out.write("id,price,day\n" + "".join(f"{i},{i * 1.5},2024-01-0{1 + i % 9}\n" for i in range(rows)))


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_second_load_starts_no_job_and_a_changed_file_a_new_copy(spark, tmp_path):
    source, copies = tmp_path / "rows.csv", str(tmp_path / "copies")
    write(source, 50)
    first = tf.load_csv(spark, str(source), copies=copies)
    again, jobs = jobs_of(spark, "load-again", lambda: tf.load_csv(spark, str(source), copies=copies))
    assert jobs == []
    assert again.schema == first.schema and again.count() == 50
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tf.load_csv(spark, str(source)).collect()))
    write(source, 60)
    changed = tf.load_csv(spark, str(source), copies=copies)
    assert changed.count() == 60 and changed.inputFiles() != first.inputFiles()
