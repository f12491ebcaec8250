"""Runs are replaced as a whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from archspark.sources.store import read_run, write_run

K = ["project_id", "run_id"]


def rows(spark, values):
    return spark.createDataFrame(values, "project_id string, run_id string, v long")


def read(spark, path, name, **key):
    return sorted((r.project_id, r.v) for r in read_run(spark, path, name, K, **key).collect())


def test_runs_are_replaced_together(spark, tmp_path):
    path = str(tmp_path)
    write_run({"a": rows(spark, [("p", "1", 1), ("007", "1", 2)]), "b": rows(spark, [("p", "1", 10), ("007", "1", 20)])}, path, K)
    write_run({"a": rows(spark, [("p", "1", 3), ("p", "1", 4)]), "b": rows(spark, []).limit(0)}, path, K)
    assert read(spark, path, "a") == [("007", 2), ("p", 3), ("p", 4)] and read(spark, path, "b") == [("007", 20)]
    assert read(spark, path, "a", project_id="p") == [("p", 3), ("p", 4)] and read(spark, path, "b", project_id="p") == []
    write_run({"b": rows(spark, [("p", "1", 30)])}, path, K)
    assert read(spark, path, "a", project_id="p") == [("p", 3), ("p", 4)] and read(spark, path, "b") == [("007", 20), ("p", 30)]


def test_a_write_that_breaks_off_leaves_the_old_run(spark, tmp_path):
    path = str(tmp_path)
    write_run({"a": rows(spark, [("p", "1", 1)]), "b": rows(spark, [("p", "1", 10)])}, path, K)
    broken = rows(spark, [("p", "1", 11)]).withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        write_run({"a": rows(spark, [("p", "1", 2)]), "b": broken}, path, K)
    assert read(spark, path, "a") == [("p", 1)] and read(spark, path, "b") == [("p", 10)]
    write_run({"a": rows(spark, [("p", "1", 3)]), "b": rows(spark, [("p", "1", 12)])}, path, K)
    assert read(spark, path, "a") == [("p", 3)] and read(spark, path, "b") == [("p", 12)]
