"""Work is dealt out and taken in pieces, however the input lies in files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from archspark.functions.frames import substring_pairs
from archspark.operators import history as h
from archspark.operators import score as sc
from archspark.operators.extract import python_source
from archspark.queries import QUERIES


def test_facts_of_a_batch_come_in_pieces():
    batch = pd.DataFrame({"path": [f"m{i}.py" for i in range(250)], "text": [f"import a{i}\n" for i in range(250)]})
    pieces = list(python_source._read_batches(iter([batch])))
    assert max(map(len, pieces)) <= 100
    rows = pd.concat(pieces)
    assert rows["path"].tolist() == batch["path"].tolist()
    assert [m[0]["name"] for m in rows["modules"]] == [f"a{i}" for i in range(250)]


def test_scripts_of_one_file_are_dealt_out(spark, tmp_path):
    rows = [(i, i % 3) for i in range(40)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = QUERIES["extract_ddl_nested"](spark, str(tmp_path))
    assert made.count() == 11 * len(rows)
    scripts = made.select("table").rdd
    assert scripts.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # four kinds of rows


def test_lists_of_files_are_worked_out_once(spark, tmp_path):
    """The test of a list for rows, below the explode, would hold the whole extraction again."""
    spark.createDataFrame([(i, f"part {i}", 900.0 + i) for i in range(8, 16)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["extract_fields"](spark, str(tmp_path))
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.field for r in rows.collect() if r.path.endswith(".java")} == {"Gadget11.peer:Gadget35 private", "Gadget11.LIMIT:int private"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_dealt_out_before_they_are_counted(spark):
    """Else the tables of a task's pairs lie beside the commits that make them, and grow with the square of a commit."""
    rows = [("p", sha, path) for sha in range(6) for path in ("a", "b", "c")[: 2 + sha % 2]]
    pairs = h.co_change(spark.createDataFrame(rows, "project_id string, sha int, path string"), ["project_id"])
    assert "RepartitionByExpression [project_id" in plan_of(pairs)
    assert {tuple(r) for r in pairs.collect()} == {("p", "a", "b", 6), ("p", "a", "c", 3), ("p", "b", "c", 3)}


def test_signals_are_not_dealt_by_category(spark):
    rows = [(i, "security", f"s{n}", "high", -float(n), "fail") for i in range(3) for n in range(1, 15)]
    signals = spark.createDataFrame(rows, "project_id int, category string, signal string, severity string, impact double, status string")
    weights = spark.createDataFrame([("security", 0.5)], "category string, weight double")
    issues = sc.top_issues(signals, weights, ["project_id"])
    assert "strategy=broadcast" in plan_of(issues) and "RepartitionByExpression [project_id" in plan_of(issues)
    assert {(r.project_id, r["rank"], r.signal) for r in issues.collect()} == {(i, n, f"s{15 - n}") for i in range(3) for n in range(1, 13)}
    own = spark.createDataFrame([(1, "security", 0.5)], "project_id int, category string, weight double")  # as many rows as projects: not hinted
    assert "strategy=broadcast" not in plan_of(sc.top_issues(signals, own, ["project_id"]))


def test_names_are_not_shuffled_to_meet_few_needles(spark, tmp_path):
    names = spark.range(4000).select(F.lit("p").alias("project_id"), F.concat(F.lit("customer#"), F.col("id")).alias("name"))
    names.write.parquet(f"{tmp_path}/names")
    needles = spark.createDataFrame([("p", "er#77")], "project_id string, needle string")
    met = substring_pairs(needles, spark.read.parquet(f"{tmp_path}/names"), ["project_id"])
    assert any("rarest-grams" in f for f in met.inputFiles())  # so their true size is known
    assert met.count() == sum(str(i).startswith("77") for i in range(4000))
