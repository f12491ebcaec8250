"""Graphs, runs and reports on storage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from archspark.operators.graph import edge_label, merge_edges, merge_nodes
from archspark.schema import EDGE_COLUMNS, EDGE_SCHEMA, KEYS, NODE_COLUMNS, NODE_SCHEMA


def _columns(ddl: str, keys: Sequence[str]) -> str:
    """The part of a table schema behind its keys."""
    return ddl.split(", ", len(keys))[-1]


def read_graph_json(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """One ``{meta, nodes, edges}`` document per run below key folders; merge rules apply on load."""
    node, edge = _columns(NODE_SCHEMA, KEYS), _columns(EDGE_SCHEMA, KEYS)
    attributes = node.split(", attr ", 1)
    fields = f"struct<{', '.join(_colon(c) for c in attributes[0].split(', '))}, attributes:{attributes[1]}>"
    links = f"struct<{', '.join(_colon(c) for c in edge.split(', ')[:-1])}, attributes:map<string,string>>"
    schema = ", ".join(f"{k} string" for k in keys)
    docs = spark.read.schema(f"nodes array<{fields}>, edges array<{links}>, {schema}").option("multiLine", True).json(path)
    nodes = docs.select(*keys, F.inline("nodes")).withColumnRenamed("attributes", "attr")
    nodes = nodes.withColumn("external", F.coalesce("external", F.lit(False))).select(*keys, *NODE_COLUMNS)
    edges = docs.select(*keys, F.inline("edges")).withColumnRenamed("attributes", "attr").withColumns({
        "weight": F.coalesce("weight", F.lit(1.0)), "label": F.coalesce(F.nullif("label", F.lit("")), edge_label(F.col("kind"))),
        "attr": F.coalesce("attr", F.create_map().cast("map<string,string>"))}).select(*keys, *EDGE_COLUMNS)
    return merge_nodes(nodes, keys=keys), merge_edges(edges, keys=keys)


def _colon(column: str) -> str:
    name, kind = column.split(" ", 1)
    return f"{name}:{kind}"


def write_table(df: DataFrame, path: str, keys: Sequence[str] = KEYS, fmt: str = "parquet") -> None:
    """Replace the partitions of the runs in the frame and keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Nodes and edges of runs, replaced together."""
    write_run({"nodes": nodes, "edges": edges}, path, keys)


def write_run(tables: dict[str, DataFrame], path: str, keys: Sequence[str] = KEYS) -> None:
    """Replace the given tables of all runs that have a row in any of them, together or not at all.

    Tables are written aside, each below its name in a folder of this commit; nothing that a reader sees is touched. The list of
    replaced (run, table) pairs is written last, as one small file, which makes the commit visible. A write that breaks off before leaves the
    runs as they were; its files are never read. Of several commits of a run the newest counts. A table without rows of a
    run replaces the older rows of that run by none.
    """
    if not tables:
        return
    spark, keys = next(iter(tables.values())).sparkSession, list(keys)
    commit, seq = uuid.uuid4().hex, time.time_ns()
    written = []
    for name, df in tables.items():
        folder = f"{path}/{name}/commit_={commit}"
        df.write.partitionBy(*keys).parquet(folder)
        written.append(spark.read.schema(df.schema).parquet(folder).select(*keys).distinct())
    runs = reduce(DataFrame.unionByName, written).distinct()
    names = F.explode(F.array(*[F.lit(n) for n in tables]))
    runs.select(*keys, names.alias("table_"), F.lit(seq).alias("seq_")).coalesce(1).write.parquet(f"{path}/commits/commit_={commit}")


def read_run(spark: SparkSession, path: str, name: str, keys: Sequence[str] = KEYS, **key: str) -> DataFrame:
    """One table of the stored runs as of their newest commits; given keys prune partitions."""
    keys = list(keys)
    pick = lambda df: reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), key.items(), df)
    commits = _read(spark, f"{path}/commits", {"commit_": StringType()})
    kinds = {k: commits.schema[k].dataType for k in keys} | {"commit_": StringType()}
    newest = pick(commits).filter(F.col("table_") == name).groupBy(*keys).agg(F.max_by("commit_", F.struct("seq_", "commit_")).alias("commit_"))
    df = pick(_read(spark, f"{path}/{name}", kinds))
    return df.join(newest, [*keys, "commit_"], "left_semi").drop("commit_")


def _read(spark: SparkSession, path: str, kinds: dict[str, DataType]) -> DataFrame:
    """A partitioned table; the types of these columns are given, as a folder name such as 007 would be read as a number."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])).parquet(path)


def write_issue_report(issues: DataFrame, path: str, fmt: str = "json") -> None:
    """Issues or recommendations, one row per item; CSV gets lists as JSON text."""
    flat = issues
    if fmt == "csv":
        nested = [f.name for f in issues.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        flat = issues.withColumns({c: F.to_json(c) for c in nested}) if nested else issues
    writer = flat.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
