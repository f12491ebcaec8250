"""Commit logs: records split by 0x1E, fields by 0x1F, written one file per project run.

Files live under ``project_id=.../run_id=...`` so the keys come from partition discovery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions.text import LINE_BREAK
from archspark.schema import KEYS

RECORD, FIELD = "\x1e", "\x1f"


def _read_records(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    raw = spark.read.option("lineSep", RECORD).text(path)
    # a split is read in order by one task, so (block, row id) is the order inside the file
    seq = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select(*keys, F.regexp_replace("value", r"^\n+|\n+$", "").alias("record"), seq.alias("seq"))


def _epoch(raw: Column) -> Column:
    return F.timestamp_seconds(F.coalesce(raw.try_cast("bigint"), F.lit(0)))


def parse_commit_log(records: DataFrame, keys=KEYS) -> DataFrame:
    """``record`` text to commits: sha, author, email, ts, subject (200 characters), files.

    Records with fewer than five header fields are dropped.
    """
    lines = F.split("record", LINE_BREAK)
    parts = F.split(F.get(lines, F.lit(0)), FIELD)
    files = F.filter(
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.trim), lambda x: x != ""
    )
    return records.filter((F.col("record") != "") & (F.size(parts) >= 5)).select(
        *keys,
        *[c for c in ("seq",) if c in records.columns],
        F.get(parts, F.lit(0)).alias("sha"),
        F.get(parts, F.lit(1)).alias("author"),
        F.get(parts, F.lit(2)).alias("email"),
        _epoch(F.get(parts, F.lit(3))).alias("ts"),
        F.substring(F.get(parts, F.lit(4)), 1, 200).alias("subject"),
        files.alias("files"),
    )


def parse_commit_dag(records: DataFrame, keys=KEYS) -> DataFrame:
    """``record`` text to the commit graph: parents, decoration and subject; merges are kept."""
    parts = F.split("record", FIELD)
    return records.filter((F.col("record") != "") & (F.size(parts) >= 7)).select(
        *keys,
        *[c for c in ("seq",) if c in records.columns],
        F.get(parts, F.lit(0)).alias("sha"),
        F.filter(F.split(F.get(parts, F.lit(1)), r"\s+"), lambda x: x != "").alias("parents"),
        F.get(parts, F.lit(2)).alias("author"),
        F.get(parts, F.lit(3)).alias("email"),
        _epoch(F.get(parts, F.lit(4))).alias("ts"),
        F.get(parts, F.lit(5)).alias("decoration"),
        F.substring(F.get(parts, F.lit(6)), 1, 200).alias("subject"),
    )


def read_commit_log(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    return parse_commit_log(_read_records(spark, path, keys), keys)


def read_commit_dag(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    return parse_commit_dag(_read_records(spark, path, keys), keys)
