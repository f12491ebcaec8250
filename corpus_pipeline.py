"""Training-data pipeline over ``documents``: toxicity, near-duplicates, benchmark passages, mixture, token files.

Each stage reads what its predecessor wrote and returns the columns of its input, but for the last, which returns
what it reads back from the token files. Stages decide by row: rows that repeat an id or lack one stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm.common import shared_folder, staged
from archspark.llm.decontamination import contaminate
from archspark.llm.mixing import mix_sources
from archspark.llm.overlap import alike, without_near_copies
from archspark.llm.queries import tokenizer_path
from archspark.llm.simhash import near_duplicates
from archspark.llm.tokens import token_corpus
from archspark.llm.toxicity import fit_toxicity
from archspark.queries.registry import table

#: SQL can't express a fitted classifier or a tokenizer.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> DataFrame:
    """Written with a number per row, ``row_``, by which decisions are joined back."""
    return staged(docs.withColumn("row_", F.monotonically_increasing_id()), "pipeline-rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a score under 0.5; the classifier learns from all labels."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.column(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of near copies (5-word shingles, Jaccard 0.8 or more) one row, that of smallest id; ids may repeat or lack.

    Fingerprints in vantage-point shards link rows first: a row goes if it is like the first of its component. Copies of that similarity may
    differ in more bits than the fingerprints' radius, so what stays is compared by shingles.
    """
    order = ["no_id", "doc_id", "hash_"]
    rows = numbered(docs).withColumns({"no_id": F.col("doc_id").isNull(), "hash_": F.xxhash64("text")})
    linked = near_duplicates(rows.withColumn("key_", F.struct(*order, "row_")), id_col="key_", width=5)
    linked = linked.select(F.col("component_id.row_").alias("first"), F.col("id.row_").alias("later")).filter("first <> later")
    texts = rows.select(F.col("row_").alias("point"), "text")
    fell = staged(alike(linked, texts, 5, 0.8).select(F.col("later").alias("row_")), "pipeline-copies")
    rows = rows.join(fell, "row_", "left_anti")
    stay = without_near_copies(rows, "row_", order)
    return rows.join(stay, "row_", "left_semi").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a window of a benchmark item; equal texts are decided alike, so no numbered copy of the rows is written."""
    rows = docs.withColumn("key_", F.unhex(F.md5("text")))
    found = contaminate(rows, table(spark, sf_dir, "benchmark"), id_col="key_")
    return rows.join(found.filter("n_hit > 0").select(F.col("id").alias("key_")), "key_", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mixture takes it."""
    rows = numbered(docs)
    key = F.struct("doc_id", F.xxhash64("text").alias("hash_"), "row_")
    copies = mix_sources(rows.withColumn("key_", key), id_col="key_").filter("copies > 0").select(F.col("id.row_").alias("row_"), "copies")
    taken = rows.join(copies, "row_").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; per document its place and checksum as read back."""
    read = token_corpus(docs, tokenizer_path(), folder=shared_folder(spark, "corpus-tokens"))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
