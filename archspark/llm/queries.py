"""One query per operator over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm.common import shared_folder
from archspark.llm.decontamination import contaminate
from archspark.llm.licences import scan_licences, shipped
from archspark.llm.main_text import extract_main_text
from archspark.llm.mixing import mix_sources
from archspark.llm.mtree import top_inner_products
from archspark.llm.quality import quality_scores
from archspark.llm.runs import periodic_runs
from archspark.llm.simhash import near_duplicates
from archspark.llm.surrogates import replace_entities
from archspark.llm.tokens import token_corpus
from archspark.llm.toxicity import fit_toxicity, held_out
from archspark.llm.variants import spelling_forms, word_counts
from archspark.llm.warc import read_archives, write_archives
from archspark.queries.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """The vocabulary file; ARCHSPARK_TOKENIZER names another."""
    if named := os.environ.get("ARCHSPARK_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_keyed_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = os.environ.get("ARCHSPARK_PII_KEY", "key of this deployment")
    done = replace_entities(table(spark, sf_dir, "documents"), key)
    return done.select(F.col("id").alias("doc_id"), "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS lacks, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT lacks, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY lacks, src
), o AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY lacks, src) - 1) % 3]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS ratio FROM o
), v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS lev
  FROM l WINDOW b AS (ORDER BY ratio, lacks, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT lacks, src, source_size,
         least(lim, coalesce((SELECT max(lev) FROM v WHERE lev <= ratio) * weight, lim)) AS target
  FROM v
), e AS (
  SELECT d.doc_id, d.lacks, d.src, d.size, t.source_size, t.target,
         coalesce(CAST(CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * 16777216) END AS BIGINT), 0) AS expected,
         CAST('0x' || substr(md5('20240|' || CASE WHEN lacks THEN 'n' ELSE 's' END || '|' || src), 1, 6) AS BIGINT) AS off
  FROM sized d JOIN t USING (lacks, src)
), p AS (
  SELECT *, CAST(sum(expected) OVER (PARTITION BY lacks, src ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) + off AS upto FROM e
)
SELECT doc_id, size, source_size, target,
       CAST((upto // 16777216 - (upto - expected) // 16777216) * size AS BIGINT) AS taken,
       CAST(upto // 16777216 - (upto - expected) // 16777216 AS BIGINT) AS copies
FROM p
"""


@query("op2_systematic_mix", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


@query("op3_counterfactual_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op4_rans_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_corpus(table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_positional_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_splittable_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    records = read_archives(spark, folder, write_archives(pages, folder))
    return records.select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op7_licence_digests")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"), shipped(spark))
    return found.select(F.col("id").alias("doc_id"), "digest", "licence", F.array_join("notices", ",").alias("notices"))


TOP_SQL = """
WITH w AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([t[1] * t[2] FOR t IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM w q JOIN w c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op8_mtree_topk", TOP_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op9_vantage_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_weak_label_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_scores(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), F.col("pattern").alias("votes"), "posterior", "score", "keep")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the checksum of a tenth of the ids makes the text periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    sized = chosen.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    steps = sized.withColumn("p", p).withColumn("steps", F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1))
    tail = F.expr("transform(steps, i -> element_at(w, int(a + i % p + 1)))")
    made = F.concat_ws(" ", F.concat(F.expr("slice(w, 1, int(a))"), tail))
    return steps.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@query("op11_basic_factor_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_tails(table(spark, sf_dir, "documents")))
    lines = F.expr(r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_block_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op13_prefix_suffix_tiles")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents"), slip=97))
