"""Source trees: files below ``project_id=.../run_id=...`` as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions import paths as p
from archspark.functions.frames import top_k
from archspark.schema import KEYS



def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """UTF-8 text; bad bytes become U+FFFD."""
    return files.withColumn("text", F.make_valid_utf8(F.col(content).cast("string"))).drop(content)


def classify_files(files: DataFrame) -> DataFrame:
    """Add language, infra kind, module and top package; drop files of no known kind."""
    path = F.col("path")
    return p.with_language(files).withColumns(
        {"ext": p.extension(path), "module": p.module_of(path), "top_package": p.top_package(path)}
    )


def select_files(
    files: DataFrame, keys: Sequence[str] = KEYS, include: Sequence[str] = (), exclude: Sequence[str] = (),
    max_files: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Path and size rules of a scan; needs ``path`` and ``size``."""
    sized = files.filter(F.col("size") > 0)
    sized = sized if max_bytes is None else sized.filter(F.col("size") <= max_bytes)
    kept = p.exclude_paths(p.exclude_dirs(p.exclude_binary(sized)), exclude)
    kept = classify_files(p.include_paths(kept, include))
    return kept if max_files is None else top_k(kept, keys, [F.col("path")], max_files)


def read_source_tree(
    spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (),
    max_files: int | None = None, max_bytes: int | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Scan a tree of projects and runs into the ``files`` table.

    Paths and sizes are filtered in the scan, so the content is not shuffled. With ``max_files`` the list is
    chosen first, without content, and joined back to it.
    """
    marker = "".join(f"{k}=([^/]+)/" for k in keys)
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)

    def keyed(df: DataFrame) -> DataFrame:
        found = {k: F.regexp_extract("path", marker, i + 1) for i, k in enumerate(keys)}
        relative = F.regexp_extract("path", marker + "(.*)$", len(keys) + 1)
        return df.withColumns({"uri": F.col("path"), **found}).withColumn("path", F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))))

    bounded = base.load(root).filter(F.col("length") > 0)
    bounded = bounded if max_bytes is None else bounded.filter(F.col("length") <= max_bytes)
    if max_files is None:
        rows = keyed(bounded.select("path", F.col("length").alias("size"), "content"))
        return decode_text(select_files(rows, keys, include, exclude, None, max_bytes)).drop("uri")
    listed = keyed(bounded.select("path", F.col("length").alias("size")))
    chosen = select_files(listed, keys, include, exclude, max_files, max_bytes)
    content = bounded.select(F.col("path").alias("uri"), "content")
    return decode_text(chosen.join(content, "uri")).drop("uri")


def read_sql_scripts(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language") == "sql")


# Kinds of manifest and deployment files.
MANIFEST_KINDS = (
    "docker", "compose", "npm", "pip", "gomod", "cargo", "maven", "gradle", "helm", "serverless", "proc", "make",
)


def read_manifests(files: DataFrame) -> DataFrame:
    return files.filter(F.col("infra_kind").isin(*MANIFEST_KINDS) | (F.col("language") == "yaml"))
