"""What the operators share: written stages in the shared folder, word splitting, executor-side files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from archspark.session import ensure_checkpoint_dir

#: Words of the overlap contract: A-Z lower-cased, every other ASCII byte but digits and letters ends a word.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def alnum_words(data: bytes) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(_ALNUM).split()


def space_words(data: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return data.lower().split()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors both reach."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    base = re.sub(r"^file:/*", "file:///", base) if base.startswith("file:") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage is cut and survives lost executors.

    Parquet looks at its sizes after 100 rows at the earliest, and a task holds a whole row group: tables of rows that take
    megabytes bound their groups by ``group_rows``, and have no dictionaries, which would be begun anew in each group.
    """
    path = shared_folder(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows).option("parquet.enable.dictionary", "false")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """(file system, path in it) on driver or executor, for the binary files of the operators."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of the Arrow batches, so that Python objects of few texts live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
