"""Mix sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Expected copies are prefix-summed
within the source, one random offset is added, and a document is emitted once for each integer boundary
that its interval crosses. Documents run from long to short, so that those that share a boundary are of
like size and the words taken stay within about one long document of the target.

The prefix sum is distributed: rows are range-partitioned by source, size and id, each partition sums its
own rows, and only the sums per partition and source are summed again. Expected copies are whole numbers
of 2**-24, so the sums don't depend on the partitioning and reruns agree.

Defined results: null or empty text has size 0 and takes 0 words; a null source is a source of its own,
last in order; rows that repeat an id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.llm.common import staged

UNIT = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Column, max_repeat: float = 3.0) -> DataFrame:
    """Targets per source from (no_source, source, source_size); one row per source.

    ``weights`` may use ``ordinal``, the position of the source from 0. All words are shared by weight,
    a target stops at ``max_repeat`` times its source, and the excess is shared again by weight. At the
    end targets are ``min(limit, level * weight)``: sources reach their limit in the order of limit per weight,
    so the level follows from running sums in that order.
    """
    order = Window.orderBy("no_source", "source")
    by_limit = Window.orderBy("_ratio", "no_source", "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("weight", weights.cast("double"))
    t = t.withColumn("_limit", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("_ratio", F.try_divide("_limit", "weight"))
    t = (
        t.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.try_divide("_left", "_weights"))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    t = t.withColumn("target", F.least(F.col("_limit"), F.coalesce(level * F.col("weight"), F.col("_limit"))))
    return t.select("no_source", "source", "ordinal", "weight", "source_size", "target")


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the expected copies per source within one sorted partition."""
    last: tuple | None = None
    carry = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lacks, source, expected = (batch.column(batch.schema.get_field_index(c)) for c in ("no_source", "source", "expected"))
        new = np.ones(n, bool)
        new[0] = last != (source[0].as_py(), lacks[0].as_py())
        if n > 1:
            new[1:] = pc.or_(pc.not_equal(source[1:], source[:-1]), pc.not_equal(lacks[1:], lacks[:-1])).to_numpy(zero_copy_only=False)
        sums = np.cumsum(expected.to_numpy())
        at = np.flatnonzero(new)
        base = np.zeros(n, np.int64)
        base[at] = np.diff(np.concatenate(([0], np.where(at > 0, sums[at - 1], 0))))
        sums = sums - np.cumsum(base)
        sums[: at[0] if len(at) else n] += carry
        last, carry = (source[n - 1].as_py(), lacks[n - 1].as_py()), int(sums[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "within"])


def systematic_sample(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``copies`` to rows of (id, no_source, source, size, expected): boundaries that each row's interval crosses."""
    parts = (
        rows.repartitionByRange("no_source", "source", F.col("size").desc(), "id")
        .sortWithinPartitions("no_source", "source", F.col("size").desc(), "id")
        .withColumn("part", F.spark_partition_id())
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", within bigint"
    local = staged(parts.mapInArrow(_running, schema), "mix-within")
    ends = local.groupBy("part", "no_source", "source").agg(F.sum("expected").alias("_sum"))
    earlier = Window.partitionBy("no_source", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    offset = random_offset(seed)
    upper = F.col("_before") + F.col("within") + offset
    return (
        local.join(ends, ["part", "no_source", "source"])
        .withColumn("copies", F.shiftright(upper, 24) - F.shiftright(upper - F.col("expected"), 24))
        .drop("part", "within", "_before")
    )


def random_offset(seed: int) -> Column:
    """One offset per source in units of 2**-24: the first six hex digits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), F.when(F.col("no_source"), "n").otherwise("s"), F.col("source"))
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_repeat: float = 3.0,
    seed: int = 20240,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (words, repeats counted).

    Sources in code-point order, null last, weigh the values of ``cycle`` in turn.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    sizes = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    weights = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), F.col("ordinal") % len(cycle) + 1)
    targets = source_targets(sizes, weights, max_repeat)
    expected = F.round(F.try_divide("target", "source_size") * UNIT).cast("long")
    rows = sized.join(targets, ["no_source", "source"]).withColumn("expected", F.coalesce(expected, F.lit(0)))
    rows = rows.select("id", "no_source", "source", "size", "source_size", "target", "expected")
    return systematic_sample(rows, seed).select(
        "id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
