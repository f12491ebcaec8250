"""Near copies by shingle overlap: MinHash bands find pairs, the Jaccard similarity of their word shingles decides them.

Rows with the same words are one point, named by its first row. A point has ``BANDS`` keys of ``ROWS`` minima each, so two points
of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8 and more above. In rounds, every point is
compared with the first point of each key it holds, which settles large groups in as many rows as they have members. What then
still shares a key mostly has a passage in common and is unlike, and of such points all would meet all. They meet over their
rarest shingles instead: two sets of similarity s or more share one of the first few of each, in any fixed order. A point that is like an earlier one falls away, so a chain of near copies may leave
with its ends unlike, and no two points that stay were found alike.

Defined results: null and empty texts have the same (no) words and are one point; a text of fewer words than a shingle is one
shingle; rows of one point are one group whatever their ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import raw_texts, slices, space_words, staged

SEED = 42
BANDS, ROWS = 20, 5
ROUNDS = 2
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles."""
    import xxhash

    words = space_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    text, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64, n - width + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """One key per band, of the minima of its hash functions."""
    import xxhash

    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * _ODD + _ADD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, mixed.min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _signatures(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = raw_texts(part.column(1))
            words = [hashlib.md5(b" ".join(space_words(t))).digest() for t in texts]
            keys = [bands(shingles(t, width)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rank", "words", "keys"])

    kind = rows.schema["rank"].dataType.simpleString()
    return rows.select("rank", "text").mapInArrow(run, f"rank {kind}, words binary, keys array<bigint>")


def alike(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The distinct pairs (first, later) of points whose texts are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None  # rows of one first point mostly lie together
        for part in slices(batches):
            found = []
            for first, a, b in zip(part.column(0).to_pylist(), raw_texts(part.column(2)), raw_texts(part.column(3))):
                if first != last:
                    last, known = first, shingles(a, width)
                found.append(jaccard(known, shingles(b, width)) >= least)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["first", "later"]).filter(pa.array(found, pa.bool_()))

    one = texts.select(F.col("point").alias("first"), F.col("text").alias("first_text"))
    two = texts.select(F.col("point").alias("later"), F.col("text").alias("later_text"))
    both = pairs.join(two, "later").join(one, "first").select("first", "later", "first_text", "later_text")
    return both.mapInArrow(run, "first bigint, later bigint")


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, width).view(np.int64) for t in raw_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["point", "shingles"])

    return texts.select("point", "text").mapInArrow(run, "point bigint, shingles array<bigint>")


def _close_pairs(ranks: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Distinct pairs (first, later) by rank, among them all of similarity ``least`` or more.

    Shingles are ordered by the points that hold them, rarest first. If x is the smaller of two sets (or as large), they are alike only
    if ``least/(1+least)`` of both sizes together are shared, so they share a shingle at places of both that leave room for that many.
    """
    sets = staged(_shingled(texts, width), "overlap-shingles")
    held = sets.select("point", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = held.groupBy("shingle").count().filter("count > 1")
    room = lambda part: F.col("size") - F.ceil(F.lit(part) * F.col("size") - 1e-6) + 1  # noqa: E731  places in which a first shared shingle may lie
    # those of one point alone come first and meet nothing
    own = held.join(shared, "shingle").groupBy("point", "size").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("own"))
    own = own.withColumn("alone", F.col("size") - F.size("own")).withColumn("places", F.greatest(room(least) - F.col("alone"), F.lit(0)).cast("int"))
    firsts = own.select("point", "size", "alone", F.posexplode(F.slice("own", F.lit(1), F.col("places"))).alias("at", "s"))
    firsts = firsts.withColumn("after", F.col("size") - F.col("alone") - F.col("at") - 1)  # shingles behind this one
    firsts = staged(firsts.join(ranks, "point").select("point", "rank", "size", "after", F.col("s.shingle").alias("shingle"), room(2 * least / (1 + least)).alias("near")), "overlap-firsts")
    x = firsts.filter(F.col("size") - F.col("after") <= F.col("near")).alias("x")
    y = firsts.alias("y")
    smaller = F.struct("x.size", "x.rank") < F.struct("y.size", "y.rank")
    enough = F.lit(least / (1 + least)) * (F.col("x.size") + F.col("y.size")) - 1e-6
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & smaller & (F.least("x.after", "y.after") + 1 >= enough))
    in_order = F.col("x.rank") < F.col("y.rank")
    first, later = F.when(in_order, F.col("x.point")).otherwise(F.col("y.point")), F.when(in_order, F.col("y.point")).otherwise(F.col("x.point"))
    return met.select(first.alias("first"), later.alias("later")).distinct()


def without_near_copies(rows: DataFrame, row_col: str, rank_cols: list[str], text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The ``row_col`` (a long, distinct) of the rows that stay: of like rows the first by ``rank_cols``."""
    rank = F.struct(*[F.col(c) for c in rank_cols], F.col(row_col).alias("row_")).alias("rank")
    rows = rows.select(rank, F.col(text_col).alias("text"))
    signed = staged(_signatures(rows, width), "overlap-keys")
    points = staged(signed.groupBy("words").agg(F.min("rank").alias("rank"), F.first("keys").alias("keys")), "overlap-points")
    entries = points.select(F.explode("keys").alias("key"), "rank")
    entries = staged(entries.join(entries.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"), "overlap-entries")
    held = entries.select(F.col("rank.row_").alias("point")).distinct()
    texts = rows.select(F.col("rank.row_").alias("point"), "text").join(held, "point", "left_semi")
    texts = staged(texts, "overlap-texts")
    gone = None
    for _ in range(ROUNDS):
        heads = entries.groupBy("key").agg(F.min("rank").alias("head"))
        placed = entries.join(heads, "key").withColumn("is_head", F.col("rank.row_") == F.col("head.row_"))
        placed = staged(placed, "overlap-placed")
        pairs = placed.filter("not is_head").select(F.col("head.row_").alias("first"), F.col("rank.row_").alias("later")).distinct()
        fell = staged(alike(pairs, texts, width, least).select(F.col("later").alias("point")).distinct(), "overlap-fell")
        gone = fell if gone is None else gone.unionAll(fell)
        left = placed.filter("not is_head").select("key", "rank")
        entries = staged(left.join(fell, F.col("rank.row_") == F.col("point"), "left_anti"), "overlap-entries")
    left = entries.join(entries.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")
    left = left.select(F.col("rank.row_").alias("point"), "rank").distinct()
    pairs = _close_pairs(left, texts.join(left.select("point"), "point", "left_semi"), width, least)
    gone = gone.unionAll(alike(pairs, texts, width, least).select(F.col("later").alias("point")))
    stay = points.select(F.col("rank.row_").alias("point")).join(gone.distinct(), "point", "left_anti")
    return stay.select(F.col("point").alias(row_col))
