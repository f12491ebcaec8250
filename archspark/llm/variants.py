"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Two words, the longer of M code points, are one edit apart if their common prefix and common suffix together reach M-1.
That test is made on dense tiles: padded code-point matrices of two blocks of words, aligned once at the first and once at the last code point.
Which blocks meet: the M places are cut into segments of two, and the edit lies in one of them, so both words have one key
(M, segment, code points before, code points after). A word has the keys of its own length and of one more; rows are
shuffled by key and sorted, and a block meets itself and the blocks in which its last key goes on. Keys only
choose the blocks; a tile compares whole words. Each pair counts only in the segment where its common prefix ends, so no pair
is found twice and none is missed.

A key's words agree but on two code points, so with an alphabet of a letters a group has at most a*a + a words, whatever the
table's size (90 letters: 8,190). Words longer than ``LONG`` code points are cut into LONG/2 wider segments, which keeps the
rows per word bounded; their groups are tiled in the same way.

Defined results: null texts have no words; a null id counts as an empty one; ties of the most frequent near word go to the smallest in
code-point order; an empty table gives no rows; repeated rows count each time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import raw_texts, slices, staged

TILE = 64
LONG = 1024
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 200_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
RUN_OF_LETTERS = "[a-zÀ-ÿ]+"


def _with_slip(word: str, prefix_crc: int, slip: int) -> str:
    """The word, less one code point if ``slip`` divides the checksum of id and word."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, slip: int | None = None
) -> DataFrame:
    """(word, n) of runs of letters, A-Z lower-cased, with ``min_length`` code points and ``min_count`` occurrences at least.

    ``slip`` plants misspellings: a run whose crc32 of ``<id>:<run>`` it divides loses the code point at crc32 % length.
    Tasks count before the shuffle, so a hot word is one row per task and ``HELD_WORDS`` distinct words.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    letters = re.compile(RUN_OF_LETTERS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, 64):
            for key, data in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                found = Counter(letters.findall(data.translate(_LOWER).decode("utf-8", "replace")))
                crc = zlib.crc32(f"{key}:".encode())
                for word, n in found.items():
                    if slip:
                        word = _with_slip(word, crc, slip)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    total = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= min_count)


def _width(longer: Column, long: int) -> Column:
    """Code points of a segment in words of this length."""
    return F.when(longer <= long, F.lit(2)).otherwise(F.ceil(longer / F.lit(long // 2)).cast("int"))


def keyed_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(key, longer, segment, word, n): a row per length and segment that a pair with this word may have."""
    sized = words.select("word", "n", F.char_length("word").alias("size_"))
    both = sized.withColumn("longer", F.explode(F.array(F.col("size_"), F.col("size_") + 1))).withColumn("width_", _width(F.col("longer"), long))
    cut = both.withColumn("segment", F.explode(F.sequence(F.lit(0), F.floor((F.col("longer") - 1) / F.col("width_")).cast("int"))))
    before = F.substring("word", F.lit(1), F.col("segment") * F.col("width_"))
    left = F.greatest(F.lit(0), F.col("longer") - (F.col("segment") + 1) * F.col("width_"))
    after = F.when(left > 0, F.substring("word", F.col("size_") - left + 1, left)).otherwise(F.lit(""))
    return cut.select(F.xxhash64("longer", "segment", before, after).alias("key"), "longer", "segment", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned at the first, code points aligned at the last, lengths; padded with zeros."""
    size = np.array([len(w) for w in words], np.int64)
    wide = int(size.max())
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    points = points.astype(np.uint8) if points.max() < 256 else points
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    head = np.zeros((len(words), wide), points.dtype)
    tail = np.zeros((len(words), wide), points.dtype)
    head[row, col] = points
    tail[row, np.repeat(size, size) - 1 - col] = points
    return head, tail, size


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair of rows the number of leading columns that agree."""
    differs = a[:, None, :] != b[None, :, :]
    return np.where(differs.any(axis=2), differs.argmax(axis=2), a.shape[1])


def near_pairs(
    key: np.ndarray, longer: np.ndarray, segment: np.ndarray, words: list[str], long: int = LONG
) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words one edit apart, among rows sorted by key; each pair once."""
    left, right = [], []
    for at in range(0, len(words), TILE):
        end = min(at + TILE, len(words))
        other = at
        while other < len(words) and (other == at or key[other] == key[end - 1]):
            upto = min(other + TILE, len(words))
            head, tail, size = _matrices(words[at:end] + (words[other:upto] if other != at else []))
            a, b = slice(0, end - at), slice(0 if other == at else end - at, None)
            least = np.minimum(size[a, None], size[None, b])
            most = np.maximum(size[a, None], size[None, b])
            prefix = np.minimum(_agreeing(head[a], head[b]), least)
            suffix = np.minimum(_agreeing(tail[a], tail[b]), least)
            width = np.where(most <= long, 2, -(-most // (long // 2)))
            here = (longer[at:end, None] == most) & (longer[None, other:upto] == most)
            place = np.minimum(prefix, most - 1) // width
            here &= (segment[at:end, None] == place) & (segment[None, other:upto] == place)
            hit = here & (prefix + suffix >= most - 1) & (prefix < most)
            if other == at:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            left.append(i + at)
            right.append(j + other)
            other += TILE
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, near, near_n) for every pair of words one edit apart, in both directions; ``words`` has distinct (word, n)."""
    rows = keyed_words(words, long)
    dealt = rows.repartition("key").sortWithinPartitions("key", "word", "longer")

    def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        together = np.zeros(len(key), bool)
        together[1:] = key[1:] == key[:-1]
        together[:-1] |= together[1:]
        kept = np.flatnonzero(together)  # a key of one word pairs with none
        if not len(kept):
            return
        table = table.take(pa.array(kept))
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        i, j = near_pairs(key[kept], table.column("longer").to_numpy(), table.column("segment").to_numpy(), word.to_pylist(), long)
        for a, b in ((i, j), (j, i)):
            for at in range(0, len(a), 65536):
                mine, its = pa.array(a[at : at + 65536]), pa.array(b[at : at + 65536])
                yield pa.RecordBatch.from_arrays([word.take(mine), word.take(its), n.take(its)], ["word", "near", "near_n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1].as_py()
            key = batch.column(0).to_numpy()
            start = int(np.searchsorted(key, last))  # the group that may go on in the next batch
            if start == 0:
                continue
            held[-1] = batch.slice(0, start)
            yield from tiles(pa.Table.from_batches(held))
            held = [batch.slice(start)]
        if held:
            yield from tiles(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def spelling_forms(words: DataFrame, factor: int = 2, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word if that has ``factor`` times its
    count at least; its root is the last of the chain of forms, itself without one. ``words`` has distinct (word, n).

    Counts at least double along a chain, so it has no cycle and under 63 steps; each round of joins doubles the steps taken.
    """
    if factor < 2:
        raise ValueError("a form has twice the count at least, or chains need not end")
    words = staged(words.select("word", "n"), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best_")
    near = near_words(words, long).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    wins = -F.col("best_.less") >= factor * F.col("n")
    formed = staged(
        words.join(near, "word", "left").select(
            "word",
            F.when(wins, F.col("best_.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(wins, -F.col("best_.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    steps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next_"))
        on = steps.join(ahead, "root", "left")
        moved = staged(on.select("word", F.coalesce("next_", "root").alias("root"), F.col("next_").isNotNull().alias("moved_")), "variant-roots")
        steps = moved.select("word", "root")
        if moved.filter("moved_").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
