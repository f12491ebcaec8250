"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least ``power`` periods and ``shortest`` words long, that
neither neighbour extends with the same period. The basic factors of a text are its stretches of 1, 2, 4, ... words;
each is named by the names of its two halves, so equal names are equal words. Per length L, an occurrence and its successor that start
at most L apart lie within 2L words, where occurrences of one factor form arithmetic progressions: their difference is
a period. Occurrences at neighbouring places with the same difference join into the maximal stretch of that period, and of stretches that
cover the same words the smallest period stays. Periods in (L/2, L] are taken from length L, so each run is
proposed once, and any run of three periods holds such occurrences. A factor that occurs once is dropped: none that holds it repeats.

Each document is examined whole in one row of a map over the table; several short documents share the arrays of one pass,
of ``PASS_WORDS`` words or one longer document. No rows are shuffled.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; repeated rows, repeated ids and null
ids are kept and judged row by row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import raw_texts, slices

#: Words examined together; a longer document is examined alone.
PASS_WORDS = 400_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _by_name(key: np.ndarray, pos: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions sorted by both; one sort of packed numbers where they fit 63 bits."""
    bits = max(size - 1, 1).bit_length()
    if len(key) and int(key.max()) < 1 << (63 - bits):
        packed = np.sort(key << bits | pos)
        return packed >> bits, packed & ((1 << bits) - 1)
    order = np.lexsort((pos, key))
    return key[order], pos[order]


def runs_of(names: np.ndarray, end: np.ndarray, shortest: int = 24, power: int = 3) -> np.ndarray:
    """(start, length, period) of all runs, sorted by start and period.

    ``names`` has one number per word, equal for equal words; ``end`` tells per word where its document ends.
    """
    size, found = len(names), []
    pos, key, length = np.arange(size), names, 1
    name = np.full(size, -1, np.int64)
    while len(pos):
        key, pos = _by_name(key, pos, size)
        same = (key[1:] == key[:-1]) & (end[pos[1:]] == end[pos[:-1]])
        gap = pos[1:] - pos[:-1]
        near = same & (gap <= length) & (2 * gap > length)
        if near.any():
            found.append(_stretches(pos[:-1][near], gap[near], length, shortest, power))
        name[:] = -1
        twice = np.zeros(len(pos), bool)
        twice[:-1] |= same
        twice[1:] |= same
        name[pos[twice]] = np.concatenate(([0], np.cumsum(~same)))[twice]
        pos = np.sort(pos[twice])
        pos = pos[pos + 2 * length <= end[pos]]
        pos = pos[name[pos + length] >= 0]
        key = name[pos] * (int(name.max(initial=0)) + 1) + name[pos + length]
        length *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(at: np.ndarray, gap: np.ndarray, length: int, shortest: int, power: int) -> np.ndarray:
    """Neighbouring occurrences of one difference, joined to the stretch that keeps this period."""
    order = np.argsort(at)
    at, gap = at[order], gap[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [len(at)])) - 1
    start, period = at[first], gap[first]
    total = at[last] + length + period - start
    whole = total >= np.maximum(shortest, power * period)
    return np.stack((start[whole], total[whole], period[whole]), axis=1)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _examined(ids: list, texts: list[list[bytes]], shortest: int, power: int, types: list[pa.DataType]) -> pa.RecordBatch:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    names = np.fromiter((number[w] for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
    runs = runs_of(names, np.repeat(ends, sizes), shortest, power)
    cut = np.searchsorted(runs[:, 0], np.concatenate(([0], ends)))
    rows, best, kept = [], [], []
    for i, words in enumerate(texts):
        mine = [(int(s - ends[i] + sizes[i]), int(n), int(p)) for s, n, p in runs[cut[i] : cut[i + 1]]]
        top = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        rows.append([dict(zip(_RUN.names, r)) for r in mine])
        best.append(top and dict(zip(_RUN.names, top)))
        kept.append(_collapsed(words, mine).decode("utf-8", "replace"))
    columns = [pa.array(ids, types[0]), pa.array(rows, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(kept, types[1])]
    return pa.RecordBatch.from_arrays(columns, ["id", "runs", "best", "collapsed"])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, power: int = 3
) -> DataFrame:
    """(id, runs, best, collapsed) per row: all runs by start and period, the run of greatest length by period (ties: smallest start,
    then period; null without a run), and the text's words without repetitions, joined by one space.

    ``power`` is the least number of periods, 3 or more.
    """
    if power < 3 or shortest < 1:
        raise ValueError("a run has three periods at least, and one word")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for part in slices(batches):
            types = [part.column(0).type, part.column(1).type]
            for key, data in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                words = data.split()
                ids.append(key)
                texts.append(words)
                held += len(words)
                if held >= PASS_WORDS:
                    yield _examined(ids, texts, shortest, power, types)
                    ids, texts, held = [], [], 0
        if ids:
            yield _examined(ids, texts, shortest, power, types)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, runs array<{RUN}>, best {RUN}, collapsed string")
