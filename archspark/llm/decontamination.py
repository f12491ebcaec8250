"""Benchmark decontamination with a distributed positional inverted index.

The index is dealt by document: each shard holds some documents' postings for every term, as one row of a written table
(documents with their first position, terms, and the ascending positions of each term; documents lie one after the other with a
gap). A shard is a row group of its own, so a task holds few of them however large its split is. No posting list is shuffled, so
frequent terms are no hot keys. A probe sends the windows of the test items to all shards, in blocks of bounded size. In a shard,
windows that lack a term are dropped by one table lookup; for the others the posting list of the rarest term gives starts, and the
lists of the other terms, shifted by their offsets, are intersected with them from rare to frequent. ``slop`` widens the match from
exact phrases to terms near their places.

Defined results: null and empty texts have no words and no hits; a null item has no window; items with the same
id are one item; every document row is counted by itself, repeated ids included; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import alnum_words, raw_texts, slices, staged

SHARD_WORDS = 1 << 19
GAP = 64


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write the index: one row per shard of about ``shard_words`` words (a longer document is a shard of its own)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, first array<bigint>, n_words array<bigint>, terms array<binary>, ends array<bigint>, positions binary"
    id_type = _arrow_type(rows)

    def shard(ids: list, docs_words: list[list[bytes]]) -> pa.RecordBatch:
        counts = np.array([len(w) for w in docs_words], np.int64)
        first = np.cumsum(counts + GAP) - counts - GAP
        codes: dict[bytes, int] = {}
        flat = np.fromiter((codes.setdefault(w, len(codes)) for words in docs_words for w in words), np.int32, int(counts.sum()))
        places = np.arange(len(flat)) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        order = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=len(codes)))
        one = [
            pa.array([ids], pa.list_(id_type)),
            pa.array([first], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([list(codes)], pa.list_(pa.binary())),
            pa.array([ends.astype(np.int64)], pa.list_(pa.int64())),
            pa.array([places[order].astype("<u4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(one, ["ids", "first", "n_words", "terms", "ends", "positions"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        size = 0
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                own = alnum_words(text)
                if ids and size + len(own) + GAP > shard_words:
                    yield shard(ids, words)
                    ids, words, size = [], [], 0
                ids.append(key)
                words.append(own)
                size += len(own) + GAP
        if ids:
            yield shard(ids, words)

    return staged(rows.mapInArrow(run, schema), "postings", group_rows=1)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


class Windows:
    """Distinct windows of a block of items, by length: rows of term codes, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.codes: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for number, (_, text) in enumerate(items):
            words = [self.codes.setdefault(w, len(self.codes)) for w in alnum_words(text)]
            for at in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[at : at + width]), set()).add(number)
        self.groups = []
        for length in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == length]
            self.groups.append((length, np.array(rows, np.int64), [sorted(found[w]) for w in rows]))
        self.terms = pa.array(list(self.codes), pa.binary())


def find_windows(windows: Windows, terms: pa.Array, ends: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(window length, items, starts) for each window that occurs in the shard."""
    place = pc.index_in(windows.terms, value_set=terms).fill_null(-1).to_numpy()
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    lo = np.where(place >= 0, starts[place] if len(ends) else 0, 0)
    hi = np.where(place >= 0, ends[place] if len(ends) else 0, 0)
    counts = hi - lo
    for length, rows, items in windows.groups:
        sizes = counts[rows]
        for k in np.flatnonzero(sizes.min(axis=1) > 0):
            row = rows[k]
            order = np.argsort(sizes[k], kind="stable")
            rare = order[0]
            base = positions[lo[row[rare]] : hi[row[rare]]].astype(np.int64) - rare
            for j in order[1:]:
                if not len(base):
                    break
                own = positions[lo[row[j]] : hi[row[j]]]
                want = base + j
                at = np.searchsorted(own, np.maximum(want - slop, 0).astype(own.dtype))
                ok = at < len(own)
                base, at, want = base[ok], at[ok], want[ok]
                base = base[own[at] <= want + slop]
            base = base[base >= 0]
            if len(base):
                yield length, items[k], base


def probe(index: DataFrame, items: list[tuple[str, bytes]], width: int = 10, slop: int = 0) -> DataFrame:
    """One row per indexed document: (shard_row, doc, id, n_words, items array, runs array of [start, end))."""
    windows = Windows(items, width)
    sent = index.sparkSession.sparkContext.broadcast(windows)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc string, id {kind}, n_words bigint, items array<string>, runs array<struct<s:bigint,e:bigint>>"
    runs_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in slices(batches, 1):
            part = batch.column("part")[0].as_py()
            first = batch.column("first").flatten().to_numpy()
            n_words = batch.column("n_words").flatten()
            positions = np.frombuffer(batch.column("positions")[0].as_py(), "<u4")
            spans: dict[int, list[tuple[int, int]]] = {}
            named: dict[int, set[int]] = {}
            for length, owners, starts in find_windows(windows, batch.column("terms").flatten(), batch.column("ends").flatten().to_numpy(), positions, slop):
                for doc, start in zip(np.searchsorted(first, starts, side="right") - 1, starts):
                    at = int(start - first[doc])
                    spans.setdefault(int(doc), []).append((at, at + length))
                    named.setdefault(int(doc), set()).update(owners)
            n = len(first)
            out = [
                pa.array([f"{part}:{i}" for i in range(n)]),
                batch.column("ids").flatten(),
                n_words,
                pa.array([[windows.names[i] for i in sorted(named.get(d, ()))] for d in range(n)], pa.list_(pa.string())),
                pa.array([[{"s": s, "e": e} for s, e in merged(spans.get(d, []))] for d in range(n)], runs_type),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc", "id", "n_words", "items", "runs"])

    shards = index.withColumn("part", F.monotonically_increasing_id().cast("string"))
    return shards.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def covered(runs: Column) -> Column:
    """Words inside any of the runs; the array may hold overlapping runs."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = F.aggregate(
        F.array_sort(runs),
        start,
        lambda acc, r: F.struct(
            F.greatest(acc["to"], r["e"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(acc["to"], r["s"]))).alias("n"),
        ),
    )
    return step["n"]


def contaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    slop: int = 0,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: id, n_words, items (sorted ids as strings), runs (hit word ranges), n_hit.

    The words of an item without an id count as hit; it has no name to list. Items are taken in blocks of about ``block_bytes`` of text, one broadcast each; a longer item is a block of its own.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = items.filter("text is not null").groupBy("item", "text").count().drop("count")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    parts = []
    if blocks > 1:
        items = staged(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "items")
    for block in range(blocks):
        own = items.filter(F.col("block") == block) if blocks > 1 else items
        parts.append(probe(index, [(r["item"], r["text"].encode()) for r in own.orderBy("item", "text").collect()], width, slop))
    found = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionAll(part)
        found = found.groupBy("doc").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("items")).alias("items"),
            F.flatten(F.collect_list("runs")).alias("runs"),
        )
    return found.select("id", "n_words", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items"), "runs", covered(F.col("runs")).alias("n_hit"))
