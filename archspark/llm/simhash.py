"""SimHash near-duplicates with vantage-point trees over Hamming distance.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of a text's word shingles. Documents
with equal fingerprints are one point. Points are dealt to shards by a vantage-point tree that is built
on a bounded sample: a point's home is the leaf it falls into; where the triangle inequality allows a
neighbour beyond a boundary, it also visits the shards over there as a guest. So every linked pair meets in
the home shard of one of them. In a shard, points are compared only if their distances to each of two local vantage
points differ by no more than the radius, and a shard returns no more links than it has points (a forest of the local
components). Components of all links are found by alternating star steps.

Defined results: null or empty text has no shingles and fingerprint zero, which links like any other;
texts of fewer words than a shingle are one shingle; repeated rows share the component; a null id is never a
component's name while another id is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import raw_texts, slices, space_words, staged

SEED = 42


def fingerprint(data: bytes, width: int = 4) -> int:
    """64 bits; ties of set and unset count as unset."""
    import xxhash

    words = space_words(data)
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, votes, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - width + 1
    for at in range(0, total, 65536):
        to = min(at + 65536, total)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64, to - at)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, width) for t in raw_texts(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def build_tree(sample: np.ndarray, weight: float, leaf: int, radius: int, rng: np.random.Generator):
    """Nested (vantage, median, inside, outside); None is a leaf. Of a few vantage points the one whose boundary has least is taken."""
    if len(sample) * weight <= leaf or len(sample) < 8:
        return None
    best = None
    for v in rng.choice(sample, size=min(12, len(sample)), replace=False):
        d = np.bitwise_count(sample ^ v)
        cut = int(np.median(d))
        inside = d <= cut
        cut -= int(inside.all())
        inside = d <= cut
        share = inside.mean()
        if not 0.2 <= share <= 0.8:
            continue
        cost = np.mean((d > cut - radius) & (d <= cut + radius)) + abs(share - 0.5)
        if best is None or cost < best[0]:
            best = (cost, v, cut, inside)
    if best is None:
        return None
    _, v, cut, inside = best
    return (v, cut, build_tree(sample[inside], weight, leaf, radius, rng), build_tree(sample[~inside], weight, leaf, radius, rng))


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, row numbers, at home?) for each leaf that rows reach."""
    stack = [(tree, 1, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, name, rows, home = stack.pop()
        if not len(rows):
            continue
        if node is None:
            yield name, rows, home
            continue
        v, cut, inside, outside = node
        d = np.bitwise_count(fps[rows] ^ v).astype(np.int64)
        near, far = d <= cut, d > cut
        visits = near | (~home & (d <= cut + radius))  # whoever is at home outside stays there; inner points visit it
        stack.append((inside, 2 * name, rows[visits], home[visits] & near[visits]))
        visits = far | (d > cut - radius)
        stack.append((outside, 2 * name + 1, rows[visits], home[visits] & far[visits]))


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smallest point of its local component) of all pairs with at least one point at home."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    label = np.arange(len(fps))
    first = fps[len(fps) // 2]
    d = np.bitwise_count(fps ^ first).astype(np.int64)
    second = fps[np.argmin(np.abs(d - 32))]
    cell = d * 65 + np.bitwise_count(fps ^ second)
    by_cell = np.argsort(cell, kind="stable")
    names, at = np.unique(cell[by_cell], return_index=True)
    members = dict(zip(names.tolist(), np.split(by_cell, at[1:])))
    for name, own in members.items():
        mine = own[home[own]]
        if not len(mine):
            continue
        k, m = divmod(name, 65)
        near = [members.get(i * 65 + j) for i in range(k - radius, k + radius + 1) for j in range(max(0, m - radius), min(64, m + radius) + 1)]
        others = np.concatenate([x for x in near if x is not None])
        theirs = fps[others][None, :]
        step = max(1, 100_000 // len(others))  # the block stays in a core's cache
        for start in range(0, len(mine), step):
            rows = mine[start : start + step]
            close = np.bitwise_count(fps[rows][:, None] ^ theirs) <= radius
            if not close.any():
                continue
            a, b = np.nonzero(close)
            a, b = rows[a], others[b]
            keep = a != b
            a, b = a[keep], b[keep]
            while len(a):  # hook the larger root to the smaller one, then shorten the paths
                ra, rb = label[a], label[b]
                split = ra != rb
                if not split.any():
                    break
                a, b, ra, rb = a[split], b[split], ra[split], rb[split]
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
                while True:
                    short = label[label]
                    if np.array_equal(short, label):
                        break
                    label = short
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fps[linked], fps[label[linked]]


def near_links(points: DataFrame, radius: int = 4, leaf: int = 32768, sample_rows: int = 20000) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints within the radius; ``points`` has distinct fp.

    The tree is fitted on ``sample_rows`` fingerprints at most, those of smallest hash.
    """
    n = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(sample, n / max(1, len(sample)), leaf, radius, np.random.default_rng(SEED))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for shard, rows, home in route(tree, fps, radius):
                shards = np.full(len(rows), shard, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fps[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(fps, table.column("home").to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node; root is the smallest node of the component.

    Alternating star steps: each node's larger neighbours, then its smaller ones, are tied to the smallest node it
    knows, until nothing changes. Only a count and a checksum reach the driver.
    """

    def tied(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = staged(edges.filter("a <> b").distinct(), "near-edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return edges, tuple(mark)

    edges, mark = tied(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near-least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, _ = tied(large)
        least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "near-least")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges, now = tied(small)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id that links reach)."""
    marked = staged(fingerprints(docs, id_col, text_col, width), "near-fingerprints")
    points = staged(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "near-points")
    roots = staged(components(near_links(points, radius)), "near-roots")
    linked = staged(points.join(roots, points.fp == roots.node).select("fp", "first_id", "root"), "near-linked")
    least = staged(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "near-components")
    named = linked.join(least, "root").select(F.col("fp").alias("linked_fp"), F.col("component_id").alias("linked_id"))
    points = staged(
        points.join(named, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id")),
        "near-named",
    )
    return marked.join(points, "fp").select("id", "fp", "component_id")
