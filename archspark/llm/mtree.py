"""Exact top-k inner products with M-trees and best-first search.

Components become whole numbers. With one more coordinate that brings every candidate to the norm of the longest one (and is
0 for queries), the largest inner product is the nearest point in Euclidean distance, so a metric tree gives exact results.
Candidates are dealt to trees by a hash of their id. A tree is a set of pages in a written table; an entry of an inner page holds a
routing object, its covering radius, its distance to the parent's routing object and its child page; an entry of a leaf holds a
vector, its id and its distance to the leaf's routing object. Blocks of queries meet every tree. A search
takes pages by their least possible distance. By the triangle inequality, stored parent distances and radii rule out entries
before their distances are computed. Bounds are floating point with a slack; scores and ties are whole numbers and exact.

Defined results: rows with a null id, a null vector or a null or non-finite component take no part; of rows that repeat an id, the
smallest vector counts; vectors of different length never meet; an empty vector scores 0; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.llm.common import staged

PAGE = 1024
FANOUT = 32
TURN = 8
SLACK = 1e-6


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): usable vectors as whole numbers."""
    wide = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return wide.filter(usable).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


class Builder:
    """Bulk load: routing objects are drawn from the points, the others join the nearest, and so on down to full pages."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, lift: np.ndarray, seed: int):
        self.ids, self.points, self.lift = ids, points, lift
        self.rng = np.random.default_rng(seed)
        self.pages: list[dict] = []
        if len(ids):
            self.node(np.arange(len(ids)), None)

    def distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        d = self.points[rows] - self.points[to]
        return np.sqrt((d * d).sum(axis=1) + (self.lift[rows] - self.lift[to]) ** 2)

    def node(self, rows: np.ndarray, parent: int | None) -> int:
        number = len(self.pages)
        self.pages.append({})
        if len(rows) <= PAGE:
            entries, radii, children = rows, np.zeros(len(rows)), np.full(len(rows), -1)
        else:
            groups = self.split(rows)
            entries = np.array([g[0] for g in groups])
            radii = np.array([self.distances(g[1], g[0]).max() for g in groups])
            children = np.array([self.node(g[1], g[0]) for g in groups])
        up = self.distances(entries, parent) if parent is not None else np.zeros(len(entries))
        self.pages[number] = {
            "page": number, "ids": self.ids[entries], "points": self.points[entries].astype("<i8").tobytes(),
            "lift": self.lift[entries], "radii": radii, "up": up, "children": children,
        }
        return number

    def split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        k = min(FANOUT, -(-len(rows) // PAGE) + 1)
        routing = self.rng.choice(rows, size=k, replace=False)
        nearest = np.argmin(np.stack([self.distances(rows, r) for r in routing]), axis=0)
        groups = [(int(r), rows[nearest == i]) for i, r in enumerate(routing) if (nearest == i).any()]
        if len(groups) > 1:
            return groups
        return [(int(part[0]), part) for part in np.array_split(rows, k)]  # equal points


class Tree:
    def __init__(self, pages: list[dict]):
        self.pages = {}
        for p in pages:
            n = len(p["ids"])
            points = np.frombuffer(p["points"], "<i8").reshape(n, -1).astype(np.float64)
            self.pages[p["page"]] = (np.asarray(p["ids"]), points, np.asarray(p["lift"]), np.asarray(p["radii"]), np.asarray(p["up"]), np.asarray(p["children"]))

    def distances(self, number: int, queries: np.ndarray, norms: np.ndarray, longest: float) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms[:, None] + longest - 2.0 * (queries @ self.pages[number][1].T)))

    def leaves(self, queries: np.ndarray, norms: np.ndarray, longest: float) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Leaf pages, the least possible distance of each query to each of them, and its distance to their routing objects."""
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        n = len(queries)
        queue = [(0, np.zeros(n), np.full(n, np.nan))] if self.pages else []
        while queue:
            number, least, to_parent = queue.pop()
            _, _, _, radii, _, children = self.pages[number]
            if children[0] < 0:
                found.append((number, least, to_parent))
                continue
            far = self.distances(number, queries, norms, longest)
            bounds = np.maximum(least[:, None], far - radii - SLACK * (1 + far))
            queue += [(int(child), bounds[:, j], far[:, j]) for j, child in enumerate(children)]
        if not found:
            return [], np.zeros((n, 0)), np.zeros((n, 0))
        return [f[0] for f in found], np.stack([f[1] for f in found], axis=1), np.stack([f[2] for f in found], axis=1)

    def search(self, own: np.ndarray, queries: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of each query, ties to the smaller id; missing ones score minus infinity.

        Every query takes its leaves by their bounds, some in a turn, until a bound is beyond its k-th best; the queries of
        a turn that take the same page read it together.
        """
        n = len(queries)
        norms = (queries * queries).sum(axis=1)
        names, bounds, to_routing = self.leaves(queries, norms, longest)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        reach = np.full(n, np.inf)
        order = np.argsort(bounds, axis=1, kind="stable")
        for turn in range(0, len(names), TURN):
            part = order[:, turn : turn + TURN]
            active = np.take_along_axis(bounds, part, 1) <= reach[:, None]
            if not active.any():
                break
            found = [(np.repeat(np.arange(n), k), ids.ravel(), scores.ravel())]
            for leaf in np.unique(part[active]):
                rows = np.flatnonzero(((part == leaf) & active).any(axis=1))
                found.append(self.read_leaf(names[leaf], rows, to_routing[rows, leaf], own, queries, scores[:, -1], reach, k))
            row, other, score = (np.concatenate(x) for x in zip(*found))
            first = np.lexsort((other, -score, row))
            row = row[first]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = first[rank < k]
            scores, ids = score[best].reshape(n, k), other[best].reshape(n, k)
            full = np.isfinite(scores[:, -1])
            near = np.sqrt(np.maximum(0.0, norms + longest - 2.0 * np.where(full, scores[:, -1], 0.0)))
            reach = np.where(full, near + SLACK * (1 + near), np.inf)
        return scores, ids

    def read_leaf(self, number, rows, to_routing, own, queries, worst, reach, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of a leaf that may be among the best of some queries; what parent distances rule out isn't computed."""
        names, points, _, _, up, _ = self.pages[number]
        may = ~(np.abs(up - to_routing[:, None]) > reach[rows][:, None])  # a leaf that is the root has no routing object
        columns = np.flatnonzero(may.any(axis=0))
        dots = queries[rows] @ points[columns].T
        dots[~may[:, columns] | (names[columns] == own[rows][:, None])] = -np.inf
        least = worst[rows]
        if len(columns) > k:  # no more than k of a page, and those that tie with the k-th, can be among the best
            some = np.flatnonzero(dots.max(axis=1) >= least)
            least[some] = np.maximum(least[some], np.partition(dots[some], len(columns) - k, axis=1)[:, len(columns) - k])
        hit, column = np.nonzero((dots >= least[:, None]) & np.isfinite(dots))
        return rows[hit], names[columns[column]], dots[hit, column]


PAGES = "tree bigint, page bigint, ids array<bigint>, points binary, lift array<double>, radii array<double>, up array<double>, children array<bigint>"


def build_trees(vectors: DataFrame, longest: float, tree_rows: int) -> DataFrame:
    """Write the pages of all trees; ``vectors`` has (dim, tree, id, v)."""

    def build(table: pa.Table) -> pa.Table:
        ids, points = distinct_rows(table)
        lift = np.sqrt(np.maximum(0.0, longest - (points * points).sum(axis=1)))
        tree = table.column("tree")[0].as_py()
        pages = Builder(ids, points, lift, tree).pages
        columns = {c: [p[c] for p in pages] for c in ("page", "ids", "points", "lift", "radii", "up", "children")}
        fixed = {"dim": pa.array([table.column("dim")[0].as_py()] * len(pages), pa.int32()), "tree": [tree] * len(pages)}
        return pa.table(fixed | columns)

    return staged(vectors.groupBy("dim", "tree").applyInArrow(build, "dim int, " + PAGES), "mtree-pages")


def distinct_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and points (float64, whole); of a repeated id the smallest vector."""
    dim = table.column("dim")[0].as_py()
    ids = table.column("id").to_numpy()
    points = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim) if dim else np.zeros((len(ids), 0))
    order = np.lexsort((*points.T[::-1], ids))
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    return ids[order][first], points[order][first].astype(np.float64)


def top_inner_products(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    tree_rows: int = 16384,
    block_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with other rows. ``is_query`` is on column ``id``."""
    vectors = staged(whole_vectors(rows, id_col, vector_col, scale).withColumn("dim", F.size("v")), "mtree-vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    n, longest = vectors.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).first()
    trees = max(1, -(-n // tree_rows))
    spread = F.xxhash64(F.col("id"))
    pages = build_trees(vectors.withColumn("tree", F.pmod(spread, F.lit(trees))), float(longest), tree_rows)
    queries = vectors.filter(is_query)
    blocks = max(1, -(-queries.count() // block_rows))
    queries = queries.withColumn("block", F.pmod(spread, F.lit(blocks)))
    queries = queries.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))
    dealt = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    top = float(longest)

    def search(queries: pa.Table, pages: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if queries.num_rows and pages.num_rows:
            own, points = distinct_rows(queries)
            scores, ids = Tree(pages.to_pylist()).search(own, points, top, k)
            some = np.isfinite(scores)
            found = [np.repeat(own, some.sum(axis=1)), ids[some], scores[some].astype(np.int64)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    keys = ("dim", "tree", "block")
    found = queries.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
